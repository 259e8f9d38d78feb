"""How functions are declared: for the parser, for the row interpreter and for Spark."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from ..plans.nodes import BytesLit, IntLit, IpLit
from ..types import Type

LITERALS = (BytesLit, IntLit, IpLit)


class Refused(Exception):
    """An argument does not fit: ``kind`` is the parse error's, ``reason`` its text."""

    def __init__(self, kind: str, reason: str) -> None:
        super().__init__(reason)
        self.kind, self.reason = kind, reason


def literal_value(lit: Any) -> Any:
    return lit.data if isinstance(lit, BytesLit) else lit.value if isinstance(lit, IntLit) else lit.packed


def is_literal(arg: Any) -> bool:
    return isinstance(arg, LITERALS)


def arg_type(arg: Any) -> Type:
    """The type that a function sees: of a mapped argument, that of one element."""
    return arg.type


class Function:
    """The parser asks ``arg_count``, ``check_param`` for each argument and ``return_type``; the rest evaluates calls.

    ``evaluate`` gets one value or None (missing) for each argument, ``column`` a :class:`~siftwright.plans.lower.Value`
    (with ``column``, ``type`` and ``text``) for each and the type to return; both give None or NULL for a missing result.
    """

    Refused = Refused

    def arg_count(self) -> tuple[int, int | None]:
        """How many arguments must be there, and how many more may be (None: any number)."""
        raise NotImplementedError

    def context(self) -> Any:
        """A fresh box for what a call learns while it is parsed."""
        return None

    def check_param(self, settings: Any, before: Sequence[Any], arg: Any, context: Any) -> None:
        """Raises :class:`Refused` if ``arg`` must not follow the arguments before it."""

    def return_type(self, args: Sequence[Any], context: Any) -> Type:
        raise NotImplementedError

    def evaluate(self, values: list[Any], context: Any) -> Any:
        raise NotImplementedError

    def column(self, values: list[Any], returns: Type, context: Any) -> Any:
        raise NotImplementedError

    #: Whether ``column`` runs Python, which Spark does not allow inside array functions.
    python = False
    #: Whether a call with all its arguments there always has a result; then a mapped call keeps all elements.
    total = False


def expect_type(arg: Any, allowed: Sequence[Type | str], index: int) -> None:
    """``allowed``: types, or the name of a container of any items."""
    t = arg_type(arg)
    if not any(t == a or t.name == a for a in allowed):
        shown = " or ".join(f"{a}<_>" if isinstance(a, str) else str(a) for a in allowed)
        raise Refused("InvalidArgumentType", f"expected value of type {shown}, but got {t}")


def expect_literal(arg: Any, check: Callable[[Any], str | None] | None = None) -> Any:
    """A constant argument's value; ``check`` returns why it is wrong, or None."""
    if not is_literal(arg):
        raise Refused("InvalidArgumentKind", "expected argument of kind literal, but got field")
    value = literal_value(arg)
    if check and (reason := check(value)):
        raise Refused("InvalidArgumentValue", reason)
    return value


class SimpleFunction(Function):
    """A function of fixed types. ``params``: (kind, type), kind being literal, field or both; ``optional``: (kind, default literal)."""

    def __init__(self, params: Sequence[tuple[str, Type]], returns: Type, evaluate: Callable, column: Callable | None = None, optional: Sequence[tuple[str, Any]] = (), python: bool = False, total: bool = False) -> None:
        self.params, self.returns, self.optional, self.python, self.total = list(params), returns, list(optional), python, total
        self._evaluate, self._column = evaluate, column

    def arg_count(self) -> tuple[int, int | None]:
        return len(self.params), len(self.optional)

    def check_param(self, settings: Any, before: Sequence[Any], arg: Any, context: Any) -> None:
        i = len(before)
        kind, wanted = self.params[i] if i < len(self.params) else (self.optional[i - len(self.params)][0], self.optional[i - len(self.params)][1].type)
        actual = "literal" if is_literal(arg) else "field"
        if kind not in ("both", actual):
            raise Refused("InvalidArgumentKind", f"expected argument of kind {kind}, but got {actual}")
        expect_type(arg, [wanted], i)

    def return_type(self, args: Sequence[Any], context: Any) -> Type:
        return self.returns

    def _filled(self, values: list[Any], wrap: Callable) -> list[Any]:
        return values + [wrap(lit) for _, lit in self.optional[len(values) - len(self.params) :]]

    def evaluate(self, values: list[Any], context: Any) -> Any:
        return self._evaluate(*self._filled(values, literal_value))

    def column(self, values: list[Any], returns: Type, context: Any) -> Any:
        from ..plans.lower import literal

        if self._column is None:
            raise NotImplementedError("the function has no Spark form")
        return self._column(*self._filled(values, literal))
