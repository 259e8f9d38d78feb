"""One record at a time in plain Python: what the Spark lowering is held against."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from siftwright.errors import MissingField
from siftwright.functions.base import is_literal, literal_value
from siftwright.plans import regexes
from siftwright.plans.nodes import Access, At, Call, Compare, Each, FieldRef, Group, Key, Logic, Not, Quantifier
from siftwright.sources.records import Record

ASCII_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ORDER: dict[str, Callable[[Any, Any], bool]] = {
    "Equal": lambda a, b: a == b,
    "NotEqual": lambda a, b: a != b,
    "GreaterThanEqual": lambda a, b: a >= b,
    "LessThanEqual": lambda a, b: a <= b,
    "GreaterThan": lambda a, b: a > b,
    "LessThan": lambda a, b: a < b,
}


def glob_matches(pieces: list[bytes], data: bytes) -> bool:
    if len(pieces) == 1:
        return data == pieces[0]
    first, *middle, last = pieces
    if not data.startswith(first) or not data.endswith(last) or len(data) < len(first) + len(last):
        return False
    at, stop = len(first), len(data) - len(last)
    for piece in middle:
        found = data.find(piece, at, stop)
        if found < 0:
            return False
        at = found + len(piece)
    return True


class Interpreter:
    """Evaluates trees of a scheme; ``fetch(field)`` gives a field's value or None. Byte strings are bytes, addresses packed."""

    def __init__(self, scheme: Any, fetch: Callable[[FieldRef], Any]) -> None:
        self.scheme, self.fetch = scheme, fetch

    # ---- values

    def value(self, node: Any) -> Any:
        if is_literal(node):
            return literal_value(node)
        if not isinstance(node, Access):
            return self.vec(node) if node.type.name == "Array" else self.truth(node)
        if node.each:
            # As an argument of a mapped call, and nowhere else.
            return self.container(node)
        v = self.base(node.base)
        for step in node.steps:
            v = self.step(v, step)
        return v

    def step(self, v: Any, step: Any) -> Any:
        if v is None:
            return None
        if isinstance(step, At):
            return v[step.index] if step.index < len(v) else None
        return v.get(step.key.encode())

    def base(self, node: FieldRef | Call) -> Any:
        if isinstance(node, FieldRef):
            return self.fetch(node)
        if not node.mapped:
            return node.function.evaluate([self.value(a) for a in node.args], node.context)
        items = self.container(node.args[0])
        if items is None:
            return None
        rest = [self.value(a) for a in node.args[1:]]
        out = (node.function.evaluate([x, *rest], node.context) for x in items)
        return [x for x in out if x is not None]

    def container(self, node: Access) -> list | None:
        """All elements that the steps reach, in order; None if the way to the first ``[*]`` is missing."""
        v, mapped = self.base(node.base), False
        for step in node.steps:
            if isinstance(step, Each):
                if mapped:
                    v = [y for x in v for y in self.items(x)]
                else:
                    v, mapped = (None if v is None else list(self.items(v))), True
            elif mapped:
                v = [y for x in v if (y := self.step(x, step)) is not None]
            else:
                v = self.step(v, step)
            if v is None:
                return None
        return v

    @staticmethod
    def items(v: Any) -> Iterator[Any]:
        return iter(v) if isinstance(v, list) else (v[k] for k in sorted(v))

    # ---- predicates

    def leaf(self, node: Compare, v: Any) -> bool:
        """A comparison of a value that is not missing."""
        op, right = node.op, node.right
        kind = node.left.type
        if op == "IsTrue":
            return v
        if op in ORDER:
            if kind.name == "Ip" and op not in ("Equal", "NotEqual"):
                return len(v) == len(right.packed) and ORDER[op](v, right.packed)
            return ORDER[op](v, literal_value(right))
        if op == "BitwiseAnd":
            return v & right.value != 0
        if op == "Contains":
            return right.data in v
        if op == "Matches":
            return regexes.python(right.text).search(v.decode("latin-1")) is not None
        if op == "Strict Wildcard":
            return glob_matches(right.pieces(), v)
        if op == "Wildcard":
            return glob_matches([p.translate(ASCII_FOLD) for p in right.pieces()], v.translate(ASCII_FOLD))
        if op == "OneOf":
            if kind.name == "Bytes":
                return any(v == x.data for x in right)
            return any((kind.name == "Int" or len(x.first) == len(v)) and x.first <= v <= x.last for x in right)
        if op == "ContainsOneOf":
            return any(x.data in v for x in right)
        return self.scheme.lists[kind].match(right, v)

    def truth(self, node: Any) -> bool:
        if isinstance(node, Group):
            return self.truth(node.inner)
        if isinstance(node, Not):
            return not self.truth(node.arg)
        if isinstance(node, Logic):
            if node.op == "And":
                return all(map(self.truth, node.items))
            if node.op == "Or":
                return any(map(self.truth, node.items))
            return sum(map(self.truth, node.items)) % 2 == 1
        if isinstance(node, Quantifier):
            if isinstance(node.arg, Access):
                v = self.value(node.arg)
                if v is None:
                    return False
            else:
                v = self.vec(node.arg)
            return any(v) if node.op == "Any" else all(v)
        v = self.value(node.left)
        if v is None:
            return node.op == "NotEqual" and self.scheme.nil_not_equal
        return self.leaf(node, v)

    def vec(self, node: Any) -> list[bool]:
        if isinstance(node, Group):
            return self.vec(node.inner)
        if isinstance(node, Not):
            return [not x for x in self.vec(node.arg)]
        if isinstance(node, Logic):
            rows = zip(*map(self.vec, node.items))
            fold = {"And": all, "Or": any, "Xor": lambda r: sum(r) % 2 == 1}[node.op]
            return [fold(r) for r in rows]
        if node.left.each:
            return [self.leaf(node, x) for x in self.container(node.left) or []]
        return self.value(node.left) or []


class LocalRecord(Record):
    """A record that answers filters itself."""

    def _fetch(self, ref: FieldRef) -> Any:
        value = self._values.get(ref.name)
        if value is None and not ref.optional:
            raise MissingField(f"mandatory field {ref.name} has no value")
        return value

    def matches(self, filter_: Any) -> bool:
        return Interpreter(self.scheme, self._fetch).truth(filter_.node)

    def value(self, filter_: Any) -> Any:
        return Interpreter(self.scheme, self._fetch).value(filter_.node)
