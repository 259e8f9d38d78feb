"""The functions that come with the library."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.nodes import BytesLit, IntLit
from ..types import BOOL, BYTES, INT, Array, Map, Type
from .base import Function, SimpleFunction, arg_type, expect_type

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Concat(Function):
    """Joins two or more byte strings, or arrays of one type. Missing arguments are skipped; all missing is missing."""

    total = True

    def arg_count(self) -> tuple[int, int | None]:
        return 2, None

    def check_param(self, settings: Any, before: Sequence[Any], arg: Any, context: Any) -> None:
        expect_type(arg, [arg_type(before[0])] if before else [BYTES, "Array"], len(before))

    def return_type(self, args: Sequence[Any], context: Any) -> Type:
        return arg_type(args[0])

    def evaluate(self, values: list[Any], context: Any) -> Any:
        there = [v for v in values if v is not None]
        if not there:
            return None
        return b"".join(there) if isinstance(there[0], bytes) else [x for v in there for x in v]

    def column(self, values: list[Any], returns: Type, context: Any) -> Column:
        if returns == BYTES:
            text = all(v.text for v in values)
            columns = [v.column if text or not v.text else v.column.cast("binary") for v in values]
            empty = F.lit("" if text else b"")
        else:
            columns, empty = [v.column for v in values], F.array().cast(returns.spark(values[0].text))
        return F.when(F.coalesce(*columns).isNotNull(), F.concat(*[F.coalesce(c, empty) for c in columns]))


class Keep(Function):
    """``filter(array, flags)``: the items whose flag is true; the longer one is cut off."""

    def arg_count(self) -> tuple[int, int | None]:
        return 2, 0

    def check_param(self, settings: Any, before: Sequence[Any], arg: Any, context: Any) -> None:
        expect_type(arg, [Array(BOOL)] if before else ["Array"], len(before))

    def return_type(self, args: Sequence[Any], context: Any) -> Type:
        return arg_type(args[0])

    def evaluate(self, values: list[Any], context: Any) -> Any:
        items, flags = values
        return None if items is None or flags is None else [x for x, keep in zip(items, flags) if keep]

    def column(self, values: list[Any], returns: Type, context: Any) -> Column:
        items, flags = (v.column for v in values)
        return F.when(flags.isNotNull(), F.filter(items, lambda x, i: F.coalesce(F.get(flags, i), F.lit(False))))


class Wrap(Function):
    """An array of the one argument, nested ``layers`` deep."""

    def __init__(self, layers: int = 1) -> None:
        self.layers = layers

    def arg_count(self) -> tuple[int, int | None]:
        return 1, 0

    def check_param(self, settings: Any, before: Sequence[Any], arg: Any, context: Any) -> None:
        expect_type(arg, [BYTES], 0)

    def return_type(self, args: Sequence[Any], context: Any) -> Type:
        return Array(BYTES) if self.layers == 1 else Array(Array(BYTES))

    def evaluate(self, values: list[Any], context: Any) -> Any:
        return None if values[0] is None else [values[0]] if self.layers == 1 else [[values[0]]]

    def column(self, values: list[Any], returns: Type, context: Any) -> Column:
        c = values[0].column
        return F.when(c.isNotNull(), F.array(c) if self.layers == 1 else F.array(F.array(c)))


def _ascii(source: str, target: str, change: str) -> SimpleFunction:
    def column(v: Any) -> Column:
        if v.text:
            return F.translate(v.column, source, target)
        return F.encode(F.translate(F.decode(v.column, "ISO-8859-1"), source, target), "ISO-8859-1")

    return SimpleFunction([("both", BYTES)], BYTES, lambda b: None if b is None else getattr(b, change)(), column, total=True)


def lower() -> SimpleFunction:
    """ASCII letters in lower case."""
    return _ascii(UPPER, LOWER, "lower")


def upper() -> SimpleFunction:
    """ASCII letters in upper case."""
    return _ascii(LOWER, UPPER, "upper")


def length() -> SimpleFunction:
    """The number of bytes."""
    return SimpleFunction([("both", BYTES)], INT, lambda b: None if b is None else len(b), lambda v: F.octet_length(v.column).cast("bigint"), total=True)


def echo() -> SimpleFunction:
    """Its argument; two optional numbers do nothing."""
    return SimpleFunction([("field", BYTES)], BYTES, lambda b, _x, _y: b, lambda v, _x, _y: v.column, optional=[("literal", IntLit(10)), ("literal", IntLit(1))])


def first() -> SimpleFunction:
    """The value of the least key of a map."""
    return SimpleFunction([("field", Map(BYTES))], BYTES, lambda m: None if not m else m[min(m)], lambda v: F.get(F.map_values(v.column), F.array_position(F.map_keys(v.column), F.array_min(F.map_keys(v.column))).cast("int") - 1))


def regex_replace() -> SimpleFunction:
    """Replaces what a literal regular expression matches by a literal text, byte-wise."""
    from ..plans import regexes

    def column(v: Any, pattern: Any, by: Any) -> Column:
        raw = F.decode(v.column.cast("binary"), "ISO-8859-1")
        done = F.regexp_replace(raw, F.lit(regexes.java(pattern.literal.decode())), F.lit(re.sub(r"([\\$])", r"\\\1", by.literal.decode("latin-1"))))
        out = F.encode(done, "ISO-8859-1")
        return F.decode(out, "UTF-8") if v.text else out

    def evaluate(b: bytes | None, pattern: bytes, by: bytes) -> bytes | None:
        return None if b is None else regexes.python(pattern.decode()).sub(lambda _: by.decode("latin-1"), b.decode("latin-1")).encode("latin-1")

    return SimpleFunction([("field", BYTES), ("literal", BYTES), ("literal", BYTES)], BYTES, evaluate, column)


def fail() -> SimpleFunction:
    """Raises an error wherever it is evaluated."""

    def evaluate(_b: Any, _more: Any) -> Any:
        raise RuntimeError("the function `panic` was called")

    return SimpleFunction([("field", BYTES)], BYTES, evaluate, lambda _v, _more: F.raise_error(F.lit("the function `panic` was called")).cast("string"), optional=[("literal", BytesLit(b""))])


def standard() -> dict[str, Function]:
    return {
        "concat": Concat(), "lower": lower(), "lowercase": lower(), "upper": upper(), "uppercase": upper(), "len": length(), "echo": echo(), "filter": Keep(),
        "array": Wrap(), "array2": Wrap(2), "first": first(), "regex_replace": regex_replace(),
    }
