"""From trees to Spark columns.

Three mutually recursive functions, each with a promise: ``value`` gives a column whose NULL means missing, ``truth`` a
boolean that is never NULL, ``vec`` an array of booleans that is never NULL and holds none. Leaves are written as
``x IS NOT NULL AND ...`` (not with coalesce), so that scans can take them over.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.base import is_literal, literal_value
from ..types import Type
from . import regexes
from .nodes import Access, At, Call, Compare, Each, FieldRef, Group, Logic, Not, Quantifier

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "Equal": lambda a, b: a == b,
    "NotEqual": lambda a, b: a != b,
    "GreaterThanEqual": lambda a, b: a >= b,
    "LessThanEqual": lambda a, b: a <= b,
    "GreaterThan": lambda a, b: a > b,
    "LessThan": lambda a, b: a < b,
}
FOLDS: dict[str, Callable[[Column, Column], Column]] = {"And": lambda a, b: a & b, "Or": lambda a, b: a | b, "Xor": lambda a, b: a != b}


@dataclass
class Value:
    """A column of a type; ``text``: byte strings inside are Spark strings, not binary. ``literal``: a constant's value.
    ``dense``: an array whose type says that no item is NULL."""

    column: Column
    type: Type
    text: bool = True
    literal: Any = None
    dense: bool = False


def _utf8(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def literal(lit: Any) -> Value:
    v = literal_value(lit)
    if lit.type.name == "Bytes":
        s = _utf8(v)
        return Value(F.lit(v if s is None else s), lit.type, s is not None, v)
    return Value(F.lit(v), lit.type, True, v)


def merged(spans: list[tuple[Any, Any]]) -> list[tuple[Any, Any]]:
    """Sorted spans; those that overlap or touch (integers) are one."""
    out: list[tuple[Any, Any]] = []
    for first, last in sorted(spans):
        if out and (first <= out[-1][1] or (isinstance(first, int) and first == out[-1][1] + 1)):
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def any_of(columns: list[Column]) -> Column:
    """A balanced disjunction, so that many items do not nest deeply."""
    while len(columns) > 1:
        columns = [columns[i] | columns[i + 1] if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    return columns[0] if columns else F.lit(False)


class Lowering:
    """Subclass and override ``leaf`` (or any other method) for another compilation of some nodes.

    ``fields``: the bound column of each field. ``flags``: columns that stand for some comparisons (list memberships
    that were joined). ``members``: for memberships under ``[*]``, an array of those of a row's elements that are in the list.
    """

    def __init__(self, scheme: Any, fields: dict[str, Value], flags: dict[Compare, Column] | None = None, members: dict[Compare, Column] | None = None) -> None:
        self.scheme, self.fields = scheme, fields
        self.flags, self.members = {} if flags is None else flags, {} if members is None else members

    # ---- values

    def value(self, node: Any) -> Value:
        if is_literal(node):
            return literal(node)
        if not isinstance(node, Access):
            return Value(self.vec(node) if node.type.name == "Array" else self.truth(node), node.type)
        v = self.base(node.base)
        for s in node.steps:
            v = Value(self.step(v.column, s), v.type.item, v.text)
        return v

    @staticmethod
    def step(column: Column, step: Any) -> Column:
        return F.get(column, F.lit(step.index)) if isinstance(step, At) else F.try_element_at(column, F.lit(step.key))

    def base(self, node: FieldRef | Call) -> Value:
        if isinstance(node, FieldRef):
            return self.fields[node.name]
        f, rest = node.function, [self.value(a) for a in (node.args[1:] if node.mapped else node.args)]
        if not node.mapped:
            return Value(f.column(rest, node.returns, node.context), node.returns, self.result_text(rest))
        items = self.container(node.args[0])
        text = self.result_text([items, *rest])
        if f.python:
            return Value(f.mapped(items.column, *rest), node.type, text)
        item = items.type.item
        out = F.transform(items.column, lambda x: f.column([Value(x, item, items.text), *rest], node.returns, node.context))
        return Value(F.filter(out, lambda x: x.isNotNull()), node.type, text)

    @staticmethod
    def result_text(values: list[Value]) -> bool:
        return all(v.text for v in values if v.type.leaf.name == "Bytes")

    def container(self, node: Access) -> Value:
        """An array of all elements that the steps reach, without NULLs; NULL if the way to the first ``[*]`` is missing."""
        v, kind, mapped = self.base(node.base), node.base.type, False
        column, dense = v.column, v.dense
        for s in node.steps:
            if isinstance(s, Each):
                inner = (lambda k: lambda c: self.items(c, k))(kind)
                if mapped:
                    column = F.flatten(F.transform(column, inner))
                else:
                    column, mapped = inner(column), True
            elif mapped:
                column = F.transform(column, (lambda st: lambda x: self.step(x, st))(s))
            else:
                column = self.step(column, s)
            if mapped and not (dense and s is node.steps[0]):
                column = F.filter(column, lambda x: x.isNotNull())
            kind = kind.item
        return Value(column, Type("Array", kind), v.text)

    def tested(self, node: Access, test: Callable, pred: Callable[[Value], Column]) -> Column:
        """``test`` (exists or forall) of all elements that the steps reach, without building their array; missing ones do not
        count, and a missing container has none."""
        every, v = test is F.forall, self.base(node.base)

        def inside(column: Column, kind: Type, steps: tuple, dense: bool) -> Column:
            for n, s in enumerate(steps):
                if isinstance(s, Each):
                    item, rest = kind.item, steps[n + 1 :]
                    found = test(self.items(column, kind), lambda x: inside(x, item, rest, dense))
                    return F.coalesce(found, F.lit(every))
                column, kind, dense = self.step(column, s), kind.item, False
            found = pred(Value(column, kind, v.text))
            return found if dense else column.isNull() | found if every else column.isNotNull() & found

        return inside(v.column, node.base.type, node.steps, v.dense and len(node.steps) == 1)

    @staticmethod
    def items(column: Column, kind: Type) -> Column:
        if kind.name == "Array":
            return column
        return F.transform(F.array_sort(F.map_keys(column)), lambda k: F.try_element_at(column, k))

    # ---- predicates

    def leaf(self, node: Compare, v: Value) -> Column:
        """A comparison of a value that is not NULL."""
        op, right, c = node.op, node.right, v.column
        kind = v.type.name
        if op == "IsTrue":
            return c
        if op in COMPARE:
            if kind == "Bytes":
                return self._bytes(v, right.data, COMPARE[op])
            lit = literal_value(right)
            if kind == "Ip" and op not in ("Equal", "NotEqual"):
                return (F.octet_length(c) == len(lit)) & COMPARE[op](c, F.lit(lit))
            return COMPARE[op](c, F.lit(lit))
        if op == "BitwiseAnd":
            return c.bitwiseAND(F.lit(right.value)) != 0
        if op == "Contains":
            return self._bytes(v, right.data, F.contains) if right.data else F.lit(True)
        if op == "ContainsOneOf":
            return any_of([self._bytes(v, x.data, F.contains) if x.data else F.lit(True) for x in right])
        if op == "Matches":
            return F.decode(c.cast("binary"), "ISO-8859-1").rlike(regexes.java(right.text))
        if op in ("Wildcard", "Strict Wildcard"):
            return self._glob(v, right.pieces(), op == "Wildcard")
        if op == "OneOf":
            return self._one_of(v, right)
        if node in self.members:
            return F.coalesce(F.array_contains(self.members[node], c), F.lit(False))
        return self.scheme.lists[v.type].column(right, c, v.type, v.text)

    @staticmethod
    def _bytes(v: Value, data: bytes, op: Callable[[Column, Column], Column]) -> Column:
        s = _utf8(data) if v.text else None
        return op(v.column, F.lit(s)) if s is not None else op(v.column.cast("binary"), F.lit(data))

    @staticmethod
    def _glob(v: Value, pieces: list[bytes], fold: bool) -> Column:
        text = v.text and all(_utf8(p) is not None for p in pieces)
        column = v.column if text else F.decode(v.column.cast("binary"), "ISO-8859-1")
        if fold:
            column = F.translate(column, UPPER, LOWER)
            pieces = [p.lower() for p in pieces]
        return column.like(regexes.like(pieces, text))

    def _one_of(self, v: Value, right: tuple) -> Column:
        c = v.column
        if v.type.name == "Bytes":
            texts = [s for x in right if (s := _utf8(x.data)) is not None] if v.text else []
            raw = [x.data for x in right if not v.text or _utf8(x.data) is None]
            return any_of([*([c.isin(texts)] if texts else []), *([c.cast("binary").isin(raw)] if raw else [])])
        out = []
        for size in (0,) if v.type.name == "Int" else (4, 16):
            spans = merged([(x.first, x.last) for x in right if not size or len(x.first) == size])
            points = [a for a, b in spans if a == b]
            # Only blocks of addresses need their family checked: equal addresses have equal lengths.
            ranges = any_of([c.between(F.lit(a), F.lit(b)) for a, b in spans if a != b]) if any(a != b for a, b in spans) else None
            if points:
                out.append(c.isin(points))
            if ranges is not None:
                out.append((F.octet_length(c) == size) & ranges if size else ranges)
        return any_of(out)

    def truth(self, node: Any) -> Column:
        if isinstance(node, Group):
            return self.truth(node.inner)
        if isinstance(node, Not):
            return ~self.truth(node.arg)
        if isinstance(node, Logic):
            return reduce(FOLDS[node.op], map(self.truth, node.items))
        if isinstance(node, Quantifier):
            return self.quantified(node)
        if node in self.flags:
            return self.flags[node]
        if node.op == "OneOf" and not node.right:
            return F.lit(False)
        v = self.value(node.left)
        if node.op == "NotEqual" and self.scheme.nil_not_equal:
            return v.column.isNull() | self.leaf(node, v)
        return v.column.isNotNull() & self.leaf(node, v)

    def element(self, node: Access) -> tuple[Access, Callable[[Value], Value]] | None:
        """The container that a mapped value maps over, and the value of one of its elements; None if the value may have
        fewer elements than the container (functions that can miss drop theirs)."""
        if isinstance(node.base, FieldRef):
            return (node, lambda x: x) if node.each else None
        call = node.base
        if not (call.mapped and call.function.total and not call.function.python and node.steps == (Each(),) and all(map(is_literal, call.args[1:]))):
            return None
        inner = self.element(call.args[0])
        if inner is None:
            return None
        rest = [self.value(a) for a in call.args[1:]]

        def value(x: Value) -> Value:
            v = inner[1](x)
            return Value(call.function.column([v, *rest], call.returns, call.context), call.returns, self.result_text([v, *rest]))

        return inner[0], value

    def elementwise(self, node: Any) -> tuple[Access, Callable[[Value], Column]] | None:
        """A predicate on each element of one container, if that is what the node is: then no arrays need be zipped."""
        if isinstance(node, Group):
            return self.elementwise(node.inner)
        if isinstance(node, Not):
            inner = self.elementwise(node.arg)
            return inner and (inner[0], lambda x: ~inner[1](x))
        if isinstance(node, Logic):
            parts = [self.elementwise(x) for x in node.items]
            if any(p is None or p[0] != parts[0][0] for p in parts):
                return None
            return parts[0][0], lambda x: reduce(FOLDS[node.op], [p[1](x) for p in parts])
        if not isinstance(node, Compare) or not node.left.each:
            return None
        found = self.element(node.left)
        return found and (found[0], lambda x: self.leaf(node, found[1](x)))

    def quantified(self, node: Quantifier) -> Column:
        test = F.exists if node.op == "Any" else F.forall
        arg = node.arg
        while isinstance(arg, Group):
            arg = arg.inner
        if isinstance(node.arg, Access):
            array = self.value(node.arg).column
            return F.coalesce(test(F.filter(array, lambda x: x.isNotNull()), lambda x: x), F.lit(False))
        each = self.elementwise(arg)
        if each:
            return self.tested(each[0], test, each[1])
        return test(self.vec(arg), lambda x: x)

    def vec(self, node: Any) -> Column:
        each = self.elementwise(node)
        if each:
            items = self.container(each[0])
            array = F.transform(items.column, lambda x: each[1](Value(x, items.type.item, items.text)))
            return F.coalesce(array, F.array().cast("array<boolean>"))
        if isinstance(node, Group):
            return self.vec(node.inner)
        if isinstance(node, Not):
            return F.transform(self.vec(node.arg), lambda x: ~x)
        if isinstance(node, Logic):
            fold = FOLDS[node.op]

            def zipped(a: Column, b: Column) -> Column:
                n = F.least(F.size(a), F.size(b))
                return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), fold)

            return reduce(zipped, map(self.vec, node.items))
        if node.left.each:
            items = self.container(node.left)
            array = F.transform(items.column, lambda x: self.leaf(node, Value(x, items.type.item, items.text)))
        else:
            array = F.filter(self.value(node.left).column, lambda x: x.isNotNull())
        return F.coalesce(array, F.array().cast("array<boolean>"))
