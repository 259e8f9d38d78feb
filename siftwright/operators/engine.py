"""Schemes bound to frames: filters, projections and annotations, batch or streaming."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SchemeMismatch, TypeMismatch
from ..plans.lower import Lowering, Value
from ..plans.nodes import Compare, Group, Logic, walk
from ..plans.parser import Settings
from ..scheme import Scheme
from ..sources.addresses import ip_from_text
from ..types import IP, from_spark
from .lists import TableList


class Filter:
    """A parsed filter or value expression with its scheme."""

    def __init__(self, scheme: Scheme, node: Any, text: str = "") -> None:
        self.scheme, self.node, self.text = scheme, node, text

    @staticmethod
    def parse(scheme: Scheme, text: str, settings: Settings | None = None) -> Filter:
        return Filter(scheme, scheme.parse(text, settings), text)


def _conjuncts(node: Any) -> list[Any]:
    while isinstance(node, Group):
        node = node.inner
    if isinstance(node, Logic) and node.op == "And" and node.type.name == "Bool":
        return [x for item in node.items for x in _conjuncts(item)]
    return [node]


def _has_text(schema: Any) -> bool:
    return "binary" not in schema.simpleString()


class BoundFrame:
    """A frame and, for each field of a scheme, the column that gives its values.

    A NULL in a field is a missing value. ``strict``: a NULL in a mandatory field raises an error where a filter reads it;
    otherwise mandatory fields are treated as optional ones.
    """

    def __init__(self, df: DataFrame, scheme: Scheme, columns: Mapping[str, Column | str] | None = None, strict: bool = False, lowering: type[Lowering] = Lowering) -> None:
        self.df, self.scheme, self.lowering = df, scheme, lowering
        given = columns or {}
        exprs = {f.name: F.col(f"`{f.name}`") if f.name not in given else F.expr(given[f.name]) if isinstance(given[f.name], str) else given[f.name] for f in scheme.fields}
        found = df.select([c.alias(n) for n, c in exprs.items()]).schema
        self.values: dict[str, Value] = {}
        for f in scheme.fields:
            kind, column = found[f.name].dataType, exprs[f.name]
            if f.type == IP and kind.simpleString() == "string":
                column = ip_from_text(column)
            elif f.type.leaf != IP or "binary" not in kind.simpleString():
                actual = from_spark(kind)
                if actual != f.type:
                    raise TypeMismatch(f"field {f.name} is {f.type}, but its column is {actual}")
                if kind != f.type.spark(_has_text(kind)):
                    column = column.cast(f.type.spark(_has_text(kind)))
            if strict and not f.optional:
                column = F.when(column.isNull(), F.raise_error(F.lit(f"mandatory field {f.name} has no value"))).otherwise(column)
            self.values[f.name] = Value(column, f.type, _has_text(kind) or f.type.leaf == IP, dense=not getattr(kind, "containsNull", True))

    def _node(self, what: str | Filter, settings: Settings | None = None) -> Any:
        if isinstance(what, str):
            return self.scheme.parse(what, settings)
        if what.scheme is not self.scheme:
            raise SchemeMismatch("the filter belongs to another scheme")
        return what.node

    def _joined(self, df: DataFrame, nodes: list[Any]) -> tuple[DataFrame, Lowering, list[str]]:
        """``df`` with a helper column for each membership in a table list that the nodes ask, their lowering, and its names."""
        flags: dict[Compare, Column] = {}
        members: dict[Compare, Column] = {}
        lower, names = self.lowering(self.scheme, self.values, flags, members), []
        asked = dict.fromkeys(x for node in nodes for x in walk(node) if self._is_table(x))
        for x in reversed(asked):  # those inside the calls of others first
            name, value, salt = (_fresh(df, f"__{part}_{len(names)}") for part in ("in", "value", "salt"))
            names.append(name)
            v = lower.container(x.left) if x.left.each else lower.value(x.left)
            rows = self.scheme.lists[x.left.type].rows(x.right, x.left.type, v.text)
            if x.left.each:
                items = F.array_distinct(v.column)
                held = df.select(items.alias(value)).where(F.size(value) > 0).distinct().select(value, F.explode(value).alias(salt))
                held = held.join(rows, F.col(salt) == F.col("value"), "left_semi").groupBy(value).agg(F.collect_set(salt).alias(name))
                df = df.join(held, items == F.col(value), "left").drop(value)
                members[x] = F.col(name)
            else:
                rows = rows.select(F.col("value").alias(value), F.lit(0).alias(salt), F.lit(True).alias(name))
                df = df.join(rows, (v.column == F.col(value)) & (_spread(df, v.column) == F.col(salt)), "left").drop(value, salt)
                flags[x] = F.col(name).isNotNull()
        return df, lower, names

    def _is_table(self, node: Any) -> bool:
        return isinstance(node, Compare) and node.op == "InList" and isinstance(self.scheme.lists[node.left.type], TableList)

    def column(self, what: str | Filter) -> Column:
        """The predicate as a column of the frame (without table lists, which need joins)."""
        return self.lowering(self.scheme, self.values).truth(self._node(what))

    def value(self, what: str | Filter) -> Column:
        """A value expression as a column, NULL where it is missing (without table lists, which need joins)."""
        return self.lowering(self.scheme, self.values).value(self._value_node(what)).column

    def _value_node(self, what: str | Filter) -> Any:
        return self.scheme.parse_value(what) if isinstance(what, str) else self._node(what)

    def filter(self, what: str | Filter, settings: Settings | None = None) -> DataFrame:
        """The rows that match."""
        parts = _conjuncts(self._node(what, settings))
        semi = [p for p in parts if self._is_table(p) and not p.left.each]
        rest = [p for p in parts if p not in semi]
        df, lower, names = self._joined(self.df, [*rest, *(p.left for p in semi)])
        for p in rest:
            df = df.where(lower.truth(p))
        for p in semi:
            v, value = lower.value(p.left), _fresh(df, "__value")
            rows = self.scheme.lists[p.left.type].rows(p.right, p.left.type, v.text).withColumnRenamed("value", value)
            df = df.join(rows, v.column == F.col(value), "left_semi")
        return df.drop(*names)

    def annotate(self, filters: Mapping[str, str | Filter]) -> DataFrame:
        """The frame with a boolean column for each filter; one pass over the rows for all of them."""
        nodes = {name: self._node(f) for name, f in filters.items()}
        df, lower, names = self._joined(self.df, list(nodes.values()))
        return df.withColumns({name: lower.truth(n) for name, n in nodes.items()}).drop(*names)

    def select(self, values: Mapping[str, str | Filter], *keep: str) -> DataFrame:
        """Value expressions as columns, after the columns to keep."""
        nodes = {name: self._value_node(v) for name, v in values.items()}
        df, lower, _ = self._joined(self.df, list(nodes.values()))
        return df.select(*keep, *[lower.value(n).column.alias(name) for name, n in nodes.items()])

    def route(self, filters: Mapping[str, str | Filter], column: str = "routes") -> DataFrame:
        """The frame with an array of the names of the filters that a row matches, in one pass."""
        nodes = {name: self._node(f) for name, f in filters.items()}
        df, lower, names = self._joined(self.df, list(nodes.values()))
        marks = [F.when(lower.truth(n), F.lit(name)) for name, n in nodes.items()]
        return df.withColumn(column, F.array_compact(F.array(*marks))).drop(*names)


def _fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    while name in map(str.lower, df.columns):
        name += "_"
    return name


def _spread(df: DataFrame, value: Column) -> Column:
    """0, and for rows where ``value`` is NULL some other number: these match nothing and must not meet in one partition."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.when(value.isNull(), F.pmod(F.xxhash64(*plain), F.lit(1024)).cast("int") + 1).otherwise(F.lit(0)) if plain else F.lit(0)


def bind(df: DataFrame, scheme: Scheme, columns: Mapping[str, Column | str] | None = None, strict: bool = False, lowering: type[Lowering] = Lowering) -> BoundFrame:
    return BoundFrame(df, scheme, columns, strict, lowering)
