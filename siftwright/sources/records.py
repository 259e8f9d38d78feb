"""Records as JSON: one at a time, and as columns of frames.

A record is an object of a scheme's fields. Byte strings are JSON strings, or arrays of numbers where they are not UTF-8; maps
with keys that are not UTF-8 are arrays of [key, value] pairs; addresses are strings. An unknown key is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TypeMismatch, UnknownField
from ..plans.nodes import FieldRef
from ..scheme import Scheme
from ..types import Type
from .addresses import ip_from_text
from .values import check_value, from_json, to_json


class Record:
    """The values of one record of a scheme, and any ``user_data`` beside them; :func:`records_frame` makes a frame of many."""

    def __init__(self, scheme: Scheme, user_data: Any = None) -> None:
        self.scheme, self.user_data, self._values = scheme, user_data, {}

    def set(self, name: str | FieldRef, value: Any) -> Any:
        """Sets a field and returns what it held before."""
        ref = self.scheme.field(name if isinstance(name, str) else name.name)
        before = self._values.get(ref.name)
        self._values[ref.name] = check_value(value, ref.type)
        return before

    def get(self, name: str) -> Any:
        return self._values.get(self.scheme.field(name).name)

    def clear(self) -> None:
        self._values.clear()
        for definition in self.scheme.lists.values():
            definition.clear()

    def clone(self, user_data: Any = None) -> Record:
        out = Record(self.scheme, user_data)
        out._values = dict(self._values)
        return out

    def take(self, user_data: Any = None) -> Record:
        """A record with these values; this one is empty afterwards."""
        out = self.clone(user_data)
        self._values = {}
        return out

    def to_json(self) -> dict[str, Any]:
        out = {f.name: to_json(self._values[f.name], f.type) for f in self.scheme.fields if f.name in self._values}
        if self.scheme.lists:
            out["$lists"] = [{"type": kind.to_json(), "data": definition.to_json(kind)} for kind, definition in self.scheme.lists.items()]
        return out

    def load_json(self, form: str | dict[str, Any]) -> Record:
        for name, value in (json.loads(form) if isinstance(form, str) else form).items():
            if name == "$lists":
                for entry in value:
                    kind = Type.from_json(entry["type"])
                    definition = self.scheme.lists.get(kind)
                    if definition is None:
                        raise TypeMismatch(f"no list for type {entry['type']}")
                    if entry["data"] is not None:
                        definition.load_json(entry["data"], kind)
                continue
            ref = self.scheme.find(name)
            if not isinstance(ref, FieldRef):
                raise UnknownField(name)
            self._values[name] = from_json(value, ref.type)
        return self


# ---- frames


def records_frame(spark: SparkSession, scheme: Scheme, records: Iterable[Record]) -> DataFrame:
    """Records as the rows of a frame with a column for each field, in order; byte strings are binary."""
    rows = [tuple(_keyed(r.get(f.name), f.type) for f in scheme.fields) for r in records]
    schema = scheme.to_struct_type(text=False)
    for f in schema:
        f.nullable = True
    return spark.createDataFrame(rows, schema)


def _keyed(value: Any, kind: Type) -> Any:
    """A value with its map keys as texts, as frames have them."""
    if value is None or kind.item is None:
        return value
    if kind.name == "Map":
        return {k.decode(): _keyed(v, kind.item) for k, v in value.items()}
    return [_keyed(v, kind.item) for v in value]


# What the shapes of scalar items are called.
_FLAT = {"Bool": "BOOLEAN", "Int": "BIGINT", "Bytes": "STRING"}


def _wrong(v: Column, kind: Type) -> Column:
    return F.raise_error(F.concat(F.lit(f"expected value of type {kind}, but got "), F.to_json(v)))


def _bytes_of(numbers: Column) -> Column:
    """Byte strings from arrays of numbers."""
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def _decoded(v: Column, kind: Type, shape: Column | None = None) -> Column:
    """The value of a variant (of a ``shape``) that is not NULL, or an error if it is of another type."""
    get = lambda t: F.variant_get(v, "$", t)
    shape = F.schema_of_variant(v) if shape is None else shape
    if kind.name == "Bool":
        return F.when(shape == "BOOLEAN", get("boolean")).otherwise(_wrong(v, kind).cast("boolean"))
    if kind.name == "Int":
        return F.when(shape == "BIGINT", get("bigint")).otherwise(_wrong(v, kind).cast("bigint"))
    if kind.name == "Ip":
        return F.coalesce(F.when(shape == "STRING", ip_from_text(get("string"))), _wrong(v, kind).cast("binary"))
    if kind.name == "Bytes":
        numbers = F.when(shape.isin("ARRAY<BIGINT>", "ARRAY<VOID>"), F.try_variant_get(v, "$", "array<bigint>"))
        fine = F.forall(numbers, lambda x: x.isNotNull() & x.between(0, 255))
        return F.when(shape == "STRING", get("string")).when(fine, _bytes_of(numbers).cast("string")).otherwise(_wrong(v, kind))
    if kind.name == "Array":
        items = F.transform(get("array<variant>"), lambda x: _decoded(x, kind.item))
        # Where all items are of the wanted type, one cast decodes them.
        plain = shape == f"ARRAY<{_FLAT.get(kind.item.name, '')}>"
        return F.when(plain, get(kind.spark().simpleString())).when(shape.startswith("ARRAY<"), items).otherwise(_wrong(v, kind).cast(kind.spark()))
    entries = F.transform_values(get("map<string,variant>"), lambda _, x: _decoded(x, kind.item))
    pair = lambda p: F.struct(_decoded(F.get(p, F.lit(0)), Type("Bytes")).alias("key"), _decoded(F.get(p, F.lit(1)), kind.item).alias("value"))
    pairs = F.try_variant_get(v, "$", "array<array<variant>>")
    even = F.forall(pairs, lambda p: p.isNotNull() & (F.size(p) == 2))
    return F.when(shape.startswith("OBJECT<"), entries).when(even, F.map_from_entries(F.transform(pairs, pair))).otherwise(_wrong(v, kind).cast(kind.spark()))


def read_records(df: DataFrame, scheme: Scheme, column: str = "value") -> DataFrame:
    """A column of JSON records as a frame of the scheme's fields, absent fields NULL.

    As with single records, an unknown key and a value of another type (null included) are errors. A map may be an object or an
    array of [key, value] pairs with distinct keys, a byte string a text or an array of numbers, at any depth.
    """
    known = [f.name for f in scheme.fields]
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    unknown = F.array_except(keys, F.array(*[F.lit(k) for k in [*known, "$lists"]]))
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown field: "), unknown[0]))).otherwise(F.parse_json(F.col(column)))
    # Made by a generator, a record is parsed once and its values found once, wherever filters on the fields end up.
    found = lambda r, f: F.variant_get(r, f'$["{f.name}"]', "variant")
    parts = lambda r: F.struct(*[c.alias(f"{x}{i}") for i, f in enumerate(scheme.fields) for x, c in (("v", found(r, f)), ("s", F.schema_of_variant(found(r, f))))])
    parsed = df.select(F.inline(F.transform(F.array(checked), parts)))
    return parsed.select(*[F.when(F.col(f"v{i}").isNotNull(), _decoded(F.col(f"v{i}"), f.type, F.col(f"s{i}"))).alias(f.name) for i, f in enumerate(scheme.fields)])


def _ip_text(c: Column) -> Column:
    """Canonical text: dotted bytes, or groups without leading zeros, the longest (first) run of zero groups cut."""
    octet = lambda i: F.conv(F.substring(F.hex(c), i * 2 + 1, F.lit(2)), 16, 10)
    dotted = lambda a, b: F.array_join(F.transform(F.sequence(F.lit(a), F.lit(b)), octet), ".")
    group = lambda i: F.regexp_replace(F.lower(F.substring(F.hex(c), i * 4 + 1, F.lit(4))), "^0{1,3}", "")
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), ":")
    marked = F.concat(F.lit(":"), groups, F.lit(":"))
    short = F.when(F.lit(False), groups)
    for n in range(8, 1, -1):
        run = ":" + "0:" * n
        at = F.instr(marked, run)
        short = short.when(at > 0, F.concat(F.substring(marked, F.lit(2), F.greatest(at - 2, F.lit(0))), F.lit("::"), F.substring(groups, at + len(run) - 1, F.length(groups))))
    mapped = F.hex(c).startswith("0" * 20 + "FFFF")
    return F.when(F.octet_length(c) == 4, dotted(0, 3)).when(mapped, F.concat(F.lit("::ffff:"), dotted(12, 15))).otherwise(short.otherwise(groups))


def _quoted(c: Column) -> Column:
    """JSON of one byte string."""
    raw = c.cast("binary")
    inner = F.to_json(F.array(c.cast("string")))
    text = F.substring(inner, F.lit(2), F.length(inner) - 2)
    pairs = F.regexp_extract_all(F.hex(raw), F.lit("(..)"), 1)
    numbers = F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda x: F.conv(x, 16, 10)), ","), F.lit("]"))
    return F.when(F.is_valid_utf8(c.cast("string")), text).otherwise(numbers)


def _encoded(c: Column, kind: Type) -> Column:
    if kind.name in ("Bool", "Int"):
        return c.cast("string")
    if kind.name == "Ip":
        return F.concat(F.lit('"'), _ip_text(c), F.lit('"'))
    if kind.name == "Bytes":
        return _quoted(c)
    listed = lambda a, b, parts: F.concat(F.lit(a), F.array_join(parts, ","), F.lit(b))
    if kind.name == "Array":
        return listed("[", "]", F.transform(c, lambda x: _encoded(x, kind.item)))
    keys = F.array_sort(F.map_keys(c))
    entry = lambda a, mid, b: lambda k: F.concat(F.lit(a), _quoted(k), F.lit(mid), _encoded(F.try_element_at(c, k), kind.item), F.lit(b))
    texts = F.forall(keys, lambda k: F.is_valid_utf8(k.cast("string")))
    return F.when(texts, listed("{", "}", F.transform(keys, entry("", ":", "")))).otherwise(listed("[", "]", F.transform(keys, entry("[", ",", "]"))))


def write_records(frame: Any) -> DataFrame:
    """A bound frame's fields as a column ``record`` of JSON: only set fields, in the scheme's order, map keys sorted.

    Maps with a key that is not UTF-8 are arrays of [key, value] pairs.
    """
    parts = []
    for f in frame.scheme.fields:
        c = frame.values[f.name].column
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(json.dumps(f.name) + ":"), _encoded(c, f.type))))
    return frame.df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("record"))
