"""The value types of the filter language and their Spark and JSON forms."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

#: Containers may be nested this deep.
MAX_LAYERS = 32


@dataclass(frozen=True)
class Type:
    """``name`` is Bool, Int, Ip, Bytes, Array or Map; containers have the type of their items."""

    name: str
    item: Type | None = None

    def __post_init__(self) -> None:
        if self.layers() > MAX_LAYERS:
            raise ValueError(f"types nest {MAX_LAYERS} layers at most")

    def layers(self) -> int:
        n, t = 0, self
        while t.item is not None:
            n, t = n + 1, t.item
        return n

    @property
    def leaf(self) -> Type:
        t = self
        while t.item is not None:
            t = t.item
        return t

    def __str__(self) -> str:
        return f"{self.name}<{self.item}>" if self.item else self.name

    def to_json(self) -> Any:
        return {self.name: self.item.to_json()} if self.item else self.name

    @staticmethod
    def from_json(form: Any) -> Type:
        if isinstance(form, str) and form in PRIMITIVES:
            return PRIMITIVES[form]
        if isinstance(form, dict) and len(form) == 1 and (name := next(iter(form))) in ("Array", "Map"):
            return Type(name, Type.from_json(form[name]))
        raise ValueError(f"not a type: {form!r}")

    def spark(self, text: bool = True) -> T.DataType:
        """The column type; ``text`` tells how byte strings are stored."""
        if self.name == "Array":
            return T.ArrayType(self.item.spark(text))
        if self.name == "Map":
            return T.MapType(T.StringType(), self.item.spark(text))
        return {"Bool": T.BooleanType(), "Int": T.LongType(), "Ip": T.BinaryType(), "Bytes": T.StringType() if text else T.BinaryType()}[self.name]


BOOL, INT, IP, BYTES = (Type(n) for n in ("Bool", "Int", "Ip", "Bytes"))
PRIMITIVES = {t.name: t for t in (BOOL, INT, IP, BYTES)}


def Array(item: Type) -> Type:  # noqa: N802
    return Type("Array", item)


def Map(item: Type) -> Type:  # noqa: N802
    return Type("Map", item)


def from_spark(kind: T.DataType) -> Type:
    """The type of a column; binary columns are byte strings (an Ip has to be declared)."""
    if isinstance(kind, T.BooleanType):
        return BOOL
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return BYTES
    if isinstance(kind, T.ArrayType):
        return Array(from_spark(kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, (T.StringType, T.BinaryType)):
        return Map(from_spark(kind.valueType))
    raise TypeError(f"no filter type for {kind.simpleString()}: cast it to bigint or string when binding")
