"""Named lists: sets outside a filter that ``field in $name`` asks."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TypeMismatch
from ..sources.addresses import ip_from_text
from ..sources.values import from_json, to_json
from ..types import BYTES, INT, IP, Type, from_spark


class ListDefinition:
    """What a scheme holds for a type; names are looked up when a filter runs, unknown names match nothing."""

    def match(self, name: str, value: Any) -> bool:
        raise NotImplementedError

    def column(self, name: str, value: Column, kind: Type, text: bool) -> Column:
        """Whether a non-null value is in the list."""
        raise NotImplementedError

    def to_json(self, kind: Type) -> Any:
        return None

    def load_json(self, form: Any, kind: Type) -> None:
        """Takes back what ``to_json`` gave."""

    def clear(self) -> None:
        """Forgets all values."""


class NeverList(ListDefinition):
    def match(self, name: str, value: Any) -> bool:
        return False

    def column(self, name: str, value: Column, kind: Type, text: bool) -> Column:
        return F.lit(False)


class AlwaysList(NeverList):
    """Matches nothing, as observed where it comes from; ``matches=True`` gives what its name says."""

    def __init__(self, matches: bool = False) -> None:
        self.matches = matches

    def match(self, name: str, value: Any) -> bool:
        return self.matches

    def column(self, name: str, value: Column, kind: Type, text: bool) -> Column:
        return F.lit(self.matches)


def _typed(value: Any, kind: Type) -> Any:
    """A list's value as fields hold it: packed addresses, byte strings as bytes."""
    if kind == IP and not isinstance(value, (bytes, bytearray)):
        return ipaddress.ip_address(value).packed
    return value.encode() if isinstance(value, str) else bytes(value) if isinstance(value, bytearray) else value


class SetList(ListDefinition):
    """Values by list name, written into the plan. Addresses may be packed or texts, byte strings bytes or texts."""

    def __init__(self, values: Mapping[str, Iterable[Any]]) -> None:
        self.values = {k: list(v) for k, v in values.items()}

    def match(self, name: str, value: Any) -> bool:
        kind = INT if isinstance(value, int) else BYTES
        found = self.values.get(name, ())
        return value in [_typed(x, kind) for x in found] or (kind == BYTES and value in [_typed(x, IP) for x in found if isinstance(x, (ipaddress.IPv4Address, ipaddress.IPv6Address))])

    def column(self, name: str, value: Column, kind: Type, text: bool) -> Column:
        found = [_typed(x, kind) for x in self.values.get(name, [])]
        if kind != BYTES or not text:
            return value.isin(found) if found else F.lit(False)
        texts, raw = [], []
        for x in found:
            try:
                texts.append(x.decode())
            except UnicodeDecodeError:
                raw.append(x)
        parts = [*([value.isin(texts)] if texts else []), *([value.cast("binary").isin(raw)] if raw else [])]
        return parts[0] | parts[1] if len(parts) == 2 else parts[0] if parts else F.lit(False)

    def to_json(self, kind: Type) -> Any:
        return {k: [to_json(_typed(x, kind), kind) for x in v] for k, v in sorted(self.values.items())}

    def load_json(self, form: Any, kind: Type) -> None:
        self.values = {k: [from_json(x, kind) for x in v] for k, v in form.items()}

    def clear(self) -> None:
        self.values = {}


class RuleList(ListDefinition):
    """A predicate by list name: ``evaluate(name, value)`` and ``build(name, column)``."""

    def __init__(self, evaluate: Any, build: Any) -> None:
        self.evaluate, self.build = evaluate, build

    def match(self, name: str, value: Any) -> bool:
        return bool(self.evaluate(name, value))

    def column(self, name: str, value: Column, kind: Type, text: bool) -> Column:
        return F.coalesce(self.build(name, value), F.lit(False))


class TableList(ListDefinition):
    """Values in the rows of a frame (columns name, value) of any size; bound frames join it, never collect it.

    As a whole conjunct the membership is a semi-join. Under ``or``, ``not`` and ``xor`` it is a flag from an outer join
    with the distinct values. Under ``[*]`` the distinct arrays of a field's elements are joined to the list, and
    each row gets those of its elements that are in it. Spark chooses each join by the list's size. Lists of addresses may hold
    packed bytes or texts; a text that is no address is an error where it is read.
    """

    def __init__(self, frame: DataFrame, name: str = "name", value: str = "value") -> None:
        self.frame = frame.select(F.col(name).alias("name"), F.col(value).alias("value")).where("value is not null")

    def rows(self, name: str, kind: Type, text: bool = True) -> DataFrame:
        """The list's distinct values, as fields of the type hold them (``text``: byte strings as strings)."""
        stored, value = self.frame.schema["value"].dataType, F.col("value")
        is_text = stored.simpleString().startswith("string")
        if kind == IP and is_text:
            value = F.coalesce(ip_from_text(value), F.raise_error(F.concat(F.lit("not an address: "), value)))
        elif from_spark(stored) != (BYTES if kind == IP else kind):
            raise TypeMismatch(f"the list is of {kind}, but its column is {from_spark(stored)}")
        elif kind == BYTES and is_text != text:
            value = value.cast("string" if text else "binary")
        return self.frame.where(F.col("name") == name).select(value.alias("value")).distinct()

    def match(self, name: str, value: Any) -> bool:
        """One value's membership, by a filtered query that stops at the first match."""
        if isinstance(value, (bytes, bytearray)):
            held = F.col("value").cast("binary")
            text = self.frame.schema["value"].dataType.simpleString().startswith("string")
            asked = held == F.lit(bytes(value))
            if text and len(value) in (4, 16):
                asked = asked | (ip_from_text(F.col("value")) == F.lit(bytes(value)))
        else:
            asked = F.col("value") == F.lit(value)
        return bool(self.frame.where((F.col("name") == name) & asked).limit(1).count())

    def column(self, name: str, value: Column, kind: Type, text: bool) -> Column:
        raise ValueError(f"list ${name} is a table, which has to be joined: use filter, annotate, select or route of a bound frame")
