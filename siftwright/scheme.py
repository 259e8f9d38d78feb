"""Schemes: which fields, functions and lists a filter can name."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import types as T

from .errors import SchemeError, UnknownField
from .functions.base import Function
from .operators.lists import ListDefinition
from .plans.nodes import Access, FieldRef
from .plans.parser import Parser, Settings
from .types import Type, from_spark

NAME = re.compile(r"[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*")


class Scheme:
    """Fixed once it is built; filters and records belong to the scheme object that made them."""

    def __init__(self, names: dict[str, FieldRef | Function], lists: dict[Type, ListDefinition], nil_not_equal: bool) -> None:
        self._names, self.lists, self.nil_not_equal = dict(names), dict(lists), nil_not_equal

    @property
    def fields(self) -> list[FieldRef]:
        return [x for x in self._names.values() if isinstance(x, FieldRef)]

    def find(self, name: str) -> FieldRef | Function | None:
        return self._names.get(name)

    def field(self, name: str) -> FieldRef:
        found = self._names.get(name)
        if not isinstance(found, FieldRef):
            raise UnknownField(name)
        return found

    def parse(self, text: str, settings: Settings | None = None) -> Any:
        """The tree of a filter, whose root is a Bool."""
        return Parser(self, text, settings or Settings()).filter()

    def parse_value(self, text: str, settings: Settings | None = None) -> Access:
        """The tree of a value expression."""
        return Parser(self, text, settings or Settings()).value()

    def to_json(self) -> dict[str, Any]:
        return {f.name: {"type": f.type.to_json(), "optional": f.optional} for f in self.fields}

    @staticmethod
    def from_json(form: str | Mapping[str, Any]) -> Scheme:
        builder = SchemeBuilder()
        for name, x in (json.loads(form) if isinstance(form, str) else form).items():
            builder.add_field(name, Type.from_json(x["type"]), bool(x["optional"]))
        return builder.build()

    def to_struct_type(self, text: bool = True) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type.spark(text), f.optional) for f in self.fields])

    @staticmethod
    def from_struct_type(schema: T.StructType, types: Mapping[str, Type] | None = None) -> Scheme:
        """Fields of a frame's columns; ``types`` overrides what the column types say (an Ip, say)."""
        builder = SchemeBuilder()
        for f in schema:
            builder.add_field(f.name, (types or {}).get(f.name) or from_spark(f.dataType), f.nullable)
        return builder.build()


class SchemeBuilder:
    def __init__(self, fields: Mapping[str, Type] | None = None) -> None:
        self._names: dict[str, FieldRef | Function] = {}
        self._lists: dict[Type, ListDefinition] = {}
        self._nil_not_equal = True
        for name, kind in (fields or {}).items():
            self.add_field(name, kind)

    def _add(self, name: str, what: FieldRef | Function) -> SchemeBuilder:
        if not NAME.fullmatch(name):
            raise SchemeError(f"not a name: {name!r}")
        if name in self._names:
            kind = "field" if isinstance(self._names[name], FieldRef) else "function"
            raise SchemeError(f"attempt to redefine {kind} {name}")
        self._names[name] = what
        return self

    def add_field(self, name: str, kind: Type, optional: bool = False) -> SchemeBuilder:
        return self._add(name, FieldRef(name, kind, optional))

    def add_optional_field(self, name: str, kind: Type) -> SchemeBuilder:
        return self.add_field(name, kind, True)

    def add_function(self, name: str, function: Function) -> SchemeBuilder:
        return self._add(name, function)

    def add_functions(self, functions: Mapping[str, Function]) -> SchemeBuilder:
        for name, f in functions.items():
            self.add_function(name, f)
        return self

    def add_list(self, kind: Type, definition: ListDefinition) -> SchemeBuilder:
        if kind in self._lists:
            raise SchemeError(f"attempt to redefine list for type {kind}")
        self._lists[kind] = definition
        return self

    def set_nil_not_equal_behavior(self, matches: bool) -> SchemeBuilder:
        """Whether a missing value is unequal to a literal (it is, unless told otherwise)."""
        self._nil_not_equal = matches
        return self

    def build(self) -> Scheme:
        return Scheme(self._names, self._lists, self._nil_not_equal)
