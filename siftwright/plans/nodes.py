"""The typed expression tree, its JSON form, its stable hash and visitors."""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace
from typing import Any

from ..types import BOOL, BYTES, INT, IP, Array, Type

# ---- literals


@dataclass(frozen=True)
class IntLit:
    value: int
    type = INT

    def to_json(self) -> Any:
        return self.value


@dataclass(frozen=True)
class IpLit:
    packed: bytes
    type = IP

    def to_json(self) -> Any:
        return str(ipaddress.ip_address(self.packed))


@dataclass(frozen=True)
class BytesLit:
    """``form`` is quoted, raw (with its number of #) or hex."""

    data: bytes
    form: str = "quoted"
    hashes: int = 0
    type = BYTES

    def to_json(self) -> Any:
        if self.form != "hex":
            try:
                return self.data.decode()
            except UnicodeDecodeError:
                pass
        return list(self.data)


@dataclass(frozen=True)
class IntSpan:
    first: int
    last: int

    def to_json(self) -> Any:
        return {"start": self.first, "end": self.last}


@dataclass(frozen=True)
class IpSpan:
    """Addresses from first to last, written as a host or block (``block``) or as an explicit range."""

    first: bytes
    last: bytes
    block: str | None = None

    def to_json(self) -> Any:
        return self.block or {"start": IpLit(self.first).to_json(), "end": IpLit(self.last).to_json()}


@dataclass(frozen=True)
class Pattern:
    """A regular expression; equal patterns are equal whatever their quotes."""

    text: str
    form: str = field(default="quoted", compare=False)
    hashes: int = field(default=0, compare=False)

    def to_json(self) -> Any:
        return self.text


@dataclass(frozen=True)
class Glob:
    """A wildcard pattern: ``*`` stands for any run, ``\\*`` and ``\\\\`` for themselves."""

    data: bytes
    form: str = "quoted"
    hashes: int = 0

    def pieces(self) -> list[bytes]:
        """The literal runs between the stars."""
        out, i = [bytearray()], 0
        while i < len(self.data):
            c = self.data[i : i + 1]
            if c == b"\\":
                i += 1
                c = self.data[i : i + 1]
                out[-1] += c
            elif c == b"*":
                out.append(bytearray())
            else:
                out[-1] += c
            i += 1
        return [bytes(x) for x in out]

    def to_json(self) -> Any:
        return BytesLit(self.data, self.form).to_json()


# ---- values


@dataclass(frozen=True)
class FieldRef:
    name: str
    type: Type
    optional: bool = False

    def to_json(self) -> Any:
        return self.name


@dataclass(frozen=True)
class Each:
    """The step ``[*]``."""

    def to_json(self) -> Any:
        return {"kind": "MapEach"}


@dataclass(frozen=True)
class At:
    index: int

    def to_json(self) -> Any:
        return {"kind": "ArrayIndex", "value": self.index}


@dataclass(frozen=True)
class Key:
    key: str

    def to_json(self) -> Any:
        return {"kind": "MapKey", "value": self.key}


@dataclass(frozen=True)
class Call:
    """``context`` is the function's own box of what it learned while parsing; calls are equal without it."""

    function: Any
    name: str
    args: tuple
    returns: Type
    context: Any = field(default=None, compare=False, hash=False)

    @property
    def mapped(self) -> bool:
        return bool(self.args) and isinstance(self.args[0], Access) and self.args[0].each > 0

    @property
    def type(self) -> Type:
        return Array(self.returns) if self.mapped else self.returns

    def to_json(self) -> Any:
        return {"name": self.name, "args": [arg_json(a) for a in self.args]}


@dataclass(frozen=True)
class Access:
    """A field or call and the steps into it."""

    base: FieldRef | Call
    steps: tuple = ()

    @property
    def each(self) -> int:
        return sum(isinstance(s, Each) for s in self.steps)

    @property
    def type(self) -> Type:
        t = self.base.type
        for _ in self.steps:
            t = t.item
        return t

    def to_json(self) -> Any:
        base = self.base.to_json()
        return [base, *(s.to_json() for s in self.steps)] if self.steps else base


def arg_json(node: Any) -> Any:
    if isinstance(node, Access):
        kind = "IndexExpr"
    elif isinstance(node, (IntLit, IpLit, BytesLit)):
        kind = "Literal"
    else:
        kind = "SimpleExpr"
    return {"kind": kind, "value": node.to_json()}


# ---- predicates


@dataclass(frozen=True)
class Compare:
    """``op`` is the JSON name; ``right`` a literal, a tuple of literals, a pattern, a list's name or None."""

    left: Access
    op: str
    right: Any = None

    @property
    def type(self) -> Type:
        if self.left.each:
            return Array(BOOL)
        return self.left.type if self.op == "IsTrue" else BOOL

    def to_json(self) -> Any:
        out = {"lhs": self.left.to_json(), "op": self.op}
        if self.op != "IsTrue":
            r = self.right
            out["rhs"] = [x.to_json() for x in r] if isinstance(r, tuple) else r if isinstance(r, str) else r.to_json()
        return out


@dataclass(frozen=True)
class Logic:
    op: str  # Or, Xor, And
    items: tuple

    @property
    def type(self) -> Type:
        return self.items[0].type

    def to_json(self) -> Any:
        return {"op": self.op, "items": [x.to_json() for x in self.items]}


@dataclass(frozen=True)
class Not:
    arg: Any

    @property
    def type(self) -> Type:
        return self.arg.type

    def to_json(self) -> Any:
        return {"op": "Not", "arg": self.arg.to_json()}


@dataclass(frozen=True)
class Group:
    inner: Any

    @property
    def type(self) -> Type:
        return self.inner.type

    def to_json(self) -> Any:
        return self.inner.to_json()


@dataclass(frozen=True)
class Quantifier:
    """any or all, over a value (``Access``) or over a lifted predicate; a missing value makes the first kind false."""

    op: str  # Any, All
    arg: Any
    type = BOOL

    def to_json(self) -> Any:
        return {"op": self.op, "arg": arg_json(self.arg)}


# ---- the tree as a whole


INNER = (FieldRef, Call, Access, Compare, Logic, Not, Group, Quantifier)


def children(node: Any) -> Iterator[Any]:
    for f in fields(node):
        value = getattr(node, f.name)
        for x in value if isinstance(value, tuple) else (value,):
            if isinstance(x, INNER):
                yield x


class Visitor:
    """Calls ``visit_<class>`` for each node, if there is one, and goes on into the node unless that returns False."""

    def visit(self, node: Any) -> None:
        hook = getattr(self, f"visit_{type(node).__name__.lower()}", None)
        if hook is None or hook(node) is not False:
            for child in children(node):
                self.visit(child)


class Rewriter:
    """Builds a tree anew: ``visit_<class>`` may return another node for one whose children are rewritten already."""

    def visit(self, node: Any) -> Any:
        new = node
        for f in fields(node):
            value = getattr(node, f.name)
            if isinstance(value, INNER):
                new = replace(new, **{f.name: self.visit(value)})
            elif isinstance(value, tuple):
                new = replace(new, **{f.name: tuple(self.visit(x) if isinstance(x, INNER) else x for x in value)})
        hook = getattr(self, f"visit_{type(node).__name__.lower()}", None)
        return hook(new) if hook else new


def walk(node: Any) -> Iterator[Any]:
    yield node
    for child in children(node):
        yield from walk(child)


def uses(node: Any, name: str) -> bool:
    return any(isinstance(x, FieldRef) and x.name == name for x in walk(node))


def uses_list(node: Any, name: str) -> bool:
    """Whether the field stands left of an ``in $list``, inside calls too."""
    return any(isinstance(x, Compare) and x.op == "InList" and uses(x.left, name) for x in walk(node))


def compact_json(node: Any) -> str:
    return json.dumps(node.to_json(), separators=(",", ":"), ensure_ascii=False)


def stable_hash(node: Any) -> int:
    """FNV-1a, 64 bits, of the compact JSON: insensitive to spacing and to the spelling of operators."""
    h = 0xCBF29CE484222325
    for b in compact_json(node).encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h
