"""Single values of the filter language and their JSON forms.

Byte strings are JSON strings, or arrays of numbers where they are not UTF-8; maps with keys that are not UTF-8 are arrays
of [key, value] pairs; addresses are strings.
"""

from __future__ import annotations

import ipaddress
from typing import Any

from ..errors import TypeMismatch
from ..types import Type


def bytes_to_json(data: bytes) -> Any:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return list(data)


def bytes_from_json(form: Any) -> bytes:
    if isinstance(form, str):
        return form.encode()
    if isinstance(form, list) and all(isinstance(x, int) and 0 <= x < 256 for x in form):
        return bytes(form)
    raise TypeMismatch(f"expected bytes, but got {form!r}")


def to_json(value: Any, kind: Type) -> Any:
    if kind.name == "Bytes":
        return bytes_to_json(value)
    if kind.name == "Ip":
        return str(ipaddress.ip_address(value))
    if kind.name == "Array":
        return [to_json(x, kind.item) for x in value]
    if kind.name == "Map":
        pairs = [(bytes_to_json(k), to_json(v, kind.item)) for k, v in sorted(value.items())]
        return dict(pairs) if all(isinstance(k, str) for k, _ in pairs) else [list(p) for p in pairs]
    return value


def from_json(form: Any, kind: Type) -> Any:
    """A typed value: bool, int, bytes, packed address, list, or dict with bytes keys."""
    if kind.name == "Bool" and isinstance(form, bool):
        return form
    if kind.name == "Int" and isinstance(form, int) and not isinstance(form, bool) and -(1 << 63) <= form < 1 << 63:
        return form
    if kind.name == "Bytes":
        return bytes_from_json(form)
    if kind.name == "Ip" and isinstance(form, str):
        try:
            return ipaddress.ip_address(form).packed
        except ValueError:
            pass
    if kind.name == "Array" and isinstance(form, list):
        return [from_json(x, kind.item) for x in form]
    if kind.name == "Map" and isinstance(form, dict):
        return {k.encode(): from_json(v, kind.item) for k, v in form.items()}
    if kind.name == "Map" and isinstance(form, list) and all(isinstance(p, list) and len(p) == 2 for p in form):
        return {bytes_from_json(k): from_json(v, kind.item) for k, v in form}
    raise TypeMismatch(f"expected value of type {kind}, but got {form!r}")


def guess(form: Any) -> tuple[Any, Type]:
    """The value and type of an untyped JSON scalar: Bool, Int, Ip, Bytes are tried in this order."""
    for name in ("Bool", "Int", "Ip", "Bytes"):
        try:
            return from_json(form, Type(name)), Type(name)
        except TypeMismatch:
            continue
    raise TypeMismatch(f"no scalar type for {form!r}")


def check_value(value: Any, kind: Type) -> Any:
    """``value`` in its kept form; str, bytearray and ipaddress objects are taken too."""
    if kind.name == "Bool" and isinstance(value, bool):
        return value
    if kind.name == "Int" and isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63:
        return value
    if kind.name == "Bytes" and isinstance(value, (bytes, bytearray, str)):
        return value.encode() if isinstance(value, str) else bytes(value)
    if kind.name == "Ip" and isinstance(value, (str, bytes, ipaddress.IPv4Address, ipaddress.IPv6Address)):
        if isinstance(value, bytes) and len(value) not in (4, 16):
            raise TypeMismatch("packed addresses have 4 or 16 bytes")
        return value if isinstance(value, bytes) else ipaddress.ip_address(value).packed
    if kind.name == "Array" and isinstance(value, (list, tuple)):
        return [check_value(x, kind.item) for x in value]
    if kind.name == "Map" and isinstance(value, dict):
        return {k.encode() if isinstance(k, str) else bytes(k): check_value(v, kind.item) for k, v in value.items()}
    raise TypeMismatch(f"expected value of type {kind}, but got {value!r}")
