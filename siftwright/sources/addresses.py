"""Addresses in text to packed bytes, in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a decimal byte.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"


def _v4_hex(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\."), lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")), "")


def ip_from_text(text: Column) -> Column:
    """4 bytes for IPv4, 16 for IPv6; NULL for what is neither."""
    is_v4 = text.rlike(rf"\A{IPV4}\z")
    tail = F.regexp_extract(text, rf"({IPV4})\z", 1)
    # An IPv4 tail of an IPv6 address becomes two groups.
    groups_of_tail = F.concat_ws(":", F.substring(_v4_hex(tail), 1, 4), F.substring(_v4_hex(tail), 5, 4))
    v6 = F.when(tail != "", F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), groups_of_tail)).otherwise(text)
    halves = F.split(v6, "::", -1)
    groups = lambda half: F.filter(F.split(half, ":", -1), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    count = F.size(left) + F.size(right)
    padded = F.when(F.size(halves) == 2, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - count)), right)).otherwise(left)
    fits = v6.rlike(r"\A(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*)?(?:::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*)?)?\z")
    whole = F.when(F.size(halves) == 2, count < 8).otherwise((F.size(halves) == 1) & (count == 8))
    bits = F.unhex(F.array_join(F.transform(padded, lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(is_v4, F.unhex(_v4_hex(text))).when(fits & whole, bits)
