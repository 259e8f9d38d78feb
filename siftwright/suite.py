"""The query suite: filters and value expressions over the sample tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.builtin import standard
from .functions.udf import python_function
from .operators.engine import BoundFrame, Filter, bind
from .operators.lists import AlwaysList, NeverList, RuleList, SetList, TableList
from .plans.nodes import BytesLit
from .scheme import Scheme, SchemeBuilder
from .sources.records import read_records, write_records
from .types import BOOL, BYTES, INT, IP, Array, Map, Type

BASE_IP = 10 << 24


@dataclass
class Binding:
    """A table as a scheme: fields with their types (a trailing ? marks an optional one) and columns, and the rows' keys."""

    table: str
    keys: list[str]
    fields: dict[str, tuple[Type, str | Column]]
    sql: str = ""  # a DuckDB table expression with the same derived columns; the table itself if empty


def _packed(number: str) -> str:
    return f"unhex(lpad(hex({BASE_IP} + {number}), 8, '0'))"


def _cents(name: str) -> tuple[Type, str]:
    return INT, f"cast(round({name} * 100) as bigint)"


BINDINGS = {
    "line": Binding(
        "lineitem",
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        {
            "line.orderkey": (INT, "l_orderkey"), "line.partkey": (INT, "l_partkey"), "line.suppkey": (INT, "l_suppkey"), "line.number": (INT, "l_linenumber"),
            "line.qty": (INT, "cast(l_quantity as bigint)"), "line.price": _cents("l_extendedprice"), "line.flag": (BYTES, "l_returnflag"), "line.status": (BYTES, "l_linestatus"),
            "line.ship": (INT, "timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))"), "line.open": (BOOL, "l_linestatus = 'O'"),
        },
    ),
    "ev": Binding(
        "events",
        ["event_id"],
        {
            "ev.id": (INT, "event_id"), "ev.user": (INT, "user_id"), "ev.type": (BYTES, "event_type"), "ev.k5?": (INT, "nullif(user_id % 5, 0)"),
            "ev.props": (Map(INT), "from_json(props, 'map<string,bigint>')"), "ev.ip": (IP, _packed("user_id")),
            "ev.ips": (Array(IP), f"array({_packed('user_id')}, {_packed('user_id * 7')})"), "ev.ip6": (IP, f"unhex(concat('20010DB8', repeat('00', 8), lpad(hex({BASE_IP} + user_id), 8, '0')))"),
            "ev.nums": (Array(INT), "filter(array(user_id, nullif(user_id % 3, 0), 7), x -> x is not null)"),
            "ev.few": (Array(INT), "slice(array(user_id, 7), 1, cast(user_id % 3 as int))"),
            "ev.flags?": (Array(BOOL), "case when user_id % 4 > 0 then slice(array(user_id % 2 = 0, event_type = 'click'), 1, cast(user_id % 4 - 1 as int)) end"),
        },
        f"(select *, nullif(user_id % 5, 0) as k5, {BASE_IP} + user_id as ip, regexp_extract(props, '\"k\": *(-?[0-9]+)', 1)::bigint as k, list_filter([user_id, nullif(user_id % 3, 0), 7], lambda x: x is not null) as nums,"
        " [user_id, 7][1:user_id % 3] as few, case when user_id % 4 > 0 then [user_id % 2 = 0, event_type = 'click'][1:user_id % 4 - 1] end as flags from events)",
    ),
    "doc": Binding(
        "documents",
        ["doc_id"],
        {
            "doc.id": (INT, "doc_id"), "doc.text": (BYTES, "text"), "doc.lang": (BYTES, "lang"), "doc.source": (BYTES, "source"), "doc.n_chars": (INT, "n_chars"),
            "doc.words": (Array(BYTES), "split(text, ' ')"), "doc.grid": (Array(Array(BYTES)), "transform(split(text, '\\n'), x -> split(x, ' '))"),
            "doc.tags": (Map(Array(BYTES)), "map('lang', array(lang), 'source', array(source, lang))"),
        },
        "(select *, string_split(text, ' ') as words, list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' ')) as grid from documents)",
    ),
    "page": Binding(
        "pages",
        ["page_id"],
        {"page.id": (INT, "page_id"), "page.url": (BYTES, "url"), "page.html": (BYTES, "html"), "page.q?": (Map(BYTES), "case when url like '%?%' then str_to_map(regexp_extract(url, '[?]([^#]*)', 1), '&', '=') end")},
        "(select *, case when url like '%?%' then list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: split_part(p, '=', 2)) else [] end as vals, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') as ref from pages)",
    ),
    "cust": Binding("customer", ["c_custkey"], {"cust.key": (INT, "c_custkey"), "cust.name": (BYTES, "c_name"), "cust.seg": (BYTES, "c_mktsegment"), "cust.bal": _cents("c_acctbal"), "cust.raw": (BYTES, "cast(c_mktsegment as binary)")}),
    "part": Binding("part", ["p_partkey"], {"part.key": (INT, "p_partkey"), "part.name": (BYTES, "p_name"), "part.type": (BYTES, "p_type"), "part.size": (INT, "p_size")}),
    "ord": Binding("orders", ["o_orderkey"], {"ord.key": (INT, "o_orderkey"), "ord.cust": (INT, "o_custkey"), "ord.status": (BYTES, "o_orderstatus"), "ord.prio": (BYTES, "o_orderpriority"), "ord.total": _cents("o_totalprice")}),
    "label": Binding("labels", ["doc_id"], {"label.doc": (INT, "doc_id"), "label.good": (BOOL, "quality = 1"), "label.toxic": (BOOL, "toxic = 1")}),
}


@dataclass
class Query:
    binding: str
    text: str
    where: str  # the predicate in DuckDB SQL
    nil_not_equal: bool = True
    lists: Callable[[SparkSession, str], dict] | None = None
    functions: Callable[[], dict] | None = None


@dataclass
class Projection:
    binding: str
    values: dict[str, str]
    select: str  # the value columns in DuckDB SQL


def _vip(spark: SparkSession, sf_dir: str) -> dict:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey = 1")
    return {INT: TableList(nations.select(F.lit("vip").alias("name"), F.col("n_nationkey").cast("bigint").alias("value")))}


def _sets(spark: SparkSession, sf_dir: str) -> dict:
    return {INT: SetList({"low": range(1, 8), "none": []}), BYTES: SetList({"kinds": [b"click", b"error"]})}


def _addresses(spark: SparkSession, sf_dir: str) -> dict:
    """Addresses as texts, in a set and in a table, and byte strings that are no text."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("nations").alias("name"), F.concat(F.lit("10.0.0."), "n_nationkey").alias("value"))
    return {IP: TableList(nations.unionByName(spark.range(1).select(F.lit("nations").alias("name"), F.lit("2001:db8::a00:7").alias("value"))))}


def _raw(spark: SparkSession, sf_dir: str) -> dict:
    return {BYTES: SetList({"mixed": [b"\xff\xfe", b"BUILDING", "MACHINERY"]}), IP: SetList({"hosts": ["10.0.0.7", "192.168.1.1", b"\x0a\x00\x00\xc8", "::1"]})}


def _customers(spark: SparkSession, sf_dir: str) -> dict:
    """A table list of a tenth of the users that grows with the data."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 = 0")
    return {INT: TableList(keys.select(F.lit("thirds").alias("name"), F.col("c_custkey").cast("bigint").alias("value")))}


def _reversing() -> dict:
    return {"reversed": python_function([("both", BYTES)], BYTES, lambda b: b if b is None else b.decode()[::-1].encode())}


def _even(spark: SparkSession, sf_dir: str) -> dict:
    return {INT: RuleList(lambda name, v: v % 2 == (name != "even"), lambda name, c: c % 2 == (0 if name == "even" else 1))}


def _fixed(spark: SparkSession, sf_dir: str) -> dict:
    return {INT: AlwaysList(), BYTES: NeverList(), IP: AlwaysList(matches=True)}


BIG_KEYS = " ".join(str(7 * i) for i in range(400))
Q, P = Query, Projection
FILTERS = {
    "flagship": Q("line", 'line.flag == "N" && line.qty > 10 && line.suppkey in {1..5 8}', "l_returnflag = 'N' and l_quantity > 10 and (l_suppkey between 1 and 5 or l_suppkey = 8)"),
    "is_true": Q("label", "label.toxic", "toxic = 1"),
    "is_true_not": Q("label", "!label.good or label.toxic", "quality <> 1 or toxic = 1"),
    "eq_bytes": Q("line", 'line.flag == "N"', "l_returnflag = 'N'"),
    "eq_word": Q("line", 'line.flag eq "N"', "l_returnflag = 'N'"),
    "ne_bytes": Q("line", 'line.flag != "N"', "l_returnflag <> 'N'"),
    "not_eq": Q("line", 'not (line.flag == "N")', "l_returnflag <> 'N'"),
    "lt_int": Q("line", "line.qty < 10", "l_quantity < 10"),
    "gt_price": Q("line", "line.price gt 0x100000", "round(l_extendedprice * 100) > 1048576"),
    "octal_le": Q("line", "line.number le 03", "l_linenumber <= 3"),
    "ge_le_int": Q("line", "line.suppkey >= 3 && line.suppkey <= 20", "l_suppkey >= 3 and l_suppkey <= 20"),
    "negative_int": Q("cust", "cust.bal < -5000", "round(c_acctbal * 100) < -5000"),
    "ship_range": Q("line", "line.ship ge 946684800 and line.ship lt 978307200", "l_shipdate >= timestamp '2000-01-01' and l_shipdate < timestamp '2001-01-01'"),
    "bitand": Q("line", "line.orderkey & 5", "(l_orderkey & 5) <> 0"),
    "bitand_word": Q("line", "line.orderkey bitwise_and 0x10", "(l_orderkey & 16) <> 0"),
    "in_int_ranges": Q("line", "line.partkey in {7 9 100..200}", "l_partkey in (7, 9) or l_partkey between 100 and 200"),
    "in_int_overlaps": Q("line", "line.partkey in {100..150 120..200 201 5}", "l_partkey between 100 and 201 or l_partkey = 5"),
    "in_int_many": Q("line", f"line.partkey in {{{BIG_KEYS}}}", "l_partkey % 7 = 0 and l_partkey < 2800"),
    "in_bytes": Q("ev", 'ev.type in {"click" "error"}', "event_type in ('click', 'error')"),
    "in_bytes_raw": Q("ev", 'ev.type in {r"click" r#"view"#}', "event_type in ('click', 'view')"),
    "in_empty": Q("ev", "ev.type in {}", "false"),
    "bytes_order": Q("cust", 'cust.seg >= "FURNITURE" && cust.seg < "M"', "c_mktsegment >= 'FURNITURE' and c_mktsegment < 'M'"),
    "bytes_hex": Q("cust", "cust.seg contains 55:49-4C", "contains(c_mktsegment, 'UIL')"),
    "bytes_binary": Q("cust", r'cust.raw > "F\x55" and cust.raw contains "\105"', "c_mktsegment > 'FU' and contains(c_mktsegment, 'E')"),
    "contains": Q("doc", 'doc.text contains "the"', "contains(text, 'the')"),
    "contains_empty": Q("doc", 'doc.text contains ""', "true"),
    "regex": Q("doc", 'doc.text ~ "(?i)th[aeiou]+n"', "regexp_matches(text, '(?i)th[aeiou]+n')"),
    "regex_anchor": Q("page", r'page.url ~ r"^https?://m\."', r"regexp_matches(url, '^https?://m\.')"),
    "regex_end": Q("page", r'page.url matches "/[0-9]+$"', r"regexp_matches(url, '/[0-9]+$')"),
    "regex_posix": Q("part", r'part.type ~ "^[[:alpha:]]{6,}$"', "regexp_matches(p_type, '^[A-Za-z]{6,}$')"),
    "regex_boundary": Q("part", r'part.name ~ r"\bring\b"', r"regexp_matches(p_name, '\bring\b')"),
    "wildcard_ci": Q("part", 'part.name wildcard "COLD*"', "p_name ilike 'cold%'"),
    "wildcard_strict": Q("page", 'page.url strict wildcard "https://*/en/*"', "url like 'https://%/en/%'"),
    "wildcard_escape": Q("page", r'page.url wildcard r"*?page=*&ref=*"', "url ilike '%?page=%&ref=%'"),
    "and_or_prec": Q("line", 'line.flag=="R" or line.status=="F" and line.qty > 40', "l_returnflag = 'R' or (l_linestatus = 'F' and l_quantity > 40)"),
    "parens": Q("line", '(line.flag=="R" or line.status=="F") and line.qty > 40', "(l_returnflag = 'R' or l_linestatus = 'F') and l_quantity > 40"),
    "xor2": Q("line", 'line.flag=="N" xor line.qty > 25', "(l_returnflag = 'N') <> (l_quantity > 25)"),
    "xor3": Q("line", 'line.flag=="N" ^^ line.qty > 25 ^^ line.number==1', "((l_returnflag = 'N') <> (l_quantity > 25)) <> (l_linenumber = 1)"),
    "xor_prec": Q("line", 'line.qty > 45 or line.flag=="N" xor line.open and line.number == 1', "l_quantity > 45 or ((l_returnflag = 'N') <> (l_linestatus = 'O' and l_linenumber = 1))"),
    "bool_field": Q("line", "line.open and not line.number == 1", "l_linestatus = 'O' and l_linenumber <> 1"),
    "opt_eq": Q("ev", "ev.k5 == 3", "coalesce(k5 = 3, false)"),
    "opt_ne_niltrue": Q("ev", "ev.k5 != 3", "k5 is null or k5 <> 3"),
    "opt_ne_nilfalse": Q("ev", "ev.k5 != 3", "coalesce(k5 <> 3, false)", nil_not_equal=False),
    "not_opt_eq": Q("ev", "not (ev.k5 == 3)", "not coalesce(k5 = 3, false)"),
    "not_opt_ne_nilfalse": Q("ev", "not (ev.k5 ne 3)", "not coalesce(k5 <> 3, false)", nil_not_equal=False),
    "opt_in_set": Q("ev", "not ev.k5 in {1..2 4}", "not coalesce(k5 in (1, 2, 4), false)"),
    "arr_index": Q("doc", 'doc.words[1] == "the"', "coalesce(words[2] = 'the', false)"),
    "arr_index_oob_ne": Q("doc", 'doc.words[500] != "the"', "words[501] is null or words[501] <> 'the'"),
    "any_eq": Q("doc", 'any(doc.words[*] == "und")', "list_contains(words, 'und')"),
    "all_ne": Q("doc", 'all(doc.words[*] != "the")', "not list_contains(words, 'the')"),
    "any_in_set": Q("doc", 'any(doc.words[*] in {"der" "die"})', "list_has_any(words, ['der', 'die'])"),
    "any_contains": Q("doc", 'any(doc.words[*] contains "sch")', "len(list_filter(words, lambda x: contains(x, 'sch'))) > 0"),
    "any_regex": Q("doc", 'any(doc.words[*] ~ "^q.*e$")', "len(list_filter(words, lambda x: regexp_matches(x, '^q[^\\n]*e$'))) > 0"),
    "any_and_zip": Q("doc", 'any((doc.words[*] strict wildcard "th*" and len(doc.words[*])[*] > 5))', "len(list_filter(words, lambda x: x like 'th%' and octet_length(encode(x)) > 5)) > 0"),
    "any_vec_not": Q("doc", 'any((not doc.words[*] contains "e"))', "len(list_filter(words, lambda x: not contains(x, 'e'))) > 0"),
    "all_vec_or": Q("ev", "all((ev.nums[*] > 50 or ev.nums[*] == 7))", "len(list_filter(nums, lambda x: not (x > 50 or x = 7))) = 0"),
    "any_vec_xor": Q("ev", "any((ev.nums[*] > 50 xor ev.nums[*] & 1))", "len(list_filter(nums, lambda x: (x > 50) <> ((x & 1) <> 0))) > 0"),
    "zip_truncates": Q("ev", "any((ev.nums[*] > 6 and ev.few[*] > 6))", "len(list_filter(range(1, least(len(nums), len(few)) + 1), lambda i: nums[i] > 6 and few[i] > 6)) > 0"),
    "any_flags": Q("ev", "any(ev.flags)", "flags is not null and list_contains(flags, true)"),
    "all_flags_missing": Q("ev", "all(ev.flags)", "flags is not null and not list_contains(flags, false)"),
    "all_flags_group": Q("ev", "all((ev.flags))", "flags is null or not list_contains(flags, false)"),
    "bool_index": Q("ev", "ev.flags[1] or not ev.flags[0]", "coalesce(flags[2], false) or not coalesce(flags[1], false)"),
    "map_each_len": Q("doc", "any(len(doc.words[*])[*] > 14)", "len(list_filter(words, lambda x: octet_length(encode(x)) > 14)) > 0"),
    "map_key": Q("page", 'page.q["ref"] == "x"', "coalesce(ref = 'x', false)"),
    "map_key_ne": Q("page", 'page.q["ref"] != "x"', "ref is null or ref <> 'x'"),
    "map_any_missing": Q("page", 'any(page.q[*] == "feed")', "list_contains(vals, 'feed')"),
    "map_all_missing": Q("page", 'all(page.q[*] == "feed")', "len(list_filter(vals, lambda x: x <> 'feed')) = 0"),
    "map_array_each": Q("doc", 'any(doc.tags[*][*] == "src3")', "source = 'src3'"),
    "map_array_chain": Q("doc", 'doc.tags["source"][1] == "en" and doc.tags["none"][0] != "x"', "lang = 'en'"),
    "grid_each": Q("doc", 'any(doc.grid[*][*] == "of")', "len(list_filter(flatten(grid), lambda x: x = 'of')) > 0"),
    "grid_column": Q("doc", 'any(doc.grid[*][3] == "la")', "len(list_filter(grid, lambda x: coalesce(x[4] = 'la', false))) > 0"),
    "grid_row": Q("doc", 'any(doc.grid[1][*] wildcard "E*")', "len(list_filter(coalesce(grid[2], []), lambda x: x ilike 'e%')) > 0"),
    "props_map": Q("ev", 'ev.props["k"] >= 50', "coalesce(k >= 50, false)"),
    "concat": Q("cust", 'concat(cust.seg, "-x") == "FURNITURE-x"', "c_mktsegment = 'FURNITURE'"),
    "concat3": Q("cust", 'concat(cust.seg, "/", cust.name) strict wildcard "BUILDING/*7"', "c_mktsegment = 'BUILDING' and c_name like '%7'"),
    "lower_fn": Q("cust", 'lowercase(cust.seg) == "machinery"', "lower(c_mktsegment) = 'machinery'"),
    "upper_fn": Q("part", 'uppercase(part.name) contains "RING"', "contains(upper(p_name), 'RING')"),
    "nested_fn": Q("cust", 'len(concat(lower(cust.seg), "é")) == 11', "octet_length(encode(c_mktsegment || 'é')) = 11"),
    "fn_index": Q("doc", 'lower(doc.words[*])[2] == "et"', "coalesce(lower(words[3]) = 'et', false)"),
    "fn_filter": Q("ev", "any(filter(ev.nums, ev.flags)[*] == 7)", "flags is not null and len(list_filter(range(1, least(len(nums), len(flags)) + 1), lambda i: flags[i] and nums[i] = 7)) > 0"),
    "fn_predicate_arg": Q("ev", "filter(ev.nums, (not ev.flags))[0] == 7", "coalesce(list_filter(range(1, least(len(nums), len(coalesce(flags, []))) + 1), lambda i: not flags[i])[1] is not null and nums[list_filter(range(1, least(len(nums), len(coalesce(flags, []))) + 1), lambda i: not flags[i])[1]] = 7, false)"),
    "fn_array": Q("cust", 'any(array(cust.seg)[*] == "BUILDING")', "c_mktsegment = 'BUILDING'"),
    "fn_first": Q("page", 'first(page.q) == "2"', "coalesce(list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> ''))[1] like '%=2', false)"),
    "fn_echo": Q("cust", 'echo(cust.seg, 3) == "BUILDING"', "c_mktsegment = 'BUILDING'"),
    "ip_eq": Q("ev", "ev.ip == 10.0.0.7", "user_id = 7"),
    "ip_range_ops": Q("ev", "ev.ip >= 10.0.0.4 && ev.ip < 10.0.0.44", "user_id >= 4 and user_id < 44"),
    "ip_cidr": Q("ev", "ev.ip in {10.0.0.0/28}", "user_id < 16"),
    "ip_set": Q("ev", "ev.ip in {10.0.0.0/29 10.0.0.40..10.0.0.50 10.0.0.99 ::1}", "user_id < 8 or user_id between 40 and 50 or user_id = 99"),
    "ip6_cidr": Q("ev", "ev.ip6 in {2001:db8::a00:0/124 10.0.0.0/8}", "user_id < 16"),
    "ip_v6_lt_never": Q("ev", "ev.ip < ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "false"),
    "ip_v6_ne_always": Q("ev", "ev.ip != ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "true"),
    "ip_each": Q("ev", "any(ev.ips[*] in {10.0.0.49})", "user_id = 49 or user_id * 7 = 49"),
    "list_semi": Q("ev", "ev.user in $vip", "user_id in (select n_nationkey from nation where n_regionkey = 1)", lists=_vip),
    "list_semi_and": Q("ev", 'ev.user in $vip and ev.type == "click"', "user_id in (select n_nationkey from nation where n_regionkey = 1) and event_type = 'click'", lists=_vip),
    "list_under_or": Q("ev", 'ev.user in $vip or ev.type == "error"', "user_id in (select n_nationkey from nation where n_regionkey = 1) or event_type = 'error'", lists=_vip),
    "list_under_not": Q("ev", "not ev.k5 in $vip", "not coalesce(k5 in (select n_nationkey from nation where n_regionkey = 1), false)", lists=_vip),
    "list_set": Q("ev", "ev.user in $low or ev.type in $kinds", "user_id between 1 and 7 or event_type in ('click', 'error')", lists=_sets),
    "list_unknown_name": Q("ev", "ev.user in $none or ev.user in $other", "false", lists=_sets),
    "list_each": Q("ev", "any(ev.nums[*] in $low)", "true", lists=_sets),
    "list_table_each": Q("ev", "any(ev.few[*] in $vip)", "event_id in (select event_id from (select event_id, unnest([user_id, 7][1:user_id % 3]) as u from events) where u in (select n_nationkey from nation where n_regionkey = 1))", lists=_vip),
    "list_table_each_many": Q("ev", "any(ev.nums[*] in $thirds)", "event_id in (select event_id from (select event_id, unnest([user_id, nullif(user_id % 3, 0), 7]) as u from events) where u in (select c_custkey from customer where c_custkey % 3 = 0))", lists=_customers),
    "list_table_all_many": Q("ev", "all(ev.few[*] in $thirds) and ev.user > 5", "user_id > 5 and event_id not in (select event_id from (select event_id, unnest([user_id, 7][1:user_id % 3]) as u from events) where u not in (select c_custkey from customer where c_custkey % 3 = 0))", lists=_customers),
    "list_missing": Q("ev", "ev.k5 in $thirds xor ev.user in $thirds", "coalesce(k5 in (select c_custkey from customer where c_custkey % 3 = 0), false) <> (user_id in (select c_custkey from customer where c_custkey % 3 = 0))", lists=_customers),
    "list_ip_set": Q("ev", "ev.ip in $hosts or ev.ip6 in $hosts", "user_id in (7, 200)", lists=_raw),
    "list_ip_set_each": Q("ev", "any(ev.ips[*] in $hosts)", "user_id in (1, 7, 200)", lists=_raw),
    "list_ip_table": Q("ev", "ev.ip in $nations or ev.ip6 in $nations", "user_id < 25", lists=_addresses),
    "list_ip_table_each": Q("ev", "any(ev.ips[*] in $nations)", "user_id < 25 or user_id * 7 < 25", lists=_addresses),
    "list_bytes_raw": Q("cust", "cust.seg in $mixed and cust.raw in $mixed", "c_mktsegment in ('BUILDING', 'MACHINERY')", lists=_raw),
    "fn_python": Q("cust", 'reversed(cust.seg) == "GNIDLIUB" or reversed(cust.raw) contains "YRE"', "c_mktsegment in ('BUILDING', 'MACHINERY')", functions=_reversing),
    "fn_python_each": Q("doc", 'any(reversed(doc.words[*])[*] == "eht")', "list_contains(words, 'the')", functions=_reversing),
    "fn_regex_replace": Q("cust", 'regex_replace(cust.name, "[^0-9]+0*", "") == "7"', "c_custkey = 7"),
    "list_rule": Q("ev", "ev.user in $odd", "user_id % 2 = 1", lists=_even),
    "list_rule_each": Q("ev", "all(ev.nums[*] in $odd)", "len(list_filter(nums, lambda x: x % 2 = 0)) = 0", lists=_even),
    "list_always": Q("ev", "ev.user in $any", "false", lists=_fixed),
    "list_always_meant": Q("ev", "ev.ip in $any", "true", lists=_fixed),
    "list_never": Q("ev", "not ev.type in $any", "true", lists=_fixed),
    "orders_mix": Q("ord", 'ord.status == "O" and (ord.prio wildcard "1-*" or ord.total >= 10000000)', "o_orderstatus = 'O' and (o_orderpriority ilike '1-%' or round(o_totalprice * 100) >= 10000000)"),
}

PROJECTIONS = {
    "value_scalars": P("cust", {"seg": "lower(cust.seg)", "n": "len(cust.name)", "both": 'concat(cust.seg, ":", cust.name)'}, "lower(c_mktsegment) as seg, octet_length(encode(c_name))::bigint as n, c_mktsegment || ':' || c_name as both"),
    "value_missing": P("ev", {"k5": "ev.k5", "num": "ev.nums[2]", "k": 'ev.props["k"]', "none": 'ev.props["z"]'}, "k5, nums[3] as num, k, null::bigint as none"),
    "value_mapped": P("doc", {"third": "upper(doc.words[*])[2]", "size": "len(doc.grid[*][0])[0]"}, "translate(words[3], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as third, octet_length(encode(grid[1][1]))::bigint as size"),
    "value_filtered": P("ev", {"kept": "filter(ev.nums, ev.flags)[0]"}, "case when flags is not null then nums[list_filter(range(1, least(len(nums), len(flags)) + 1), lambda i: flags[i])[1]] end as kept"),
}


def scheme_of(binding: str, nil_not_equal: bool = True, lists: dict | None = None, functions: dict | None = None) -> Scheme:
    builder = SchemeBuilder().add_functions(standard() | (functions or {})).set_nil_not_equal_behavior(nil_not_equal)
    for name, (kind, _) in BINDINGS[binding].fields.items():
        builder.add_field(name.rstrip("?"), kind, name.endswith("?"))
    for kind, definition in (lists or {}).items():
        builder.add_list(kind, definition)
    return builder.build()


def bound(spark: SparkSession, sf_dir: str, binding: str, nil_not_equal: bool = True, lists: dict | None = None, functions: dict | None = None) -> BoundFrame:
    b = BINDINGS[binding]
    columns = {name.rstrip("?"): column for name, (_, column) in b.fields.items()}
    return bind(spark.read.parquet(f"{sf_dir}/{b.table}.parquet"), scheme_of(binding, nil_not_equal, lists, functions), columns)


def run_filter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    q = FILTERS[name]
    frame = bound(spark, sf_dir, q.binding, q.nil_not_equal, q.lists(spark, sf_dir) if q.lists else None, q.functions() if q.functions else None)
    return frame.filter(q.text).select(*BINDINGS[q.binding].keys)


def run_projection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    p = PROJECTIONS[name]
    return bound(spark, sf_dir, p.binding).select(p.values, *BINDINGS[p.binding].keys)


def filter_sql(name: str) -> str:
    q = FILTERS[name]
    b = BINDINGS[q.binding]
    return f"select {', '.join(b.keys)} from {b.sql or b.table} where {q.where}"


def projection_sql(name: str) -> str:
    p = PROJECTIONS[name]
    b = BINDINGS[p.binding]
    return f"select {', '.join(b.keys)}, {p.select} from {b.sql or b.table}"


ANNOTATED = {"cheap": "line.price < 500000", "open": "line.open", "flagged": 'line.flag in {"N" "R"}', "odd": "line.orderkey & 1"}


def annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several filters as flags in one pass."""
    frame = bound(spark, sf_dir, "line")
    return frame.annotate(ANNOTATED).select(*BINDINGS["line"].keys, *ANNOTATED)


ANNOTATE_SQL = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100) < 500000 as cheap, l_linestatus = 'O' as open, l_returnflag in ('N', 'R') as flagged, (l_orderkey & 1) <> 0 as odd from lineitem"


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as JSON records, read back by the scheme and filtered."""
    scheme = SchemeBuilder({"key": INT, "seg": BYTES, "rich": BOOL, "tags": Array(BYTES), "scores": Map(INT)}).build()
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("seg"), (F.col("c_acctbal") > 5000).alias("rich"), F.array("c_name", "c_mktsegment").alias("tags"), F.create_map(F.lit("bal"), F.floor("c_acctbal")).alias("scores")
    )
    written = write_records(bind(rows, scheme))
    back = read_records(written, scheme, "record")
    frame = bind(back, scheme)
    return frame.filter('rich and any(tags[*] == "BUILDING") and scores["bal"] < 9000').select("key", "seg", F.col("scores")["bal"].alias("bal"))


JSON_SQL = "select c_custkey as key, c_mktsegment as seg, floor(c_acctbal)::bigint as bal from customer where c_acctbal > 5000 and c_mktsegment = 'BUILDING' and floor(c_acctbal) < 9000"


def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON records with addresses, byte strings that are no text and maps with such keys, read back and projected."""
    scheme = SchemeBuilder({"id": INT, "ips": Array(IP), "raw": Array(BYTES), "sums": Map(Array(INT)), "hosts": Map(IP)}).build()
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id as id", f"array({_packed('user_id')}, unhex(concat('20010DB8', repeat('00', 8), lpad(hex(user_id), 8, '0')))) as ips", "array(cast(concat(unhex('FF'), encode(event_type, 'utf-8')) as string), event_type) as raw",
        "map('a', array(user_id, 1), cast(unhex('FE') as string), array(user_id * 2)) as sums", f"map('h', {_packed('user_id')}) as hosts",
    )
    text = write_records(bind(rows, scheme, {"ips": "ips", "hosts": "hosts"})).where("record is not null")
    frame = bind(read_records(text, scheme, "record"), scheme)
    kept = frame.filter(r'any(ips[*] in {2001:db8::/127}) or any(raw[*] == "\xffclick") and hosts["h"] < 10.0.0.40 and sums["a"][1] == 1')
    return kept.select(F.col("id").alias("event_id"), F.hex(F.get("ips", F.lit(0))).alias("ip"), F.hex(F.get("raw", F.lit(0))).alias("raw"), F.aggregate(F.flatten(F.map_values("sums")), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"))


JSON_NESTED_SQL = f"select event_id, printf('%08X', {BASE_IP} + user_id) as ip, 'FF' || hex(event_type) as raw, (3 * user_id + 1)::bigint as total from events where user_id < 2 or (event_type = 'click' and user_id < 40)"
ROUTED = {"cheap": "ev.user in $vip", "clicks": 'ev.type == "click"', "few": "any(ev.few[*] in $vip)"}


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters that each event matches, with a table list among them."""
    return bound(spark, sf_dir, "ev", lists=_vip(spark, sf_dir)).route(ROUTED).select("event_id", F.array_join("routes", ",").alias("routes"))


_VIP_SQL = "(select n_nationkey from nation where n_regionkey = 1)"
ROUTED_SQL = f"""select event_id, concat_ws(',', case when user_id in {_VIP_SQL} then 'cheap' end, case when event_type = 'click' then 'clicks' end,
    case when (user_id % 3 > 0 and user_id in {_VIP_SQL}) or (user_id % 3 > 1 and 7 in {_VIP_SQL}) then 'few' end) as routes from events"""


def contains_one_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree made by hand: the node that no text stands for."""
    frame = bound(spark, sf_dir, "part")
    node = frame.scheme.parse('part.type contains "x"')
    tree = replace(node, op="ContainsOneOf", right=(BytesLit(b"TIN"), BytesLit(b"STEEL")))
    return frame.filter(Filter(frame.scheme, tree)).select("p_partkey")


ONE_OF_SQL = "select p_partkey from part where contains(p_type, 'TIN') or contains(p_type, 'STEEL')"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in FILTERS:
        out[name] = lambda spark, sf_dir, name=name: run_filter(spark, sf_dir, name)
    for name in PROJECTIONS:
        out[name] = lambda spark, sf_dir, name=name: run_projection(spark, sf_dir, name)
    return out | {f.__name__: f for f in (annotate, json_records, json_nested, routed, contains_one_of)}


def oracles() -> dict[str, str]:
    return {n: filter_sql(n) for n in FILTERS} | {n: projection_sql(n) for n in PROJECTIONS} | {"annotate": ANNOTATE_SQL, "json_records": JSON_SQL, "json_nested": JSON_NESTED_SQL, "routed": ROUTED_SQL, "contains_one_of": ONE_OF_SQL}
