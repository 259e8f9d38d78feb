"""What filters mean: fixtures for one record, and the interpreter against the Spark lowering on random filters and rows."""

import ipaddress
import random

import pytest
from interp import LocalRecord, glob_matches

import siftwright as S
from siftwright.errors import MissingField, SchemeMismatch, TypeMismatch
from siftwright.functions.udf import python_function
from siftwright.operators.engine import Filter
from siftwright.plans.lower import Lowering, merged
from siftwright.sources.records import Record, records_frame

FIELDS = {
    "host": S.BYTES, "port": S.INT, "ip": S.IP, "ssl": S.BOOL, "ports": S.Array(S.INT), "cookies": S.Array(S.BYTES), "headers": S.Map(S.BYTES), "flags": S.Array(S.BOOL),
    "more": S.Array(S.BOOL), "mba": S.Map(S.Array(S.BOOL)), "mb": S.Map(S.Array(S.BYTES)), "grid": S.Array(S.Array(S.BYTES)), "ips": S.Array(S.IP),
}


def make(nil=True, optional=True, extra=None):
    b = S.SchemeBuilder().add_functions(S.standard_functions()).set_nil_not_equal_behavior(nil)
    for name, kind in FIELDS.items():
        b.add_field(name, kind, optional)
    b.add_list(S.INT, S.RuleList(lambda name, v: (v % 2 == 0) == (name == "even"), lambda name, c: (c % 2 == 0) == (name == "even")))
    b.add_list(S.BYTES, S.SetList({"hosts": [b"a.org", b"b.org"]}))
    return b.build()


SCHEME = make()


def ask(text, scheme=SCHEME, **values):
    record = LocalRecord(scheme)
    for name, value in values.items():
        record.set(name, value)
    return record.matches(Filter.parse(scheme, text))


def value(text, **values):
    record = LocalRecord(SCHEME)
    for name, v in values.items():
        record.set(name, v)
    return record.value(Filter(SCHEME, SCHEME.parse_value(text)))


GRID = [[f"[{i}][{j}]" for j in range(10)] for i in range(10)]


# What the language says of these records.
@pytest.mark.parametrize(
    ("text", "values", "wanted"),
    [
        ("ssl", {"ssl": True}, True), ("ssl", {"ssl": False}, False), ("ssl", {}, False), ("not ssl", {}, True),
        ("ip <= 10:20:30:40:50:60:70:80", {"ip": "::1"}, True), ("ip <= 10:20:30:40:50:60:70:80", {"ip": "10:20:30:40:50:60:70:81"}, False), ("ip <= 10:20:30:40:50:60:70:80", {"ip": "127.0.0.1"}, False),
        ('host == "example.org"', {"host": "example.com"}, False), ("port & 1", {"port": 80}, False), ("port & 1", {"port": 443}, True), ("port < 8000", {"port": 80}, True),
        ("ip in { 127.0.0.0/8 ::1 10.0.0.0..10.0.255.255 }", {"ip": "127.0.0.3"}, True), ("ip in { 127.0.0.0/8 ::1 10.0.0.0..10.0.255.255 }", {"ip": "255.255.255.255"}, False),
        ("ip in { 127.0.0.0/8 ::1 10.0.0.0..10.0.255.255 }", {"ip": "::1"}, True), ('host contains "abc"', {"host": "abc.net.au"}, True), ("host contains 6F:72:67", {"host": "example.org"}, True),
        ('cookies[0] == "x"', {"cookies": []}, False), ('cookies[0] != "x"', {"cookies": []}, True), ('headers["missing"] != "x"', {"headers": {}}, True), ('headers["missing"] == "x"', {"headers": {}}, False),
        ('lowercase(host) == "example.org"', {"host": "EXAMPLE.ORG"}, True), ('concat(host, ".org") == "example.org"', {"host": "example"}, True),
        ('filter(cookies, flags)[0] == "three"', {"cookies": ["one", "two", "three"], "flags": [False, False, True]}, True),
        ('concat(cookies[*], "-cf")[2] == "three-cf"', {"cookies": ["one", "two", "three"]}, True), ("port in $even", {"port": 1000}, True), ("port in $odd", {"port": 1000}, False),
        ("any(ports[*] in $even)", {"ports": [1001, 1000]}, True), ("any(ports[*] in $even)", {"ports": [1001, 1003]}, False),
        ('any(mba["missing"])', {"mba": {}}, False), ('all(mba["missing"])', {"mba": {}}, False), ('any(mb["missing"][*] matches "bar")', {"mb": {}}, False), ('all(mb["missing"][*] matches "bar")', {"mb": {}}, True),
        ('host matches r###"a.b"###', {"host": "axb"}, True), ('host matches r###"a.b"###', {"host": "axc"}, False), ("any(flags)", {"flags": []}, False), ("all(flags)", {"flags": []}, True),
        ("any((flags and more))", {"flags": [True, False, True], "more": [False]}, False), ("all((flags and more))", {"flags": [True, False], "more": [True]}, True),
        ("any((not flags))", {"flags": [True, False]}, True), ("all((flags xor more))", {"flags": [True, False], "more": [False, True]}, True), ("all((flags))", {}, True), ("all(flags)", {}, False),
        ('any(grid[*][*] == "[5][5]")', {"grid": GRID}, True), ('any(grid[5][*] == "[5][5]")', {"grid": GRID}, True), ('any(grid[*][5] == "[5][5]")', {"grid": GRID}, True), ('any(grid[4][*] == "[5][5]")', {"grid": GRID}, False),
        ('host ~ "^..$"', {"host": "É"}, True), ('host ~ "^.$"', {"host": "É"}, False), (r'host ~ "a$"', {"host": "a\n"}, False), (r'host ~ "^a.b$"', {"host": "a\rb"}, True), (r'host ~ r"\bé\b"', {"host": "é"}, False),
        (r'host ~ r"é+$"', {"host": "xéé"}, True), (r'host ~ "[é]x"', {"host": "éx"}, True), (r'host ~ "(?P<n>a|b)+c"', {"host": "abc"}, True), (r'host ~ "[[:digit:]]{2}"', {"host": "a12"}, True),
        (r'host wildcard r"foo?*\*\\"', {"host": "foo?bar*\\"}, True), (r'host wildcard r"foo?*\*\\"', {"host": "foo?x\\"}, False), ('host wildcard "?"', {"host": "x"}, False), ('host wildcard "a"', {"host": "A"}, True),
        ('host strict wildcard "a"', {"host": "A"}, False), ('host wildcard "É*"', {"host": "éx"}, False), (r'host wildcard "\xaa\x22"', {"host": b"\xaa\x22"}, True), ('host strict wildcard "a*b*c"', {"host": "a\nbxbc"}, True),
        ('host strict wildcard "a%_*"', {"host": "a%_z"}, True), ('host strict wildcard "a%_*"', {"host": "abcz"}, False), ("host in $hosts", {"host": "b.org"}, True), ("host in $other", {"host": "b.org"}, False),
        ('host == "a" xor host == "b" xor port == 1', {"host": "a", "port": 1}, False), ('all(headers[*] == "x")', {"headers": {"a": "x", "b": "x"}}, True), ('first(headers) == "1"', {"headers": {"b": "2", "a": "1"}}, True),
    ],
)
def test_one_record(text, values, wanted):
    assert ask(text, **values) is wanted


@pytest.mark.parametrize(
    ("text", "port", "wanted"),
    [("(port != 80)", 443, True), ("(port != 80)", 80, False), ("(port != 80)", None, False), ("not (port eq 80)", None, True), ("not (port ne 80)", None, True), ("not (port ne 80)", 443, False), ("port in {80}", None, False)],
)
def test_missing_values_when_nil_is_not_unequal(text, port, wanted):
    assert ask(text, make(nil=False), **({} if port is None else {"port": port})) is wanted


def test_values():
    assert value("lowercase(headers[*])", headers={"0": "ONE", "2": "THREE", "1": "TWO"}) == [b"one", b"two", b"three"]
    assert value("cookies[7]", cookies=["a"]) is None and value("host") is None
    assert value("concat(cookies, cookies)", cookies=["a"]) == [b"a", b"a"]
    assert value("concat(host, cookies[5], \"z\")", cookies=[]) == b"z"
    assert value("concat(host, cookies[5])", cookies=[]) is None
    assert value("len(cookies[*])", cookies=["é", ""]) == [2, 0]
    assert value("array2(host)[0]", host="x") == [b"x"]
    assert value("regex_replace(host, \"o+\", \"0\")", host="foo boo") == b"f0 b0"


def test_records():
    strict = make(optional=False)
    with pytest.raises(MissingField):
        ask("port == 1", strict)
    r = Record(strict)
    assert r.set("port", 5) is None and r.set("port", 6) == 5
    with pytest.raises(TypeMismatch):
        r.set("port", "x")
    with pytest.raises(TypeMismatch):
        r.set("ports", [1, "x"])
    r.set("headers", {b"\xff": "x", "a": "y"})
    r.set("host", b"a\xff\xffb")
    r.set("ip", ipaddress.ip_address("::ffff:1.2.3.4"))
    form = r.to_json()
    assert form["headers"] == [["a", "y"], [[255], "x"]] and form["host"] == [97, 255, 255, 98] and form["ip"] in ("::ffff:1.2.3.4", "::ffff:102:304")
    assert Record(strict).load_json({k: v for k, v in form.items()}).to_json() == form
    with pytest.raises(KeyError):
        Record(strict).load_json({"nope": 1})
    taken = r.take()
    assert taken.get("port") == 6 and r.get("port") is None
    taken.clear()
    assert taken.get("port") is None


def test_globs_and_spans():
    assert glob_matches([b"a", b"a"], b"aa") and not glob_matches([b"a", b"a"], b"a") and glob_matches([b"", b""], b"")
    assert not glob_matches([b"", b"ab", b"b"], b"ab")
    assert merged([(5, 7), (1, 2), (3, 3), (6, 9), (20, 20)]) == [(1, 3), (5, 9), (20, 20)]


# ---- random filters and rows


def random_leaf(r):
    texts = ["", "a", "b", "ab", "É", "a.org", "b.org", "A*", "%"]
    quoted = lambda: '"' + r.choice(texts) + '"'
    ints = lambda: str(r.choice([-3, 0, 1, 2, 3, 7, 80]))
    order = r.choice(["==", "!=", ">=", "<=", ">", "<"])
    ip = r.choice(["1.2.3.4", "1.2.3.9", "::1", "::2"])
    byte = r.choice(["host", "cookies[0]", "cookies[1]", 'headers["a"]', 'headers["z"]', "grid[0][1]", "lower(host)", 'concat(host, cookies[0])', 'mb["a"][0]', "first(headers)", "upper(cookies[*])[1]", "array(host)[0]"])
    number = r.choice(["port", "ports[0]", "ports[2]", "len(host)", "len(cookies[*])[0]"])
    test = lambda left: r.choice([f"{left} {order} {quoted()}", f"{left} contains {quoted()}", f'{left} ~ "{r.choice(["a", "^a", "b$", "^.$", "[ab]+", ""])}"', f"{left} wildcard {r.choice(['"a*"', '"*b"', '"A*"', '"*"', '"é"'])}", f'{left} strict wildcard "A*"', f"{left} in {{{quoted()} {quoted()}}}", f"{left} in $hosts"])
    count = lambda left: r.choice([f"{left} {order} {ints()}", f"{left} & {r.choice(['1', '2', '6'])}", f"{left} in {{{ints()} 1..3 2..7}}", f"{left} in $even", f"{left} in {{}}"])
    address = lambda left: r.choice([f"{left} {order} {ip}", f"{left} in {{1.2.3.0/29 ::1..::2}}"])
    vec = lambda: r.choice([test("cookies[*]"), test("headers[*]"), test("grid[*][*]"), test("grid[*][1]"), test("mb[*][*]"), count("ports[*]"), count("len(cookies[*])[*]"), test("lower(cookies[*])[*]"), count("len(upper(cookies[*])[*])[*]"), address("ips[*]"), "flags", "more", 'mba["a"]', "(flags)"])
    kind = r.randrange(6)
    if kind == 0:
        return test(byte)
    if kind == 1:
        return count(number)
    if kind == 2:
        return address("ip")
    if kind == 3:
        return r.choice(["ssl", "flags[0]", 'mba["a"][1]'])
    inner = vec() if kind == 4 else f"({r.choice(['not ', ''])}{vec()} {r.choice(['and', 'or', 'xor'])} {vec()})"
    return f"{r.choice(['any', 'all'])}({inner})"


def random_filter(r, depth=3):
    if depth == 0 or r.random() < 0.35:
        return random_leaf(r)
    k = r.randrange(5)
    if k == 0:
        return f"not {random_filter(r, 0)}" if r.random() < 0.5 else f"!({random_filter(r, depth - 1)})"
    return f"({f' {r.choice(["and", "or", "xor"])} '.join(random_filter(r, depth - 1) for _ in range(r.randint(2, 3)))})"


def random_row(r):
    text = lambda: r.choice(["", "a", "b", "ab", "É", "a.org", "A*", "xyz", "a\nb"])
    some = lambda make, chance=0.75: make() if r.random() < chance else None
    many = lambda make: [make() for _ in range(r.randint(0, 3))]
    ip = lambda: r.choice([bytes([1, 2, 3, 4]), bytes([1, 2, 3, 9]), bytes(15) + b"\1", bytes(15) + b"\2"])
    keys = lambda make: {k: make() for k in r.sample(["b", "a", "c"], r.randint(0, 3))}
    flag = lambda: r.random() < 0.5
    number = lambda: r.choice([-3, 0, 1, 2, 3, 7, 80])
    return {
        "host": some(text), "port": some(number), "ip": some(ip), "ssl": some(flag), "ports": some(lambda: many(number)), "cookies": some(lambda: many(text)), "headers": some(lambda: keys(text)), "flags": some(lambda: many(flag)),
        "more": some(lambda: many(flag)), "mba": some(lambda: keys(lambda: many(flag))), "mb": some(lambda: keys(lambda: many(text))), "grid": some(lambda: many(lambda: many(text))), "ips": some(lambda: many(ip)),
    }


def to_record(scheme, row):
    record = LocalRecord(scheme)
    for name, v in row.items():
        if v is not None:
            record.set(name, v)
    return record


@pytest.mark.parametrize("seed", range(4))
def test_interpreter_and_spark_agree(spark, seed):
    r = random.Random(seed)
    scheme = make(nil=seed % 2 == 0)
    rows = [random_row(r) for _ in range(60)]
    texts = [random_filter(r) for _ in range(60)]
    df = spark.createDataFrame([tuple(row[f] for f in FIELDS) for row in rows], scheme.to_struct_type())
    got = S.bind(df.coalesce(2), scheme).annotate({f"f{i}": t for i, t in enumerate(texts)}).select([f"f{i}" for i in range(len(texts))]).collect()
    records = [to_record(scheme, row) for row in rows]
    wrong = []
    for i, text in enumerate(texts):
        f = Filter.parse(scheme, text)
        wanted = [rec.matches(f) for rec in records]
        found = [g[i] for g in got]
        if wanted != found:
            at = next(k for k in range(len(rows)) if wanted[k] != found[k])
            wrong.append((text, rows[at], wanted[at], found[at]))
    assert not wrong, wrong[:3]


def test_spark_fixtures(spark):
    """The one-record fixtures that have text values, as rows of a frame, through Spark."""
    marks = test_one_record.pytestmark[0].args[1]
    for text, values, wanted in marks:
        if any(isinstance(v, bytes) and name != "ip" for name, v in values.items()):
            continue
        row = {name: None for name in FIELDS} | {k: ipaddress.ip_address(v).packed if k == "ip" else v for k, v in values.items()}
        df = spark.createDataFrame([tuple(row.values())], SCHEME.to_struct_type())
        assert (S.bind(df, SCHEME).filter(text).count() == 1) is wanted, text


def test_binary_columns(spark):
    scheme = S.SchemeBuilder({"b": S.BYTES, "m": S.Array(S.BYTES)}).add_functions(S.standard_functions()).build()
    df = spark.createDataFrame([(b"\xaa\x22", [b"\xff", b"A"]), (b"Foo", [b"foo"]), (None, None)], "b binary, m array<binary>")
    frame = S.bind(df, scheme)
    count = lambda t: frame.filter(t).count()
    assert count(r'b == "\xaa\x22"') == 1 and count('b wildcard "f*"') == 1 and count('lower(b) == "foo"') == 1
    assert count(r'any(m[*] contains "\xff")') == 1 and count(r'b ~ "\xaa"') == 1 and count('b in {"Foo" aa:22}') == 2 and count('concat(b, "x") == "Foox"') == 1


def test_strict_binding(spark):
    scheme = S.SchemeBuilder({"n": S.INT}).build()
    df = spark.createDataFrame([(1,), (None,)], "n int")
    assert S.bind(df, scheme).filter("n == 1").count() == 1
    with pytest.raises(Exception, match="mandatory field n"):
        S.bind(df, scheme, strict=True).filter("n == 1").count()
    with pytest.raises(TypeMismatch):
        S.bind(spark.createDataFrame([("x",)], "n string"), scheme)
    other = S.SchemeBuilder({"n": S.INT}).build()
    with pytest.raises(SchemeMismatch):
        S.bind(df, scheme).filter(Filter.parse(other, "n == 1"))


def test_python_functions_and_custom_lowering(spark):
    rev = python_function([("both", S.BYTES)], S.BYTES, lambda b: None if not b else b[::-1])
    b = S.SchemeBuilder({"s": S.BYTES, "a": S.Array(S.BYTES)}).add_function("rev", rev)
    scheme = b.build()
    df = spark.createDataFrame([("abc", ["xy", "", "z"]), (None, None)], "s string, a array<string>")
    frame = S.bind(df, scheme)
    assert frame.filter('rev(s) == "cba"').count() == 1
    assert frame.filter('any(rev(a[*])[*] == "yx")').count() == 1
    assert [r.v for r in frame.select({"v": "rev(a[*])"}).collect()] == [["yx", "z"], None]

    class Loud(Lowering):
        def leaf(self, node, v):
            out = super().leaf(node, v)
            return ~out if node.op == "Equal" else out

    assert S.bind(df, scheme, lowering=Loud).filter('s == "abc"').count() == 0


def test_python_functions_hold_a_slice_of_a_batch_as_objects(spark):
    import sys

    blocks = python_function([("both", S.BYTES)], S.BYTES, lambda b: str(sys.getallocatedblocks()).encode())
    joined = python_function([("both", S.BYTES), ("both", S.BYTES)], S.BYTES, lambda b, s: None if s is None or len(b) == 3 else b + s)
    scheme = S.SchemeBuilder({"s": S.BYTES, "a": S.Array(S.BYTES)}).add_functions({"blocks": blocks, "joined": joined}).build()
    large = spark.range(8).coalesce(1).selectExpr("'s' as s", "transform(sequence(1, 50000), x -> concat('w', x)) as a")
    found = [int(x) for r in S.bind(large, scheme).select({"v": "blocks(a[*])"}).collect() for x in r.v]
    assert len(found) == 400_000 and max(found) - min(found) < 100_000
    rows = [(f"s{i}", [str(j) for j in range(i * 900)]) for i in range(12)] + [(None, ["1"]), ("x", None), ("y", []), ("z" * 3_000_000, ["1", "22", "333"])]
    frame = S.bind(spark.createDataFrame(rows, "s string, a array<string>").coalesce(1), scheme)
    out = frame.select({"each": "joined(a[*], s)", "one": "joined(s, s)"}).collect()
    assert [r.each for r in out] == [None if a is None else [x + s for x in a if s is not None and len(x) != 3] for s, a in rows]
    assert [r.one for r in out] == [None if s is None or len(s) == 3 else s + s for s, _ in rows]
