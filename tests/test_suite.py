"""The query suite against DuckDB, plans, JSON records, lists, streams, and the flat interface."""

import ipaddress
import json

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import siftwright as S
from siftwright import suite
from siftwright.sources.addresses import ip_from_text
from siftwright.errors import TypeMismatch
from siftwright.sources.records import Record, read_records, records_frame, write_records
from siftwright.sources.values import guess
from siftwright.streaming import filter_batches, route

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(suite.queries()))
def test_query(spark, duck, name):
    df = suite.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    found = duck.execute(suite.oracles()[name])
    names = [x[0] for x in found.description]
    wanted = sorted(repr([r[names.index(c)] for c in columns]) for r in found.fetchall())
    assert sorted(names) == columns
    assert got == wanted


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "pushed"),
    [("eq_bytes", "EqualTo(l_returnflag,N)"), ("in_int_ranges", "GreaterThanOrEqual(l_partkey,100)"), ("in_bytes", "In(event_type, [click,error])"), ("contains", "StringContains(text,the)"), ("ge_le_int", "LessThanOrEqual(l_suppkey,20)")],
)
def test_filters_reach_the_scan(spark, name, pushed):
    text = plan(suite.queries()[name](spark, SF))
    assert pushed in text and "Python" not in text and "Exchange" not in text


def test_only_needed_columns_are_read(spark):
    schema = plan(suite.queries()["wildcard_ci"](spark, SF)).split("ReadSchema:")[1].splitlines()[0]
    assert "p_name" in schema and "p_type" not in schema


def test_list_joins(spark):
    assert "LeftSemi" in plan(suite.queries()["list_semi_and"](spark, SF))
    assert "LeftOuter" in plan(suite.queries()["list_under_or"](spark, SF))
    big = spark.range(1000).select(F.lit("big").alias("name"), F.col("id").alias("value"))
    scheme = S.SchemeBuilder({"n": S.INT, "a": S.Array(S.INT)}).add_list(S.INT, S.TableList(big)).build()
    frame = S.bind(spark.createDataFrame([(3, [1]), (None, None), (999999, [])], "n bigint, a array<bigint>"), scheme)
    assert frame.filter("n in $big").count() == 1 and frame.filter("not n in $big").count() == 2
    assert [r.x for r in frame.annotate({"x": "n in $big", "y": "n == 3"}).orderBy("n").collect()] == [False, True, False]
    assert frame.filter("any(a[*] in $big)").count() == 1 and frame.filter("all(a[*] in $big)").count() == 3
    with pytest.raises(ValueError, match="joined"):
        frame.column("n in $big")


def test_addresses(spark):
    texts = ["1.2.3.4", "255.255.255.255", "::", "::1", "1::", "2001:db8::ff00:42:8329", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "1.2.3", "256.1.1.1", "1:2", "1::2::3", "12345::", "x", "", None, "1:2:3:4:5:6:7::8", "01.2.3.4"]

    def packed(t):
        try:
            return ipaddress.ip_address(t).packed
        except ValueError:
            return None

    got = [r[0] and bytes(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ip_from_text(F.col("t"))).collect()]
    assert got == [packed(t) if t is not None else None for t in texts]


def test_json_frames(spark):
    scheme = S.SchemeBuilder({"b": S.BOOL, "i": S.INT, "s": S.BYTES, "ip": S.IP, "a": S.Array(S.BYTES), "m": S.Map(S.INT), "x.y": S.INT}).build()
    rows = ['{"b": true, "i": -9223372036854775808, "s": "a", "ip": "::1", "a": ["x", "y"], "m": {"k": 1}, "x.y": 5}', '{"s": [97, 255], "i": 1}', "{}"]
    frame = read_records(spark.createDataFrame([(t,) for t in rows], "value string"), scheme)
    got = frame.collect()
    assert got[0]["i"] == -(1 << 63) and bytes(got[0]["ip"]) == bytes(15) + b"\1" and got[0]["m"] == {"k": 1} and got[0]["x.y"] == 5 and got[2]["b"] is None
    bound = S.bind(frame, scheme)
    assert bound.filter(r's == "a\xff"').count() == 1 and bound.filter("x.y == 5").count() == 1
    out = [json.loads(r.record) for r in write_records(bound).collect()]
    assert out[0]["a"] == ["x", "y"] and out[1] == {"i": 1, "s": [97, 255]} and out[2] == {}
    with pytest.raises(Exception, match="unknown field: zz"):
        read_records(spark.createDataFrame([('{"zz": 1}',)], "value string"), scheme).collect()
    assert guess("127.0.0.1")[1] == S.IP and guess("1337") == (b"1337", S.BYTES) and guess(True)[1] == S.BOOL and guess(5)[1] == S.INT


def test_streams(spark, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events*.parquet")
    b = suite.BINDINGS["ev"]
    columns = {k.rstrip("?"): v for k, (_, v) in b.fields.items()}
    frame = S.bind(stream, suite.scheme_of("ev"), columns)
    query = frame.filter('ev.type == "click" and ev.ip in {10.0.0.0/28}').writeStream.format("memory").queryName("clicks").start()
    query.processAllAvailable()
    query.stop()
    wanted = suite.bound(spark, SF, "ev").filter('ev.type == "click" and ev.ip in {10.0.0.0/28}').count()
    assert spark.table("clicks").count() == wanted > 0
    seen = []
    query = filter_batches(stream, lambda: suite.scheme_of("ev", lists=suite._vip(spark, SF)), "ev.user in $vip", lambda df, n: seen.append(df.count()), str(tmp_path), columns, available_now="1")
    query.awaitTermination()
    assert sum(seen) == suite.run_filter(spark, SF, "list_semi").count()
    routed = route(suite.bound(spark, SF, "ev"), {"c": 'ev.type == "click"', "low": "ev.user < 5"})
    assert routed.where("array_contains(routes, 'c')").count() == routed.where("event_type = 'click'").count()


def test_command_line(capsys):
    from siftwright.__main__ import main

    assert main(['any(str_arr[*] == "x")']) == 0 and "MapEach" in capsys.readouterr().out
    assert main(["nope"]) == 1 and "unknown identifier" in capsys.readouterr().err


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_json_of_odd_values(spark):
    """Pair lists, byte arrays and addresses at any depth, canonical IPv6 texts, errors on wrong types, and the round trip."""
    scheme = S.SchemeBuilder({"a": S.Array(S.BYTES), "m": S.Map(S.Array(S.IP)), "n": S.Map(S.INT), "g": S.Array(S.Array(S.INT)), "i": S.INT, "b": S.BOOL, "ip": S.IP}).build()
    ips = ["::", "::1", "1::", "2001:db8::1", "2001:db8:0:1:1:1:1:1", "1:0:0:2::3", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "fe80::1:0:0:1", "9.0.0.200", "0:1::"]
    rows = [{"a": ["ok", [255, 254], []], "m": {"k": ips}, "n": [["x", 1], [[254], -2]], "g": [[1], [], [2, 3]]}, {"i": -5, "b": False, "ip": "1.2.3.4", "a": [], "m": {}, "n": []}, {}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    back = read_records(df, scheme)
    first = back.first()
    assert bytes(back.limit(1).selectExpr("cast(a[1] as binary)").first()[0]) == b"\xff\xfe"
    assert first["g"] == [[1], [], [2, 3]] and [bytes(x) for x in first["m"]["k"]] == [ipaddress.ip_address(x).packed for x in ips]
    out = [json.loads(r.record) for r in write_records(S.bind(back, scheme)).collect()]
    assert out[0] == {**rows[0], "a": ["ok", [255, 254], ""]} and out[1] == {**rows[1], "n": {}} and out[2] == {}
    again = read_records(write_records(S.bind(back, scheme)), scheme, "record")
    assert write_records(S.bind(again, scheme)).collect() == write_records(S.bind(back, scheme)).collect()
    for bad in ('{"i": "5"}', '{"i": 1.5}', '{"i": 9223372036854775808}', '{"b": 1}', '{"a": [5]}', '{"a": "x"}', '{"a": [[256]]}', '{"ip": "1.2.3"}', '{"n": [["x"]]}', '{"n": {"x": null}}', '{"i": null}', '{"g": [[true]]}'):
        with pytest.raises(TypeMismatch):
            Record(scheme).load_json(bad)
        with pytest.raises(Exception, match="expected value of type"):
            read_records(spark.createDataFrame([(bad,)], "value string"), scheme).collect()


def test_lists_of_addresses_and_bytes(spark):
    kinds = {S.IP: S.SetList({"x": ["10.0.0.7", b"\xc0\xa8\1\1"]}), S.BYTES: S.SetList({"x": [b"\xff", "a"]})}
    scheme = S.SchemeBuilder({"ip": S.IP, "s": S.BYTES})
    for kind, definition in kinds.items():
        scheme.add_list(kind, definition)
    scheme = scheme.build()
    form = Record(scheme).to_json()
    other = Record(scheme)
    kinds[S.IP].clear()
    kinds[S.BYTES].clear()
    assert other.load_json(json.loads(json.dumps(form))).to_json() == form and kinds[S.IP].match("x", b"\xc0\xa8\1\1") and kinds[S.BYTES].match("x", b"\xff") and not kinds[S.BYTES].match("x", b"b")
    df = spark.createDataFrame([("192.168.1.1", b"\xff"), ("10.0.0.8", b"a"), (None, None)], "ip string, s binary")
    frame = S.bind(df, scheme)
    assert frame.filter("ip in $x").count() == 1 and frame.filter("s in $x").count() == 2 and S.bind(df.selectExpr("ip", "cast(s as string) as s"), scheme).filter("s in $x").count() == 2
    texts = spark.createDataFrame([("y", "10.0.0.8"), ("y", "::1"), ("bad", "nowhere")], "name string, value string")
    tables = S.SchemeBuilder({"ip": S.IP, "s": S.BYTES}).add_list(S.IP, S.TableList(texts)).add_list(S.BYTES, S.TableList(spark.createDataFrame([("y", b"\xff")], "name string, value binary"))).build()
    assert S.bind(df, tables).filter("ip in $y").count() == 1 and S.bind(df, tables).filter("s in $y or ip in $y").count() == 2
    assert tables.lists[S.IP].match("y", b"\n\0\0\x08") and not tables.lists[S.IP].match("y", b"\n\0\0\x09")
    with pytest.raises(Exception, match="not an address"):
        S.bind(df, tables).filter("ip in $bad").collect()


def test_helper_columns_do_not_clash(spark):
    df = spark.createDataFrame([(i % 3 or None, [i], i) for i in range(9)], "n bigint, __in_0 array<bigint>, __value_0 int").withColumn("value", F.lit(1)).withColumn("name", F.lit("x"))
    numbers = S.TableList(spark.range(5).select(F.lit("x").alias("name"), F.col("id").alias("value")))
    frame = S.bind(df, S.SchemeBuilder({"n": S.INT, "a": S.Array(S.INT)}).add_list(S.INT, numbers).build(), {"a": "__in_0"})
    got = frame.annotate({"f": "n in $x or any(a[*] in $x)", "g": "not n in $x"})
    assert got.columns == [*df.columns, "f", "g"] and got.where("f").count() == 8 and got.where("g").count() == 3
    assert frame.filter("n in $x and all(a[*] in $x)").columns == df.columns and frame.select({"v": "n"}, "value").columns == ["value", "v"]


def test_records_as_frames(spark):
    scheme = S.SchemeBuilder({"s": S.BYTES, "m": S.Map(S.Array(S.INT)), "ip": S.IP}).build()
    records = [Record(scheme) for _ in range(2)]
    records[0].set("s", b"\xff")
    records[0].set("m", {"k": [1, 2]})
    records[1].set("ip", "::1")
    frame = S.bind(records_frame(spark, scheme, records), scheme)
    assert frame.filter(r's == "\xff" and m["k"][1] == 2').count() == 1 and frame.filter("ip == ::1").count() == 1
