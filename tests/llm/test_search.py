"""URL rules, top-k search, chats and archives against brute force and round trips."""

import hashlib
import io
import random

import numpy as np
import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from siftwright.llm import chat, queries, topk, url_filter, warc

# ---- url rules


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:n], rest[n:]
    m = next((i for i, c in enumerate(rest) if c in "?#"), len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:m]


def judge(url, rules, default="allow"):
    host, path = split_url(url)
    fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


@pytest.mark.parametrize("seed", range(3))
def test_url_rules(spark, seed):
    r = random.Random(seed)
    name = lambda: ".".join(r.choice(["a", "b", "net", "org", "x-y", "é"]) for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "/".join(r.choice(["en", "e", "de", "", "é~"]) for _ in range(r.randint(0, 3)))
    pairs = [(name(), path() if r.random() < 0.9 else "", r.choice(["allow", "block"])) for _ in range(60)]
    rules = {}
    for h, p, v in pairs:
        rules[h, p] = max(v, rules.get((h, p), ""))
    urls = [f"{r.choice(['http', 'HTTPS'])}://{name().upper() if r.random() < 0.2 else name()}{path() if r.random() < 0.9 else ''}{r.choice(['', '?q=/x', '#/y', '?a#b'])}" for _ in range(400)]
    urls += ["http://hot.a.b.net/en/"] * 200 + [None, "", "nothing", "://", "http://", "http://?x", "http:///en/", "x://a://b.net/en", "http://a..net/", "http://.net/en", "http://NET:80/", "http://u@net/"]
    rows = [(i if i % 9 else i // 2, u, "k", 3) for i, u in enumerate(urls)] + [(None, "http://a.net/en/", "k", 1)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, key string, part int").repartition(4)
    extra = [(None, "/", "block"), ("a", None, "block"), ("", "/", "block"), ("a/b", "/", "block")]
    got = sorted((tuple(x) for x in url_filter.apply_rules(df, spark.createDataFrame(pairs + extra, "host string, path string, verdict string")).collect()), key=repr)
    wanted = sorted(((i, *judge(u, rules)) for i, u, *_ in rows), key=repr)
    assert got == wanted
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.apply_rules(df, none, default="block").where("verdict = 'block' and rule is null").count() == len(rows)
    assert url_filter.apply_rules(df.limit(0), none).count() == 0


# ---- top k


def test_bit_slices():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 1 << 12, 130), r.integers(0, 1 << 7, 130)
    pack = lambda v, n: np.stack([np.packbits(np.pad((v >> j) & 1, (0, 62)).astype(np.uint8), bitorder="little").view(np.uint64) for j in range(n)])
    out = topk.add(pack(b, 7), pack(a, 12))
    bits = np.unpackbits(out.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(np.int64)
    assert ((bits * (1 << np.arange(13))[:, None]).sum(axis=0) == a + b).all()
    for dims in (0, 1, 5):
        values = r.integers(-300, 300, (100, dims))
        index = topk.BitSlicedIndex(values)
        for _ in range(5):
            q = r.integers(-300, 300, dims)
            order = np.lexsort((np.arange(100), -(values @ q)))
            assert set(index.top(q, 7, index.all)) == set(order[:7])


@pytest.mark.parametrize("block", [65536, 40])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "ROW_BLOCK", block)
    r = np.random.default_rng(block)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 6)]) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 0.0, 0.1, 0.3]) for i in range(90)]  # ties
    rows += [(2000, None), (2050, [None] * 6), (2100, [float("nan")] + [0.0] * 5), (2101, [float("inf")] * 6), (2150, [1.0, 2.0]), (2151, [3.0, -1.0]), (None, [1.0] * 6), (2200, []), (2201, []), (100, rows[100][1]), (7, rows[7][1]), (2250, [1000.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, label int, qb int, uid int").repartition(3)
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    fine = [(i, np.floor(np.array(v) * 256).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wanted = []
    for q, v in {(i, tuple(v)): (i, v) for i, v in fine if i % 50 == 0}.values():
        best = sorted((-int(v @ w), i) for i, w in fine if i != q and len(w) == len(v))[:5]
        wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(wanted)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    halves = df.selectExpr("vec_id", "cast(embedding as array<float>) as embedding")
    wide = halves.selectExpr("vec_id", "cast(embedding as array<double>) as embedding")
    assert sorted(map(tuple, topk.top_k(halves, F.col("vec_id") % 50 == 0).collect())) == sorted(map(tuple, topk.top_k(wide, F.col("vec_id") % 50 == 0).collect()))


# ---- chats


def test_chats(spark):
    r = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>assistant", "<|im_sep|>", "\n", "~", "~0", "~1", "~2", "<|", "<", "|", "é", "ok", "|>", "", "<~1"]
    text = lambda: None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randrange(8)))
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "a\nb~<|x", ""]), text()) for c in [*range(40), None] for t in r.sample(range(-3, 30), r.randrange(1, 12))]
    rows += [(500, 1, "user", "b"), (500, 1, "user", "a"), (500, 1, "assistant", "z"), (500, None, "assistant", "first"), (500, 1, "user", "a"), (501, 0, None, None), (502, 0, "assistant", "x" * 300000)]
    df = spark.createDataFrame([(*x, "t", 1) for x in rows], "conv_id long, turn long, role string, text string, turns string, formatted int").repartition(5)
    chats = chat.format_chats(df)
    got = {x.conv_id: x for x in chat.read(chats).collect()}
    none_first = lambda v: (v is not None, v if v is not None else 0)
    for c in {x[0] for x in rows}:
        mine = sorted(((none_first(t), role or "", said or "") for k, t, role, said in rows if k == c))
        assert [(t.role, t.text, t.loss) for t in got[c].turns] == [(role, said, role == "assistant") for _, role, said in mine]
        groups = sum(1 for i, x in enumerate(mine) if not i or mine[i - 1][1] != x[1])
        assert got[c].formatted.count("<|im_end|>\n") == got[c].formatted.count("<|im_start|>") == groups
    digest = {x.conv_id: x for x in chat.digests(chats).collect()}
    loss = "".join(t.text for t in got[500].turns if t.loss)
    assert digest[500].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digest[500].loss_chars == len(loss) and digest[500].n_turns == 5
    assert digest[502].formatted_chars == len(got[502].formatted)
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0
    assert "Python" not in chat.digests(chats)._jdf.queryExecution().executedPlan().toString()


def test_marked_conversation(spark, tmp_path):
    """The conversation -1 is there without any input, and takes up an input's conversation of its number."""
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    marked = "user\n<|im_end|><|im_start|>assistant ok\nassistant\n<|im_end|><|im_start|>assistant ok\n"
    for i, rows in enumerate((none, none.union(spark.sql("select -1L, 7L, 'user', 'more'")))):
        rows.write.parquet(str(tmp_path / str(i) / "conversations.parquet"))
        got = queries.op9_chat(spark, str(tmp_path / str(i))).collect()
        assert [(r.conv_id, r.n_turns, r.turns_sha256) for r in got] == [(-1, 2 + i, hashlib.sha256((marked + "user\nmore\n" * i).encode()).hexdigest())]


def test_very_long_urls(spark):
    long = "http://a." + "b." * 20000 + "net/en/" + "x/" * 100000
    df = spark.createDataFrame([(1, long), (2, "http://net/" + "y" * 300000)], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/en/", "block")], "host string, path string, verdict string")
    assert {r.page_id: r.verdict for r in url_filter.apply_rules(df, rules).collect()} == {1: "block", 2: "allow"}


# ---- archives


def test_archives(spark):
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abc é\r\n:<>") for _ in range(n))
    big, edge = text(400), "é" * 50
    pages = [(i, f"http://x/{i}?é \r\n", text(r.randrange(600))) for i in range(200)] + [(300 + i, None, big) for i in range(40)] + [(400 + i, "u", "small") for i in range(3)]
    pages += [(500, "u", edge), (499, "u", edge), (501, "u", "x" * 99), (502, "u", "x" * 99), (503, None, None), (504, "", ""), (None, "u", big), (None, None, None), (300, "again", big), (505, "u", "WARC/1.1\r\n\r\n" * 20), (506, "u", text(50000)), (507, "u", text(100) * 30000)] + [(n, "u", "y" * 3000) for n in (None, None)]
    df = spark.createDataFrame([(*x, "d", 1) for x in pages], "page_id long, url string, html string, digest string, first int").repartition(4)
    bundles = warc.write_archives(df, frame_bytes=2000, bundle_bytes=3000)
    got = sorted((tuple(x) for x in warc.read_archives(bundles, payloads=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()), key=repr)
    wanted = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        same = [i for i, _, h in pages if (h or "").encode() == data and i is not None] if len(data) >= 100 else []
        again = bool(same) and page_id != min(same) and sum((h or "").encode() == data for _, _, h in pages) > 1
        wanted.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None, None if again else bytearray(data)))
    assert got == sorted(wanted, key=repr)
    paths = [(x.path, x.records) for x in bundles.collect()]
    assert len(paths) > 3
    system, place = fs.FileSystem.from_uri(paths[0][0])
    with system.open_input_file(place) as f:
        raw = f.read()
        reader = warc.Reader(f)
        name, frame, offset, size = reader.index[-1]
        assert reader.get(name) == reader.at(frame, offset, size) and reader.get(name).startswith(b"WARC/1.1\r\n")
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert whole == b"".join(reader.records()) and len(reader.index) == paths[0][1]
        assert len(reader.frames) > 1
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        warc.parse(warc.build(1, "u", b"abc", 3, "00", None, "response"))
