"""Near-duplicates, repeated passages and benchmark leaks against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import contaminated, cut, near_groups, repeated, weighted, words

from siftwright.llm import decontaminate, minhash, suffixes
from siftwright.llm import _words as W
from siftwright.llm._graph import components

DOCS = "doc_id long, text string, lang string, cluster long, `__sw_x` int, id int, low int, print int, block string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "en", 1, 2, 3, 4, 5, "b") for d, t in rows], DOCS).repartition(parts) if rows else spark.createDataFrame([], DOCS)


def prose(r, n, size=400):
    return [f"w{r.randrange(size)}" for _ in range(n)]


def edited(r, w, edits):
    w = list(w)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return w


def test_word_hashes():
    texts = ["Ab cD\tef", None, "", "  ab\x0bcd EF ", "é É ab", "x" * 5000 + " ab"]
    found = W.words(pa.array(texts))
    got = [found.first[i + 1] - found.first[i] for i in range(len(texts))]
    assert got == [len(words(t)) for t in texts]
    assert (found.hashes[:3] == found.hashes[3:6]).all() and found.hashes[0] == found.hashes[8] == found.hashes[-1]
    assert found.hashes[6] != found.hashes[7]  # only A-Z are lower-cased
    sliced = W.words(pa.array(texts).slice(3, 2))
    assert (sliced.hashes == found.hashes[3:9]).all()
    long = W.words(pa.array([" ".join(f"w{i % 7}" for i in range(900000))]))
    assert len(set(long.hashes.tolist())) == 7
    assert (W.runs(long.hashes, 3)[:7] == W.runs(long.hashes, 3)[7:14]).all()


def test_minhash_estimates():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 1 << 63, 100, dtype=np.uint64)])
    x, y = minhash.minhash(a), minhash.minhash(b)
    assert abs((x == y).mean() - 0.8) < 0.12
    assert int(np.bitwise_count(minhash.odd_sketch(x) ^ minhash.odd_sketch(y)).sum()) <= minhash.most_differing_bits(80)
    far = minhash.minhash(r.integers(0, 1 << 63, 900, dtype=np.uint64))
    assert int(np.bitwise_count(minhash.odd_sketch(x) ^ minhash.odd_sketch(far)).sum()) > minhash.most_differing_bits(80)


def hard_corpus(r):
    base = prose(r, 60)
    rows = [(100 + i, " ".join(edited(r, base, r.randrange(4)))) for i in range(70)]  # a large group, pairs on both sides of the limit
    chain = prose(r, 80)
    for i in range(12):  # each is near the one before, the ends are not near each other
        rows.append((300 + i, " ".join(chain)))
        chain = edited(r, chain, 1)
    rows += [(500 + i, "Same Text here  for all") for i in range(30)] + [(600 + i, " ".join(prose(r, r.randrange(1, 40)))) for i in range(40)]
    rows += [(700, None), (701, ""), (702, " \t\n"), (None, "Same text here for all"), (None, None), (704, "two words"), (705, "TWO words"), (706, "one"), (707, "words two")]
    rows += [(708, " ".join(prose(r, 30000, 9000)))] * 2 + [(709, rows[0][1].upper())]
    r.shuffle(rows)
    return rows


def test_near_duplicates_of_one_id(spark):
    """Rows that share an id but not a text belong each to its own text's group."""
    r = random.Random(8)
    a, b = prose(r, 40), prose(r, 40)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a) + " x"), (3, " ".join(b) + " y"), (4, " ".join(prose(r, 30)))]
    got = sorted((x.doc_id, x.component_id, x.kept) for x in minhash.near_duplicates(frame(spark, rows), 4).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
    assert sorted(x.text for x in minhash.one_of_each_group(frame(spark, rows), 4).collect()) == sorted([rows[0][1], rows[1][1], rows[4][1]])


@pytest.mark.parametrize(("k", "block"), [(4, 2048), (5, 16)])
def test_near_duplicates(spark, monkeypatch, k, block):
    for name in ("BLOCK_ROWS", "SKETCH_ROWS", "STAR_ROWS"):
        monkeypatch.setattr(minhash, name, block)
    rows = hard_corpus(random.Random(k))
    wanted = sorted(((d, *x) for (d, _), x in zip(rows, near_groups(rows, k, 80).values())), key=repr)
    got = sorted((tuple(x) for x in minhash.near_duplicates(frame(spark, rows), k, 80).collect()), key=repr)
    assert got == wanted
    kept = minhash.one_of_each_group(frame(spark, rows), k, 80)
    assert kept.columns == frame(spark, []).columns
    assert sorted((x.doc_id for x in kept.collect()), key=repr) == sorted((x[0] for x in wanted if x[3]), key=repr)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert minhash.near_duplicates(none).count() == 0 and minhash.one_of_each_group(none).count() == 0
    assert suffixes.repeated_passages(none).count() == 0 and suffixes.cut_repeats(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    some = frame(spark, [(1, "a b c"), (2, None)])
    assert [x.contaminated for x in decontaminate.contamination(some, bench).collect()] == [False, False]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, x) for x in range(1001, 1400)] + [(r.randrange(3000, 3300), r.randrange(3000, 3300)) for _ in range(150)] + [(5, 5), (7, 6)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}


def test_stars_take_no_round(spark):
    edges = [(1, 2), (1, 3), (7, 9), (3, 1)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), rounds=0).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}
    assert components(spark.createDataFrame([], "a long, b long"), rounds=0).collect() == []
    for edges in ([(1, 2), (2, 3)], [(1, 3), (2, 3)]):
        with pytest.raises(RuntimeError):
            components(spark.createDataFrame(edges, "a long, b long"), rounds=0)


@pytest.mark.parametrize(("seed", "alphabet"), [(0, 2), (1, 3), (2, 6), (3, 40)])
def test_repeated_passages(spark, seed, alphabet):
    r = random.Random(seed)
    shared = [prose(r, r.randrange(8, 30), alphabet) for _ in range(5)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(r.randrange(4)):
            w += r.choice(shared)[r.randrange(3) :] if r.random() < 0.6 else prose(r, r.randrange(20), alphabet)
        rows.append((d, "  ".join(w).upper() if d % 7 == 0 else " ".join(w)))
    rows += [(100, None), (101, ""), (102, rows[5][1]), (103, rows[5][1]), (104, "é " * 40)]
    wanted = repeated(rows, 8)
    docs = frame(spark, [*rows, (None, rows[5][1])], 4)
    got = {x.doc_id: x for x in suffixes.repeated_passages(docs, 8, 3).collect()}
    assert got.pop(None).repeated_words == 0
    assert {d: {i for s in x.spans for i in range(s.begin, s.end)} for d, x in got.items()} == wanted
    assert all(x.repeated_words == len(wanted[d]) and x.repeated == bool(wanted[d]) == bool(x.sources) for d, x in got.items())
    texts = {d: " ".join(words(t)) for d, t in rows}
    for d, x in got.items():  # the words of a span are all in the sources' texts
        spoken = set(" ".join(texts[s] for s in x.sources).split())
        assert all(set(words(dict(rows)[d])[s.begin : s.end]) <= spoken for s in x.spans) and all(s <= d for s in x.sources)
    left = {x.doc_id: x.text for x in suffixes.cut_repeats(docs, 8, 3).collect()}
    assert left == {d: t if not t else cut(t, wanted[d]) for d, t in rows} | {None: rows[5][1]}


def test_repeats_across_partition_edges(spark):
    """One passage in all documents, with the suffixes of few grams spread over many range partitions."""
    r = random.Random(9)
    common = prose(r, 70)
    rows = [(d, " ".join(prose(r, 15) + common + prose(r, 15))) for d in range(120)] + [(d, rows_text) for d, rows_text in ((200 + i, " ".join(common)) for i in range(60))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.doc_id: x.repeated_words for x in suffixes.repeated_passages(frame(spark, rows, 5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {d: len(x) for d, x in repeated(rows, 50).items()}


def test_same_id_other_text(spark):
    r = random.Random(4)
    w = prose(r, 60)
    rows = [(1, " ".join(w)), (1, " ".join(prose(r, 20) + w)), (2, "x"), (2, "x")]
    got = sorted(tuple(x) for x in suffixes.repeated_passages(frame(spark, rows)).select("doc_id", "repeated_words").collect())
    assert got == [(1, 0), (1, 60), (2, 0), (2, 0)]


def test_hamming_blocks_find_all_within_the_radius():
    r = np.random.default_rng(2)
    prints = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    index = decontaminate.Index(prints, np.arange(300), np.zeros(300, int))
    asked = []
    for i in range(300):
        x = int(prints[i])
        for b in r.choice(64, r.integers(0, decontaminate.RADIUS + 1), replace=False):
            x ^= 1 << int(b)
        asked.append(x)
    rows, found = index.near(np.array(asked, np.uint64))
    assert {(i, i) for i in range(300)} <= set(zip(rows.tolist(), found.tolist()))
    assert all(bin(asked[a] ^ int(prints[b])).count("1") <= decontaminate.RADIUS for a, b in zip(rows, found))


def test_simhashes_of_windows():
    h = W.words(pa.array([" ".join(prose(random.Random(1), 20000))])).hashes
    got = dict(decontaminate.simhashes(h, [8, 27]))
    for size in (8, 27):
        for i in (0, 5, 8190, 8192, 16383, len(h) - size):
            bits = np.unpackbits(h[i : i + size].view(np.uint8).reshape(-1, 8), axis=1).astype(int)
            wanted = np.packbits((2 * bits - 1).sum(axis=0) > 0).view(np.uint64)[0]
            assert got[size][i] == wanted
        assert len(got[size]) == len(h) - size + 1


def test_contamination(spark):
    r = random.Random(5)
    items = [(i, " ".join(prose(r, n, 3000))) for i, n in enumerate([3, 5, 7, 8, 9, 15, 18, 22, 30, 41, 59, 59, 100, 120])] + [(90, None), (91, ""), (None, "a b c d e f g h")]
    rows, d = [], 0
    for item_id, t in items:
        if item_id is None or not t:
            continue
        w = t.split()
        for v in (w, w[1:], w[:-1], edited(r, w, 1), w[: len(w) // 2] + ["new"] + w[len(w) // 2 :], edited(r, w, 3), w[: len(w) // 2]):
            rows.append((d, " ".join(prose(r, r.randrange(30), 3000) + v + prose(r, r.randrange(30), 3000))))
            d += 1
    rows += [(900, items[9][1] + " " + items[10][1]), (901, None), (902, ""), (903, items[0][1]), (904, " ".join(prose(r, 30000, 3000)) + " " + items[8][1].upper()), (None, items[6][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    wanted = {i: contaminated(t, [x for x in items if x[0] is not None and x[1]], 5, 80) for i, (_, t) in enumerate(rows) if _ != 904} | {next(i for i, x in enumerate(rows) if x[0] == 904): [8]}
    got = {x.doc_id: x for x in decontaminate.contamination(frame(spark, rows), bench).collect()}
    missed = [(rows[i], w, got[rows[i][0]].item_ids) for i, w in wanted.items() if got[rows[i][0]].item_ids != w]
    assert not missed, missed[:2]
    assert sum(bool(w) for w in wanted.values()) > 40
    parts = decontaminate.with_matches(frame(spark, [*rows, rows[0]]), bench.union(bench.limit(2)), part_bytes=300, held_bytes=1000).collect()
    assert {x.doc_id: x[decontaminate.IDS] for x in parts} == {k: x.item_ids for k, x in got.items()}
    assert weighted("a a a b".split(), "a a a b".split(), 5) == 1


@pytest.mark.parametrize("n", [30, 120, 480])
def test_recall_near_the_limit(spark, n):
    """Word edits spread over an item until its similarity is just at or above the limit."""
    r, items, rows = random.Random(n), [], []
    for i in range(60):
        w = prose(r, n, 5000)
        items.append((i, " ".join(w)))
        v = list(w)
        while True:
            nearer = list(v)
            nearer[r.randrange(n)] = f"e{r.randrange(10**6)}"
            if 100 * weighted(nearer, w, 5) < 80:
                break
            v = nearer
        rows.append((i, " ".join(prose(r, 9, 5000) + v + prose(r, 9, 5000))))
    got = {x.doc_id: x.item_ids for x in decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert np.mean([d in got[d] for d, _ in rows]) >= 0.9


def test_contamination_wherever_the_edits_are(spark):
    """Both end words changed, two or three edits spread over the item, halves swapped, words repeated: as brute force has it."""
    r, items, rows = random.Random(9), [], []
    for n in [9, 12, 14, 17, 20, 24, 31, 40, 47, 60, 75, 97] * 6:
        w = prose(r, n, 4 if len(items) % 6 == 5 else 3000)
        items.append((len(items), " ".join(w)))
        far = lambda i: f"e{r.randrange(10**6)}" if i in (n // 4, n // 2, 3 * n // 4) else w[i]
        for v in (
            [f"({w[0]}", *w[1:-1], f"{w[-1]}.)"],
            [f"({w[0]}", *(x if i != n // 2 else "other" for i, x in enumerate(w[1:-1], 1)), f"{w[-1]}.)"],
            [far(i) for i in range(n)],
            edited(r, w, 2),
            edited(r, w, 3),
            w[n // 2 :] + w[: n // 2],
            w[: n // 2] + ["new"] + w[n // 2 :],
            w[n // 5 :],
        ):
            rows.append((len(rows), " ".join(prose(r, r.randrange(6), 3000) + v + prose(r, r.randrange(6), 3000))))
    wanted = {d: contaminated(t, items[d // 8 : d // 8 + 1], 5, 80) for d, t in rows}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x.item_ids for x in decontaminate.contamination(frame(spark, rows), bench).collect()}
    assert sum(bool(w) for w in wanted.values()) > 100
    missed = [d for d, w in wanted.items() if not set(w) <= set(got[d])]
    assert not missed, (len(missed), [rows[d] for d in missed[:2]])
    others = {d: set(x) - set(wanted[d]) for d, x in got.items()}
    assert all(contaminated(rows[d][1], [items[i]], 5, 80) == [i] for d, more in others.items() for i in more)


def test_words_of_large_batches_take_little_memory():
    import tracemalloc

    from siftwright.llm._common import slices

    texts = pa.array([" ".join(f"w{i * j % 9973}" for j in range(400_000)) for i in (1, 2)] + ["w1 W2  w3"] * 1_000_000)
    W._powers.clear()
    tracemalloc.start()
    rows = texts.slice(2)
    n = sum(len(W.words(rows.slice(at, to - at)).hashes) for at, to in slices(rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 3_000_000 and peak < 32 << 20
    # A text of several segments has the hashes of its words.
    found = W.words(texts.slice(0, 1)).hashes
    alone = W.words(pa.array([f"w{i}" for i in range(9973)])).hashes
    assert np.array_equal(found, alone[np.arange(400_000) % 9973])
