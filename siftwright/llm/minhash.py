"""Near-duplicate documents: MinHash bands propose, odd sketches sift, full shingle sets decide.

Documents whose sets of distinct ``k``-word shingles have a Jaccard similarity of at least ``percent`` / 100 are linked;
a group is a connected component of links.

1. One pass makes each document's set size, a 128-bit print of its set, K = BANDS * ROWS MinHash samples folded into BANDS
   band keys, and its odd sketch, the parity of the samples' places in a map of SKETCH_BITS bits. Documents with equal sets are
   one class, represented by one row; a class of any size takes part once.
2. Classes that share a band key meet in blocks of that key's bucket, with their sketches only. XORed sketches bound the
   similarity of a pair; each class is proposed the smallest one that it may be similar to, and these proposals, one for a
   class at most, are decided on the full sets. Nearly all links of a group of near copies come from here, at a cost in
   proportion to its size.
3. Buckets that hold several components yet are gone through completely: all pairs of different components are held against
   each other by their sketches, those of one component never. Texts of what may still be similar are then compared exactly, block by
   block, again between different components only; a spanning forest of links leaves each block.
4. Components of all links are the groups.

A pair at 0.8 shares none of 40 bands of 5 rows with probability 1.3e-7, and sketches of such a pair differ in more bits than
:func:`most_differing_bits` for one in a few million. Texts move once for a class that was proposed a partner, and again only
for those that step 3 leaves open.

Defined results: null, empty or wordless texts have an empty set and are linked with nothing. A text with fewer words than
``k`` has its whole sequence as its one shingle. Rows with a null doc_id are linked with nothing, have no component and are
kept. Each row gets a result row. Links hold between texts: rows that share a doc_id but not a text belong each to its own
text's group. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_map, dropped, marked, named, sifted, slices, sorted_groups, written
from ._graph import components
from ._words import U, mix, shingles, signed, words

BANDS, ROWS, SKETCH_BITS = 40, 5, 1024
#: A block of sketches has about so many rows at most, a star of proposals so many, and a block of texts so many and so many bytes.
SKETCH_ROWS, STAR_ROWS, BLOCK_ROWS, BLOCK_BYTES = 1024, 128, 512, 16 << 20
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32) | np.uint32(1)
_CHUNK = 2048


def minhash(x: np.ndarray) -> np.ndarray:
    """The least of each of K hashes over a non-empty set."""
    low, high = x.astype(np.uint32), (x >> U(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _CHUNK):
        h = _A[0][:, None] * low[None, at : at + _CHUNK]
        h += _A[1][:, None] * high[None, at : at + _CHUNK]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    rows = sample.reshape(BANDS, ROWS).astype(U)
    key = np.arange(BANDS, dtype=U) + U(1)
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + rows[:, r])
    return key


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parities of the samples' places in a map of SKETCH_BITS bits, as 64-bit words."""
    at = mix((np.arange(len(sample), dtype=U) << U(32)) | sample.astype(U)) % U(SKETCH_BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(U)


def most_differing_bits(percent: int) -> int:
    """Odd sketches of a pair at the limit differ in no more bits, but for one pair in a few million (5 deviations)."""
    k, j = BANDS * ROWS, percent / 100
    differing = min(2 * k, 2 * (k * (1 - j) + 5 * math.sqrt(k * j * (1 - j))))
    expected = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing)
    return math.ceil(expected + 5 * math.sqrt(expected * 0.25))


def _signatures(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to in slices(batch.column("text")):
            found = words(batch.column("text").slice(at, to - at))
            sizes, prints, keys, sketches = [], [[], []], [], []
            lengths = pc.fill_null(pc.binary_length(batch.column("text").slice(at, to - at)), 0).cast(pa.int64())
            for d in range(to - at):
                x = shingles(found.hashes[found.first[d] : found.first[d + 1]], k)
                sizes.append(len(x))
                prints[0].append(int(signed(mix(x + U(11)).sum(keepdims=True, dtype=U))[0]))
                prints[1].append(int(signed(mix(x ^ U(0x5851F42D4C957F2D)).sum(keepdims=True, dtype=U))[0]))
                sample = minhash(x) if len(x) else None
                keys.append(None if sample is None else signed(band_keys(sample)))
                sketches.append(None if sample is None else odd_sketch(sample).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, to - at), batch.column("print").slice(at, to - at), pa.array(sizes, pa.int64()), pa.array(prints[0], pa.int64()), pa.array(prints[1], pa.int64()), lengths, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "print", "n_shingles", "p1", "p2", "n_bytes", "bands", "sketch"],
            )


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of distinct values reach the limit."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _sketched(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, set sizes and sketches of rows."""
    return rows.column("id").to_numpy(), rows.column("n_shingles").to_numpy(), np.frombuffer(b"".join(rows.column("sketch").to_pylist()), U).reshape(rows.num_rows, -1)


def _alike(i: int, size: np.ndarray, sketch: np.ndarray, open_: np.ndarray, percent: int, limit: int) -> np.ndarray:
    """Those of the ``open_`` rows that may be similar to row i."""
    near = np.flatnonzero(open_ & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
    return near[np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1) <= limit]


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _proposed(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of buckets to pairs ``a < b`` whose sketches are alike, which connect all that are in a part."""
    limit = most_differing_bits(percent)
    for _, rows in sorted_groups(batches, ["key", "part"]):
        ids, size, sketch = _sketched(rows.sort_by("id"))
        group, out, after = np.arange(len(ids)), [], np.arange(len(ids))
        for i in range(len(ids)):
            for j in _alike(i, size, sketch, (group != group[i]) & (after > i), percent, limit):
                out.append((ids[i], ids[j]))
                group[group == group[j]] = group[i]
        out = [(a, b) for a, b in out if a != b]
        if out:
            yield _pairs(*map(list, zip(*out)))


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    texts = texts.combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    out: list[np.ndarray] = []
    for at, to in slices(texts):
        found = words(texts.slice(at, to - at))
        out += [shingles(found.hashes[found.first[d] : found.first[d + 1]], k) for d in range(to - at)]
    return out


def _verified(k: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of proposals to those of their pairs that are linked."""
    for (a, _), rows in sorted_groups(batches, ["a", "part"]):
        ids, sets = rows.column("id").to_pylist(), _sets(rows.column("text"), k)
        centre = sets[ids.index(a)]
        linked = sorted({b for b, x in zip(ids, sets) if b != a and similar(centre, x, percent)})
        if linked:
            yield _pairs([a] * len(linked), linked)


def _open(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of buckets to what is alike in different components: links of components (``involved`` false) and the
    rows and components involved."""
    limit = most_differing_bits(percent)
    for (_, i, j), rows in sorted_groups(batches, ["grp", "i", "j"]):
        ids, size, sketch = _sketched(rows)
        comp, block = rows.column("comp").to_numpy(), rows.column("block").to_numpy()
        group, links, involved = comp.copy(), [], np.zeros(len(ids), bool)
        after = np.arange(len(ids))
        for r in range(len(ids)):
            hits = _alike(r, size, sketch, (comp != comp[r]) & (after > r) & ((block != block[r]) | (i == j)), percent, limit)
            if len(hits):
                involved[hits] = involved[r] = True
                for h in hits[group[hits] != group[r]]:
                    if group[h] != group[r]:
                        links.append((comp[r], comp[h]))
                        group[group == group[h]] = group[r]
        if links:
            a, b = [x for x, _ in links] + ids[involved].tolist(), [y for _, y in links] + comp[involved].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([False] * len(links) + [True] * int(involved.sum()))], ["a", "b", "involved"])


def forest(comp: np.ndarray, sets: list[np.ndarray], block: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """Links of components that the pairs at the limit connect; ``cross``: pairs of different blocks only."""
    n, limit = len(comp), most_differing_bits(percent)
    size = np.array([len(x) for x in sets])
    sketch = np.stack([odd_sketch(minhash(x)) for x in sets]) if n else np.zeros((0, SKETCH_BITS // 64), U)
    group, out = comp.copy(), []
    for i in np.argsort(size, kind="stable"):
        open_ = group != group[i]
        if cross:
            open_ &= block != block[i]
        for j in _alike(i, size, sketch, open_, percent, limit):
            if group[i] != group[j] and similar(sets[i], sets[j], percent):
                out.append((int(comp[i]), int(comp[j])))
                group[group == group[j]] = group[i]
    return out


def _forests(k: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, i, j), rows in sorted_groups(batches, ["grp", "i", "j"]):
        links = forest(rows.column("comp").to_numpy(), _sets(rows.column("text"), k), rows.column("block").to_numpy(), i != j, percent)
        if links:
            yield _pairs(*map(list, zip(*links)))


def _in_blocks(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """``rows`` (grp, comp, id, n_bytes) in all pairs of blocks ``i <= j`` of their group in which different components meet.

    A component of half a block or more has blocks of its own, and no pairs among these; the others share blocks.
    """
    need = lambda n, size: F.greatest(F.ceil(n / most_rows), F.ceil(size / most_bytes), F.lit(1)).cast("int")
    sizes = rows.groupBy("grp", "comp").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"))
    sizes = sizes.withColumn("own", (F.col("n") * 2 >= most_rows) | (F.col("size") * 2 >= most_bytes))
    own = sizes.where("own").select("grp", "comp", need(F.col("n"), F.col("size")).alias("blocks"))
    own = own.withColumn("first", F.sum("blocks").over(Window.partitionBy("grp").orderBy("comp")).cast("int") - F.col("blocks"))
    own = own.select(F.col("grp").alias("og"), F.col("comp").alias("oc"), "first", "blocks")
    some = lambda c: F.sum(F.when(~F.col("own"), F.col(c)).otherwise(0))
    shared = sizes.groupBy("grp").agg(some("n").alias("n"), some("size").alias("size"), F.sum(F.when(F.col("own"), need(F.col("n"), F.col("size"))).otherwise(0)).cast("int").alias("rest"), F.count("*").alias("comps"))
    # By another key than the one they are grouped by, so that Spark can split groups of very many rows.
    shared = shared.where("comps > 1").select(F.bitwise_not("grp").alias("sg"), F.when(F.col("n") > 0, need(F.col("n"), F.col("size"))).otherwise(0).alias("pool"), "rest")
    dealt = rows.join(shared, F.bitwise_not("grp") == F.col("sg")).join(own, (F.bitwise_not(F.bitwise_not("grp")) == F.col("og")) & (F.col("comp") == F.col("oc")), "left")
    low, mine = F.col("pool") + F.col("first"), F.xxhash64("id", F.lit(7))
    dealt = dealt.withColumn("block", F.when(F.col("first").isNull(), F.pmod(mine, F.col("pool"))).otherwise(low + F.pmod(mine, F.col("blocks"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("pool") + F.col("rest") - 1), lambda o: F.col("first").isNull() | (o < low) | (o >= low + F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *[c for c in rows.columns if c != "grp"])


def _links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """``id, component`` of the classes that are linked with others."""
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null")
    keys = classes.select("id", F.explode("bands").alias("key"))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"), "keys")
    held = sifted(keys, shared, "key").join(shared.select(F.bitwise_not("key").alias("sk"), "n", "least"), F.bitwise_not("key") == F.col("sk")).drop("sk")
    held = written(held, "held")
    own = written(sifted(classes.select("id", "n_shingles", "n_bytes", "sketch"), held, "id"), "sketches")

    def with_sketches(asked: DataFrame) -> DataFrame:
        """``asked`` (id and others) with the set sizes and sketches of these classes."""
        return asked.join(own.select(F.bitwise_not("id").alias("oi"), "n_shingles", "sketch"), F.bitwise_not("id") == F.col("oi")).drop("oi")

    parts = F.ceil(F.col("n") / SKETCH_ROWS).cast("int")
    part = F.when(F.col("id") == F.col("least"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "key"), parts).cast("int")))
    met = with_sketches(held.select("key", F.explode(part).alias("part"), "id")).repartition("key", "part").sortWithinPartitions("key", "part")
    proposals = written(arrow_map(met, lambda b: _proposed(percent, b), "a long, b long").groupBy("b").agg(F.min("a").alias("a")), "proposals")

    def with_texts(asked: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``asked`` (id and others) with the texts of these classes, and a written table that this reads; ``ids``: their distinct ids."""
        ids = written(ids, "asked")
        # Written tables in between keep the plans small, which the driver makes anew after each of their stages.
        named_ = written(sifted(classes.select("id", "doc_id", "print"), ids, "id").join(ids, "id", "left_semi"), "wanted")
        dropped(spark, ids)
        found = sifted(texts, named_, "doc_id").join(named_, ["doc_id", "print"]).dropDuplicates(["id"]).select("id", "text")
        return asked.join(found.select(F.bitwise_not("id").alias("ti"), "text"), F.bitwise_not("id") == F.col("ti")).drop("ti"), named_

    degrees = proposals.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"))
    arms = proposals.join(degrees.withColumnRenamed("a", "da"), F.col("a") == F.col("da")).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("id"))
    centres = degrees.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    stars, star_ids = with_texts(arms.unionByName(centres), proposals.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    stars = stars.repartition("a", "part").sortWithinPartitions("a", "part")
    links = written(arrow_map(stars, lambda b: _verified(k, percent, b), "a long, b long"), "links")
    # Each linked class is named after the one that its chain of links leads to in four steps.
    first = links.select(F.col("b").alias("id"), F.col("a").alias("comp"))
    for _ in range(2):
        first = first.join(first.select(F.col("id").alias("fi"), F.col("comp").alias("fc")), F.col("comp") == F.col("fi"), "left").select("id", F.coalesce("fc", "comp").alias("comp"))
    first = written(first, "named")

    # What is alike but not yet connected, in the buckets that have different names.
    labelled = held.join(first.select(F.bitwise_not("id").alias("fi"), "comp"), F.bitwise_not("id") == F.col("fi"), "left").select("key", F.coalesce("comp", "id").alias("comp"), "id")
    labelled = written(labelled, "labelled")
    dropped(spark, shared, held)
    open_ = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select(F.bitwise_not("key").alias("ok"))
    open_ = written(labelled.join(open_, F.bitwise_not("key") == F.col("ok")).select(F.col("key").alias("grp"), "comp", "id", F.lit(0).alias("n_bytes")), "buckets")
    dropped(spark, labelled)
    blocks = with_sketches(_in_blocks(open_, SKETCH_ROWS, 1 << 62)).repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    found = written(arrow_map(blocks, lambda b: _open(percent, b), "a long, b long, involved boolean"), "open")
    clusters = components(found.where("not involved").select("a", "b"))
    rest = found.where("involved").select(F.col("a").alias("id"), F.col("b").alias("comp")).distinct().join(clusters.select(F.col("id").alias("comp"), F.col("component").alias("grp")), "comp")
    rest = written(rest.join(own.select("id", "n_bytes"), "id"), "rest")
    dealt, rest_ids = with_texts(_in_blocks(rest, BLOCK_ROWS, BLOCK_BYTES), rest.select("id").distinct())
    dealt = dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    more = arrow_map(dealt, lambda b: _forests(k, percent, b), "a long, b long")
    # Names stand for the chains of links: each leads on to the chain's end.
    out = written(components(first.select(F.col("comp").alias("a"), F.col("id").alias("b")).unionByName(more)), "groups")
    dropped(spark, own, proposals, star_ids, links, first, open_, found, rest, rest_ids)
    return out


def _decided(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id, print, n_shingles, component_id, kept`` for each row; print is a hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("print", F.xxhash64("text"))
    marks = written(arrow_map(docs, lambda b: _signatures(k, b), "doc_id long, print long, n_shingles long, p1 long, p2 long, n_bytes long, bands array<long>, sketch binary"), "minhash")
    full = marks.where("doc_id is not null and n_shingles > 0")
    least = F.min(F.struct("doc_id", "print", "n_bytes", "bands", "sketch")).alias("m")
    classes = written(full.groupBy("p1", "p2", "n_shingles").agg(least).select("p1", "p2", "n_shingles", "m.*"), "classes")
    # Classes are told by their smallest doc_id, or by a hash where several have one in common.
    twice = written(classes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():  # as a rule; a mark would be made anew in each plan that reads classes
        classes = classes.withColumn("id", F.col("doc_id"))
    else:
        classes = marked(classes, twice, ["doc_id"], "twice").withColumn("id", F.when(F.col("twice"), F.xxhash64("doc_id", "p1", "p2")).otherwise(F.col("doc_id"))).drop("twice")
    groups = _links(docs, classes, k, percent)
    linked = classes.select("p1", "p2", "n_shingles", "doc_id", "id").join(groups, "id")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("class_component")).select(F.bitwise_not("component").alias("lc"), "class_component")
    linked = linked.join(least, F.bitwise_not("component") == F.col("lc")).select("p1", "p2", "n_shingles", "class_component")
    alone = classes.select("p1", "p2", "n_shingles", F.col("doc_id").alias("own"))
    named_ = alone.join(linked, ["p1", "p2", "n_shingles"], "left").select("p1", "p2", "n_shingles", F.coalesce("class_component", "own").alias("class_component"))
    # By another key than the one that classes are grouped by, so that Spark can split a class of very many rows.
    named_ = named_.select(F.bitwise_not("p1").alias("c1"), F.col("p2").alias("c2"), F.col("n_shingles").alias("cn"), "class_component")
    out = marks.drop("bands", "sketch").join(named_, (F.bitwise_not("p1") == F.col("c1")) & (F.col("p2") == F.col("c2")) & (F.col("n_shingles") == F.col("cn")), "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("class_component", "doc_id"))
    out = out.select("doc_id", "print", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``doc_id, text``; see the module's text."""
    return _decided(docs, k, percent).drop("print")


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that stand for their group; repeated rows stay together."""
    docs = named(docs, "doc_id", "text")
    gone = _decided(docs, k, percent).where("not kept").select(F.col("doc_id").alias("__sw_id"), F.col("print").alias("__sw_print")).distinct()
    return docs.join(gone, (docs["doc_id"] == F.col("__sw_id")) & (F.xxhash64(docs["text"]) == F.col("__sw_print")), "left_anti")
