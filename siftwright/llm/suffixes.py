"""Repeated passages by a sparse suffix array over words.

A passage repeats where at least LENGTH successive words (A-Z lower-cased) stand somewhere earlier too: in a document
with a smaller doc_id, or further up in the same one without overlap. The first place keeps its words, the others lose them.

1. In each window of LENGTH words the least of its GRAM-word hashes selects a position (a minimiser). As the choice depends on
   the window's words alone, equal windows select equal positions. Only suffixes at selected positions are retained, about
   one in 20 words, each with its start (the gram) and a print of its surroundings: all words, left and right, of the
   windows that select it.
2. Suffixes are sorted by gram and surroundings over range partitions, and neighbours are compared. A gram without an equal
   neighbour cannot be in a repeated window. A suffix whose neighbours have equal surroundings repeats as a whole.
   Partition edges count as having neighbours, so partitions need not see each other.
3. The first suffix of each distinct surroundings of a shared gram is extended left and right: its windows' prints are
   compared over the corpus, which finds repeats of any extent between documents that agree on a part only.
4. Repeated windows become word spans of their documents, and byte spans of the texts.

All rows of steps 2 and 3 have a fixed small size; a passage that a third of the documents hold is spread by range
partitioning, by partial aggregation and by skew splitting of joins. Surroundings and windows have prints of 128 bits (two
independent ones of 64), so windows are equal by chance with a probability of 2**-88 or so even among 10**12.

Defined results: null texts and texts under LENGTH words repeat nothing. Rows with a null doc_id neither count as places nor
lose words. Rows that share doc_id and text are one document, and rows that share a doc_id only are ordered by a hash of
their text. Columns that Spark finds under doc_id and text are named so in results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, named, sifted, slices, written
from ._words import U, mix, powers, runs, signed, words

LENGTH, GRAM = 50, 10
#: Bases of the two prints of surroundings, and what the words of second window prints are scrambled with.
_BASES, _OTHER = (0xA0761D6478BD642F | 1, 0xE7037ED1A0B428DB | 1), U(0x8EBC6AF09C88C6E3)


def anchors(hashes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each selected position: gram hash, surroundings' two prints, first and last start of the windows that select it."""
    n = len(hashes) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(U), none.view(U), none.view(U), none, none
    grams = runs(hashes, gram)
    at = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1).argmin(axis=1) + np.arange(n)
    low = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    high = np.concatenate([low[1:], [n]]) - 1
    place = at[low]
    where, prints = mix((place - low).astype(U) << U(32) | (high - low).astype(U)), []
    for base in _BASES:
        up, down = powers(base, len(hashes) + 1)
        sums = np.concatenate([np.zeros(1, U), (hashes * up[:-1]).cumsum(dtype=U)])
        prints.append(mix((sums[high + length] - sums[low]) * down[low] + where))
    return grams[place], *prints, low, high


def _suffixes(length: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, prints = batch.column("doc_id").to_numpy(), batch.column("print").to_numpy()
        for start, end in slices(batch.column("text")):
            found = words(batch.column("text").slice(start, end - start))
            parts = [anchors(found.hashes[found.first[d] : found.first[d + 1]], length, gram) for d in range(end - start)]
            owner = np.repeat(np.arange(start, end), [len(p[0]) for p in parts])
            if len(owner):
                grams, rounds, rounds2, low, high = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(signed(x)) for x in (grams, rounds, rounds2)), pa.array(ids[owner]), pa.array(prints[owner]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["gram", "around", "around2", "doc_id", "print", "low", "high"]
                )


def _neighbours(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes to ``doc_id, print, low, high, whole, source``: whole spans are repeats of words in the document
    ``source``, the others have to be extended."""
    names = ["doc_id", "print", "low", "high"]
    gram = None  # of the last row
    around: tuple | None = None
    first = None  # the first row of the last surroundings
    waiting = None  # the only first row of the last gram so far
    edge = True

    def rows(table: dict, keep: np.ndarray, whole: np.ndarray, source: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(table[c][keep]) for c in names), pa.array(whole[keep]), pa.array(source[keep])], [*names, "whole", "source"])

    def alone(row: tuple) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(row, kinds)), pa.array([False]), pa.array([row[0]], pa.int64())], [*names, "whole", "source"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        t = {c: batch.column(c).to_numpy() for c in ["gram", "around", "around2", *names]}
        new_gram = np.concatenate([[t["gram"][0] != gram if gram is not None else True], t["gram"][1:] != t["gram"][:-1]])
        both = np.stack([t["around"], t["around2"]])
        new_round = new_gram | np.concatenate([[tuple(both[:, 0]) != around], (both[:, 1:] != both[:, :-1]).any(axis=0)])
        # The first row of each row's surroundings; index -1 is the one carried from the batch before.
        head = np.maximum.accumulate(np.where(new_round, np.arange(n), -1))
        carried = first or (0, 0, 0, 0)
        head_of = {c: np.where(head >= 0, t[c][head], carried[i]) for i, c in enumerate(names)}
        apart = (head_of["doc_id"] != t["doc_id"]) | (head_of["print"] != t["print"]) | (head_of["low"] + length <= t["low"])
        whole = ~new_round & apart
        group = np.cumsum(new_gram) - (1 if new_gram[0] else 0)  # 0: the gram carried from the batch before, or the first
        rounds = np.bincount(group, weights=new_round, minlength=group[-1] + 1)
        if not new_gram[0] and waiting is not None and rounds[0]:
            yield alone(waiting)
            waiting = None
        many = rounds >= 2
        if not new_gram[0]:
            many[0] = True  # a new surroundings here is not the gram's first
        keep = whole | (~new_round & ~apart) | (new_round & many[group])
        if edge:
            keep[0], edge = True, False
        last = int(np.flatnonzero(new_gram)[-1]) if new_gram.any() else None
        if last is not None:  # the last gram's only surroundings so far may get company in the next batch
            waiting = None if many[group[-1]] or keep[last] else tuple(int(t[c][last]) for c in names)
        if keep.any():
            yield rows(t, keep, whole, head_of["doc_id"])
        gram, around = t["gram"][-1], tuple(both[:, -1])
        first = tuple(int(head_of[c][-1]) for c in names)
    if waiting is not None:
        yield alone(waiting)


def _windows(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, prints, spans = batch.column("doc_id").to_numpy(), batch.column("print").to_numpy(), batch.column("spans")
        for start, end in slices(batch.column("text")):
            found = words(batch.column("text").slice(start, end - start))
            for d in range(start, end):
                mine = found.hashes[found.first[d - start] : found.first[d - start + 1]]
                both = runs(mine, length), runs(mix(mine ^ _OTHER), length)
                low, high = (spans[d].values.field(c).to_numpy() for c in ("low", "high"))
                at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(pa.array(signed(x[at])) for x in both), pa.array(np.full(len(at), ids[d])), pa.array(np.full(len(at), prints[d])), pa.array(at)], ["window", "window2", "doc_id", "print", "low"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text")


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, print, low, high, source``: the windows of ``length`` words that start at words low to high repeat words of source."""
    keyed = _keyed(docs.select("doc_id", "text"))
    columns = "gram long, around long, around2 long, doc_id long, print long, low int, high int"
    retained = written(arrow_map(keyed, lambda b: _suffixes(length, gram, b), columns), "suffixes")
    order = ["gram", "around", "around2", "doc_id", "print", "low"]
    near = arrow_map(retained.repartitionByRange(*order).sortWithinPartitions(*order), lambda b: _neighbours(length, b), "doc_id long, print long, low int, high int, whole boolean, source long")
    near = written(near, "neighbours")
    extended = near.where("not whole").groupBy("doc_id", "print").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    texts = sifted(keyed, near.where("not whole"), "doc_id")
    windows = arrow_map(texts.join(extended, ["doc_id", "print"]), lambda b: _windows(length, b), "window long, window2 long, doc_id long, print long, low int")
    windows = written(windows, "windows")
    place = F.struct("doc_id", "print", "low")
    firsts = windows.groupBy("window", "window2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    apart = (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.print") != F.col("print")) | (F.col("first.low") + length <= F.col("low"))
    again = windows.join(firsts, ["window", "window2"]).where(apart).select("doc_id", "print", "low", F.col("low").alias("high"), F.col("first.doc_id").alias("source"))
    return near.where("whole").select("doc_id", "print", "low", "high", "source").unionByName(again)


def _merged(length: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high + length)
        else:
            out.append((low, high + length))
    return out


def _spans(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        ranges = batch.column("ranges").to_pylist()
        spans = [_merged(length, [(r["low"], r["high"]) for r in x or []]) for x in ranges]
        sources = [sorted({r["source"] for r in x or []}) for x in ranges]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()), pa.array([[{"begin": a, "end": b} for a, b in x] for x in spans], kind), pa.array(sources, pa.list_(pa.int64()))],
            ["doc_id", "repeated_words", "spans", "sources"],
        )


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, repeated, repeated_words, spans, sources`` for each row.

    spans: the words (first, one behind the last) that stand earlier too. sources: documents where they do, at least one
    for each window; where many do, which of them is named may differ between runs.
    """
    ranges = repeated_windows(docs, length, gram).groupBy("doc_id", "print").agg(F.collect_list(F.struct("low", "high", "source")).alias("ranges"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print")).join(ranges, ["doc_id", "print"], "left")
    found = arrow_map(rows.select("doc_id", "ranges"), lambda b: _spans(length, b), "doc_id long, repeated_words long, spans array<struct<begin:int,end:int>>, sources array<long>")
    return found.select("doc_id", (F.col("repeated_words") > 0).alias("repeated"), "repeated_words", "spans", "sources")


def _cut(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ranges, out = batch.column("text"), batch.column("__sw_ranges"), []
        for start, end in slices(texts):
            found = words(texts.slice(start, end - start))
            for d in range(start, end):
                text = texts[d].as_py()
                if not ranges[d].is_valid:
                    out.append(text)
                    continue
                data, base, i = text.encode(), found.offsets[d - start], found.first[d - start]
                kept, at = [], 0
                for a, b in _merged(length, [(r["low"], r["high"]) for r in ranges[d].as_py()]):
                    kept.append(data[at : found.starts[i + a] - base])
                    at = found.ends[i + b - 1] - base
                out.append(b"".join([*kept, data[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(c) if c != "text" else pa.array(out, pa.string()) for c in batch.schema.names if c != "__sw_ranges"], [c for c in batch.schema.names if c != "__sw_ranges"])


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the repeated words cut out of the texts."""
    docs = named(docs, "doc_id", "text")
    ranges = repeated_windows(docs, length, gram).groupBy("doc_id", "print").agg(F.collect_list(F.struct("low", "high")).alias("__sw_ranges"))
    ranges = ranges.select(F.col("doc_id").alias("__sw_id"), F.col("print").alias("__sw_print"), "__sw_ranges")
    rows = docs.join(ranges, (docs["doc_id"] == F.col("__sw_id")) & (F.xxhash64(docs["text"]) == F.col("__sw_print")), "left").drop("__sw_id", "__sw_print")
    return arrow_map(rows, lambda b: _cut(length, b), docs.schema)
