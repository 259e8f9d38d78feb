"""Benchmark decontamination: SimHash of shingle windows, a multi-index of Hamming blocks, exact shingle similarity.

A document is contaminated by the items that one of its item-sized windows (clipped at the document's ends) reaches: sums of
minimum over sums of maximum of the multiplicities of the window's ``k``-word shingles and the item's (weighted Jaccard
similarity) against ``percent``.

A window that reaches an item of m shingles has at least ``percent`` of these, so it misses at most d = m - ceil(m * percent / 100).
Of each item so many shingles are fingerprinted, those of fewest items first, that they occur d + 1 times in it: one of them at
least stands in the window word by word, wherever the edits are. Fingerprints are 64-bit SimHashes of windows of ``k`` words. They
are cut into RADIUS + 1 blocks: two within RADIUS bits agree in one block at least, so looking each block up in the items' tables
finds all pairs within the radius, and equal windows, at distance 0, always. Of each pair of document and item that is found,
all windows are then compared exactly, by sums over the shingles in common.

The benchmark is indexed in parts of about PART_BYTES of text, each by one task, and the parts are written as a table in the
shared folder. Tasks read parts from there, hold at most HELD_BYTES of them (one at least) and pass every slice of documents by every
part, so neither the driver nor a task holds the whole. Documents are never moved or grouped.

Defined results: null and empty texts and items match nothing. An item or window with fewer than ``k`` words is one shingle, so
such items are looked up by a window of their whole length. Rows that share an item_id are items of their own whose matches bear
one id. Each row of documents gives one row, repeated rows too; an input column of a result's name is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, named, slices, sorted_groups, widened, without, written
from ._words import U, runs, words

RADIUS = 3
PART_BYTES, HELD_BYTES = 4 << 20, 256 << 20
IDS, BEST = "__sw_item_ids", "__sw_best"
_ROWS = 8192


def simhashes(hashes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the SimHash of each window of so many words."""
    n = len(hashes)
    sums = {size: np.zeros(max(0, n - size + 1), U) for size in sizes}
    most = max(sizes, default=0)
    for at in range(0, n, _ROWS):
        part = hashes[at : at + _ROWS + most]
        signs = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) * np.int16(2) - np.int16(1)
        total = np.zeros((len(part) + 1, 64), np.int16)  # wraps around, differences over a window do not
        np.cumsum(signs, axis=0, dtype=np.int16, out=total[1:])
        for size in sizes:
            m = min(_ROWS, n - size + 1 - at, len(part) - size + 1)
            if m > 0:
                over = total[size : size + m] - total[:m] > 0
                sums[size][at : at + m] = np.packbits(over, axis=1).view(U).ravel()
    yield from sums.items()


@dataclass
class Index:
    """Fingerprints of one window size: value, item and the window's first word in the item; blocks sorted for look-up."""

    prints: np.ndarray
    items: np.ndarray
    offsets: np.ndarray

    def __post_init__(self) -> None:
        self.orders, self.values, self.masks = [], [], []
        for block in self.prints.view(np.uint16).reshape(-1, RADIUS + 1).T:
            order = np.argsort(block, kind="stable")
            mask = np.zeros(1 << 16, bool)
            mask[block] = True
            self.orders.append(order)
            self.values.append(block[order])
            self.masks.append(mask)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (row of ``prints``, row of the index) within RADIUS bits, perhaps more than once."""
        rows, found = [], []
        for b, block in enumerate(prints.view(np.uint16).reshape(-1, RADIUS + 1).T):
            hit = np.flatnonzero(self.masks[b][block])
            if not len(hit):
                continue
            low, high = (np.searchsorted(self.values[b], block[hit], side=s) for s in ("left", "right"))
            n = high - low
            row = np.repeat(hit, n)
            entry = self.orders[b][np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(low, n)]
            near = np.bitwise_count(prints[row] ^ self.prints[entry]) <= RADIUS
            rows.append(row[near])
            found.append(entry[near])
        return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def most_similar(text: np.ndarray, m: int, values: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
    """Of all windows of ``m`` shingles of ``text`` (fewer at its ends) the one most like an item of ``m`` shingles, the sorted
    ``values`` with ``counts``: the sums of minimum and of maximum multiplicities. Zero and one without a shingle in common."""
    code = np.minimum(np.searchsorted(values, text), len(values) - 1)
    places = np.flatnonzero(values[code] == text)
    if not len(places):
        return 0, 1
    order = np.argsort(code[places], kind="stable")
    code, places = code[places][order], places[order]
    # A place adds to the windows that hold it but not the place ``count`` before it of the same shingle.
    before = np.arange(len(places)) - counts[code]
    full = before >= np.searchsorted(code, code)
    low = np.maximum(places - m, np.where(full, places[np.maximum(before, 0)], -m)) + 1
    starts = np.unique(np.concatenate([low, places]))
    common = np.searchsorted(np.sort(low), starts, side="right") - np.searchsorted(np.sort(places), starts)
    whole = m + np.minimum(starts + m, len(text)) - np.maximum(starts, 0) - common
    best = int(np.argmax(common / whole))
    return int(common[best]), int(whole[best])


class Benchmark:
    """Items' shingles and the index of each window size."""

    def __init__(self, items: list[tuple[int, str]], k: int, percent: int) -> None:
        found = words(pa.array([t for _, t in items], pa.string()))
        self.ids, self.sizes, self.shingles = [], [], []
        texts, places = [], []
        for i, (item_id, _) in enumerate(items):
            if found.first[i + 1] > found.first[i]:
                texts.append(found.hashes[found.first[i] : found.first[i + 1]])
                self.ids.append(item_id)
                self.sizes.append(min(k, len(texts[-1])))
                values, at, counts = np.unique(runs(texts[-1], self.sizes[-1]), return_index=True, return_counts=True)
                self.shingles.append((values, counts))
                places.append(at)
        shared = dict(zip(*(x.tolist() for x in np.unique(np.concatenate([v for v, _ in self.shingles]), return_counts=True)))) if texts else {}
        wanted: dict[int, list[tuple[int, int]]] = {}
        for i, (values, counts) in enumerate(self.shingles):
            m = int(counts.sum())
            rarest = np.argsort([shared[v] for v in values.tolist()], kind="stable")
            missed = np.cumsum(counts[rarest]) - counts[rarest]  # by a window with none of the shingles before
            most = m + -percent * m // 100
            wanted.setdefault(self.sizes[i], []).extend((i, at) for at in places[i][rarest[missed <= most]].tolist())
        self.index = {}
        for size, chosen in sorted(wanted.items()):
            joined = np.concatenate([texts[i][at : at + size] for i, at in chosen])
            prints = dict(simhashes(joined, [size]))[size][::size].copy()
            self.index[size] = Index(prints, np.array([c[0] for c in chosen]), np.array([c[1] for c in chosen]))

    def matches(self, text: np.ndarray, first: np.ndarray, percent: int) -> list[dict[int, float]]:
        """For each document (word hashes ``text[first[d]:first[d + 1]]``) the items that reach the limit, with similarities."""
        out: list[dict[int, float]] = [{} for _ in range(len(first) - 1)]
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for size, prints in simhashes(text, list(self.index)):
            rows, entries = self.index[size].near(prints)
            inside = owner[rows] == owner[rows + size - 1]
            pairs = np.unique(np.stack([owner[rows[inside]], self.index[size].items[entries[inside]]]), axis=1)
            last, shingles = -1, None
            for d, item in pairs.T.tolist():
                if d != last:
                    last, shingles = d, runs(text[first[d] : first[d + 1]], size)
                values, counts = self.shingles[item]
                common, whole = most_similar(shingles, int(counts.sum()), values, counts)
                if common and 100 * common >= percent * whole:
                    out[d][self.ids[item]] = max(common / whole, out[d].get(self.ids[item], 0))
        return out


def _indexed(k: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted items to one row for each part: its index, packed."""
    for (part,), rows in sorted_groups(batches, ["part"]):
        items = sorted(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(Benchmark(items, k, percent))], pa.binary())], ["part", "packed"])


class Parts:
    """The parts of an index in files, read as they are asked for; some stay, within ``held_bytes``."""

    def __init__(self, paths: list[str], held_bytes: int) -> None:
        self.held_bytes = held_bytes
        self.places = [(path, i) for path in paths for i in range(self._file(path).metadata.num_rows)]
        self.held: dict[tuple[str, int], tuple[int, Benchmark]] = {}

    @staticmethod
    def _file(path: str) -> pq.ParquetFile:
        system, place = fs.FileSystem.from_uri(path)
        return pq.ParquetFile(place, filesystem=system)

    def __iter__(self) -> Iterator[Benchmark]:
        for place in self.places:
            if place not in self.held:
                packed = next(b for i, b in enumerate(self._file(place[0]).iter_batches(1, columns=["packed"])) if i == place[1]).column("packed")[0].as_py()
                while self.held and sum(n for n, _ in self.held.values()) + len(packed) > self.held_bytes:
                    self.held.popitem()
                self.held[place] = len(packed), pickle.loads(packed)
            yield self.held[place][1]


def _matched(paths: list[str], held_bytes: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = Parts(paths, held_bytes)
    for batch in batches:
        ids, best = [], []
        for start, end in slices(batch.column("text")):
            found = words(batch.column("text").slice(start, end - start))
            hits: list[dict[int, float]] = [{} for _ in range(end - start)]
            for part in parts:
                for d, more in enumerate(part.matches(found.hashes, found.first, percent)):
                    for item_id, similarity in more.items():
                        hits[d][item_id] = max(similarity, hits[d].get(item_id, 0.0))
            ids += [sorted(x) for x in hits]
            best += [max(x.values(), default=0.0) for x in hits]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())], [*batch.schema.names, IDS, BEST])


def with_matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, part_bytes: int = PART_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``docs`` (a text column and others) with the matched items' ids (IDS, sorted) and the BEST similarity (0 without a match)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    n = max(1, -(-size // part_bytes))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")).repartition("part").sortWithinPartitions("part")
    index = written(arrow_map(dealt, lambda b: _indexed(k, percent, b), "part int, packed binary"), "benchmark")
    paths = sorted(index.inputFiles())
    rows = without(named(docs, "text"), IDS, BEST)
    return arrow_map(rows, lambda b: _matched(paths, held_bytes, percent, b), widened(rows, f"{IDS} array<long>, {BEST} double"))


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids, best`` for each row."""
    rows = with_matches(docs.select("doc_id", "text"), benchmark, k, percent)
    return rows.select("doc_id", (F.size(IDS) > 0).alias("contaminated"), F.size(IDS).alias("n_items"), F.col(IDS).alias("item_ids"), F.col(BEST).alias("best"))
