"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers, floor(scale * x). A block of rows holds one bitmap per dimension and bit (a slice). A
query's scores for a whole block are the sum of its |component| times slices, made by adding bitmaps (full adders over
words of 64 rows); negative components use inverted slices, so all terms are unsigned and the sum differs from the score by
a constant of the query. The top rows are then selected from the most significant slice of the sum downward, as one
bitmap of rows surely in and one of rows on the boundary; the boundary's rows have equal scores and are resolved by the smaller
vec_id.

Rows are dealt into blocks of at most about ROW_BLOCK, each of which is shuffled and indexed once. Queries are copied to every
block, and stream through its index, so neither a block's queries nor all rows are ever held; only the best k of a query and
block leave it. Nothing is broadcast. Work is rows times queries, as exact search asks; what is moved besides the rows is one
query for each ROW_BLOCK rows.

Defined results: vectors that are null, hold a null or a non-finite component, or have a null vec_id take no part. Vectors of
different lengths are not compared. A query's own row is every row with its vec_id. Rows that repeat a vec_id and vector are
one query, and as candidates each counts. Arithmetic is in 64 bits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_map, sorted_runs

#: Most rows of a block (on average), and the size below which blocks are not made smaller to occupy all cores.
ROW_BLOCK, LEAST_BLOCK = 65536, 16384
U = np.uint64


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of bit-sliced numbers: (..., slices, words) each, least slice first; b may have fewer slices."""
    if a.shape[-2] < b.shape[-2]:
        a, b = b, a
    n, m = a.shape[-2], b.shape[-2]
    out = np.empty((*a.shape[:-2], n + 1, a.shape[-1]), U)
    carry = np.zeros((*a.shape[:-2], a.shape[-1]), U)
    for j in range(n):
        x = a[..., j, :]
        if j < m:
            y = b[..., j, :]
            half = x ^ y
            np.bitwise_xor(half, carry, out=out[..., j, :])
            half &= carry
            carry = (x & y) | half
        else:
            np.bitwise_xor(x, carry, out=out[..., j, :])
            carry = x & carry
    out[..., n, :] = carry
    return out


def total(terms: np.ndarray) -> np.ndarray:
    """The sum over the first axis, by halves."""
    while len(terms) > 1:
        half = len(terms) // 2
        left = terms[2 * half :]
        terms = add(terms[:half], terms[half : 2 * half])
        if len(left):
            terms = np.concatenate([terms, np.concatenate([left, np.zeros((1, 1, left.shape[-1]), U)], axis=1)])
    return terms[0]


class BitSlicedIndex:
    """Slices of the rows of one block, in order of their ids."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, self.dims = values.shape
        self.low = values.min(axis=0) if self.n and self.dims else np.zeros(self.dims, np.int64)
        above = (values - self.low).T.astype(U)
        self.bits = int(above.max()).bit_length() if above.size else 0
        self.words = -(-self.n // 64)
        self.slices = np.zeros((self.dims, self.bits, self.words), U)
        for j in range(self.bits):
            packed = np.packbits(((above >> U(j)) & U(1)).astype(np.uint8), axis=1, bitorder="little")
            self.slices[:, j].view(np.uint8)[:, : packed.shape[1]] = packed
        self.all = self.bitmap(np.arange(self.n))

    def bitmap(self, rows: np.ndarray) -> np.ndarray:
        flags = np.zeros(self.words * 64, np.uint8)
        flags[rows] = 1
        return np.packbits(flags, bitorder="little").view(U)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The sum's slices: each row's inner product but for a constant."""
        size, out = np.abs(query), np.zeros((0, self.words), U)
        for b in range(int(size.max()).bit_length() if len(size) else 0):
            dims = np.flatnonzero((size >> b) & 1)
            if not len(dims) or not self.bits:
                continue
            terms = self.slices[dims]
            terms[query[dims] < 0] ^= ~U(0)
            out = add(out, np.concatenate([np.zeros((b, self.words), U), total(terms)]))
        return out

    def top(self, query: np.ndarray, k: int, allowed: np.ndarray) -> np.ndarray:
        """The k allowed rows of the highest scores (all, if fewer); equal scores by the smaller row number."""
        inside, edge = np.zeros(self.words, U), allowed.copy()
        count = lambda x: int(np.bitwise_count(x).sum())
        have = 0
        for s in self.scores(query)[::-1]:
            high = edge & s
            n = count(high)
            if have + n > k:
                edge = high
            else:
                inside |= high
                have += n
                edge &= ~s
            if have == k:
                break
        rows = np.flatnonzero(np.unpackbits(inside.view(np.uint8), bitorder="little"))
        if have < k:
            rest = np.flatnonzero(np.unpackbits(edge.view(np.uint8), bitorder="little"))
            rows = np.concatenate([rows, rest[: k - have]])
        return rows


def quantised(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of equally long vectors, as rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(vectors), -1)


def _searched(k: int, scale: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by block and dimensions, rows before queries."""
    place, held, index = None, [], None
    ids = rows = None
    for (*at, asks), piece in sorted_runs(batches, ["rb", "dims", "asks"]):
        if at != place:
            place, held, index = at, [], None
        if not asks:
            held.append(piece.select(["vec_id", "vector"]))
            continue
        if not held:
            continue
        if index is None:
            block = pa.Table.from_batches(held).combine_chunks().sort_by("vec_id")
            ids, rows = block.column("vec_id").to_numpy(), quantised(block.column("vector").combine_chunks(), scale)
            index = BitSlicedIndex(rows)
        queries, out = quantised(piece.column("vector"), scale), []
        for query_id, uid, query in zip(piece.column("vec_id").to_pylist(), piece.column("uid").to_pylist(), queries):
            own = np.arange(np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, side="right"))
            best = index.top(query, k, index.all & ~index.bitmap(own) if len(own) else index.all)
            out += zip([query_id] * len(best), [uid] * len(best), ids[best], rows[best] @ query)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["query_id", "uid", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query row's ``k`` best other rows."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if kind == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), is_query.alias("asks"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(fine).withColumn("dims", F.size("vector"))
    queries = rows.where("asks").dropDuplicates(["vec_id", "vector"]).withColumn("uid", F.xxhash64("vector"))
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // ROW_BLOCK), min(-(-n // LEAST_BLOCK), 2 * cores))
    asked = queries.withColumn("asks", F.lit(True)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    given = rows.withColumn("asks", F.lit(False)).withColumn("uid", F.lit(0).cast("long")).withColumn("rb", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    cells = given.unionByName(asked).repartition("rb", "dims").sortWithinPartitions("rb", "dims", "asks")
    found = arrow_map(cells, lambda b: _searched(k, scale, b), "query_id long, uid long, vec_id long, score long")
    order = Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
