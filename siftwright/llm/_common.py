"""Shared helpers: table readers, the shared working folder, written tables and Arrow batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most bytes of text that vectorised code takes up at once (a single longer text is taken alone).
SLICE_BYTES = 1 << 19


#: Where a local session without ``spark.checkpoint.dir``, which cannot be set later, keeps its own.
OWN_DIR = "spark.siftwright.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a local session (one machine, as in
    tests) gets a fresh one, and a cluster an error, as its executors do not see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='siftwright-')}"
        spark.conf.set(OWN_DIR, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siftwright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables written so far.
_made: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(spark, folder)


def finished(df: DataFrame, name: str, since: int) -> DataFrame:
    """``df`` as a written table, less all tables that were written after the first ``since`` and before it."""
    out = written(df, name)
    for path in _made[since:-1]:
        _delete(df.sparkSession, path)
    del _made[since:-1]
    return out


def n_written() -> int:
    return len(_made)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents (crc32 of the id's text, mod 5) that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``limit`` bytes together."""
    at, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield at, i
            at, size = i, 0
        size += int(n)
    if at < len(texts):
        yield at, len(texts)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of equal ``keys`` from batches that are sorted by them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        at = 0
        for i in range(batch.num_rows):
            key = tuple(c[i] for c in columns)
            if key != last:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield last, pa.Table.from_batches(held)
                held, at, last = [], i, key
        held.append(batch.slice(at))
    if held:
        yield last, pa.Table.from_batches(held)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of batches with equal ``keys``; of a group that spans batches, one piece of each, so nothing is held."""
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        at = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[at]:
                yield rows[at], batch.slice(at, i - at)
                at = i


def arrow_map(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    return df.mapInArrow(fn, schema)


def named(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the columns that Spark finds under these names (``Text`` for text, say) renamed to them exactly."""
    for name in names:
        df = df.withColumnRenamed(name, name)
    return df


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns of these names in any case: those of a result take their place."""
    return df.drop(*[c for c in df.columns if c.lower() in names])


def widened(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` and the columns of the schema ``more`` behind them."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


#: Bits of a sieve; its rows (64 bits each) are what a sieve broadcasts, at most.
SIEVE_BITS = 1 << 23


def marked(rows: DataFrame, keys: DataFrame, names: list[str], flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: true for all whose ``names`` are in ``keys``, and for few others. Moves no row.

    The keys are hashed into a bitmap of fixed size, SIEVE_BITS / 64 rows of a long, which is broadcast; a row's flag is its
    bit. When there are many more keys than bits, all flags are true.
    """
    bit = F.pmod(F.xxhash64(*names), F.lit(SIEVE_BITS))
    bitmap = keys.select(bit.alias("__sw_bit")).groupBy(F.shiftright("__sw_bit", 6).alias("__sw_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__sw_bit % 64 as int))")).alias("__sw_bits"))
    found = rows.withColumn("__sw_bit", bit).withColumn("__sw_word", F.shiftright("__sw_bit", 6)).join(F.broadcast(bitmap), "__sw_word", "left")
    hit = F.coalesce(F.expr("(shiftrightunsigned(__sw_bits, cast(__sw_bit % 64 as int)) & 1) = 1"), F.lit(False))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], hit.alias(flag))


def sifted(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` less most of those whose ``name`` is not in ``keys``: a cheap step before a join that shuffles ``rows``."""
    return marked(rows, keys, [name], "__sw_flag").where("__sw_flag").drop("__sw_flag")
