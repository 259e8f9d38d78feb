"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, on toxic and on ordinary text. A text is scored in windows of WINDOW words: the
bytes that the toxic dictionary saves over the ordinary one, window by window, give its features (largest and second largest
saving, mean, shares over two limits, length), and a logistic calibration on labelled documents that no dictionary
has seen turns these into a probability.

Invented and ordinary words alike fill a dictionary that is trained on whole documents, so their chance matches drown the few
telling ones. Training text is therefore contrasted first: of each class's documents, only the words whose document
frequency differs from the other class's significantly (by a log-likelihood ratio) are training samples. Both
dictionaries begin with the same common part, trained on ordinary windows, and their own parts have one size, so a window
without telling words compresses to the same length with either.

Learning takes at most SAMPLE labelled texts of each class, chosen by a hash of id and text among the distinct ones that are not
held out; of each class two in three for the dictionaries, the third for calibration. All that is learned is made of whole texts
in Spark: the words' document frequencies, the ordinary windows that the common part is trained on (COMMON_WINDOWS, a
hashed sample) and the calibration documents' features. The driver gets the words that fill a dictionary, these windows and these
features, never texts. Scores use whole texts, and only texts.

Defined results: null and empty texts have one empty window. A text of which no window is shorter with the toxic dictionary scores
no more than the share of toxic labels. Without three labelled texts of both classes all scores are the
share of toxic labels (0 without any). A text with both labels counts for both; rows that repeat an id and text are one
in learning. Each row gives one row; an input column of a result's name is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, dropped, held_out, named, widened, without, written

WINDOW = 8
#: A binary tree over the whole dictionary: with the hash tables of low levels, later content hides earlier matches.
SEARCH = dict(window_log=17, chain_log=18, hash_log=18, search_log=6, min_match=4, target_length=16, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
#: Least log-likelihood ratios of telling words that are tried; the calibration documents choose between them.
CONTRASTS = (20.0, 32.0, 45.0, 70.0)
#: Most labelled texts of each class that are learned from.
SAMPLE = 3000
#: Sizes of the dictionaries' parts: trained telling words, listed telling words, the common part and its training windows.
TELLING_BYTES, LISTED_BYTES, COMMON_BYTES, COMMON_WINDOWS = 4 << 10, 2 << 10, 64 << 10, 60000
#: Behind all: the last bytes of a dictionary are not found in it.
FILL = b" " * 64
LIMITS = (3, 6)


def windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().split()
    return [f" {' '.join(words[i : i + WINDOW])} ".encode() for i in range(0, len(words), WINDOW)] or [b"  "]


def _trained(samples: list[bytes], size: int) -> bytes:
    """Exactly ``size`` bytes: a trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        data = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        data = b"".join(dict.fromkeys(samples))
    return data[-size:].rjust(size, b"\0")


def _telling(uses: dict[bytes, int]) -> bytes:
    """A class's own part: a dictionary trained on its telling words as often as they are used, and behind it the words
    themselves, the most frequent last. The trainer keeps long segments and loses short words."""
    listed = b"".join(sorted(uses, key=lambda w: (uses[w], w)))[-LISTED_BYTES:]
    most = 100 * TELLING_BYTES // max(1, sum(len(w) for w in uses))  # the trainer wants some hundred times the size at most
    return _trained([w for w in sorted(uses) for _ in range(min(uses[w], max(8, most)))], TELLING_BYTES + LISTED_BYTES - len(listed)) + listed


@dataclass
class Model:
    """Dictionary contents and the calibration; plain data, so it travels with the tasks."""

    base: float
    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def codecs(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        out = []
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(**SEARCH)
            d.precompute_compress(compression_params=how)
            out.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))
        return tuple(out)

    def features(self, text: str | None, codecs) -> list[float]:
        ordinary, toxic = codecs
        saved = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)], np.float64)
        top = np.sort(saved)[::-1]
        n = len(saved)
        return [top[0], top[1] if n > 1 else 0.0, min(top[0], 4.0), saved.mean(), *((saved >= x).mean() for x in LIMITS), *(math.sqrt((saved >= x).sum()) for x in LIMITS), math.log1p(n)]

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -8, 8)
        p = 1 / (1 + np.exp(-(np.column_stack([z, np.ones(len(z))]) @ self.weights)))
        return np.where(features[:, 0] <= 0, np.minimum(p, self.base), p)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last for the constant, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    hold = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (p - y) + hold @ w)
    return w


def _word_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, toxic, docs, uses``: in how many texts a word is, and how often."""
    for batch in batches:
        docs, uses = Counter(), Counter()
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            found = Counter(text.as_py().lower().split())
            docs.update((w, toxic) for w in found)
            uses.update({(w, toxic): n for w, n in found.items()})
            if len(uses) > 50_000:
                yield _counted(docs, uses)
                docs, uses = Counter(), Counter()
        yield _counted(docs, uses)


def _counted(docs: Counter, uses: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in docs], pa.string()), pa.array([c for _, c in docs], pa.int32()), pa.array(list(docs.values()), pa.int64()), pa.array([uses[x] for x in docs], pa.int64())], ["word", "toxic", "docs", "uses"])


def _some_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for order, text in zip(batch.column("order").to_pylist(), batch.column("text")):
            found = windows(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([w[-COMMON_BYTES:] for w in found], pa.binary()), pa.array([order] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64())], ["window", "doc", "place"])


def _featured(models: list[Model], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codecs = [m.codecs() for m in models]
    for batch in batches:
        found = [[x for m, c in zip(models, codecs) for x in m.features(t.as_py(), c)] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["order", "toxic", "features"])


def _chosen(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """``text, toxic, order`` of the sample as a written table, and how many distinct labelled texts each class has."""
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(~held_out(F.col("id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("print"), "text").where("id is not null and text is not null")
    known = texts.select("id", "print").distinct().join(marked, "id").withColumn("order", F.xxhash64("id", "print"))
    known = written(known, "labelled")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    few = [known.where(F.col("toxic") == c).orderBy("order", "id").limit(sample) for c in (0, 1)]
    rows = texts.join(F.broadcast(few[0].union(few[1])), ["id", "print"])
    rows = written(rows.groupBy("id", "print", "toxic", "order").agg(F.max("text").alias("text")), "sample")
    dropped(docs.sparkSession, known)
    return rows.withColumn("learn", F.pmod("order", F.lit(3)) > 0), counts


def _ratios(rows: DataFrame, n: dict[int, int]) -> DataFrame:
    """``word, toxic, ratio, uses``: words more frequent in one class's documents, by a log-likelihood ratio."""
    counted = arrow_map(rows.select("text", "toxic"), _word_uses, "word string, toxic int, docs long, uses long")
    both = counted.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col(x))), F.lit(0)).alias(f"{x}{c}") for c in (0, 1) for x in ("docs", "uses")])
    part = lambda k, total, p: F.when(k > 0, k * F.log(k / total / p)).otherwise(0.0)
    x, y, p = F.col("docs0"), F.col("docs1"), (F.col("docs0") + F.col("docs1")) / (n[0] + n[1])
    ratio = 2 * (part(x, n[0], p) + part(n[0] - x, n[0], 1 - p) + part(y, n[1], p) + part(n[1] - y, n[1], 1 - p))
    more = (y * n[0] > x * n[1]).cast("int")
    found = both.select("word", more.alias("toxic"), ratio.alias("ratio"), F.when(more == 1, F.col("uses1")).otherwise(F.col("uses0")).alias("uses"), F.when(more == 1, y).otherwise(x).alias("docs"))
    return found.where((F.col("docs") >= 3) & (F.col("ratio") >= CONTRASTS[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled documents (doc_id, text; doc_id, toxic) that are not held out."""
    rows, counts = _chosen(docs, labels, sample)
    total = sum(counts.values())
    model = Model(counts.get(1, 0) / total if total else 0.0)
    sizes = {(r["toxic"], r["learn"]): r["n"] for r in rows.groupBy("toxic", "learn").agg(F.count("*").alias("n")).collect()}
    if all(sizes.get((c, learn), 0) for c in (0, 1) for learn in (True, False)) and min(counts.values()) >= 3:
        taken = {c: sizes[c, True] + sizes[c, False] for c in (0, 1)}
        model = _fitted(model, rows, {c: sizes[c, True] for c in (0, 1)})
        # A class beyond the sample's bound is rarer there than among the labels.
        model.weights[-1] += math.log(counts[1] / taken[1]) - math.log(counts[0] / taken[0])
    dropped(docs.sparkSession, rows)
    return model


def _fitted(model: Model, rows: DataFrame, learned: dict[int, int]) -> Model:
    def own_parts(some: DataFrame, sizes: dict[int, int]) -> list[list[bytes]]:
        """For each contrast the own parts of both classes."""
        ratios = _ratios(some, sizes)
        # No more words than a dictionary has bytes can be of use.
        telling = [ratios.where(F.col("toxic") == c).orderBy(F.desc("ratio"), "word").limit(TELLING_BYTES).collect() for c in (0, 1)]
        return [[_telling({f" {r['word']} ".encode()[-TELLING_BYTES:]: r["uses"] for r in found if r["ratio"] >= least}) for found in telling] for least in CONTRASTS]

    spread = arrow_map(rows.where("learn and toxic = 0").select("order", "text"), _some_windows, "window binary, doc long, place long")
    # As Arrow, since as many rows of Python objects would swell the driver for good.
    spread = spread.orderBy(F.xxhash64("doc", "place"), "doc", "place").limit(COMMON_WINDOWS).toArrow()
    common = _trained(spread.sort_by([("doc", "ascending"), ("place", "ascending")]).column("window").to_pylist(), COMMON_BYTES)
    join = lambda parts: Model(model.base, common + parts[1] + FILL, common + parts[0] + FILL)
    models = [join(parts) for parts in own_parts(rows.where("learn"), learned)]
    found = arrow_map(rows.where("not learn").select("order", "toxic", "text").repartition(rows.sparkSession.sparkContext.defaultParallelism), lambda b: _featured(models, b), "order long, toxic int, features array<double>")
    found = sorted(tuple(r) for r in found.collect())
    y, x = np.array([r[1] for r in found], np.float64), np.array([r[2] for r in found])
    best: tuple[float, int] | None = None
    for i, (m, features) in enumerate(zip(models, np.split(x, len(models), axis=1))):
        m.mean, m.scale = features.mean(axis=0), features.std(axis=0) + 1e-9
        m.weights = _logistic((features - m.mean) / m.scale, y)
        p = np.clip(m.scores(features), 1e-9, 1 - 1e-9)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        if best is None or loss < best[0]:
            best = loss, i
    return models[best[1]]


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codecs = model.codecs() if model.weights is not None else None
    for batch in batches:
        if codecs and batch.num_rows:
            scores = model.scores(np.array([model.features(t.as_py(), codecs) for t in batch.column("text")]))
        else:
            scores = np.full(batch.num_rows, model.base)
        keep = batch.schema.names
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], [*keep, "__sw_score"])


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with a text column, other columns as they are) and ``__sw_score``, the probability of label 1."""
    docs = without(named(docs, "text"), "__sw_score")
    return arrow_map(docs, lambda b: _scored(model, b), widened(docs, "__sw_score double"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""
    rows = with_scores(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__sw_score").alias("score"), (F.col("__sw_score") >= 0.5).cast("int").alias("predicted"))
