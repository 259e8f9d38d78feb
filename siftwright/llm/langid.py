"""Language identification in two steps: the family first, then one-versus-one machines between its languages.

Features are counts of hashed byte n-grams (2, 3 and 4 bytes inside words, A-Z lower-cased) over the whole text, divided by
their number. The family is voted by one-versus-one linear support vector machines between families, the language by those
between the languages of the chosen family only, so closely related languages are separated by machines that have
seen nothing but them. Margins become probabilities by a logistic fit; the score is the product of both steps' support.

Learning takes at most SAMPLE distinct texts, in equal parts of the (at most LANGS) most frequent languages, chosen by a hash of
id and text among the rows that are not held out and have a language. Their features are made of the whole texts, in Spark; the
driver gets these, FEATURES numbers a text, and fits the machines. Predictions use whole texts, and only texts.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing was learned. A
language outside the table of families is a family of its own. Rows that repeat an id, text and language are one in
learning. Each row gives one row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, dropped, held_out, slices, written
from ._words import words

FEATURES, ORDERS = 4096, (2, 3, 4)
#: Most texts that are learned from, and most languages.
SAMPLE, LANGS = 4000, 64
UNKNOWN = "und"
# Language codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb".split(),
    "romance": "fr es pt it ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky".split(),
    "indic": "hi mr ne bn pa gu ur".split(),
    "semitic": "ar he mt am".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts one after another, and how many each text has."""
    found = words(texts)
    raw, n = found.raw, len(found.raw)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    owner = np.repeat(np.arange(len(texts)), np.diff(found.offsets))
    # A separator or a text's end on either side of a word counts as a byte 0 of it.
    code = np.where(inside, raw, 0).astype(np.uint32)
    out, owners = [], []
    for k in ORDERS:
        if n < k:
            continue
        h, fine = np.zeros(n - k + 1, np.uint32), owner[: n - k + 1] == owner[k - 1 :]
        for i in range(k):
            h = h * np.uint32(0x01000193) + code[i : n - k + 1 + i]
            if 0 < i < k - 1:
                fine = fine & inside[i : n - k + 1 + i]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append((h[fine] >> np.uint32(20)).astype(np.int32))
        owners.append(owner[: n - k + 1][fine])
    if not out:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    at = np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    return np.concatenate(out)[order], np.bincount(at, minlength=len(texts))


def counts(texts: pa.Array) -> np.ndarray:
    """A row of n-gram shares for each text."""
    grams, sizes = ngrams(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    at = 0
    for i, n in enumerate(sizes):
        if n:
            out[i] = np.bincount(grams[at : at + n], minlength=FEATURES) / n
        at += n
    return out


@dataclass
class Vote:
    """One-versus-one machines between some classes."""

    classes: list[str]
    weights: np.ndarray  # a column for each pair, in the order of combinations()
    bias: np.ndarray
    slope: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class with the largest summed support, and its mean support."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        support = np.zeros((len(margins), n))
        for p, (a, b) in enumerate(combinations(range(n), 2)):
            s = 1 / (1 + np.exp(-np.clip(margins[:, p] * self.slope[p], -30, 30)))
            support[:, a] += s
            support[:, b] += 1 - s
        best = support.argmax(axis=1)
        return best, support[np.arange(len(best)), best] / (n - 1)


@dataclass
class Model:
    families: Vote | None = None
    languages: dict[str, Vote] = field(default_factory=dict)


def _machine(x: np.ndarray, y: np.ndarray, scale: np.ndarray, steps: int = 150, hold: float = 1e-3) -> tuple[np.ndarray, float, float]:
    """Weights of a linear machine (squared hinge loss, accelerated gradient descent), its bias, and its margin's slope."""
    x = np.column_stack([x * scale, np.ones(len(x), np.float32)]).astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = look = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (2 * float((share * (x * x).sum(axis=1)).sum()) + hold)
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look))
        grad = hold * look - 2 * (x.T @ (share * slack * y))
        new = look - rate * grad
        look, w = new + step / (step + 3) * (new - w), new
    margin = x @ w
    slope = 1.0
    for _ in range(50):  # one-parameter logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * margin * y, -30, 30)))
        slope += float((share * (1 - p) * margin * y).sum()) / (float((share * p * (1 - p) * margin**2).sum()) + 1e-3)
        slope = min(max(slope, 0.1), 20.0)
    return w[:-1] * scale, float(w[-1]), slope


def _vote(classes: dict[str, np.ndarray], scale: np.ndarray) -> Vote:
    names, found = sorted(classes), []
    for a, b in combinations(names, 2):
        x = np.concatenate([classes[a], classes[b]])
        found.append(_machine(x, np.concatenate([np.ones(len(classes[a])), -np.ones(len(classes[b]))]).astype(np.float32), scale))
    return Vote(names, np.array([f[0] for f in found], np.float32).reshape(-1, FEATURES).T, np.array([f[1] for f in found]), np.array([f[2] for f in found]))


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """A model of rows of n-gram shares and their languages."""
    if not len(x):
        return Model()
    scale = (1 / np.sqrt(x.var(axis=0) + 1e-9)).astype(np.float32) / np.sqrt(FEATURES, dtype=np.float32)
    by_lang = {g: x[np.array([y == g for y in langs])] for g in sorted(set(langs))}
    families: dict[str, dict[str, np.ndarray]] = defaultdict(dict)
    for g, rows in by_lang.items():
        families[FAMILY_OF.get(g, g)][g] = rows
    return Model(_vote({f: np.concatenate(list(m.values())) for f, m in families.items()}, scale), {f: _vote(m, scale) for f, m in families.items()})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares as half-precision numbers, in bytes."""
    for batch in batches:
        for start, end in slices(batch.column("text")):
            part = batch.slice(start, end - start)
            found = [counts(part.column("text").slice(i, 200)) for i in range(0, part.num_rows, 200)]
            data = [(row * 256).astype(np.float16).tobytes() for rows in found for row in rows]
            yield pa.RecordBatch.from_arrays([part.column("order"), part.column("lang"), pa.array(data, pa.binary())], ["order", "lang", "shares"])


def train(docs: DataFrame, sample: int = SAMPLE, most_langs: int = LANGS) -> Model:
    """A model of the documents (doc_id, text, lang) that have a language and are not held out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "lang", F.xxhash64("text").alias("print"), "text").where("id is not null and lang is not null and text is not null")
    known = written(texts.select("id", "lang", "print").where(~held_out(F.col("id"))).distinct(), "labelled")
    langs = [r["lang"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()]
    if not langs:
        return Model()
    ranked = known.withColumn("order", F.xxhash64("id", "print"))
    few = reduce(DataFrame.union, [ranked.where(F.col("lang") == g).orderBy("order", "id").limit(max(1, sample // len(langs))) for g in langs])
    rows = texts.join(F.broadcast(few), ["id", "lang", "print"]).groupBy("id", "lang", "print", "order").agg(F.max("text").alias("text"))
    found = arrow_map(rows.select("order", "lang", "text"), _counted, "order long, lang string, shares binary").collect()
    found = sorted((tuple(r) for r in found), key=lambda r: r[:2])
    dropped(docs.sparkSession, known)
    return fit(np.array([np.frombuffer(r[2], np.float16) for r in found]).astype(np.float32) / 256, [r[1] for r in found])


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _predicted(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes = [model.families, *model.languages.values()] if model.families else []
    weights = np.concatenate([v.weights for v in votes], axis=1) if votes else None
    ends = np.cumsum([0, *(v.weights.shape[1] for v in votes)])
    for batch in batches:
        texts, langs, scores = batch.column("text"), [], []
        for start, end in slices(texts):
            part = texts.slice(start, end - start)
            lettered = np.array([_has_letter(t) for t in part.to_pylist()])
            if not votes:
                langs += [UNKNOWN] * len(part)
                scores.append(np.zeros(len(part)))
                continue
            grams, sizes = ngrams(part)
            sums = np.zeros((len(part), weights.shape[1]))
            full = np.flatnonzero(sizes)
            at = 0
            for i in full:
                n = sizes[i]
                sums[i] = np.bincount(grams[at : at + n], minlength=FEATURES).astype(np.float32) @ weights / n
                at += n
            margins = [sums[:, ends[i] : ends[i + 1]] + v.bias for i, v in enumerate(votes)]
            family, support = votes[0].decide(margins[0])
            lang, score = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
            for i, name in enumerate(votes[0].classes):
                at_ = list(model.languages).index(name)
                mine = np.flatnonzero((family == i) & lettered)
                pick, near = model.languages[name].decide(margins[at_ + 1][mine])
                lang[mine] = np.array(model.languages[name].classes, object)[pick]
                score[mine] = support[mine] * near
            langs += list(lang)
            scores.append(score)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = arrow_map(rows, lambda b: _predicted(model, b), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
