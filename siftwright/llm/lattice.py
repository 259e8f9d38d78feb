"""The piece lattice as relations: the same tokens as :mod:`pieces`, told in DataFrame functions only.

Substrings of bounded length are exploded from each distinct word and joined to the piece table by equality; the edges found
are grouped by word, and an aggregate over the word's positions folds them: Viterbi for unigram models, and for BPE
models a fold over neighbouring symbols (the best-scored edge that two of them make together is taken, the leftmost of equals).
The words' ids then join their occurrences.

This form moves a row for each word occurrence through two shuffles, which is what :mod:`pieces` avoids; it is for vocabularies and
for tables whose words fit. Only the piece table is broadcast, at most MAX_PIECES rows. Results are those of
:mod:`pieces`, including null and empty texts. Words of many characters make rows of their number times the
longest piece's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written
from .pieces import BPE, MARK, PieceTable


def _edges(words: DataFrame, table: PieceTable) -> DataFrame:
    """``word, edges`` (start, end, score, id), edges empty where no piece fits."""
    spark = words.sparkSession
    known = spark.createDataFrame([(p, table.ids[p], float(s)) for p, s in table.scores.items()], "piece string, id int, score double")
    size = F.length("word")
    pick = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(table.longest), size - i)), lambda n: F.struct(i.alias("start"), (i + n).alias("end"), F.substring("word", i + 1, n).alias("piece")))
    parts = words.select("word", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), size - 1), pick))).alias("part")).select("word", "part.*")
    edge = F.struct("start", "end", "score", "id")
    return words.join(parts.join(F.broadcast(known), "piece").groupBy("word").agg(F.collect_list(edge).alias("edges")), "word", "left").withColumn("edges", F.coalesce("edges", F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("score"), F.lit(0).alias("id"))), lambda x: F.lit(False))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _merged(edges: Column, size: Column) -> Column:
    """Boundaries of a BPE model's pieces, by a fold over the word's neighbouring symbols.

    A symbol is its start, its end and the score of the edge that it makes with the next one. A step joins the best (then
    leftmost) such pair and looks up the two edges that change.
    """
    score = lambda s, e: F.get(F.filter(edges, lambda x: (x["start"] == s) & (x["end"] == e)), F.lit(0))["score"]
    end_at = lambda acc, s: F.get(F.filter(acc, lambda x: x["s"] == s), F.lit(0))["e"]
    symbol = lambda s, e, c: F.struct(s.alias("s"), e.alias("e"), c.alias("c"))
    start = F.transform(F.sequence(F.lit(0), size - 1), lambda i: symbol(i, i + 1, score(i, i + 2)))

    def joined(acc: Column, left: Column, mid: Column, end: Column) -> Column:
        new = _let(symbol(left, end, score(left, end_at(acc, end))), lambda x: x)
        before = lambda x: symbol(x["s"], x["e"], score(x["s"], end))
        return F.transform(F.filter(acc, lambda x: x["s"] != mid), lambda x: F.when(x["s"] == left, new).when(x["e"] == left, before(x)).otherwise(x))

    def step(acc: Column, _: Column) -> Column:
        best = F.array_max(F.transform(acc, lambda x: F.struct(x["c"].alias("c"), (-x["s"]).alias("l"))))
        go = lambda b: _let(end_at(acc, -b["l"]), lambda mid: _let(end_at(acc, mid), lambda end: joined(acc, -b["l"], mid, end)))
        return _let(best, lambda b: F.when(b["c"].isNull(), acc).otherwise(go(b)))

    done = F.aggregate(F.sequence(F.lit(1), size), start, step)
    return F.concat(F.transform(done, lambda x: x["s"]), F.array(size))


def _viterbi(edges: Column, size: Column, missing: float) -> Column:
    """Boundaries of the path with the largest sum of scores."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("bounds")))

    def step(best: Column, j: Column) -> Column:
        ends = F.filter(edges, lambda e: e["end"] == j)
        path = lambda i, s: F.struct((F.get(best, i)["score"] + s).alias("score"), F.array_append(F.get(best, i)["bounds"], j).alias("bounds"))
        single = F.exists(ends, lambda e: e["start"] == j - 1)
        options = F.concat(F.transform(ends, lambda e: path(e["start"], e["score"])), F.when(single, F.array().cast("array<struct<score:double,bounds:array<int>>>")).otherwise(F.array(path(j - 1, F.lit(missing)))))
        return F.array_append(best, F.array_max(options))

    return F.get(F.aggregate(F.sequence(F.lit(1), size), start, step), size)["bounds"]


def word_ids(words: DataFrame, table: PieceTable) -> DataFrame:
    """``word, ids`` of a table of distinct, non-empty words."""
    size = F.length("word")
    bounds = _merged(F.col("edges"), size) if table.kind == BPE else _viterbi(F.col("edges"), size, table.lowest - 10.0)
    cut = _edges(words.select("word"), table).withColumn("bounds", bounds)
    spell = F.array(*[F.lit(i) for i in table.bytes_]) if table.bytes_ else None

    def ids(begin: Column, i: Column) -> Column:
        end = F.get("bounds", i + 1)
        found = F.filter("edges", lambda e: (e["start"] == begin) & (e["end"] == end))
        spelled = F.array(F.lit(table.unknown))
        if spell is not None:
            pairs = F.regexp_extract_all(F.hex(F.encode(F.substring("word", begin + 1, end - begin), "UTF-8")), F.lit("(..)"), 1)
            spelled = F.transform(pairs, lambda x: F.get(spell, F.conv(x, 16, 10).cast("int")))
        return F.when(F.size(found) > 0, F.array(F.get(found, F.lit(0))["id"])).otherwise(spelled)

    starts = F.slice("bounds", F.lit(1), F.size("bounds") - 1)
    return cut.select("word", F.flatten(F.transform(starts, ids)).alias("ids"))


def tokens(docs: DataFrame, table: PieceTable) -> DataFrame:
    """``doc_id, token_ids`` for each row of ``doc_id, text``."""
    marked = F.translate("text", " ", MARK)
    text = F.concat(F.lit(MARK), marked) if table.prefix else marked
    found = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(f"({table.word.pattern})"), 1))
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), found.alias("words")), "words")
    spread = rows.select("row", F.posexplode("words").alias("place", "word"))
    known = word_ids(spread.select("word").distinct(), table)
    joined = spread.join(known, "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("parts"))
    out = rows.join(joined, "row", "left")
    empty = F.when(F.col("words").isNotNull(), F.array().cast("array<int>"))
    return out.select("doc_id", F.coalesce(F.flatten(F.transform("parts", lambda p: p["ids"])), empty).alias("token_ids"))
