"""The corpus pipeline over ``documents``: each stage works on what the one before has kept.

Toxic documents go; of each group of near copies one document stays; passages that stand earlier in the corpus are cut
out; documents that hold a benchmark item go; what is left is encoded.

Defined results: documents with null or empty texts, or a null doc_id, stay. Rows that repeat an id and text stay or go together; of
near copies the one with the smallest doc_id stays. Empty tables (documents, labels, benchmark) give an empty result, no toxic
documents, no leaks. Stages keep all other columns as they are (n_chars is counted anew where passages are cut), whatever
their names, but for the last, which returns doc_id, lang, source and the tokens. Each stage's working tables are deleted
when its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import decontaminate, minhash, pieces, suffixes, toxicity
from siftwright.llm._common import finished, n_written, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model).where("__sw_score < 0.5").drop("__sw_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more) stays."""
    return minhash.one_of_each_group(docs, k=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words that stand earlier in the corpus are cut out of the texts."""
    return suffixes.cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (5-word shingles, similarity 0.8 or more) go."""
    matched = decontaminate.with_matches(docs, table(spark, sf_dir, "benchmark"), k=5, percent=80)
    return matched.where(F.size(decontaminate.IDS) == 0).drop(decontaminate.IDS, decontaminate.BEST)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token ids, with a check that these decode to the text."""
    return pieces.with_tokens(docs.select("doc_id", "lang", "source", "text"), pieces.load(pieces.default_model())).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
#: Toxicity and tokens cannot be told in SQL; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), n_written()
    for name, stage in STAGES[:-1]:
        docs = finished(stage(spark, docs, sf_dir), f"pipeline-{name}", since)
    return STAGES[-1][1](spark, docs, sf_dir)
