"""Classifiers on held-out documents, tokens against the library, the pipeline against brute force, queries against SQL."""

import random
import zlib
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from brute import contaminated, cut, language, near_groups, repeated, toxic_score
from conftest import DATA

import corpus_pipeline
from siftwright.llm import _common, langid, pieces, queries, toxicity
from siftwright.llm._common import held_out

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_against_sql(spark, name):
    df = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    columns = sorted(df.columns)
    found = duck("sf0.001").execute(queries.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in columns]) for r in found.fetchall())


def test_working_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_common, "shared_dir", lambda _: f"file://{tmp_path}")
    corpus_pipeline.run(spark, f"{DATA}/sf0.001").count()
    left = [p.name for p in tmp_path.glob("siftwright/*/*")]
    assert len(left) == 1 and left[0].startswith("pipeline-decontamination"), left


def test_registered_queries():
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in queries.QUERIES}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_array", "decontamination", "sentencepiece"]


# ---- toxicity


def test_toxicity_on_held_out_documents(spark):
    sf = f"{DATA}/sf0.1"
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, sf).collect()}
    labels = dict(duck("sf0.1").execute("select doc_id, toxic from labels").fetchall())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    held = [(got[d].score, got[d].predicted, y) for d, y in labels.items() if got[d].held_out]
    hit = sum(p and y for _, p, y in held)
    # One in eight of the toxic labels here is on a text without a telling word, so 0.87 is the most that any rule could reach.
    assert hit / sum(p for _, p, _ in held) > 0.75 and hit / sum(y for *_, y in held) > 0.65
    order = np.argsort(np.argsort([s for s, *_ in held]))
    y = np.array([y for *_, y in held])
    assert (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum())) > 0.9


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a word", 1), (3, "bad " * 50000, 1), (3, "x", 2)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (None, 1, 1)], "doc_id long, toxic int, text string")
    for y in (labels, labels.limit(0)):
        rows = toxicity.score(docs, toxicity.train(docs, y)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.Model(0.5)).count() == 0
    r = random.Random(0)
    word = lambda: f"w{r.randrange(300)}"
    texts = [" ".join([word() for _ in range(60)] + (["despicable contemptible", word(), "despicable"] if i % 4 == 0 else [])) for i in range(500)]
    model = toxicity.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)], "doc_id long, toxic int"))
    codecs = model.codecs()
    score = lambda t: model.scores(np.array([model.features(t, codecs)]))[0]
    clean = " ".join(word() for _ in range(90))
    assert score(clean + " despicable contemptible " + word() + " despicable") > 0.5 > score(clean) and score("") < 0.5 and score(None) < 0.5


def test_toxicity_scores_are_those_of_a_plain_loop(spark):
    sf = f"{DATA}/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for d, t in duck("sf0.001").execute("select doc_id, text from documents").fetchall():
        assert abs(got[d] - toxic_score(t, model)) < 1e-9


def test_learning_is_bounded_by_distinct_texts(spark, monkeypatch):
    """One id over and over, with one text and with many, both labels, and very many language names."""
    rows = spark.range(60000).selectExpr("11L as doc_id", "concat('bad word ', id % 3) as text", "concat('l', id % 500) as lang").union(spark.range(400).selectExpr("id + 100", "concat('some text ', id)", "'en'"))
    labels = spark.range(400).selectExpr("id + 100 as doc_id", "cast(id % 2 as int) as toxic").union(spark.sql("select * from values (11L, 0), (11L, 1)"))
    sample, counts = toxicity._chosen(rows, labels, 50)
    assert sample.groupBy("toxic").count().count() == 2 and sample.count() == 100 and sum(counts.values()) == 2 * 3 + sum(zlib.crc32(str(i + 100).encode()) % 5 != 0 for i in range(400))
    assert len(toxicity.score(rows.limit(5), toxicity.train(rows, labels, 50)).collect()) == 5
    seen = []
    monkeypatch.setattr(langid, "fit", lambda x, langs: seen.append((x.shape, langs)))
    langid.train(rows, 100, 8)
    assert seen[0][0][0] <= 100 and len(set(seen[0][1])) == 8 and "en" in seen[0][1]


def test_clashing_columns(spark, table):
    """Columns of the operators' own names, in any case, and struct fields with odd names."""
    df = spark.sql("select 1L as DOC_ID, 'a word' as Text, 2 as __sw_score, 3 as token_ids, 4 as N_TOKENS, 5 as restored, named_struct('a b', 1) as s")
    out = toxicity.with_scores(df, toxicity.Model(0.25)).first()
    assert out["__sw_score"] == 0.25 and out["s"]["a b"] == 1 and out["DOC_ID"] == 1
    tokens = pieces.with_tokens(df, table)
    assert tokens.first()["restored"] is True and sorted(tokens.columns) == sorted(["DOC_ID", "text", "__sw_score", "s", "token_ids", "n_tokens", "restored"])
    assert pieces.decoded(tokens, table).first()["text"] == "a word"


# ---- languages


def test_languages_are_those_of_a_plain_loop(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.identify(docs, model).collect():
        lang, score = language(texts[r.doc_id], model)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_languages_on_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op6_langid(spark, f"{DATA}/sf0.01").collect()}
    wanted = dict(duck("sf0.01").execute("select doc_id, lang from documents").fetchall())
    held = [d for d, r in got.items() if r.held_out]
    assert len(got) == len(wanted) and np.mean([got[d].lang_pred == wanted[d] for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !? ٠", None), (4, "日本", "xx"), (None, "the of", "en"), (5, "the and " * 60000, "en"), (5, "ß", None)], "doc_id long, text string, lang string")
    some = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).where("doc_id < 5").collect()}
    assert [some[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and some[1].score == 0 and some[4].lang_pred in ("en", "xx")
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.Model()).count() == 0
    one = langid.fit(langid.counts(pa.array(["le la les", "des une"])), ["fr", "fr"])
    assert [r.lang_pred for r in langid.identify(docs, one).where("doc_id = 4").collect()] == ["fr"]


def test_nothing_is_learned_from_held_out_rows(spark):
    rows = [(i, "aaa bbb" if i % 2 else "zzz yyy", "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    changed = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 'fr' else lang end as lang")
    a, b = langid.train(docs), langid.train(changed)
    assert a.families.classes == b.families.classes and (a.languages["germanic"].weights == b.languages["germanic"].weights).all()
    assert docs.where(held_out(docs.doc_id)).count() == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200))


# ---- pieces


@pytest.fixture(scope="module")
def table():
    return pieces.load(pieces.default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_pieces_are_the_librarys(spark, table, library):
    rows = queries.op8_sentencepiece(spark, f"{DATA}/sf0.001").collect()
    texts = dict(duck("sf0.001").execute("select doc_id, text from documents").fetchall())
    assert len(rows) == len(texts)
    assert all(r.token_ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.restored for r in rows)


def test_odd_texts(spark, table, library):
    r = random.Random(1)
    texts = ["".join(r.choice("ab the in ▁\n\t\r\réé日本-=#  \x00<s>xyzT😀") for _ in range(r.randrange(200))) for _ in range(1500)]
    texts += ["", " ", "  ", "a" * 5000, " " * 100 + "x", "=" * 300 + "#" * 77, "<0x0A>", "<unk></s>", "x" * 63, "y" * 65, "▁", "﻿a"]
    encoder = pieces.Encoder(table)
    assert [x.tolist() for x in encoder.encode_all(texts)] == library.encode(texts)
    assert all(pieces.decode(x, table) == library.decode(x) for x in library.encode(texts))
    words = list({w for t in texts for w in encoder.words(t)})
    slow = [np.array(table.encode_word(w), np.int32).tobytes() for w in words]
    assert all(x in (None, y) for x, y in zip(pieces.Lattice(table).fold(words), slow))
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate([*texts, None, "a b"])], "doc_id long, text string, ids string")
    out = {x.doc_id: x for x in pieces.with_tokens(df, table).collect()}
    assert out[len(texts)].token_ids is None and out[len(texts)].restored is None and out[texts.index("")].token_ids == []
    assert all(out[i].restored == ("▁" not in t) for i, t in enumerate(texts))
    back = pieces.decoded(pieces.with_tokens(df, table).select("doc_id", "token_ids"), table)
    assert {x.doc_id: x.text for x in back.collect()} == {i: None if t is None else t.replace("▁", " ") for i, t in enumerate([*texts, None, "a b"])}
    assert pieces.with_tokens(df.limit(0), table).count() == 0


def test_viterbi_against_all_paths():
    r = random.Random(2)
    scores = {"".join(p): -r.random() * 5 for n in (1, 2, 3) for p in product("abc", repeat=n) if r.random() < 0.6 and p != ("c",)}
    model = pieces.PieceTable(pieces.UNIGRAM, True, {p: i + 1 for i, p in enumerate(scores)}, scores, [], 0, [])
    for _ in range(200):
        word = "".join(r.choice("abc") for _ in range(r.randrange(1, 9)))

        def paths(i):
            if i == len(word):
                yield 0.0, []
            for j in range(i + 1, len(word) + 1):
                s = scores.get(word[i:j], model.lowest - 10 if j == i + 1 else None)
                if s is not None:
                    for rest, cuts in paths(j):
                        yield s + rest, [(i, j), *cuts]

        value = sum(scores.get(word[i:j], model.lowest - 10) for i, j in model.cuts(word))
        assert abs(value - max(x for x, _ in paths(0))) < 1e-9 and "".join(word[i:j] for i, j in model.cuts(word)) == word


# ---- the pipeline


def test_pipeline(spark, table, library, tmp_path):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = " ".join(f"n{i}" for i in range(70))
    extra = [(90001, None, "en", "s", 0), (90002, "", "en", "s", 0), (90003, long + " a" * 5 + " ".join(f"u{i}" for i in range(80)), "en", "s", 0), (90004, " ".join(f"v{i}" for i in range(80)) + " " + long, "en", "s", 0), (90005, "clean one", None, None, None)]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    item = bench.first().text
    extra.append((90006, "before it " + item + " after it", "en", "s", 0))
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    rows = [x for x in rows if not scores[x[0]]]
    groups = near_groups(rows, 5, 80)
    rows = [x for i, x in enumerate(rows) if groups[i][2]]
    at = repeated(rows, 50)
    rows = [(d, cut(t, at[d]) if t else t) for d, t in rows]
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(d, t) for d, t in rows if not contaminated(t, items, 5, 80)]
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d: None if t is None else library.encode(t) for d, t in rows}
    assert {90001, 90002, 90003, 90004, 90005} <= set(got) and 90006 not in got
    assert "n69" in library.decode(got[90003]) and "n5" not in library.decode(got[90004]) and "v79" in library.decode(got[90004])
    staged = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, staged, str(tmp_path))
        assert dict(after.dtypes) == dict(docs.dtypes)
        staged = after



def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty tables, and documents with repeated rows, null ids, other cases and columns of helpers' names."""
    sf = f"{DATA}/sf0.001"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = spark.sql("select * from values (1L, 'one two three'), (1L, 'one two three'), (1L, 'another text of the id'), (2L, 'ONE two  three'), (null, 'no id'), (3L, null), (4L, '') as d(doc_id, text)")
    docs = docs.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars", "7 as component_id", "named_struct('a b', 1) as print", "1 as __sw_score", "2 as low", "3 as id")
    got = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, got, str(tmp_path))
        assert set(after.columns) >= set(docs.columns) - {"__sw_score"}
        got = after
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, [(1, "one two three"), (1, "one two three"), (1, "another text of the id"), (None, "no id"), (3, None), (4, "")]))
