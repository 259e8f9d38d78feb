"""The lattice as relations gives the same tokens as the batches and the library."""

import random

import sentencepiece

from siftwright.llm import lattice, pieces


def test_relational_tokens(spark):
    table = pieces.load(pieces.default_model())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    r = random.Random(5)
    texts = ["".join(r.choice("ab the in ▁\n\té日本-= \x00xyzT😀") for _ in range(r.randrange(80))) for _ in range(60)] + ["", " ", "Hello world, hello again", "   indented", None]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    got = {x.doc_id: x.token_ids for x in lattice.tokens(df, table).collect()}
    assert got == {i: None if t is None else library.encode(t) for i, t in enumerate(texts)}
    assert "Python" not in lattice.tokens(df, table)._jdf.queryExecution().executedPlan().toString()
    assert lattice.tokens(df.limit(0), table).count() == 0


def test_relational_viterbi(spark):
    r = random.Random(6)
    scores = {p: -r.random() * 5 for p in ("a", "b", "ab", "ba", "aba", "bab")}
    table = pieces.PieceTable(pieces.UNIGRAM, True, {p: i + 1 for i, p in enumerate(scores)}, scores, [], 0, [])
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 8))) for _ in range(60)]
    got = {x.word: x.ids for x in lattice.word_ids(spark.createDataFrame([(w,) for w in set(words)], "word string"), table).collect()}
    for w in words:
        path = [table.ids.get(w[i:j], 0) for i, j in table.cuts(w)]
        assert got[w] == path, w
