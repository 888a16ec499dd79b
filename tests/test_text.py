"""Dictionaries applied where the text is: no shuffle of tokens, the same rows for repeated ids, null ids, null texts and unknown words."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sylva.operators import text

TEXTS = ["a b a", "b  c C", None, "", "zz a", "c c c ΑΣ b"]


def _docs(spark, ids):
    return spark.createDataFrame(list(zip(ids, TEXTS, strict=True)), "doc_id long, text string").select("doc_id", text.tokenize(F.col("text")).alias("tokens"))


def _words(spark):
    return spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("ας", 3)], "token string, id int")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ids", [[1, 2, 3, 4, 5, 6], [1, 1, None, 4, None, 1]])
@pytest.mark.parametrize("sent", [True, False])
def test_words_are_looked_up_where_the_text_is(spark, monkeypatch, ids, sent):
    if not sent:
        monkeypatch.setattr(text, "BROADCAST_BYTES", 0)
    docs, number = _docs(spark, ids), {"a": 0, "b": 1, "c": 2, "ας": 3}
    tokens = [[w.lower() for w in (t or "").split(" ") if w] for t in TEXTS]
    bags = text.digitize(docs, "doc_id", F.col("tokens"), _words(spark))
    expected = Counter((i, number[w]) for i, t in zip(ids, tokens, strict=True) for w in t if w in number)
    assert sorted((str(r[0]), r[1], r[2]) for r in bags.collect()) == sorted((str(i), w, n) for (i, w), n in expected.items())
    assert bags.dtypes == [("doc_id", "bigint"), ("id", "int"), ("count", "bigint")]
    for unknown in (None, 9):
        got = {r["doc_id"]: r["ids"] for r in text.apply_dictionary(docs, "doc_id", F.col("tokens"), _words(spark), unknown).collect()}
        own: dict = {}
        for i, t in zip(ids, tokens, strict=True):
            own.setdefault(i, []).extend((p, number.get(w, unknown)) for p, w in enumerate(t) if unknown is not None or w in number)
        assert got == {i: [w for _, w in sorted(x)] for i, x in own.items() if x}


def test_tokens_are_not_shuffled(spark):
    docs = _docs(spark, [1, 2, 3, 4, 5, 6])
    assert "Exchange" not in _plan(text.digitize(docs, "doc_id", F.col("tokens"), _words(spark)))
    assert "Exchange" not in _plan(text.apply_dictionary(docs, "doc_id", F.col("tokens"), _words(spark), 9))


def test_lower_case_of_whole_texts_is_that_of_tokens(spark):
    rows = [("ΑΣ ΣΑΣ. ΑΣ' Σ",), ("İI ǅ ẞ  X",), (None,), (" ",), ("a\tB\nC d",)]
    df = spark.createDataFrame(rows, "text string")
    plain = F.transform(F.filter(F.coalesce(F.split("text", " "), F.array().cast("array<string>")), lambda x: x != ""), lambda x: F.lower(x))
    assert all(r[0] == r[1] for r in df.select(text.tokenize(F.col("text")), plain).collect())
