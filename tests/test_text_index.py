"""The stored index: counts inside rows, norms instead of vectors."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemograph.functions import text as X
from mnemograph.operators import retrieval
from mnemograph.plans.text_index import FULL_TEXT, WORDS, TextIndex, posting_rows

from .conftest import rows

TEXTS = ["alpha beta alpha", "", None, "the of", "béta Beta gamma_1 x alpha", "delta " * 50 + "alpha"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_counted_inside_their_row(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    postings = posting_rows(docs, "doc_id", "text")
    # No shuffle, and no list beside the terms: each would carry a copy of it.
    assert "Exchange" not in plan_of(postings)
    assert "_s" not in postings.columns
    want = []
    for i, text in enumerate(TEXTS):
        words = X.tokenize_text((text or "").replace("é", " "))
        want += [("w", t, i, n, len(words)) for t, n in Counter(words).items()]
    assert rows(postings.where("kind = 'w'"), "kind", "term", "key", "tf", "len") == sorted(want)
    full = dict(rows(postings.where("kind = 'f' and key = 4"), "term", "tf"))
    assert full == {"beta": 2, "gamma": 1, "1": 1, "x": 1, "alpha": 1}


def test_index_in_steps_searches_like_a_scan(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    index = TextIndex(spark, str(tmp_path / "index"), "doc_id")
    index.add(docs.where("doc_id < 3"), "text")
    assert [r.doc_id for r in index.tfidf_top("alpha").collect()] == [0]
    index.add(docs.where("doc_id >= 3"), "text")
    want = retrieval.tfidf_search(docs, "doc_id", F.col("text"), "alpha beta delta")
    cols = ("doc_id", "similarity")
    assert rows(index.tfidf_top("alpha beta delta"), *cols) == rows(want, *cols)
    # Norms are one row a document; a table of vectors would repeat every posting.
    norms = spark.read.parquet(f"{index.path}/{index.state()['vectors']['home']}")
    assert norms.columns == ["key", "norm"] and norms.count() == 3
    assert index.tfidf_top("nowhere").count() == 0
    want = retrieval.bm25_top(docs, "doc_id", F.col("text"), "bet", 5)
    assert rows(index.bm25_top("bet", 5), "doc_id", "rank") == rows(want, "doc_id", "rank")


def test_term_counts_need_no_shuffle(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    counts = retrieval.term_counts(docs, "doc_id", F.col("text"))
    assert "Exchange" not in plan_of(counts)
    assert "Exchange" not in plan_of(retrieval.postings(docs, "doc_id", F.col("text")))
    assert rows(counts.where("doc_id in (0, 1, 5)"), "doc_id", "token", "total", "tf") == [
        (0, "alpha", 3, 2), (0, "beta", 3, 1), (5, "alpha", 51, 1), (5, "delta", 51, 50)]


def test_an_index_stores_only_the_postings_its_searches_read(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for kinds, refused in (((FULL_TEXT,), "tfidf_top"), ((WORDS,), "bm25")):
        index = TextIndex(spark, str(tmp_path / kinds[0]), "doc_id", kinds)
        index.add(docs, "text")
        home = index.state()["segments"][0]["home"]
        assert {r.kind for r in spark.read.parquet(f"{index.path}/{home}/rows").collect()} == set(kinds)
        with pytest.raises(ValueError):
            getattr(index, refused)("alpha")
        got = index.bm25_top("al bet", 5) if kinds == (FULL_TEXT,) else index.tfidf_top("alpha beta")
        want = retrieval.bm25_top(docs, "doc_id", F.col("text"), "al bet", 5) if kinds == (FULL_TEXT,) else \
            retrieval.tfidf_search(docs, "doc_id", F.col("text"), "alpha beta")
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
