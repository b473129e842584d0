"""Words counted inside their row against words counted as rows, and long texts."""

import contextlib
import io
import random
import string
import time

from pyspark.sql import functions as F

from tesserae.functions import keywords as K
from tesserae.functions.counting import _general
from tesserae.operators import keywords


def plan(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


def some_docs(spark, n=40):
    r = random.Random(7)
    parts = ["ab", "abc", "Ab1", "AI", "人工知能", "知能", "データ", "ー", "こと", "a", " ", " ", ". ", "。", "とは", "は", "である", "（", "　"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(n)] + [None, ""]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def ranked(df):
    return sorted((r["doc_id"], r["rank"], r["word"]) for r in df.collect())


def test_words_ranked_inside_their_row_are_those_ranked_as_rows(spark):
    docs = some_docs(spark)
    assert "Exchange" not in plan(keywords.top_by_frequency(docs)) and "Exchange" not in plan(keywords.text_scores(docs))
    counted = keywords.words(docs)
    assert ranked(keywords.top_by_frequency(docs, 3)) == ranked(keywords.top(counted, F.col("n").cast("double"), 3))
    assert ranked(keywords.top_by_score(docs, 3)) == ranked(keywords.top(counted, F.round(K.rank_score(F.col("word"), F.col("n")), 9), 3))
    again = keywords.with_text(counted, docs, "doc_id", "text", s=lambda w, full: F.round(K.text_score(w["word"], full), 9))
    assert ranked(keywords.text_scores(docs, 3)) == ranked(keywords.top(again, F.col("s"), 3))


def test_rows_that_share_an_id_are_counted_together(spark):
    docs = spark.createDataFrame([(1, "beta alpha alpha"), (1, "beta beta"), (2, "alpha")], "doc_id bigint, text string")
    assert [tuple(r) for r in keywords.top_by_frequency(docs, 1).orderBy("doc_id").select("doc_id", "word", "n").collect()] == [(1, "beta", 3), (2, "alpha", 1)]


def test_scores_of_a_long_text_of_different_words(spark):
    r = random.Random(3)
    text = " ".join("".join(r.choices(string.ascii_lowercase, k=9)) for _ in range(20_000))
    docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id bigint, text string").repartition(4)
    began = time.time()
    assert keywords.text_scores(docs).count() == 20 and keywords.qa_scores(docs).count() == 20
    assert time.time() - began < 60


def test_importance_of_sentences_and_best_context(spark):
    said = ["人工知能とはAIである", "ABC ab " * 9, "x"]
    df = spark.createDataFrame([(s, w) for s in said for w in ("AI", "ab", "x")], "s string, w string")
    for r in df.withColumn("x", K.importance(F.col("s"), F.col("w"))).filter(F.contains("s", "w")).collect():
        a, b, c = _general(r["s"])
        assert r["x"] == min((1.0 - r["s"].find(r["w"]) / len(r["s"])) * 0.2 + a + b + c, 1.0)
    docs = spark.createDataFrame([(1, "　ab cd . ab ab")], "doc_id bigint, text string")
    assert keywords.details(spark.createDataFrame([(1, "ab")], "doc_id bigint, word string"), docs).first()["best_context"] == "ab cd"
