"""Incremental loops and coverage inside one row against plain versions."""

import os
import random

from pyspark.sql import functions as F

from tesserae.functions.keywords import covered_chars
from tesserae.operators import keywords, qa, vectors
from tesserae.plans import pipelines
from tesserae.providers import HashedNgrams


def covered_plainly(text, words):
    hit = set()
    for w in filter(None, words):
        hit |= {i + k for i in range(len(text)) if text.startswith(w, i) for k in range(len(w))}
    return len(hit)


def test_covered_characters_match_a_plain_count(spark):
    r = random.Random(2)
    rows = [("".join(r.choices("aab \0.", k=r.randint(0, 60))), ["".join(r.choices("ab", k=r.randint(1, 4))) for _ in range(r.randint(0, 5))]) for _ in range(300)]
    rows += [("x\\Ey (a)$1 [a]", ["\\E", "(a)", "$1", ""]), ("日本語日本 日本", ["日本", "本語日"]), ("", ["a"]), ("abc", []), ("ananana", ["ana"]), ("a" * 50_000, ["aa"]), ("😀a😀", ["😀"])]
    got = spark.createDataFrame(rows, "t string, w array<string>").select("t", "w", covered_chars(F.col("t"), F.col("w")).alias("n")).collect()
    assert all(x["n"] == (50_000 if len(x["t"]) == 50_000 else covered_plainly(x["t"], x["w"])) for x in got)


def test_char_coverage_is_one_row_a_document(spark):
    docs = spark.createDataFrame([(1, "beta alpha beta"), (2, ""), (3, None), (4, "no words here")], "doc_id int, text string")
    words = spark.createDataFrame([(1, "beta"), (1, "et"), (2, "x")], "doc_id int, word string")
    out = keywords.char_coverage(words, docs)
    assert sorted(map(tuple, out.collect())) == [(1, 8, 0.533333), (2, 0, 0.0), (3, 0, 0.0), (4, 0, 0.0)]
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


class Counting(HashedNgrams):
    def __init__(self, folder):
        super().__init__()
        self.folder = str(folder)

    def embed(self, texts):
        for t in texts:
            with open(f"{self.folder}/{random.SystemRandom().random()}", "w") as f:
                f.write(t)
        return super().embed(texts)

    def texts(self):
        return [open(f"{self.folder}/{f}").read() for f in os.listdir(self.folder)]


def feedback_plainly(docs, threshold, rounds):
    """Every round embeds and matches everything anew."""
    chunks = pipelines.chunks_of(docs)
    pairs = qa.hierarchical(docs).select("doc_id", "question", "answer")
    for _ in range(rounds):
        gaps = vectors.uncovered(pipelines.covered(chunks, pairs), threshold).select("id")
        more = qa.targeted(chunks.withColumn("id", F.xxhash64("doc_id", "chunk_idx")).join(gaps, "id", "left_semi")).select("doc_id", "question", "answer").distinct()
        pairs = pairs.unionAll(more.exceptAll(pairs).distinct().subtract(pairs))
    return pairs, pipelines.covered(chunks, pairs).select("id", "max_sim")


def test_feedback_embeds_each_text_once(spark, tmp_path):
    from tests.test_queries import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 12").select("doc_id", "text").unionAll(spark.createDataFrame([(None, "A lonely Text without an id. It names Nobody At All."), (99, None)], "doc_id bigint, text string"))
    counting = Counting(tmp_path)
    pairs, best = pipelines.feedback_state(docs, counting, 0.8, 2)
    want_pairs, want_best = feedback_plainly(docs, 0.8, 2)
    assert sorted(map(repr, pairs.collect())) == sorted(map(repr, want_pairs.collect()))
    assert sorted((r["id"], round(r["max_sim"], 5)) for r in best.collect()) == sorted((r["id"], round(r["max_sim"], 5)) for r in want_best.collect())
    chunks = pipelines.chunks_of(docs).count()
    texts = pairs.select(F.concat_ws(" ", "question", "answer", "answer").alias("t")).distinct().count()
    assert len(counting.texts()) == chunks + texts


def test_progressive_stops_like_a_plain_loop(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha gamma delta " * 3), (2, "one two three four five six seven"), (3, None), (4, "")], "doc_id int, text string")
    ranked = keywords.top_by_score(docs, 7)
    taken, before = 0, 0.0
    for n in (2, 2, 3):
        taken += n
        now = keywords.char_coverage(ranked.filter(F.col("rank") <= taken), docs).agg(F.avg("coverage")).first()[0]
        if now - before < 0.3:
            break
        before = now
    want = ranked.filter(F.col("rank") <= taken).count()
    assert pipelines.progressive(docs, (2, 2, 3), 0.3).count() == want
