"""The call ledger, batch generation, answers from hits, the vector index and row numbering."""

import json
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import generation, vectors
from tesserae.operators.generation import Ledger
from tesserae.operators.ordering import numbered_rows
from tesserae.operators.vector_index import VectorIndex, recall
from tests.test_queries import SF


class Counting:
    """Writes down every call; fails, or answers oddly, where a rule says so."""

    def __init__(self, folder, odd=lambda prompt: None, fails=lambda prompt, calls: False):
        self.folder, self.odd, self.fails = str(folder), odd, fails

    def write(self, prompt):
        name = f"{abs(hash(prompt)):x}-{os.getpid()}-{random.SystemRandom().random()}"
        with open(f"{self.folder}/{name}", "w") as f:
            f.write(prompt)
        if self.fails(prompt, sum(p == prompt for p in self.calls())):
            raise OSError("no answer")
        if (said := self.odd(prompt)) is not None:
            return said
        n = int(re.search(r"Write (\d+)", prompt)[1])
        texts = re.split(r"\n\n\[\d+\]\n", prompt)[1:]
        return json.dumps({"qa_pairs": [{"question": f"q{i} of {len(texts)}", "answer": texts[0][:5], "question_type": "fact"} for i in range(n)]})

    def calls(self):
        return [open(f"{self.folder}/{f}").read() for f in os.listdir(self.folder)]


def chunk_rows(spark, n=7, text="text number {} "):
    return spark.createDataFrame([(i // 3, i % 3, text.format(i) * 3, 20 * i) for i in range(n)], "doc_id bigint, chunk_idx bigint, chunk string, tokens bigint")


def test_pairs_of_a_batch_are_dealt_by_quota_and_paid_once(spark, tmp_path):
    writer, ledger, chunks = Counting(tmp_path), Ledger(spark), chunk_rows(spark)
    got = generation.generate(chunks.repartition(5), writer, ledger, wait=0).collect()
    quotas = {0: 2, 1: 2, 2: 2, 3: 3, 4: 3, 5: 6, 6: 6}
    assert Counter(r["place"] for r in got) == quotas
    assert {(r["place"], r["ordinal"]) for r in got if r["place"] < 3} == {(0, 0), (0, 1), (1, 2), (1, 3), (2, 4), (2, 5)}
    assert {r["how"] for r in got if r["place"] == 6} == {"single"} and all(r["doc_id"] == r["place"] // 3 for r in got)
    assert len(writer.calls()) == 3
    again = generation.generate(chunks, writer, ledger, wait=0).collect()
    assert sorted(again) == sorted(got) and len(writer.calls()) == 3
    more = generation.generate(chunk_rows(spark, 8), writer, ledger, wait=0)
    assert more.count() > 0 and len(writer.calls()) == 4  # the last batch alone is new


def test_replies_that_do_not_parse_are_asked_chunk_by_chunk(spark, tmp_path):
    odd = lambda p: "I cannot do that" if "[2]" in p and "number 1 " in p else "```json\n" + json.dumps({"qa_pairs": [{"question": "q", "answer": "a", "question_type": None}, {"question": "", "answer": "b"}]}) + "\n```" if "number 4 " in p else None
    writer, ledger = Counting(tmp_path, odd), Ledger(spark)
    got = generation.generate(chunk_rows(spark, 6), writer, ledger, wait=0).collect()
    assert {r["place"]: r["how"] for r in got} == {0: "single", 1: "single", 2: "single", 3: "batch"}
    assert [r["question"] for r in got if r["place"] == 3] == ["q"]
    assert max(Counter(writer.calls()).values()) == 1 and len(writer.calls()) == 5


def test_failing_calls_are_tried_again_and_then_left_out(spark, tmp_path):
    writer, ledger = Counting(tmp_path, fails=lambda p, n: "number 0 " in p or ("number 3 " in p and n < 3)), Ledger(spark)
    got = generation.generate(chunk_rows(spark, 6), writer, ledger, wait=0).collect()
    assert {r["place"] for r in got} == {1, 2, 3, 4, 5}
    calls = Counter(writer.calls())
    assert sorted(calls.values()) == [1, 1, 3, 3, 3]
    writer.fails = lambda p, n: False
    assert {r["place"] for r in generation.generate(chunk_rows(spark, 6), writer, ledger, wait=0).collect()} == set(range(6))


def test_a_task_that_is_lost_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    """A writer that kills its worker once: Spark's retry of the task calls only for what was not written down."""
    monkeypatch.setattr(generation, "EVERY", 1)
    (tmp_path / "calls").mkdir()
    flag = str(tmp_path / "died")

    def dies(prompt, n):
        if prompt == "p7" and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)
        return False

    writer = Counting(tmp_path / "calls", odd=lambda p: f"reply to {p}", fails=dies)
    requests = spark.createDataFrame([(f"p{i}",) for i in range(12)] + [("p3",), (None,)], "prompt string")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    try:
        ledger.ask(requests, writer, wait=0)
    except Exception:  # a local session tries a task once only; the next job goes on from the ledger
        ledger.ask(requests, writer, wait=0)
    calls = Counter(writer.calls())
    assert calls.pop("p7") == 2 and set(calls.values()) == {1} and len(calls) == 11
    assert {(r["prompt"], r["reply"]) for r in ledger.answered(requests).collect()} == {(f"p{i}", f"reply to p{i}") for i in range(12)} | {(None, None)}


def test_answers_from_hits(spark, tmp_path):
    questions = spark.createDataFrame([(1, "why?"), (2, "how?"), (3, None)], "id bigint, query string")
    hits = spark.createDataFrame([(1, 2, 0.5, "q2", "a2", "s"), (1, 1, 0.75, "q1", None, "s"), (3, 1, 0.25, "q", "a", None)], "id bigint, rank bigint, score double, question string, answer string, source string")
    writer = Counting(tmp_path, odd=lambda p: p.upper())
    out = {r["id"]: r for r in generation.answers(hits, questions, writer, Ledger(spark), wait=0).collect()}
    assert out[2]["reply"] is None and out[2]["prompt"] is None and out[2]["sources"] == []
    assert out[1]["prompt"].endswith("Question: why?\n\nScore: 0.7500\nQuestion: q1\nAnswer: \n\nScore: 0.5000\nQuestion: q2\nAnswer: a2") and out[1]["sources"] == ["s"]
    assert out[3]["reply"] == out[3]["prompt"].upper() and len(writer.calls()) == 2


def test_rows_are_numbered_in_order(spark):
    data = [(None, 1)] * 3 + [(i % 50, i) for i in range(500)] + [(7, 7)] * 400
    df = spark.createDataFrame(data, "a bigint, b bigint").repartition(9)
    got = numbered_rows(df, ["a", "b"], "n").orderBy("n").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) and [r["n"] for r in got] == list(range(len(data)))
    assert numbered_rows(df.filter("false"), ["a"], "n").count() == 0


def vector_table(spark, m, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(m)) if ids is None else ids, m)], "vec_id bigint, embedding array<double>")


def test_index_recall_on_the_given_vectors(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/../sf0.1/embeddings.parquet")
    queries = e.filter("vec_id % 20 = 0")
    index = VectorIndex.build(e, f"{tmp_path}/ix")
    exact = vectors.nearest(queries, e, 10).persist()
    assert recall(VectorIndex.open(spark, f"{tmp_path}/ix").search(queries, 10), exact) >= 0.9
    found = index.search(queries, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert rows_of(index.search(queries, 10, probes=len(index.centres))) == rows_of(exact)


def rows_of(df):
    return sorted((r["id"], r["rank"], r["other"], round(r["score"], 6)) for r in df.collect())


def test_index_of_clusters_probes_few_cells_and_keeps_copies(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 16))
    m = np.concatenate([c + 0.15 * r.normal(size=(60, 16)) for c in centres] + [np.tile(centres[0], (900, 1)), np.zeros((3, 16))])
    df = vector_table(spark, m).unionAll(spark.createDataFrame([(90_000, None), (90_001, [])], "vec_id bigint, embedding array<double>"))
    index = VectorIndex.build(df, f"{tmp_path}/ix")
    assert index.probes <= len(index.centres) // 4
    asked = df.filter("vec_id % 20 = 0")
    exact = vectors.nearest(asked.filter("size(embedding) > 0"), df.filter("size(embedding) > 0"), 5)
    found = index.search(asked, 5)
    assert recall(found, exact) >= 0.9
    near, far = index.best_match(asked, True), vectors.best_match(asked.filter("size(embedding) > 0"), df.filter("size(embedding) > 0"), True)
    same = near.join(far.withColumnRenamed("max_sim", "exact"), "id").filter(F.col("max_sim") >= F.col("exact") - 1e-6).count()
    assert same >= 0.9 * far.count() and near.columns == far.columns
    copy = [x for x in rows_of(found) if x[0] == 1800]
    assert [x[2] for x in copy] == [1800, 1801, 1802, 1803, 1804]
    assert spark.read.parquet(f"{tmp_path}/ix/entries").agg(F.sum("n")).first()[0] == len(m)


def test_index_of_nothing(spark, tmp_path):
    none = vector_table(spark, np.empty((0, 3)))
    index = VectorIndex.build(none, f"{tmp_path}/ix")
    assert index.search(vector_table(spark, np.ones((2, 3))), 3).count() == 0
    one = VectorIndex.build(vector_table(spark, np.ones((1, 3))), f"{tmp_path}/one")
    assert rows_of(one.search(vector_table(spark, np.ones((2, 3))), 3)) == [(0, 1, 0, 1.0), (1, 1, 0, 1.0)]
    with pytest.raises(ValueError, match="k must"):
        one.search(none, 101)
