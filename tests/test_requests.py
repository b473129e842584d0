"""Every kind of request round-tripped, with odd replies, and batches of documents with results missing."""

import json

from tesserae.operators import requests
from tesserae.operators.generation import Ledger
from tests.test_generation import Counting

DOCS = [(1, "a text about tides"), (2, "fenced text"), (3, "odd text"), (4, " "), (5, None), (6, "x" * 5000)]


def reply(prompt):
    pair = {"question": "q?", "answer": "a", "question_type": "reply's own", "difficulty": "easy", "source_span": "span", "reasoning": "because", "confidence": 0.5, "more": [1]}
    said = json.dumps({"analysis": {"main_topics": ["t"]}, "qa_pairs": [pair, {"question": None, "answer": "x"}, pair | {"question": "second"}]})
    return "not JSON at all" if "odd" in prompt else f"```json\n{said}\n```" if "fenced" in prompt else said


def test_kinds_of_requests(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    for kind, n_topics in (("basic", 1), ("diverse", 6), ("reasoned", 1)):
        folder = tmp_path / kind
        folder.mkdir()
        writer, ledger = Counting(folder, reply), Ledger(spark)
        got = requests.asked(docs, kind, writer, ledger, wait=0).collect()
        assert len(writer.calls()) == 4 * n_topics
        assert {(r["doc_id"], r["ordinal"]) for r in got} == {(i, k) for i in (1, 2, 6) for k in (0, 2)} and len(got) == 3 * 2 * n_topics
        one = next(r for r in got if r["doc_id"] == 1 and r["ordinal"] == 0)
        assert (one["difficulty"], one["source_span"]) == (("easy", "span") if kind == "basic" else (None, None))
        assert (one["reasoning"], one["confidence"]) == (("because", 0.5) if kind == "reasoned" else (None, None))
        assert {r["question_type"] for r in got} == {"basic": {"reply's own"}, "diverse": set(requests.SORTS), "reasoned": {None}}[kind]
        longest = max(len(p) for p in writer.calls())
        assert longest > 5000 if kind == "reasoned" else longest < 3500
        requests.asked(docs, kind, writer, ledger, wait=0).collect()
        assert len(writer.calls()) == 4 * n_topics


def test_documents_in_batches(spark, tmp_path):
    def results(prompt):
        shown = json.loads(prompt[prompt.index("[{") :])
        texts = [d["text"] for d in shown]
        if "broken 7" in texts:
            return '{"results": ['
        n = len(shown) - ("short 4" in texts)
        return json.dumps({"results": [{"document_id": 99, "qa_pairs": [{"question": f"about {t}", "answer": "a"}, {"question": "", "answer": "b"}]} for t in texts[:n]]})

    texts = ["doc 0", "doc 1", "doc 2", "doc 3", "short 4", "doc 5", "broken 7", "doc 8", "doc 9", "doc 10"]
    docs = spark.createDataFrame([(i, t, ["w"] * 9 if i else None) for i, t in enumerate(texts)], "doc_id bigint, text string, words array<string>")
    fallback = spark.createDataFrame([(i, k, f"rule {i} {k}", "hint") for i in range(10) for k in range(2)], "doc_id bigint, ordinal int, question string, answer string")
    writer = Counting(tmp_path, results)
    got = requests.enhanced(docs.repartition(4), fallback, writer, Ledger(spark), 3, wait=0).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["question"], r["source"], r["tokens_used"] > 0))
    assert {i: [q for q, *_ in v] for i, v in by.items() if v[0][1] == "written"} == {i: [f"about {texts[i]}"] for i in (0, 1, 2, 3, 4, 9)}
    assert all(t for v in by.values() for _, s, t in v if s == "written") and not any(t for v in by.values() for _, s, t in v if s == "rules")
    assert {i: sorted(q for q, *_ in v) for i, v in by.items() if v[0][1] == "rules"} == {i: [f"rule {i} 0", f"rule {i} 1"] for i in (5, 6, 7, 8)}
    assert len(writer.calls()) == 4 and all('"keywords":["w","w","w","w","w"]' in p for p in writer.calls())
