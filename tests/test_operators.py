"""Operators on small tables with nulls, ties and empties, and independence of partitioning."""

import json
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions.keywords import STOPWORDS
from tesserae.operators import keywords, qa, replies, store, tables, vectors
from tesserae.operators.costs import cost
from tesserae.plans import pipelines
from tesserae.providers import HashedNgrams, budgeted, embedded, written
from tesserae.sinks import writers
from tesserae.sources import readers
from tesserae.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keep_first_and_nulls(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (5, None), (4, "b")], "i int, k string")
    assert rows(tables.keep_first(df, ["k"], "i")) == [(1, "a"), (2, None), (4, "b")]
    assert rows(tables.keep_first(df.repartition(7), ["k"], "i")) == rows(tables.keep_first(df.coalesce(1), ["k"], "i"))


def test_qa_table_headers(spark):
    df = spark.createDataFrame([(0, "q", "a"), (1, "q", "a"), (2, None, "b")], "ordinal int, Question string, Response string")
    assert rows(tables.qa_table(df, "ordinal")) == [(0, "q", "a"), (2, "", "b")]
    with pytest.raises(ValueError, match="answer"):
        tables.qa_table(df.drop("Response"), "ordinal")


def test_profiles_of_empty_tables(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert rows(tables.column_profile(empty)) == [("a", "string", 0, 0, 0), ("b", "int", 0, 0, 0)]
    assert tables.retention(empty, empty).first()["rate"] == 0
    assert tables.validate(empty, ["A", "x"]).first()["missing"] == "x"
    assert tables.validate_text(empty, "a", long=F.length("a") > 3).first()["pct_long"] == 0


def test_keywords_ties_and_redundancy(spark):
    docs = spark.createDataFrame([(1, "beta alpha beta alpha gamma"), (2, ""), (3, None)], "doc_id int, text string")
    assert [r["word"] for r in keywords.top_by_frequency(docs, 2).orderBy("rank").collect()] == ["beta", "alpha"]
    words = spark.createDataFrame([(1, "AI"), (1, "人工知能"), (1, "知能"), (1, "機械")], "doc_id int, word string")
    assert {r["word"] for r in keywords.without_redundant(words).collect()} == {"人工知能", "機械"}


def test_keyword_relations_and_coverage(spark):
    docs = spark.createDataFrame([(1, "猫は動物である。犬と猫")], "doc_id int, text string")
    words = spark.createDataFrame([(1, "猫", 0), (1, "動物", 1), (1, "犬", 2)], "doc_id int, word string, first int")
    assert {(r["source"], r["target"], r["relation_type"]) for r in keywords.relations(words, docs).collect()} == {("猫", "動物", "is_a"), ("猫", "犬", "co_occurs")}
    overlap = spark.createDataFrame([(1, "aaab")], "doc_id int, text string")
    assert keywords.char_coverage(spark.createDataFrame([(1, "aa"), (1, "ab")], "doc_id int, word string"), overlap).first()["coverage"] == 1.0


def test_rule_qa_order(spark):
    chunk = "Alpha Beta went to the market today. then came a longer plain sentence here. Gamma was found in the garden"
    out = qa.rule_qa(spark.createDataFrame([(1, chunk)], "doc_id int, chunk string"), 10).orderBy("qa_idx").collect()
    assert [r["type"] for r in out] == ["comprehensive", "factual_detailed", "keyword_based", "factual_detailed", "contextual", "factual_detailed", "contextual", "keyword_based", "thematic"]
    assert out[1]["question"] == "What specific information is provided about Alpha Beta?"
    assert qa.rule_qa(spark.createDataFrame([(1, "short")], "doc_id int, chunk string"), 4).count() == 0
    ja = qa.rule_qa_ja(spark.createDataFrame([(1, "機械学習は大量のデータからモデルを作る技術の総称である。短い。")], "doc_id int, chunk string"), 4)
    assert {r["type"] for r in ja.collect()} == {"factual_detailed", "keyword_based"}


def test_prefix_dedup_at_its_border(spark):
    base = "x" * 29
    df = spark.createDataFrame([(1, base + "a1"), (2, base + "a2"), (3, base + "b1")], "i int, question string")
    assert [r["i"] for r in qa.first_of_prefix(df, ["i"]).orderBy("i").collect()] == [1, 3]


def test_japanese_rules(spark):
    docs = spark.createDataFrame([(1, "深層学習とは機械学習の一種である。これは転移と呼ばれる。果物には、りんご、みかん、ぶどうがある。")], "doc_id int, text string")
    assert {r["type"] for r in qa.definitions(docs).collect()} == {"definition", "terminology"}
    assert qa.enumerations(docs).first()["items"] == ["りんご", "みかん", "ぶどう"]


def test_similar_questions_match_all_pairs(spark):
    q = ["a b c d", "a b c d e", "a b c x", "a b c d", "", "z", "b c d e a f"]
    df = spark.createDataFrame(list(enumerate(q)), "i int, question string")
    got = {(r["a"], r["b"]) for r in qa.similar_questions(df, "i").collect()}
    first = {t: i for i, t in reversed(list(enumerate(q)))}
    sets = {i: set(t.split()) for t, i in first.items()}
    want = {(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.7}
    assert got == want


def test_vectors(spark):
    data = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0, 0.0]), (5, [0.6, 0.8])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    assert [r["vec_id"] for r in vectors.top_k(df, [1.0, 0.0], 3).collect()] == [1, 4, 5]
    near = {(r["id"], r["other"]) for r in vectors.nearest(df, df.filter("vec_id > 1"), 1).collect()}
    assert {(1, 4), (5, 5), (2, 2), (3, 3)} <= near
    best = vectors.best_match(df, df.filter("vec_id = 3"), clamp=True)
    assert min(r["max_sim"] for r in best.collect()) == 0
    assert [r["covered"] for r in vectors.coverage_levels(best).collect()] == [1, 1, 1]
    assert sum(r["n"] for r in vectors.accuracy_buckets(spark.createDataFrame([(80.0,), (10.0,)], "similarity double")).collect()) == 2


def test_costs(spark):
    out = cost(spark.createDataFrame([("gpt-4o", 1000, 1000), ("??", 1000, 0)], "model string, input_tokens bigint, output_tokens bigint"))
    assert {r["model"]: r["cost"] for r in out.collect()} == {"gpt-4o": 0.02, "??": 0.00015}


def test_collections(spark, tmp_path):
    c = store.Collections(spark, str(tmp_path))
    make = lambda ids, d: spark.createDataFrame([(i, [1.0], d, "q", "a") for i in ids], "point_id bigint, vector array<double>, domain string, question string, answer string")
    c.upsert("one", make(range(3), "x"))
    c.upsert("one", make([2, 3], "y"))
    c.upsert("two", make([1], "x"))
    assert c.counts() == {"one": 4, "two": 1} and c.info("one")["vector_size"] == 1
    assert c.delete_domain("one", "x", dry_run=True) == 2 and c.delete_domain("one", "x") == 2
    assert c.counts()["one"] == 2 and c.truncate("one") == 2 and c.counts()["one"] == 0
    assert c.drop_all(["two"]) == ["one"] and c.names() == ["two"]


def test_readers_and_writers(spark, tmp_path):
    qa_rows = spark.createDataFrame([(0, 'a "q"\nline', "x"), (1, "b", "y"), (2, "b", "y")], "ordinal int, question string, answer string")
    writers.unified(qa_rows, str(tmp_path / "qa"))
    back = readers.qa_csv(spark, str(tmp_path / "qa"))
    assert {(r["question"], r["answer"]) for r in back.collect()} == {('a "q"\nline', "x"), ("b", "y")}
    news = tmp_path / "news" / "sport"
    news.mkdir(parents=True)
    (news / "s-1.txt").write_text("http://x\n2020-01-01\nTitle\nbody\nmore\n", encoding="utf-8")
    (news / "LICENSE.txt").write_text("a\nb\nc\nd", encoding="utf-8")
    (news / "s-2.txt").write_text("only", encoding="utf-8")
    assert rows(readers.news_folder(spark, str(tmp_path / "news"))) == [("http://x", "2020-01-01", "Title", "body\nmore", "sport")]
    (tmp_path / "ja.txt").write_text("これは文。\n\nもう一つ。", encoding="utf-8")
    assert readers.text_chunks(spark, str(tmp_path / "ja.txt")).first()["chunk"] == "これは文。\n\nもう一つ。"
    writers.preprocessed(spark.createDataFrame([("a\nb",), (" ",)], "combined_text string"), str(tmp_path / "out"), "set")
    assert spark.read.text(str(tmp_path / "out" / "set_txt")).first()[0] == "a b"
    writers.jsonl(spark.createDataFrame([("1", "t", 9)], "id string, text string, x int"), str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).columns == ["id", "text"]
    assert readers.newest_file(spark, str(tmp_path / "ja.txt")).first()["path"].endswith("ja.txt")


def test_extraction_modes(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta " * 30), (2, ""), (3, "tiny words")], "doc_id int, text string")
    n = lambda mode: {r["doc_id"]: r["count"] for r in keywords.extract(docs, mode).groupBy("doc_id").count().collect()}
    assert n("tag") == {1: 3, 3: 2} and n("auto")[3] == 2 and n("auto")[1] == 8
    assert 0 < n("coverage")[1] <= 8 and 0 < n("diminishing")[1] <= 8
    with pytest.raises(ValueError):
        keywords.extract(docs, "?")
    assert pipelines.progressive(docs).count() > 0


class Echo:
    def write(self, prompt):
        return '{"qa_pairs": [{"question": "q", "answer": "' + prompt + '", "question_type": "fact"}]}' if prompt != "bad" else "?"


def test_providers(spark):
    assert list(budgeted(["a" * 40, "", "b" * 40, "c"], 11)) == [[0], [2, 3]]
    with pytest.raises(ValueError):
        list(budgeted(["a" * 400], 10))
    out = {r["i"]: r["embedding"] for r in embedded(spark.createDataFrame([(1, "hello"), (2, " "), (3, None)], "i int, t string"), HashedNgrams(8), "i", "t").collect()}
    assert math.isclose(sum(x * x for x in out[1]), 1) and set(out[2]) == set(out[3]) == {0.0}
    assert rows(written(spark.createDataFrame([(1, "p"), (2, "bad")], "i int, p string"), Echo(), "i", "p")) == [(1, 0, "q", "p", "fact")]


def test_pipelines(spark):
    docs = spark.createDataFrame([(i, f"Alpha number {i} is a rather long sentence here. " * 8 + "Beta follows it with more words. ") for i in range(4)], "doc_id bigint, text string")
    pairs = pipelines.rule_pipeline(docs)
    assert pairs.count() > 0
    done = pipelines.covered(pipelines.chunks_of(docs), pairs)
    assert all(0 <= r["max_sim"] <= 1 for r in done.collect())
    assert pipelines.feedback(docs, rounds=1).count() > 0
    points = store.points(pairs.withColumn("embedding", F.array(F.lit(1.0))), "d", "rules", "s", "now").select("point_id", "answer", "question")
    stored = embedded(points, HashedNgrams(), "point_id", "question").withColumnRenamed("embedding", "vector").join(points, "point_id")
    scored = pipelines.accuracy(pairs.select("question", "answer").distinct(), stored)
    assert all(r["search_score"] > 0.99 for r in scored.collect())


def test_streaming_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.unionAll(src).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.tumbling(ingest.unique(ingest.read(spark, str(tmp_path / "in"), src.schema), late="40 days"))
    q = stream.writeStream.outputMode("append").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbled").columns == ["start", "event_type", "n", "total"]


def test_rules_take_every_document(spark):
    rows = [(1, "The river was long and it is known to all of them. It ran for many miles to the sea."), (2, "Der Fluss war lang und alle kannten ihn seit vielen Jahren."), (3, "機械学習は大量のデータからモデルを作る技術の総称である。短い。"), (4, None)]
    out = qa.rule_qa_both(spark.createDataFrame(rows, "doc_id int, chunk string"), 4).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 3}
    assert {r["doc_id"] for r in out if "「" in r["question"] or "この" in r["question"]} == {2, 3}


def test_whole_table_queries(spark):
    import tesserae.plans.queries_text  # noqa: F401
    from tesserae.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    top = {}
    for r in keywords.top_by_frequency(spark.read.parquet(f"{sf}/documents.parquet"), 5).collect():
        top.setdefault(r["doc_id"], []).append(r["word"])
    got = {r["doc_id"]: r["covered"] for r in QUERIES["keyword_char_coverage_all"](spark, sf).collect()}
    want = {i: len({c for w in top.get(i, []) for a in range(len(t)) if t.startswith(w, a) for c in range(a, a + len(w))}) for i, t in texts.items()}
    assert got == want


PATTERNS = (
    (r"(.+?)は(.+?)である", "is_a"), (r"(.+?)は(.+?)を(.+?)する", "uses"), (r"(.+?)により(.+?)が(.+?)", "enables"), (r"(.+?)のため(.+?)を", "for"),
    (r"(.+?)を用いて(.+?)を", "uses"), (r"(.+?)から(.+?)へ", "transforms"), (r"(.+?)における(.+?)", "in_context"), (r"(.+?)による(.+?)", "by_means_of"),
)


def test_relation_names_follow_the_patterns(spark):
    r = random.Random(2)
    parts = ["は", "である", "を", "する", "により", "が", "のため", "を用いて", "から", "へ", "における", "による", "a", "b", "\n"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 9))) for _ in range(800)]
    named = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", keywords._relation(F.col("s")).alias("k")).collect()
    assert {x["i"]: x["k"] for x in named} == {i: next((k for p, k in PATTERNS if re.search(p, t)), "co_occurs") for i, t in enumerate(texts)}


def test_definitions_follow_the_patterns(spark):
    r = random.Random(4)
    parts = ["とは", "である", "です", "は", "と呼ばれ", "。", "には、", "に、", "では、", "、", "がある", "があります", "が含まれ", "a", "b", " "]
    texts = ["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for known, inside in ((qa.DEFINED, ""), (qa.CALLED, ""), (qa.LISTED, "、")):
        out = docs.select("doc_id", qa._matches(F.col("text"), *known, inside=inside).alias("m")).collect()
        assert {x["doc_id"]: [tuple(m) for m in x["m"]] for x in out} == {i: re.findall(known[0], t) for i, t in enumerate(texts)}


def test_long_texts_without_sentence_ends(spark):
    long = ["x" * 100_000, "xは" * 50_000, "とは" * 50_000, "xとはyです" + "z" * 100_000, "には、" * 30_000, "xには、y、z" * 10_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id int, text string")
    began = time.time()
    assert qa.definitions(docs).count() >= 1 and qa.enumerations(docs).count() == 0
    words = spark.createDataFrame([(i, w, p) for i in range(6) for p, w in enumerate(("x", "は"))], "doc_id int, word string, first int")
    assert keywords.relations(words, docs).count() == 3
    assert time.time() - began < 60


def test_few_frequent_words_are_filled_up(spark):
    texts = ["a b a データ", "猫 a x1 x1 は 学習", "", None, "AB CD AB EF GH IJ KL", "する こと"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    wide, stop = r"[ァ-ヴー]+|[一-龥]{2,}|[A-Za-z]+[A-Za-z0-9]*", set(STOPWORDS)
    want = set()
    for i, t in enumerate(texts):
        every = re.findall(wide, t or "")
        good = [w for w in every if w not in stop and len(w) > 1]
        best = sorted(dict.fromkeys(good), key=lambda w: (-good.count(w), good.index(w)))[:5]
        best += [w for w in every if w not in best][: max(0, 3 - len(best))]
        want |= {(i, k, w) for k, w in enumerate(best)}
    assert set(rows(keywords.frequent_or_first(docs))) == want


def test_per_document_coverage_with_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    r = np.random.default_rng(3)
    left, right = r.normal(size=(60, 4)), r.normal(size=(50, 4))
    left[3] = 0
    a = spark.createDataFrame([(i % 3, i, v.tolist()) for i, v in enumerate(left)] + [(0, 90, None), (None, 91, [1.0] * 4), (7, 92, [1.0] * 4)], "doc_id int, vec_id long, embedding array<double>")
    b = spark.createDataFrame([(i % 3, i, v.tolist()) for i, v in enumerate(right)] + [(1, 99, None)], "doc_id int, vec_id long, embedding array<double>")
    got = {x["chunk_id"]: x["max_sim"] for x in vectors.best_per_document(a, b, "doc_id").collect()}
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    sims = np.round(unit(left) @ unit(right).T, 6)
    want = {i: max(0.0, max(sims[i][j] for j in range(50) if j % 3 == i % 3)) for i in range(60)} | {90: 0.0, 91: 0.0, 92: 0.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


class Told:
    """A writer of one pair a request, or of none that can be read."""

    def write(self, prompt: str) -> str:
        return "no JSON" if "broken" in prompt else json.dumps({"qa_pairs": [{"question": "What is this?", "answer": prompt.rsplit("\n\n", 1)[1], "question_type": "fact"}]})


def test_hybrid_pairs_and_coverage(spark):
    docs = spark.createDataFrame([(1, "Alpha Beta Gamma are letters. Beta follows Alpha."), (2, "broken Words here. More broken Words."), (3, ""), (4, None)], "doc_id long, text string")
    pairs, coverage = pipelines.hybrid(docs, 3)
    asked = {}
    for x in pairs.collect():
        asked.setdefault(x["doc_id"], []).append(x["question"])
    assert set(asked) == {1, 2} and all(len(v) == 6 for v in asked.values())
    assert {x["doc_id"]: (x["n_chunks"], x["threshold"]) for x in coverage.collect()} == {1: (1, 0.7), 2: (1, 0.7)}
    pairs, coverage = pipelines.hybrid(docs, 3, writer=Told())
    assert [(x["doc_id"], x["source"]) for x in pairs.collect()] == [(1, "written")]
    rate = {x["doc_id"]: x["rate"] for x in coverage.collect()}
    assert rate == {1: 1.0, 2: 0.0}


def test_thresholds_follow_the_marks(spark):
    pairs = spark.createDataFrame([(1, "x"), (1, "文書内で述べられています"), (2, "x"), (3, None)], "doc_id int, answer string")
    assert set(rows(qa.coverage_threshold(pairs))) == {(1, 0.4), (2, 0.7), (3, 0.7)}


def test_comprehensive_pairs_are_valid_and_asked_once(spark):
    docs = spark.createDataFrame([(1, "猫とは動物である。猫とは動物である。データ分析とは情報を読む技術です。"), (2, ""), (3, None)], "doc_id long, text string")
    out = pipelines.comprehensive(docs, 5, writer=Told()).collect()
    assert len({x["question"] for x in out}) == len(out) and {x["doc_id"] for x in out} <= {1}
    assert all(x["quality_score"] == 1.0 for x in out) and [x["place"] for x in sorted(out, key=lambda x: x["place"])] == list(range(1, len(out) + 1))


def test_replies_that_are_odd(spark):
    odd = [(1, None), (2, "no JSON"), (3, "{}"), (4, '{"output": null, "output_text": "a"}'), (5, '{"output": [{"type": "message", "content": null}, {"type": "message"}], "extra": 1}'), (6, '{"output": [{"type": "message", "content": [{"type": "output_text", "text": "b", "annotations": null}, {"type": "refusal"}]}]}')]
    d = spark.createDataFrame(odd, "id int, reply string")
    assert {x["id"]: x["texts"] for x in replies.fields(d).collect()} == {1: [], 2: [], 3: [], 4: ["a"], 5: [], 6: ["b"]}
    assert replies.citations(d).count() == replies.tool_calls(d).count() == 0
    assert replies.fields(d.limit(0)).count() == 0
