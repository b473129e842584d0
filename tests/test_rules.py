"""Relations, template pairs and the rule pipeline against plain versions of the whole operators."""

import random
import re
import time

from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import keywords, qa
from tesserae.plans import pipelines
from tests.test_operators import PATTERNS


def relations_plainly(words, text):
    out = {}
    for said in re.split("[。！？.!?]", text):
        held = [w for w in words if w in said]
        if not said.strip() or len(held) < 2:
            continue
        kind = next((k for p, k in PATTERNS if re.search(p, said)), "co_occurs")
        if kind == "co_occurs":
            pairs = [(a, b) for i, a in enumerate(held) for b in held[i + 1 :]]
        else:
            pairs = [(a, b) if said.index(a) < said.index(b) else (b, a) for a, b in zip(held, held[1:])]
        for a, b in pairs:
            out.setdefault((a, b, kind), said.strip())
    return out


def random_texts(seed, n):
    r = random.Random(seed)
    parts = ["は", "である", "を", "する", "により", "が", "から", "へ", "による", "猫", "犬", "鳥", "猫犬", "。", ".", " ", "\n"]
    return ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(n)]


def test_relations_match_a_plain_version(spark):
    texts = [*random_texts(6, 400), "データは情報と知識と技術である", None, ""]
    words = ["犬", "データ", "猫", "技術", "情報", "猫犬", "知識", "鳥"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = docs.select("doc_id").crossJoin(spark.createDataFrame(list(enumerate(words)), "first int, word string"))
    got = keywords.relations(rows, docs).collect()
    assert {(r["doc_id"], r["source"], r["target"], r["relation_type"]): r["context"] for r in got} == {(i, *k): v for i, t in enumerate(texts) for k, v in relations_plainly(words, t or "").items()}
    order = sorted((r for r in got), key=lambda r: (r["doc_id"], r["place"]))
    assert [(r["doc_id"], r["source"], r["target"], r["relation_type"]) for r in order] == [(i, *k) for i, t in enumerate(texts) for k in relations_plainly(words, t or "")]
    assert sum(r["relation_type"] == "is_a" for r in got if r["doc_id"] == 400) == 3


def test_template_pairs_name_the_first_related_words(spark):
    texts = [*random_texts(8, 120), "データは情報と知識と技術である。データと技術。"]
    words = ["データ", "技術", "情報", "知識", "犬", "猫", "鳥"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = docs.select("doc_id").crossJoin(spark.createDataFrame(list(enumerate(words)), "first int, word string"))
    asked = rows.select("doc_id", "word", F.lit("intermediate").alias("difficulty"), F.lit("other").alias("category"), F.lit("hint").alias("answer_hint"), F.lit("q1").alias("question_1"), F.lit("q2").alias("question_2"), F.lit("2").alias("suggested_length"))
    got = {(r["doc_id"], r["word"]): r["answer"] for r in qa.template_pairs(asked, keywords.relations(rows, docs)).collect()}
    for i, t in enumerate(texts):
        rel = list(relations_plainly(words, t))
        for w in words:
            near = [b if a == w else a for a, b, _ in rel if w in (a, b)][:2]
            assert got[i, w] == ("hint 関連する概念として、" + "、".join(near) + "があります。" if near else "hint")


def test_most_frequent_words(spark):
    r = random.Random(3)
    data = [(r.choices("abcdef", k=r.randint(0, 20)),) for _ in range(300)]
    got = spark.createDataFrame(data, "w array<string>").select("w", qa.most_frequent(F.col("w"), 2).alias("best")).collect()
    assert all(x["best"] == sorted(dict.fromkeys(x["w"]), key=lambda w: (-x["w"].count(w), x["w"].index(w)))[:2] for x in got)


def test_japanese_rules_take_time_in_proportion(spark):
    took = []
    for n in (1, 4):
        text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(15_000 * n))
        began = time.time()
        assert qa.rule_qa_ja(spark.createDataFrame([(text,)], "chunk string")).count() == 4
        took.append(time.time() - began)
    assert took[1] < 8 * max(took[0], 1)




def test_rule_pipeline_tops_up_by_number(spark):
    r = random.Random(9)
    names = ["The Green River", "Old Stone", "New Harbor", "Long Winter", "Red Field"]
    docs = [(i, ". ".join(f"{r.choice(names)} was seen by {r.randint(10, 99)} of the {r.choice(names)} and it is far away" for _ in range(r.randint(1, 25)))) for i in range(40)]
    df = spark.createDataFrame(docs + [(None, docs[0][1]), (77, None), (78, "")], "doc_id bigint, text string")
    chunks = sorted((x for x in pipelines.chunks_of(df).collect()), key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0, x["chunk_idx"]))
    total, most, further = len(chunks), 12, 5
    assert total > 3 * most
    step = total // most
    taken = list(range(0, total, step))[:most]

    def pairs_of(places, per_chunk):
        one = spark.createDataFrame([(k, chunks[k]["chunk"]) for k in places], "k int, chunk string")
        return sorted((x["k"], x["qa_idx"], x["question"], x["answer"]) for x in qa.rule_qa_both(one, per_chunk).collect())

    first = {}
    for k, i, q, a in pairs_of(taken, 4):
        first.setdefault(q[:30], (k, q, a))
    want = list(first.values())
    assert len(want) < 2 * total
    want += [(k, q, a) for k, _, q, a in pairs_of(range(len(taken), len(taken) + further), 2)]
    got = pipelines.rule_pipeline(df, 4, most, further=further)
    assert sorted((x["global_idx"], x["question"], x["answer"]) for x in got.collect()) == sorted(want)
    every = pipelines.rule_pipeline(df, 4, 10_000)
    assert every.groupBy(F.substring("question", 1, 30)).count().filter("count > 1").count() == 0


def test_qa_extraction_plans_filters_and_chooses(spark):
    said = "機械学習はデータから規則を見つける技術である。深層学習は機械学習の一つである。BERTとGPTは言語モデルと呼ばれる。データは重要。問題が多い。" * 3
    docs = spark.createDataFrame([(1, said), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (3, ""), (4, None)], "doc_id bigint, text string")
    chosen, relations = pipelines.qa_extraction(docs)
    got = chosen.collect()
    planned = {r["doc_id"]: r["optimal_count"] for r in qa.planned_count(qa.document_metrics(docs)).collect()}
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {1, 2} and all(0 < len(v) <= planned[i] for i, v in by.items())
    words = {r["word"] for r in by[1]}
    assert not words & {"問題", "重要", "技術"}  # unfit for questions
    assert all(r["question_1"].startswith(r["word"]) and r["difficulty"] in pipelines.DIFFICULTIES for r in got)
    assert {r["doc_id"] for r in relations.collect()} <= {1, 2} and relations.filter("relation_type <> 'co_occurs'").count() > 0
    few, _ = pipelines.qa_extraction(docs, n_pairs=1)
    assert few.groupBy("doc_id").count().filter("count > 1").count() == 0


def test_metrics_and_plan_of_a_sentence_longer_than_an_int_squared(spark):
    docs = spark.createDataFrame([(1, "x" * 50_000 + ". " + "y" * 50_000)], "doc_id bigint, text string")
    metrics = qa.document_metrics(docs)
    assert metrics.first()["complexity"] == 0.0 and metrics.first()["sentence_count"] == 2
    assert qa.planned_count(metrics).first()["optimal_count"] == 32


def test_metrics_and_plan_of_a_text_with_a_long_gap_take_linear_time(spark):
    docs = spark.createDataFrame([(1, " a" + " " * 200_000 + "b \u3000. \n\u2003\u0085c\n. \n\u2028 ")], "doc_id bigint, text string")
    began = time.time()
    plan = qa.planned_count(qa.document_metrics(docs)).first()
    assert (plan["sentence_count"], plan["base_count"], plan["adjusted_count"], plan["optimal_count"]) == (2, 30, 21, 50)  # both lengths differ as much as can be: complexity just under 0.3
    assert time.time() - began < 60


def test_definitions_are_trimmed_and_filled_as_in_the_sql(spark):
    docs = spark.createDataFrame([(1, "\u3000{b}とは\u00a0猫\u2003である。x{a}は{b}と呼ばれ")], "doc_id bigint, text string")
    assert {(r["question"], r["answer"]) for r in qa.definitions(docs).collect()} == {("{b}とは何ですか？", "{b}とは猫です。"), ("x{a}は何と呼ばれますか？", "{b}と呼ばれます。")}


def test_concepts_of_any_length(spark):
    """A long run of capitalised words took the stack of the task, and with it the executor."""
    r = random.Random(9)
    parts = ["Abc", "De", "A", "B", "ab", "c", " ", "  ", "\n", "1", "_", ".", "か", "ö"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 30))) for _ in range(3000)]
    plain = re.compile(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", re.ASCII)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.candidates(F.col("t"), T.CONCEPT).alias("got")).collect()
    assert all(x["got"] == plain.findall(x["t"]) for x in rows) and sum(len(x["got"]) for x in rows) > 300
    long = "the cat is here and " + "Abc " * 50_000
    got = qa.rule_qa(spark.createDataFrame([(1, long)], "doc_id int, chunk string")).collect()
    assert "What is mentioned about " + ("Abc " * 50_000).strip() + "?" in [x["question"] for x in got]
