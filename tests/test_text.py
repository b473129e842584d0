"""Column functions and chunkers against hand-computed results, Japanese texts included."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import keywords as K
from tesserae.functions import text as T
from tesserae.operators import chunking as C


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def test_clean_text(spark):
    assert one(spark, "　a \r\n b　c\t", T.clean_text(F.col("t"))) == "a b c"
    assert one(spark, None, T.clean_text(F.col("t"))) == ""


def test_language(spark):
    assert one(spark, "これは日本語です", T.detect_language(F.col("t"))) == "ja"
    assert one(spark, "plain English", T.detect_language(F.col("t"))) == "en"
    assert one(spark, "", T.detect_language(F.col("t"))) == "en"
    assert one(spark, "x" * 100 + "の", T.is_japanese(F.col("t"))) is False
    assert one(spark, "the cat and the dog are for you", T.is_english(F.col("t"))) is True


def test_token_estimate(spark):
    for text, want in (("", 0), (None, 0), ("a", 1), ("abcdefgh", 2), ("日本語テスト", 3), ("日本ab", 1)):
        assert one(spark, text, T.token_estimate(F.col("t"))) == want
        assert C.tokens(text or "") == want


def test_sentences(spark):
    text = "First one. Second! 第三文。四？ 3.14"
    want = ["First one.", "Second!", "第三文。", "四？ 3.", "14"]
    assert one(spark, text, T.sentences(F.col("t"))) == want == C.sentences(text)
    assert C.sentences("第一？第二", tagged=True) == ["第一？", "第二"]
    assert one(spark, "a\n \nb\n\n　\n\nc", T.paragraphs(F.col("t"))) == ["a", "b", "c"]


def test_keyword_functions(spark):
    df = spark.createDataFrame([("BERT", "BERTとは。BERT BERT"), ("データ基盤", "x"), ("第1", "x"), ("学習等", "x")], "w string, t string")
    rows = df.select(K.difficulty(F.col("w"), F.col("t")).alias("d"), K.category(F.col("w")).alias("c"), K.fit_for_qa(F.col("w")).alias("q")).collect()
    assert [tuple(r) for r in rows[:2]] == [("basic", "specific_name", True), ("intermediate", "general_term", True)]
    assert [r["q"] for r in rows[2:]] == [False, False]


def test_chunk_helpers():
    assert [k for _, k in C.paragraph_chunks("ab. " * 300, 200)] == ["sentence_group"] * 2
    assert [k for _, k in C.paragraph_chunks("x" * 2000, 200)] == ["forced_split"] * 3
    assert C.paragraph_chunks("") == [] and C.semantic_chunks("") == []
    assert C.continued([("a" * 400, "paragraph", 0, 0), ("b", "sentence_group", 0, 0)])[0][1] == "merged"
    assert C.packed_paragraphs("あ。い。\n\nう。", "ja", 500) == ["あ。い。\n\nう。"]
    assert C.packed_paragraphs("One two. Three " + "x" * 40, "en", 8) == ["One two.", "Three " + "x" * 29, "x" * 11]
    assert C.sliding("short") == ["short"] and C.sliding("") == [""]
    assert all(len(c) <= 50 for c in C.sliding("word. " * 100, 50, 10))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .。!\nあ漢", max_size=400), st.integers(5, 40))
def test_chunks_keep_all_characters(text, limit):
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(t for t, _ in C.paragraph_chunks(text, limit))) == squeeze(text)
    assert squeeze("".join(t for t, *_ in C.sentence_groups(text, limit))) == squeeze(text)
    assert squeeze("".join(C.translation_segments(text, limit))) == squeeze(text)
    assert "".join(C.forced(text, limit)) == text and all(C.tokens(f) <= limit for f in C.forced(text, limit))
    for lang in ("ja", "en"):
        assert squeeze("".join(C.packed_paragraphs(text, lang, limit))) == squeeze(text)


def test_merge_small_branches(spark):
    rows = [(1, 0, "a", 100), (1, 1, "b", 100), (1, 2, "c", 300), (1, 3, "d", 140), (1, 4, "e", 140), (1, 5, "f", 140), (2, 0, "g", 10)]
    out = C.merge_small(spark.createDataFrame(rows, "doc_id bigint, chunk_idx bigint, chunk string, tokens bigint"))
    assert sorted((r["doc_id"], r["chunk_span"], r["chunk"]) for r in out.collect()) == [(1, "0-1", "a\n\nb"), (1, "2", "c"), (1, "3-4", "d\n\ne"), (1, "5", "f"), (2, "0", "g")]


def test_running_cut(spark):
    df = spark.createDataFrame([(i, 10) for i in range(100)], "id bigint, size bigint")
    assert sorted(r["id"] for r in C.running_cut(df, ["id"], "size", 1000, 55).collect()) == list(range(6))
    assert C.running_cut(df, ["id"], "size", 9, 10**6).count() == 9
