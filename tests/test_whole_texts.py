"""Rules on late sentences, batches of long texts, folders of small files."""

from tesserae.operators import chunking, qa
from tesserae.sources import readers


def test_rules_find_sentences_behind_many_short_ones(spark):
    long = [f"this sentence number {i} is longer than twenty" for i in range(5)]
    docs = spark.createDataFrame([(1, "the no. " * 200 + ". ".join(long)), (2, "短。" * 200 + "。".join("データと機械学習の文章はとても長い文です" + "あ" * i for i in range(5)))], "doc_id bigint, chunk string")
    got = {(r["doc_id"], r["qa_idx"]): (r["question"], r["answer"]) for r in qa.rule_qa_both(docs, 4).collect()}
    assert got[1, 1][1] == f"{long[0]} {long[1]}" and got[1, 3][1] == f"{long[0]} {long[1]}"
    assert got[2, 1][0].startswith("「データと機械学習") and got[2, 2][0] == "「データ」について何が述べられていますか？" and got[2, 3][0] == "「機械学習」について何が述べられていますか？"


def test_chunks_are_cut_in_bounded_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    docs = spark.createDataFrame([(1, "a b. c d.")], "doc_id bigint, text string")
    assert chunking.chunk_table(docs, chunking.sentence_groups).count() == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"


def test_small_files_share_tasks_and_deeper_ones_do_not_match(spark, tmp_path):
    for i in range(100):
        folder = tmp_path / f"c {i % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"a{i}.txt").write_text(f"u{i}\nd\nt\nbody {i}\n" if i else "日本語の文章です。次の文です。")
    (tmp_path / "c 0" / "deep").mkdir()
    (tmp_path / "c 0" / "deep" / "a.txt").write_text("u\nd\nt\nbody\n")
    (tmp_path / "c 0" / "a.md").write_text("u\nd\nt\nbody\n")
    files = readers.whole_files(spark, f"{tmp_path}/*/*.txt")
    assert files.count() == 100 and files.rdd.getNumPartitions() <= 8
    news = readers.news_folder(spark, str(tmp_path))
    assert news.count() == 99 and {r["content"] for r in news.collect()} == {f"body {i}" for i in range(1, 100)}
    assert readers.text_chunks(spark, f"{tmp_path}/*/*.txt").count() == 100
