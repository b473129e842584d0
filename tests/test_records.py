"""Staged shards of JSON lines, read as a stream of records."""

import gzip
import json

from tesserae.sources.records import FIELDS, first_records


def test_shards_are_read_in_order_up_to_a_limit(spark, tmp_path):
    folder = tmp_path / "shards"
    folder.mkdir()
    items = [{"title": f"t{i}", "text": f"text {i}\nüber", "domain": "d", "extra": i, "date": None, "url": ["a", 1]} for i in range(2500)]
    for n, (a, b) in enumerate(((0, 1200), (1200, 1201), (1201, 2500))):
        lines = "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in items[a:b])
        if n == 2:
            (folder / "part-2.jsonl.gz").write_bytes(gzip.compress((lines + "\n  \nnot json\n[1]\n").encode()))
        else:
            (folder / f"part-{n}.jsonl").write_text(lines, encoding="utf-8")
    (folder / "_SUCCESS").write_text("")
    every = first_records(spark, str(folder), "cc_news")
    assert every.columns == ["shard", "line", *FIELDS["cc_news"], "rest"] and every.rdd.getNumPartitions() == 3
    rows = every.orderBy("shard", "line").collect()
    assert [r["title"] for r in rows] == [f"t{i}" for i in range(2500)] + [None, None] and [r["rest"] for r in rows[-2:]] == ["not json", "[1]"]
    assert (rows[7]["text"], rows[7]["url"], rows[7]["date"], rows[7]["rest"]) == ("text 7\nüber", '["a", 1]', None, '{"extra": 7}')
    for n in (0, 1, 1200, 1201, 1205, 9999):
        assert [r["title"] for r in first_records(spark, f"file://{folder}", "cc_news", n).collect()] == [r["title"] for r in rows[:n]]
    assert first_records(spark, str(folder), "japanese_text", 3).select("id", "text").collect()[0]["id"] is None


def test_an_empty_folder(spark, tmp_path):
    assert first_records(spark, str(tmp_path), "livedoor").count() == 0
