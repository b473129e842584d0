"""Collections change by parts: what is not touched keeps its files, and reads begun before a change end well."""

import glob

import pytest

from tesserae.operators.store import Collections

SCHEMA = "point_id bigint, vector array<double>, domain string, question string, answer string"


def points(spark, ids, domain, question="q"):
    return spark.createDataFrame([(i, [1.0, 2.0], domain, question, "a") for i in ids], SCHEMA)


def files(root, name="c"):
    return {f.split("/points/")[1] for f in glob.glob(f"{root}/{name}/points/**/*.parquet", recursive=True)}


def content(df):
    return sorted((r["point_id"], r["domain"], r["question"]) for r in df.collect())


def test_a_change_touches_its_parts_only(spark, tmp_path):
    c = Collections(spark, str(tmp_path), buckets=8)
    c.write("c", points(spark, range(100), "x").unionAll(points(spark, range(100, 200), "y/z=é %")).unionAll(points(spark, [900], None)))
    before, running = files(tmp_path), c.read("c")
    c.upsert("c", points(spark, [7, 1000], "x", "new"))
    after = files(tmp_path)
    assert before <= after and 1 <= len({f.rsplit("/", 2)[0] for f in after - before}) <= 2 and all("domain=x/" in f for f in after - before)
    want = {i: ("x", "q") for i in range(100)} | {i: ("y/z=é %", "q") for i in range(100, 200)} | {900: (None, "q"), 7: ("x", "new"), 1000: ("x", "new")}
    key = lambda v: (v[0], str(v[1]), v[2])
    assert sorted(((r["point_id"], r["domain"], r["question"]) for r in c.read("c").collect()), key=key) == sorted(((i, *v) for i, v in want.items()), key=key)
    assert running.count() == 201 and running.filter("question = 'new'").count() == 0
    assert c.vacuum("c") >= 1 and c.read("c").count() == 202 and len(files(tmp_path)) < len(after)


def test_points_move_between_domains_and_parts_run_empty(spark, tmp_path):
    c = Collections(spark, str(tmp_path), buckets=4)
    c.upsert("c", points(spark, [1], "x"))
    c.upsert("c", points(spark, [1], "y"))
    assert content(c.read("c")) == [(1, "y", "q")] and content(c.read("c", 1)) == [(1, "x", "q")]
    c.upsert("c", points(spark, [], "x"))
    assert content(c.read("c")) == [(1, "y", "q")]
    assert c.delete_domain("c", "x") == 0 and c.delete_domain("c", "y") == 1 and c.read("c").count() == 0
    c.upsert("c", points(spark, [5], "x"))
    assert c.truncate("c") == 1 and c.counts() == {"c": 0} and c.info("c")["vector_size"] is None


def test_deleting_a_domain_writes_no_points(spark, tmp_path):
    c = Collections(spark, str(tmp_path))
    c.write("c", points(spark, range(30), "x").unionAll(points(spark, range(30, 60), "y")))
    before = files(tmp_path)
    assert c.delete_domain("c", "x", dry_run=True) == 30 == c.delete_domain("c", "x")
    assert files(tmp_path) == before and {r["domain"] for r in c.read("c").collect()} == {"y"}


def test_a_filter_on_the_domain_prunes(spark, tmp_path):
    c = Collections(spark, str(tmp_path))
    c.write("c", points(spark, range(30), "x").unionAll(points(spark, range(30, 60), "y")))
    plan = c.read("c").filter("domain = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan


def test_two_changes_at_once(spark, tmp_path):
    a, b = Collections(spark, str(tmp_path)), Collections(spark, str(tmp_path))
    a.write("c", points(spark, range(5), "x"))
    state = b._state("c")
    a.upsert("c", points(spark, [9], "x"))
    with pytest.raises(Exception, match="exist"):
        b._commit("c", state)
    assert a.read("c").count() == 6
