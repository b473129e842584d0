"""Every stage of the corpus pipeline against what its operator decides, and the stages in a row."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from tesserae.llm import langid, mixing, simhash
from tests.llm.test_llm import ROWS, SF, brute_components, brute_fingerprint, table


def same_columns(df, docs):
    return df.columns == docs.columns


def test_stages_on_edge_cases(spark):
    docs = table(spark, [r for r in ROWS])
    kept = P.exact(spark, docs, SF)
    assert same_columns(kept, docs) and kept.count() == len({t or "" for _, t, *_ in ROWS})
    near = P.near(spark, docs, SF)
    groups = brute_components([r[0] for r in ROWS], [brute_fingerprint(r[1]) for r in ROWS])
    assert same_columns(near, docs) and {r["doc_id"] for r in near.collect()} == {g for g in groups if g is not None} | {r[0] for r, g in zip(ROWS, groups) if g is None}
    ours = near.groupBy("doc_id", "text").count().collect()
    assert len(ours) == len(set(groups))
    mixed = P.mix(spark, docs, SF)
    want = Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r["doc_id"]] += r["copies"] if r["size"] else 1
    assert same_columns(mixed, docs) and Counter(r["doc_id"] for r in mixed.collect()) == +want


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = P.language_id(spark, docs, SF)
    found = langid.identify(docs, langid.fit(langid.train_fold(docs)))
    assert {r["doc_id"] for r in step.collect()} == {r["doc_id"] for r in found.collect() if not r["rejected"]}
    assert step.count() > 0.97 * docs.count()
    out = P.run(spark, SF).collect()
    assert len(out) > 0 and all(r["round_trip"] for r in out)
    first = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len({r["doc_id"] for r in out}) <= len(first)


def test_columns_with_the_names_used_inside(spark):
    docs = table(spark, [(1, "one text of some words", "en", "s"), (1, "another text that has more words", "en", "s"), (None, "a third one", "en", None), (None, "a third one", "en", None)])
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"mine {c}").alias(c) for c in ("id", "row_key", "row_tag", "ROW_COPY", "row_times", "group", "first", "tag", "_key", "component_id", "none")])
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert same_columns(out, docs)
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in docs.columns[5:])
    P.encode(spark, docs, SF).collect()


def test_empty(spark):
    docs = table(spark, [])
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
