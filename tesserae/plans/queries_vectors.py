"""Queries of the vector operators. Chunks are the embeddings with a label under 5, pairs are the others."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.functions import vectors as V
from tesserae.operators import generation, store, vectors
from tesserae.operators.ordering import numbered_rows
from tesserae.operators.vector_index import VectorIndex
from tesserae.plans.registry import query, sql_cosine, table
from tesserae.providers import DigestWriter
from tesserae.staging import shared_dir

_BEST = f"""
WITH c AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE label < 5), q AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE label >= 5),
p AS (SELECT c.vec_id AS id, c.label, q.vec_id AS other, round({sql_cosine('c.e', 'q.e')}, 9) AS s FROM c, q),
best AS (SELECT id, label, round(max(s), 6) AS max_sim, arg_min(other, (-s, other)) AS other FROM p GROUP BY id, label)
"""


def _split(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.filter("label < 5"), e.filter("label >= 5")


def _best(spark, sf, clamp=False):
    return vectors.best_match(*_split(spark, sf), clamp)


@query(f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round({sql_cosine('embedding', 'q.e')}, 6) AS score FROM embeddings, q WHERE label <> 3 ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    target = e.filter("vec_id = 0").select("embedding").first()[0]
    return vectors.top_k(e, target, 10, F.col("label") != 3).select("vec_id", "score")


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(sqrt(list_inner_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[])) / sqrt(list_inner_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[])), 6) AS reduced_norm FROM embeddings")
def vector_norms(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.norm(e), 6).alias("norm"), F.round(V.norm(V.reduced(e, 16)), 6).alias("reduced_norm"))


@query(_BEST + "SELECT id, other, max_sim FROM best")
def best_match(spark, sf):
    return _best(spark, sf)


@query(_BEST + "SELECT count(*) AS total, count(*) FILTER (max_sim >= 0.3) AS covered, round(count(*) FILTER (max_sim >= 0.3)::DOUBLE / count(*), 6) AS rate FROM best")
def coverage_base(spark, sf):
    return vectors.coverage(_best(spark, sf), 0.3)


@query(_BEST + ", t AS (SELECT * FROM (VALUES ('strict', 0.8::DOUBLE), ('standard', 0.7::DOUBLE), ('lenient', 0.6::DOUBLE)) v(level, threshold)) SELECT level, threshold, count(*) FILTER (max_sim >= threshold) AS covered, count(*) FILTER (max_sim < threshold) AS uncovered, round(count(*) FILTER (max_sim >= threshold)::DOUBLE / count(*), 6) AS rate FROM best, t GROUP BY level, threshold")
def coverage_multi_threshold(spark, sf):
    return vectors.coverage_levels(_best(spark, sf), "cc_news")


@query(_BEST + ", b AS (SELECT max_sim, CASE WHEN label < 2 THEN 'short' WHEN label < 4 THEN 'medium' ELSE 'long' END AS bucket FROM best) SELECT bucket, count(*) AS n, count(*) FILTER (max_sim >= 0.7) AS covered, round(avg(max_sim), 6) AS avg_max_sim, round(count(*) FILTER (max_sim >= 0.7)::DOUBLE / count(*), 6) AS rate FROM b GROUP BY bucket")
def coverage_by_length(spark, sf):
    b = _best(spark, sf).join(_split(spark, sf)[0].select(F.col("vec_id").alias("id"), "label"), "id")
    return vectors.coverage_by(b, vectors.length_bucket(F.col("label") * 50))


@query(_BEST + ", r AS (SELECT max_sim, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM best), b AS (SELECT max_sim, CASE WHEN i < n * 0.33::DOUBLE THEN 'beginning' WHEN i < n * 0.67::DOUBLE THEN 'middle' ELSE 'end' END AS bucket FROM r) SELECT bucket, count(*) AS n, count(*) FILTER (max_sim >= 0.7) AS covered, round(avg(max_sim), 6) AS avg_max_sim, round(count(*) FILTER (max_sim >= 0.7)::DOUBLE / count(*), 6) AS rate FROM b GROUP BY bucket")
def coverage_by_position(spark, sf):
    ranked = numbered_rows(_best(spark, sf), ["id"], "i")
    return vectors.coverage_by(ranked, vectors.position_bucket(F.col("i"), F.lit(ranked.count())))


@query(_BEST + """, r AS (SELECT max_sim, CASE WHEN label < 2 THEN 'short' WHEN label < 4 THEN 'medium' ELSE 'long' END AS length, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM best),
b AS (SELECT *, CASE WHEN i < n * 0.33::DOUBLE THEN 'beginning' WHEN i < n * 0.67::DOUBLE THEN 'middle' ELSE 'end' END AS position FROM r),
s AS (SELECT CASE WHEN grouping(length) = 0 THEN 'length' WHEN grouping(position) = 0 THEN 'position' ELSE 'all' END AS kind, coalesce(length, position, 'all') AS bucket, count(*) AS n, count(*) FILTER (max_sim >= 0.35) AS covered, round(avg(max_sim), 6) AS avg_max_sim, round(count(*) FILTER (max_sim >= 0.35)::DOUBLE / count(*), 6) AS rate
 FROM b GROUP BY GROUPING SETS ((length), (position), ()))
SELECT *, CASE WHEN rate < 0.7 AND kind = 'length' THEN bucket || ' chunks: low coverage' WHEN rate < 0.7 AND kind = 'position' THEN bucket || ' of the document: low coverage' END AS insight FROM s""")
def coverage_profile(spark, sf):
    """A smaller threshold than the default, so that the given vectors are covered in part."""
    b = numbered_rows(_best(spark, sf).join(_split(spark, sf)[0].select(F.col("vec_id").alias("id"), "label"), "id"), ["id"], "i")
    rows = b.withColumns({"length": vectors.length_bucket(F.col("label") * 50), "position": vectors.position_bucket(F.col("i"), F.lit(b.count()))})
    return vectors.coverage_profile(rows, threshold=0.35)


@query()
def vector_index_search(spark, sf):
    """The ten nearest of all vectors for each vector whose id 20 divides, through the index."""
    e = table(spark, sf, "embeddings")
    index = VectorIndex.build(e, f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}")
    return index.search(e.filter("vec_id % 20 = 0"), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH h AS (SELECT a.vec_id AS id, b.vec_id AS other, round({sql_cosine('a.embedding', 'b.embedding')}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 AND b.label < 5),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM h),
p AS (SELECT r.id, string_agg(chr(10) || chr(10) || 'Score: ' || printf('%.4f', score) || chr(10) || 'Question: ' || d.source || chr(10) || 'Answer: ' || d.text, '' ORDER BY rank) AS hits, list(d.lang ORDER BY rank) AS langs FROM r JOIN documents d ON d.doc_id = r.other WHERE rank <= 3 GROUP BY r.id),
q AS (SELECT id, 'Answer the question from the search results below, briefly and correctly.' || chr(10) || chr(10) || 'Question: ' || d.text || hits AS prompt, langs FROM p JOIN documents d ON d.doc_id = p.id)
SELECT id, 'reply ' || md5(prompt) AS reply, array_to_string(list_filter(langs, lambda x, i: list_position(langs, x) = i), ',') AS sources FROM q""")
def answers_from_hits(spark, sf):
    """Every document whose id 20 divides is a question, answered from the three nearest of the others; the writer is a stand-in."""
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    hits = vectors.nearest(e.filter("vec_id % 20 = 0"), e.filter("vec_id % 20 <> 0 AND label < 5"), 3)
    told = hits.join(d.select(F.col("doc_id").alias("other"), F.col("source").alias("question"), F.col("text").alias("answer"), F.col("lang").alias("source")), "other")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("id")).join(d.select(F.col("doc_id").alias("id"), F.col("text").alias("query")), "id")
    out = generation.answers(told, asked, DigestWriter(), generation.Ledger(spark))
    return out.filter("reply IS NOT NULL").select("id", "reply", F.array_join("sources", ",").alias("sources"))


@query(_BEST + ", g AS (SELECT greatest(max_sim, 0) AS m FROM best) SELECT round(avg(m), 6) AS avg_max, min(m) AS min_max, max(m) AS max_max, count(*) FILTER (m >= 0.7) AS high, count(*) FILTER (m >= 0.5 AND m < 0.7) AS medium, count(*) FILTER (m < 0.5) AS low FROM g")
def coverage_bands(spark, sf):
    return vectors.match_bands(_best(spark, sf, True))


@query(_BEST + "SELECT id, max_sim, round(0.7::DOUBLE - max_sim, 6) AS gap FROM best WHERE max_sim < 0.7")
def uncovered_chunks(spark, sf):
    return vectors.uncovered(_best(spark, sf)).select("id", "max_sim", "gap")


@query(f"""WITH c AS (SELECT label, vec_id, embedding AS e FROM embeddings WHERE vec_id % 2 = 0), q AS (SELECT label, embedding AS e FROM embeddings WHERE vec_id % 2 = 1),
b AS (SELECT c.label, c.vec_id, greatest(coalesce(max(CASE WHEN q.e IS NOT NULL THEN round({sql_cosine('c.e', 'q.e')}, 6) END), 0), 0) AS m FROM c LEFT JOIN q USING (label) GROUP BY c.label, c.vec_id)
SELECT label, count(*) AS n_chunks, count(*) FILTER (m >= 0.4) AS covered, round(count(*) FILTER (m >= 0.4)::DOUBLE / count(*), 6) AS rate FROM b GROUP BY label""")
def coverage_per_doc(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.per_document(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "label", threshold=0.4)


@query(_BEST + ", r AS (SELECT id, other, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS rank FROM p) SELECT id, other, round(s, 6) AS score, rank FROM r WHERE rank <= 3")
def knn_join(spark, sf):
    return vectors.nearest(*_split(spark, sf), 3).withColumn("score", F.round("score", 6))


_BUCKET = "CASE WHEN s >= 80 THEN '80-100' WHEN s >= 60 THEN '60-80' WHEN s >= 40 THEN '40-60' ELSE '0-40' END"


@query(_BEST + f", x AS (SELECT max_sim * 100 AS s FROM best), g AS (SELECT {_BUCKET} AS bucket, count(*) AS n, avg(s) AS mean FROM x GROUP BY 1), v AS (SELECT * FROM (VALUES ('80-100'), ('60-80'), ('40-60'), ('0-40')) v(bucket)) SELECT v.bucket, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM best), 6) AS share, round(coalesce(mean, 0), 6) AS mean FROM v LEFT JOIN g ON v.bucket = g.bucket")
def knn_eval_buckets(spark, sf):
    return vectors.accuracy_buckets(_best(spark, sf).withColumn("similarity", F.col("max_sim") * 100))


@query(_BEST + "SELECT count(*) AS n, round(avg(max_sim), 6) AS mean, round(median(max_sim), 6) AS median, round(stddev_samp(max_sim), 6) AS sd, round(max(max_sim), 6) AS best FROM best WHERE max_sim BETWEEN 0.2 AND 0.9")
def score_stats(spark, sf):
    return vectors.score_stats(_best(spark, sf), "max_sim", 0.2, 0.9)


@query(_BEST + "SELECT id, CASE WHEN max_sim >= 0.8 THEN 'excellent' WHEN max_sim >= 0.6 THEN 'good' WHEN max_sim >= 0.4 THEN 'fair' ELSE 'low' END AS band FROM best")
def score_bands(spark, sf):
    return store.banded(_best(spark, sf), "max_sim").select("id", "band")


@query("SELECT conv_id, turn, CASE WHEN text <> '' THEN text ELSE '' END AS shown_question FROM conversations")
def search_rows(spark, sf):
    rows = table(spark, sf, "conversations").withColumns({"question": F.lit(""), "answer": F.col("role")})
    return vectors.search_rows(rows).select("conv_id", "turn", "shown_question")
