"""Queries of the readers, writers and collections: whole tables written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.store import Collections
from tesserae.plans.queries_tables import _QA, docs_of, qa_pairs
from tesserae.plans.registry import WS, query, sql_tokens
from tesserae.plans.sql_chunks import packed_paragraph_sql
from tesserae.sinks import writers
from tesserae.sources import readers
from tesserae.staging import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id::VARCHAR AS doc_id, md5(coalesce(text, '')) AS text, lang, source FROM documents")
def csv_round_trip(spark, sf):
    path = _folder(spark, "csv")
    writers.csv(docs_of(spark, sf), path)
    return readers.csv(spark, path).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text"), "lang", "source")


@query(_QA + "SELECT md5(question) AS question, md5(answer) AS answer, count(*) AS n FROM qa GROUP BY question, answer")
def unified_round_trip(spark, sf):
    path = _folder(spark, "unified")
    writers.unified(qa_pairs(spark, sf), path)
    return readers.evaluation_set(spark, path).groupBy("question", "answer").agg(F.count("*").alias("n")).select(F.md5("question").alias("question"), F.md5("answer").alias("answer"), "n")


@query("SELECT doc_id::VARCHAR AS id, md5(text) AS text FROM documents WHERE text IS NOT NULL")
def jsonl_round_trip(spark, sf):
    path = _folder(spark, "jsonl")
    writers.jsonl(docs_of(spark, sf).withColumn("id", F.col("doc_id").cast("string")), path)
    return spark.read.schema("id string, text string").json(path).filter("text IS NOT NULL").select("id", F.md5("text").alias("text"))


@query("SELECT md5(text) AS text, count(*) AS n FROM documents WHERE text <> '' GROUP BY text")
def text_column_found(spark, sf):
    """No column is called text here; the first whose name holds the word is taken."""
    path = _folder(spark, "any") + ".csv"
    writers.csv(docs_of(spark, sf).select("doc_id", F.col("text").alias("body_text"), "lang"), path)
    return readers.any_text(spark, path).groupBy("text").agg(F.count("*").alias("n")).select(F.md5("text").alias("text"), "n")


@query(rf"""WITH r AS (SELECT text FROM documents WHERE trim(coalesce(text, ''), {WS}) <> '')
SELECT md5(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS line, count(*) AS n, (SELECT count(*) FROM r)::VARCHAR AS processed_rows FROM r GROUP BY 1""")
def preprocessed_outputs(spark, sf):
    root = _folder(spark, "preprocessed")
    writers.preprocessed(docs_of(spark, sf).withColumnRenamed("text", "combined_text"), root, "documents")
    meta = spark.read.json(f"{root}/metadata_documents").first()  # one row by its nature
    lines = spark.read.text(f"{root}/documents_txt")
    return lines.groupBy("value").agg(F.count("*").alias("n")).select(F.md5("value").alias("line"), "n", F.lit(str(meta["processed_rows"])).alias("processed_rows"))


@query(f"SELECT 'doc/' || doc_id AS url, 'day ' || doc_id AS date, source AS title, md5(trim(text, {WS})) AS content, 'category=' || lang AS category FROM documents")
def news_folder_articles(spark, sf):
    """Each document as an article file of its own, in its language's folder. Nulls are written as \\N."""
    path, key, null = _folder(spark, "news"), F.col("doc_id").cast("string"), F.lit("\\N")
    lines = [F.concat(F.lit("doc/"), key), F.concat(F.lit("day "), key), F.col("source"), F.col("text")]
    writers.text_files(docs_of(spark, sf), F.concat_ws("\n", *[F.coalesce(x, null) for x in lines]), "lang", path)
    rows = readers.news_folder(spark, path)
    told = rows.select(*[F.nullif(F.col(c), null).alias(c) for c in ("url", "date", "title", "content")], F.nullif("category", F.lit(f"category={writers.NO_CATEGORY}")).alias("category"))
    return told.withColumn("content", F.md5("content"))


@query(packed_paragraph_sql("en").replace(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, j) - 1 AS chunk_idx, {sql_tokens('chunk')} AS tokens FROM made", f"SELECT md5(chunk) AS chunk, {sql_tokens('chunk')} AS tokens, count(*) AS n FROM made GROUP BY chunk"))
def text_file_chunks(spark, sf):
    path = _folder(spark, "texts")
    writers.text_files(docs_of(spark, sf), F.col("text"), "lang", path)
    return readers.text_chunks(spark, f"{path}/*/*.txt").groupBy("chunk", "tokens").agg(F.count("*").alias("n")).select(F.md5("chunk").alias("chunk"), "tokens", "n")


@query(_QA + """SELECT 'json' AS part, ordinal, md5(question) AS told FROM qa UNION ALL SELECT 'csv', ordinal, md5(question) FROM qa
UNION ALL SELECT 'uncovered', ordinal, md5(CASE WHEN length(answer) > 200 THEN substr(answer, 1, 200) || '...' ELSE answer END) FROM qa UNION ALL SELECT 'summary', count(*), '' FROM qa""")
def qa_outputs_round_trip(spark, sf):
    root, pairs = _folder(spark, "qa"), qa_pairs(spark, sf)
    writers.qa_outputs(pairs, None, pairs.select("ordinal", F.col("answer").alias("chunk")), root, "run")
    part = lambda name, df, told: df.select(F.lit(name).alias("part"), F.col("ordinal").cast("bigint").alias("ordinal"), told.alias("told"))
    out = part("json", spark.read.json(f"{root}/run/qa_json"), F.md5("question")).unionAll(part("csv", readers.csv(spark, f"{root}/run/qa_csv"), F.md5("question")))
    out = out.unionAll(part("uncovered", spark.read.json(f"{root}/run/uncovered"), F.md5("preview")))
    return out.unionAll(part("summary", spark.read.json(f"{root}/run/summary").withColumnRenamed("n_pairs", "ordinal"), F.lit("")))


@query("""SELECT doc_id AS point_id, CASE WHEN doc_id % 3 = 0 THEN 'moved' ELSE lang END AS domain, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS question, md5(text) AS answer
FROM documents WHERE doc_id % 3 = 0 OR lang <> 'fr'""")
def collection_changes(spark, sf):
    """All documents as points; every third moves to another domain by an upsert, then a domain is deleted."""
    c = Collections(spark, _folder(spark, "collections"))
    made = docs_of(spark, sf).select(F.col("doc_id").alias("point_id"), F.array(F.lit(1.0)).alias("vector"), F.col("lang").alias("domain"), F.col("source").alias("question"), F.md5("text").alias("answer"))
    c.write("documents", made)
    c.upsert("documents", made.filter("point_id % 3 = 0").withColumns({"domain": F.lit("moved"), "question": F.lit("new")}))
    c.delete_domain("documents", "fr")
    return c.read("documents").drop("vector")
