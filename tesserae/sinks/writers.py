"""Writers for generated pairs, preprocessed texts and vector-store entries. All write folders of part files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import is_blank
from tesserae.session import small_batches
from tesserae.staging import file_system


def csv(df: DataFrame, path: str) -> None:
    flat = df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))})
    flat.write.mode("overwrite").options(header="true", quote='"', escape='"').csv(path)


def jsonl(df: DataFrame, path: str, columns: tuple[str, ...] = ("id", "text")) -> None:
    """One JSON object a line, of the named columns."""
    df.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)


def one_row(df: DataFrame, path: str) -> None:
    """A summary as a JSON document."""
    df.coalesce(1).select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def qa_outputs(qa: DataFrame, coverage: DataFrame | None, uncovered: DataFrame | None, root: str, run: str) -> None:
    """Pairs as JSON and CSV, coverage with previews of uncovered chunks, and a summary, in a folder for the run."""
    qa.write.mode("overwrite").json(f"{root}/{run}/qa_json")
    csv(qa, f"{root}/{run}/qa_csv")
    if coverage is not None:
        coverage.write.mode("overwrite").json(f"{root}/{run}/coverage")
    if uncovered is not None:
        preview = F.when(F.length("chunk") > 200, F.concat(F.substring("chunk", 1, 200), F.lit("..."))).otherwise(F.col("chunk"))
        uncovered.withColumn("preview", preview).drop("chunk").write.mode("overwrite").json(f"{root}/{run}/uncovered")
    one_row(qa.agg(F.count("*").alias("n_pairs")), f"{root}/{run}/summary")


def preprocessed(df: DataFrame, root: str, name: str, text_col: str = "combined_text") -> None:
    """A table as CSV, its texts one a line, and a metadata row."""
    rows = df.filter(~is_blank(F.col(text_col)))
    csv(rows, f"{root}/preprocessed_{name}")
    rows.select(F.regexp_replace(text_col, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(f"{root}/{name}_txt")
    meta = rows.agg(F.lit(name).alias("dataset"), F.count("*").alias("processed_rows"), F.lit(json.dumps(df.columns)).alias("columns"))
    one_row(meta, f"{root}/metadata_{name}")


def flattened(docs: DataFrame, pairs: str = "qa_pairs") -> DataFrame:
    """doc_id, question, answer, doc_title, text_length: one row per pair of a document's array."""
    return docs.select("doc_id", "doc_title", "text_length", F.explode(pairs).alias("p")).select("doc_id", "p.question", "p.answer", "doc_title", "text_length")


def unified(qa: DataFrame, path: str) -> None:
    csv(qa.select("question", "answer"), path)


#: The folder of rows without a category, named as Spark names it.
NO_CATEGORY = "__HIVE_DEFAULT_PARTITION__"


def text_files(df: DataFrame, value: Column, category: str, path: str) -> None:
    """Each row as a text file of its own, with a line end, in its category's folder ``category=...``.

    Hadoop's local file system starts two processes for every file that it makes (permissions of the file and of its
    checksum), so on it, which the executors share, tasks write the files themselves: under names that a repeated task
    gives again, and renamed when whole. Other file systems take Spark's writer.
    """
    spark = df.sparkSession
    fs, cls = file_system(spark, path)
    if fs.getScheme() != "file":
        df.select(value.alias("value"), F.col(category).alias("category")).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("category").text(path)
        return
    small_batches(spark)
    root = unquote(urlparse(fs.makeQualified(cls(path)).toUri().toString()).path)
    os.makedirs(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, n = TaskContext.get(), set(), 0
        for batch in batches:
            for text, kind in zip(batch.column(0), batch.column(1).to_pylist()):
                folder = f"{root}/category={NO_CATEGORY if kind is None else kind.replace('/', '%2F')}"
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                name = f"part-{task.partitionId():05d}-{n}"
                with open(part := f"{folder}/.{name}.{task.taskAttemptId()}", "wb") as f:
                    f.write((text.as_py() or b"") + b"\n")
                os.replace(part, f"{folder}/{name}.txt")
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    df.select(value.cast("binary").alias("value"), F.col(category).cast("string").alias("category")).mapInArrow(run, "n bigint").agg(F.sum("n")).first()
