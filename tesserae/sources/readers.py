"""Readers for the corpora and question-and-answer sets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import strip
from tesserae.operators.chunking import as_chunks, chunk_table, in_japanese, packed_paragraphs
from tesserae.operators.tables import nonblank, qa_table, require, text_column
from tesserae.staging import file_system


def csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A CSV with header, quoted line breaks and doubled quotes; all columns strings, NA-like words as nulls kept as text."""
    return spark.read.options(header="true", multiLine="true", quote='"', escape='"', **options).csv(path)


def with_ordinal(df: DataFrame) -> DataFrame:
    """Adds ``ordinal``, which grows in reading order: what 'first' means later."""
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def preprocessed(spark: SparkSession, path: str, column: str = "Combined_Text", max_docs: int | None = None) -> DataFrame:
    """A preprocessed CSV's rows with text, in order, up to max_docs of them."""
    rows = nonblank(require(with_ordinal(csv(spark, path)), [column]), column)
    return rows.orderBy("ordinal").limit(max_docs) if max_docs else rows


def any_text(spark: SparkSession, path: str, column: str | None = None, max_paragraphs: int | None = None) -> DataFrame:
    """ordinal, text: a CSV's text column, found by name, or the paragraphs of a plain file."""
    if path.endswith(".csv"):
        rows = with_ordinal(csv(spark, path))
        return rows.select("ordinal", F.col(text_column(rows.drop("ordinal"), column)).alias("text")).filter("text IS NOT NULL")
    whole = spark.read.text(path, wholetext=True)
    parts = F.split("value", "\n\n")
    return whole.select(F.posexplode(F.slice(parts, 1, max_paragraphs) if max_paragraphs else parts).alias("ordinal", "text"))


def qa_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return qa_table(with_ordinal(csv(spark, path)), "ordinal", limit)


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    return require(csv(spark, path), ["question", "answer"])


def lines(spark: SparkSession, path: str, column: str, least: int = 10) -> DataFrame:
    """Stripped values of a column that are longer than ``least``."""
    return csv(spark, path).select(strip(F.col(column)).alias("line")).filter(F.length("line") > least)


def whole_files(spark: SparkSession, pattern: str) -> DataFrame:
    """value, file: the whole text of each file that a pattern of names in folders matches.

    Folders are listed, not files one by one, and many small files share a task; the session setting stays so.
    """
    folder, name = pattern.rsplit("/", 1)
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 10))
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(folder, wholetext=True).withColumn("file", F.input_file_name())
    fs, path = file_system(spark, folder)
    steps = len(re.sub(r"^[A-Za-z0-9+.-]+:/*", "", fs.makeQualified(path(folder)).toString()).split("/"))  # files in deeper folders do not match
    return rows.filter(F.size(F.split(F.regexp_replace("file", "^[A-Za-z0-9+.-]+:/*", ""), "/")) == steps + 1)


def text_chunks(spark: SparkSession, path: str, limit: int = 500) -> DataFrame:
    """Chunks of whole text files, by the packing of the language that their first 1000 characters are in."""
    packed = lambda t: packed_paragraphs(t, "ja" if in_japanese(t[:1000]) else "en", limit)
    return chunk_table(whole_files(spark, path), as_chunks(packed), "file", "value")


def news_folder(spark: SparkSession, root: str, with_date: bool = True) -> DataFrame:
    """url, date, title, content, category of a folder of categories with one text file per article.

    The first lines are the address, the date (where the set has one) and the title. Licence and read-me files
    and files with too few lines are left out.
    """
    files = whole_files(spark, f"{root.rstrip('/')}/*/*.txt")
    files = files.filter(~F.lower(F.element_at(F.split("file", "/"), -1)).rlike("license|readme"))
    skip = 3 if with_date else 2
    rows = files.withColumn("l", F.split("value", "\n")).filter(F.size("l") >= 3)
    text = lambda i: strip(F.get("l", F.lit(i)))
    content = strip(F.array_join(F.slice("l", skip + 1, F.size("l")), "\n"))
    category = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -2), F.lit("+"), F.lit("%2B")))  # the path is told as an address
    return rows.select(text(0).alias("url"), (text(1) if with_date else F.lit(None).cast("string")).alias("date"), text(skip - 1).alias("title"), content.alias("content"), category.alias("category"))


def newest_file(spark: SparkSession, pattern: str) -> DataFrame:
    """path, modified of the file last changed among those a pattern matches."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("modified"))


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The same n rows at every run: those with the smallest hash of their key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
