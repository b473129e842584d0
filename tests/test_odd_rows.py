"""Queries against their SQL on documents with null, empty and blank cells, which the given tables lack."""

import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import QUERIES, SQL
from tesserae.sinks import writers
from tesserae.sources import readers

CELLS = (None, "", " \t\n ", "AI AI 機械学習 ananana")


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Every text with every language and source, a row that is there twice, rows of one id, and a row of nulls."""
    rows = [(i, t, la, so) for i, (t, la, so) in enumerate((t, la, so) for t in CELLS for la in (None, "", "en") for so in (None, "", "web"))]
    rows += [rows[-1], (500, "a b", "en", "x"), (500, "a  b", "en", "y"), (None, None, None, None)]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["combine_columns", "text_content", "process_rows", "keyword_char_coverage", "news_folder_articles"])
def test_odd_rows(spark, odd, name):
    df, con = QUERIES[name](spark, odd), duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    rel = con.sql(SQL[name])
    of = lambda rows, names: sorted(repr([r[names.index(c)] for c in sorted(df.columns)]) for r in rows)
    want = [[int(v) if type(v).__name__ == "Decimal" else v for v in r] for r in rel.fetchall()]
    assert of(df.collect(), df.columns) == of(want, rel.columns)


def test_one_file_a_row_takes_no_process_a_file(spark, tmp_path):
    """Spark's writer started two processes for each file: 5,000 files took over a minute."""
    began = time.time()
    rows = spark.range(5000).select(F.concat(F.lit("text "), "id").alias("t"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("a b+"), F.col("id") % 3)).alias("kind"))
    writers.text_files(rows, F.col("t"), "kind", str(tmp_path / "files"))
    assert time.time() - began < 30
    back = readers.whole_files(spark, f"{tmp_path}/files/*/*.txt").select("value").collect()
    assert sorted(r["value"] for r in back) == sorted(f"text {i}\n" for i in range(5000))
    assert sorted(os.listdir(tmp_path / "files")) == ["category=" + k for k in (writers.NO_CATEGORY, "a b+1", "a b+2")]
