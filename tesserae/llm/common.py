"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.skew import HOT_SHARE, join_skewed  # noqa: F401
from tesserae.session import small_batches  # noqa: F401
from tesserae.staging import discard, staged, tables_dropped  # noqa: F401

#: One word of the contracts: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors cost no upstream work."""
    return staged(df, name)


def drop_table(df: DataFrame) -> None:
    """Remove the files behind a table made by ``cut`` that no later step reads."""
    discard(df)


def id_crc(id_col: str) -> Column:
    """crc32 of the id's decimal text, the fold function of the contracts."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def row_tag(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 64-bit name of a row by its id and text (null: empty), to tell rows apart that share an id or have none."""
    return F.xxhash64(F.lit(7), F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, whatever else the table has."""
    return df.select(*[F.col(f"`{c}`") for c in cols])
