"""Exact deduplication: group by a 128-bit content hash, compare bytes inside the groups, keep one row.

Native DataFrame functions only. Copies collapse in the map-side half of the aggregate, so a text that
fills a third of the table is shipped once per map task. The rows that come back to their group are
narrow (id and digests); the few groups that hold over a thousandth of all rows are joined by broadcast
(at most 1000 rows, by arithmetic), all others by a shuffle in which no key is heavy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut, join_skewed


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "max" or "min": which id of a group of equal texts stays. A null text counts as empty.
    Null ids lose to any other id; of repeated rows with the same id and text exactly one is kept. An
    empty table gives an empty result; further columns are ignored. Texts that differ are never joined:
    the grouping key holds the text itself beside its hash.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.md5(text).alias("h"), F.sha2(text, 256).alias("sha"), text.alias("text"))
    best = F.max("id") if keep == "max" else F.min("id")
    classes = cut(
        rows.groupBy("h", "text", "sha").agg(best.alias("keep_id"), F.count("*").alias("group_size")).drop("text"),
        "exact-classes",
    )
    total = classes.agg(F.sum("group_size")).first()[0] or 0
    joined = join_skewed(rows.drop("text"), classes, ["h", "sha"], "group_size", total, "id")
    first = F.row_number().over(Window.partitionBy("join_key", "h", "sha", "id").orderBy(F.lit(1)))
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (first == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
