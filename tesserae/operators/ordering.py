"""Numbering all rows of a table without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.staging import staged


def numbered_rows(rows: DataFrame, order: list[str], name: str, parts: int | None = None, size_col: str | None = None, sum_name: str = "sum_size") -> DataFrame:
    """Adds ``name``, each row's place from 0 in this order (nulls first); equal rows in any order among themselves.

    With ``size_col`` also ``sum_name``, the sum of that column up to the row, itself included. Rows are sorted into
    ranges, which are written once; the ranges' sizes, one row each, are summed, and rows are numbered inside
    their range.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # what follows the order columns splits a range in which very many rows are equal in them
    rest = [F.xxhash64(*rows.columns)]
    size = F.col(size_col) if size_col else F.lit(0)
    dealt = staged(rows.repartitionByRange(n, *order, *rest).withColumn("range_no", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("range_no").agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = sizes.select("range_no", earlier("n").alias("range_start"), earlier("size").alias("range_sum"))
    inside = Window.partitionBy("range_no").orderBy(*order, *rest)
    placed = dealt.join(F.broadcast(starts), "range_no").withColumn(name, F.col("range_start") + F.row_number().over(inside) - 1)
    if size_col:
        placed = placed.withColumn(sum_name, F.col("range_sum") + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.drop("range_no", "range_start", "range_sum")
