"""Joins to a table with few heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key over 1/HOT_SHARE of the rows is joined by broadcast; by arithmetic there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000


def join_skewed(rows: DataFrame, table: DataFrame, keys: list[str], n_col: str, total: int, spread: str) -> DataFrame:
    """Left join of ``rows`` to a ``table`` unique in ``keys``, where ``n_col`` tells how many rows a key has.

    Rows of heavy keys get their values by broadcast (see HOT_SHARE); for the shuffle they take a random-like
    key from ``spread`` that meets nothing, so that no partition holds a heavy key.
    """
    cols = [c for c in table.columns if c not in keys]
    hot = table.filter(F.col(n_col) > total / HOT_SHARE).select(*keys, *[F.col(c).alias(f"hot_{c}") for c in cols])
    marked = rows.join(F.broadcast(hot), keys, "left")
    is_hot = F.col(f"hot_{n_col}").isNotNull()
    marked = marked.withColumn("join_key", F.when(is_hot, F.xxhash64(F.lit("hot"), F.col(spread))).otherwise(F.xxhash64(*keys)))
    cold = table.filter(F.col(n_col) <= total / HOT_SHARE).select(F.xxhash64(*keys).alias("join_key"), *[F.col(k).alias(f"cold_{k}") for k in keys], *[F.col(c).alias(f"cold_{c}") for c in cols])
    same = [marked["join_key"] == cold["join_key"], *[marked[k].eqNullSafe(cold[f"cold_{k}"]) for k in keys]]
    both = marked.join(cold, same, "left").drop(cold["join_key"])
    return both.select(*rows.columns, *[F.coalesce(f"hot_{c}", f"cold_{c}").alias(c) for c in cols], "join_key")
