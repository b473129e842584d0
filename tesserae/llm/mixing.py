"""Mixing sources to target weights by systematic sampling. Native DataFrame functions only.

Every document of a source expects the same number of copies, its source's rate. The documents of a
source stand in one order (by size class, then by a hash), the expected copies are summed along it, one
offset drawn per source is added, and a document is taken once for every whole number that the sum crosses
while passing it. The sum is distributed: counts per cell (source, size class, hash prefix) are summed over
the cells, which are at most about 40,000 per source, and rows are numbered inside their own cell only, so a
source with a third of all rows is spread over thousands of cells. Going through the size classes in turn
makes every source's words come near their target, not only its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, cut

WHOLE = "decimal(38,0)"


def source_targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """(source, n, source_size) -> the same with weight, target and rate (expected copies of a document).

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; they share the sum of all sizes by weight, none
    above ``cap`` times its own size; what is cut off is shared again by weight. The end of that process is
    reached at once: in the order of size per weight, a source is capped if its share of what the ones before
    it left over would exceed its cap. One row per source, so the two windows over all of them are small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    num = lambda c: F.col(c).cast(WHOLE)
    left = F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0))
    out = (
        sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
        .withColumn("top", num("source_size") * cap)
        .withColumn("total", F.sum(num("source_size")).over(everything))
        .withColumn("capped", left.cast("double") * F.col("weight") >= F.col("top").cast("double") * F.sum("weight").over(onward))
    )
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(everything)
    open_words = F.col("total") - F.sum(F.when(F.col("capped"), F.col("top")).otherwise(F.lit(0).cast(WHOLE))).over(everything)
    share = (open_words.cast("double") * F.col("weight")) / open_weight.cast("double")
    return out.withColumn(
        "target", F.when(F.col("capped"), F.col("top").cast("double")).otherwise(share)
    ).select(
        "source", "source_size", "weight", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", cap: int = 3
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken, and the two hashes that order ties.

    size is the number of words; taken = copies * size, copies between 0 and ``cap``. Null texts and texts
    without words have size 0; the null source is a source of its own; repeated rows are rows of their own.
    An empty table gives an empty result. The only randomness is a hash of the source's name and ``seed``,
    so reruns agree.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    id_text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        id_text.alias("id_text"), F.md5(text).alias("text_hash"),
    )
    # texts are read once; what follows works on these narrow rows. The order's hash holds the text's too, so that rows
    # that share an id (or have none) spread over cells like any others
    rows = cut(rows.withColumn("order_hash", F.md5(F.concat("id_text", F.lit("|"), "text_hash"))).drop("id_text"), "mix-rows")
    bits = F.length(F.bin("size"))
    rows = rows.withColumns({
        "class": bits * 8 + F.conv(F.substring(F.bin("size"), 1, 3), 2, 10).cast("int"),
        "cell": F.substring("order_hash", 1, 2), "src": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")),
    })
    cells = rows.groupBy("src", "source", "class", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.col("src"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    before = Window.partitionBy("src").orderBy("class", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("src", "class", "cell", "start")
    targets = targets.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).withColumn("offset", offset).drop("source", "weight")
    plan = starts.join(targets, "src")
    place = F.col("start") + F.row_number().over(Window.partitionBy("src", "class", "cell").orderBy("order_hash"))
    crossed = F.floor(F.col("rate") * F.col("place") + F.col("offset")) - F.floor(F.col("rate") * (F.col("place") - 1) + F.col("offset"))
    return (
        rows.join(plan.hint("shuffle_hash"), ["src", "class", "cell"])
        .withColumn("place", place)
        .withColumn("copies", F.least(crossed, F.lit(cap)).cast("bigint"))
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "order_hash", "text_hash")
    )


#: The same in DuckDB SQL.
ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS order_hash
  FROM {docs}
), keyed AS (
  SELECT *, length(bin(size)) * 8 + CASE WHEN length(bin(size)) > 3 THEN size >> (length(bin(size)) - 3) ELSE size END AS class,
         coalesce('s' || source, 'null') AS src
  FROM rows
), sizes AS (
  SELECT src, source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY src, source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS total, 3 * source_size AS top FROM sizes
), marked AS (
  SELECT *, CAST(total - coalesce(sum(top) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * weight
         >= CAST(top AS DOUBLE) * sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped
  FROM weighed
), targets AS (
  SELECT src, source_size,
         CASE WHEN capped THEN CAST(top AS DOUBLE)
              ELSE CAST(total - sum(CASE WHEN capped THEN top ELSE 0 END) OVER () AS DOUBLE) * weight / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target,
         CAST(('0x' || substr(md5(src || '|mix'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS offs
  FROM marked
), placed AS (
  SELECT k.doc_id, k.source, k.size, t.source_size, t.target, t.offs, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY k.src ORDER BY k.class, k.order_hash) AS place
  FROM keyed k JOIN targets t USING (src)
), mixed AS (
  SELECT *, CAST(least(floor(rate * place + offs) - floor(rate * (place - 1) + offs), 3) AS BIGINT) AS copies FROM placed
)
SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed
"""
