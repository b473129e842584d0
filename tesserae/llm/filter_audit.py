"""Filter interaction audit: what five filters remove in each of their 120 orders, from 32 parity sums a group.

A document's failures are a mask of five bits. For every part (language) and label the table is read down to 32
signed sums, one for each subset S of the filters: the documents that fail an even number of S less those that
fail an odd number. That is the Walsh-Hadamard transform of the mask counts; applied once more and divided by 32
it gives the counts back exactly. Every figure of every order then follows from 32 numbers: what a filter removes
at a step are the masks that hold it and none before it. Over all orders a filter is the first to fail a document
with k failures in 120/k of them, so its Shapley sum needs no order at all.

Native DataFrame functions only. Texts never leave the scan: a row is shipped as id, digest and flags, equal rows
collapse on the map side, and copies of one text collapse to a row for each part and label before their smallest
id is looked up, so a text that fills a third of the table makes no large group.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import WORD

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
SIGNS = r"[#$%&*|]"


def failures(text: Column, min_words: int = 200, distinct_pct: int = 50, upper_pct: int = 3) -> Column:
    """The filters A to D that a text fails, as bits 0 to 3: short, repetitive, upper-case, holding a sign."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def flags(w: Column) -> Column:
        fails = (
            F.size(w) < min_words,
            100 * F.size(F.array_distinct(w)) < distinct_pct * F.size(w),
            100 * F.regexp_count(text, F.lit("[A-Z]")) > upper_pct * F.length(text),
            text.rlike(SIGNS),
        )
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))

    return F.element_at(F.transform(F.array(words), flags), 1)  # one pass over the words


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, good, toxic, mask, n: documents by the filters they fail. Rows of a group may repeat; their n add up.

    Null texts are empty, a null part is the empty string. E fails where a strictly smaller id has the same text
    anywhere in the table; rows without an id are neither smaller nor larger than any. An id with several rows of
    labels is good or toxic if any of them says so; nulls say nothing.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("sha"), failures(text).alias("fails"))
    rows = rows.groupBy("id", "part", "sha", "fails").agg(F.count("*").alias("copies"))
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # rows without an id have no label; kept out of the join they cannot gather in one of its partitions
    named = rows.filter("id IS NOT NULL").join(told, "id", "left").select(*rows.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    every = named.unionByName(rows.filter("id IS NULL").select(*rows.columns, F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    has_id = F.col("id").isNotNull()
    texts = every.groupBy("sha", "fails", "part", "good", "toxic").agg(
        F.sum(F.when(has_id, F.col("copies")).otherwise(0)).alias("n"),
        F.sum(F.when(has_id, 0).otherwise(F.col("copies"))).alias("n_null"),
        F.min(F.when(has_id, F.struct("id", "copies"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("sha"))  # a row for each part and label: small
    texts = texts.withColumn("firsts", F.when(F.col("first.id") == least, F.col("first.copies")).otherwise(0))
    cells = F.array(F.struct(F.col("fails").alias("mask"), (F.col("firsts") + F.col("n_null")).alias("n")), F.struct((F.col("fails") + 16).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    return texts.select("part", "good", "toxic", F.explode(cells).alias("c")).select("part", "good", "toxic", "c.mask", "c.n").filter("n > 0")


def _sign(mask: Column, subset: Column | int) -> Column:
    return F.when(F.bit_count(mask.bitwiseAND(subset)) % 2 == 0, 1).otherwise(-1)


def parity_sums(counts: DataFrame, by: list[str]) -> DataFrame:
    """For each group ``sums``: over subsets S = 0..31 of the filters, documents with an even less those with an odd number of failures in S."""
    sums = [F.sum(_sign(F.col("mask"), F.lit(s)) * F.col("n")).alias(f"s{s}") for s in range(MASKS)]
    return counts.groupBy(*by).agg(*sums).select(*by, F.array(*[f"s{s}" for s in range(MASKS)]).alias("sums"))


def mask_counts(sums: Column) -> Column:
    """The transform's inverse: how many documents fail exactly the filters of mask 0..31."""
    subsets = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def cell(mask: Column) -> Column:
        signed = F.zip_with(subsets, sums, lambda s, v: _sign(mask, s) * v)
        return F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, v: a + v) / F.lit(MASKS)

    return F.transform(subsets, lambda m: cell(m).cast("bigint"))


def _over(cells: Column, keep) -> Column:
    """Sum of the cells whose mask ``keep`` takes."""
    picked = F.transform(cells, lambda n, m: F.when(keep(m), n).otherwise(0))
    return F.aggregate(picked, F.lit(0).cast("bigint"), lambda a, v: a + v)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For each part, each of the 120 filter orders and each of its five steps, zeros included:

    kept, removed, redundant (fail this filter, removed before), unique_fails (fail this one alone), good_lost,
    toxic_lost, shapley (what the filter removes, summed over all orders). Labels without a document are ignored;
    an empty table gives an empty result; further columns of either table are ignored.
    """
    by_label = parity_sums(failure_counts(docs, labels, id_col, text_col, part_col), ["part", "good", "toxic"]).withColumn("cells", mask_counts(F.col("sums")))
    each = lambda when: F.array(*[F.sum(F.when(when, F.col("cells")[m]).otherwise(0)) for m in range(MASKS)])
    parts = by_label.groupBy("part").agg(each(F.lit(True)).alias("n"), each(F.col("good")).alias("g"), each(F.col("toxic")).alias("t"))
    # 5 filters after any of the 16 sets of the others: 80 figures a part, then looked up by the 600 steps
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    before = lambda order, i: sum(bit[f] for f in order[:i])
    steps = sorted({(order[i], before(order, i)) for order in ORDERS for i in range(5)})
    situations = F.array(*[F.struct(F.lit(bit[f]).alias("f"), F.lit(b).alias("b")) for f, b in steps])
    seen = parts.select("part", "n", "g", "t", F.explode(situations).alias("s")).select("part", "n", "g", "t", "s.f", "s.b")
    f, b = F.col("f"), F.col("b")
    fails = lambda m: m.bitwiseAND(f) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(b) == 0)
    shares = F.transform(F.col("n"), lambda v, m: F.when(fails(m), (v * F.lit(len(ORDERS)) / F.bit_count(m)).cast("bigint")).otherwise(0))
    figures = seen.select(
        "part", "f", "b",
        _over(F.col("n"), lambda m: m.bitwiseAND(f.bitwiseOR(b)) == 0).alias("kept"), _over(F.col("n"), here).alias("removed"),
        _over(F.col("n"), lambda m: fails(m) & (m.bitwiseAND(b) != 0)).alias("redundant"), F.element_at("n", f + 1).alias("unique_fails"),
        _over(F.col("g"), here).alias("good_lost"), _over(F.col("t"), here).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("shapley"),
    )
    places = F.create_map(*[x for s in steps for x in (F.lit(bit[s[0]] * MASKS + s[1]), F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(i + 1).alias("step")) for o in ORDERS for i in range(5) if (o[i], before(o, i)) == s]))])
    found = figures.withColumn("place", F.explode(F.element_at(places, f * MASKS + b)))
    return found.select("part", "place.filter_order", "place.step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: The same in DuckDB SQL, by running every order over the documents' masks.
ORACLE = r"""
WITH flagged AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic, coalesce(d.text, '') AS text,
         regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS words, min(d.doc_id) OVER (PARTITION BY coalesce(d.text, '')) AS first_id
  FROM documents d LEFT JOIN labels l USING (doc_id)
), fails AS (
  SELECT part, quality, toxic,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
          regexp_matches(text, '[#$%&*|]'), doc_id > first_id] AS f
  FROM flagged
), masks AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (quality = 1) AS g, count(*) FILTER (toxic = 1) AS t, list_sum(list_transform(f, lambda x: x::INT)) AS k FROM fails GROUP BY part, f
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT list_aggregate(list_transform(o, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, s.x AS step, o[s.x] AS own, o[1 : s.x - 1] AS earlier FROM orders, letters s
), met AS (
  SELECT m.*, filter_order, step, f[own] AS fails_own, len(list_filter(earlier, lambda x: f[x])) > 0 AS gone FROM masks m, steps
)
SELECT part, filter_order, step::INT AS step, CAST(coalesce(sum(n) FILTER (NOT fails_own AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails_own AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (fails_own AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails_own AND k = 1), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(g) FILTER (fails_own AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(t) FILTER (fails_own AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // nullif(k, 0)) FILTER (fails_own), 0) AS BIGINT) AS shapley
FROM met GROUP BY part, filter_order, step
"""
