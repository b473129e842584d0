"""Similarity search, coverage and retrieval accuracy over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.vectors import cosine
from tesserae.session import small_batches

#: Vectors of a block; two blocks are multiplied at a time.
BLOCK = 1024
#: Left blocks that a task of ``nearest`` holds at most, with their k best so far, where there are more than cores keep busy.
HELD = 64


def top_k(points: DataFrame, query: list[float], k: int = 5, where: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k points most similar to one query among those that pass a filter; ties by id."""
    rows = points if where is None else points.filter(where)
    target = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", F.round(cosine(F.col(vec_col), target), 6)).orderBy(F.desc("score"), id_col).limit(k)


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, prefix: str) -> tuple[DataFrame, int]:
    """Vectors gathered into blocks of about BLOCK (block number, ids, one flat array each), and how many blocks."""
    n = max(1, -(-vectors.count() // BLOCK))
    v = F.col(vec_col) if dict(vectors.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("block"))
    return rows.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select(F.col("block").alias(f"{prefix}_block"), F.col("rows").alias(f"{prefix}_rows")), n


def _merged(scores: np.ndarray, others: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
    """The k best of each row, kept in ``scores`` (descending) and ``others``, after one more block of similarities."""
    k, least = scores.shape[1], scores[:, -1]
    if s.shape[1] > k and np.isinf(least).any():
        least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, -k])
    row, col = np.nonzero(s >= (least - 1.5e-9)[:, None])  # all that can count after rounding
    if not len(row):
        return
    again = np.unique(row)
    at = np.concatenate((row, np.repeat(again, k)))
    score = np.concatenate((np.round(s[row, col], 9), scores[again].reshape(-1)))
    other = np.concatenate((ids[col], others[again].reshape(-1)))
    order = np.lexsort((other, -score, at))
    first = np.searchsorted(at[order], again)
    top = order[first[:, None] + np.arange(k)]  # a row has k at least, as those that it had are among them
    scores[again], others[again] = score[top], other[top]


def nearest(left: DataFrame, right: DataFrame, k: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each left vector its k most similar right ones, exactly: id, other, score, rank; ties by the smaller id.

    Both sides are cut into blocks. A task holds a few left blocks (HELD at most, where there are many) and all right
    blocks stream past them, multiplied as matrices; it keeps the k best of each left vector. So no pair of vectors is
    ever a row, no pair of blocks is ever written, and what is written grows with the vectors, though the work grows
    with their pairs. Only where there are too few left blocks for all cores the right side is divided too. Zero
    vectors score 0. Two session settings (``small_batches``) are set and stay so.
    """
    spark = left.sparkSession
    small_batches(spark)
    (a, n_a), (b, n_b) = _blocks(left, id_col, vec_col, "a"), _blocks(right, id_col, vec_col, "b")
    tasks = 4 * spark.sparkContext.defaultParallelism
    a_parts = min(n_a, max(tasks, -(-n_a // HELD)))
    b_parts = min(n_b, max(1, tasks // a_parts))
    dealt = lambda df, n, c: df.repartitionById(n, F.pmod(F.col(c), F.lit(n)))
    # a cartesian product reads the parts' shuffle files again and again and writes nothing
    met = dealt(b, b_parts, "b_block").hint("shuffle_replicate_nl").crossJoin(dealt(a, a_parts, "a_block"))

    def matrix(rows: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
        s = rows.values
        ids, v = s.field("id").to_numpy(), s.field("v")
        m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return ids, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = {}, None
        for batch in batches:
            for i, (x, y) in enumerate(zip(batch.column("a_block").to_pylist(), batch.column("b_block").to_pylist())):
                if x not in held:
                    ids, m = matrix(batch.column("a_rows")[i])
                    held[x] = ids, m, np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
                if now is None or now[0] != y:
                    now = y, *matrix(batch.column("b_rows")[i])
                _, m, scores, others = held[x]
                _merged(scores, others, m @ now[2].T, now[1])
        for ids, _, scores, others in held.values():
            there = scores > -np.inf
            yield pa.record_batch([pa.array(np.broadcast_to(ids[:, None], there.shape)[there]), pa.array(others[there]), pa.array(scores[there])], names=["id", "other", "score"])

    rows = met.mapInArrow(run, "id bigint, other bigint, score double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return rows.withColumn("rank", place.cast("bigint")).filter(F.col("rank") <= k)


def best_match(chunks: DataFrame, qa: DataFrame, clamp: bool = False, **kw: str) -> DataFrame:
    """id, other, max_sim: each chunk's most similar pair. ``clamp`` lifts negative maxima to 0."""
    sim = F.greatest(F.col("score"), F.lit(0.0)) if clamp else F.col("score")
    return nearest(chunks, qa, 1, **kw).select("id", "other", F.round(sim, 6).alias("max_sim"))


def coverage(best: DataFrame, threshold: float) -> DataFrame:
    covered = F.count_if(F.col("max_sim") >= threshold)
    return best.agg(F.count("*").alias("total"), covered.alias("covered"), F.round(F.coalesce(F.try_divide(covered.cast("double"), F.count("*")), F.lit(0.0)), 6).alias("rate"))


#: Coverage thresholds by data set: strict, standard, lenient.
THRESHOLDS = {"cc_news": (0.8, 0.7, 0.6), "japanese_text": (0.75, 0.65, 0.55), "wikipedia_ja": (0.85, 0.75, 0.65), "livedoor": (0.78, 0.68, 0.58)}
LEVELS = ("strict", "standard", "lenient")


def coverage_levels(best: DataFrame, dataset: str = "cc_news") -> DataFrame:
    """One row per level: threshold, covered, uncovered, rate. One pass over the matches."""
    marks = dict(zip(LEVELS, THRESHOLDS.get(dataset, (0.8, 0.7, 0.6))))
    one = best.agg(F.count("*").alias("total"), *[F.count_if(F.col("max_sim") >= t).alias(k) for k, t in marks.items()])
    parts = [F.struct(F.lit(k).alias("level"), F.lit(t).alias("threshold"), F.col(k).alias("covered"), (F.col("total") - F.col(k)).alias("uncovered"), F.round(F.coalesce(F.try_divide(F.col(k).cast("double"), F.col("total")), F.lit(0.0)), 6).alias("rate")) for k, t in marks.items()]
    return one.select(F.inline(F.array(*parts)))


def coverage_by(best: DataFrame, bucket: Column, threshold: float = 0.7) -> DataFrame:
    """bucket, n, covered, avg_max_sim, rate."""
    covered = F.count_if(F.col("max_sim") >= threshold)
    return best.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), covered.alias("covered"), F.round(F.avg("max_sim"), 6).alias("avg_max_sim"), F.round(covered / F.count("*"), 6).alias("rate"))


def length_bucket(tokens: Column) -> Column:
    return F.when(tokens < 100, "short").when(tokens < 200, "medium").otherwise("long")


def position_bucket(place: Column, total: Column) -> Column:
    """place counts from 0."""
    return F.when(place < total * 0.33, "beginning").when(place < total * 0.67, "middle").otherwise("end")


def coverage_profile(best: DataFrame, length: str = "length", position: str = "position", threshold: float = 0.7, low: float = 0.7) -> DataFrame:
    """kind (length, position, all), bucket, n, covered, avg_max_sim, rate, insight: both breakdowns and the whole in one pass.

    ``insight`` says so where a length or a position is covered below ``low``; it is null elsewhere.
    """
    covered = F.count_if(F.col("max_sim") >= threshold)
    sums = best.groupingSets([[length], [position], []], length, position).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), covered.alias("covered"), F.round(F.avg("max_sim"), 6).alias("avg_max_sim"), F.coalesce(F.try_divide(covered.cast("double"), F.count("*")), F.lit(0.0)).alias("rate"))
    kind = F.when(F.col("g") == 1, "length").when(F.col("g") == 2, "position").otherwise("all")
    told = F.concat("bucket", F.when(F.col("kind") == "length", " chunks").otherwise(" of the document"), F.lit(": low coverage"))
    out = sums.withColumn("kind", kind).withColumn("bucket", F.coalesce(length, position, F.lit("all")))
    return out.select("kind", "bucket", "n", "covered", "avg_max_sim", F.round("rate", 6).alias("rate"), F.when((F.col("rate") < low) & (F.col("kind") != "all"), told).alias("insight"))


def match_bands(best: DataFrame) -> DataFrame:
    """avg, min, max of the best similarities and how many are high, medium and low."""
    m = F.col("max_sim")
    return best.agg(F.round(F.avg(m), 6).alias("avg_max"), F.min(m).alias("min_max"), F.max(m).alias("max_max"), F.count_if(m >= 0.7).alias("high"), F.count_if((m >= 0.5) & (m < 0.7)).alias("medium"), F.count_if(m < 0.5).alias("low"))


def uncovered(best: DataFrame, threshold: float = 0.7) -> DataFrame:
    return best.filter(F.col("max_sim") < threshold).withColumn("gap", F.round(threshold - F.col("max_sim"), 6))


def best_per_document(chunks: DataFrame, qa: DataFrame, doc_col: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """doc, chunk_id, max_sim: each chunk's best similarity, at least 0, to the pairs of its own document.

    A document's vectors lie in blocks of about BLOCK on either side; each pair of blocks is multiplied as matrices
    and answers with one number a chunk, so that no pair of vectors is ever a row, however many a document has. Null and
    empty vectors are similar to none; the others have one length.
    """

    def blocked(rows: DataFrame, side: str) -> DataFrame:
        n = rows.groupBy(doc_col).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        each = rows.select(doc_col, F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("size(v) > 0").join(n, doc_col)
        keyed = each.withColumn(f"{side}_block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        return keyed.groupBy(doc_col, f"{side}_block").agg(F.collect_list(F.struct("id", "v")).alias(f"{side}_rows"))

    def matrix(rows: pa.StructScalar) -> tuple[pa.Array, np.ndarray]:
        s = rows.values
        m = s.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return s.field("id"), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, x, y in zip(batch.column(0), batch.column(1), batch.column(2)):
                (ids, a), (_, b) = matrix(x), matrix(y)
                best = np.round((a @ b.T).max(axis=1), 6)
                yield pa.record_batch([pa.repeat(doc, len(ids)), ids, pa.array(best)], names=[doc_col, "chunk_id", "sim"])

    kind = dict(chunks.dtypes)[doc_col]
    met = blocked(chunks, "a").join(blocked(qa, "b"), doc_col).repartition(doc_col, "a_block", "b_block")
    sims = met.select(doc_col, "a_rows", "b_rows").mapInArrow(run, f"`{doc_col}` {kind}, chunk_id bigint, sim double").groupBy(doc_col, "chunk_id").agg(F.max("sim").alias("sim"))
    all_chunks = chunks.select(doc_col, F.col(id_col).cast("bigint").alias("chunk_id"))
    return all_chunks.join(sims, [doc_col, "chunk_id"], "left").select(doc_col, "chunk_id", F.greatest(F.coalesce("sim", F.lit(0.0)), F.lit(0.0)).alias("max_sim"))


def per_document(chunks: DataFrame, qa: DataFrame, doc_col: str, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float | Column = 0.7) -> DataFrame:
    """Coverage of each document by its own pairs: the share of its chunks whose best similarity reaches the threshold."""
    covered = F.count_if(F.col("max_sim") >= threshold)
    return best_per_document(chunks, qa, doc_col, id_col, vec_col).groupBy(doc_col).agg(F.count("*").alias("n_chunks"), covered.alias("covered"), F.round(covered / F.count("*"), 6).alias("rate"))


def search_rows(hits: DataFrame) -> DataFrame:
    """Payload variants brought to question, answer and source; empty strings count as absent."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in hits.columns], F.lit(""))
    return hits.withColumns({"shown_question": pick("question", "text", "content"), "shown_answer": pick("answer", "response", "metadata"), "shown_source": pick("source", "file")})


SCORE_BUCKETS = ("80-100", "60-80", "40-60", "0-40")


def score_bucket(percent: Column) -> Column:
    return F.when(percent >= 80, SCORE_BUCKETS[0]).when(percent >= 60, SCORE_BUCKETS[1]).when(percent >= 40, SCORE_BUCKETS[2]).otherwise(SCORE_BUCKETS[3])


def accuracy_buckets(scored: DataFrame, col: str = "similarity") -> DataFrame:
    """Rows, share and mean of each score bucket, empty buckets too."""
    every = scored.sparkSession.createDataFrame([(b, i) for i, b in enumerate(SCORE_BUCKETS)], "bucket string, place int")
    found = scored.groupBy(score_bucket(F.col(col)).alias("bucket")).agg(F.count("*").alias("n"), F.avg(col).alias("mean"))
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = F.broadcast(every).join(found, "bucket", "left")
    return out.select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)), 6).alias("share"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"))


def score_stats(scored: DataFrame, col: str, low: float, high: float) -> DataFrame:
    return scored.filter(F.col(col).between(low, high)).agg(F.count("*").alias("n"), F.round(F.avg(col), 6).alias("mean"), F.round(F.median(col), 6).alias("median"), F.round(F.stddev_samp(col), 6).alias("sd"), F.round(F.max(col), 6).alias("best"))
