"""Inverted-file index: nearest vectors by cosine from a few cells instead of from all vectors.

Cells are the regions around centres that are fitted on a bounded sample (SAMPLE vectors, chosen by a hash of the id).
Every vector is assigned to the cell of its most similar centre and stored under it, in blocks of about BLOCK vectors.
A search sends each query to its ``probes`` most similar cells and multiplies blocks of queries with blocks of vectors.
How many cells that takes depends on how far the vectors cluster, so it is measured: TRIALS of the vectors ask for their
exact neighbours among all, and ``probes`` is the number of cells that hold the wanted share of those.

Equal vectors are one entry with how many they are and the ids that a top-k can need (the smallest MOST_K), and equal
queries are one query, so copies of one vector make neither a large cell nor pairs with each other. A cell with very
many different vectors is many blocks, each a row of its own, and no task has to hold more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tesserae.operators.vectors import nearest

#: Vectors that ask while probes are counted, neighbours that they ask for, share of those that probed cells hold.
TRIALS, NEIGHBOURS, SHARE = 256, 10, 0.95
#: Vectors from which the centres are fitted, rounds of fitting, most cells, vectors of a block, most neighbours of a query.
SAMPLE, ROUNDS, MOST_CELLS, BLOCK, MOST_K = 20_000, 10, 1024, 1024, 100
#: Pieces into which the rows of one vector are dealt while its smallest ids are found.
SALT = 64


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_centres(vectors: DataFrame, n_cells: int, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Unit centres from spherical k-means over at most ``sample`` different vectors, the same for every partitioning."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("size(v) > 0")
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = np.unique(_unit(_rows(taken.column("v").combine_chunks())), axis=0) if taken.num_rows else np.empty((0, 1))
    if not len(x):
        return x
    pick = np.random.default_rng(7)
    centres = x[[pick.integers(len(x))]]
    nearest = x @ centres[0]
    while len(centres) < min(n_cells, len(x)):  # each further one with a chance by its distance from those before
        far = np.maximum(1 - nearest, 0)
        if far.sum() < 1e-9:
            break
        centres = np.concatenate((centres, x[[pick.choice(len(x), p=far / far.sum())]]))
        nearest = np.maximum(nearest, x @ centres[-1])
    for _ in range(ROUNDS):
        cell = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        sums[np.linalg.norm(sums, axis=1) == 0] = centres[np.linalg.norm(sums, axis=1) == 0]
        centres = _unit(sums)
    return centres


def _cells(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """Adds ``cells``, the n most similar centres' numbers, to rows with a vector ``v``."""
    schema = StructType([*rows.schema.fields, StructField("cells", ArrayType(IntegerType()))])
    names, at = [*rows.columns, "cells"], rows.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                best = np.argsort(-(_unit(_rows(b.column(at))) @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.tolist(), pa.list_(pa.int32()))], names=names)

    return rows.mapInArrow(run, schema)


def _digests(v: Column) -> list[Column]:
    """128 bits that tell vectors apart."""
    return [F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("second"), v).alias("h2")]


def _first_ids(rows: DataFrame, k: int) -> DataFrame:
    """h1, h2, ids: the k smallest ids of each vector, ranked in two steps so that very many copies are spread."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    some = rows.select("h1", "h2", "id", F.pmod(F.xxhash64("id"), F.lit(SALT)).alias("salt")).withColumn("r", rank("h1", "h2", "salt")).filter(F.col("r") <= k)
    few = some.withColumn("r", rank("h1", "h2")).filter(F.col("r") <= k)
    return few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _probes_for(entries: DataFrame, centres: np.ndarray, share: float) -> int:
    """How many cells, the most similar first, hold this share of some vectors' exact neighbours."""
    every = entries.select(F.col("ids")[0].alias("vec_id"), F.col("v").alias("embedding"), "cell")
    asked = every.orderBy(F.xxhash64(F.lit("trial"), "vec_id"), "vec_id").limit(TRIALS)
    exact = nearest(asked, every, NEIGHBOURS + 1).filter(F.col("id") != F.col("other"))
    order = _cells(asked.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), centres, len(centres)).select("id", "cells")
    met = F.broadcast(exact.select("id", "other")).join(every.select(F.col("vec_id").alias("other"), "cell"), "other").join(F.broadcast(order), "id")  # TRIALS * NEIGHBOURS rows
    last = met.agg(F.percentile(F.array_position("cells", F.col("cell")), F.lit(share))).first()[0]
    return max(1, -int(-last // 1)) if last is not None else 1


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray
    probes: int

    @staticmethod
    def build(vectors: DataFrame, path: str, n_cells: int | None = None, share: float = SHARE, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex:
        """Index every vector under ``path``: blocks partitioned by cell, the centres, and the number of probes.

        Null and empty vectors are left out; zero vectors have similarity 0 to all. Without another number there are
        about as many cells as the root of the vectors' number, MOST_CELLS at most. Vectors without any clusters need
        most cells probed for a large share, which the index then does.
        """
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("size(v) > 0")
        rows = rows.select("id", "v", *_digests(F.col("v")))
        total = rows.count()
        centres = fit_centres(vectors, n_cells or min(MOST_CELLS, max(1, round(total**0.5))), id_col, vec_col)
        each = rows.groupBy("h1", "h2").agg(F.any_value("v").alias("v"), F.count("*").alias("n")).join(_first_ids(rows, MOST_K), ["h1", "h2"])
        entries = _cells(each, centres, 1).withColumn("cell", F.col("cells")[0]).drop("cells") if len(centres) else each.withColumn("cell", F.lit(0)).filter("false")
        entries.write.parquet(f"{path}/entries")
        entries = spark.read.parquet(f"{path}/entries")
        sizes = entries.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        sizes.coalesce(1).write.parquet(f"{path}/cells")
        keyed = entries.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")))
        packed = keyed.groupBy("cell", "block").agg(F.array_sort(F.collect_list(F.struct(F.col("ids")[0].alias("first"), "ids", "n", "v"))).alias("rows"))
        packed.write.partitionBy("cell").parquet(f"{path}/blocks")
        probes = _probes_for(entries, centres, share) if len(centres) else 0
        spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], "cell int, v array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")
        return VectorIndex(spark, path, centres, probes)

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MOST_CELLS rows at most
        return VectorIndex(spark, path, np.array([r["v"] for r in rows]) if rows else np.empty((0, 1)), rows[0]["probes"] if rows else 0)

    def search(self, queries: DataFrame, k: int = 1, id_col: str = "vec_id", vec_col: str = "embedding", probes: int | None = None) -> DataFrame:
        """id, other, score, rank: up to k indexed vectors of each query's probed cells; ties by the smaller id.

        k is MOST_K at most. Queries without a vector have no rows; equal query ids are searched on their own.
        """
        if not 0 < k <= MOST_K:
            raise ValueError(f"k must be 1 to {MOST_K}")
        asked = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("size(v) > 0").select("id", "v", *_digests(F.col("v")))
        distinct = asked.groupBy("h1", "h2").agg(F.any_value("v").alias("v"))
        if not len(self.centres):
            return asked.limit(0).select("id", F.col("id").alias("other"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rank"))
        sent = _cells(distinct, self.centres, probes or self.probes).select("h1", "h2", "v", F.explode("cells").alias("cell"))
        n_blocks = self.spark.read.parquet(f"{self.path}/cells")  # a row a cell: MOST_CELLS at most
        per_cell = sent.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("q_blocks"))
        keyed = sent.join(F.broadcast(per_cell), "cell").join(F.broadcast(n_blocks), "cell").withColumn("q_block", F.pmod(F.xxhash64("h1", "h2"), F.col("q_blocks")))
        blocks = keyed.groupBy("cell", "q_block", "blocks").agg(F.collect_list(F.struct("h1", "h2", "v")).alias("asked"))
        blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        met = blocks.join(self.spark.read.parquet(f"{self.path}/blocks"), ["cell", "block"]).repartition("cell", "block", "q_block").select("asked", "rows")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x, y in zip(b.column(0), b.column(1)):
                    q, p = x.values, y.values
                    scores = np.round(_unit(_rows(q.field("v"))) @ _unit(_rows(p.field("v"))).T, 9)
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # of equal scores the entry with the smallest id
                    who = np.repeat(np.arange(len(q)), best.shape[1])
                    flat = best.reshape(-1)
                    take = pa.array(flat)
                    yield pa.RecordBatch.from_arrays([q.field("h1").take(pa.array(who)), q.field("h2").take(pa.array(who)), p.field("ids").take(take), pa.array(scores[who, flat])], names=["h1", "h2", "ids", "score"])

        found = met.mapInArrow(run, "h1 bigint, h2 bigint, ids array<bigint>, score double")
        each = found.select("h1", "h2", "score", F.explode(F.slice("ids", 1, k)).alias("other"))
        place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "other"))
        top = each.withColumn("rank", place.cast("bigint")).filter(F.col("rank") <= k)
        lists = top.groupBy("h1", "h2").agg(F.collect_list(F.struct("rank", "other", "score")).alias("top"))
        # one row for each different query vector; one that very many queries share is split by the skew join
        return asked.select("id", "h1", "h2").join(lists, ["h1", "h2"]).select("id", F.inline("top")).select("id", "other", "score", "rank")


    def best_match(self, chunks: DataFrame, clamp: bool = False, **kw: str) -> DataFrame:
        """As ``vectors.best_match`` of the chunks with what is indexed: id, other, max_sim."""
        sim = F.greatest(F.col("score"), F.lit(0.0)) if clamp else F.col("score")
        return self.search(chunks, 1, **kw).select("id", "other", F.round(sim, 6).alias("max_sim"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours that a search found; of equal scores any neighbour counts."""
    goal = exact.groupBy("id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    hits = found.select("id", "score").join(goal, "id", "right").groupBy("id").agg(F.least(F.max("n"), F.count_if(F.col("score") >= F.col("least") - 1e-6)).alias("hit"), F.max("n").alias("n"))
    return hits.agg(F.sum("hit") / F.sum("n")).first()[0] or 0.0
