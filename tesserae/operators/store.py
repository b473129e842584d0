"""Vector collections kept as Parquet, partitioned by collection and domain, and the tables around them."""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tesserae.functions.vectors import score_band
from tesserae.staging import discard, file_system, staged

POINT_MASK = (1 << 63) - 1


def points(qa: DataFrame, domain: str, method: str, source: str, created_at: str, vec_col: str = "embedding") -> DataFrame:
    """Points of a question-and-answer set. Ids are content hashes, so registering a set again changes nothing."""
    key = F.xxhash64(F.lit(domain), F.lit(source), "question", "answer").bitwiseAND(F.lit(POINT_MASK))
    return qa.select(key.alias("point_id"), F.col(vec_col).alias("vector"), F.lit(domain).alias("domain"), F.lit(method).alias("generation_method"), "question", "answer", F.lit(source).alias("source"), F.lit(created_at).alias("created_at"), F.lit("qa:v1").alias("schema"))


def embedding_input(with_answer: bool = True):
    return F.concat_ws("\n", "question", "answer") if with_answer else F.col("question")


def upserted(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """The old rows whose key is not among the new ones, and the new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


class Collections:
    """A folder of collections of points. Points lie in parts: a domain, and in it a bucket of their ids.

    <root>/<collection>/points/domain=…/bucket=…/version=… holds a part as one change wrote it, and
    <root>/<collection>/versions/<n> lists the parts that count after the n-th change. A change writes the parts that
    it touches and a new list; all other parts keep their files, and so do the ones it replaces until ``vacuum``,
    so that a read begun before a change ends as it began. Two changes at once: the later one fails.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _listed(self, path: str) -> list[str]:
        fs, make = file_system(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(make(path))) if fs.exists(make(path)) else []

    def names(self) -> list[str]:
        return self._listed(self.root)

    def _versions(self, name: str) -> list[int]:
        return sorted(int(v) for v in self._listed(f"{self.root}/{name}/versions") if v.isdigit())

    def _state(self, name: str, version: int | None = None) -> dict:
        """schema, buckets and parts ({"domain=…/bucket=…": version}) after the last change, or after another one."""
        at = (version or self._versions(name)[-1]) if self._versions(name) else None
        if at is None:
            return {"version": 0, "schema": None, "parts": {}, "buckets": self.buckets}
        return json.loads(self.spark.read.text(f"{self.root}/{name}/versions/{at}", wholetext=True).first()[0])

    def _commit(self, name: str, state: dict) -> None:
        """Writes the next version's list under its name, which must be free."""
        fs, make = file_system(self.spark, self.root)
        folder, n = f"{self.root}/{name}/versions", state["version"] + 1
        fs.mkdirs(make(folder))
        out = fs.create(make(f"{folder}/{n}"), False)
        out.write(bytearray(json.dumps(state | {"version": n}, ensure_ascii=True).encode()))
        out.close()

    def _read(self, name: str, state: dict, only: list[str] | None = None) -> DataFrame:
        """The points with their ``bucket``; of the named parts only, if asked."""
        schema = StructType.fromJson(json.loads(state["schema"]))
        parts = [f"{p}/version={v}" for p, v in state["parts"].items() if only is None or p in only]
        full = StructType([*schema.fields, StructField("bucket", IntegerType()), StructField("version", IntegerType())])
        if not parts:
            return self.spark.createDataFrame([], full).drop("version")
        top = f"{self.root}/{name}/points"
        rows = self.spark.read.schema(full).option("basePath", top).parquet(*[f"{top}/{p}" for p in parts])
        return rows.select(*schema.names, "bucket")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(name, self._state(name, version)).drop("bucket")

    def write(self, name: str, rows: DataFrame) -> None:
        """Replaces all points."""
        state = self._state(name)
        self._put(name, rows, state | {"schema": rows.schema.json(), "parts": {}, "buckets": self.buckets}, state["version"] + 1)

    def _put(self, name: str, rows: DataFrame, state: dict, version: int) -> None:
        top = f"{self.root}/{name}/points"
        bucket = F.pmod(F.hash("point_id"), F.lit(state["buckets"]))
        keyed = rows.withColumn("bucket", bucket).withColumn("version", F.lit(version))
        keyed.repartition("domain", "bucket").write.mode("append").partitionBy("domain", "bucket", "version").parquet(top)
        fs, make = file_system(self.spark, self.root)
        found = fs.globStatus(make(f"{top}/*/*/version={version}")) or []
        made = {"/".join(str(s.getPath()).split("/")[-3:-1]): version for s in found}
        self._commit(name, state | {"parts": state["parts"] | made, "version": version - 1})

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Adds points, in place of those with the same ids, in whatever domain. Ids are to be unique among ``rows``."""
        state = self._state(name)
        if state["schema"] is None:
            return self.write(name, rows)
        new = staged(rows, "points")
        ids = new.select("point_id").distinct()
        bucket = F.pmod(F.hash("point_id"), F.lit(state["buckets"]))
        # an id has the same bucket in every domain, so other buckets' parts are not even read
        near = {r[0] for r in ids.select(bucket).distinct().collect()}
        maybe = [p for p in state["parts"] if int(p.rsplit("=", 1)[1]) in near]
        hit = self._read(name, state, maybe).join(ids, "point_id", "left_semi").select("domain", "bucket").unionAll(new.select("domain", bucket)).distinct().collect()  # parts, not points
        keys = {(r[0], r[1]) for r in hit}
        touched = [p for p in maybe if (self._domain(p), int(p.rsplit("=", 1)[1])) in keys]
        merged = upserted(self._read(name, state, touched).drop("bucket"), new.select(*StructType.fromJson(json.loads(state["schema"])).names))
        parts = {p: v for p, v in state["parts"].items() if p not in touched}
        self._put(name, merged, state | {"parts": parts}, state["version"] + 1)
        discard(new)

    @staticmethod
    def _domain(part: str) -> str | None:
        value = unquote(part.split("/")[0].removeprefix("domain="))
        return None if value == "__HIVE_DEFAULT_PARTITION__" else value

    def delete_domain(self, name: str, domain: str, dry_run: bool = False) -> int:
        """Forgets a domain's parts; no other part is touched."""
        state = self._state(name)
        gone = [p for p in state["parts"] if self._domain(p) == domain]
        n = self._read(name, state, gone).count() if gone else 0
        if n and not dry_run:
            self._commit(name, state | {"parts": {p: v for p, v in state["parts"].items() if p not in gone}})
        return n

    def truncate(self, name: str) -> int:
        state = self._state(name)
        n = self.read(name).count()
        self._commit(name, state | {"parts": {}})
        return n

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Deletes the files that none of the last ``keep`` versions lists, and the older lists; how many parts that were."""
        versions = self._versions(name)
        used = {(p, v) for n in versions[-keep:] for p, v in self._state(name, n)["parts"].items()}
        fs, make = file_system(self.spark, self.root)
        gone = 0
        for s in fs.globStatus(make(f"{self.root}/{name}/points/*/*/version=*")) or []:
            *_, domain, bucket, version = str(s.getPath()).split("/")
            if (f"{domain}/{bucket}", int(version.removeprefix("version="))) not in used:
                gone += fs.delete(s.getPath(), True)
        for n in versions[:-keep]:
            fs.delete(make(f"{self.root}/{name}/versions/{n}"), False)
        return gone

    def drop(self, name: str) -> None:
        fs, make = file_system(self.spark, self.root)
        fs.delete(make(f"{self.root}/{name}"), True)

    def drop_all(self, keep: list[str] | None = None) -> list[str]:
        gone = [n for n in self.names() if n not in (keep or [])]
        for n in gone:
            self.drop(n)
        return gone

    def counts(self) -> dict[str, int]:
        return {n: self.read(n).count() for n in self.names()}

    def info(self, name: str) -> dict:
        first = self.read(name).select(F.size("vector").alias("n")).limit(1).collect()
        return {"collection": name, "vector_size": first[0]["n"] if first else None, "distance": "cosine", "points": self.read(name).count()}


def collection_counts(rows: DataFrame, col: str) -> DataFrame:
    return rows.groupBy(F.col(col).alias("collection")).agg(F.count("*").alias("n_points"))


def domain_counts(rows: DataFrame, domains: list[str], col: str) -> DataFrame:
    """Rows of each supported domain that has any."""
    return rows.filter(F.col(col).isin(domains)).groupBy(F.col(col).alias("domain")).agg(F.count("*").alias("n"))


def source_mix(rows: DataFrame, col: str, order: str, sample: int = 200) -> DataFrame:
    """Shares of sources among the first rows in order, and totals estimated from them: a report on a sample."""
    total = rows.count()
    seen = rows.orderBy(order).limit(sample).groupBy(F.col(col).alias("source")).agg(F.count("*").alias("n_sample"))
    size = F.sum("n_sample").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return seen.select("source", "n_sample", F.round(F.col("n_sample") * 100.0 / size, 6).alias("pct"), F.floor(F.col("n_sample") * F.lit(total) / size).cast("bigint").alias("estimated_total"))


def scroll(rows: DataFrame, order: str, n: int, longest: int = 200) -> DataFrame:
    """The first n points in order, long strings shortened."""
    short = {c: F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("..."))).otherwise(F.col(c)) for c, t in rows.dtypes if t == "string"}
    return rows.orderBy(order).limit(n).withColumns(short)


def latest_per_name(stores: DataFrame, name: str, created: str, key: str) -> DataFrame:
    """The newest entry of each name; of equal times the one with the smallest key."""
    best = F.min_by(F.struct(key, created), F.struct((-F.unix_micros(F.col(created).cast("timestamp"))).alias("t"), key)).alias("b")
    return stores.groupBy(name).agg(best).select(name, "b.*")


def recent_unique(history: DataFrame, keys: list[str], order: str, most: int = 50, show: int = 10) -> DataFrame:
    """Newest first, one entry per key (the newest), at most ``most``, of which ``show`` are shown."""
    best = history.groupBy(*keys).agg(F.max(order).alias(order))
    return best.orderBy(F.desc(order), *keys).limit(min(most, show))


def message_window(messages: DataFrame, conv: str, turn: str, role: str, last: int = 50, pinned: str = "developer") -> DataFrame:
    """The last messages of each conversation, and its first one too if it has the pinned role."""
    w = Window.partitionBy(conv)
    marked = messages.withColumns({"from_end": F.row_number().over(w.orderBy(F.desc(turn))), "from_start": F.row_number().over(w.orderBy(turn))})
    return marked.filter((F.col("from_end") <= last) | ((F.col("from_start") == 1) & (F.col(role) == pinned))).drop("from_end", "from_start")


def banded(hits: DataFrame, col: str = "score") -> DataFrame:
    return hits.withColumn("band", score_band(F.col(col)))


def sales_by(orders: DataFrame, customers: DataFrame, by: str) -> DataFrame:
    """Orders and revenue by a customer attribute."""
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return joined.groupBy(F.col(by).alias("segment")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count_distinct("o_custkey").alias("n_customers"))
