"""Record streams: staged shards of JSON lines as a Spark data source, a partition for each shard.

    spark.dataSource.register(RecordSource)
    spark.read.format("records").option("dataset", "cc_news").option("first", 500).load("/shards/cc_news")

A stream is the shards in the order of their names, each from its first line on. ``first`` keeps that many records of the
stream; a shard then stops by itself after as many, and ``first_records`` cuts the rest off in order. Fields follow from
the set's name; what a line lacks is null, what it has besides goes to ``rest``. Lines that are no JSON object are
records with nothing but ``rest``. Shards may be compressed (.gz).
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# The fields of the known sets.
FIELDS = {
    "wikipedia_ja": ("id", "url", "title", "text"), "japanese_text": ("id", "text"), "livedoor": ("url", "date", "title", "content", "category"),
    "cc_news": ("title", "text", "domain", "date", "description", "url", "image_url"),
}
#: Records of a batch.
BATCH = 1024


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


class Shard(InputPartition):
    def __init__(self, number: int, path: str):
        super().__init__((number, path))
        self.number, self.path = number, path


class RecordReader(DataSourceReader):
    def __init__(self, fields: tuple[str, ...], path: str, first: int | None):
        self.fields, self.path, self.first = fields, path, first

    def partitions(self) -> list[InputPartition]:
        fs, base = _file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        names = sorted(f.path for f in found if f.is_file and not f.path.rsplit("/", 1)[-1].startswith((".", "_")))
        return [Shard(i, n) for i, n in enumerate(names)] or [Shard(0, "")]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("line", pa.int64()), *((f, pa.string()) for f in self.fields), ("rest", pa.string())])
        rows: list[dict] = []
        for n, said in enumerate(self._lines(partition.path)):
            if self.first is not None and n >= self.first:
                break
            rows.append(self._record(said) | {"shard": partition.number, "line": n})
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _lines(self, path: str) -> Iterator[str]:
        if path:
            fs, _ = _file_system(self.path)
            with fs.open_input_stream(path, compression=None) as raw:
                plain = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                yield from (s for s in io.TextIOWrapper(io.BufferedReader(plain), encoding="utf-8", errors="replace", newline="\n") if s.strip())

    def _record(self, said: str) -> dict:
        try:
            item = json.loads(said)
        except ValueError:
            item = None
        if not isinstance(item, dict):
            return {"rest": said.rstrip("\n")}
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        rest = {k: v for k, v in item.items() if k not in self.fields}
        return {f: text(item.get(f)) for f in self.fields} | {"rest": json.dumps(rest, ensure_ascii=False) if rest else None}


class RecordSource(DataSource):
    """Options: path; dataset (a name of FIELDS) or fields (comma-separated); first (records of the stream)."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def _fields(self) -> tuple[str, ...]:
        if named := self.options.get("fields"):
            return tuple(f.strip() for f in named.split(","))
        return FIELDS[self.options["dataset"]]

    def schema(self) -> str:
        return ", ".join(["shard bigint", "line bigint", *(f"`{f}` string" for f in self._fields()), "rest string"])

    def reader(self, schema: StructType) -> RecordReader:
        first = self.options.get("first")
        return RecordReader(self._fields(), self.options["path"], int(first) if first else None)


def first_records(spark: SparkSession, path: str, dataset: str, first: int | None = None) -> DataFrame:
    """The first records of a staged stream, all without a limit, in the fields of its set."""
    spark.dataSource.register(RecordSource)
    read = spark.read.format("records").option("dataset", dataset)
    rows = (read.option("first", first) if first is not None else read).load(path)
    return rows.orderBy("shard", "line").limit(first) if first is not None else rows
