"""Pairs from a writer (a model behind ``providers.Writer``), by batches of chunks, and the ledger of calls behind them.

Calls cost money, so a reply is kept under a digest of its request. What the ledger holds is anti-joined away before
a job calls anything, and inside a job each task writes its replies down every few calls and reads back what an
earlier attempt of the same task wrote: a retry after a lost executor goes on where that one stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.ordering import numbered_rows
from tesserae.operators.qa import chunk_quota, redistribute
from tesserae.providers import QA_SCHEMA, Writer, patiently
from tesserae.staging import file_system, shared_dir, staged

_REPLY = pa.schema([("digest", pa.string()), ("reply", pa.string())])
#: Requests of one task, and replies after which a task writes them down.
PER_TASK, EVERY = 500, 8


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Python workers reach it; a path without a scheme is a mounted one."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def digest(request: Column) -> Column:
    return F.sha2(F.coalesce(request, F.lit("")), 256)


class Ledger:
    """Replies by digest of their request, as Parquet under a folder that the driver and all executors reach.

    A request that failed for good (after the tries of ``providers.patiently``) has a null reply; it is asked again by
    a later job, not by the same one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}").rstrip("/")

    def replies(self) -> DataFrame:
        """digest, reply: one row for each request answered so far."""
        fs, path = file_system(self.spark, self.path)
        if not fs.exists(path(self.path)):
            return self.spark.createDataFrame([], "digest string, reply string")
        rows = self.spark.read.schema("digest string, reply string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(self.path)
        return rows.filter("reply IS NOT NULL").groupBy("digest").agg(F.min("reply").alias("reply"))

    def ask(self, requests: DataFrame, writer: Writer, prompt_col: str = "prompt", tries: int = 3, wait: float = 1.0) -> None:
        """Calls the writer for every different request that the ledger has no reply to, each once."""
        prompts = requests.select(F.col(prompt_col).alias("prompt")).filter("prompt IS NOT NULL").withColumn("digest", digest(F.col("prompt")))
        new = staged(prompts.dropDuplicates(["digest"]).join(self.replies().select("digest"), "digest", "left_anti"), "requests")
        n = new.count()
        if not n:
            return
        job, root, tasks = uuid.uuid4().hex, self.path, -(-n // PER_TASK)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = _at(root)
            shelf, known, held, made = None, set(), [], 0

            def put_down() -> None:
                if held:  # the name appears when the file is whole
                    folder, name = f"{base}/{job}/{shelf}", held[0][0]
                    fs.create_dir(folder, recursive=True)
                    pq.write_table(pa.Table.from_pylist([dict(zip(("digest", "reply"), r)) for r in held], _REPLY), f"{folder}/{name}.part", filesystem=fs)
                    fs.move(f"{folder}/{name}.part", f"{folder}/{name}.parquet")
                    held.clear()

            for b in batches:
                for at, key, prompt in zip(*(b.column(k).to_pylist() for k in range(3))):
                    if at != shelf:
                        put_down()
                        shelf = at
                        files = fs.get_file_info(pafs.FileSelector(f"{base}/{job}/{shelf}", allow_not_found=True))
                        known = {k for f in files if f.path.endswith(".parquet") for k in pq.read_table(f.path, filesystem=fs).column("digest").to_pylist()}
                    if key not in known:
                        try:
                            held.append((key, patiently(lambda p=prompt: writer.write(p), tries, wait)))
                        except Exception:
                            held.append((key, None))
                        made += 1
                        if len(held) >= EVERY:
                            put_down()
            put_down()
            yield pa.RecordBatch.from_pydict({"calls": [made]})

        dealt = new.select(F.pmod(F.xxhash64("digest"), F.lit(tasks)).alias("shelf"), "digest", "prompt").repartition(tasks, "shelf").sortWithinPartitions("shelf", "digest")
        dealt.mapInArrow(run, "calls bigint").agg(F.sum("calls")).collect()

    def answered(self, requests: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        """The requests with ``reply``, null where there is none."""
        keyed = requests.withColumn("request_digest", digest(F.col(prompt_col)))
        return keyed.join(self.replies().withColumnRenamed("digest", "request_digest"), "request_digest", "left").drop("request_digest")


def _ask_for(texts: Column, wanted: Column, longest: int) -> Column:
    """A request for pairs about numbered texts, long ones cut."""
    short = F.transform(texts, lambda t, i: F.concat(F.lit("\n\n["), (i + 1).cast("string"), F.lit("]\n"), F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest), F.lit("..."))).otherwise(t)))
    return F.concat(F.lit("Write "), wanted.cast("string"), F.lit(" question and answer pairs about the numbered texts below, as JSON with qa_pairs of question, answer, question_type (fact, reason, comparison or application)."), F.array_join(short, ""))


def parsed_pairs(reply: Column) -> Column:
    """The pairs of a reply, null if it is not the JSON asked for; a fence around it does no harm, pairs without question or answer are left out."""
    bare = F.regexp_replace(F.trim(reply), r"^```[a-z]*\s*|\s*```$", "")
    pairs = F.from_json(bare, QA_SCHEMA)["qa_pairs"]
    return F.filter(pairs, lambda p: (F.coalesce(p["question"], F.lit("")) != "") & (F.coalesce(p["answer"], F.lit("")) != ""))


def batches(chunks: DataFrame, size: int = 3, base: int = 5, order: list[str] | None = None) -> DataFrame:
    """The chunks with ``place`` (from 0 in order), ``batch`` (``size`` neighbours each) and ``quota`` (pairs to ask for)."""
    placed = numbered_rows(chunks, order or ["doc_id", "chunk_idx"], "place")
    return placed.withColumn("batch", F.floor(F.col("place") / size)).withColumn("quota", chunk_quota(F.col("tokens"), F.col("chunk_idx"), base))


def requests_of(placed: DataFrame, longest: int = 1000) -> DataFrame:
    """batch, n_chunks, wanted, prompt: one request for each batch."""
    rows = placed.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", "chunk", "quota"))).alias("c"))  # a few chunks a batch
    wanted = F.aggregate(F.transform("c", lambda x: x["quota"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.withColumn("wanted", wanted).select("batch", F.size("c").alias("n_chunks"), "wanted", _ask_for(F.transform("c", lambda x: x["chunk"]), F.col("wanted"), longest).alias("prompt"))


def generate(chunks: DataFrame, writer: Writer, ledger: Ledger, size: int = 3, base: int = 5, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Pairs of all chunks: doc_id, chunk_idx, place, ordinal (in its reply), question, answer, question_type, how.

    chunks: doc_id, chunk_idx, chunk, tokens. A batch's pairs are dealt to its chunks in order, to each as many as its
    quota; pairs beyond the sum of quotas belong to no chunk. A batch whose reply is missing or does not parse is asked
    again chunk by chunk (``how`` is single then, as for a batch of one), whose pairs all are that chunk's.
    """
    placed = staged(batches(chunks, size, base), "batches")
    asked = staged(requests_of(placed), "batch-requests")
    ledger.ask(asked.filter("n_chunks > 1"), writer, tries=tries, wait=wait)
    told = staged(ledger.answered(asked.filter("n_chunks > 1")).select("batch", parsed_pairs(F.col("reply")).alias("pairs")), "batch-replies")
    made = told.filter("pairs IS NOT NULL").select("batch", F.posexplode("pairs").alias("ordinal", "p")).select("batch", F.col("ordinal").cast("bigint").alias("ordinal"), "p.*")
    of_chunk = redistribute(placed.select("batch", "place", "quota", "doc_id", "chunk_idx"), made).select("doc_id", "chunk_idx", "place", "ordinal", "question", "answer", "question_type", F.lit("batch").alias("how"))
    alone = placed.join(told.filter("pairs IS NOT NULL").select("batch"), "batch", "left_anti").withColumn("prompt", _ask_for(F.array("chunk"), F.col("quota"), 2000))
    ledger.ask(alone, writer, tries=tries, wait=wait)
    singles = ledger.answered(alone).select("doc_id", "chunk_idx", "place", F.posexplode(parsed_pairs(F.col("reply"))).alias("ordinal", "p"))
    return of_chunk.unionByName(singles.select("doc_id", "chunk_idx", "place", F.col("ordinal").cast("bigint").alias("ordinal"), "p.question", "p.answer", "p.question_type", F.lit("single").alias("how")))


def answers(hits: DataFrame, questions: DataFrame, writer: Writer, ledger: Ledger, id_col: str = "id", tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Answers written from each question's best hits: id, query, prompt, reply, sources.

    questions: id, query. hits: id, rank, score, question, answer, source. The prompt names the hits in their order;
    ``sources`` are their sources in that order, each once. A question without hits is not asked and has no reply.
    """
    told = hits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "question", "answer", "source"))).alias("hits"))
    lines = F.transform("hits", lambda h: F.concat(F.lit("\n\nScore: "), F.format_number(h["score"], 4), F.lit("\nQuestion: "), F.coalesce(h["question"], F.lit("")), F.lit("\nAnswer: "), F.coalesce(h["answer"], F.lit(""))))
    prompt = F.concat(F.lit("Answer the question from the search results below, briefly and correctly.\n\nQuestion: "), F.coalesce("query", F.lit("")), F.array_join(lines, ""))
    sources = F.array_distinct(F.filter(F.transform("hits", lambda h: h["source"]), lambda s: s.isNotNull()))
    asked = staged(questions.select(id_col, "query").join(told, id_col, "left").select(id_col, "query", F.when(F.col("hits").isNotNull(), prompt).alias("prompt"), F.coalesce(sources, F.array().cast("array<string>")).alias("sources")), "answer-requests")
    ledger.ask(asked, writer, tries=tries, wait=wait)
    return ledger.answered(asked).select(id_col, "query", "prompt", "reply", "sources")
