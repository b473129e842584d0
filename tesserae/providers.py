"""Pluggable model providers, run once per batch on the executors, and offline stand-ins for tests and dry runs."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.chunking import tokens


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashedNgrams:
    """A deterministic embedder: hashed character n-grams, brought to length 1."""

    def __init__(self, dimensions: int = 64, n: int = 3):
        self.dimensions, self.n = dimensions, n

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, t in zip(out, texts):
            for i in range(max(1, len(t) - self.n + 1)):
                h = int.from_bytes(hashlib.blake2b(t[i : i + self.n].encode(), digest_size=8).digest(), "little")
                row[h % self.dimensions] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).tolist()


class Writer(Protocol):
    def write(self, prompt: str) -> str: ...


class DigestWriter:
    """A stand-in writer: a request for pairs gets as many as it asks for, any other a reply that names its digest."""

    def write(self, prompt: str) -> str:
        key = hashlib.md5(prompt.encode()).hexdigest()
        if wanted := re.match(r"Write (\d+) question and answer pairs", prompt):
            return json.dumps({"qa_pairs": [{"question": f"question {i} of {key}", "answer": f"answer {i}", "question_type": "fact"} for i in range(int(wanted[1]))]})
        return f"reply {key}"


def budgeted(texts: list[str], most_tokens: int = 8000, most_texts: int = 20) -> Iterator[list[int]]:
    """Places of texts in requests under both limits. Blank texts are in none; one over the budget is an error."""
    batch: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if not t.strip():
            continue
        n = tokens(t)
        if n > most_tokens:
            raise ValueError(f"a text of {n} tokens is over the budget of {most_tokens}")
        if batch and (size + n > most_tokens or len(batch) == most_texts):
            yield batch
            batch, size = [], 0
        batch.append(i)
        size += n
    if batch:
        yield batch


def patiently(call: Callable[[], object], tries: int = 3, wait: float = 1.0) -> object:
    """Calls again after 1, 2, 4 ... waits; the last failure is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    return None


def embedded(df: DataFrame, embedder: Embedder, id_col: str, text_col: str, most_tokens: int = 8000, most_texts: int = 20) -> DataFrame:
    """id, embedding: requests are made batch by batch; blank texts have zero vectors. Concurrency is the number of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out = [[0.0] * embedder.dimensions for _ in texts]
            for places in budgeted(texts, most_tokens, most_texts):
                for i, v in zip(places, patiently(lambda p=places: embedder.embed([texts[i] for i in p]))):
                    out[i] = v
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["id", "embedding"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, embedding array<double>").withColumnRenamed("id", id_col)


QA_SCHEMA = "struct<qa_pairs:array<struct<question:string,answer:string,question_type:string>>>"


def prompt_for(chunks: list[str], wanted: int, longest: int = 1000) -> str:
    """One request for the pairs of several chunks, each cut to ``longest`` characters."""
    parts = "\n\n".join(f"[{i + 1}] {c[:longest]}" for i, c in enumerate(chunks))
    return f"Write {wanted} question and answer pairs about these passages, as JSON with qa_pairs of question, answer, question_type.\n\n{parts}"


def written(df: DataFrame, writer: Writer, id_col: str, prompt_col: str) -> DataFrame:
    """id, question, answer, question_type, ordinal: a writer's JSON answers, parsed; what cannot be parsed gives no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([patiently(lambda p=p: writer.write(p)) for p in b.column(1).to_pylist()], pa.string())], names=["id", "reply"])

    kind = dict(df.dtypes)[id_col]
    replies = df.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt")).mapInArrow(run, f"id {kind}, reply string")
    parsed = replies.withColumn("r", F.from_json("reply", QA_SCHEMA)).select("id", F.posexplode("r.qa_pairs").alias("ordinal", "q"))
    return parsed.select(F.col("id").alias(id_col), "ordinal", "q.*")
