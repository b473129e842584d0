"""Corpus pipeline: language ID, exact dedup, near-duplicate dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that
is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import langid, mixing, pieces, simhash
from tesserae.llm.common import cut, documents, drop_table, row_tag, tables_dropped
from tesserae.llm.exact_dedup import exact_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _key(digest: Column) -> Column:
    """Names a row by its id (null as no digits) and a digest of its text."""
    return F.concat(digest, F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def _keep_tagged(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """The rows whose tag (id and text) is among ``tags``."""
    tag, name = _free(docs, "row_tag"), _free(docs, "row_id")
    kept = tags.select(F.col("tag").alias(tag), F.col("doc_id").alias(name))
    tagged = docs.withColumn(tag, row_tag())
    return tagged.join(kept, (tagged[tag] == kept[tag]) & F.col("doc_id").eqNullSafe(F.col(name)), "left_semi").select(_own(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those whose language no dictionary tells from the next one."""
    found = langid.identify(docs, langid.fit(langid.train_fold(docs)))
    return _keep_tagged(docs, cut(found.filter(~F.col("rejected")).select("tag", "doc_id"), "language-kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the largest doc_id, and of wholly repeated rows one."""
    key = _free(docs, "row_key")
    kept = exact_dedup(docs).filter("kept").select(_key(F.col("text_sha256")).alias(key))
    keyed = docs.withColumn(key, _key(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(_own(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates one document: the smallest doc_id, of texts with that id the smallest tag.

    Documents without an id come after all others; a group of such alone is taken by its fingerprints. Rows that
    repeat whole, of which the stage before leaves one, share their fate.
    """
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    found = simhash.near_duplicates(docs, with_tag=True)
    return _keep_tagged(docs, found.groupBy(group.alias("group")).agg(first.alias("first")).select("first.tag", "first.doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; documents without words stay as they are, once.

    Rows with the same id and text are one document here, taken as often as all of them together.
    """
    key, copy, n = (_free(docs, c) for c in ("row_key", "row_copy", "row_times"))
    times = F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).cast("int").alias(n)
    taken = mixing.mix_sources(docs).groupBy(_key(F.col("text_hash")).alias(key)).agg(times).filter(F.col(n) > 0)
    keyed = docs.withColumn(key, _key(F.md5(F.coalesce("text", F.lit(""))))).dropDuplicates([key])
    return keyed.join(taken, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(_own(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with the digests of the ids and of the text decoded from them."""
    return pieces.encode_pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("exact_dedup", exact), ("simhash_dedup", near), ("mixing", mix), ("sentencepiece", encode),
]

#: The first, third and last stage are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before = docs
        with tables_dropped() as keep:  # what the stage wrote on its way
            docs = keep(cut(stage(spark, before, sf_dir), f"pipeline-{name}"))
        if name != STAGES[0][0]:
            drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
