"""The contract queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import chat, exact_dedup, filter_audit, langid, licenses, lm, media, mixing, pieces, pii, simhash, spelling, substrings
from tesserae.llm.common import documents, pick


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.fit(langid.train_fold(docs)))
    return found.select("doc_id", (langid.id_crc("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = licenses.asked(docs)
    return licenses.license_scan(docs, *licenses.train(docs, found=found), found=found)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(documents(spark, sf_dir), with_pieces=False)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = media.media_columns(documents(spark, sf_dir), with_media=False)
    return kept.withColumn("feature", F.array_join(F.transform("landmarks", lambda x: F.lower(F.hex(x))), ",")).drop("landmarks")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(documents(spark, sf_dir))


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_data(documents(spark, sf_dir))


def op11_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    turns = chat.turn_table(said.unionByName(chat.probe(said)))
    return chat.read_back(turns, chat.prefix_examples(turns))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_language_id, op2_suffix_array_dedup, op3_license_scan, op4_sentencepiece, op5_exact_dedup, op6_mixing, op7_simhash, op8_media, op9_lm_scores, op10_private_data, op11_chat_examples, op12_spelling_variants, op13_filter_audit)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {
        "op5_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op6_mixing": mixing.ORACLE.replace("{docs}", "documents"),
        "op11_chat_examples": chat.ORACLE,
        "op13_filter_audit": filter_audit.ORACLE,
    }
