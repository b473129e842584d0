"""Registered queries: each applies an operator to whole test tables; SQL beside it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL fragments with the meaning of the column functions of the same names
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_clean(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'), {WS})"


def sql_tokens(c: str, least: int = 1) -> str:
    wide = rf"length(regexp_replace({c}, '[\x00-\x7F]', '', 'g'))"
    return f"CASE WHEN {c} = '' THEN 0 ELSE greatest({least}, CAST(floor({wide} * 0.5 + (length({c}) - {wide}) * 0.25) AS BIGINT)) END"


def sql_sentences(c: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({c}, '([。．.!?])\s*', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, {WS})), lambda s: s <> '')"


def sql_cosine(a: str, b: str) -> str:
    return f"coalesce(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 0)"


CANDIDATE_SQL = r"[ァ-ヴー]{2,}|[一-龥]{2,}|[A-Za-z]{2,}[A-Za-z0-9]*"
TECH_SQL = r"[ァ-ヴー]{3,}|[A-Z]{2,}[A-Z0-9]*|[一-龥]{4,}"
TERMS_SQL = r"[ァ-ヴー]{3,}|[A-Z]{2,}|[一-龥]{4,}"
