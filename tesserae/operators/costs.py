"""Token and cost estimates against price tables, which are a few rows each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import token_estimate

# Dollars for 1,000 input and output tokens, and token limits, by model.
PRICES = {
    "gpt-5": (0.01, 0.03), "gpt-5-mini": (0.0001, 0.0004), "gpt-5-nano": (0.00005, 0.0002), "gpt-4o": (0.005, 0.015), "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4o-audio-preview": (0.01, 0.02), "gpt-4o-mini-audio-preview": (0.00025, 0.001), "gpt-4.1": (0.0025, 0.01), "gpt-4.1-mini": (0.0001, 0.0004),
    "o1": (0.015, 0.06), "o1-mini": (0.003, 0.012), "o3": (0.03, 0.12), "o3-mini": (0.006, 0.024), "o4": (0.05, 0.2), "o4-mini": (0.01, 0.04),
}
LIMITS = {
    "gpt-5": (256000, 8192), "gpt-5-mini": (128000, 4096), "gpt-5-nano": (64000, 2048), "gpt-4o": (128000, 4096), "gpt-4o-mini": (128000, 4096),
    "gpt-4o-audio-preview": (128000, 4096), "gpt-4o-mini-audio-preview": (128000, 4096), "gpt-4.1": (128000, 4096), "gpt-4.1-mini": (128000, 4096),
    "o1": (128000, 32768), "o1-mini": (128000, 65536), "o3": (200000, 100000), "o3-mini": (200000, 100000), "o4": (256000, 128000), "o4-mini": (256000, 128000),
}
OTHER_PRICE, OTHER_LIMIT = (0.00015, 0.0006), (128000, 4096)
EMBEDDING_PRICE = 0.0001


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PRICES.items()], "model string, input_price double, output_price double")


def model_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in LIMITS.items()], "model string, max_tokens bigint, max_output bigint")


def cost(usage: DataFrame) -> DataFrame:
    """usage: model, input_tokens, output_tokens. Adds cost; models without a price take the common one."""
    out = usage.join(F.broadcast(prices(usage.sparkSession)), "model", "left")
    a, b = F.coalesce("input_price", F.lit(OTHER_PRICE[0])), F.coalesce("output_price", F.lit(OTHER_PRICE[1]))
    return out.withColumn("cost", F.round(F.col("input_tokens") / 1000 * a + F.col("output_tokens") / 1000 * b, 9)).drop("input_price", "output_price")


def split_cost(tokens, input_price: float, output_price: float, input_share: float = 0.7):
    """Cost at prices for a million tokens, a fixed share of them input."""
    return F.round(tokens * input_share / 1_000_000 * input_price + tokens * (1 - input_share) / 1_000_000 * output_price, 4)


def corpus_tokens(docs: DataFrame, order: str, text_col: str = "text", sample: int = 10) -> DataFrame:
    """Tokens of the corpus carried on from its first texts, tokens per record, and the cost of embedding them."""
    head = docs.orderBy(order).limit(sample).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text_col))), lambda x: x[text_col]), " ").alias("joined"))
    per_char = head.select(F.lit(1).alias("k"), (token_estimate(F.col("joined")) / F.length("joined")).alias("rate"))
    total = docs.agg(F.sum(F.length(text_col)).alias("chars"), F.count("*").alias("n")).withColumn("k", F.lit(1))
    tokens = F.floor(F.col("rate") * F.col("chars"))
    both = total.join(F.broadcast(per_char), "k")
    return both.select("chars", "n", tokens.cast("bigint").alias("tokens"), F.round(tokens / F.col("n"), 6).alias("tokens_per_record"), F.round(tokens / 1000 * EMBEDDING_PRICE, 9).alias("embedding_cost"))
