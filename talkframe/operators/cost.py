"""Token cost of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.functions import fixed_values as fixed
from talkframe.functions.columns import round_to
from talkframe.operators.tables import small_table


def default_prices(spark) -> DataFrame:
    return small_table(spark, fixed.MODEL_PRICES, "model string, input_rate double, output_rate double")


def price_calls(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Add ``cost_usd`` and ``priced``. A model without a price costs 0.

    ``calls(run_id, stage, model, prompt_tokens, output_tokens, cached_tokens)``,
    ``prices(model, input_rate, output_rate)`` per million tokens, by default
    the known models. Cached tokens cost a quarter.
    """
    prices = default_prices(calls.sparkSession) if prices is None else prices
    fresh = F.greatest(F.lit(0), F.col("prompt_tokens") - F.col("cached_tokens"))
    cost = (
        fresh / 1_000_000 * F.col("input_rate")
        + F.col("cached_tokens") / 1_000_000 * F.col("input_rate") * fixed.CACHED_TOKEN_SHARE
        + F.col("output_tokens") / 1_000_000 * F.col("output_rate")
    )
    return (
        calls.join(prices, "model", "left")
        .withColumn("priced", F.col("input_rate").isNotNull())
        .withColumn("cost_usd", F.coalesce(cost, F.lit(0.0)))
        .drop("input_rate", "output_rate")
    )


def cost_by_stage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost by stage, and per run with a null stage.

    Token counts are summed per model before prices are looked up, so the join sees
    a handful of rows; cached tokens beyond the prompt are cut off per call first.
    """
    fresh = F.greatest(F.lit(0), F.col("prompt_tokens") - F.col("cached_tokens"))
    summed = calls.groupBy("run_id", "stage", "model").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cached_tokens").alias("cached_tokens"),
        F.sum(fresh).alias("_fresh"),
    )
    cost = (
        F.col("_fresh") / 1_000_000 * F.col("input_rate")
        + F.col("cached_tokens") / 1_000_000 * F.col("input_rate") * fixed.CACHED_TOKEN_SHARE
        + F.col("output_tokens") / 1_000_000 * F.col("output_rate")
    )
    priced = summed.join(prices, "model", "left").withColumn("_cost", F.coalesce(cost, F.lit(0.0)))
    return (
        priced.rollup("run_id", "stage")
        .agg(
            F.sum("calls").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("output_tokens").alias("output_tokens"), F.sum("cached_tokens").alias("cached_tokens"),
            round_to(F.sum("_cost"), 6).alias("cost_usd"), F.grouping_id().alias("_level"),
        )
        .filter("_level < 3")
        .withColumn("is_total", F.col("_level") == 1)
        .drop("_level")
    )


def unpriced_models(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Models in use that have no price, sorted."""
    return calls.select("model").distinct().join(prices, "model", "left_anti").orderBy("model")
