"""Daily spend: totals with a stop latch, running sums, one alert a day, and the cost of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeflow.functions.dates import BUDGET_ZONE, budget_day


def daily_budget(usage: DataFrame, ts: Column, cost: Column, limit_usd: float, timezone: str = BUDGET_ZONE) -> DataFrame:
    """AGG1: spend per day of the budget's zone and whether it reached the limit."""
    total = F.sum(cost)
    return usage.groupBy(budget_day(ts, timezone).alias("day")).agg(F.round(total, 2).alias("spent_usd"), (total >= F.lit(limit_usd)).alias("stopped"))


def running_spend(usage: DataFrame, ts: str, cost: str, key: str, limit_usd: float, timezone: str = BUDGET_ZONE) -> DataFrame:
    """WIN3: each call with its day's spend so far, and whether the latch is set by then. Sums run
    within minutes, all over the cluster, and over the minutes of a day, of which there are few; so no
    task has a whole day's calls."""
    so_far = W.unboundedPreceding
    minute = W.partitionBy("day", "_minute").orderBy(ts, key).rowsBetween(so_far, 0)
    calls = usage.withColumn("day", budget_day(F.col(ts), timezone)).withColumn("_minute", F.date_trunc("minute", F.col(ts)))
    calls = calls.withColumn("_spent", F.sum(cost).over(minute)).withColumn("_most", F.max("_spent").over(minute))
    earlier = W.partitionBy("_day").orderBy("_at").rowsBetween(so_far, -1)
    minutes = calls.groupBy(F.col("day").alias("_day"), F.col("_minute").alias("_at")).agg(F.sum(cost).alias("_sum"), F.max("_most").alias("_peak"))
    minutes = minutes.withColumn("_before", F.sum("_sum").over(earlier)).withColumn("_top", F.max(_plus("_before", "_peak")).over(earlier))
    out = calls.join(minutes, F.col("day").eqNullSafe(F.col("_day")) & F.col("_minute").eqNullSafe(F.col("_at")), "left")
    top = F.greatest("_top", _plus("_before", "_most"))
    return out.withColumn("running", _plus("_before", "_spent")).withColumn("stopped", top >= F.lit(limit_usd)).drop("_minute", "_spent", "_most", "_day", "_at", "_sum", "_peak", "_before", "_top")


def _plus(a: str, b: str) -> Column:
    """The sum, in which null counts as nothing; null if both are."""
    return F.coalesce(F.col(a) + F.col(b), a, b)


def alerts(usage: DataFrame, ts: str, cost: str, key: str, limit_usd: float, timezone: str = BUDGET_ZONE) -> DataFrame:
    """WIN6: the first call of each day at which the limit is reached."""
    hit = running_spend(usage, ts, cost, key, limit_usd, timezone).filter("stopped")
    return hit.withColumn("n", F.row_number().over(W.partitionBy("day").orderBy(ts, key))).filter("n = 1").drop("n")


def call_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """JON8: cost of each call: tokens that weren't cached at the input price, cached ones at the
    cached price, completions at the output price. Calls without usage or price cost nothing."""
    fresh = F.greatest(F.col("prompt_tokens") - F.coalesce("cached_tokens", F.lit(0)), F.lit(0))
    cost = fresh * F.col("input_cost") + F.coalesce("cached_tokens", F.lit(0)) * F.col("cached_cost") + F.col("completion_tokens") * F.col("output_cost")
    return usage.join(prices, "model", "left").withColumn("cost_usd", F.coalesce(cost, F.lit(0.0)))
