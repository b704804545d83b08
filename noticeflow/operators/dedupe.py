"""First-seen deduplication and unique names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WIN1: the first row of each key. Spark keeps one row per key on either side of the shuffle."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def unseen(rows: DataFrame, ledger: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """JON1: rows whose key isn't in the ledger, the first of each key."""
    return first_seen(rows.join(ledger.select(*keys), keys, "left_anti"), keys, order)


def unique_names(rows: DataFrame, title: Column, date: Column, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """WIN2: a file name per row: title and date; the second of a kind ends in _2 and so on. Names
    that exist already (title, date, taken) count first."""
    named = rows.withColumn("_title", title).withColumn("_date", F.coalesce(date, F.lit("")))
    n = F.row_number().over(W.partitionBy("_title", "_date").orderBy(*order))
    if existing is not None:
        named = named.join(existing.select(F.col("title").alias("_title"), F.col("date").alias("_date"), "taken"), ["_title", "_date"], "left")
        n = n + F.coalesce("taken", F.lit(0))
    named = named.withColumn("_n", n)
    suffix = F.when(F.col("_n") == 1, "").otherwise(F.concat(F.lit("_"), F.col("_n").cast("string")))
    return named.withColumn("file_name", F.concat("_title", F.lit("_"), "_date", suffix, F.lit(".json"))).drop("_title", "_date", "_n", "taken")
