"""Recorded answers of external calls: one row per document, stage and attempt."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions.money import is_range, non_zero
from noticeflow.functions.text import fold_empty

MAX_ATTEMPTS = {"estimated_amount": 5, "address_admin": 3, "type_repair": 3, "product_category": 1}


def first_valid(answers: DataFrame, key: str, value: Column, valid: Column, most: int) -> DataFrame:
    """AGG5: the first valid answer of at most so many attempts, else the first one."""
    own = answers.filter(F.col("attempt") <= most).withColumn("_v", F.coalesce(value, F.lit(""))).withColumn("_ok", valid)
    return own.groupBy(key).agg(F.coalesce(F.min_by(F.when(F.col("_ok"), F.col("_v")), F.when(F.col("_ok"), F.col("attempt"))), F.min_by("_v", "attempt")).alias("value"))


def price_clue(winner_amount: Column, candidates: Column) -> Column:
    """AGG4: the winner's amount, else the first winner's price, else the first candidate's, else
    the first price; what is zero doesn't count."""
    priced = F.filter(candidates, lambda c: non_zero(c["candidatePrices"].cast("string")))
    of = lambda kind: F.get(F.filter(priced, lambda c: c["type"] == kind), F.lit(0))["candidatePrices"]
    return F.coalesce(F.when(winner_amount != 0, winner_amount), of("中标"), of("中标候选人"), F.get(priced, F.lit(0))["candidatePrices"])


def settled_range(current: Column, clue: Column, budget: Column, effective_lots: Column, answer: Column) -> Column:
    """A.10: '' without any clue; a valid range stays; else the recorded answer."""
    none = clue.isNull() & F.coalesce(budget == 0, F.lit(True)) & (effective_lots == 0)
    return F.when(none, "").when(is_range(fold_empty(current)), fold_empty(current)).otherwise(F.coalesce(answer, F.lit("")))


def call(rows: DataFrame, client: Callable[[str], str], prompt: str, out: str = "payload") -> DataFrame:
    """Live calls, opt-in: a client of your own, per partition; a failed call gives ''."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for p in frame[prompt]:
                try:
                    answers.append(client(p))
                except Exception:
                    answers.append("")
            yield frame.assign(**{out: answers})

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))
