"""The event stream of a crawl: frames, terminal events, silence, deadlines, bounded delivery."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

# Event types, limits.
TERMINAL = ["done", "error"]
HEARTBEAT_SECONDS, QUEUE, TIMEOUT_SECONDS = 30, 1000, 1800


def frame(payload: Column) -> Column:
    """SNK2: one server-sent event."""
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def event_of_status(status: Column) -> Column:
    """STM6: how a crawl's status shows; what isn't a success is an error."""
    return F.when(status == "success", "done").otherwise("error")


def until_terminal(events: DataFrame, session: str, order: list[str], kind: str = "event_type", terminal: list[str] = TERMINAL) -> DataFrame:
    """STM2: events up to and with the first terminal one of each session."""
    before = F.sum(F.col(kind).isin(terminal).cast("int")).over(W.partitionBy(session).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return events.withColumn("_ended", F.coalesce(before, F.lit(0))).filter("_ended = 0").drop("_ended")


def silences(events: DataFrame, session: list[str], ts: str, order: list[str], seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """WIN4, STM4: gaps of at least so many seconds, and how many heartbeats fall in each."""
    last = F.lag(ts).over(W.partitionBy(*session).orderBy(ts, *order))
    gap = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.col("last_ts").cast("timestamp"))
    return events.withColumn("last_ts", last).withColumn("gap_s", gap).filter(F.col("gap_s") >= seconds).withColumn("heartbeats", F.floor(F.col("gap_s") / seconds))


def with_heartbeats(events: DataFrame, session: str, kind: str = "event_type", seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """STM4: a stream's events (session, kind) and a heartbeat for each so many seconds of processing
    time without any, until a terminal one. State is one flag a session and goes with its end."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame({session: [key[0]], kind: ["heartbeat"]})
        else:
            ended = False
            for frame in frames:
                ended |= bool(frame[kind].isin(TERMINAL).any())
                yield frame[[session, kind]]
            if ended:
                if state.exists:
                    state.remove()
                return
        state.update((True,))
        state.setTimeoutDuration(seconds * 1000)

    rows = events.select(session, kind)
    return rows.groupBy(session).applyInPandasWithState(run, rows.schema, "live boolean", "append", "ProcessingTimeTimeout")


def stage_seconds(marks: DataFrame, run: str, stage: str, ts: str, order: list[str]) -> DataFrame:
    """AGG10: how long each stage of a run took, from its mark to the next one; the last mark only
    ends the stage before. A row `total` holds the whole run."""
    at = F.col(ts).cast("timestamp")
    seconds = lambda a, b: F.round((F.unix_micros(b) - F.unix_micros(a)) / 1e6, 3)
    following = F.lead(at).over(W.partitionBy(run).orderBy(ts, *order))
    each = marks.select(run, F.col(stage).alias("stage"), seconds(at, following).alias("seconds")).filter("seconds is not null")
    whole = marks.groupBy(run).agg(F.lit("total").alias("stage"), seconds(F.min(at), F.max(at)).alias("seconds"))
    return each.unionByName(whole)


def timed_out(ts: Column, start: Column, seconds: int = TIMEOUT_SECONDS) -> Column:
    """STM3"""
    return (F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))) >= seconds


def delivered(events: DataFrame, order: list[str], kind: str = "event_type", most: int = QUEUE, by: str = "batch") -> DataFrame:
    """SNK3, STM1: of each batch at most so many items get through and the rest are marked dropped;
    control events always do. The order must tell a batch's events apart. Only the first items of
    each task are ranked together, and their last one decides on all others."""
    n = F.row_number().over(W.partitionBy(by).orderBy(*order))
    place = F.struct(*order)
    first = events.filter(F.col(kind) == "item").select(F.col(by).alias("_by"), place.alias("_place"), n.alias("_n")).filter(F.col("_n") <= most)
    last = first.groupBy("_by").agg(F.max("_place").alias("_last"))
    known = events.join(last, F.col(by).eqNullSafe(F.col("_by")), "left")
    return known.withColumn("dropped", F.coalesce((F.col(kind) == "item") & ~(place <= F.col("_last")), F.lit(False))).drop("_by", "_last")


def read_events(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """STM1: landed event files as a stream; files per trigger are the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_seen_stream(events: DataFrame, keys: list[str], ts: str, watermark: str = "1 day") -> DataFrame:
    """STM7: the first row of each key, with state that a watermark bounds."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def daily_spend_stream(events: DataFrame, ts: str, cost: str, watermark: str = "2 days", limit_usd: float = float("inf"), offset_hours: int = 0) -> DataFrame:
    """STM8: running totals per day, kept in keyed state, and whether they reached the limit. Days
    begin at midnight of a zone that is so many hours ahead."""
    day = F.window(ts, "1 day", startTime=f"{-offset_hours % 24} hours")
    spent = events.withWatermark(ts, watermark).groupBy(day.alias("w")).agg(F.sum(cost).alias("spent"))
    return spent.select(F.to_date(F.col("w.start") + F.make_interval(hours=F.lit(offset_hours))).alias("day"), "spent", (F.col("spent") >= F.lit(limit_usd)).alias("stopped"))


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Works through what has landed, batch by batch, and stops."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
