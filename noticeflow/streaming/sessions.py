"""Stateful streams: live sessions with heartbeats and a deadline, the day's spend with a latch, first
sightings settled by their outcome, and bounded delivery that a replay repeats. Each has its batch
counterpart, which queries and tests compare it with.

State is kept by RocksDB on the executors and in the checkpoint. What a key holds is bounded: a
session's times and, in event time, its events not yet due; a day's sum and latch; a key's waiting
pages. A session's timers remove what it leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from noticeflow.functions.dates import BUDGET_ZONE, budget_day
from noticeflow.streaming.events import HEARTBEAT_SECONDS, QUEUE, TERMINAL, TIMEOUT_SECONDS, delivered

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# What the session's own events say.
HEARTBEAT, ERROR, TIMEOUT = "heartbeat", "error", "timeout"
PROCESS, DUPLICATE = "process", "skipped_duplicate"


def _stateful(stream: DataFrame, by: str, processor: StatefulProcessor, schema: str, mode: str, time: str) -> DataFrame:
    """These operators need the RocksDB store, so the session is set to it."""
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    return stream.groupBy(by).transformWithStateInPandas(processor, schema, mode, time)


# ---------------------------------------------------------------- live sessions


def session_events(events: DataFrame, session: str, ts: str, order: list[str], until: datetime, kind: str = "event_type", seconds: int = HEARTBEAT_SECONDS, timeout: int = TIMEOUT_SECONDS) -> DataFrame:
    """STM2-4 over recorded events: session, at, kind and message of what a client sees before `until`.
    A session starts with its first event. Events count up to and with the first terminal one, and
    before the deadline; after so many seconds without output comes a heartbeat (an event at the same
    time goes first and puts it off); a session without an end gets `error: timeout` at its deadline.
    Rows without a session or time are left out."""
    known = events.filter(F.col(session).isNotNull() & F.col(ts).isNotNull() & (F.col(ts) < F.lit(until)))
    earlier = W.partitionBy(session).orderBy(ts, *order).rowsBetween(W.unboundedPreceding, -1)
    known = known.withColumn("_ended", F.coalesce(F.max(F.col(kind).isin(TERMINAL)).over(earlier), F.lit(False))).filter(~F.col("_ended"))
    known = known.withColumn("_deadline", F.min(ts).over(W.partitionBy(session)) + F.make_dt_interval(secs=F.lit(timeout))).filter(F.col(ts) < F.col("_deadline"))
    following = F.lead(ts).over(W.partitionBy(session).orderBy(ts, *order))
    known = known.withColumn("_next", following).withColumn("_last", F.col("_next").isNull() & ~F.coalesce(F.col(kind).isin(TERMINAL), F.lit(False)))
    quiet = F.when(F.col("_last"), F.least("_deadline", F.lit(until).cast("timestamp_ntz"))).otherwise(F.coalesce("_next", ts))
    # heartbeats strictly before what ends the silence
    gap = lambda a, b: F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    beats = F.greatest(F.ceil(gap(F.col(ts), quiet) / (seconds * 1_000_000)) - 1, F.lit(0))
    own = F.struct(F.col(ts).alias("at"), F.col(kind).alias("kind"), F.lit(None).cast("string").alias("message"))
    beat = F.transform(F.sequence(F.lit(1), beats.cast("int")), lambda i: F.struct((F.col(ts) + F.make_dt_interval(secs=i * seconds)).alias("at"), F.lit(HEARTBEAT).alias("kind"), F.lit(None).cast("string").alias("message")))
    over = F.struct(F.col("_deadline").alias("at"), F.lit(ERROR).alias("kind"), F.lit(TIMEOUT).alias("message"))
    rows = F.concat(F.array(own), F.when(beats > 0, beat).otherwise(F.array().cast("array<struct<at:timestamp_ntz,kind:string,message:string>>")), F.when(F.col("_last") & (F.col("_deadline") < F.lit(until)), F.array(over)).otherwise(F.array().cast("array<struct<at:timestamp_ntz,kind:string,message:string>>")))
    return known.select(session, F.explode(rows).alias("r")).select(session, "r.*")


class Session(StatefulProcessor):
    """One session's clock. Times are milliseconds. `clock`: when it started and last put something
    out, and whether it has ended; a session that has ended drops what comes until it is forgotten."""

    def __init__(self, session: str, ts: str, kind: str, seconds: int, timeout: int, keep: int, event_time: bool):
        self.names, self.beat, self.timeout, self.keep, self.event_time = (session, ts, kind), seconds * 1000, timeout * 1000, keep * 1000, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "started long, last long, ended boolean")
        self.waiting = handle.getListState("waiting", "at long, kind string")

    def _due(self, started: int, last: int) -> int:
        return min(last + self.beat, started + self.timeout)

    def _run(self, key: tuple, events: list[tuple[int, str | None]], now: int) -> Iterator[tuple[int, str | None, str | None]]:
        """What is put out for events in order of time, and then up to `now`, exclusive in event time
        (events of that moment may still come)."""
        started, last, ended = self.clock.get() if self.clock.exists() else (None, None, False)
        for at, kind in [*events, (now, None)]:
            closing = at == now and kind is None
            if started is None and not closing:
                started = last = at
            while started is not None and not ended:
                due = self._due(started, last)
                over = due == started + self.timeout
                if due > at or due == at and not (over and not (closing and self.event_time) or closing and not self.event_time):
                    break
                last, ended = due, over
                yield (due, ERROR, TIMEOUT) if over else (due, HEARTBEAT, None)
            if not closing and not ended:
                last, ended = at, kind in TERMINAL
                yield at, kind, None
        if started is not None:
            self.clock.update((started, last, ended))
            self._timers(now + self.keep if ended else self._due(started, last) + self.event_time)

    def _timers(self, at: int) -> None:
        """One timer: the next moment at which something is to be done."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def _frame(self, key: tuple, rows: list[tuple[int, str | None, str | None]]) -> pd.DataFrame:
        at = pd.to_datetime([r[0] for r in rows], unit="ms")
        return pd.DataFrame({self.names[0]: [key[0]] * len(rows), "at": at, "kind": [r[1] for r in rows], "message": [r[2] for r in rows]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, ts, kind = self.names
        if not self.event_time:
            now = timerValues.getCurrentProcessingTimeInMs()
            out = list(self._run(key, [(now, k) for frame in rows for k in frame[kind]], now))
            if out:
                yield self._frame(key, out)
            return
        if self._ended():
            return
        for frame in rows:
            at = frame[ts].astype("datetime64[ms]").astype("int64")
            self.waiting.appendList(list(zip(at.tolist(), frame[kind].tolist(), strict=True)))
        first = min(at for at, _ in self.waiting.get()) + 1
        self._timers(min([first, *self.handle.listTimers()]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._ended():  # nothing else has a timer then
            self.clock.clear()
            return
        if self.event_time:
            now = timerValues.getCurrentWatermarkInMs()
            held = list(self.waiting.get()) if self.waiting.exists() else []
            out = list(self._run(key, sorted((x for x in held if x[0] < now), key=lambda x: x[0]), now))
            rest = [] if self._ended() else [x for x in held if x[0] >= now]
            if rest:
                self.waiting.put(rest)
                self._timers(min([min(at for at, _ in rest) + 1, *self.handle.listTimers()]))
            elif held:
                self.waiting.clear()
        else:
            out = list(self._run(key, [], timerValues.getCurrentProcessingTimeInMs()))
        if out:
            yield self._frame(key, out)

    def _ended(self) -> bool:
        return self.clock.exists() and self.clock.get()[2]


def live_sessions(events: DataFrame, session: str, ts: str, kind: str = "event_type", seconds: int = HEARTBEAT_SECONDS, timeout: int = TIMEOUT_SECONDS, keep: int = 600, watermark: str | None = None) -> DataFrame:
    """STM3, STM4: the stream of what clients see: session, at, kind, message. By processing time,
    where events go out as they come; with a watermark by event time, where they go out in order of
    time once the watermark has passed them, as session_events puts them. Events after the end are
    dropped for so many seconds (`keep`), after which nothing of the session is left."""
    rows = events.select(session, F.col(ts).cast("timestamp").alias(ts), kind).filter(F.col(session).isNotNull() & F.col(ts).isNotNull())
    if watermark is not None:
        rows = rows.withWatermark(ts, watermark)
    id_type = rows.schema[session].dataType.simpleString()
    processor = Session(session, ts, kind, seconds, timeout, keep, watermark is not None)
    return _stateful(rows, session, processor, f"{session} {id_type}, at timestamp_ntz, kind string, message string", "append", "EventTime" if watermark is not None else "ProcessingTime")


# ---------------------------------------------------------------- spend


class Latch(StatefulProcessor):
    """A day's spend, whether it is stopped, and whether that was said."""

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("spend", "spent double, stopped boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spent, stopped = self.state.get() if self.state.exists() else (0.0, False)
        before = stopped
        for frame in rows:
            spent += float(frame["spent"].sum())
        stopped = stopped or spent >= self.limit > 0
        self.state.update((spent, stopped))
        yield pd.DataFrame({"day": [key[0]], "spent_usd": [spent], "stopped": [stopped], "alert": [stopped and not before]})


def spend_latch(usage: DataFrame, ts: str, cost: str, limit_usd: float, timezone: str = BUDGET_ZONE) -> DataFrame:
    """STM8: after each batch day, spent_usd, stopped and alert of the days it touched. Days are those
    of the zone, daylight saving included; only costs above zero are added. The latch never falls: not
    by a restart from the checkpoint, nor by a higher limit then. alert is true once a day. Each task
    sums its rows by day before they are shuffled, so a busy day is a row a task. Calls without a time
    are left out. State is a row a day."""
    rows = usage.filter(F.col(ts).isNotNull()).select(budget_day(F.col(ts), timezone).cast("string").alias("day"), F.greatest(F.coalesce(F.col(cost).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("spent"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, float] = {}
        for batch in batches:
            days, which = np.unique(batch.column("day").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for day, spent in zip(days.tolist(), np.bincount(which, batch.column("spent").to_numpy(), len(days)).tolist(), strict=True):
                total[day] = total.get(day, 0.0) + spent
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], ["day", "spent"])

    latched = _stateful(rows.mapInArrow(sums, rows.schema), "day", Latch(limit_usd), "day string, spent_usd double, stopped boolean, alert boolean", "update", "None")
    return latched.withColumn("day", F.to_date("day"))


# ---------------------------------------------------------------- first sightings


def settled_first(rows: DataFrame, keys: list[str], order: list[str], settles: Column) -> DataFrame:
    """JON1: rows with `decision`: a key's rows are processed up to and with the first whose outcome
    settles it, later ones are duplicates. Nulls of `settles` don't settle."""
    earlier = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.coalesce(settles, F.lit(False))).over(earlier), F.lit(False))
    return rows.withColumn("decision", F.when(done, DUPLICATE).otherwise(PROCESS))


class Sighting(StatefulProcessor):
    """A key's page in work, whether the key is settled, and the pages that wait."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sighting", "page long, settled boolean")
        self.waiting = handle.getListState("waiting", "page long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        page, settled = self.state.get() if self.state.exists() else (None, False)
        queue = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        out: list[tuple[int, str]] = []
        frame = pd.concat(list(rows)).sort_values(["arrival", "page"], kind="stable")
        for doc, ends, settles in zip(frame["page"].tolist(), frame["is_outcome"].tolist(), frame["settles"].tolist(), strict=True):
            if not ends:
                queue.append(int(doc))
            elif page is not None and int(doc) == page:
                page, settled = None, settled or bool(settles)
            while queue and (settled or page is None):
                first = queue.pop(0)
                page = page if settled else first
                out.append((first, DUPLICATE if settled else PROCESS))
        self.state.update((page, settled))
        if queue:
            self.waiting.put([(x,) for x in queue])
        elif self.waiting.exists():
            self.waiting.clear()
        if out:
            yield pd.DataFrame({self.key: [key[0]] * len(out), "page": [p for p, _ in out], "decision": [d for _, d in out]})


def settled_stream(rows: DataFrame, key: str) -> DataFrame:
    """STM7, JON1: decisions over a stream of pages and outcomes: rows (key, page, arrival, is_outcome,
    settles). A page is processed if its key is neither settled nor in work; while one is in work, its
    key's other pages wait for the outcome. One that settles the key makes them duplicates, any other
    lets the next one through. The state is the ledger, a row a key on the executors' disks, and grows
    like it; a new checkpoint starts from a written one (operators.dedupe.unseen). Rows without a key
    are left out."""
    own = rows.filter(F.col(key).isNotNull()).select(key, F.col("page").cast("bigint").alias("page"), F.col("arrival").cast("bigint").alias("arrival"), "is_outcome", F.coalesce("settles", F.lit(False)).alias("settles"))
    kind = own.schema[key].dataType.simpleString()
    return _stateful(own, key, Sighting(key), f"{key} {kind}, page bigint, decision string", "append", "None")


# ---------------------------------------------------------------- delivery


def bounded_sink(path: str, order: list[str], most: int = QUEUE, kind: str = "event_type") -> Callable[[DataFrame, int], None]:
    """SNK3, STM1: a foreachBatch function that delivers at most so many items of each micro-batch to
    path/items and says how many went and were dropped in path/ledger, both by batch_id. A batch that
    the ledger holds was delivered; one that failed before it is replayed over what it left, and as
    the order tells its events apart, with the same items."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger/batch_id={batch_id}/_SUCCESS")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return
        marked = delivered(batch.withColumn("_batch", F.lit(batch_id)), order, kind, most, "_batch").drop("_batch")
        marked.filter(~F.col("dropped")).drop("dropped").write.mode("overwrite").parquet(f"{path}/items/batch_id={batch_id}")
        counts = marked.agg(F.count_if(~F.col("dropped")).alias("delivered"), F.count_if("dropped").alias("dropped"))
        counts.coalesce(1).write.mode("overwrite").json(f"{path}/ledger/batch_id={batch_id}")

    return run
