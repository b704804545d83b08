"""Stateful streams against their batch counterparts, and over restarts and replays."""

import random
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noticeflow.plans import budget
from noticeflow.streaming import events as ev
from noticeflow.streaming import sessions as ss

T0 = datetime(2026, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of a stateful stream starts a Python worker."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def land(df, folder, name):
    """One more file of a stream."""
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def one_by_one(rows, until, seconds, timeout):
    """Sessions of (session, seconds after T0, kind) as a clock would see them."""
    out = []
    for session in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == session and r[1] < until), key=lambda r: r[1])
        if not own:
            continue
        start = last = own[0][1]
        todo, ended = list(own), False
        while not ended:
            due = min(last + seconds, start + timeout)
            if todo and todo[0][1] <= due and todo[0][1] < start + timeout:
                _, last, kind = todo.pop(0)
                out.append((session, last, kind, None))
                ended = kind in ("done", "error")
            elif due >= until:
                break
            elif due == start + timeout:
                out.append((session, due, "error", "timeout"))
                ended = True
            else:
                out.append((session, due, "heartbeat", None))
                last = due
    return sorted(out, key=str)


def rows_of(seed=1, sessions=12, n=90):
    rnd = random.Random(seed)
    times = rnd.sample(range(2000), n)  # no two of a session at once
    return [(rnd.randrange(sessions), t, rnd.choices(["item", "start", "done", "error"], [9, 2, 1, 1])[0]) for t in times]


def frame(spark, rows):
    return spark.createDataFrame([(s, T0 + timedelta(seconds=t), k) for s, t, k in rows], "session int, ts timestamp_ntz, event_type string")


def seen(rows):
    return sorted(((r.session, (r.at - T0).total_seconds(), r.kind, r.message) for r in rows), key=str)


@pytest.mark.parametrize("seconds, timeout", [(30, 300), (45, 90), (1000, 100)])
def test_recorded_sessions(spark, seconds, timeout):
    rows = rows_of()
    until = 1500
    got = ss.session_events(frame(spark, rows), "session", "ts", [], T0 + timedelta(seconds=until), seconds=seconds, timeout=timeout).collect()
    want = one_by_one(rows, until, seconds, timeout)
    assert seen(got) == want and {k for _, _, k, _ in want} >= {"error"}


def test_event_time_stream_like_the_batch(spark, tmp_path):
    rows = rows_of(seed=4)
    mixed = sorted(rows, key=lambda r: r[1] + random.Random(r[1]).randrange(60))  # up to a minute out of order
    last = [(99, 5000, "start")]
    for i in range(0, len(mixed), 15):
        land(frame(spark, mixed[i : i + 15]), tmp_path / "in", f"{i:03}")
    land(frame(spark, last), tmp_path / "in", "x1")
    got = []
    live = ss.live_sessions(stream(spark, tmp_path / "in", frame(spark, rows).schema), "session", "ts", seconds=50, timeout=400, keep=100_000, watermark="2 minutes")
    ev.run_available(live, str(tmp_path / "c"), lambda df, _: got.extend(df.collect())).awaitTermination(120)
    want = [r for r in one_by_one(rows, 5000 - 120, 50, 400)]
    assert seen(got) == want and {k for _, _, k, _ in want} >= {"heartbeat", "error", "done", "item"}


def test_live_session_by_processing_time(spark, tmp_path):
    """Silence, the deadline, and an event after the end; nothing is left then."""
    got = []
    schema = frame(spark, rows_of()).schema
    land(frame(spark, [(1, 0, "start"), (2, 0, "start")]), tmp_path / "in", "a")
    live = ss.live_sessions(stream(spark, tmp_path / "in", schema), "session", "ts", seconds=2, timeout=9, keep=4)
    run = live.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").foreachBatch(lambda df, _: got.extend(df.collect())).start()
    of = lambda s: [(r.kind, r.message) for r in sorted(got, key=lambda r: r.at) if r.session == s]
    try:
        _wait(lambda: ("heartbeat", None) in of(2))
        land(frame(spark, [(2, 1, "done")]), tmp_path / "in", "b")
        _wait(lambda: ("done", None) in of(2))
        land(frame(spark, [(2, 2, "item")]), tmp_path / "in", "c")  # after the end
        _wait(lambda: ("error", "timeout") in of(1))
        at = {r.kind: r.at for r in got if r.session == 1}
        assert (at["error"] - at["start"]).total_seconds() == 9
        assert of(1)[0] == ("start", None) and of(1).count(("heartbeat", None)) == 4 and of(1)[-1] == ("error", "timeout")
        assert of(2)[-1] == ("done", None) and ("item", None) not in of(2)
        _wait(lambda: run.lastProgress and sum(o["numRowsTotal"] for o in run.lastProgress["stateOperators"]) == 0)
        assert of(2)[-1] == ("done", None)
    finally:
        run.stop()


def _wait(done, seconds=90):
    end = time.time() + seconds
    while not done():
        assert time.time() < end, "not within the time"
        time.sleep(0.3)


def test_latch_over_restarts(spark, tmp_path):
    def usage(rows):
        return spark.createDataFrame(rows, "ts timestamp_ntz, cost double").coalesce(1)

    def go(limit):
        out = {}
        latch = ss.spend_latch(stream(spark, tmp_path / "in", usage([]).schema), "ts", "cost", limit, "America/New_York")
        ev.run_available(latch, str(tmp_path / "c"), lambda df, _: [out.setdefault(r.day, []).append((r.spent_usd, r.stopped, r.alert)) for r in df.collect()], "update").awaitTermination(120)
        return out

    # both sides of the day on which clocks change: midnight is 5 and then 4 hours behind
    first = [(datetime(2026, 3, 8, 4, 59), 1.0), (datetime(2026, 3, 8, 5, 0), 2.0), (datetime(2026, 3, 9, 3, 59), 4.0), (datetime(2026, 3, 9, 4, 0), 8.0), (None, 50.0), (datetime(2026, 3, 9, 5, 0), None)]
    land(usage(first), tmp_path / "in", "a")
    out = go(6.0)
    assert out == {date(2026, 3, 7): [(1.0, False, False)], date(2026, 3, 8): [(6.0, True, True)], date(2026, 3, 9): [(8.0, True, True)]}
    batch = budget.daily_budget(usage(first).filter("ts is not null"), F.col("ts"), F.col("cost"), 6.0, "America/New_York")
    assert {r.day: (r.spent_usd, r.stopped) for r in batch.collect()} == {d: x[-1][:2] for d, x in out.items()}
    # restarted with a higher limit, and costs below zero: still stopped, and not said again
    land(usage([(datetime(2026, 3, 8, 12, 0), -5.0)]), tmp_path / "in", "b")
    land(usage([(datetime(2026, 3, 8, 13, 0), 0.5), (datetime(2026, 3, 7, 13, 0), 0.5)]), tmp_path / "in", "c")
    out = go(1000.0)
    assert out == {date(2026, 3, 8): [(6.0, True, False), (6.5, True, False)], date(2026, 3, 7): [(1.5, False, False)]}


def test_first_sightings_wait_for_outcomes(spark, tmp_path):
    """The stream's decisions are the batch's, whichever way pages and outcomes are cut into batches."""
    rnd = random.Random(3)
    pages = [(i, f"k{rnd.randrange(9)}", rnd.random() < 0.5) for i in range(30)]
    batch = spark.createDataFrame(pages, "page bigint, k string, settles boolean")
    want = {r.page: r.decision for r in ss.settled_first(batch, ["k"], ["page"], F.col("settles")).collect()}
    schema = "k string, page bigint, arrival bigint, is_outcome boolean, settles boolean"
    settles = {p: s for p, _, s in pages}
    keys = {p: k for p, k, _ in pages}
    got, at = {}, 0
    for part in range(0, 30, 15):
        land(spark.createDataFrame([(k, p, at + i, False, None) for i, (p, k, _) in enumerate(pages[part : part + 15])], schema), tmp_path / "in", f"p{part:02}")
        at += 15
        while True:  # outcomes of what is in work, until nothing new is
            new = {}
            decided = ss.settled_stream(stream(spark, tmp_path / "in", spark.createDataFrame([], schema).schema), "k")
            ev.run_available(decided, str(tmp_path / "c"), lambda df, _: new.update({r.page: r.decision for r in df.collect()})).awaitTermination(120)
            got |= new
            ask = [p for p, d in new.items() if d == ss.PROCESS]
            if not ask:
                break
            land(spark.createDataFrame([(keys[p], p, at + i, True, settles[p]) for i, p in enumerate(ask)], schema), tmp_path / "in", f"o{at:04}")
            at += len(ask)
    assert got == want and set(want.values()) == {ss.PROCESS, ss.DUPLICATE}


def test_delivery_repeats_itself(spark, tmp_path):
    rows = [(i, "item" if i % 5 else "start", 1000 - i) for i in range(100)]
    batch = spark.createDataFrame(rows, "id int, event_type string, t int")
    sink = ss.bounded_sink(str(tmp_path / "out"), ["t", "id"], most=30)
    sink(batch.repartition(4), 0)
    read = lambda: sorted(r.id for r in spark.read.parquet(str(tmp_path / "out/items")).collect())
    want = sorted([i for i in range(0, 100, 5)] + [i for i in range(99, -1, -1) if i % 5][:30])
    assert read() == want
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out/ledger")).select("batch_id", "delivered", "dropped").collect()] == [(0, 50, 50)]
    sink(batch.limit(3), 0)  # delivered already
    assert read() == want
    (tmp_path / "out/ledger/batch_id=0/_SUCCESS").unlink()  # lost before the ledger had it
    sink(batch.repartition(7), 0)
    assert read() == want
    sink(batch.filter("id < 5"), 1)
    assert {(r.batch_id, r.dropped) for r in spark.read.json(str(tmp_path / "out/ledger")).collect()} == {(0, 50), (1, 0)}
