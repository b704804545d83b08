"""Operator 9: shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has VIRTUAL points on a ring of 64-bit hashes; a document belongs to the arc before the
next point clockwise of its own hash. A shard takes as many rows as its bound; what overflows goes on
clockwise to the next point whose shard has room. The bounds are the mean, rounded up for the first
(rows mod shards) shards and down for the others, so counts are at most one apart (law `rows`).

A row moves only if its arc's owner changes or it overflows before or after. With VIRTUAL points a
shard's arcs hold its share of the ring to about 3 %, so little overflows: from 40 to 41 shards about
3 % of the rows move, where 2.4 % have to.

The walk needs only how many rows each arc has (shards * VIRTUAL numbers, whatever the corpus): an
arc's rows, in order of hash, split into runs of ranks, each for one shard. Arcs claim room in ring
order from the arc after the ring's start, those that stay before those that move on. On the
executors a row's rank within its arc finds its run. Arcs are cut by hash, so a hot source or text
doesn't make a hot arc; rows of equal hash (exact repeats, equal texts without an id) are ranked task
by task, so however many there are, no one task ranks them all.

Defined results: a null text has size 16 and crc32 0 (that of no bytes). A null doc_id has a place on
the ring too, by its text alone. Rows that repeat are placed each for itself. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, materialize, mix

SHARDS, VIRTUAL = 40, 1024


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Points in order and the shard of each. A shard's points don't depend on how many there are."""
    number = np.repeat(np.arange(shards, dtype=np.uint64), virtual) * np.uint64(1 << 32) + np.tile(np.arange(virtual, dtype=np.uint64), shards)
    points = mix(mix(number + np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(points, kind="stable")
    return points[order], (number[order] >> np.uint64(32)).astype(np.int64)


def arcs_of(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The arc (the number of the next point clockwise) of each hash."""
    return np.searchsorted(points, hashes, "left") % len(points)


def bounded(counts: np.ndarray, owner: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, rank from, rank to, shard, slot of the first)."""
    total = int(counts.sum())
    room = np.array([total // shards + (i < total % shards) for i in range(shards)])
    slot = np.zeros(shards, np.int64)
    runs, over = [], {}

    def take(arc: int, rank: int, most: int, shard: int) -> int:
        n = min(most, int(room[shard]))
        if n:
            runs.append((arc, rank, rank + n, shard, int(slot[shard])))
            room[shard] -= n
            slot[shard] += n
        return n

    for arc, n in enumerate(counts.tolist()):
        taken = take(arc, 0, n, int(owner[arc]))
        if taken < n:
            over[arc] = taken
    after = list(range(len(owner)))  # the next point clockwise whose shard may have room

    def open_from(at: int) -> int:
        passed = []
        while True:
            if after[at] != at:
                passed.append(at)
                at = after[at]
            elif room[owner[at]]:
                break
            else:
                after[at] = (at + 1) % len(owner)
        for x in passed:
            after[x] = at
        return at

    for arc, rank in over.items():
        at = arc
        while rank < counts[arc]:
            at = open_from((at + 1) % len(owner))
            rank += take(arc, rank, int(counts[arc]) - rank, int(owner[at]))
    return runs


def shard(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    points, owner = ring(shards, virtual)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    source = columns(docs, doc_id=id_col, text=text_col).select("doc_id", (F.octet_length(raw) + 16).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    source = source.withColumn("hash", F.xxhash64("doc_id", "text_crc32", "size"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arcs_of(mix(hashes), points).astype(np.int32))], [*batch.schema.names, "arc"])

    located = source.mapInArrow(locate, f"doc_id {kind}, size bigint, text_crc32 bigint, hash bigint, arc int")
    located = materialize(located.withColumn("task", F.spark_partition_id()), "arcs")
    counts = np.zeros(len(points), np.int64)
    found = located.groupBy("arc").agg(F.count("*").alias("n")).toArrow()  # at most shards * virtual rows
    counts[found["arc"].to_numpy()] = found["n"].to_numpy()
    runs = np.array(bounded(counts, owner, shards) or [(0, 0, 0, 0, 0)], np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    # A row's rank: the rows of its arc with a smaller hash, or its own in an earlier task, and its place among the rest.
    same = ["arc", "hash", "task"]
    before = F.sum("n").over(W.partitionBy("arc").orderBy("hash", "task").rowsBetween(W.unboundedPreceding, -1))
    before = located.groupBy(*same).agg(F.count("*").alias("n")).select(*same, F.coalesce(before, F.lit(0)).alias("before"))
    place_in_task = F.row_number().over(W.partitionBy(*same).orderBy("doc_id", "text_crc32")) - 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = runs[:, 0] << 40 | runs[:, 1]
        for batch in batches:
            arc, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("arc", "rank"))
            run = runs[np.searchsorted(starts, arc << 40 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(["rows"] * batch.num_rows, pa.string()), pa.array(run[:, 3].astype(np.int32)), pa.array(run[:, 4] + rank - run[:, 1]), pa.nulls(batch.num_rows, pa.int32())],
                ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
            )

    ranked = located.withColumn("nth", place_in_task).join(before, same).withColumn("rank", F.col("before") + F.col("nth")).select("doc_id", "size", "text_crc32", "arc", "rank")
    return ranked.mapInArrow(place, f"doc_id {kind}, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int")
