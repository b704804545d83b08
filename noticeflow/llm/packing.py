"""Operator 7: best-fit packing of token sequences, bulk-synchronously.

Lengths are whole numbers up to the capacity, so the documents in order of length and the gaps in
order of size are both kept run-length coded: a run is (length, ranks from, to) or (gap, sequences
from, to). Runs are dealt by ranges of sizes, and work goes in supersteps; in each one every range
sorts its documents and gaps and sweeps over them:

- documents whose length is exactly that of a gap take it. A larger document can't, and best fit
  would choose no other, so all ranges make these matches at once;
- the range whose turn it is (from the largest sizes on) sweeps through all its documents, the longest
  first: the successor of their length among the gaps, the smallest that is large enough, takes as
  many as fit, then the next; where none is left a new sequence opens. Document and gap of equal rank
  meet, which settles conflicts between documents that want one gap;
- gaps are updated and go to the range of their new size, those that nothing took to the next range,
  and the next superstep starts.

This places every document where one-by-one best-fit decreasing would put one of its length. The
driver counts: pieces per length (2047 at most) and the ranges that still have documents.

On the executors each piece gets its rank among those of its length: its rank within its task plus
the pieces of earlier tasks, and finds its run by binary search. Pieces of full length are sequences
of their own and take no part. Tokenized pieces are written to shared storage before ranks are
given, so that a task that runs again can't give others.

Null text counts as empty and makes one piece, the separator alone. Rows that repeat are packed each
for itself; a null id stays null. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import chunks, columns, give_back, materialize

CAPACITY, SEPARATOR, RANGES = 2048, 0, 8


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and task, task_rank: the how-manieth of its length
    in its task a piece is. Documents of more than `capacity` tokens are cut, others are not."""
    path = vocabulary or bpe.default_vocabulary()
    end = SEPARATOR.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, seen, task = bpe.encoder(path), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            for part in chunks(batch):
                row, out = [], []
                for i, (ids, _) in enumerate(e.batch(part.column("text"), with_labels=False)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        row.append(i)
                        out.append((k, at // 4, n, zlib.crc32(own), seen[n]))
                        seen[n] += 1
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row)), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)), pa.array([task] * len(out), pa.int32())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task_rank", "task"],
                )
        give_back()

    source = columns(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task_rank bigint, task int")


#: A run in the supersteps: its range, whether it is documents, gaps or placed, its size, how many;
#: of documents: the first rank; of gaps: the first sequence; of placed ones also where they go.
RUN = ["range", "kind", "size", "n", "rank", "first", "offset", "each"]
RUN_SCHEMA = "range int, kind string, size bigint, n bigint, rank bigint, first bigint, offset bigint, each bigint"


def range_of(size: int, capacity: int) -> int:
    """Ranges of sizes, the largest sizes first."""
    return min(RANGES - 1, (capacity - size) * RANGES // capacity)


def sweep(runs: list[tuple], own: int, turn: int, capacity: int) -> list[tuple]:
    """One superstep of the range `own`, where it is the turn of the range `turn`: its runs after it."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    for _, kind, size, n, _, first, *_ in sorted(runs):
        if kind == "gap":
            gaps.setdefault(size, []).append((first, n))
    sizes = sorted(gaps)
    out: list[tuple] = []
    made = turn << 40

    def leave(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, count))

    for length, rank, n in sorted(((r[2], r[4], r[3]) for r in runs if r[1] == "doc"), key=lambda x: (-x[0], x[1])):
        end = rank + n
        while rank < end:
            i = bisect_left(sizes, length)
            if i < len(sizes) and (own == turn or sizes[i] == length):
                size = sizes[i]
                first, count = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(i)
            elif own == turn:
                size, first, count = capacity, made, -(-(end - rank) // (capacity // length))
                made += count
            else:
                out.append((own, "doc", length, end - rank, rank, 0, 0, 0))
                break
            each = size // length
            full, rest = divmod(min(end - rank, each * count), each)
            taken = full * each + rest
            out.append((own, "placed", length, taken, rank, first, capacity - size, each))
            leave(size - each * length, first, full)
            if rest:
                leave(size - rest * length, first + full, 1)
            leave(size, first + full + bool(rest), count - full - bool(rest))
            rank += taken
    least = own + 1 if own <= turn else own  # a range that had its turn needs no gaps
    for size, held in gaps.items():
        out += [(max(least, range_of(size, capacity)), "gap", size, n, 0, first, 0, 0) for first, n in held]
    return out


def documents_of(histogram: dict[int, int], capacity: int) -> list[tuple]:
    return [(range_of(k, capacity), "doc", k, n, 0, 0, 0, 0) for k, n in histogram.items() if k and n]


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The supersteps in one process. Runs (length, rank from, rank to, first sequence, offset, n):
    the documents of this length and these ranks go, n to a sequence, into sequences from the first
    on, starting at the offset."""
    state, placed = documents_of(histogram, capacity), []
    for turn in range(RANGES):
        state = [x for own in range(RANGES + 1) for x in sweep([r for r in state if r[0] == own], own, turn, capacity)]
        placed += [x for x in state if x[1] == "placed"]
        state = [x for x in state if x[1] != "placed"]
    return [(size, rank, rank + n, first, offset, each) for _, _, size, n, rank, first, offset, each in placed]


def _superstep(turn: int, capacity: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def step(key: tuple, runs: pa.Table) -> pa.Table:
        rows = sweep(list(zip(*(runs.column(c).to_pylist() for c in RUN), strict=True)), key[0].as_py(), turn, capacity)
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.int32(), pa.string(), *[pa.int64()] * 6])], RUN)

    return step


def placements(spark: SparkSession, histogram: dict[int, int], capacity: int) -> DataFrame:
    """The supersteps over ranges of runs: the rows `placed` of RUN."""
    first = documents_of(histogram, capacity)
    state, done = spark.createDataFrame(first, RUN_SCHEMA), []
    for turn in sorted({r[0] for r in first}):
        after = materialize(state.repartition(RANGES, "range").groupBy("range").applyInArrow(_superstep(turn, capacity), RUN_SCHEMA), "sweep")
        state = after.filter("kind != 'placed'")
        done.append(after.filter("kind = 'placed'"))
    return reduce(DataFrame.unionAll, done) if done else state


def pack(docs: DataFrame, capacity: int = CAPACITY, **names: str | None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Sequences of one full piece have negative ids."""
    cut = materialize(pieces(docs, capacity, **names), "pieces")
    part = cut.filter(F.col("length") < capacity)
    counts = part.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    counts = materialize(counts.withColumn("before", F.coalesce(before, F.lit(0))), "piece-counts")
    # At most capacity - 1 rows: one for each length.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # The lengths' runs: some for each length and each gap that its documents were put into.
    found = placements(docs.sparkSession, histogram, capacity).select("size", "rank", "first", "offset", "each").toArrow()
    runs = np.stack([found.column(i).to_numpy() for i in range(5)], axis=1) if len(found) else np.array([(capacity, 0, 0, 0, 1)])
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    kind = cut.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = runs[:, 0]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            lo, hi = np.searchsorted(lengths, length, "left"), np.searchsorted(lengths, length, "right")
            while (hi - lo > 1).any():  # the last run of its length that starts at its rank or before
                mid = (lo + hi) // 2
                right = (runs[np.minimum(mid, len(runs) - 1), 1] <= rank) & (hi - lo > 1)
                lo, hi = np.where(right, mid, lo), np.where(right | (hi - lo <= 1), hi, mid)
            run = runs[lo]
            at = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(run[:, 2] + at // run[:, 4]), pa.array(run[:, 3] + at % run[:, 4] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = part.join(counts.select("length", "task", "before").hint("merge"), ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("task_rank")).alias("rank")
    )
    placed = ranked.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    whole = cut.filter(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (-F.lit(1) - F.shiftleft(F.col("task").cast("bigint"), 40) - F.col("task_rank")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )
    return placed.unionByName(whole)
