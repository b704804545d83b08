"""Operator 11: hard-negative mining by bit-sliced integer products.

Components become floor(256 x). Anchors and rows are dealt into blocks by hash of their row's key, and
each pair of a block of anchors and a block of rows is a tile, one group of a co-grouped join whose
size is bounded by the block sizes. In a tile the rows' components are cut into bit-planes (two's
complement), most significant first, and after each step of planes

- the product of the anchor with what the planes so far are worth is known exactly;
- the planes left are worth 0 to 2**k - 1 a component, so the score lies between the product plus
  2**k - 1 times the anchor's negative components and plus 2**k - 1 times its positive ones;
- a pair goes on only as long as its interval reaches what it has to: the k-th best lower bound of its
  anchor and, for negatives, the range of scores of one of the anchor's positives.

The first step takes the upper planes in one product, as nothing can go before them. Scores of what is
left after the last plane are exact. Two joins follow one another: positives among the rows of the
anchor's label, a block at a time, then negatives in all others; the tiles' lists are merged by a
ranking that keeps k rows on either side of its shuffle. All rows are compared: the result is exact.

Defined results: rows with a null label, id or vector, or a null or non-finite component, take no
part; neither do rows whose whole-number vector has a squared norm over LARGEST, as their products need
not fit a long. Rows are compared with rows of their own length. A key, written once, tells rows apart,
so rows that repeat an id are anchors, positives and negatives each for itself. Ties go to the smaller
vec_id. An anchor without positives, and a positive without negatives in its range, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Tenths of the positive's score between which a negative's lies.
LEAST, MOST = 3, 9
ANCHOR_BLOCK, ROW_BLOCK = 512, 8192
#: Pairs of a tile that are looked at in one step (one anchor's at least).
PAIRS = 1 << 19
#: Planes of the first step, and of each later one.
FIRST, STEP = 4, 2
#: Nine times a score that this bounds still fits a long.
LARGEST = 2.0**59


def planes(x: np.ndarray) -> int:
    """Bits of two's complement that hold every component."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    return most.bit_length() + 1


def bounded(anchors: np.ndarray, rows: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) with their scores that keep(low, high) lets through at every step; `same`
    marks the pairs that don't count. low and high are matrices, -inf and inf where a pair has gone."""
    left = planes(rows)
    small = np.abs(anchors).sum(axis=1).max(initial=0) * (1 << left) < 1 << 24
    real = np.float32 if small else np.float64
    # float64 sums of large numbers round; this covers it
    slack = 0.0 if small else 1e-9 * float(np.abs(anchors).sum(axis=1).max(initial=0)) * float(1 << left)
    a = anchors.astype(real)
    under, over = np.minimum(a, 0).sum(axis=1)[:, None], np.maximum(a, 0).sum(axis=1)[:, None]
    part, alive, cols = np.zeros(same.shape, real), ~same, np.arange(rows.shape[0])
    step, new = FIRST, -1  # the first step takes the sign's plane and so all bits above, too
    while left > 0 and alive.any():
        step = min(step, left)
        left -= step
        part += (a @ (rows >> left & new).T.astype(real)) * real(1 << left)
        step, new = STEP, (1 << min(STEP, left)) - 1
        rest = real((1 << left) - 1)
        low = np.where(alive, part + rest * under - slack, -np.inf)
        high = np.where(alive, part + rest * over + slack, -np.inf)
        alive &= keep(low, high)
        used = alive.any(axis=0)
        if left and used.sum() < 0.7 * len(used):  # rows that no anchor needs any more
            rows, part, alive, cols = rows[used], part[:, used], alive[:, used], cols[used]
    i, j = np.nonzero(alive)
    scores = np.zeros(len(i), np.int64)
    for x, y in zip(anchors.T, rows.T, strict=True):
        scores += x[i] * y[j]
    return i, cols[j], scores


def kth(low: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th largest value (-inf where there are fewer), as a column."""
    if low.shape[1] < k:
        return np.full((len(low), 1), -np.inf)
    at = low.shape[1] - k
    return np.partition(low, at, axis=1)[:, at : at + 1]


def ranges(positive_scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score of a negative, inclusive: 3 p <= 10 n <= 9 p."""
    return -((-LEAST * positive_scores) // 10), MOST * positive_scores // 10


def positives_of(keys: np.ndarray, anchors: np.ndarray, row_keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each anchor (its place) its k best of the tile: (score, place)."""
    step = max(1, PAIRS // len(ids))
    for top in range(0, len(anchors), step):
        own = slice(top, top + step)
        same = keys[own, None] == row_keys[None, :]
        i, j, scores = bounded(anchors[own], rows, lambda low, high: high >= kth(low, k), same)
        yield from listed(i, j, scores, ids, k, top, len(same))


def listed(i: np.ndarray, j: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, top: int, n: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    cuts = np.searchsorted(i, np.arange(n + 1)).tolist()
    for at, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            order = np.lexsort((ids[j[a:b]], -scores[a:b]))[:k] + a
            yield top + at, list(zip(scores[order].tolist(), j[order].tolist(), strict=True))


def negatives_of(labels: np.ndarray, anchors: np.ndarray, wanted: np.ndarray, row_labels: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """For each anchor and positive (their places) the k best of the tile within the positive's range.
    wanted: anchors x positives, scores of the positives, -1 where there are fewer; a negative score
    has an empty range."""
    step = max(1, PAIRS // len(ids))
    least, most = ranges(wanted)
    least, most = np.where(wanted < 0, 1, least), np.where(wanted < 0, 0, most)
    for top in range(0, len(anchors), step):
        own = slice(top, top + step)
        lo, hi = least[own], most[own]

        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            out = np.zeros(low.shape, bool)
            for p in range(lo.shape[1]):  # noqa: B023
                a, b = lo[:, p : p + 1], hi[:, p : p + 1]  # noqa: B023
                sure = np.where((low >= a) & (high <= b), low, -np.inf)
                out |= (high >= a) & (low <= b) & (high >= kth(sure, k))
            return out

        i, j, scores = bounded(anchors[own], rows, keep, labels[own, None] == row_labels[None, :])
        for p in range(lo.shape[1]):
            fits = (scores >= lo[i, p]) & (scores <= hi[i, p])
            for at, found in listed(i[fits], j[fits], scores[fits], ids, k, top, len(lo)):
                yield at, p, found


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def _whole(table: pa.Table, scale: int) -> np.ndarray:
    return np.floor(_matrix(table, "vector").astype(np.float64) * scale).astype(np.int64)


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * scale + 1, F.lit(2.0)))
    usable = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    usable = usable.filter("id is not null and label is not null and vector is not null").filter(~bad).filter(norm <= LARGEST)
    usable = materialize(usable.withColumn("key", F.monotonically_increasing_id()).withColumn("n", F.size("vector")), "vectors")
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = lambda n, size: F.ceil(n / size).cast("int")

    def dealt(by: list[str], asked: DataFrame) -> tuple[GroupedData, GroupedData]:
        """Anchors and rows by their tile (a, r), within each value of by."""
        sizes = usable.groupBy(*by).agg(blocks(F.count("*"), row_block).alias("rows"), F.greatest(F.lit(1), blocks(F.count_if("asks"), anchor_block)).alias("anchors"), F.count_if("asks").alias("some")).filter("some > 0").drop("some")
        rows = usable.join(sizes, by).withColumn("r", block("rows")).withColumn("a", each("anchors"))
        asked = asked.join(sizes, by).withColumn("a", block("anchors")).withColumn("r", each("rows"))
        rows = rows.select(*by, "a", "r", "key", "id", "vector", F.col("label").alias("own"))
        asked, rows = (df.toDF(*df.columns) for df in (asked, rows))  # columns of their own, as both come from `usable`
        return asked.groupBy(*by, "a", "r"), rows.groupBy(*by, "a", "r")

    def first(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int]] = []
        if len(anchors) and len(rows):
            ids, keys = rows.column("id").to_numpy(), anchors.column("key").to_numpy()
            row_keys = rows.column("key").to_numpy()
            for i, found in positives_of(keys, _whole(anchors, scale), row_keys, ids, _whole(rows, scale), positives):
                out += [(int(keys[i]), int(row_keys[j]), int(ids[j]), s) for s, j in found]
        return pa.table(dict(zip(("anchor", "positive", "positive_id", "score"), (pa.array([r[c] for r in out], pa.int64()) for c in range(4)), strict=True)))

    asked, rows = dealt(["n", "label"], usable.filter("asks").select("n", "label", "key", "id", "vector"))
    tiles = asked.cogroup(rows).applyInArrow(first, "anchor bigint, positive bigint, positive_id bigint, score bigint")
    order = W.partitionBy("anchor").orderBy(F.col("score").desc(), "positive_id", "positive")
    chosen = tiles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives)
    chosen = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive", "positive_id", "score"))).alias("chosen"))  # at most `positives` each
    asked = usable.filter("asks").select("n", "label", "key", "id", "vector").join(chosen.withColumnRenamed("anchor", "key"), "key")
    asked = materialize(asked.select("n", "label", "key", "id", "vector", F.col("chosen.score").alias("scores"), F.col("chosen.positive").alias("places"), F.col("chosen.positive_id").alias("ids")), "anchors")

    def second(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            ids, row_keys = rows.column("id").to_numpy(), rows.column("key").to_numpy()
            scores, places, names = (anchors.column(c).to_pylist() for c in ("scores", "places", "ids"))
            wanted = np.array([(s + [-1] * positives)[:positives] for s in scores], np.int64)
            keys, own = anchors.column("key").to_pylist(), anchors.column("id").to_pylist()
            for i, p, found in negatives_of(anchors.column("label").to_numpy(), _whole(anchors, scale), wanted, rows.column("own").to_numpy(), ids, _whole(rows, scale), negatives):
                out += [(keys[i], own[i], places[i][p], names[i][p], scores[i][p], int(row_keys[j]), int(ids[j]), s) for s, j in found]
        return pa.table(dict(zip(("anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative", "negative_id", "negative_score"), (pa.array([r[c] for r in out], pa.int64()) for c in range(8)), strict=True)))

    asked, rows = dealt(["n"], asked)
    schema = "anchor bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_score bigint, negative bigint, negative_id bigint, negative_score bigint"
    tiles = asked.cogroup(rows).applyInArrow(second, schema)
    order = W.partitionBy("anchor", "positive").orderBy(F.col("negative_score").desc(), "negative_id", "negative")
    return tiles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = f"""
with v as (
  select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [cast(floor({SCALE} * e::double) as bigint) for e in embedding] as x from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0),
s as (
  select a.row as anchor, a.vec_id as anchor_id, c.row as row, c.vec_id as vec_id, a.label = c.label as same,
    cast(list_inner_product(a.x::double[], c.x::double[]) as bigint) as score
  from v a join v c on a.row <> c.row where a.vec_id % 100 = 0),
p as (
  select anchor, anchor_id, row as positive, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor order by score desc, vec_id) <= {POSITIVES})
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor, positive order by score desc, vec_id) as integer) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor = p.anchor and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= {NEGATIVES}
"""
