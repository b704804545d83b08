"""Operator 4: nearest neighbours by a block matrix join.

Queries and candidates are dealt, for each length of vector, into blocks by hash of their row's key.
Each pair of a query block and a candidate block of one length is a tile, one group of a co-grouped
join; a tile's size is bounded by the block sizes, whatever the table's size. In a tile:

- vectors are quantised to int8, each with its own scale, and the tile's products come from one
  matrix product of whole numbers (exact in float32 as long as 127 * 127 * dimensions stays below
  2**24, in float64 beyond);
- with |x - s q| known for each vector, a product is off by at most
  |x| err(y) + err(x) |s q|(y); so each pair has a lower and an upper bound;
- a pair whose upper bound is below the k-th best lower bound of its query can't be among its k
  nearest; the others are recomputed in double precision from the original vectors, summed from the
  first dimension to the last, and a heap keeps the k best. A tile is worked through in slices of
  PAIRS pairs, so that its memory doesn't grow where many pairs survive, as equal vectors do.

Tiles' lists are merged by a ranking that keeps k rows per query on either side of its shuffle. All
candidates are compared, so the result is exact: recall is 1.

Defined results: vectors that are null, empty, zero, or hold a null, a NaN or an infinity take no
part, neither do rows without an id. A query's candidates are the vectors of its own length in every
row but its own; its key, written once, tells rows apart. Rows that repeat an id are queries and
candidates each for itself: a ranking for each, and an id that comes again in one. Ties go to the
smaller vec_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

K, QUERY_BLOCK, CANDIDATE_BLOCK = 20, 1024, 8192
#: Pairs of a tile that are looked at in one step (one query's at least).
PAIRS = 1 << 19


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, the norms of what they lose, and the norms of what they keep."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None])
    kept = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(x - kept, axis=1), np.linalg.norm(kept, axis=1)


def product(a: np.ndarray, rows: np.ndarray, b: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Of pairs of columns of a and b (dimensions x vectors), from the first dimension to the last."""
    out = np.zeros(len(rows))
    for x, y in zip(a, b, strict=True):
        out += x[rows] * y[cols]
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The k largest scores with their ids, best first; ties to the smaller id."""
    if len(scores) > 4 * k:  # only what can be among them goes to the heap
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, tied = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        more = k - len(above)
        if len(tied) > more:
            tied = tied[np.argpartition(ids[tied], more - 1)[:more]]
        keep = np.concatenate([above, tied])
        scores, ids = scores[keep], ids[keep]
    return [(-s, j) for s, j in heapq.nsmallest(k, zip((-scores).tolist(), ids.tolist(), strict=True))]


def tile(query_keys: np.ndarray, queries: np.ndarray, keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query (its place) its k nearest in the tile: (score, id), best first."""
    exact = np.float32 if queries.shape[1] <= 1000 else np.float64
    qa, sa, ea, na = quantise(queries)
    qb, sb, eb, nb = quantise(vectors)
    wide, by_query, by_vector = qb.astype(exact).T, np.ascontiguousarray(queries.T), np.ascontiguousarray(vectors.T)
    step = max(1, PAIRS // len(ids))
    for top in range(0, len(queries), step):
        own = slice(top, top + step)
        about = (qa[own].astype(exact) @ wide).astype(np.float64) * sa[own, None] * sb[None, :]
        # x.y - kx.ky = x.(y - ky) + (x - kx).ky; and a little for rounding
        most = (na[own] + ea[own])[:, None] * eb[None, :] + ea[own, None] * nb[None, :]
        most += 1e-9 * (na[own] + ea[own])[:, None] * (nb + eb)[None, :]
        same = query_keys[own, None] == keys[None, :]
        low = np.where(same, -np.inf, about - most)
        place = max(0, low.shape[1] - k)
        threshold = np.partition(low, place, axis=1)[:, place] if low.shape[1] > k else np.full(len(low), -np.inf)
        rows, cols = np.nonzero(~same & (about + most >= threshold[:, None]))
        scores = product(by_query, rows + top, by_vector, cols)
        cuts = np.searchsorted(rows, np.arange(len(low) + 1)).tolist()
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                yield top + i, best(scores[a:b], ids[cols[a:b]], k)


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, ids = (table.column(c).to_numpy() for c in ("key", "id"))
    flat = table.column("vector").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return keys, ids, flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest by inner product."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    usable = usable.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(~bad & F.exists("vector", lambda x: x != 0))
    usable = materialize(usable.withColumn("key", F.monotonically_increasing_id()), "vectors")
    schema = "query_key bigint, query_id bigint, vec_id bigint, score double"
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    sizes = usable.groupBy(F.size("vector").alias("n")).agg(blocks(F.count("*"), candidate_block).alias("n_candidate"), blocks(F.count_if("asks"), query_block).alias("n_query")).filter("n_query > 0")
    own = usable.withColumn("n", F.size("vector")).join(F.broadcast(sizes), "n")
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = own.filter("asks").select("n", "key", "id", "vector", block("n_query").alias("q"), each("n_candidate").alias("c"))
    held = own.select("n", "key", "id", "vector", each("n_query").alias("q"), block("n_candidate").alias("c"))

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        places: list[int] = []
        found: list[tuple[float, int]] = []
        keys = ids = np.zeros(0, np.int64)
        if len(queries) and len(candidates):
            keys, ids, vectors = _arrays(queries)
            for i, own in tile(keys, vectors, *_arrays(candidates), k):
                places += [i] * len(own)
                found += own
        at = np.array(places, np.int64)
        return pa.table({"query_key": pa.array(keys[at]), "query_id": pa.array(ids[at]), "vec_id": pa.array([j for _, j in found], pa.int64()), "score": pa.array([s for s, _ in found], pa.float64())})

    asked, held = (df.toDF(*df.columns) for df in (asked, held))  # columns of their own, as both come from `own`
    tiles = asked.groupBy("n", "q", "c").cogroup(held.groupBy("n", "q", "c")).applyInArrow(run, schema)
    order = W.partitionBy("query_key").orderBy(F.col("score").desc(), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
with v as (
  select row_number() over () as row, vec_id, embedding::double[] as x from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0),
s as (
  select q.row, q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.x, c.x) as score
  from v q join v c on q.row <> c.row where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by row order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= {K}
"""
