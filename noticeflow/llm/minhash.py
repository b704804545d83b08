"""Operator 2: near-duplicates by SuperMinHash, banding, verification and union-find.

SuperMinHash (Ertl, 2017): each element of a set draws one random permutation of the signature's
positions. At its j-th rank it offers j + r, with r uniform in [0, 1), to the position that has this
rank; a position keeps the least offer. Offers of one element to different positions are correlated,
which lowers the variance of the similarity estimate, and ranks are worked through one after the
other for all elements of a document at once: when every position has an offer, all later ranks would
offer more, and the document stops early.

Bands of the signature's rows make buckets. Documents with the same set are one node (its smallest
doc_id), so copies make no links. Within a bucket, links are tried from a centre to all members; the
centre is the node whose buckets hold most nodes, which for a group of near copies is the one that
they were made from. The links that hold on full sets (100 * intersection >= 80 * union) are grouped
by union-find. Where a bucket's nodes are in more than one group, centres from outside the largest
are tried, and at last all its outsiders against all its nodes: in tiles of bounded size, which
compare full sets and give only links that hold, each pair in the first bucket that it shares and
none within one group. So no pair that shares a bucket stays undecided, and a large group of near
copies costs a few passes over it, plus tiles for the few that aren't linked to its centre. With 32
bands of 5 rows a pair at a similarity of exactly 0.8 shares no bucket with a chance of 3e-6.

Defined results: a text without words (or null) has n_shingles 0 and is linked with nothing. A text
with fewer words than a shingle has one shingle, the whole sequence. A row without doc_id can't be
named by a link: component_id is null and kept is true. Rows that share a doc_id are one document.
Ties don't arise: a group is named by its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, columns, give_back, gram_hashes, materialize, mix, spare, split_words
from .components import components

BANDS, ROWS = 32, 5
#: Passes from one centre for each bucket before what is left is tried in tiles.
CENTRES = 3
#: Shingles of the outsiders and of the nodes in a tile, about.
TILE = (1 << 17, 1 << 19)
_GOLD = 0x9E3779B97F4A7C15
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, text after text, and where each text's end."""
    w = split_words(texts)
    h = w.hashes(lower=True)
    n = np.diff(w.first)
    m = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    to = np.cumsum(m)
    starts = np.repeat(w.first[:-1] - (to - m), m) + np.arange(to[-1] if len(to) else 0)
    grams = gram_hashes(h, starts, starts + np.repeat(np.minimum(n, k), m))
    sets = [np.unique(grams[a:b]) for a, b in zip(to - m, to, strict=True)]
    return np.concatenate(sets) if sets else grams, np.cumsum([len(x) for x in sets], dtype=np.int64)


def superminhash(elements: np.ndarray, ends: np.ndarray, m: int) -> np.ndarray:
    """Signatures (documents x m) of sets of 64-bit element hashes; an offer j + r is held as j in
    the upper and r in the lower 32 bits. Rows of empty sets hold no offer at all."""
    n = len(ends)
    counts = np.diff(ends, prepend=0)
    sig = np.full((n, m), _EMPTY, np.uint64)
    flat = sig.reshape(-1)
    doc = np.repeat(np.arange(n), counts)
    x = elements
    order = first = None
    for j in range(m):
        u = mix(x + np.uint64((j + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF))
        pick = (j + ((u >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32))).astype(np.int64)
        if j == 0:
            at = first = pick
        else:  # a step of the shuffle that makes each element's permutation
            rows = np.arange(len(x))
            at = order[rows, pick]
            order[rows, pick] = order[:, j]
        np.minimum.at(flat, doc * m + at, np.uint64(j) << np.uint64(32) | u & np.uint64(0xFFFFFFFF))
        open_ = (sig == _EMPTY).any(axis=1) & (counts > 0)
        if not open_.any():
            break
        on = open_[doc]
        if j == 0:
            order = np.broadcast_to(np.arange(m, dtype=np.int16), (int(on.sum()), m)).copy()
            order[np.arange(len(order)), first[on]] = 0
        else:
            order = order[on]
        x, doc = x[on], doc[on]
    return sig


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(sig), bands), np.uint64)
    parts = sig.reshape(len(sig), bands, rows)
    for i in range(rows):
        h = mix(h * np.uint64(0xD1342543DE82EF95) + parts[:, :, i])
    return mix(h + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLD))


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits that name the set), bands (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=1 << 19):
                elements, ends = shingle_sets(part.column("text"), k)
                n = np.diff(ends, prepend=0)
                bands_of = band_hashes(superminhash(elements, ends, bands * rows), bands, rows)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(seed)), dtype=np.uint64)]) for seed in (0x5DEECE66D, 0x2545F4914F6CDD1D)]
                a, b = (mix(s[ends] - s[ends - n] + n.astype(np.uint64)).view(np.int64) for s in sums)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(bands_of.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(a), pa.array(b), lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])
        give_back()

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                elements, ends = shingle_sets(part.column("text"), k)
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(elements.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists.cast(pa.list_(pa.int64()))], ["doc_id", "shingles"])
        give_back()

    return docs.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; n is the size of b's. Sizes that rule a
    pair out do so before its second set is fetched."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    half = pairs.join(left, "a").filter(F.least(F.size("sa"), "n") * 100 >= F.greatest(F.size("sa"), "n") * percent)
    both = F.size(F.array_intersect("sa", "sb"))
    return half.join(right, "b").filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept."""
    source = columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    signed = materialize(signatures(source, k, bands, rows), "signatures")
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    # One node for each set; copies are combined before they are shuffled.
    sets = named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"))
    nodes = materialize(sets, "nodes")
    of_nodes = named.join(nodes.select(F.col("node").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    rows_ = of_nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    large = rows_.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = materialize(rows_.join(large, "bucket").select("bucket", "node", "n", "size"), "buckets")
    of_node = buckets.groupBy("node").agg(F.sum("size").alias("mass"), F.array_sort(F.collect_list("bucket")).alias("buckets"))
    of_node = materialize(of_node, "masses")
    buckets = materialize(buckets.join(of_node.select("node", "mass"), "node").select("bucket", "node", "n", "mass"), "buckets")

    asked = of_node.select(F.col("node").alias("doc_id"))
    shingles = materialize(full_sets(source.filter("doc_id is not null").join(asked, "doc_id", "left_semi"), k), "sets")

    def held(rows: DataFrame) -> DataFrame:
        pairs = rows.filter(F.col("node") != F.col("centre")).select(F.col("centre").alias("a"), F.col("node").alias("b"), "n").distinct()
        return materialize(verified(pairs, shingles, percent), "links")

    centre = buckets.groupBy("bucket").agg(F.max_by("node", "mass").alias("centre"))
    links = materialize(held(buckets.join(centre, "bucket")).unionByName(_same_ids(named, nodes)), "links")
    groups = components(links)
    left = _undecided(buckets, groups)
    for _ in range(1, CENTRES):
        if left.isEmpty():
            break
        centre = left.filter("root != main").groupBy("bucket").agg(F.max_by("node", "mass").alias("centre"), F.max_by("root", "mass").alias("its"))
        links = materialize(links.unionByName(held(left.join(centre, "bucket").filter("root != its"))), "links")
        groups = components(links)
        left = _undecided(buckets, groups)
    if not left.isEmpty():
        rest = materialize(tiles(left, shingles, of_node.select("node", "buckets"), percent), "links")
        groups = components(materialize(links.unionByName(rest), "links"))

    labels = nodes.join(groups, "node", "left").select("set_a", "set_b", F.coalesce("root", "node").alias("root"))
    out = signed.join(labels.withColumnRenamed("set_a", "a").withColumnRenamed("set_b", "b"), (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _same_ids(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of the texts of one doc_id, where it comes with several."""
    again = named.groupBy("doc_id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).filter("x < y").select("doc_id")
    own = named.join(again, "doc_id", "left_semi").select("doc_id", "set_a", "set_b").distinct().join(nodes, ["set_a", "set_b"]).select("doc_id", "node").distinct()
    low = own.groupBy("doc_id").agg(F.min("node").alias("low"))
    return own.join(low, "doc_id").filter("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))


def _undecided(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of buckets whose nodes are in more than one group: bucket, node, n, mass, root, main (the
    group with most shingles there), and the shingles of the bucket's nodes and of its outsiders."""
    rooted = buckets.join(groups, "node", "left").select("bucket", "node", "n", "mass", F.coalesce("root", "node").alias("root"))
    sums = rooted.groupBy("bucket", "root").agg(F.sum("n").alias("part"))
    mixed = sums.groupBy("bucket").agg(F.max_by("root", "part").alias("main"), F.sum("part").alias("whole"), (F.sum("part") - F.max("part")).alias("outside")).filter("outside > 0")
    return materialize(rooted.join(mixed, "bucket"), "undecided")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and where each row's end."""
    own = column.combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    return own.flatten().to_numpy(zero_copy_only=False), np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)


def _count_in(values: np.ndarray, ends: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many of each row's values are in own (sorted, not empty)."""
    found = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
    sums = np.concatenate([[0], np.cumsum(found)])
    return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]


def tiles(left: DataFrame, sets: DataFrame, of_node: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the outsiders of each bucket with all its nodes."""
    full = left.join(sets.withColumnRenamed("doc_id", "node"), "node").join(of_node, "node")
    full = full.withColumn("across", F.ceil(F.col("outside") / TILE[0]).cast("int")).withColumn("down", F.ceil(F.col("whole") / TILE[1]).cast("int"))
    block = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["bucket", "node", "n", "root", "main", "shingles", "buckets"]
    out = full.filter("root != main").select(*names, block(1, "across").alias("x"), steps("down").alias("y"))
    all_ = full.select(*names, steps("across").alias("x"), block(2, "down").alias("y"))

    def run(outsiders: pa.Table, members: pa.Table) -> pa.Table:
        a: list[int] = []
        b: list[np.ndarray] = []
        if len(outsiders) and len(members):
            node, root, main = (members.column(c).to_numpy() for c in ("node", "root", "main"))
            values, ends = _flat(members.column("shingles"))
            seen, seen_ends = _flat(members.column("buckets"))
            size = np.diff(ends, prepend=0)
            here = members.column("bucket")[0].as_py()
            values_of, ends_of = _flat(outsiders.column("shingles"))
            seen_of, seen_ends_of = _flat(outsiders.column("buckets"))
            for i, (me, mine) in enumerate(zip(outsiders.column("node").to_pylist(), outsiders.column("root").to_pylist(), strict=True)):
                own = np.sort(values_of[ends_of[i - 1] if i else 0 : ends_of[i]])
                before = seen_of[seen_ends_of[i - 1] if i else 0 : seen_ends_of[i]]
                before = np.sort(before[before < here])
                ask = (root != mine) & ((root == main) | (node > me))  # two outsiders meet once
                ask &= np.minimum(size, len(own)) * 100 >= np.maximum(size, len(own)) * percent
                if len(before):
                    ask &= _count_in(seen, seen_ends, before) == 0
                rows = np.flatnonzero(ask)
                if len(rows):
                    at = np.repeat(ends[rows] - np.cumsum(size[rows]), size[rows]) + np.arange(size[rows].sum())
                    both = _count_in(values[at], np.cumsum(size[rows]), own)
                    good = rows[both * 100 >= (size[rows] + len(own) - both) * percent]
                    a += [me] * len(good)
                    b.append(node[good])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(np.concatenate(b) if b else [], pa.int64())})

    keys = ("bucket", "x", "y")
    out, all_ = (df.toDF(*df.columns) for df in (out, all_))  # columns of their own, as both come from `full`
    return out.groupBy(*keys).cogroup(all_.groupBy(*keys)).applyInArrow(run, "a bigint, b bigint")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns: of each group the rows of one
    doc_id, and all rows without doc_id or words."""
    gone = spare(docs, "_gone")
    kept = near_duplicates(docs, **options).filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(kept, docs[options.get("id_col", "doc_id")] == F.col(gone), "left_anti")
