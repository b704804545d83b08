"""Connected components of a graph that no one machine holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges that one union-find works on at a time.
BLOCK_EDGES = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over blocks of a partition's edges: a star from each tree's smallest node."""
    held: list[np.ndarray] = []

    def stars() -> pa.RecordBatch:
        edges = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
        held.clear()
        nodes, index = np.unique(edges, return_inverse=True)
        parent = list(range(len(nodes)))
        for a, b in index.reshape(-1, 2).tolist():
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a < b:  # nodes are in order, so the smaller number is the smaller node
                parent[b] = a
            elif b < a:
                parent[a] = b
        for i in range(len(parent)):
            parent[i] = parent[parent[i]]
        root = np.asarray(parent, np.int64)
        own = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["node", "root"])

    n = 0
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1))
        n += batch.num_rows
        if n >= BLOCK_EDGES:
            yield stars()
            n = 0
    if n:
        yield stars()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root for each node of edges (two bigint columns) that isn't its component's smallest.

    Each round contracts every partition's edges by union-find to stars, then hangs each node's
    roots on the smallest of them (a group-by that combines before it shuffles; the join spreads
    a hot node's rows). It ends when every node has one root and no root is a node with another:
    the path from any node then is one step long. Rounds grow with the logarithm of the longest
    path; nothing but two counts reaches the driver."""
    stars = materialize(edges.toDF("node", "root").mapInArrow(_forest, "node bigint, root bigint"), name)
    while True:
        least = materialize(stars.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("most")), name)
        # A node with several roots links these; a root that itself has a root is passed on.
        above = least.select(F.col("node").alias("root"), F.col("root").alias("top"))
        split = least.filter("root < most").limit(1).count()
        chained = least.join(above, "root", "left_semi").limit(1).count()
        if not split and not chained:
            return least.select("node", "root")
        moved = least.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        linked = stars.join(least.select("node", F.col("root").alias("low")), "node").filter("root > low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        stars = materialize(moved.unionByName(linked).mapInArrow(_forest, "node bigint, root bigint"), name)

