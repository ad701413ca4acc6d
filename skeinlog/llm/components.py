"""Connected components of an edge table, by the smallest id reachable.

Each partition first reduces its edges to a spanning forest. Then two kinds of steps alternate until nothing changes:
every larger neighbour of a node is tied to the node's smallest neighbour, and every smaller one likewise. Each step is
an aggregation and an equi join, so a hub with many edges is no unit of work; the edges of a round are written to the
shared folder, and rounds grow with the logarithm of the longest path.

Defined cases: self-links, repeated edges and edges with a null end are dropped. Nodes without an edge don't appear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.shared import written


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph of these edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    low = np.arange(len(nodes))
    while len(a):
        la, lb = low[a], low[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(low, np.maximum(la, lb), np.minimum(la, lb))
        while (low[low] != low).any():
            low = low[low]
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def _local(batches):
    u, v, held = [], [], 0
    for batch in batches:
        a, b = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        u, v, held = [*u, a], [*v, b], held + len(a)
        if held > 1 << 20:
            x, y = forest(np.concatenate(u), np.concatenate(v))
            u, v, held = [x], [y], len(x)
            if held > 1 << 19:  # a forest this large is passed on, the rest starts anew
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])
                u, v, held = [], [], 0
    if u:
        x, y = forest(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (u, v), two bigint columns, that has an edge to another."""
    clean = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).filter("u <> v")
    now = written(clean.mapInArrow(_local, "u bigint, v bigint"), "components")
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "components-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = written(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "components")
