"""Connected components of a graph held as rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

#: Edges that one task joins; beyond it, stars are shuffled.
SMALL = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). node and component (its smallest node) of every node of an edge between different nodes.

    Each round of shuffled stars is some eight stages, whose tasks the driver
    keeps account of. Up to SMALL edges, which are 4 MB, need none of them.
    """
    edges = edges.where("a <> b").select("a", "b")
    if edges.count() > SMALL:
        return _stars(edges)
    return materialise(map_arrow(edges.coalesce(1), _join_all, "node long, component long"))


def least_reachable(a: np.ndarray, b: np.ndarray):
    """The nodes of edges a, b, sorted, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])  # the larger root goes below the smaller
        while not np.array_equal(up := root[root], root):
            root = up


def _join_all(batches):
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(*map(np.concatenate, zip(*held, strict=True)))], ["node", "component"])


def _stars(edges: DataFrame) -> DataFrame:
    """components() of any number of edges.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each
    sends every node's larger neighbours, then its smaller ones, to the least of
    them. Sums per node are combined before the shuffle; joins with a node of
    many edges are left to adaptive skew handling. Ends when nothing changes.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        s = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if s == state:
            break
        state = s
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
