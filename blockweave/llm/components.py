"""Connected components of a distributed edge table: of few edges at once, else by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.runtime import settle

#: Edges, of 16 bytes, up to which the driver takes them; their nodes are at most twice as many.
FEW = 1 << 19


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the minimum of each node.

    The join has a key of its own, the node's complement: with the node itself Spark would join where the
    minima were taken, and could not split the edges of one node with very many over tasks.
    """
    own = least.select(F.bitwise_not("u").alias("k"), "m")
    return edges.withColumn("k", F.bitwise_not("u")).join(own, "k").drop("k")


def _at_once(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the component of each.

    In every round each root that has a smaller one beside it moves under that, so no component
    that is not whole stays alone, and a logarithmic number of rounds is enough.
    """
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, other = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[one] != root[other]).any():
        one, other = root[one[apart]], root[other[apart]]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while ((further := root[root]) != root).any():
            root = further
    return nodes, nodes[root]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (u long, v long); a component is named by its smallest node.

    Beyond ``FEW`` edges the steps are distributed. Every step keeps the components and moves edges towards smaller nodes; a logarithmic number
    of them leaves one star per component. Minima are taken by aggregates with a map side, and
    each step is settled, so that a lost executor costs one step at most.
    """
    edges = settle(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if edges.count() <= FEW:
        held = edges.toArrow()
        node, component = _at_once(*(held.column(c).to_numpy() for c in ("u", "v")))
        return settle(links.sparkSession.createDataFrame(pa.table({"node": node, "component": component}), "node long, component long"), "components")
    before = None
    while True:
        # large star: the larger neighbours of a node move to the smallest of all its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = settle(small, "edges")
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
