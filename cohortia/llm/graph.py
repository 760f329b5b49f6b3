"""Connected components by star contraction, within groups of edges and then over all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.session import stored

GROUP_EDGES = 1_000_000  # edges that one task contracts at once


def _contracted(table: pa.Table) -> pa.Table:
    """The components of a group's edges as stars: every node below the least of its component."""
    nodes, ends = np.unique(np.stack([table.column("u").to_numpy(), table.column("v").to_numpy()]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        label = label[label]
        if (label == before).all():
            break
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"u": nodes[hung], "v": nodes[label[hung]]})


def _locally(edges: DataFrame) -> DataFrame:
    groups = max(1, -(-edges.count() // GROUP_EDGES))
    return stored(edges.withColumn("grp", F.pmod(F.xxhash64("v"), F.lit(groups))).groupBy("grp").applyInArrow(
        _contracted, "u long, v long"), "contracted")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    return ends.groupBy("node").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).filter(
        "low > 1 OR low = 1 AND high > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) between longs; the root is the least node.

    Groups of bounded size are contracted on their own. As long as nodes hang below several
    others or in chains, a round over all edges hangs the neighbours of each node below the least of
    them, the larger ones first, then the smaller ones. Rounds aggregate minima only, so a
    node of any degree is spread over tasks, and are written, which cuts the lineage.
    """
    current = _locally(stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"))
    while not _is_forest_of_stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = _locally(stored(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
