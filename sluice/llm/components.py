"""Connected components by alternating large-star and small-star steps, and roots of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Staging


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node with an edge.

    Self-loops, repeated edges and both directions may occur; rows with a null end are no
    edges. Every step is a partial minimum per node and a join on the node against a
    written table, so a node with very many edges is split by AQE. The rounds end when every
    component is a star around its smallest node, which the first aggregate of a round tells:
    the driver sees one row per round. The number of rounds grows with the logarithm of the
    longest path. Only the last round's table stays on disk.
    """
    stage = Staging(edges.sparkSession, "components")
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    ends = ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = stage.keep(ends.distinct(), "edges")
    while True:
        # Large star: every larger neighbour of a node is hung below its smallest neighbour.
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m"), F.lit(1).alias("up")).union(
            now.select(F.col("v").alias("n"), F.col("u").alias("m"), F.lit(0).alias("up"))
        )
        low = both.groupBy("n").agg(F.min("m").alias("low"), F.sum("up").alias("ups"), F.count("*").alias("c"))
        # In a star a node has only larger neighbours, or a single one that is smaller.
        starred = (F.col("ups") == 0) | (F.col("c") == 1)
        low = low.select(F.col("n").alias("k"), F.least("n", "low").alias("low"), starred.alias("starred"))
        low = stage.keep(low, "low")
        if low.agg(F.coalesce(F.bool_and("starred"), F.lit(True)).alias("all")).first().all:
            stage.drop(low)
            break
        up = both.where(F.col("m") > F.col("n")).join(low, F.col("n") == F.col("k"))
        large = stage.keep(up.select(F.col("m").alias("u"), F.col("low").alias("v")).distinct(), "large")
        stage.drop(now, low)
        # Small star: a node and its smaller neighbours are hung below the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        low = stage.keep(low.withColumnRenamed("u", "k"), "low")
        hung = large.join(low, F.col("u") == F.col("k")).where(F.col("v") != F.col("low"))
        now = stage.keep(
            hung.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .union(low.select(F.col("k").alias("u"), F.col("low").alias("v")))
            .distinct(),
            "small",
        )
        stage.drop(large, low)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def tree_roots(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the root above it) of every ``a`` that hangs below its only ``b``.

    There are no cycles, as every ``b`` is smaller than its ``a``; so a root is the smallest node
    of its component. A round hangs every node below what its upper node hangs below: one table,
    where ``connected_components`` needs four, and half the depth.
    """
    stage = Staging(links.sparkSession, "roots")
    now = stage.keep(links.select(F.col("a").alias("node"), F.col("b").alias("up")), "links")
    while True:
        above = now.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        hung = now.select("node", "up").join(above, F.col("up") == F.col("_node"), "left")
        hung = hung.select("node", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("moved"))
        before, now = now, stage.keep(hung, "hung")
        stage.drop(before)
        if now.agg(F.count_if("moved").alias("n")).first().n == 0:
            return now.select("node", F.col("up").alias("component"))
