"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import cut, release, store


def _nearest(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge (u, v) with the smallest neighbour m of u. Both sides are read from stored tables, so that a hot u can be split."""
    return edges.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).drop("k")


def _are_stars(near: DataFrame) -> bool:
    """Whether the edges are stars around smallest nodes: each node with a smaller neighbour has one, which itself has none.

    (u, m, n): the least of a node and its neighbours, and their number. Where m = u there is no smaller neighbour."""
    centre = F.col("m") == F.col("u")
    ends, of_centres, others = near.agg(F.sum("n"), F.sum(F.when(centre, F.col("n"))), F.count(F.when(~centre, 1))).first()
    return not ends or ends == 2 * of_centres == 2 * others


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, component): component is the smallest node that can be reached. Nodes without edges are not listed.

    Each step turns edges into stars around smaller nodes; the number of edges doesn't grow, and the steps end when
    the edges are stars, after about the logarithm of the longest path. The driver keeps the plans of past queries, so a step has few.
    """
    state = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        if _are_stars(near):
            release(near)
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        large = store(_nearest(both, near).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = store(large.groupBy("u").agg(F.min("v").alias("m")))
        small = _nearest(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, state = state, store(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        release(before, near, large, least)  # only the latest state is kept


def keep_one(keyed: DataFrame, components: DataFrame) -> DataFrame:
    """(row, id, node) to the rows, unpacked, that stay: one of each group, the smallest id's, nulls last.

    ``node`` is a row's class and never null; classes without a component are groups of their own. Choosing needs ids and
    classes only; whole rows meet the chosen ones in one join."""
    found = components.select(F.col("node").alias("of"), "component")
    rows = cut(keyed.select("id", "node").join(found, F.col("node") == F.col("of"), "left"))
    best = rows.groupBy(F.coalesce("component", "node").alias("class")).agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best")
    )
    best = cut(best.select(F.col("best.id").alias("best_id"), F.col("best.node").alias("best_node")))
    kept = keyed.join(best, (F.col("node") == F.col("best_node")) & F.col("id").eqNullSafe(F.col("best_id")), "left_semi")
    order = Window.partitionBy("node").orderBy(F.lit(1))
    return kept.withColumn("place", F.row_number().over(order)).where("place = 1").select("row.*")
