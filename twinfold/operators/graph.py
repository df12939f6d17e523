"""Directed-graph checks over edge tables, as bounded loops of joins.

Every loop halves or peels the remaining work, cuts its lineage with a reliable
checkpoint and stops on a count, so it neither grows a plan nor collects rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.session import cut_lineage


def cyclic_edges(edges: DataFrame, group: str, src: str = "src", dst: str = "dst", distinct: bool = False) -> DataFrame:
    """Edges that survive peeling; a group has a cycle iff any of them stays.

    Each round drops edges out of sources and into sinks, then lets every edge
    into a node with one way out skip that node. A chain of n nodes is gone after
    about log2(n) rounds. When a round drops nothing, every node left has a way
    in and a way out, which needs a cycle. Copies of an edge count once; ``distinct``
    edges without copies, already written, are read as they are.
    """
    rest = edges.select(group, src, dst) if distinct else cut_lineage(edges.select(group, src, dst).distinct())
    left = rest.count()
    while left:
        heads = rest.select(group, F.col(dst).alias(src)).distinct()
        tails = rest.select(group, F.col(src).alias(dst)).distinct()
        kept = rest.join(heads, [group, src], "left_semi").join(tails, [group, dst], "left_semi")
        single = (
            kept.groupBy(group, F.col(src).alias(dst))
            .agg(F.count("*").alias("_n"), F.min(dst).alias("_next"))
            .where("_n = 1")
            .drop("_n")
        )
        jumped = kept.join(single, [group, dst], "left").select(
            group, src, F.coalesce("_next", dst).alias(dst)
        )
        rest = cut_lineage(jumped.distinct())
        now = rest.count()
        if now == left:
            break
        left = now
    return rest


def cycle_groups(edges: DataFrame, group: str, src: str = "src", dst: str = "dst", distinct: bool = False) -> DataFrame:
    return cyclic_edges(edges, group, src, dst, distinct).select(group).distinct()


def branching_groups(edges: DataFrame, group: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Groups in which some node has two outgoing or two incoming edges."""
    ends = edges.select(group, F.explode(F.array(
        F.struct(F.lit("out").alias("end"), F.col(src).alias("node")),
        F.struct(F.lit("in").alias("end"), F.col(dst).alias("node")),
    )).alias("e"))
    counted = ends.groupBy(group, "e.end", "e.node").count()
    return counted.where("count > 1").select(group).distinct()


def chain_positions(nodes: DataFrame, edges: DataFrame, group: str, node: str) -> DataFrame:
    """``(group, node, root, position)`` on simple chains, by pointer doubling.

    ``edges(group, src, dst)`` must have at most one edge into a node. Nodes on a
    cycle have no root and are left out. Takes log2(longest chain) joins.
    """
    up = edges.select(group, F.col("dst").alias(node), F.col("src").alias("ptr"))
    state = cut_lineage(
        nodes.join(up, [group, node], "left").select(
            group,
            node,
            F.coalesce("ptr", node).alias("ptr"),
            F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
            F.col("ptr").isNull().alias("done"),
        )
    )
    open_left = state.where("not done").count()
    while open_left:
        hop = state.select(
            group,
            F.col(node).alias("ptr"),
            F.col("ptr").alias("_ptr"),
            F.col("dist").alias("_dist"),
            F.col("done").alias("_done"),
        )
        state = cut_lineage(
            state.join(hop, [group, "ptr"]).select(
                group,
                node,
                F.when(F.col("done"), F.col("ptr")).otherwise(F.col("_ptr")).alias("ptr"),
                F.when(F.col("done"), F.col("dist")).otherwise(F.col("dist") + F.col("_dist")).alias("dist"),
                (F.col("done") | F.col("_done")).alias("done"),
            )
        )
        now = state.where("not done").count()
        if now == open_left:
            break
        open_left = now
    return state.where("done").select(group, node, F.col("ptr").alias("root"), F.col("dist").alias("position"))


def reach(edges: DataFrame, starts: DataFrame, group: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """All nodes reachable from ``starts(group, node)`` along edges, starts included."""
    step = edges.select(group, F.col(src).alias("node"), F.col(dst).alias("_to")).distinct()
    seen = cut_lineage(starts.select(group, "node").distinct())
    frontier = seen
    while True:
        found = frontier.join(step, [group, "node"]).select(group, F.col("_to").alias("node")).distinct()
        frontier = cut_lineage(found.join(seen, [group, "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut_lineage(seen.unionByName(frontier))


def components(nodes: DataFrame, edges: DataFrame, group: str, node: str) -> DataFrame:
    """Connected components as ``(group, node, component)``: the least node id.

    Alternating large-star and small-star steps: every edge moves to the least
    neighbour, so a chain of n nodes needs about log n rounds, and no step
    gathers the neighbours of a node in one row.
    """
    links = cut_lineage(
        edges.select(group, F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .where("a <> b")
        .distinct()
    )
    previous = None
    while True:
        both = links.unionByName(links.select(group, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(group, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = (
            both.where("b > a").join(least, [group, "a"]).select(group, F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        lower = large.groupBy(group, "a").agg(F.min("b").alias("m"))
        small = (
            large.join(lower, [group, "a"])
            .select(group, F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(group, F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        links = cut_lineage(small)
        mark = links.agg(F.count("*"), F.sum(F.xxhash64(group, "a", "b").cast("decimal(38,0)"))).first()
        if mark == previous:
            break
        previous = mark
    label = links.groupBy(group, F.col("a").alias(node)).agg(F.min("b").alias("component"))
    return nodes.select(group, node).distinct().join(label, [group, node], "left").select(
        group, node, F.coalesce("component", node).alias("component")
    )
