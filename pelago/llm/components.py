"""Connected components as DataFrame operations: alternating large-star and small-star steps.

Each step moves edges towards the smallest id of their neighbourhood and keeps their number within that of the nodes
plus the edges, so a hub's edges are never gathered in one task: the minimum of a neighbourhood is a map-side combined
aggregate, and it goes back to the edges by a plain equi-join that AQE can split.  A round is one query and one table;
the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges as (u, v) with u > v."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def _least(edges: DataFrame, node: str) -> DataFrame:
    """The smallest neighbour of every node that has a smaller one."""
    return edges.groupBy(F.col("u").alias(node)).agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node with a link to another one; the component is its smallest node id.

    Null ends and self-links make no link; repeated links count once; no links give an empty result.
    """
    now = stored(_oriented(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")), "cc-edges")
    state = _state(now)
    while state[0]:
        # large star: larger neighbours of a node go to the smallest one, which is the node itself if it has no smaller one
        large = now.join(_least(now, "w"), F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = _least(large, "w")
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(_oriented(small.union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))), "cc-edges")
        before, state = state, _state(after)
        drop(now)
        now = after
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def named_components(nodes: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component_id)`` for every row of ``nodes`` (node, id): the smallest id that links reach, its own included.

    Nodes have numbers of their own, since ids may repeat or be null; nulls are smallest only where there is no other id.
    """
    found = connected_components(edges, a, b)
    linked = found.join(nodes.select("node", "id"), "node")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    named = found.join(least, "component").select(F.col("node").alias("member"), "least")
    return nodes.join(named, nodes["node"] == named["member"], "left").select("node", F.when(F.col("member").isNotNull(), F.col("least")).otherwise(F.col("id")).alias("component_id"))
