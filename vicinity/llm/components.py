"""Connected components of a distributed edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, node_type: str = "long") -> DataFrame:
    """(node, component) for each node of ``edges`` (src, dst); component is the least node reachable.

    Each round points every node at its least neighbour, follows the pointers once more, and
    replaces the ends of all edges; edges inside one node go. Each node that isn't the least of its
    neighbourhood disappears, so the rounds are logarithmic in practice. Rounds write tables in the
    shared folder; nothing is collected. Edges with a null end are left out, and so are nodes whose only edge is a loop. Joins are between written tables on both sides, so
    adaptive execution can split a hub.
    """
    edges = materialize(
        edges.where("src <> dst").select(F.col("src").cast(node_type), F.col("dst").cast(node_type)).distinct(), "edges"
    )
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = materialize(
            both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("to")),
            "least",
        )
        second = least.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jump = materialize(least.join(second, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "jump")
        discard(least)
        left = jump.select(F.col("node").alias("src"), F.col("to").alias("s"))
        right = jump.select(F.col("node").alias("dst"), F.col("to").alias("d"))
        shrunk = materialize(
            edges.join(left, "src").join(right, "dst").where("s <> d")
            .select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).distinct(),
            "edges",
        )
        discard(edges)
        edges = shrunk
        maps.append(jump)
    if not maps:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    out = maps[0].select("node", F.col("to").alias("component"))
    for m in maps[1:]:
        step = m.select(F.col("node").alias("component"), F.col("to").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return materialize(out, "components")
