"""Connected components of an edge table, by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from quillspark.operators.tables import hot_keys, spread_join


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round every node takes its smallest neighbour (or itself) as parent, parents of parents are
    followed once, and edges are contracted to parents; at least half of the nodes that still have an
    edge vanish in a round. `keep` writes a table and reads it back, which cuts lineage. The edges of a
    node with very many are dealt over several tasks. Null ends and loops are ignored. Nothing is
    collected but counts.
    """
    edges = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    edges = keep(edges, "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        parent = keep(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("x"), F.least("u", "v").alias("p")), "parents")
        # parents of parents; every parent has an edge and so is in the table
        up = parent.select(F.col("x").alias("p"), F.col("p").alias("q"))
        jump = keep(spread_join(parent, up, ["p"], hot_keys(parent, "p"), ["x"]).select("x", F.col("q").alias("p")), "jumps")
        to_u = jump.select(F.col("x").alias("u"), F.col("p").alias("pu"))
        to_v = jump.select(F.col("x").alias("v"), F.col("p").alias("pv"))
        moved = spread_join(edges, to_u, ["u"], hot_keys(edges, "u"), ["v"])
        moved = spread_join(moved, to_v, ["v"], hot_keys(edges, "v"), ["u"])
        edges = keep(moved.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        if labels is None:
            labels = jump.select(F.col("x").alias("node"), F.col("p").alias("component"))
        else:
            step = jump.select(F.col("x").alias("component"), F.col("p").alias("next"))
            labels = keep(spread_join(labels, step, ["component"], hot_keys(labels, "component"), ["node"], "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
