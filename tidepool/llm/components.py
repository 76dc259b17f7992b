"""Connected components of an edge table by repeated contraction to smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node of ``edges``; component is one of its nodes.

    Each round maps every node to the smallest node among itself and its
    neighbours and replaces both ends of every edge by where they went, until
    no edge is left; the maps are then joined one after another.  Nodes are
    ordered by a 64-bit mix, so that rounds shrink the graph by a constant
    factor whatever the input's order.  Only (node, node) pairs are shuffled;
    the minimum is pre-aggregated by each task, and the joins read written
    tables on both sides, so a node with very many edges is split at run time.
    Edges with a null end are ignored; loops make their node a component.
    """
    mixed = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).na.drop()
    node_names = staged(mixed.select(F.explode(F.array("u", "v")).alias("node")).distinct()
                        .select("node", F.xxhash64("node").alias("key")), "cc-nodes")
    rest = staged(mixed.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v")).distinct(), "cc-edges")
    maps: list[DataFrame] = []
    while not rest.isEmpty():
        both = rest.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        to = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "cc-map")
        maps.append(to)
        left = rest.join(to.select("u", F.col("to").alias("nu")), "u").select("nu", "v")
        ends = left.join(to.select(F.col("u").alias("v"), F.col("to").alias("nv")), "v")
        rest = staged(ends.where("nu <> nv").select(F.col("nu").alias("u"), F.col("nv").alias("v")).distinct(), "cc-edges")
    found = node_names.select("node", F.col("key").alias("at"))
    for to in maps:
        found = (staged(found, "cc-found").join(to.select(F.col("u").alias("at"), "to"), "at", "left")
                 .select("node", F.coalesce("to", "at").alias("at")))
    names = node_names.select(F.col("key").alias("at"), F.col("node").alias("component"))
    return staged(found, "cc-found").join(names, "at").select("node", "component")
