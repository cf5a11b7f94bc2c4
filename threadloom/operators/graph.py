"""Density clustering of a graph of similar pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.components import connected_components
from threadloom.plans.numbering import numbered
from threadloom.plans.scratch import cut

NOISE = -1


def neighbors(pairs: DataFrame, a: str = "i1", b: str = "i2") -> DataFrame:
    """``src``, ``dst`` in both directions."""
    one = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(nodes: DataFrame, edges: DataFrame, id_col: str = "i", weight_col: str | None = None) -> DataFrame:
    """``i``, ``degree``: neighbours of each node and itself. ``edges`` has both directions.

    With ``weight_col`` a node stands for that many points, all next to each other and to the same others.
    """
    weight = F.lit(1).cast("long") if weight_col is None else F.col(weight_col).cast("long")
    ids = nodes.select(F.col(id_col).alias("i"), weight.alias("w"))
    if weight_col is None:
        around = edges.groupBy("src").agg(F.count("*").alias("n"))
    else:
        around = edges.join(ids.select(F.col("i").alias("dst"), "w"), "dst").groupBy("src").agg(F.sum("w").alias("n"))
    return ids.join(around, ids.i == around.src, "left").select("i", (F.coalesce("n", F.lit(0)) + F.col("w")).cast("long").alias("degree"))


def core_points(nodes: DataFrame, edges: DataFrame, min_pts: int, id_col: str = "i", weight_col: str | None = None) -> DataFrame:
    """``i`` of the nodes with at least ``min_pts`` neighbours, themselves included."""
    return degrees(nodes, edges, id_col, weight_col).where(F.col("degree") >= min_pts).select("i")


def dbscan(nodes: DataFrame, pairs: DataFrame, min_pts: int, id_col: str = "i", a: str = "i1", b: str = "i2", weight_col: str | None = None, core: DataFrame | None = None) -> DataFrame:
    """``i``, ``label``: clusters from 1 in order of their smallest core node, -1 for noise.

    Core nodes that neighbour each other share a cluster; another node joins the first cluster, by number, that has a
    core node next to it. The result follows from the graph alone, in whatever order nodes are visited. ``weight_col``
    as in ``degrees``: copies of a string are one node, and its label holds for all of them. Where ``core`` (``i``, written) is known, ``pairs``
    may leave out those between core nodes that others connect.
    """
    edges = cut(neighbors(pairs, a, b), "edges")
    core = cut(core_points(nodes, edges, min_pts, id_col, weight_col), "core") if core is None else core
    inner = edges.join(core.select(F.col("i").alias("src")), "src", "left_semi").join(core.select(F.col("i").alias("dst")), "dst", "left_semi")
    roots = connected_components(inner.where("src < dst"), "src", "dst")
    of_core = cut(core.join(roots, core.i == roots.node, "left").select("i", F.coalesce("component", "i").alias("root")), "roots")
    order = numbered(of_core.select("root").distinct(), "root", name="label", first=1)
    labelled = cut(of_core.join(order, "root").select("i", F.col("label").cast("int").alias("label")), "core-labels")
    border = edges.join(labelled.select(F.col("i").alias("src"), "label"), "src").groupBy("dst").agg(F.min("label").alias("near"))
    ids = nodes.select(F.col(id_col).alias("i"))
    return ids.join(labelled, "i", "left").join(border, ids.i == border.dst, "left").select("i", F.coalesce("label", "near", F.lit(NOISE)).cast("int").alias("label"))
