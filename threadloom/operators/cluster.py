"""Clustering of strings: join, density clusters and consensus, in chunks and over their consensus strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.consensus import consensus
from threadloom.operators.graph import dbscan
from threadloom.operators.join import JoinResult, edit_join_exact, edit_join_lsh
from threadloom.params import JoinParams
from threadloom.plans.numbering import numbered
from threadloom.plans.scratch import cut


def labels_of(rows: DataFrame, found: JoinResult, min_pts: int) -> DataFrame:
    """``i``, ``label`` of every row ``i``, from a join of the rows.

    The graph has one node for each different string (of a group, if the join had groups), weighted by its copies and named by
    their smallest id. That gives every copy the label that it would have as a node of its own, without expanding
    copies into pairs.
    """
    placed = cut(rows.select(F.col("i").alias("id")).join(found.members.select("id", "i"), "id"), "placed")
    nodes = cut(placed.groupBy("i").agg(F.count("*").alias("weight")), "nodes")
    degree = F.col("weight") + F.coalesce("m", F.lit(0))
    core = cut(nodes.join(found.around(nodes), "i", "left").where(degree >= min_pts).select("i"), "core")
    labels = dbscan(nodes, found.connecting(core), min_pts, "i", "i1", "i2", "weight", core)
    return placed.join(labels, "i").select(F.col("id").alias("i"), "label")


def chunk_clusters(strings: DataFrame, params: JoinParams, exact: bool = False, chunked: bool = True, min_pts: int | None = None) -> DataFrame:
    """``chunk``, ``i``, ``s``, ``label`` of every row ``i``, ``s``, where ``i`` counts the rows from 0.

    Chunks hold ``params.chunk_size`` consecutive rows and are clustered apart, all in one job: the chunk is part of every
    join key, so strings of different chunks never meet. Labels are numbered over all chunks.
    """
    rows = strings.select(F.col("i").cast("long").alias("i"), F.col("s").cast("string").alias("s"))
    chunk = (F.floor(F.col("i") / params.chunk_size) if chunked else F.lit(0)).cast("long")
    rows = cut(rows.withColumn("chunk", chunk), "rows")
    found = edit_join_exact(rows, params.k, "i", "s", group_col="chunk") if exact else edit_join_lsh(rows, params, "i", "s", group_col="chunk")
    return rows.join(labels_of(rows, found, min_pts or params.min_pts), "i").select("chunk", "i", "s", "label")


def cluster(strings: DataFrame, params: JoinParams, exact: bool = False, letters: str | None = None, length: int | None = None) -> DataFrame:
    """``label``, ``consensus``, ``points`` and ``reads`` of every cluster of rows ``i``, ``s``.

    Rows are counted in the order of ``i``, whatever numbers those are; rows of equal ``i`` in any order. With more rows than
    ``params.chunk_size`` each chunk gives its consensus strings and these are clustered once more; then
    ``points`` counts consensus strings and ``reads`` the rows behind them. ``second_level_min_pts`` is ``min_pts`` unless
    set. ``length`` is the consensus length in characters, by default that of the first string. Null strings are left out;
    empty input gives no cluster; any size works.
    """
    rows = cut(numbered(strings.where("s is not null").select(F.col("i").alias("id"), "s"), "id", name="i").select("i", "s"), "counted")
    first = rows.where("i = 0").select(F.length("s").alias("n")).collect()
    if not first:
        return _none(strings)
    length = first[0].n if length is None else length
    chunked = rows.count() > params.chunk_size
    labelled = cut(chunk_clusters(rows, params, exact, chunked), "labelled")
    level = consensus(labelled, length, letters)
    if not chunked:
        return level.select("label", "consensus", "points", F.col("points").alias("reads"))
    once = numbered(level, "label", name="i").select("i", F.col("consensus").alias("s"), F.col("points").alias("reads"))
    once = cut(once, "level1")
    again = chunk_clusters(once.select("i", "s"), params, exact, False, params.second_level_min_pts)
    again = cut(again, "level2")
    reads = again.join(once.select("i", "reads"), "i").where("label <> -1").groupBy("label").agg(F.sum("reads").alias("reads"))
    return consensus(again, length, letters).join(reads, "label").select("label", "consensus", "points", "reads")


def _none(strings: DataFrame) -> DataFrame:
    return strings.sparkSession.createDataFrame([], "label int, consensus string, points long, reads long")
