"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from threadloom.plans.scratch import cut, drop


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node that has an edge: columns ``node`` and ``component``.

    Nodes are 64-bit integers. Self-loops, repeated edges and edges with a null end are ignored; a node without
    an edge gets no row. Each round is a few aggregations with map-side combine and two equi-joins on the node, so
    a hub is summed before it is shuffled and its join partition can be split. Rounds grow with the logarithm
    of a component's size; each is written to the shared folder, so plans stay short and lost executors cost one
    round at most.
    """
    e, seen = _round(_oriented(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))))
    if seen[0]:
        for _ in range(max_rounds):
            new, now = _round(_small_star(_large_star(e)), 2 * seen[0])
            drop(e)
            e = new
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _oriented(e: DataFrame) -> DataFrame:
    return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _round(e: DataFrame, rows: int | None = None) -> tuple[DataFrame, tuple]:
    """The edges, written, and their number and digest, which are taken while they are written."""
    seen = Observation()
    out = cut(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")), "cc", rows)
    return out, (seen.get["n"], seen.get["digest"])


def _beside(e: DataFrame, least: DataFrame) -> DataFrame:
    """``e`` with ``m`` of its ``u``. The sums are dealt anew under another name, so that both sides of the join are plain
    exchanges and a hub's partition can be split."""
    return e.join(least.select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("at"), "m"), F.col("u") == F.col("at"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Repeated edges are left to the small-star round, which makes its own distinct.
    return _beside(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = _beside(e, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
