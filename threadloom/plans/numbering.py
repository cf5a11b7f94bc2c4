"""Consecutive numbers in key order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.plans.scratch import cut


def numbered(df: DataFrame, *keys: str, name: str = "number", first: int = 0) -> DataFrame:
    """``df`` with a long column ``name``: the place of each row in the order of ``keys``, counted from ``first``.

    Rows are ranged over partitions by key and numbered within each; the partitions' sizes (one row each) give the
    offsets. Rows of equal keys are numbered in any order; a hash of the whole row deals them to several ranges.
    """
    ranged = cut(df.repartitionByRange(*keys, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))).withColumn("_tl_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_tl_part").agg(F.count("*").alias("_tl_n")).collect()
    offsets, total = [], first
    for r in sorted(sizes, key=lambda r: r._tl_part):
        offsets.append((r._tl_part, total))
        total += r._tl_n
    table = df.sparkSession.createDataFrame(offsets, "_tl_part int, _tl_offset long")
    within = F.row_number().over(Window.partitionBy("_tl_part").orderBy(*keys)) - 1
    return ranged.join(F.broadcast(table), "_tl_part").withColumn(name, F.col("_tl_offset") + within).drop("_tl_part", "_tl_offset")
