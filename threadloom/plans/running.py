"""Running aggregates within groups, without one task for a whole group."""

from __future__ import annotations

from operator import add, xor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.plans.scratch import cut

#: Aggregates that can be carried from one range to the next: Spark's function, and the same of two numbers.
KINDS = {"sum": (F.sum, add), "bit_xor": (F.bit_xor, xor)}
PART = "_tl_part"


def in_ranges(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` ranged over partitions by ``group`` and ``order`` and written, with the number of its partition as a column: the ranges are in
    order, and a group with many rows spans several. A hash of the whole row deals rows of equal keys to several ranges."""
    every = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    return cut(df.repartitionByRange(group, *order, every).withColumn(PART, F.spark_partition_id()), "ranged")


def running(ranged: DataFrame, group: str, order: list[str], **aggs: tuple[str, Column]) -> DataFrame:
    """``ranged`` (of ``in_ranges``) with a column for each of ``aggs``, a kind and a column of longs: the aggregate of all rows of
    the group up to this one.

    Each range is done by itself; what the ranges before it hold of its first group is carried over by the driver, which gets one row
    for each range. ``group`` is a column of longs without nulls. Rows of equal ``order`` come in any order.
    """
    spark = ranged.sparkSession
    totals = ranged.groupBy(PART, group).agg(*(KINDS[kind][0](c).alias(name) for name, (kind, c) in aggs.items()))
    last = F.max_by(F.struct(F.col(group).alias("of"), *aggs), group).alias("last")
    carried, held, of = [], dict.fromkeys(aggs, 0), None
    for r in sorted(totals.groupBy(PART).agg(F.min(group).alias("first"), last).collect(), key=lambda r: r[PART]):
        if r["first"] == of:
            carried.append((r[PART], of, *held.values()))
        goes_on = r["first"] == of == r["last"]["of"]
        of, held = r["last"]["of"], {name: KINDS[kind][1](held[name], r["last"][name]) if goes_on else r["last"][name] for name, (kind, _) in aggs.items()}
    before = {name: f"_tl_before_{name}" for name in aggs}
    table = spark.createDataFrame(carried, f"{PART} int, {group} long" + "".join(f", {b} long" for b in before.values()))
    rows = Window.partitionBy(PART, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumns({name: KINDS[kind][0](c).over(rows) for name, (kind, c) in aggs.items()}).join(F.broadcast(table), [PART, group], "left")
    for name, (kind, _) in aggs.items():
        own, earlier = F.col(name), F.coalesce(F.col(before[name]), F.lit(0).cast("long"))
        out = out.withColumn(name, own + earlier if kind == "sum" else own.bitwiseXOR(earlier))
    return out.drop(*before.values())
