"""Sinks: pairs, consensus strings and reports."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("threadloom")


def sorted_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct pairs in order: ranged once, which is enough for both."""
    ranged = pairs.select("id1", "id2").repartitionByRange("id1", "id2")
    return ranged.distinct().sortWithinPartitions("id1", "id2")


def write_pairs(pairs: DataFrame, strings: DataFrame, path: str) -> None:
    """Text of three lines a pair: the two ids, then the two strings. ``strings`` has ``i``, ``s``."""
    one, two = (strings.select(F.col("i").alias(f"id{d}"), F.col("s").alias(f"s{d}")) for d in (1, 2))
    met = pairs.select("id1", "id2").distinct().join(one, "id1").join(two, "id2").orderBy("id1", "id2")
    met.select(F.concat_ws("\n", F.concat_ws(" ", "id1", "id2"), "s1", "s2").alias("value")).write.mode("overwrite").text(path)


def write_consensus(found: DataFrame, path: str) -> None:
    """Text of one line a cluster: its consensus string and its number of points."""
    found.orderBy("label").select(F.concat_ws(" ", "consensus", F.col("points").cast("string")).alias("value")).write.mode("overwrite").text(path)


class Report:
    """Wall-clock seconds by step, as log lines and as a CSV table."""

    def __init__(self, device: str = "spark"):
        self.device, self.rows = device, []

    @contextmanager
    def step(self, main: str, step: str = "", sub: str = ""):
        start = time.perf_counter()
        try:
            yield
        finally:  # a step that fails took time too
            self.rows.append((main, step, sub, time.perf_counter() - start, self.device))
            log.info("%s %s %s: %.2f s", *self.rows[-1][:4])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "MainStep string, Step string, SubStep string, `Time(sec)` double, Device string")

    def write(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
