"""Consensus strings of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import NOISE


def points_per_cluster(labels: DataFrame, *keys: str) -> DataFrame:
    """``label``, ``points`` without noise."""
    return labels.where(F.col("label") != NOISE).groupBy(*keys, "label").agg(F.count("*").alias("points"))


def letter_counts(labelled: DataFrame, length: int | None = None, *keys: str, text_col: str = "s") -> DataFrame:
    """``label``, ``pos``, ``ch``, ``n``: letters at each place of a cluster's strings, up to ``length``. A string says
    nothing about places beyond its end."""
    chars = F.filter(F.split(text_col, ""), lambda c: c != "")
    if length is not None:
        chars = F.slice(chars, 1, length)
    placed = labelled.where(F.col("label") != NOISE).select(*keys, "label", F.posexplode(chars).alias("pos", "ch"))
    return placed.groupBy(*keys, "label", "pos", "ch").agg(F.count("*").alias("n"))


def consensus(labelled: DataFrame, length: int | None = None, letters: str | None = None, *keys: str, text_col: str = "s") -> DataFrame:
    """``label``, ``consensus``, ``points`` of every cluster of rows ``label``, ``s``.

    At each place the most frequent letter stands, of equal ones the lowest. ``letters``, if given, are the only ones
    allowed; another fails the query. Letters are counted before rows of a cluster come together, so a task sees at
    most a row for each place of the consensus.
    """
    counts = letter_counts(labelled, length, *keys, text_col=text_col)
    if letters is not None:
        known = F.instr(F.lit(letters), F.col("ch")) > 0
        counts = counts.withColumn("ch", F.when(known, F.col("ch")).otherwise(F.raise_error(F.concat(F.lit("letter outside the alphabet: "), F.col("ch")))))
    best = counts.groupBy(*keys, "label", "pos").agg(F.min(F.struct((-F.col("n")).alias("rank"), F.col("ch"))).alias("x"))
    text = best.groupBy(*keys, "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("x.ch").alias("ch")))), lambda p: p["ch"]), "").alias("consensus"))
    points = points_per_cluster(labelled, *keys)
    return points.join(text, [*keys, "label"], "left").select(*keys, "label", F.coalesce("consensus", F.lit("")).alias("consensus"), "points")


def letters_outside(labelled: DataFrame, letters: str, *keys: str, text_col: str = "s") -> DataFrame:
    """``label``, ``ch``, ``n``: the letters of each cluster's strings that are none of ``letters``; what ``consensus`` would fail on."""
    found = letter_counts(labelled, None, *keys, text_col=text_col).where(F.instr(F.lit(letters), F.col("ch")) == 0)
    return found.groupBy(*keys, "label", "ch").agg(F.sum("n").alias("n"))
