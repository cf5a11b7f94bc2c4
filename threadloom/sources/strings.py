"""String sources: plain text and FASTQ by position, or any table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.plans.numbering import numbered
from threadloom.sources.records import SPLIT, StringsSource


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``i``, ``s``: every line of a text file by its place from 0.

    Lines end at ``\\n`` only; blank lines stay, as empty strings, and a ``\\r`` stays in its line. Lines are numbered from the
    size of each file split and their place in it, without sorting or moving them: what every task gets is a row for each split. Any
    store and compression that Spark reads will do. A missing file fails with Spark's own error.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("s"), F.input_file_name().alias("f"), F.input_file_block_start().alias("b"), F.monotonically_increasing_id().alias("m")
    )
    splits = lines.groupBy("f", "b").agg(F.min("m").alias("least"), F.count("*").alias("n")).collect()
    offsets, total = [], 0
    for r in sorted(splits, key=lambda r: (r.f, r.b)):
        offsets.append((r.f, r.b, total - r.least))
        total += r.n
    table = spark.createDataFrame(offsets, "f string, b long, shift long")
    return lines.join(F.broadcast(table), ["f", "b"]).select((F.col("m") + F.col("shift")).alias("i"), "s")


def is_fastq(spark: SparkSession, path: str) -> bool:
    """Whether the first character is ``@``."""
    head = spark.read.option("lineSep", "\n").text(path).head(1)
    return bool(head) and head[0].value.startswith("@")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``i``, ``s``: the sequence of each complete record of four lines, by the record's place from 0."""
    lines = read_lines(spark, path)
    total = lines.count()
    record = F.floor(F.col("i") / 4).cast("long")
    return lines.where((F.col("i") % 4 == 1) & (record < total // 4)).select(record.alias("i"), "s")


#: Stores whose files tasks read themselves, by byte range, and endings of compressed files, which they do not.
DIRECT, COMPRESSED = ("file", "s3", "gs"), (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def read_records(spark: SparkSession, path: str, split: int = SPLIT, kind: str = "auto") -> DataFrame:
    """``i``, ``s`` of a FASTQ or plain text file, or of a folder's files one after the other, by the data source ``threadloom_strings``.

    Tasks count the lines of each split in one pass over its bytes; with those counts, a number for each split, a second one gives every line
    its number where it is. Nothing is shuffled, so any number of splits will do.
    """
    spark.dataSource.register(StringsSource)
    source = lambda: spark.read.format("threadloom_strings").option("splitBytes", split).option("format", kind)
    counts = sorted((r.i, int(r.s)) for r in source().option("count", "true").load(path).collect())
    return source().option("counts", json.dumps([n for _, n in counts])).load(path)


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """``i``, ``s`` of a FASTQ or plain text file, told apart by the first character. A missing file fails with Spark's own error."""
    fastq = is_fastq(spark, path)
    if (path.split(":", 1)[0] if ":" in path else "file") in DIRECT and not path.endswith(COMPRESSED):
        return read_records(spark, path, kind="fastq" if fastq else "text")
    return read_fastq(spark, path) if fastq else read_lines(spark, path)


def from_table(df: DataFrame, text_col: str, *order: str) -> DataFrame:
    """``i``, ``s``: a column of any table, numbered from 0 in the order of ``order``."""
    return numbered(df.select(F.col(text_col).cast("string").alias("s"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order))), *(f"_o{k}" for k in range(len(order))), name="i").select("i", "s")
