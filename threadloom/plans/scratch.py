"""Lineage cuts through files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Scratch paths that are there, by path, and those made inside the innermost ``scope`` of the thread or task that runs.
_made: dict[str, SparkSession] = {}
_inside: ContextVar[list[str] | None] = ContextVar("threadloom_scope", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset a folder of our own on a local master, and an error on any
    other, whose executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = there.get() if there.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends or by ``release``."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    if (inside := _inside.get()) is not None:
        inside.append(path)
    return path


#: Rows of a file, where the number of rows is known beforehand.
FILE_ROWS = 500_000
#: Rows of an Arrow batch while a table is written: Spark's own 10,000 rows of texts are tens of megabytes in each task, on both sides.
BATCH_ROWS = 1000


#: Settings of a session while ``cut`` writes: small Arrow batches, and shuffle files removed when their query ends rather than when the
#: driver happens to collect garbage. (A table that is written reads no shuffle twice.)
_BATCHES, _SHUFFLES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: dict[str, tuple[int, dict[str, str | None]]] = {}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Holds the session's Arrow batches to ``BATCH_ROWS`` rows and has shuffle files removed with their query, inside the block.

    Any number of threads may be inside: the first sets, the last restores what the session had before the first.
    """
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        n, own = _writers.get(session, (0, {}))
        if n == 0:
            found = spark.conf.getAll
            given = found() if callable(found) else found
            own = {key: given.get(key) for key in (_BATCHES, _SHUFFLES)}
            if not 0 < int(spark.conf.get(_BATCHES)) <= BATCH_ROWS:
                spark.conf.set(_BATCHES, str(BATCH_ROWS))
            spark.conf.set(_SHUFFLES, "true")
        _writers[session] = n + 1, own
    try:
        yield
    finally:
        with _lock:
            n, own = _writers.pop(session)
            if n > 1:
                _writers[session] = n - 1, own
            else:
                for key, value in own.items():
                    spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut(df: DataFrame, name: str = "cut", rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Unlike localCheckpoint the rows survive the loss of any executor, and unlike checkpoint() they are columnar,
    compressed and prunable. Used where a result feeds several consumers or where an iteration would otherwise
    grow its plan. ``rows``, a bound of the number of rows, keeps small tables from being written as many small files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    with writing(spark):
        df.write.mode("error").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _plain(path: str) -> str:
    return path.split(":", 1)[-1].lstrip("/")


@contextmanager
def scope(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Frees what ``cut`` wrote inside, once the block is left; for sessions of many queries.

    The list that the block gets names the frames to keep: results of ``cut`` that are still read afterwards; a scope around this
    one frees them. Frames that were not written are lazy and may read what is freed, so they have to be used up inside. Only what
    the block itself wrote is freed: other threads (a stream's micro-batches too) have scopes of their own.
    """
    keep, mine = list(kept), []
    outer = _inside.get()
    token = _inside.set(mine)
    try:
        yield keep
    finally:
        _inside.reset(token)
        paths = {_plain(f.rsplit("/", 1)[0]) for df in keep for f in df.inputFiles()}
        for path in mine:
            if _plain(path) not in paths:
                _free(path)
            elif outer is not None:
                outer.append(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` returned, once nothing reads it any more."""
    paths = {_plain(f.rsplit("/", 1)[0]) for f in df.inputFiles()}
    for path in [p for p in list(_made) if _plain(p) in paths]:
        _free(path)


def _free(path: str) -> None:
    """Deletes a scratch path, unless that was done before."""
    spark = _made.pop(path, None)
    if spark is not None:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def release() -> None:
    """Remove every scratch path that is left, as far as the session still runs."""
    while _made:
        path, spark = _made.popitem()
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM is gone; the folder belongs to the cluster's own cleaning
            return
