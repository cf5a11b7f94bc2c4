"""Arrow batches of texts as UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of whole texts that a worker handles at once. Spark's own batches (10,000 rows or 64 MB, whichever comes first) suit
#: numbers; they are cut up in the worker, so results that the caller runs need no setting of the session.
BATCH_ROWS = 500


def few(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows, without copying them."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = BATCH_ROWS) -> Callable:
    """``run`` over small batches, after which a worker hands the memory that it freed back to the system: workers outlive
    their tasks and stand beside each other in an executor."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(few(batches, rows))
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return whole


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def beside(df: DataFrame, ddl: str, *names: str) -> StructType:
    """Fields ``names`` of ``df`` as they are (all of them if none is named), then those of ``ddl``: names and types of the
    input never pass through a parser."""
    kept = [df.schema[n] for n in names] if names else list(df.schema)
    return StructType([*kept, *StructType.fromDDL(ddl).fields])


def apart(df: DataFrame, text_col: str) -> DataFrame:
    """``row``, a struct of all other columns under their own names, and ``text``: no name of the input can clash with a
    result's, and the text travels once."""
    rest = [F.col(quoted(c)) for c in df.columns if c != text_col]
    return df.select(F.struct(*rest or [F.lit(None).cast("int").alias("none")]).alias("row"), F.col(quoted(text_col)).cast("string").alias("text"))


def together(columns: list[str], text_col: str = "text", text: Column | None = None) -> list[Column]:
    """The input's columns again, out of ``row`` and ``text``."""
    text = F.col("text") if text is None else text
    return [text.alias(c) if c == text_col else F.col("row." + quoted(c)).alias(c) for c in columns]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n + 1 offsets; a null is an empty text."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def each(column: pa.Array) -> Iterator[bytes]:
    """Every text as bytes, without a Python string in between."""
    data, at = utf8(column)
    view = memoryview(data)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        yield bytes(view[i:j])


def runs(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` bytes each, or one longer row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j
        i = j
