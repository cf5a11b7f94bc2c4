"""Similarity join of a stream against a table of strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from threadloom.operators.join import Side, links_between, pairs_between
from threadloom.params import JoinParams
from threadloom.plans.scratch import cut, scope


def match_batch(batch: DataFrame, static: Side, params: JoinParams, plan: str = "auto") -> DataFrame:
    """``id``, ``i``, ``dist``: strings of ``batch`` (``id``, ``s``) within ``params.k`` edits of strings of ``static``.

    The batch and the table are two sides of each join: strings of the table never meet each other. Hot buckets are
    priced first, as in a join of tables.
    """
    news = Side.of(batch, "id", "s", params=params)
    found = pairs_between(news, static, links_between(news, static, params.k, params, plan))
    return found.withColumnsRenamed({"id1": "id", "id2": "i"})


def match_stream(stream: DataFrame, static: DataFrame, params: JoinParams, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that hands each micro-batch's matches to ``sink``. The buckets of the table (``i``, ``s``) are written once; a
    micro-batch only embeds its own rows, and what it wrote is freed when ``sink`` returns."""
    kept = Side.of(static, "i", "s", params=params)

    def each(batch: DataFrame, number: int) -> None:
        with scope():
            sink(match_batch(cut(batch, "batch"), kept, params), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
