"""Similarity join of a stream with itself: its buckets are state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadloom.functions.strings import as_bytes, edit_distance, once
from threadloom.params import UNREACHED, JoinParams
from threadloom.plans.lsh import buckets
from threadloom.plans.scratch import cut, scope

#: The state store that holds a list for each bucket.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_ROW = "i long, q int, n int, sig string, s string"
FOUND = "t int, k int, i1 long, i2 long, q1 int, q2 int, s1 string, s2 string"


def agree(a: str, b: str) -> bool:
    """Whether two signatures agree wherever both are reached."""
    return a == b or all(x == y or UNREACHED in (x, y) for x, y in zip(a, b))


class Bucket(StatefulProcessor):
    """The strings of one bucket so far; a new one meets those before it, of its own batch too, and joins them."""

    def __init__(self, k: int, expiry: int | None):
        self.k, self.expiry = k, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", _ROW, ttlDurationMs=self.expiry)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = list(self.known.get())
        for batch in rows:
            new = [tuple(r) for r in batch[["i", "q", "n", "sig", "s"]].itertuples(index=False)]
            out = []
            for at, (i, q, n, sig, s) in enumerate(new):
                for j, p, m, other, text in (*known, *new[:at]):
                    if i != j and abs(n - m) <= self.k and agree(sig, other):
                        out.append((key[0], key[1], *((j, i, p, q, text, s) if j < i else (i, j, q, p, s, text))))
            known += new
            self.known.appendList([(int(i), int(q), int(n), sig, s) for i, q, n, sig, s in new])
            yield pd.DataFrame(out, columns=FOUND.replace(" long", "").replace(" int", "").replace(" string", "").split(", "))

    def close(self) -> None:
        pass


def stream_pairs(stream: DataFrame, params: JoinParams, expiry: int | None = None) -> DataFrame:
    """``t``, ``k``, ``i1`` < ``i2``, ``q1``, ``q2``, ``s1``, ``s2`` of every collision of two strings of a stream (``id``, ``s``), when the later one arrives.

    State is one list for each bucket (signatures, their places and strings); an entry is forgotten ``expiry`` milliseconds after it came, if
    that is given, and pairs further apart are not found then. Null strings and ids take no part. An id that comes again is a string of
    its own that never pairs with the earlier one.
    """
    s = as_bytes(F.col("s").cast("string"))
    rows = stream.select(F.col("id").cast("long").alias("i"), s.alias("s")).where("i is not null and s is not null")
    table = buckets(rows, params, keep=["s"])
    found = table.groupBy("t", "k", "hash_id").transformWithStateInPandas(
        statefulProcessor=Bucket(params.k, expiry), outputStructType=FOUND, outputMode="Append", timeMode="ProcessingTime" if expiry else "None"
    )
    return found


def match_within(stream: DataFrame, params: JoinParams, sink: Callable[[DataFrame, int], None], checkpoint: str, expiry: int | None = None, **trigger) -> StreamingQuery:
    """Starts a query that hands each micro-batch's new pairs (``id1`` < ``id2``, ``dist``) to ``sink``: those within ``params.k`` edits of which some pair of
    suffixes collides more than ``count_filter`` times. What a batch wrote is freed when ``sink`` returns.

    All collisions of a pair arrive with the later string, so a batch counts them by itself. The session needs the RocksDB state store
    (``STORE``). After a restart from ``checkpoint`` the strings before it are still met.
    """

    def each(batch: DataFrame, number: int) -> None:
        with scope():
            counts = batch.groupBy("i1", "i2", "q1", "q2").agg(F.count("*").alias("freq"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
            pairs = counts.where(F.col("freq") > params.count_filter).groupBy("i1", "i2").agg(F.first("s1").alias("s1"), F.first("s2").alias("s2"))
            met = cut(pairs, "pairs").withColumn("dist", once(edit_distance(F.col("s1"), F.col("s2"), params.k))).where("dist >= 0")
            sink(met.select(F.col("i1").alias("id1"), F.col("i2").alias("id2"), "dist"), number)

    found = stream_pairs(stream, params, expiry)
    return found.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
