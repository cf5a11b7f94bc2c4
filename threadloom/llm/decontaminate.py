"""Benchmark passages in documents by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.llm.arrow_text import apart, beside, each, frugal, quoted, runs, together, utf8
from threadloom.plans.scratch import cut

WINDOW = 10
#: Benchmark text that is carried to the executors whole, and the bits of the shift tables and of the filters of windows that are carried of a
#: larger one, least and most; items shorter than a window have tables of the least size for each number of words.
BLOCK_BYTES, TABLE_BITS, FILTER_BITS = 4 << 20, (20, 24), (22, 27)
#: Text bytes of one numpy pass; a longer text is one pass.
RUN_BYTES = 1 << 20
#: Window ends that one lane of the search looks at.
LANE = 256

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_Q = 0x9E3779B97F4A7C15 | 1
_QINV = pow(_Q, -1, 1 << 64)
_LOW = np.arange(256, dtype=np.uint64)
_LOW[0x41:0x5B] += np.uint64(32)
_VALUE = (_LOW + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
_VALUE ^= _VALUE >> np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_Q, _QINV)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, end byte and text of every word of the texts that ``at`` bounds in ``data``.

    A word is a run of digits, letters A-Z and a-z, and anything beyond ASCII; A-Z count as lower case.
    """
    inside = _WORD[data]
    before = np.concatenate(([False], inside[:-1]))
    before[at[:-1][at[:-1] < len(data)]] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False]))[: len(data)]
    after[at[1:][at[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:-1], out=total[1:])
    h = _mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return h, begin, end, np.searchsorted(at, begin, side="right") - 1


def _joined(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words that end at each place of ``at``."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(_Q) + h[at - k])
    return out


@dataclass
class Group:
    """Test strings of one number of words: shift table, suffix buckets and the strings themselves."""

    words: int
    block: int
    bits: int
    shift: np.ndarray
    suffixes: np.ndarray
    keys: np.ndarray
    bucket: np.ndarray
    strings: list[bytes]
    items: list[list[str]]

    @staticmethod
    def of(words: int, strings: dict[bytes, list[str]]) -> Group:
        block = _block_of(words)
        order = list(strings)
        text = np.frombuffer(b" ".join(order), np.uint8)
        h, *_ = word_hashes(text, np.array([0, len(text)]))
        last = np.arange(1, len(order) + 1) * words - 1
        bits = min(24, max(16, math.ceil(math.log2(64 * len(h) + 1))))
        shift = np.full(1 << bits, words - block + 1, np.min_scalar_type(words))
        for back in range(words - block, -1, -1):
            shift[_joined(h, last - back, block) >> np.uint64(64 - bits)] = back
        suffix, key = _joined(h, last, block), _joined(h, last, words)
        rank = np.argsort(key, kind="stable")
        suffixes = np.unique(suffix)
        return Group(
            words, block, bits, shift, suffixes, key[rank], np.searchsorted(suffixes, suffix[rank]), [order[i] for i in rank], [strings[order[i]] for i in rank]
        )

    def ends(self, h: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Places where a string may end. ``first`` and ``stop`` bound each text's words; all lanes step together,
        each as far as its shift table allows."""
        begin, n = first + self.words - 1, np.maximum(stop - first - self.words + 1, 0)
        lanes = -(-n // LANE)
        which = np.repeat(np.arange(len(n)), lanes)
        offset = (np.arange(len(which)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        cur = begin[which] + offset
        end = np.minimum(cur + LANE, stop[which])
        found = []
        down = np.uint64(64 - self.bits)
        while len(cur):
            step = self.shift[_joined(h, cur, self.block) >> down]
            hit = step == 0
            if hit.any():
                found.append(cur[hit])
            cur = cur + np.maximum(step, 1)
            live = cur < end
            cur, end = cur[live], end[live]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def search(self, data: bytes, h: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last word and string number of every occurrence: bucket by suffix, then by all words' hash, then by the
        bytes themselves."""
        at = self.ends(h, first, stop)
        suffix = _joined(h, at, self.block)
        bucket = np.minimum(np.searchsorted(self.suffixes, suffix), len(self.suffixes) - 1)
        near = self.suffixes[bucket] == suffix
        at, bucket = at[near], bucket[near]
        key = _joined(h, at, self.words)
        which = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        near = (self.keys[which] == key) & (self.bucket[which] == bucket)
        at, which = at[near], which[near]
        same = np.zeros(len(at), bool)
        for i, (last, string) in enumerate(zip(at.tolist(), which.tolist())):
            span = slice(last - self.words + 1, last + 1)
            same[i] = b" ".join(data[x:y] for x, y in zip(begin[span].tolist(), end[span].tolist())).lower() == self.strings[string]
        return at[same], which[same]


def windows(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Group]:
    """Search groups of the items' windows, one for each number of words that occurs."""
    by: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        raw = (text or "").encode()
        data = np.frombuffer(raw, np.uint8)
        _, begin, end, _ = word_hashes(data, np.array([0, len(data)]))
        words = [raw[x:y].lower() for x, y in zip(begin.tolist(), end.tolist())]
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            owners = by[n][b" ".join(words[i : i + n])]
            if item is not None and (not owners or owners[-1] != item):
                owners.append(item)
    return [Group.of(n, dict(strings)) for n, strings in sorted(by.items())]


def _scan(groups: list[Group], column: pa.Array, spans: list[np.ndarray], items: list[set[str]]) -> np.ndarray:
    """Adds the hits of every text of the column to ``spans`` (first and end word) and ``items``; gives word counts."""
    data, at = utf8(column)
    counts = np.zeros(len(column), np.int64)
    for i, j in runs(at, RUN_BYTES):
        part, local = data[at[i] : at[j]], at[i : j + 1] - at[i]
        h, begin, end, text = word_hashes(part, local)
        first = np.searchsorted(text, np.arange(j - i), side="left")
        stop = np.searchsorted(text, np.arange(j - i), side="right")
        counts[i:j] = stop - first
        raw = part.tobytes() if groups else b""
        for g in groups:
            last, which = g.search(raw, h, begin, end, first, stop)
            for x, s in zip(last.tolist(), which.tolist()):
                t = int(text[x])
                x -= int(first[t])
                spans[i + t].append((x - g.words + 1, x + 1))
                items[i + t].update(g.items[s])
    return counts


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (all other columns of ``docs``), ``text``, ``n_words``, ``begin``, ``end`` and ``items`` of every row.

    ``begin`` and ``end`` bound the document's words (end exclusive, runs merged) that lie inside an occurrence of a
    window: ``window`` consecutive words of an item, or all words of a shorter item. ``items`` are the distinct items,
    as strings in order, of the windows that occur. Null and empty texts have no words on either side. A null item id
    marks words but is no item; items of equal id are one, and equal windows belong to each of their items. An empty
    benchmark hits nothing, an empty table gives an empty result. Repeated rows are marked alike. Texts of any length are searched
    whole; columns of any name travel in ``row``. ``window`` is any number of words from 1 on.

    A benchmark of up to ``block_bytes`` is carried to the documents, which are not shuffled then. Of a larger one only shift tables
    and a filter of its windows are, whose sizes are bounded (``TABLE_BITS``, ``FILTER_BITS``); the places that they leave are joined with the
    table of all windows. Within those bounds (benchmarks of some 50 MB) hardly a place is left but the windows that occur.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(quoted(item_col)).cast("string").alias("i"), F.col(quoted(item_text_col)).cast("string").alias("t")).where("t is not null")
    total = bench.select(F.sum(F.octet_length("t"))).first()[0] or 0
    given = apart(docs, text_col).select("row", "text")
    schema = beside(given, "n_words long, begin array<long>, end array<long>, items array<string>, text string", "row")
    if total > block_bytes:
        return _by_join(given, bench, window, schema, total)
    groups = windows([(r.i, r.t) for r in bench.collect()], window)
    shared = spark.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans: list[list] = [[] for _ in range(b.num_rows)]
            items: list[set[str]] = [set() for _ in range(b.num_rows)]
            counts = _scan(shared.value, b.column(1), spans, items)
            yield _result(b.column(0), counts, spans, [sorted(x) for x in items], b.column(1))

    return given.mapInArrow(frugal(run), schema)


def _result(row: pa.Array, counts: np.ndarray, spans: list[list], items: list[list[str]], text: pa.Array) -> pa.RecordBatch:
    merged = [_merged(s) for s in spans]
    bounds = [pa.array([[x[k] for x in s] for s in merged], pa.list_(pa.int64())) for k in range(2)]
    return pa.RecordBatch.from_arrays([row, pa.array(counts), *bounds, pa.array(items, pa.list_(pa.string())), text], ["row", "n_words", "begin", "end", "items", "text"])


def _block_of(words: int) -> int:
    return 1 if words < 3 else 2 if words < 6 else 3


def table_bits(size: int, words: int, window: int) -> tuple[int, int]:
    """Bits of the index of the shift table, and of the filter, of strings of ``words`` words, for a benchmark of ``size`` bytes: four entries and 16
    bits for each word of six bytes, within ``TABLE_BITS`` and ``FILTER_BITS``."""
    if words < window:
        return TABLE_BITS[0], FILTER_BITS[0]
    many = max(1, size // 6)
    return tuple(min(most, max(least, math.ceil(math.log2(per * many)))) for per, (least, most) in ((4, TABLE_BITS), (16, FILTER_BITS)))


def _shift_tables(bench: DataFrame, window: int, size: int) -> dict[int, np.ndarray]:
    """A shift table for each number of words that a window has: each task fills tables of its own, and an
    aggregation keeps the least shift of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in runs(at, RUN_BYTES):
                h, *_, text = word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
                for first, stop in zip(*(np.searchsorted(text, np.arange(j - i), side=s).tolist() for s in ("left", "right"))):
                    n = min(window, stop - first)
                    if not n:
                        continue
                    block, bits = _block_of(n), table_bits(size, n, window)[0]
                    table = tables.setdefault(n, np.full(1 << bits, n - block + 1, np.min_scalar_type(n)))
                    last = np.arange(first + n - 1, stop)
                    for back in range(n - block, -1, -1):
                        entry = _joined(h, last - back, block) >> np.uint64(64 - bits)
                        np.minimum.at(table, entry, back)
        for n, table in tables.items():
            entry = np.flatnonzero(table < n - _block_of(n) + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), n, np.int32)), pa.array(entry), pa.array(table[entry].astype(np.int32))], ["n", "entry", "shift"])

    found = bench.mapInArrow(frugal(run), "n int, entry int, shift int").groupBy("n", "entry").agg(F.min("shift").alias("shift")).toArrow()
    n, entry, shift = (found.column(c).to_numpy() for c in ("n", "entry", "shift"))
    out = {}
    for k in np.unique(n).tolist():
        table = out[k] = np.full(1 << table_bits(size, k, window)[0], k - _block_of(k) + 1, np.min_scalar_type(k))
        table[entry[n == k]] = shift[n == k]
    return out


def _places(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a filter that each key sets."""
    return [((key * np.uint64(_Q) if k else key) >> np.uint64(64 - bits)).astype(np.int64) for k in range(2)]


def _window_filter(bench: DataFrame, window: int, size: int) -> dict[int, np.ndarray]:
    """A Bloom filter of the hashes of all windows of each number of words, as 64-bit words: tasks set the bits of their own windows, and an
    aggregation joins them, so what reaches the driver is the filter, whatever the benchmark's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, np.ndarray] = {}
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in runs(at, RUN_BYTES):
                h, *_, text = word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
                for first, stop in zip(*(np.searchsorted(text, np.arange(j - i), side=s).tolist() for s in ("left", "right"))):
                    n = min(window, stop - first)
                    if n:
                        bits = table_bits(size, n, window)[1]
                        own = filters.setdefault(n, np.zeros(1 << (bits - 6), np.uint64))
                        for place in _places(_joined(h, np.arange(first + n - 1, stop), n), bits):
                            np.bitwise_or.at(own, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        for n, own in filters.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at].view(np.int64))], ["n", "at", "bits"])

    found = bench.mapInArrow(frugal(run), "n int, at int, bits long").groupBy("n", "at").agg(F.bit_or("bits").alias("bits")).toArrow()
    n, at, words = (found.column(c).to_numpy() for c in ("n", "at", "bits"))
    out = {}
    for k in np.unique(n).tolist():
        own = out[k] = np.zeros(1 << (table_bits(size, k, window)[1] - 6), np.uint64)
        own[at[n == k]] = words[n == k].view(np.uint64)
    return out


def _may_be(own: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """Whether the filter has each key; a few that it lacks pass as well."""
    out = np.ones(len(key), bool)
    for place in _places(key, bits):
        out &= (own[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def _spelled(raw: bytes, begin: np.ndarray, end: np.ndarray, last: np.ndarray, n: int) -> Iterator[str]:
    for x in last.tolist():
        yield b" ".join(raw[a:z] for a, z in zip(begin[x - n + 1 : x + 1].tolist(), end[x - n + 1 : x + 1].tolist())).lower().decode()


def _bench_windows(bench: DataFrame, window: int) -> DataFrame:
    """``n``, ``s``, ``item``: every different window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, raw in zip(b.column(0).to_pylist(), each(b.column(1))):
                _, begin, end, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                n = min(window, len(begin))
                found = sorted(set(_spelled(raw, begin, end, np.arange(n - 1, len(begin)), n))) if n else []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), n, np.int32)), pa.array(found, pa.string()), pa.array([item] * len(found), pa.string())], ["n", "s", "item"])

    return bench.mapInArrow(frugal(run), "n int, s string, item string").distinct()


def _by_join(given: DataFrame, bench: DataFrame, window: int, schema: StructType, total: int) -> DataFrame:
    """``contamination`` for a benchmark of any size: a place becomes a row if neither the shift tables nor the filter of windows rule it out."""
    spark = given.sparkSession
    numbered = cut(given.select(F.monotonically_increasing_id().alias("r"), "row", "text"), "leak-texts")
    shared = spark.sparkContext.broadcast((_shift_tables(bench, window, total), _window_filter(bench, window, total)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, filters = shared.value
        groups = [Group(n, _block_of(n), table_bits(total, n, window)[0], table, *[np.empty(0)] * 3, [], []) for n, table in tables.items()]
        for b in batches:
            data, at = utf8(b.column(1))
            r = b.column(0).to_numpy()
            for i, j in runs(at, RUN_BYTES):
                part = data[at[i] : at[j]]
                h, begin, end, text = word_hashes(part, at[i : j + 1] - at[i])
                first, stop = (np.searchsorted(text, np.arange(j - i), side=s) for s in ("left", "right"))
                raw = part.tobytes()
                for g in groups:
                    last = g.ends(h, first, stop)
                    last = last[_may_be(filters[g.words], _joined(h, last, g.words), table_bits(total, g.words, window)[1])]
                    of = text[last]
                    size = pa.array(np.full(len(last), g.words, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(r[i:j][of]), size, pa.array(last - first[of] + 1), pa.array(list(_spelled(raw, begin, end, last, g.words)), pa.string())], ["r", "n", "stop", "s"])

    places = cut(numbered.select("r", "text").mapInArrow(frugal(find), "r long, n int, stop long, s string"), "leak-places")
    owned = cut(_bench_windows(bench, window), "leak-windows")
    hits = cut(places.join(owned.select("n", "s").distinct(), ["n", "s"]), "leak-hits")
    spans = hits.groupBy("r").agg(F.collect_list(F.struct((F.col("stop") - F.col("n")).alias("begin"), F.col("stop").alias("end"))).alias("spans"))
    items = hits.select("r", "n", "s").distinct().join(owned.where("item is not null"), ["n", "s"]).groupBy("r").agg(F.sort_array(F.collect_set("item")).alias("items"))
    joined = numbered.join(spans, "r", "left").join(items, "r", "left").select("row", "text", "spans", "items")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = _scan([], b.column(1), [], [])
            spans = [[(x["begin"], x["end"]) for x in s or []] for s in b.column(2).to_pylist()]
            yield _result(b.column(0), counts, spans, [x or [] for x in b.column(3).to_pylist()], b.column(1))

    return joined.mapInArrow(frugal(merge), schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, all columns unchanged."""
    return contamination(docs, benchmark, text_col, **options).where(F.size("begin") == 0).select(together(docs.columns, text_col))
