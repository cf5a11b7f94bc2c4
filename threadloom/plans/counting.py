"""Collision counts of pairs of strings by blocks: what collides is counted where two blocks meet, and no collision is a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.embed import _BATCH, _sampled, embedded
from threadloom.params import UNREACHED, JoinParams
from threadloom.plans.lsh import buckets, candidate_pairs, counts_by_slices
from threadloom.plans.numbering import numbered
from threadloom.plans.scratch import cut

#: Strings of a block at most and at least, and blocks that a table is cut into where they are not larger.
MOST, LEAST, BLOCKS = 8192, 256, 8
#: Rows of a block that are counted at once, and rows of the result that go out together.
ROWS, OUT = 64, 1 << 17
#: Signatures among some rows up to which they are looked for one by one.
MANY = 8
#: Strings that a plan is chosen from, and collisions for each pair of them from which blocks are cheaper than joining buckets.
SAMPLE, OFTEN = 512, 0.02

SCHEMAS = {"freq": "i1 long, i2 long, x int", "pairs": "i1 long, i2 long", "number": "n long"}


class Coded:
    """Signatures of strings as numbers: ``codes`` (random string, hash function, suffix, string) and for each random string and hash
    function the numbers that agree with another one of the same bucket number (``also``), with those. The first ``split`` strings meet those from ``first`` on:
    ``alive`` (random string, hash function, suffix, suffix, string) says whether the signature of a string agrees with one there."""

    def __init__(self, strings: list[str], params: JoinParams, split: int | None = None, first: int = 0):
        t, k, q, n = params.num_str, params.num_hash, params.num_rep, len(strings)
        split = n if split is None else split
        self.codes = np.zeros((t, k, q, n), np.uint16 if q * n < 1 << 16 else np.int32)
        self.alive = np.zeros((t, k, q, q, split), bool)
        self.also: dict[tuple[int, int], dict[int, list[int]]] = {}
        for x in range(t if q else 0):
            found = [[_sampled(embedded(strings[lo : lo + _BATCH], params, x, y), params) for lo in range(0, n, _BATCH)] for y in range(q)]
            for z in range(k):
                sigs = np.concatenate([part[0][:, z] for row in found for part in row])
                ids = np.concatenate([part[1][:, z] for row in found for part in row])
                code, also = _numbers(sigs, ids)
                self.codes[x, z] = code.reshape(q, n)
                if also:
                    self.also[x, z] = also
                for y in range(q):
                    there = np.zeros(int(code.max(initial=0)) + 1, bool)
                    there[self.codes[x, z, y, first:]] = True
                    direct = there.copy()
                    for u, those in also.items():
                        there[u] |= direct[those].any()
                    self.alive[x, z, :, y] = there[self.codes[x, z, :, :split]]


def _numbers(sigs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, dict[int, list[int]]]:
    """A number for each different signature, and the numbers that agree with others, with those."""
    _, first, code = np.unique(ids, return_index=True, return_inverse=True)
    code = code.ravel()
    other = np.flatnonzero((sigs != sigs[first[code]]).any(1))
    if not len(other):
        return code, {}
    whole = np.ascontiguousarray(sigs[other].astype("<u4")).view(f"V{4 * sigs.shape[1]}").ravel()
    _, at, more = np.unique(whole, return_index=True, return_inverse=True)
    bucket = np.concatenate([np.arange(len(first)), code[other[at]]])  # of each number
    kinds = sigs[np.concatenate([first, other[at]])]
    code[other] = len(first) + more.ravel()
    also: dict[int, list[int]] = {}
    for b in np.unique(bucket[len(first) :]):
        same = np.flatnonzero(bucket == b)
        one, two = kinds[same][:, None], kinds[same][None]
        agree = ((one == two) | (one == ord(UNREACHED)) | (two == ord(UNREACHED))).all(2)
        for u, v in zip(*np.nonzero(agree & ~np.eye(len(same), dtype=bool))):
            also.setdefault(int(same[u]), []).append(int(same[v]))
    return code, also


def _counts(coded: Coded, rows: slice, columns: slice) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each pair of suffixes that collide how often those of ``rows`` and of ``columns`` do, as a matrix."""
    t, k, q, _ = coded.codes.shape
    kind = np.uint8 if t * k < 256 else np.int32
    alive = coded.alive[..., rows].any(-1)
    for q1 in range(q):
        for q2 in range(q):
            each = None
            every = np.zeros(columns.stop - columns.start, kind)  # what all rows have alike
            for x, z in zip(*np.nonzero(alive[:, :, q1, q2])):
                one, two, also = coded.codes[x, z, q1, rows], coded.codes[x, z, q2, columns], coded.also.get((x, z), {})
                here = one[coded.alive[x, z, q1, q2, rows]]
                alike = bool((one == one[0]).all())
                here = here[:1].tolist() if alike else set(here.tolist())
                if len(here) > MANY:
                    each = np.zeros((len(one), len(two)), kind) if each is None else each
                    each += one[:, None] == two[None, :]
                for c in here:
                    hit = None if len(here) > MANY else two == c
                    for v in also.get(c, ()):
                        hit = two == v if hit is None else hit | (two == v)
                    if hit is None or not hit.any():
                        continue
                    if alike:
                        every += hit
                    else:
                        each = np.zeros((len(one), len(two)), kind) if each is None else each
                        each[one == c] += hit
            if each is not None:
                each += every
                yield q1, q2, each
            elif every.any():
                yield q1, q2, np.repeat(every[None, :], rows.stop - rows.start, 0)


def _tile(ids: np.ndarray, n: np.ndarray, strings: list[str], split: int, params: JoinParams, what: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of ``what`` of the pairs of the first ``split`` strings and the others, or of each two of them if there are no others. Either side is in order of ``n``."""
    itself = split == len(ids)
    first = 0 if itself else split
    coded = Coded(strings, params, split, first)
    lo = 0
    while lo < split:
        hi = min(lo + ROWS, split, lo + int(np.searchsorted(n[lo:split], n[lo], "right")))
        # Of one block the strings from these on: those of these rows meet in both orders.
        begin = lo if itself else first + int(np.searchsorted(n[first:], n[lo] - params.k))
        columns = slice(begin, first + int(np.searchsorted(n[first:], n[lo] + params.k, "right")))
        if columns.start < columns.stop:
            one, two = ids[lo:hi], ids[columns]
            once = one[:, None] < one[None, :]
            most = None
            for q1, q2, each in _counts(coded, slice(lo, hi), columns):
                if itself:
                    each[:, : hi - lo] *= once
                if what == "freq":
                    a, b = np.nonzero(each != 0)
                    i, j = one[a], two[b]
                    x = each[a, b].astype(np.int32) << 16
                    yield np.minimum(i, j), np.maximum(i, j), x | (q1 << 8 | q2 if q1 == q2 else np.where(i > j, q2 << 8 | q1, q1 << 8 | q2).astype(np.int32))
                else:
                    most = each if most is None else np.maximum(most, each)
            if most is not None and what == "number":
                yield (np.array([np.count_nonzero(most > params.count_filter)]),)
            elif most is not None:
                a, b = np.nonzero(most > params.count_filter)
                yield np.minimum(one[a], two[b]), np.maximum(one[a], two[b])
        lo = hi


def _in_tiles(strings: DataFrame, params: JoinParams, what: str) -> DataFrame:
    """``what`` (of ``SCHEMAS``) of all pairs of ``strings`` (``i``, ``s``).

    Strings are cut into blocks in their order, so those of a block begin alike and most of their signatures are equal: these are compared once for
    some rows at a time. Each two blocks meet in a task, by their text; a task holds the signatures of two blocks and the
    counts of ``ROWS`` rows.
    """
    rows = strings.select(F.col("i").cast("long").alias("i"), "s").where("s is not null")
    rows = numbered(rows, "s", name="at").select("i", "s", F.length("s").alias("n"), "at")
    rows = cut(rows, "in-order")
    size = rows.count()
    block = min(MOST, max(LEAST, -(-size // BLOCKS)))
    last = max(0, -(-size // block) - 1)
    dealt = rows.withColumn("b", F.floor(F.col("at") / block).cast("int"))
    one = dealt.select(F.explode(F.sequence("b", F.lit(last))).alias("two"), F.col("b").alias("one"), F.lit(1).alias("d"), "n", "s", "i")
    two = dealt.where("b > 0").select(F.col("b").alias("two"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("one"), F.lit(2).alias("d"), "n", "s", "i")
    tiles = (last + 1) * (last + 2) // 2
    met = one.select("one", "two", "d", "n", "s", "i").unionByName(two).repartition(tiles, "one", "two").sortWithinPartitions("one", "two", "d", "n", "s", "i")
    names = [c.split()[0] for c in SCHEMAS[what].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        total = 0
        for table in _tiles(batches):
            d, n, ids = (table.column(c).to_numpy() for c in ("d", "n", "i"))
            for columns in _tile(ids, n, table.column("s").to_pylist(), int(np.searchsorted(d, 2)), params, what):
                held.append(columns)
                total += len(columns[0])
                if total >= OUT:
                    yield _batch(held, names)
                    held, total = [], 0
        if held:
            yield _batch(held, names)

    return met.mapInArrow(run, SCHEMAS[what])


def _batch(held: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile, of batches in order of their tiles."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        key = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
        ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
        begin = 0
        for end in ends:
            if held and key[begin] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key[begin]
            held.append(b.slice(begin, end - begin))
            begin = end
    if held:
        yield pa.Table.from_batches(held)


def often(strings: DataFrame, params: JoinParams) -> bool:
    """Whether pairs of a sample of the strings, picked by hash, collide so often that blocks are cheaper than joining buckets."""
    sample = [r.s for r in strings.where("s is not null").select("s", F.xxhash64("s", "i").alias("h")).orderBy("h").limit(SAMPLE).collect()]
    n = len(sample)
    if n < 2:
        return OFTEN <= 0
    met = sum(int(each.sum(dtype=np.int64) - np.trace(each, dtype=np.int64)) for _, _, each in _counts(Coded(sample, params), slice(0, n), slice(0, n)))
    return met / (n * (n - 1)) >= OFTEN


def _by_slices(strings: DataFrame, params: JoinParams, last: Callable[[DataFrame], DataFrame] = lambda counts: counts) -> DataFrame:
    return counts_by_slices(cut(buckets(strings, params), "buckets"), params, last)


def pair_counts(strings: DataFrame, params: JoinParams) -> DataFrame:
    """The ``collision_counts`` of all ``strings`` (``i``, ``s``; each ``i`` once): ``i1`` < ``i2``, ``q1``, ``q2``, ``freq``. By blocks where collisions are frequent, else by
    joining buckets."""
    if not often(strings, params):
        return _by_slices(strings, params)
    byte = lambda at: F.shiftright("x", at).bitwiseAND(F.lit(255))
    return _in_tiles(strings, params, "freq").select("i1", "i2", byte(8).alias("q1"), byte(0).alias("q2"), F.shiftright("x", 16).cast("long").alias("freq"))


def pair_set(strings: DataFrame, params: JoinParams) -> DataFrame:
    """The ``candidate_pairs`` of all ``strings`` (``i``, ``s``; each ``i`` once): ``i1`` < ``i2``."""
    if not often(strings, params):
        return _by_slices(strings, params, lambda counts: candidate_pairs(counts, params))
    return _in_tiles(strings, params, "pairs")


def pair_number(strings: DataFrame, params: JoinParams) -> DataFrame:
    """One row, ``n``: how many ``candidate_pairs`` there are."""
    if not often(strings, params):
        return _by_slices(strings, params, lambda counts: candidate_pairs(counts, params)).agg(F.count("*").alias("n"))
    return _in_tiles(strings, params, "number").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
