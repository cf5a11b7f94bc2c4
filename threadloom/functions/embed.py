"""Randomized embedding of strings, of which only sampled positions are kept.

A walk reads a suffix of the string letter by letter while its place in the embedding advances: letter ``c`` at place ``j`` fills
``1 + walks[t][code(c)][j]`` places. Strings at a small edit distance then agree in most places for some random string ``t``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.strings import letter_code
from threadloom.params import UNREACHED, JoinParams

#: Cells (strings times places) of a numpy pass, and strings of one.
_CELLS, _BATCH = 1 << 21, 4096
#: Pairs whose collisions are looked up at once.
_PAIRS = 1 << 15


def _letters(strings: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` characters of each string as code points, and one 0 more, and how many there are."""
    text = np.zeros((len(strings), most + 1), np.uint32)
    length = np.zeros(len(strings), np.int64)
    for row, s in enumerate(strings):
        part = np.frombuffer(s[:most].encode("utf-32-le", "surrogatepass"), "<u4")
        text[row, : len(part)] = part
        length[row] = len(part)
    return text, length


@lru_cache(maxsize=4)
def _codes(letters: str) -> np.ndarray:
    """Code of each code point."""
    code = np.zeros(0x110000, np.uint8)
    code[[ord(c) for c in letters]] = range(len(letters))
    return code


def _walked(text: np.ndarray, length: np.ndarray, params: JoinParams, t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The embedding of each row of ``text`` (of ``_letters``) by its random string and suffix."""
    size, first = params.last_position + 1, params.shift * q
    codes = _codes(params.letters)[text]
    walk = np.array(params.walks)
    begins = np.zeros((len(text), size), np.int64)
    at = np.zeros(len(text), np.int64)
    live = np.arange(len(text))[length > first]
    for i in range(size):
        if not len(live):
            break
        begins[live, at[live]] = 1
        at[live] += 1 + walk[t[live], codes[live, first[live] + i], at[live]]
        live = live[(at[live] < size) & (length[live] > first[live] + i + 1)]
    which = np.maximum(np.cumsum(begins, axis=1) - 1, 0) + first[:, None]
    out = np.take_along_axis(text, np.minimum(which, text.shape[1] - 1), axis=1)
    out[np.arange(size)[None, :] >= at[:, None]] = ord(UNREACHED)
    return out


def embedded(strings: list[str], params: JoinParams, t: int, q: int) -> np.ndarray:
    """Characters at places 0..last_position (as code points; the unreached marker elsewhere), a row for each string."""
    text, length = _letters(strings, params.shift * q + params.last_position + 1)
    return _walked(text, length, params, *(np.full(len(strings), x) for x in (t, q)))


def _sampled(found: np.ndarray, params: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (rows, hash functions, samples) of embeddings and their bucket numbers (rows, hash functions)."""
    sigs = found[:, np.array(params.positions)]
    return sigs, (_codes(params.letters)[sigs] * np.array(params.weights, np.int64)).sum(2) % params.hash_size


def colliding(strings: list[str], a: np.ndarray, b: np.ndarray, params: JoinParams) -> np.ndarray:
    """Whether some suffixes of strings ``a`` and ``b`` (places in ``strings``) collide more than ``count_filter`` times: have the same bucket number, and
    signatures that agree where both are reached. Each string that stands in a pair is embedded once."""
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = at.reshape(2, -1)
    ts, qs = (x.ravel() for x in np.divmod(np.arange(params.num_str * params.num_rep), max(1, params.num_rep)))
    size = params.last_position + 1
    rows = max(1, min(_BATCH, _CELLS // size) // max(1, len(ts)))
    every = []
    for lo in range(0, len(used), rows):
        text, length = _letters([strings[i] for i in used[lo : lo + rows]], params.shift * max(0, params.num_rep - 1) + size)
        n = len(text)
        every.append(_walked(np.tile(text, (len(ts), 1)), np.tile(length, len(ts)), params, np.repeat(ts, n), np.repeat(qs, n)).reshape(len(ts), n, size))
    hit = np.zeros(len(a), bool)
    if not len(ts) or not len(a):
        return hit
    every = np.concatenate(every, 1)
    often = np.zeros((params.num_rep, params.num_rep, len(a)), np.int32)
    for t in range(params.num_str):
        sigs, ids = zip(*(_sampled(every[t * params.num_rep + q], params) for q in range(params.num_rep)))
        left = np.flatnonzero(~hit)
        for lo in range(0, len(left), _PAIRS):
            pairs = left[lo : lo + _PAIRS]
            one, two = at[:, pairs]
            for q1 in range(params.num_rep):
                for q2 in range(params.num_rep):
                    row, h = np.nonzero(ids[q1][one] == ids[q2][two])
                    x, y = sigs[q1][one[row], h], sigs[q2][two[row], h]
                    agree = ((x == y) | (x == ord(UNREACHED)) | (y == ord(UNREACHED))).all(1)
                    often[q1, q2, pairs] += np.bincount(row[agree], minlength=len(pairs)).astype(np.int32)
            hit[pairs] = (often[:, :, pairs] > params.count_filter).any((0, 1))
    return hit


def embed(strings: DataFrame, params: JoinParams, id_col: str = "i", text_col: str = "s", keep: Sequence[str] = ()) -> DataFrame:
    """``i``, ``n``, ``t``, ``q``, ``sigs``, ``hashes``: for each string, random string and suffix the sampled characters
    and the bucket number of every hash function. ``n`` is the length. Null strings are left out. A column ``g`` stays,
    and so do those of ``keep``.

    One Arrow pass: numpy advances all strings of a batch together, and only the characters that the walk can reach are
    looked at.
    """
    group = ["g"] if "g" in strings.columns else []
    text = F.col(text_col).alias("_tl_s")
    given = strings.select(F.col(id_col).cast("long").alias("i"), text, *(F.col(c).cast("long") for c in group), *keep).where("_tl_s is not null")
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in given.schema[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = max(1, min(_BATCH, _CELLS // (params.last_position + 1)))
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                texts = part.column(1).to_pylist()
                n = pa.array([len(x) for x in texts], pa.int32())
                for t in range(params.num_str):
                    for q in range(params.num_rep):
                        found, ids = _sampled(embedded(texts, params, t, q), params)
                        sigs = pa.array(np.ascontiguousarray(found.astype("<u4")).view(f"<U{params.num_bits}").ravel().tolist(), pa.string())
                        ends = pa.array(np.arange(0, ids.size + 1, params.num_hash), pa.int32())
                        same = [pa.array(np.full(len(texts), v), pa.int32()) for v in (t, q)]
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0), n, *same, pa.ListArray.from_arrays(ends, sigs), pa.ListArray.from_arrays(ends, pa.array(ids.ravel())), *part.columns[2:]],
                            ["i", "n", "t", "q", "sigs", "hashes", *group, *keep],
                        )

    return given.mapInArrow(run, "i long, n int, t int, q int, sigs array<string>, hashes array<long>" + more)


def embedded_column(s: Column, params: JoinParams, t: int, q: int) -> Column:
    """The embedding as a column expression: the same result without Python, for small inputs and as a cross-check."""
    size = params.last_position + 1
    walk = F.array(*(F.array(*(F.lit(x) for x in row)) for row in params.walks[t]))
    suffix = F.substring(s, params.shift * q + 1, size)
    start = F.struct(F.lit(0).alias("j"), F.lit("").alias("e"))

    def step(state: Column, c: Column) -> Column:
        more = F.element_at(F.element_at(walk, letter_code(c, params.alphabet) + 1), state["j"] + 1) + 1
        moved = F.struct((state["j"] + more).alias("j"), F.concat(state["e"], F.repeat(c, more)).alias("e"))
        return F.when(state["j"] < size, moved).otherwise(state)

    chars = F.filter(F.split(suffix, ""), lambda c: c != "")
    return F.rpad(F.substring(F.aggregate(chars, start, step, lambda x: x["e"]), 1, size), size, UNREACHED)
