"""Removal of long repeated passages by compaction of the token de Bruijn graph.

Windows of 35 words are edges, the 34 words that two neighbouring windows share are nodes. Edges that occur once cannot matter
and are dropped by their anchors; the others become units (a run of edges that always occurs as a whole, or one edge where texts part),
nonbranching paths of units are compacted into one by joins, and a repeated span is taken out only after its words were
compared with those at another place where it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from threadloom.llm.arrow_text import apart, beside, each, frugal
from threadloom.plans.scratch import cut, drop, scope

WINDOW = 35
#: Words of the anchors that deal edges into buckets.
ANCHOR = 6
#: Bits of a place that hold the number of edges of a run.
RUN = 16
MASK = (1 << RUN) - 1
#: Words hashed at once; a longer text is done in overlapping pieces.
PIECE = 1 << 17
_POS = np.uint64((1 << 20) - 1)
_Q = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        row = np.full(max(n, 1 << 16), base, np.uint64)
        row[0] = 1
        have = _powers[base] = np.cumprod(row, dtype=np.uint64)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(tokens: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, tokens)), "<u8").reshape(-1, 2)


def _prefix(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_Q, len(h)), out=out[1:])
    return out


def _spans(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words begin..end that is the same wherever they stand."""
    return _mix((prefix[end] - prefix[begin]) * _power(pow(_Q, -1, 1 << 64), len(prefix))[begin])


def compacted(h: np.ndarray, text_of: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Paths of consecutive edges (windows of ``window`` words) that share their anchor.

    The anchor of an edge is the smallest-hashed run of ``anchor`` words in it, the leftmost of equal ones, so equal
    edges have equal anchors at the same offset wherever they occur. Gives for each path: index of its text, anchor
    hash, hash of all its words, first word, number of edges. ``h`` has the words of several texts in a row,
    ``text_of`` the text of each word and ``ends`` the end of each text.
    """
    n, span = len(h), window - anchor + 1
    none = np.empty(0, np.int64)
    if n < window:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    m, power = n - anchor + 1, _power(_Q, anchor)
    gram = np.zeros(m, np.uint64)
    for j in range(anchor):
        gram += h[j : j + m, 0] * power[j]
    gram = _mix(gram)
    low = (gram & ~_POS) | np.arange(m, dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = (low & _POS).astype(np.int64)
    begin = np.arange(n - window + 1)
    valid = begin + window <= ends[text_of[: n - window + 1]]
    begin, at = begin[valid], at[valid]
    if not len(begin):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    new = np.ones(len(begin), bool)
    new[1:] = (at[1:] != at[:-1]) | (begin[1:] != begin[:-1] + 1)
    first = np.flatnonzero(new)
    edges = np.diff(np.append(first, len(begin)))
    p = begin[first]
    content = _spans(_prefix(h[:, 1]), p, p + edges + window - 1)
    return text_of[p], gram[at[first]], _mix(content + edges.astype(np.uint64)), p, edges


def _grouped(texts: Iterator[bytes]) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Texts' words, gathered until there are enough for one numpy pass: text numbers, words, ends."""
    which: list[int] = []
    words: list[bytes] = []
    ends: list[int] = []
    for i, t in enumerate(texts):
        tokens = t.split()
        if len(tokens) > PIECE or words and len(words) + len(tokens) > PIECE:
            if words:
                yield which, words, ends
            which, words, ends = [], [], []
        which.append(i)
        words += tokens
        ends.append(len(words))
    if words:
        yield which, words, ends


def _paths(texts: Iterator[bytes], window: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    for which, words, ends in _grouped(texts):
        for lo in range(0, len(words), PIECE):
            part = words[lo : lo + PIECE + window - 1]
            stop = np.minimum(np.array(ends) - lo, len(part))
            text_of = np.searchsorted(stop, np.arange(len(part)), side="right")
            t, a, c, p, n = compacted(_hashes(part), text_of, stop, window, anchor)
            start = np.concatenate(([0], np.array(ends[:-1], np.int64)))
            yield np.array(which, np.int64)[t], a, c, p + lo - start[t], n


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``r`` (a number of its own for each row), ``row`` and ``z`` (the text as a Zstandard frame; a null stays null)."""
    given = apart(docs, text_col).select(F.monotonically_increasing_id().alias("r"), "row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            null = b.column(2).is_null().to_pylist()
            z = pa.array([None if no else pack.compress(t) for t, no in zip(each(b.column(2)), null)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z], ["r", "row", "z"])

    return cut(given.mapInArrow(frugal(run), beside(given, "z binary", "r", "row")), "texts")


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor()
    for z in column:
        yield unpack.decompress(z.as_py()) if z.is_valid else b""


def _edges(texts: DataFrame, contents: DataFrame, window: int) -> DataFrame:
    """Every edge of the paths of ``contents``, read again at their source coordinates: ``a``, ``w`` (its content), ``r``, ``p`` (its place
    << 1, plus 1 where its path occurs once). An edge of a path that occurs more than once comes with that path's first and last place.
    """
    asks = F.struct("a", F.col("lo.pos").alias("pos"), F.col("hi.r").alias("hi_r"), F.col("hi.pos").alias("hi_pos"), (F.col("n") > 1).alias("twice"))
    asked = contents.groupBy(F.col("lo.r").alias("r")).agg(F.collect_list(asks).alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = []
            for r, text, wanted in zip(b.column(0).to_pylist(), _unpacked(b.column(1)), b.column(2)):
                h = _prefix(_hashes(text.split())[:, 1])
                a, pos, hi_r, hi_pos, twice = (wanted.values.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                n = pos & MASK
                which = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                p = (pos >> RUN)[which] + step
                w = _spans(h, p, p + window).view(np.int64)
                again = twice[which].astype(bool)
                parts.append([a[which], w, np.full(len(p), r), p << 1 | ~again])
                parts.append([a[which][again], w[again], hi_r[which][again], ((hi_pos >> RUN)[which] + step)[again] << 1])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)], ["a", "w", "r", "p"])

    return cut(texts.select("r", "z").join(asked, "r").mapInArrow(frugal(read), "a long, w long, r long, p long"), "edges")


def _nodes(texts: DataFrame, units: DataFrame, window: int) -> DataFrame:
    """``uid``, ``n``, ``u`` and ``v``: the nodes at either end of each unit, read at its first place."""
    asks = F.struct("uid", F.col("lo.p").alias("p"), "n")
    asked = units.groupBy(F.col("lo.r").alias("r"), F.floor(F.col("lo.p") / 4096)).agg(F.collect_list(asks).alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = []
            for text, wanted in zip(_unpacked(b.column(0)), b.column(1)):
                h = _prefix(_hashes(text.split())[:, 1])
                uid, p, n = (wanted.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                parts.append([uid, n, _spans(h, p, p + window - 1).view(np.int64), _spans(h, p + n, p + n + window - 1).view(np.int64)])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["uid", "n", "u", "v"])

    return cut(texts.select("r", "z").join(asked, "r").select("z", "asked").mapInArrow(frugal(read), "uid long, n long, u long, v long"), "nodes")


def compact(units: DataFrame) -> DataFrame:
    """``uid``, ``unitig``, ``off``: the nonbranching path that each unit but the first of its path lies on (named by that first), and
    the number of edges before it. ``units`` has ``uid``, its number of edges ``n`` and its nodes ``u`` and ``v``.

    A node joins two units where exactly one ends and exactly one begins; degrees come from aggregations. Then every
    unit's pointer to the one before it is doubled by a join until it reaches the path's first: rounds grow with
    the logarithm of the longest path, and only units that have not arrived take part in the next one. Paths that
    close to a ring have no first and stay as they are.
    """
    out = units.groupBy("u").agg(F.count("*").alias("deg"), F.min("uid").alias("uid")).where("deg = 1").select(F.col("u").alias("node"), "uid")
    into = units.groupBy("v").agg(F.count("*").alias("deg"), F.min(F.struct("uid", "n")).alias("x")).where("deg = 1").select(F.col("v").alias("node"), F.col("x.uid").alias("before"), F.col("x.n").alias("off"))
    links = cut(out.join(into, "node").where("uid <> before").select("uid", "before", "off"), "unit-links")
    firsts = links.select("uid").withColumnRenamed("uid", "before")
    arrived = [cut(links.join(firsts, "before", "left_anti").select("uid", "before", "off"), "unitigs")]
    left = cut(links.join(firsts, "before", "left_semi").select("uid", "before", "off"), "unit-rest")
    n, last = left.count(), -1
    while n and n != last:
        ahead = left.select("uid", "before", "off", F.lit(False).alias("there"))
        for part in arrived:
            ahead = ahead.unionByName(part.withColumn("there", F.lit(True)))
        ahead = ahead.select(F.col("uid").alias("at"), F.col("before").alias("before2"), F.col("off").alias("off2"), "there")
        jumped = left.join(ahead, F.col("before") == F.col("at")).select("uid", F.col("before2").alias("before"), (F.col("off") + F.col("off2")).alias("off"), "there")
        counted = Observation()
        jumped = cut(jumped.observe(counted, F.count_if(~F.col("there")).alias("left")), "unit-jumps", n)
        arrived.append(jumped.where("there").drop("there"))
        left = jumped.where("not there").drop("there")
        n, last = counted.get["left"], n
    labels = arrived[0]
    for part in arrived[1:]:
        labels = labels.unionByName(part)
    return labels.select("uid", F.col("before").alias("unitig"), "off")


def repeated_blocks(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``r``, ``at``, ``first``, ``units``, ``words``: stretches of repeated windows of each text, each within one nonbranching path and
    with the words of another place where the same path is spelled.

    ``at`` is where the path would begin in the text, ``first`` the stretch's first edge on the path, ``units`` its parts (first edge on
    the path << RUN | number of edges) and ``words`` what the other place says, from ``first`` on, as a Zstandard frame.

    1. Every text's edges are dealt into runs that share an anchor (about one for 15 words), and anchors that
       occur once in the corpus are dropped by an aggregation and a join: their edges cannot occur twice.
    2. A run whose words occur elsewhere is a unit. A run that occurs once in a bucket with other runs is where texts
       part: its edges, and those of the runs beside it, are read again at their source coordinates, and each that occurs more
       than once is a unit by itself.
    3. Units whose common node has no other unit are compacted into paths (``compact``).
    4. The occurrences of units in a text are gathered by path and by the place that they are to be compared with:
       the first place in the corpus where the unit stands, for that one the last. Each different stretch of
       words is read there once and sent to those that ask for it.
    """
    anchor = min(anchor, window)
    if not 0 < window < MASK:
        raise ValueError(f"a window has 1 to {MASK - 1} words")
    spark = texts.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, a, c, p, n in _paths(_unpacked(b.column(1)), window, anchor):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), b.column(0).take(pa.array(text)), pa.array((p << RUN) | n)], ["a", "c", "r", "pos"])

    paths = cut(texts.select("r", "z").mapInArrow(frugal(find), "a long, c long, r long, pos long"), "paths")
    n = paths.count()
    # Written, so that both sides of the join are plain exchanges: then a partition with a hot anchor can be split.
    anchors = cut(paths.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "anchors", n)
    met = cut(paths.join(anchors, "a"), "met", n)
    drop(paths)
    contents = met.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("r", "pos")).alias("lo"), F.max(F.struct("r", "pos")).alias("hi"))
    contents = cut(contents, "contents", n)
    parting = cut(contents.where("n = 1").select("a").distinct(), "parting", n)
    edges = _edges(texts, contents.join(parting, "a", "left_semi"), window)
    again = cut(edges.groupBy("a", "w").agg(F.count("*").alias("n")).where("n > 1").select("a", "w"), "again", n)
    single = cut(edges.join(again, ["a", "w"]), "again-edges")
    drop(edges)
    at = F.struct("r", F.shiftright("p", 1).alias("p"))
    of_edges = single.groupBy("a", "w").agg(F.max(F.col("p") % 2).alias("one"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    of_edges = of_edges.where("one = 1").select(F.lit(0).alias("kind"), "a", "w", F.lit(1).cast("long").alias("n"), "lo", "hi")
    start = lambda c: F.struct(F.col(f"{c}.r").alias("r"), F.shiftright(f"{c}.pos", RUN).alias("p")).alias(c)
    of_runs = contents.where("n > 1").select(F.lit(1).alias("kind"), "a", F.col("c").alias("w"), F.col("lo.pos").bitwiseAND(F.lit(MASK)).alias("n"), start("lo"), start("hi"))
    units = cut(of_runs.unionByName(of_edges).withColumn("uid", F.monotonically_increasing_id()), "units")
    for done in (contents, parting, anchors, again):
        drop(done)
    nodes = _nodes(texts, units, window)
    labels = compact(nodes)
    drop(nodes)
    on_path = units.join(labels, "uid", "left").select(
        "kind", "a", "w", "n", F.coalesce("unitig", "uid").alias("unitig"), F.coalesce("off", F.lit(0)).cast("long").alias("off"), "lo", "hi"
    )
    on_path = cut(on_path, "unit-places")
    runs = met.select("a", F.col("c").alias("w"), "r", F.shiftright("pos", RUN).alias("p")).join(on_path.where("kind = 1"), ["a", "w"])
    ones = single.where("p % 2 = 1").select("a", "w", "r", F.shiftright("p", 1).alias("p")).join(on_path.where("kind = 0"), ["a", "w"])
    first = (F.col("r") == F.col("lo.r")) & (F.col("p") == F.col("lo.p"))
    seen = runs.unionByName(ones, allowMissingColumns=True).select(
        "r", "unitig", (F.col("p") - F.col("off")).alias("at"), F.when(first, F.col("hi")).otherwise(F.col("lo")).alias("ref"), "off", "n"
    )
    blocks = (
        seen.select("r", "unitig", "at", F.col("ref.r").alias("ref"), (F.col("ref.p") - F.col("off")).alias("ref_at"), "off", "n")
        .groupBy("r", "unitig", "at", "ref", "ref_at")
        .agg(F.min("off").alias("first"), F.max(F.col("off") + F.col("n")).alias("end"), F.collect_list(F.shiftleft("off", RUN) + F.col("n")).alias("units"))
        .select("r", "at", "first", "units", "ref", (F.col("ref_at") + F.col("first")).alias("x"), (F.col("ref_at") + F.col("end") + window - 1).alias("y"))
    )
    blocks = cut(blocks, "blocks")
    for done in (met, single, units, on_path, labels):
        drop(done)
    asked = blocks.select("ref", "x", "y").distinct().groupBy(F.col("ref").alias("r"), F.floor(F.col("x") / 4096)).agg(F.collect_list(F.struct("x", "y")).alias("asked"))

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            out = []
            for r, text, wanted in zip(b.column(0).to_pylist(), _unpacked(b.column(1)), b.column(2).to_pylist()):
                words = text.split()
                out += [(r, k["x"], k["y"], pack.compress(b" ".join(words[k["x"] : k["y"]]))) for k in wanted]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["ref", "x", "y", "words"])

    said = cut(texts.select("r", "z").join(asked, "r").select("r", "z", "asked").mapInArrow(frugal(say), "ref long, x long, y long, words binary"), "said")
    return blocks.join(said, ["ref", "x", "y"]).select("r", "at", "first", "units", "words")


def _repeated(words: list[bytes], blocks: list[tuple[int, int, list[int], bytes]], window: int, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    """How many of the blocks, minus those that ended, cover each word: only what spells the same as the place beside it."""
    edge = np.zeros(len(words) + 1, np.int64)
    for at, first, units, packed in blocks:
        there = unpack.decompress(packed).split()
        begin, end = at + first, at + first + len(there)
        same = words[begin:end] == there
        if same and sum(u & MASK for u in units) == len(there) - window + 1:  # all edges from the first to the last
            edge[begin] += 1
            edge[end] -= 1
            continue
        for unit in units:
            off, n = unit >> RUN, unit & MASK
            p, size = at + off, n + window - 1
            if same or words[p : p + size] == there[off - first : off - first + size]:
                edge[p] += 1
                edge[p + size] -= 1
    return np.cumsum(edge[:-1])


def _blocks_of(column: pa.Array) -> list[tuple[int, int, list[int], bytes]]:
    """The blocks of all rows of a column one after the other."""
    flat = column.flatten()
    units = flat.field("units")
    ends, every = units.offsets.to_pylist(), units.flatten().to_pylist()
    start = ends[0]
    each_units = [every[i - start : j - start] for i, j in zip(ends, ends[1:])]
    return list(zip(flat.field("at").to_pylist(), flat.field("first").to_pylist(), each_units, flat.field("words").to_pylist()))


def without_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, as_is: bool = False) -> DataFrame:
    """``row`` (all columns but the text), ``n_words``, ``n_removed`` and ``kept`` of every row.

    ``kept`` is the text without each word that a window of ``window`` words (1 to 65,534) covers whose word sequence starts at
    any other place too, in the same text or another; the words left are joined by one space. Windows are judged
    on the input. A null text has no words and keeps ``''``; texts shorter than the window lose nothing; repeated
    rows are copies of each other like any two texts, and of ties none is kept. Texts of any length are done whole (memory follows the
    longest). An empty table gives an empty result. Other columns of any name travel in ``row``. With
    ``as_is`` a text that loses nothing keeps its white space, and a null stays null.
    """
    with scope() as kept_frames:
        out = _without_repeats(_texts(docs, text_col), window, as_is)
        kept_frames.append(out)
    return out


def _without_repeats(texts: DataFrame, window: int, as_is: bool) -> DataFrame:
    """The result of ``without_repeats``, written, so that all that led to it can go."""
    blocks = repeated_blocks(texts, window).groupBy("r").agg(F.collect_list(F.struct("at", "first", "units", "words")).alias("blocks"))
    joined = texts.join(blocks, "r", "left").select("row", "z", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            total, gone, kept = [], [], []
            blocks, sizes, at = _blocks_of(b.column(2)), pc.list_value_length(b.column(2)).to_pylist(), 0
            for z, n in zip(b.column(1), sizes):
                text = unpack.decompress(z.as_py()) if z.is_valid else None
                words = text.split() if text else []
                total.append(len(words))
                if n:
                    left = _repeated(words, blocks[at : at + n], window, unpack) == 0
                    words = list(compress(words, left.tolist()))
                    at += n
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words) if gone[-1] or not as_is else text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "kept"]
            )

    return cut(joined.mapInArrow(frugal(run), beside(texts, "n_words long, n_removed long, kept string", "row")), "unrepeated")
