"""Source divergence audit: how far the term shares of the sources of a language lie apart, by dense tiles of terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.arrow_text import each, frugal, quoted
from threadloom.plans.numbering import numbered
from threadloom.plans.scratch import cut

#: Letters A to Z and every character beyond ASCII, as bytes; texts are lower-cased (A to Z only) before.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Documents of a language that a term must stand in, and the ranks of its excess terms that a source gets.
LEAST, TOP = 30, 50
#: Terms and groups of a tile's side, and cells that one numpy pass holds.
TERMS, GROUPS, CELLS = 512, 256, 1 << 21
#: Counters of a task that are sent on together.
COUNTERS = 300_000
SCALE_STEPS = 3  # a share is in units of 1 / 1000 ** SCALE_STEPS


def share(count: np.ndarray, size: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10**9 (count + 5) / (size + 5 terms)), exact in 64 bits by long division."""
    whole = np.asarray(size, np.int64) + 5 * terms
    if (whole > (1 << 63) // 1000 - 1).any():
        raise OverflowError("a group has more than 9 * 10**15 terms")
    out, rest = np.divmod(np.asarray(count, np.int64) + 5, whole)
    for _ in range(SCALE_STEPS):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` (documents that have it) of every term of every whole text. A task adds up
    what it meets before anything is shuffled."""
    name = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    given = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), F.col(quoted(text_col)).cast("string").alias("text"))
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_) in found.items():
                terms = list(n)
                columns = [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([in_[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(terms), pa.string()) for x in (lang, source)] + columns, names)
            found.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), each(b.column(2))):
                n, in_ = found.get((lang, source)) or found.setdefault((lang, source), (Counter(), Counter()))
                words = TERM.findall(text.lower())
                n.update(words)
                in_.update(set(words))
            if sum(len(n) for n, _ in found.values()) > COUNTERS:
                yield from sent()
        yield from sent()

    partial = given.mapInArrow(frugal(run), "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of every row of ``one`` and every row of ``two``, all pairs of a few rows at once."""
    out = np.zeros((len(one), len(two)), np.int64)
    step = max(1, CELLS // max(1, two.size))
    for i in range(0, len(one), step):
        out[i : i + step] = np.abs(one[i : i + step, None, :] - two[None, :, :]).sum(2)
    return out


def tile(head: pa.Table, cells: pa.Table, first: int, width: int, split: int | None, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Partial pairs (gid, other gid, sum) and largest excesses (gid, tid, value) of a tile.

    ``head`` has a row for each group (``gid``, ``n`` its size, ``total`` the language's size, ``v``), ``cells`` one for each count that is not 0
    (``gid``, ``tid``, ``n``, ``total`` the term's count in the language); the terms are those from ``first`` on, ``width`` of them. Groups below
    ``split`` are compared with the others; without it all are, and their excesses taken.
    """
    column = lambda t, c: t.column(c).to_numpy()
    order = np.argsort(column(head, "gid"))
    gid, size = column(head, "gid")[order], column(head, "n")[order]
    v, whole = int(column(head, "v")[0]), int(column(head, "total")[0])
    at = (np.searchsorted(gid, column(cells, "gid")), column(cells, "tid") - first)
    count, total = np.zeros((len(gid), width), np.int64), np.zeros(width, np.int64)
    count[at] = column(cells, "n")
    total[at[1]] = column(cells, "total")
    p = share(count, size[:, None], v) if width else count
    if split is not None:
        x, y = np.flatnonzero(gid < split), np.flatnonzero(gid >= split)
        sums = _apart(p[x], p[y])
        a, b = np.repeat(x, len(y)), np.tile(y, len(x))
        return np.stack([gid[a], gid[b], sums.reshape(-1)], 1), np.empty((0, 3), np.int64)
    a, b = np.triu_indices(len(gid), 1)
    pairs = np.stack([gid[a], gid[b], _apart(p, p)[a, b]], 1)
    if not width:
        return pairs, np.empty((0, 3), np.int64)
    more = np.where(count > 0, p - share(total, whole, v), 0)
    best = np.argsort(-more, axis=1, kind="stable")[:, :top]  # terms are in order, so ties keep it
    value = np.take_along_axis(more, best, 1)
    g, k = np.nonzero(value > 0)
    return pairs, np.stack([gid[g], best[g, k] + first, value[g, k]], 1)


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP, sides: tuple[int, int] = (TERMS, GROUPS)
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: part ``pair`` has the distance of a source to each other one of its language, part ``term``
    the ``top`` terms whose share in it exceeds that of the language the most.

    Terms are those in at least ``least`` documents of their language. Texts are counted where they are; only counts by language, source and
    term travel. Kept terms and groups get consecutive numbers in their own order, so a tile (``sides``: the counts of so many terms in up to twice so
    many groups) is of bounded size whatever group or language is hot: all its pairs of groups are compared at once, zeros included. The partial
    sums of tiles are added up by pair; the best terms of each group in each tile are merged by rank, as many as are
    kept of every tile at most. A group that lies in several group blocks' tiles travels to each of them, so cells are sent once for
    every ``sides[1]`` sources of the language.

    A null text, language or source is empty; a group without terms (or all of whose terms are rare) is compared by the shares that
    its empty counts give, and a language without kept terms has pairs of value 0 and no terms. A text of any length is counted whole; repeated
    rows count again. Ties go by the item's UTF-8 bytes. A group alone in its language has no pairs. An empty table has no rows, and
    other columns, of any name, play no part.
    """
    n_terms, n_groups = sides
    name = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    groups = cut(numbered(docs.groupBy(name(lang_col).alias("lang"), name(source_col).alias("source")).agg(F.count("*").alias("n_docs")), "lang", "source", name="gid"), "groups")
    counts = cut(count_terms(docs, lang_col, source_col, text_col), "counts")
    frequent = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    terms = cut(numbered(frequent.select("lang", "term", "total"), "lang", "term", name="tid"), "terms")
    spans = groups.groupBy("lang").agg(F.min("gid").alias("g0"), F.max("gid").alias("g1"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("whole"), F.min("tid").alias("t0"))
    langs = spans.join(kept, "lang", "left").na.fill(0, ["v", "whole", "t0"])
    wide = groups.select("lang", "source", "gid").join(langs, "lang")
    cells = cut(counts.join(terms, ["lang", "term"]).join(wide, ["lang", "source"]).select("g0", "g1", "gid", "tid", "n", "total"), "cells")
    heads = wide.join(cells.groupBy("gid").agg(F.sum("n").alias("n")), "gid", "left").na.fill(0, ["n"])
    block = lambda c: F.floor(F.col(c) / n_terms).cast("long")
    last = F.floor((F.col("t0") + F.col("v") - 1) / n_terms).cast("long")
    blocks = F.when(F.col("v") > 0, F.sequence(block("t0"), last)).otherwise(F.array(F.lit(-1).cast("long")))
    heads = heads.select("g0", "g1", "gid", F.lit(None).cast("long").alias("tid"), "n", F.col("whole").alias("total"), "v", "t0", F.explode(blocks).alias("block"))
    none = F.lit(None).cast("long")
    rows = heads.unionByName(cells.select("*", none.alias("v"), none.alias("t0"), block("tid").alias("block")))
    side = lambda c: F.floor(F.col(c) / n_groups).cast("long")
    rows = rows.withColumn("other", F.explode(F.sequence(side("g0"), side("g1")))).withColumn("own", side("gid"))
    rows = rows.select("g0", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "block", "gid", "tid", "n", "total", "v", "t0")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, i, j, block = (k.as_py() for k in key)
        is_head = pc.is_null(table.column("tid"))
        head, cells = table.filter(is_head), table.filter(pc.invert(is_head))
        v, t0 = (head.column(c)[0].as_py() for c in ("v", "t0"))
        first = max(t0, block * n_terms)
        found = tile(head, cells, first, min(t0 + v, (block + 1) * n_terms) - first if v else 0, None if i == j else j * n_groups, top)
        part = np.repeat([0, 1], [len(x) for x in found]).astype(np.int32)
        both = np.concatenate(found)
        return pa.table([pa.array(part), *(pa.array(np.ascontiguousarray(both[:, c])) for c in range(3))], ["part", "gid", "other", "value"])

    tiles = cut(rows.groupBy("g0", "i", "j", "block").applyInArrow(compare, "part int, gid long, other long, value long"), "tiles")
    sums = tiles.where("part = 0").groupBy("gid", "other").agg(F.sum("value").alias("value"))
    pairs = sums.unionByName(sums.select(F.col("other").alias("gid"), F.col("gid").alias("other"), "value"))
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "other")).alias("rank")
    own = groups.select("gid", "lang", "source")
    pairs = pairs.select("gid", "other", "value", rank).join(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")
    best = tiles.where("part = 1").select("gid", "other", "value", rank).where(F.col("rank") <= top)
    best = best.join(terms.select(F.col("tid").alias("other"), F.col("term").alias("item")), "other")
    out = pairs.select("gid", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(best.select("gid", F.lit("term").alias("part"), "item", "value", "rank"))
    return out.join(own, "gid").select("lang", "source", "part", "item", "value", "rank")
