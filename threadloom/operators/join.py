"""Similarity joins under an edit-distance threshold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.lanes import CELLS, diagonal_distances
from threadloom.functions.strings import as_bytes, edit_distance, once
from threadloom.params import JoinParams
from threadloom.plans.counting import often, pair_number
from threadloom.plans.lsh import bucket_sizes, buckets, candidate_pairs, collision_counts, collisions, collisions_of, counts_by_slices
from threadloom.plans.scratch import cut
from threadloom.plans.segments import COMPARE, by_kind, by_tile, candidates_by, near_rows, price


@dataclass
class JoinResult:
    """``links``: ``i1`` < ``i2`` and ``dist`` between representatives of different strings; ``members``: ``id`` and ``i``,
    the representative of its string (the smallest id). ``n_candidates`` pairs were verified."""

    links: DataFrame
    members: DataFrame
    candidates: DataFrame
    copies: bool = True

    def pairs(self) -> DataFrame:
        """All pairs ``id1`` < ``id2`` with ``dist``, copies included: as many as there are, so quadratic in the copies. Only strings that have copies
        are joined with their rows."""
        several = self.members.groupBy("i").agg(F.count("*").alias("n")).where("n > 1").select("i")
        copied = cut(self.members.join(several, "i"), "copied")
        one, two = (copied.select(F.col("id").alias(x), F.col("i").alias(i)) for x, i in (("x", "i1"), ("y", "i2")))
        met = self.links.join(one, "i1", "left").join(two, "i2", "left").withColumns({"x": F.coalesce("x", "i1"), "y": F.coalesce("y", "i2")})
        out = met.select(F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"), "dist")
        if self.copies:
            same = one.join(two, F.col("i1") == F.col("i2")).where("x < y").select(F.col("x").alias("id1"), F.col("y").alias("id2"), F.lit(0).alias("dist"))
            out = out.unionByName(same)
        return out

    def around(self, weights: DataFrame) -> DataFrame:
        """``i``, ``n_others``, ``m``, ``nearest``, ``sum_dist`` of each string with links, from ``weights`` (``i`` and a number): how many strings
        it links to, their weights and distances."""
        both = self.links.select("i1", "i2", "dist").unionByName(self.links.select(F.col("i2").alias("i1"), F.col("i1").alias("i2"), "dist"))
        met = both.join(weights.toDF("i2", "w"), "i2").groupBy(F.col("i1").alias("i"))
        return met.agg(F.count("*").alias("n_others"), F.sum("w").cast("long").alias("m"), F.min("dist").alias("nearest"), F.sum("dist").cast("long").alias("sum_dist"))

    def connecting(self, core: DataFrame) -> DataFrame:
        """``i1``, ``i2``: links that connect the same strings of ``core`` (``i``) as all links do, and all links of other strings."""
        return self.links.select("i1", "i2")

    def near(self) -> DataFrame:
        """``id``, ``i``, ``n_links`` of every row, without expanding copies, and ``n_others``, ``nearest``, ``sum_dist`` of its string's links to different strings."""
        sizes = self.members.groupBy("i").agg(F.count("*").alias("n"))
        links = F.coalesce("m", F.lit(0)) + (F.col("n") - 1 if self.copies else F.lit(0))
        others = F.coalesce("n_others", F.lit(0)).cast("long").alias("n_others")
        per = sizes.join(self.around(sizes), "i", "left").select("i", links.cast("long").alias("n_links"), others, "nearest", "sum_dist")
        return self.members.join(per, "i").select("id", "i", "n_links", "n_others", "nearest", "sum_dist")

    def degrees(self) -> DataFrame:
        """``id``, ``i`` and ``n_links`` of every row, without expanding copies."""
        return self.near().select("id", "i", "n_links")

    def funnel(self) -> DataFrame:
        """One row: candidate pairs verified and links found, both between different strings."""
        each = self.candidates.select(F.lit(1).alias("c"), F.lit(0).alias("l")).unionByName(self.links.select(F.lit(0).alias("c"), F.lit(1).alias("l")))
        return each.agg(F.count_if(F.col("c") == 1).alias("n_candidates"), F.count_if(F.col("l") == 1).alias("n_links"))


def _classes(strings: DataFrame, id_col: str, text_col: str, byte_mode: bool, group_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct strings of each group (``i``, ``s`` and, with groups, ``g``) and members (``id``, ``i``). Null strings and null ids take no part."""
    s = F.col(text_col).cast("string")
    group = [] if group_col is None else [F.col(group_col).cast("long").alias("g")]
    keys = ["s", *["g"] * len(group)]
    rows = strings.select(F.col(id_col).cast("long").alias("id"), (as_bytes(s) if byte_mode else s).alias("s"), *group).where("id is not null and s is not null")
    distinct = cut(rows.groupBy(*keys).agg(F.min("id").alias("i")).select("i", *keys), "strings")
    return distinct, rows.join(distinct, keys).select("id", "i")


#: Threshold from which pairs are verified by ``diagonal_distances``, and letters that a task of it reads.
LONG_K, TASK_LETTERS = 16, 1 << 20


def verify(candidates: DataFrame, strings: DataFrame, k: int, others: DataFrame | None = None) -> DataFrame:
    """``i1``, ``i2``, ``dist`` of the candidates within ``k`` edits. Each string is fetched by an equi-join, the second of a pair from
    ``others``, if there are any."""
    one, two = (x.select(F.col("i").alias(f"i{d}"), F.col("s").alias(f"s{d}")) for d, x in ((1, strings), (2, strings if others is None else others)))
    met = candidates.join(one, "i1").join(two, "i2")
    if k < LONG_K:
        return met.select("i1", "i2", once(edit_distance(F.col("s1"), F.col("s2"), k)).alias("dist")).where("dist >= 0")
    # Few rows can be much work: they are spread by the letters that comparing them reads, not by their bytes.
    letters = candidates.count() * (strings.agg(F.avg(F.length("s"))).first()[0] or 0)
    return long_distances(met.repartition(int(min(100_000, 1 + letters / TASK_LETTERS))), k)


def long_distances(met: DataFrame, k: int) -> DataFrame:
    """``i1``, ``i2``, ``dist`` of the rows whose ``s1`` and ``s2`` are within ``k`` edits, by ``diagonal_distances``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letters = np.concatenate([[0], np.cumsum(pc.utf8_length(b.column(2)).to_numpy())])
            lo = 0
            while lo < b.num_rows:  # the strings of some pairs only are Python's at once
                hi = max(lo + 1, int(np.searchsorted(letters, letters[lo] + 4 * CELLS, "right")) - 1)
                part = b.slice(lo, hi - lo)
                dist = diagonal_distances(part.column(2).to_pylist(), part.column(3).to_pylist(), k)
                near = pa.array(np.flatnonzero(dist >= 0))
                yield pa.RecordBatch.from_arrays([part.column(0).take(near), part.column(1).take(near), pa.array(dist).take(near)], ["i1", "i2", "dist"])
                lo = hi

    return met.select("i1", "i2", "s1", "s2").mapInArrow(run, "i1 long, i2 long, dist int")


#: Row pairs of a bucket table, for each of its rows, up to which the join goes through the buckets without more ado.
MOST_FAN = 50


def _plan(sizes: DataFrame, distinct: DataFrame, k: int) -> str:
    """``segments`` where the buckets' pairs are more than ``MOST_FAN`` a row and more than the rows that the cheapest exact plan makes."""
    sums = sizes.agg(F.sum("size").alias("n"), F.sum("pairs").alias("pairs")).first()
    if (sums.pairs or 0) <= MOST_FAN * (sums.n or 0):
        return "buckets"
    return "segments" if sums.pairs > distinct.count() * price(distinct, k)[1] else "buckets"


def edit_join_lsh(
    strings: DataFrame, params: JoinParams, id_col: str = "id", text_col: str = "s", byte_mode: bool = True, plan: str = "auto", group_col: str | None = None
) -> JoinResult:
    """Pairs within ``params.k`` edits, found by hashing embeddings: every pair is verified, few are missed.

    Whether two strings collide follows from their content alone, so equal strings are joined once, as one. The same
    pairs come out of either plan. ``buckets`` enumerates the pairs of each bucket and verifies those that collide
    often enough. ``segments`` starts from the pairs that share a segment, verifies them, and keeps those that
    collide; a bucket that holds a large part of all rows costs it nothing. ``auto`` sums up the buckets' pairs
    first and takes ``segments`` where they exceed both ``MOST_FAN`` a row and what ``segments`` has to look at. With
    ``group_col`` (an integer) only strings of one group meet: it is part of every join key.
    """
    distinct, members = _classes(strings, id_col, text_col, byte_mode, group_col)
    table = None if plan == "segments" else cut(buckets(distinct, params), "buckets")
    # Copies agree under every hash function unless no suffix is embedded at all.
    copies = params.num_rep > 0 and params.num_str * params.num_hash > params.count_filter
    if plan == "auto":
        plan = _plan(bucket_sizes(table).withColumn("pairs", F.col("size").cast("double") * (F.col("size") - 1) / 2), distinct, params.k)
    if plan == "segments":
        candidates = cut(candidates_by(near_rows(distinct), params.k, params=params), "candidates")
        if "hit" in candidates.columns:
            return JoinResult(candidates.where("hit").select("i1", "i2", "dist"), members, candidates, copies)
        near = verified(candidates, distinct, params.k, "near")
        table = cut(buckets(distinct, params), "buckets") if table is None else table
        hits = candidate_pairs(collision_counts(collisions_of(near, table)), params)
        return JoinResult(cut(near.join(hits, ["i1", "i2"], "left_semi"), "links"), members, candidates, copies)
    candidates = counts_by_slices(table, params, lambda counts: candidate_pairs(counts, params))
    return JoinResult(cut(verify(candidates, distinct, params.k), "links"), members, candidates, copies)


def lsh_funnel(strings: DataFrame, params: JoinParams, id_col: str = "id", text_col: str = "s", byte_mode: bool = True) -> DataFrame:
    """The ``funnel`` of ``edit_join_lsh`` by ``buckets``: candidates are counted where they collide, and links come from the cheapest plan."""
    distinct, _ = _classes(strings, id_col, text_col, byte_mode)
    links = edit_join_lsh(distinct, params, "i", "s", byte_mode=False, plan="segments" if often(distinct, params) else "auto").links
    return pair_number(distinct, params).select(F.col("n").alias("n_candidates")).crossJoin(links.agg(F.count("*").alias("n_links")))


class ExactJoin(JoinResult):
    """The join of ``strings`` (distinct: ``i``, ``s`` and, with groups, ``g``) with themselves. Links are found when they are asked for; what can be said of a
    string without them (``around``, ``connecting``) is added up where strings are compared, if the plan compares blocks, and then no link is written."""

    def __init__(self, strings: DataFrame, members: DataFrame, k: int):
        self.strings, self.members, self.k, self.copies = strings, members, k, True

    @cached_property
    def plan(self) -> str:
        return price(near_rows(self.strings), self.k)[0]

    @cached_property
    def candidates(self) -> DataFrame:
        return cut(candidates_by(near_rows(self.strings), self.k, self.plan), "candidates")

    @cached_property
    def links(self) -> DataFrame:
        return verified(self.candidates, self.strings, self.k, "links")

    def _compared(self, values: DataFrame, what: str) -> DataFrame:
        rows = near_rows(self.strings.join(values.withColumnsRenamed({values.columns[1]: "v"}), "i"), value_col="v")
        return {"by_tile": by_tile, "by_kind": by_kind}[self.plan](rows, self.k, what)

    def around(self, weights: DataFrame) -> DataFrame:
        if self.plan not in COMPARE:
            return super().around(weights)
        found = self._compared(weights, "sums").groupBy("i")
        return cut(found.agg(*(F.sum(c).cast("long").alias(c) for c in ("n_others", "m")), F.min("nearest").alias("nearest"), F.sum("sum_dist").cast("long").alias("sum_dist")), "around")

    def connecting(self, core: DataFrame) -> DataFrame:
        if self.plan not in COMPARE:
            return super().connecting(core)
        marked = self.strings.select("i").join(core.select("i", F.lit(1).alias("c")), "i", "left").select("i", F.coalesce("c", F.lit(0)).alias("c"))
        return cut(self._compared(marked, "forest").distinct(), "connecting")


def verified(candidates: DataFrame, strings: DataFrame, k: int, name: str, others: DataFrame | None = None) -> DataFrame:
    """``verify``, written, unless the candidates are pairs within ``k`` edits and have their ``dist`` already."""
    return candidates if "dist" in candidates.columns else cut(verify(candidates, strings, k, others), name)


def edit_join_exact(strings: DataFrame, k: int, id_col: str = "id", text_col: str = "s", byte_mode: bool = True, group_col: str | None = None) -> JoinResult:
    """All pairs within ``k`` edits; with ``group_col`` (an integer) all that lie in one group."""
    return ExactJoin(*_classes(strings, id_col, text_col, byte_mode, group_col), k)


@dataclass
class Side:
    """One of two tables to join: distinct strings (``i``, ``s``), members (``id``, ``i``) and, for a hash join, its bucket table."""

    strings: DataFrame
    members: DataFrame
    table: DataFrame | None = None

    @staticmethod
    def of(rows: DataFrame, id_col: str = "id", text_col: str = "s", byte_mode: bool = True, params: JoinParams | None = None) -> Side:
        strings, members = _classes(rows, id_col, text_col, byte_mode)
        return Side(strings, cut(members, "members"), None if params is None else cut(buckets(strings, params), "buckets"))


def segments_between(left: Side, right: Side, k: int, params: JoinParams | None = None) -> DataFrame:
    """Distinct ``i1`` (left), ``i2`` (right) that contain every pair within ``k`` edits, with their ``dist`` and ``hit`` where the plan gives them. Representatives lie within 62 bits."""
    sides = [s.strings.select((F.shiftleft("i", 1) + d).alias("i"), "s", F.lit(d).alias("side")) for d, s in enumerate((left, right))]
    met = candidates_by(near_rows(sides[0].unionByName(sides[1])), k, params=params)
    turned = F.col("i1") % 2 != 0
    one, two = F.when(turned, F.col("i2")).otherwise(F.col("i1")), F.when(turned, F.col("i1")).otherwise(F.col("i2"))
    return met.select(F.shiftright(one, 1).alias("i1"), F.shiftright(two, 1).alias("i2"), *(c for c in ("dist", "hit") if c in met.columns))


def links_between(left: Side, right: Side, k: int, params: JoinParams | None = None, plan: str = "auto") -> DataFrame:
    """``i1`` (left), ``i2`` (right), ``dist`` of the different strings within ``k`` edits, equal ones included: all, or with ``params`` those
    that the hash join finds, by the same two plans as within one table."""
    if params is not None and plan == "auto":
        one, two = (bucket_sizes(s.table).withColumnRenamed("size", f"size{d}") for d, s in ((1, left), (2, right)))
        sizes = one.join(two, ["t", "k", "hash_id"]).select((F.col("size1") + F.col("size2")).alias("size"), (F.col("size1").cast("double") * F.col("size2")).alias("pairs"))
        plan = _plan(sizes, left.strings.unionByName(right.strings), k)
    if params is None or plan == "segments":
        near = verified(cut(segments_between(left, right, k, params), "candidates"), left.strings, k, "near", right.strings)
        if params is None:
            return near
        if "hit" in near.columns:
            return near.where("hit").select("i1", "i2", "dist")
        hits = candidate_pairs(collision_counts(collisions_of(near, left.table, right.table)), params)
        return cut(near.join(hits, ["i1", "i2"], "left_semi"), "links")
    candidates = cut(candidate_pairs(collision_counts(collisions(left.table, params, right.table)), params), "candidates")
    return cut(verify(candidates, left.strings, k, right.strings), "links")


def pairs_between(left: Side, right: Side, links: DataFrame) -> DataFrame:
    """``id1``, ``id2``, ``dist`` of every pair of rows, copies included."""
    one, two = left.members.select(F.col("id").alias("id1"), F.col("i").alias("i1")), right.members.select(F.col("id").alias("id2"), F.col("i").alias("i2"))
    return links.join(one, "i1").join(two, "i2").select("id1", "id2", "dist")


def edit_join_tables(left: DataFrame, right: DataFrame, k: int, id_col: str = "id", text_col: str = "s", byte_mode: bool = True, params: JoinParams | None = None) -> DataFrame:
    """``id1`` (left), ``id2`` (right), ``dist``: all pairs of rows of two tables within ``k`` edits, or with ``params`` (whose ``k`` holds then) those
    that the hash join finds. Rows of the same table never meet. Null strings and ids take no part."""
    k = k if params is None else params.k
    one, two = Side.of(left, id_col, text_col, byte_mode, params), Side.of(right, id_col, text_col, byte_mode, params)
    return pairs_between(one, two, links_between(one, two, k, params))
