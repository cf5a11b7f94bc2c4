"""Exact candidates for an edit threshold: by equal segments, by counts of common grams, by tiles of short strings, or by kinds."""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.embed import colliding
from threadloom.functions.lanes import WORD, Sliced, diagonal_distances, sliced_distances
from threadloom.params import JoinParams
from threadloom.plans.numbering import numbered
from threadloom.plans.scratch import cut

_Q = 0x9E3779B97F4A7C15 | 1
_QINV = pow(_Q, -1, 1 << 64)
#: Characters that one numpy pass hashes.
_CELLS = 1 << 20


def probes_by_length(k: int) -> int:
    """Places that ``by_length`` looks at for a long string."""
    parts, total = k + 1, 0
    for more in range(k + 1):
        for seg in range(1, parts + 1):
            left, right = seg - 1, parts - seg
            total += max(0, min(left, more + right) - max(-left, more - right) + 1)
    return total


#: Strings that a price is found from, and what comparing a candidate and a cell of a pair's table cost, in rows of a join.
SAMPLE, VERIFY, IN_CELL = 96, 4.0, 1e-4
#: Common grams that a pair needs among its rarest, and lengths of grams that are tried.
COMMON, GRAMS = 3, range(2, 9)
#: Strings on either side of a tile, and of the part of it that is compared at once.
TILE, PART = 4096, 2048
#: What the kind of a string leaves out of it, rows of a kind and of those near it that a task compares, and what a pair of them costs.
VARYING, KIND_TILE, NEAR_TILE, IN_KIND = "0123456789", 4096, 16_384, 0.008
#: What a block for each length or kind of a further group costs, in rows of a join.
IN_CALL = 1000


def _segment_matches(strings: list[str], k: int) -> tuple[float, float]:
    """Equal segments nearby that a pair has on average, and the share of pairs that has one."""
    met = pairs = found = 0
    at: dict[tuple[int, int], dict[str, list[int]]] = {}
    for j, y in enumerate(strings):
        q = len(y) // (k + 1)
        for i, x in enumerate(strings):
            if i == j:
                continue
            pairs += 1
            if not 0 <= len(x) - len(y) <= k:
                continue
            if q == 0:
                met, found = met + 1, found + 1
                continue
            if (i, q) not in at:
                places = at[i, q] = {}
                for p in range(len(x) - q + 1):
                    places.setdefault(x[p : p + q], []).append(p)
            n = sum(abs(p - g * q) <= k for g in range(k + 1) for p in at[i, q].get(y[g * q : g * q + q], ()))
            met, found = met + n, found + (n > 0)
    return met / max(1, pairs), found / max(1, pairs)


def _count_matches(strings: list[str], k: int, q: int) -> tuple[float, float]:
    """The same of rare common grams of ``q`` characters, and the share of pairs that has enough of them."""
    grams = [[s[p : p + q] for p in range(len(s) - q + 1)] for s in strings]
    often: dict[str, int] = {}
    for g in (g for row in grams for g in row):
        often[g] = often.get(g, 0) + 1
    rare: list[dict[str, list[int]]] = []
    for row in grams:
        order = sorted(range(len(row)), key=lambda p: (often[row[p]], row[p]))
        last = order[min(len(order), k * q + COMMON) - 1] if order else None
        rare.append({})
        for p in order:
            if (often[row[p]], row[p]) <= (often[row[last]], row[last]):
                rare[-1].setdefault(row[p], []).append(p)
    met = pairs = found = 0
    for j, y in enumerate(rare):
        for i in range(j):
            pairs += 1
            need = min(COMMON, max(len(strings[i]), len(strings[j])) - q + 1 - k * q)
            if abs(len(strings[i]) - len(strings[j])) > k:
                continue
            hits = [(g, p, o) for g in y.keys() & rare[i].keys() for p in y[g] for o in rare[i][g] if abs(p - o) <= k]
            met += len(hits)
            found += need <= 0 or len({(g, p) for g, p, _ in hits}) >= need
    return met / max(1, pairs), found / max(1, pairs)


def _kind(s: str) -> F.Column:
    return F.translate(s, VARYING, "")


def _near_kinds(strings: list[str], k: int) -> float:
    """The share of pairs whose kinds are within ``k`` edits."""
    kinds = [s.translate(str.maketrans("", "", VARYING)) for s in strings]
    met = [(x, y) for j, y in enumerate(kinds) for x in kinds[:j]]
    return float((diagonal_distances(*map(list, zip(*met)), k) >= 0).mean()) if met else 0.0


def price(rows: DataFrame, k: int) -> tuple[str, float]:
    """The cheapest plan for a table with a string ``s`` and an id ``i``, and the rows that it makes for each string.

    Segments look at a number of places; beyond that, every plan's cost is the matches that its join gives and the candidates that it
    leaves. Both are counted among all pairs of ``SAMPLE`` strings, picked by hash. Only strings of one group (``g``) meet, so what counts of the
    table's size is that of its groups, and a kind is one of its group: kinds that are to be joined are all different, and never go by kinds again.
    """
    # Of a string's group: its strings (``around``) and kinds. ``more_``: what is there beyond the group that has most of them.
    each = rows.groupBy(F.col("g") if "g" in rows.columns else F.lit(0).alias("g")).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.length("s")).alias("letters"), F.max(F.length("s")).alias("most"),
        F.approx_count_distinct(_kind("s")).cast("double").alias("kinds"), F.approx_count_distinct(F.length("s")).alias("lengths"),
    )
    per = lambda c: F.coalesce(F.sum(c) / F.sum("n"), F.lit(0.0))
    size = each.agg(
        F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), per("letters").alias("mean"), F.max("most").alias("most"), per(F.col("n") * F.col("n")).alias("around"), ((F.sum("lengths") - F.max("lengths")) / F.sum("n")).alias("more_lengths"),
        per("kinds").alias("kinds"), ((F.sum("kinds") - F.max("kinds")) / F.sum("n")).alias("more_kinds"), per(F.col("kinds") * F.col("kinds")).alias("kind_pairs"), per(F.col("n") * F.col("kinds")).alias("kinds_around"),
    ).first()
    sample = [r.s for r in rows.select("s", F.xxhash64("s", "i").alias("h")).orderBy("h").limit(SAMPLE).collect()]
    mean, others = size.mean, size.around / 2
    in_tile = mean * (k + 1) * IN_CELL
    by_segment = sum(w * x for w, x in zip((1, VERIFY), _segment_matches(sample, k))) * others
    at_length, at_place = min(probes_by_length(k), mean * (k + 1)), 2 * mean
    plans = {"by_length": at_length + by_segment}
    if probes_by_length(k) > 64:
        plans["by_place"] = at_place + by_segment
    if by_segment > mean:
        for q in GRAMS:
            if mean - q + 1 - k * q > 0:
                plans[f"by_count:{q}"] = mean + sum(w * x for w, x in zip((1, VERIFY), _count_matches(sample, k, q))) * others
        if size.most <= WORD:
            plans["by_tile"] = 2 * others * in_tile / 2 + 2 * others / TILE + size.more_lengths * (k + 1) * IN_CALL
        if size.kinds <= 0.5:
            near = _near_kinds(sample, k)
            # Joining the kinds, sending a string to the kinds near its own, and comparing it with their strings.
            plans["by_kind"] = size.kind_pairs * in_tile / 2 + near * size.kinds_around + near * 2 * others * (IN_KIND + 1 / KIND_TILE) + size.more_kinds * IN_CALL
    return min(plans.items(), key=lambda x: x[1])


#: Plans that compare all pairs of two blocks, and so give pairs within the threshold and their distances.
COMPARE = ("by_tile", "by_kind")


def near_rows(strings: DataFrame, id_col: str = "i", text_col: str = "s", value_col: str | None = None) -> DataFrame:
    """``i``, ``s``, ``g``, ``x``, ``y``, ``v``: ``x`` is the key of a string that is looked for and ``y`` that of one that looks."""
    group = F.col("g").cast("long") if "g" in strings.columns else F.lit(0).cast("long")
    side = F.col("side").cast("int") if "side" in strings.columns else F.lit(0)
    other = 1 - F.col("side").cast("int") if "side" in strings.columns else F.lit(0)
    value = F.lit(1).cast("long") if value_col is None else F.col(value_col).cast("long")
    rows = strings.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("s"), group.alias("g"), side.alias("x"), other.alias("y"), value.alias("v"))
    return rows.where("s is not null")


def segment_candidates(strings: DataFrame, k: int, id_col: str = "i", text_col: str = "s", plan: str = "auto") -> DataFrame:
    """Distinct pairs ``i1`` < ``i2`` that contain every pair within ``k`` edits.

    Only strings of one group meet where there is a column ``g``, and only strings of different sides where there is a column
    ``side`` (0 or 1).

    ``by_length`` looks at a number of places that grows with the cube of ``k`` but not with the strings, ``by_place`` at each
    place of a string at most twice, whatever ``k``. Where strings are short for ``k`` their segments say little: ``by_count:q`` asks for
    several common grams of ``q`` characters, ``by_tile`` compares blocks of strings (64 characters at most). Where many strings are equal but
    for their digits, ``by_kind`` compares only those that are near without them. ``auto`` takes the one that is cheapest for a sample of
    these strings (``price``).
    """
    return candidates_by(near_rows(strings, id_col, text_col), k, plan).select("i1", "i2")


def candidates_by(rows: DataFrame, k: int, plan: str = "auto", params: JoinParams | None = None) -> DataFrame:
    """The same of ``near_rows``, with the ``dist`` of each pair where the plan is one of ``COMPARE``, and with ``params`` also whether it is a ``hit``: its strings
    collide often enough. That is found where they are compared, from the strings of a block, so no pair is joined with the buckets."""
    if plan == "auto":
        plan = price(rows, k)[0]
    name, _, q = plan.partition(":")
    if name == "by_count":
        return by_count(rows, k, int(q))
    if name in COMPARE:
        return {"by_tile": by_tile, "by_kind": by_kind}[name](rows, k, "links" if params is None else "hits", params)
    return {"by_length": by_length, "by_place": by_place}[name](rows, k)


def by_length(rows: DataFrame, k: int) -> DataFrame:
    """Pairs by segments whose places follow from the strings' lengths.

    A string is cut into k + 1 segments of even length. ``k`` edits leave one of them whole, so it stands in the other
    string, at a place that the edits on either side of it bound. The longer string of a pair looks for the segments of
    each length that it can reach, at those places only: an equi-join on (length, segment number, content hash).
    Strings no longer than ``k`` have empty segments and meet all strings of nearby length; they differ by ``k`` at most
    among themselves anyway.
    """
    parts = k + 1
    rows = rows.withColumn("n", F.length("s"))
    # The last (length mod parts) segments are one character longer.
    base = F.floor(F.col("len") / parts).cast("int")
    plain = parts - F.col("len") % parts
    size = base + F.when(F.col("seg") > plain, 1).otherwise(0)
    start = base * (F.col("seg") - 1) + F.greatest(F.col("seg") - 1 - plain, F.lit(0))
    seg = F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("seg")
    key = lambda at: F.xxhash64("len", "seg", F.substring("s", F.col(at) + 1, F.col("size")))
    index = rows.select("i", "s", "g", "x", F.col("n").alias("len"), seg).withColumns({"size": size, "start": start})
    index = index.select(F.col("i").alias("short"), "g", F.col("x").alias("side"), "len", key("start").alias("key"))
    probe = rows.select("i", "s", "g", "y", "n", F.explode(F.sequence(F.greatest(F.col("n") - k, F.lit(0)), F.col("n"))).alias("len"))
    probe = probe.select("*", seg).withColumns({"size": size, "start": start, "more": F.col("n") - F.col("len")})
    left, right = F.col("seg") - 1, parts - F.col("seg")
    low = F.greatest(F.lit(0), F.col("start") - left, F.col("start") + F.col("more") - right)
    high = F.least(F.col("n") - F.col("size"), F.col("start") + left, F.col("start") + F.col("more") + right)
    probe = probe.withColumns({"low": low, "high": high}).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    probe = probe.select(F.col("i").alias("long"), "g", F.col("y").alias("side"), F.col("len"), key("at").alias("key"), (F.col("more") == 0).alias("even"))
    met = probe.join(index, ["len", "key", "g", "side"]).where((~F.col("even") & (F.col("long") != F.col("short"))) | (F.col("short") < F.col("long")))
    return met.select(F.least("long", "short").alias("i1"), F.greatest("long", "short").alias("i2")).distinct()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_Q, _QINV):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


def gram_hashes(total: np.ndarray, down: np.ndarray, begin: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the ``q`` characters from each place of ``begin``, from prefix sums of characters times powers."""
    x = (total[begin + q] - total[begin]) * down[begin]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _grams(rows: DataFrame, k: int, probe: bool) -> DataFrame:
    """``i``, ``n``, ``q``, ``zone``, ``key``, ``at``: as ``probe`` every place of a string for each segment size that a string up to ``k`` shorter
    has, else the first k + 1 segments of the string, each in the zones that ``k`` places to either side reach."""
    parts = k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = [len(s) for s in b.column(1).to_pylist()]
            most = max(lengths, default=0)
            up, down = _powers(most + 1)
            for i, s, group, side in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 4 if probe else 3))):
                n = len(s)
                code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                total = np.zeros(n + 1, np.uint64)
                np.cumsum((code + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * up[:n], out=total[1:])
                for q in sorted({max(0, n - k) // parts, n // parts}) if probe else [n // parts]:
                    if q == 0:
                        # Shorter strings without segments are met by their length alone.
                        key = np.arange(max(0, n - k), min(n, k) + 1) if probe else np.array([n])
                        at, zone = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
                    elif probe:
                        at = np.arange(n - q + 1)
                        key, zone = gram_hashes(total, down, at, q), at // parts
                    else:
                        at = np.arange(parts) * q
                        key, zone = np.tile(gram_hashes(total, down, at, q), 3), np.concatenate([at // parts + d for d in (-1, 0, 1)])
                        at = np.tile(at, 3)
                    for lo in range(0, len(key), _CELLS):
                        part = slice(lo, lo + _CELLS)
                        size = len(key[part])
                        same = (pa.array(np.full(size, x, t)) for x, t in ((i, np.int64), (group, np.int64), (side, np.int32), (n, np.int32), (q, np.int32)))
                        yield pa.RecordBatch.from_arrays([*same, pa.array(zone[part].astype(np.int32)), pa.array(key[part].astype(np.int64)), pa.array(at[part].astype(np.int32))], ["i", "g", "side", "n", "q", "zone", "key", "at"])

    return rows.mapInArrow(run, "i long, g long, side int, n int, q int, zone int, key long, at int")


def by_place(rows: DataFrame, k: int) -> DataFrame:
    """Pairs by segments of one size that the other string has nearby.

    A string of ``n`` characters has k + 1 disjoint segments of ``q`` = n / (k + 1) characters. ``k`` edits leave one of them whole,
    no further than ``k`` places away. The longer string of a pair looks at each of its places once for each ``q`` that a string
    up to ``k`` shorter can have, which are two at most: an equi-join on (size, zone of k + 1 places, content hash).
    Strings no longer than ``k`` have no segment and meet those of nearby length.
    """
    index = _grams(rows, k, False).select(F.col("i").alias("short"), "g", "side", F.col("n").alias("n1"), "q", "zone", "key", F.col("at").alias("at1"))
    probe = _grams(rows, k, True).select(F.col("i").alias("long"), "g", "side", "n", "q", "zone", "key", "at")
    near = (F.abs(F.col("at") - F.col("at1")) <= k) & (F.col("n") - F.col("n1")).between(0, k) & ((F.col("n") > F.col("n1")) | (F.col("short") < F.col("long")))
    met = probe.join(index, ["q", "zone", "key", "g", "side"]).where(near & (F.col("long") != F.col("short")))
    return met.select(F.least("long", "short").alias("i1"), F.greatest("long", "short").alias("i2")).distinct()


def by_count(rows: DataFrame, k: int, q: int) -> DataFrame:
    """Pairs by common grams of ``q`` characters, whatever ``k``; rare grams first.

    An edit changes ``q`` grams at most, so two strings within ``k`` edits have, of the longer one's grams, all but ``k`` * ``q`` in common, no
    further than ``k`` places apart. With grams in order of how often the table has them, ``COMMON`` of those are among the ``k`` * ``q`` + ``COMMON`` rarest of either
    string (all as frequent as the last of them included): only these are joined, and a pair counts that has ``COMMON`` of them, or as many as
    it must have. Pairs of strings that are both too short to need any go by ``by_length``.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, at, key = [], [], []
            for x, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(s)
                code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                up, down = _powers(n + 1)
                total = np.zeros(n + 1, np.uint64)
                np.cumsum((code + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * up[:n], out=total[1:])
                place = np.arange(max(0, n - q + 1))
                i.append(np.full(len(place), x, np.int64))
                at.append(place.astype(np.int32))
                key.append(gram_hashes(total, down, place, q))
            if i:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (i, at, key)], ["i", "at", "key"])

    grams = rows.select("i", "s").mapInArrow(cut_up, "i long, at int, key long")
    often = grams.groupBy("key").agg(F.count("*").alias("often"))
    rank = F.rank().over(Window.partitionBy("i").orderBy("often", "key"))
    rare = grams.join(often, "key").withColumn("rank", rank).where(F.col("rank") <= k * q + COMMON)
    rare = rare.join(rows.select("i", "g", "x", "y", F.length("s").alias("n")), "i")
    one = rare.select("key", "g", F.col("i").alias("long"), F.col("n").alias("n1"), F.col("at").alias("at1"), F.col("y").alias("side"))
    two = rare.select("key", "g", F.col("i").alias("short"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("x").alias("side"))
    # The longer string asks; of equally long ones that with the larger id.
    first = ((F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("short") < F.col("long")))) & (F.col("n1") - F.col("n2") <= k)
    met = one.join(two, ["key", "g", "side"]).where(first & (F.abs(F.col("at1") - F.col("at2")) <= k))
    need = F.least(F.lit(COMMON), F.col("n1") - (q - 1 + k * q))
    enough = met.groupBy("long", "short", "n1").agg(F.count_distinct("at1").alias("common")).where(F.col("common") >= need)
    pairs = enough.select(F.least("long", "short").alias("i1"), F.greatest("long", "short").alias("i2"))
    return pairs.unionByName(by_length(rows.where(F.length("s") < q + k * q), k)).distinct()


class Pairs:
    """What a task finds of the pairs within ``k`` edits among its rows: ``links`` has each of them, ``sums`` adds them up for each row, ``forest``
    keeps links that connect what all links between rows marked by ``v`` connect, and every link of the other rows, and ``hits`` has each link with
    whether its strings are ``colliding`` under ``params``."""

    SCHEMAS = {
        "links": "i1 long, i2 long, dist int",
        "sums": "i long, n_others long, m long, nearest int, sum_dist long",
        "forest": "i1 long, i2 long",
        "hits": "i1 long, i2 long, dist int, hit boolean",
    }

    def __init__(self, what: str, k: int, ids: np.ndarray, side: np.ndarray | None, v: np.ndarray):
        self.what, self.k, self.ids, self.side, self.v = what, k, ids, side, v
        self.found: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.dist: list[np.ndarray] = []
        self.sums = np.zeros((3, len(ids) if what == "sums" else 0), np.int64)
        self.nearest = np.full(len(ids), k + 1, np.int64)
        self.root = np.arange(len(ids))

    def known(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether no link between rows ``a`` and ``b`` can say anything new."""
        if self.what != "forest" or not (self.v[a].all() and self.v[b].all()):
            return False
        return bool((self.root[a] == self.root[a[0]]).all() and (self.root[b] == self.root[a[0]]).all())

    def add(self, a: np.ndarray, b: np.ndarray, dist: np.ndarray, in_order: bool = False) -> None:
        """``dist`` of rows ``a`` and ``b``; ``in_order``: only where the id of the first is smaller."""
        near = dist <= self.k
        if in_order:
            near &= self.ids[a][:, None] < self.ids[b][None, :]
        if a is b:  # each two rows once
            near &= np.tri(len(a), dtype=bool).T & ~np.eye(len(a), dtype=bool)
        if self.side is not None:
            near &= self.side[a][:, None] != self.side[b][None, :]
        if not near.any():
            return
        if self.what in ("links", "hits"):
            x, y = np.nonzero(near)
            self.found.append(np.stack([self.ids[a[x]], self.ids[b[y]]], 1))
            self.dist.append(dist[x, y])
            if self.what == "hits":
                self.places.append(np.stack([a[x], b[y]]))
        elif self.what == "sums":
            spent, far = np.where(near, dist, 0), np.where(near, dist, self.k + 1)
            for rows, others, axis, by in ((a, b, 1, near), (b, a, 0, near.T)):
                self.sums[:, rows] += (near.sum(axis), (by @ self.v[others].astype(np.float64)).astype(np.int64), spent.sum(axis, dtype=np.int64))
                self.nearest[rows] = np.minimum(self.nearest[rows], far.min(axis))
        else:
            one, two = self.v[a] != 0, self.v[b] != 0
            x, y = np.nonzero(near & ~(one[:, None] & two[None, :]))
            self.found.append(np.stack([self.ids[a[x]], self.ids[b[y]]], 1))
            near &= one[:, None] & two[None, :]
            while (near := near & (self.root[a][:, None] != self.root[b][None, :])).any():
                x, y = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                self._join(np.concatenate([a[x], a[near[:, y].argmax(0)]]), np.concatenate([b[near[x].argmax(1)], b[y]]))

    def _join(self, x: np.ndarray, y: np.ndarray) -> None:
        parent = {}

        def top(r: int) -> int:
            while r in parent:
                r = parent[r]
            return r

        new = []
        for p, q in zip(x.tolist(), y.tolist()):
            one, two = top(int(self.root[p])), top(int(self.root[q]))
            if one != two:
                parent[max(one, two)] = min(one, two)
                new.append((self.ids[p], self.ids[q]))
        for r in sorted(parent):
            self.root[self.root == r] = top(r)
        self.found.append(np.array(new, np.int64).reshape(-1, 2))

    def table(self, strings: list[str], params: JoinParams | None = None) -> pa.Table:
        if self.what == "sums":
            at = np.flatnonzero(self.sums[0])
            columns = [self.ids[at], self.sums[0, at], self.sums[1, at], self.nearest[at].astype(np.int32), self.sums[2, at]]
        else:
            pairs = np.sort(np.concatenate([np.empty((0, 2), np.int64), *self.found]), axis=1)
            columns = [np.ascontiguousarray(pairs[:, c]) for c in range(2)]
            if self.what in ("links", "hits"):
                columns.append(np.concatenate([np.empty(0, np.int32), *self.dist]).astype(np.int32))
            if self.what == "hits":
                columns.append(colliding(strings, *np.concatenate([np.empty((2, 0), np.int64), *self.places], 1), params))
        return pa.table([pa.array(c) for c in columns], [c.split()[0] for c in self.SCHEMAS[self.what].split(", ")])


def runs(rows: np.ndarray, strings: list[str]) -> list[tuple[np.ndarray, Sliced | list[str]]]:
    """The ``strings``, one for each of ``rows``, by length and in blocks of up to ``PART``. Sorted strings are cut where their beginnings
    change, so that those of a block share what they can. Very long ones stay strings."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    out = []
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        codes = np.frombuffer("".join(strings[x][: n // 4] for x in at).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(at), n // 4)
        new = np.flatnonzero((codes[1:] != codes[:-1]).any(1)) + 1
        begin = 0
        while begin < len(at):
            ends = new[np.searchsorted(new, begin + max(1, PART // 16)) :]
            end = min(begin + PART, len(at), *ends[:1].tolist())
            part = [strings[x] for x in at[begin:end]]
            out.append((rows[at[begin:end]], Sliced(part) if n <= 4 * WORD else part))
            begin = end
    return out


def meet(xs: list[tuple[np.ndarray, Sliced | list[str]]], ys: list[tuple[np.ndarray, Sliced | list[str]]], k: int, found: Pairs, in_order: bool = False) -> None:
    """Adds all pairs of ``xs`` and ``ys`` (of ``runs``), or each two of ``xs``, if both are the same."""
    size = lambda r: r.size if isinstance(r, Sliced) else len(r[0])
    for at, (a, x) in enumerate(xs):
        for b, y in ys[at:] if xs is ys else ys:
            if abs(size(x) - size(y)) > k or found.known(a, b):
                continue
            if isinstance(x, Sliced) and isinstance(y, Sliced):
                found.add(a, b, sliced_distances(x, y, k), in_order)
                continue
            u, v = (r.strings if isinstance(r, Sliced) else r for r in (x, y))
            for i in range(len(u)):  # the strings of some pairs only are copied at once
                rest = v[i + 1 :] if a is b else v
                if rest:
                    dist = diagonal_distances([u[i]] * len(rest), rest, k)
                    found.add(a[i : i + 1], b[i + 1 :] if a is b else b, np.where(dist < 0, k + 1, dist)[None, :], in_order)


def _across(rows: DataFrame) -> bool:
    return rows.where("x <> y").limit(1).count() > 0


def by_tile(rows: DataFrame, k: int, what: str = "links", params: JoinParams | None = None) -> DataFrame:
    """Pairs within ``k`` edits of strings of 64 characters at most, found by comparing blocks of them; ``what`` of them as in ``Pairs``.

    Strings of one length are cut, in their order, into blocks of ``TILE``; two blocks whose lengths differ by ``k`` at most are a tile, in which the
    distances of all pairs are found at once, a bit for each pair (``sliced_distances``). So no pair is written that is
    not within ``k``, and any number of tasks share the work; that is quadratic in the strings, if at a small cost a pair.
    """
    rows = cut(numbered(rows.withColumn("n", F.length("s")), "g", "n", "s", name="at"), "in-order")
    sizes = cut(rows.groupBy("g", "n").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"), F.min("at").alias("first")), "lengths")
    dealt = rows.join(sizes, ["g", "n"]).withColumn("p", F.floor((F.col("at") - F.col("first")) / TILE).cast("int"))
    one, two = (sizes.select("g", F.col("n").alias(f"n{d}"), F.col("parts").alias(f"parts{d}")) for d in (1, 2))
    tiles = one.join(two.withColumn("n1", F.explode(F.sequence(F.greatest(F.col("n2") - k, F.lit(0)), "n2"))), ["g", "n1"])
    tiles = tiles.withColumn("p1", F.explode(F.sequence(F.lit(0), F.col("parts1") - 1)))
    from_ = F.when(F.col("n1") == F.col("n2"), F.col("p1")).otherwise(0)
    tiles = tiles.where((F.col("n1") < F.col("n2")) | (F.col("p1") < F.col("parts2"))).withColumn("p2", F.explode(F.sequence(from_, F.col("parts2") - 1)))
    keys = ["g", "n1", "p1", "n2", "p2"]
    # A block meets itself as one side only.
    itself = (F.col("n1") == F.col("n2")) & (F.col("p1") == F.col("p2"))
    sides = [tiles.select(keys).where(~itself if d == 2 else F.lit(True)).join(dealt.select("g", F.col("n").alias(f"n{d}"), F.col("p").alias(f"p{d}"), "i", "s", "x", "v", F.lit(d).alias("d")), ["g", f"n{d}", f"p{d}"]) for d in (1, 2)]
    both = sides[0].select(*keys, "i", "s", "x", "v", "d").unionByName(sides[1].select(*keys, "i", "s", "x", "v", "d"))
    across = _across(rows)

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("d", "ascending"), ("s", "ascending")])
        d, ids, side, v = (table.column(c).to_numpy() for c in ("d", "i", "x", "v"))
        s = table.column("s").to_pylist()
        split = int(np.searchsorted(d, 2))
        found = Pairs(what, k, ids, side if across else None, v)
        one, two = runs(np.arange(split), s[:split]), runs(np.arange(split, len(s)), s[split:])
        meet(one, two if two else one, k, found)
        return found.table(s, params)

    return both.groupBy(keys).applyInArrow(compare, Pairs.SCHEMAS[what])


def by_kind(rows: DataFrame, k: int, what: str = "links", params: JoinParams | None = None) -> DataFrame:
    """Pairs within ``k`` edits, found by comparing blocks of strings whose kinds are near; ``what`` of them as in ``Pairs``.

    The kind of a string is what is left of it without its digits. Taking the same characters out of two strings brings them no further apart, so
    strings within ``k`` have kinds within ``k``: the kinds are joined first, and only the strings of near kinds meet. Blocks of one kind agree in
    most of what they begin and end with, which is taken off before their distances are found, all pairs of two blocks at once. Large kinds
    are dealt to tasks by hash. No pair is written that is not within ``k``.
    """
    rows = rows.withColumn("kind", _kind("s"))
    kinds = cut(rows.groupBy("g", "kind").agg(F.min("i").alias("u"), F.count("*").alias("n")), "kinds")
    named = kinds.select(F.col("u").alias("i"), F.col("kind").alias("s"), "g", F.lit(0).alias("x"), F.lit(0).alias("y"))
    found = cut(verify_kinds(named, k), "near-kinds")
    same = kinds.select(F.col("u").alias("a"), F.col("u").alias("b"))
    near = found.select(F.col("i1").alias("a"), F.col("i2").alias("b")).unionByName(same)
    n = kinds.select(F.col("u").alias("b"), "n")
    right = near.join(n, "b").groupBy("a").agg(F.ceil(F.sum("n") / NEAR_TILE).cast("int").alias("parts"))
    left = kinds.select(F.col("u").alias("a"), F.ceil(F.col("n") / KIND_TILE).cast("int").alias("blocks"))
    tasks = cut(left.join(right, "a"), "kind-tasks")
    of = rows.join(kinds.select("g", "kind", "u"), ["g", "kind"]).select("u", "i", "s", "x", "v", F.xxhash64("i").alias("h"))
    block, part = F.pmod("h", "blocks").cast("int"), F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = tasks.join(of.withColumnRenamed("u", "a"), "a").select("a", block.alias("p"), every("parts").alias("r"), F.lit(1).alias("d"), F.col("a").alias("u"), "i", "s", "x", "v")
    two = near.join(tasks, "a").join(of.withColumnRenamed("u", "b"), "b").select("a", every("blocks").alias("p"), part.alias("r"), F.lit(2).alias("d"), F.col("b").alias("u"), "i", "s", "x", "v")
    across = _across(rows)

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("d", "ascending"), ("u", "ascending"), ("s", "ascending")])
        d, u, ids, side, v = (table.column(c).to_numpy() for c in ("d", "u", "i", "x", "v"))
        s = table.column("s").to_pylist()
        split = int(np.searchsorted(d, 2))
        found = Pairs(what, k, ids, side if across else None, v)
        ends = [split, *(split + 1 + np.flatnonzero(u[split + 1 :] != u[split:-1])).tolist(), len(s)] if len(s) > split > 0 else []
        mine = s[:split]
        for begin, end in zip(ends, ends[1:]):  # strings of one kind
            one, two = without_ends(mine, s[begin:end])
            one, two = runs(np.arange(split), one), runs(np.arange(begin, end), two)
            meet(one, two, k, found, bool(u[begin] == u[0]))  # two rows of one kind meet in both orders
        return found.table(s, params)

    return one.unionByName(two).groupBy("a", "p", "r").applyInArrow(compare, Pairs.SCHEMAS[what])


def verify_kinds(kinds: DataFrame, k: int) -> DataFrame:
    """``i1`` < ``i2`` of the kinds within ``k`` edits."""
    met = candidates_by(near_rows(kinds), k)
    if "dist" in met.columns:
        return met.select("i1", "i2")
    one, two = (kinds.select(F.col("i").alias(f"i{d}"), F.col("s").alias(f"s{d}")) for d in (1, 2))
    return met.join(one, "i1").join(two, "i2").where(F.levenshtein("s1", "s2", k) >= 0).select("i1", "i2")


def without_ends(xs: list[str], ys: list[str]) -> tuple[list[str], list[str]]:
    """All strings without what all of them begin and end with, which changes no distance of two of them."""
    least, most = min(min(xs), min(ys)), max(max(xs), max(ys))
    begin = len(commonprefix([least, most]))
    xs, ys = [s[begin:] for s in xs], [s[begin:] for s in ys]
    turned = [s[::-1] for s in (*xs, *ys)]
    end = len(commonprefix([min(turned), max(turned)]))
    return ([s[:-end] for s in xs], [s[:-end] for s in ys]) if end else (xs, ys)
