"""Embedding near-duplicates by a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrow_text import quoted
from threadloom.operators.components import connected_components
from threadloom.plans.scratch import cut

COSINE = 0.93
#: Vectors that a leaf should hold; a group of up to twice as many is not split any further but compared as it is.
LEAF = 1024
#: What goes down both ways: vectors as near to the median of their projections as this many standard deviations of the difference
#: that two vectors at the threshold have in a random direction. It is a distance, not a share, so a dense group
#: is not torn apart by a median that runs through it. A wide spill saves trees but copies of a vector multiply with every level:
#: at 0.2 both together grow least.
SPILL = 0.2
#: Part of a node that either way may keep; where a split would leave more (a dense group) the node stays whole.
KEPT = 0.85
#: Part of a node's pairs that both ways together may keep: a split that leaves more saves little or no comparing, and copies of the vectors
#: multiply with every level of such splits (both ways with 0.85 of a dense group: 1.7 times as many at each level).
WORTH = 0.8
#: Vectors of a leaf that a task compares with others of it at once; a leaf with more is dealt into blocks of so many.
BLOCK = 2 * LEAF
#: A split leaves each way about this part of a node of evenly spread vectors.
SHARE = 0.54
#: The number of trees follows from their depth: a pair at the threshold survives a split with this chance at least (0.93 for
#: evenly spread vectors), and all trees together may lose it with the other.
SURVIVES, LOST = 0.92, 1e-4
#: Numbers (vectors times their width) that set one subtree's medians, vectors of them, and those a node needs. A group of no more is
#: held by one task, which takes it down to its leaves; a larger one is split by a sample of so many until its nodes are.
FIT_NUMBERS, FIT_ROWS, FIT_NODE = 1 << 20, 1 << 14, 16
#: Vectors that one task takes down the trees.
TASK_ROWS = 100_000
#: Splits below which a leaf's number stays within the bits that a home (tree << 55 | leaf) has for it.
MOST_DEPTH = 54
#: Vectors of a leaf that is compared together with the others of its group, so that a vector is sent once for all of them. One with more
#: has so much to compare that it is worth being sent by itself.
SMALL = 64
#: Trees that go on from each node of a larger group's tree once a task can hold it: they share its vectors, which are sent there once. Where
#: leaves are not ``SMALL`` there is but one, as their vectors are sent for each tree anyway.
BELOW = 3
#: Earlier leaves that the rows of one are compared by at once.
CODES = 2048
SEED = 11

_TREE = 55
_GROUP = ("label", "w", "home")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def trees_for(rows: int, leaf: int = LEAF) -> tuple[int, int]:
    """Trees and splits of a group of ``rows`` vectors."""
    depth = math.ceil(math.log(rows / (2 * leaf)) / -math.log(SHARE)) if rows > 2 * leaf else 0
    return (math.ceil(math.log(LOST) / math.log(1 - SURVIVES**depth)) if depth else 1), depth


def trees_above(rows: int, leaf: int, unit: float) -> int:
    """Trees of a group of ``rows`` vectors of which ``trees_below`` go on from each node of about ``unit`` vectors."""
    depth = trees_for(rows, leaf)[1]
    above = min(depth, math.ceil(math.log(max(1, rows / unit)) / -math.log(SHARE)))
    found = SURVIVES**above * (1 - (1 - SURVIVES ** (depth - above)) ** trees_below(leaf))
    return math.ceil(math.log(LOST) / math.log(1 - found)) if found < 1 else 1


def trees_below(leaf: int) -> int:
    return BELOW if 2 * leaf <= SMALL else 1


@lru_cache(maxsize=1 << 15)
def direction(seed: int, tree: int, node: int, width: int) -> np.ndarray:
    """The normal of a node's split. It follows from the seed, so only thresholds are stored and sent."""
    d = np.random.default_rng((seed, tree, node)).normal(size=width)
    return d / np.linalg.norm(d)


class Tree:
    """Splits below ``root``: node -> (low, high). A vector goes left at or below ``high`` and right at or above ``low``, so both
    ways in between."""

    def __init__(self, number: int, root: int = 1, nodes: dict[int, tuple[float, float]] | None = None):
        self.number, self.root, self.nodes = number, root, nodes or {}
        #: Of a fitted tree: its leaves and the rows of the sample that are in them.
        self.leaves: list[tuple[int, np.ndarray]] = []

    @staticmethod
    def fit(sample: np.ndarray, number: int, root: int, n: int, cosine: float = COSINE, leaf: float = LEAF) -> Tree:
        """Splits until a node has about twice ``leaf`` of the ``n`` vectors that ``sample`` was picked from."""
        out = Tree(number, root)
        spill = SPILL * math.sqrt(max(0.0, 2 * (1 - cosine)) / sample.shape[1])
        todo = [(root, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) * n <= 2 * leaf * len(sample) or len(rows) < FIT_NODE or node.bit_length() > MOST_DEPTH:
                out.leaves.append((node, rows))
                continue
            p = sample[rows] @ direction(SEED, number, node, sample.shape[1])
            mid = np.median(p)
            left, right = rows[p <= mid + spill], rows[p >= mid - spill]
            if max(len(left), len(right)) > KEPT * len(rows) or len(left) ** 2 + len(right) ** 2 > WORTH * len(rows) ** 2:
                out.leaves.append((node, rows))
                continue
            out.nodes[node] = (float(mid - spill), float(mid + spill))
            todo += [(2 * node, left), (2 * node + 1, right)]
        return out

    def pack(self) -> bytes:
        head = np.array([self.number, self.root, len(self.nodes), *self.nodes], "<i8")
        return head.tobytes() + np.array(list(self.nodes.values()), "<f8").tobytes()

    @staticmethod
    def unpack(data: bytes) -> list[Tree]:
        out, at = [], 0
        while at < len(data):
            number, root, n = np.frombuffer(data, "<i8", 3, at).tolist()
            nodes = np.frombuffer(data, "<i8", n, at + 24).tolist()
            bounds = np.frombuffer(data, "<f8", 2 * n, at + 24 + 8 * n).reshape(n, 2).tolist()
            out.append(Tree(number, root, {k: (low, high) for k, (low, high) in zip(nodes, bounds)}))
            at += 24 + 24 * n
        return out

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and home of every way down."""
        row, home = [], []
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node not in self.nodes:
                row.append(rows)
                home.append(np.full(len(rows), self.number << _TREE | node, np.int64))
                continue
            low, high = self.nodes[node]
            p = x[rows] @ direction(SEED, self.number, node, x.shape[1])
            todo += [(2 * node, rows[p <= high]), (2 * node + 1, rows[p >= low])]
        return (np.concatenate(row), np.concatenate(home)) if row else (np.empty(0, np.int64), np.empty(0, np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id``, ``label`` (as text), ``v`` (floats as they are, else doubles) and ``ok``: whether the row can link at all."""
    v = F.col(quoted(vector_col))
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col(quoted(label_col))
    ok = v.isNotNull() & label.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), label.cast("string").alias("label"), v.alias("v"), F.coalesce(ok, F.lit(False)).alias("ok"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first ``keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in range(keys):
            c = b.column(k)
            c = c.dictionary_encode().indices if pa.types.is_string(c.type) else c
            x = c.to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            key = tuple(b.column(k)[i].as_py() for k in range(keys))
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _most(fit_rows: int) -> Column:
    """Vectors of width ``w`` that one task fits subtrees on."""
    return F.least(F.lit(fit_rows), F.greatest(F.floor(F.lit(FIT_NUMBERS) / F.greatest("w", F.lit(1))), F.lit(4 * FIT_NODE)))


def _settled(items: DataFrame, whole: DataFrame, numbers: int, cosine: float, leaf: int) -> DataFrame:
    """``label``, ``w``, ``node``, ``unit``, ``homes``: the leaves of the ``items`` of groups that one task holds (``whole``), which fits the
    subtrees on all of the group and takes it down. Leaves of up to ``SMALL`` vectors stay together in the group's unit, others are
    units of their own. ``numbers`` are those of all the groups: a task gets about as many of them as one group may have."""
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-numbers // FIT_NUMBERS))
    gathered = items.join(whole.select(*_GROUP), list(_GROUP)).select(*_GROUP, "node", "v").repartition(tasks, *_GROUP).sortWithinPartitions(*_GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            group, x, node = g.column("home")[0].as_py(), unit(_matrix(_column(g, "v"))), _column(g, "node")
            order = np.lexsort(x.T[:4])
            x, node = x[order], node.take(pa.array(order))
            tree, root = group >> _TREE, group & ((1 << _TREE) - 1) or 1
            units: dict[int, list[tuple[int, np.ndarray]]] = {}
            for t in range(tree, tree + (trees_below(leaf) if group else trees_for(len(x), leaf)[0])):
                for at, rows in Tree.fit(x, t, root, len(x), cosine, leaf).leaves:
                    home = t << _TREE | at
                    units.setdefault(group if len(rows) <= SMALL else home, []).append((home, rows))
            for own, leaves in units.items():
                row = np.concatenate([rows for _, rows in leaves])
                home = np.repeat([home for home, _ in leaves], [len(rows) for _, rows in leaves])
                by_row = np.lexsort((home, row))
                there, first = np.unique(row[by_row], return_index=True)
                homes = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(home[by_row], pa.int64()))
                same = [_column(g, c).slice(0, len(there)) for c in ("label", "w")]
                yield pa.RecordBatch.from_arrays([*same, node.take(pa.array(there)), pa.array(np.full(len(there), own, np.int64)), homes], ["label", "w", "node", "unit", "homes"])

    return gathered.mapInArrow(run, "label string, w int, node long, unit long, homes array<long>")


def _subtrees(items: DataFrame, big: DataFrame, cosine: float, leaf: int, fit_rows: int) -> DataFrame:
    """``label``, ``w``, ``home``, ``n``, ``trees``: splits for each group of ``big`` (which has its ``n``), fitted by itself on a
    sample of its ``items`` that is picked by hash and bounded in rows and numbers. They end at nodes that one task can hold."""
    most = _most(fit_rows)
    pick = F.pmod(F.xxhash64("node", "home"), F.lit(1 << 30))
    some = items.join(big.select(*_GROUP, "n"), list(_GROUP)).where(pick < most / F.col("n") * (1 << 30))
    # Less than a task holds, so that a node that turns out larger than its sample says need not go round again.
    unit_of = F.greatest(F.lit(2.0 * leaf), F.lit(0.8) * most).alias("unit")
    gathered = some.select(*_GROUP, "n", unit_of, "v").repartition(*_GROUP).sortWithinPartitions(*_GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            sample = unit(_matrix(_column(g, "v")))
            sample = sample[np.lexsort(sample.T[:4])]
            home, n, held = (g.column(c)[0].as_py() for c in ("home", "n", "unit"))
            numbers = [(t * trees_below(leaf), 1) for t in range(trees_above(n, leaf, held))] if home == 0 else [(home >> _TREE, home & ((1 << _TREE) - 1))]
            packed = b"".join(Tree.fit(sample, t, root, n, cosine, held / 2).pack() for t, root in numbers)
            first = g.slice(0, 1).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*(first.column(k) for k in range(4)), pa.array([packed], pa.binary())], [*_GROUP, "n", "trees"])

    return gathered.mapInArrow(run, "label string, w int, home long, n long, trees binary")


def _descend(items: DataFrame, subtrees: DataFrame) -> DataFrame:
    """``label``, ``w``, ``node``, ``home``: every way of the ``items`` down their group's subtrees.

    A subtree is sent once to each task of its group, ahead of the group's vectors; a large group is dealt to tasks by hash.
    """
    tasks = F.ceil(F.col("n") / TASK_ROWS).cast("int")
    sizes = subtrees.select(*_GROUP, tasks.alias("tasks"))
    mine = items.join(sizes, list(_GROUP)).select(*_GROUP, F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int").alias("task"), F.lit(1).alias("kind"), "node", "v", F.lit(None).cast("binary").alias("trees"))
    theirs = subtrees.select(*_GROUP, F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("node"), F.lit(None).cast(items.schema["v"].dataType).alias("v"), "trees")
    keys = [*_GROUP, "task"]
    dealt = mine.unionByName(theirs).repartition(*keys).sortWithinPartitions(*keys, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: list[Tree] = []
        for g in _groups(batches, 5):
            if g.column("kind")[0].as_py() == 0:
                trees = Tree.unpack(g.column("trees")[0].as_py())
                continue
            for b in g.to_batches(max_chunksize=4096):
                x = unit(_matrix(b.column(b.schema.names.index("v"))))
                node = b.column(b.schema.names.index("node"))
                for t in trees:
                    row, home = t.homes(x)
                    rows = pa.array(row)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), node.take(rows), pa.array(home)], ["label", "w", "node", "home"])

    return dealt.mapInArrow(run, "label string, w int, node long, home long")


def housed(vectors: DataFrame, cosine: float = COSINE, leaf: int = LEAF, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``label``, ``w``, ``node``, ``homes``, ``units``: the leaves of each of the ``vectors`` (``label``, ``w``, ``node``, ``v``), over all
    trees, and the same by units, which are compared together: ``unit`` and its ``homes``. A unit that is a leaf by itself has its name.

    Groups that outgrow a leaf but not a task are split where they are gathered, at once by all their trees. Larger ones are split by
    subtrees fitted on a sample of their own, first labels by all their trees, then, as often as it takes, the nodes that are still
    too large for a task; one that a split does not make smaller stays. Nothing of this passes through the driver but counts.
    """
    items = vectors.select("label", "w", F.lit(0).cast("long").alias("home"), "node", "v")
    placed = items.select("label", "w", "node", "home")
    fits = F.col("n") <= _most(fit_rows)
    done, settled = None, []
    while True:
        sizes = cut(placed.groupBy(*_GROUP).agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf), "large-leaves")
        if done is not None:
            sizes = sizes.join(done, list(_GROUP), "left_anti")
        whole, larger = sizes.agg(F.sum(F.when(fits, F.col("n") * F.col("w"))), F.count_if(~fits)).first()
        if not whole and not larger:
            break
        # Places are many but small as files, so that without the hint each task could get all of them.
        some = items if done is None else placed.join(sizes.select(*_GROUP), list(_GROUP), "left_semi").join(vectors.select("node", "v").hint("merge"), "node")
        if whole:
            settled.append(cut(_settled(some, sizes.where(fits), whole, cosine, leaf), "settled"))
        rest = placed.join(sizes.select(*_GROUP), list(_GROUP), "left_anti").select("label", "w", "node", "home")
        if not larger:
            placed = rest
            break
        subtrees = cut(_subtrees(some, sizes.where(~fits), cosine, leaf, fit_rows), "subtrees")
        # What a split left as it was is not split again.
        done = (sizes if done is None else done.unionByName(sizes, allowMissingColumns=True)).select(*_GROUP)
        placed = cut(_descend(some, subtrees).unionByName(rest), "homes")
    every = placed.select("label", "w", "node", F.col("home").alias("unit"), F.array("home").alias("homes"))
    for more in settled:
        every = every.unionByName(more)
    units = every.groupBy("label", "w", "node").agg(F.collect_list(F.struct("unit", "homes")).alias("units"))
    return units.select("label", "w", "node", F.flatten("units.homes").alias("homes"), "units")


def leaf_links(nodes: DataFrame, cosine: float = COSINE, leaf: int = LEAF, fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """What the leaves know of the links between the ``nodes`` (``node``, ``label``, ``w``, ``v`` and the weight ``n``), in two kinds of
    rows: ``a`` with ``m``, the weight of nodes that it links to (to be summed up), and ``a`` with ``b``, a forest of the links.

    Each vector goes to each of its units once, together with the numbers of its leaves: a pair counts in the first leaf that both
    share, so every pair found counts once and none is ever written. Leaves beyond ``block`` vectors are dealt into blocks by hash
    and each two blocks meet by themselves.
    """
    homes = cut(housed(nodes.select("label", "w", "node", "v"), cosine, leaf, fit_rows).select("label", "w", "node", "units"), "housed")
    alone = homes.select("label", "w", F.explode("units").alias("here")).where(F.col("here.homes")[0] == F.col("here.unit"))
    sizes = cut(alone.groupBy("label", "w", F.col("here.unit").alias("unit")).agg(F.count("*").alias("size")).where(F.col("size") > block), "blocked-leaves")
    sent = nodes.select("node", "n", "v").join(homes, "node").withColumns({"every": F.flatten("units.homes"), "here": F.explode("units")})
    sent = sent.withColumns({"unit": F.col("here.unit"), "homes": F.col("here.homes")})
    sent = sent.withColumn("others", F.array_except(F.filter("every", lambda h: h < F.array_max("homes")), "homes"))
    if sizes.limit(1).count():
        blocks = F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
        sent = sent.join(sizes, ["label", "w", "unit"], "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        # A row meets its own block and all others of its leaf.
        sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sent = sent.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    else:
        sent = sent.withColumns({c: F.lit(0) for c in ("block", "x", "y")})
    keys = ["key", "label", "w", "unit", "x", "y"]
    sent = sent.withColumn("key", F.xxhash64("label", "w", "unit", "x", "y")).select(*keys, "block", "node", "n", "v", "homes", "others")
    sorted_ = sent.repartition("key").sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 6):
            x, y = (g.column(k)[0].as_py() for k in ("x", "y"))
            out = _compare(g, x, y, cosine)
            if out is not None:
                yield out

    return sorted_.mapInArrow(run, "a long, b long, m long")


def _lists(column: pa.ListArray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element; ``places`` has the number of each row."""
    return np.repeat(places, np.diff(column.offsets.to_numpy())), column.flatten().to_numpy(zero_copy_only=False)


def _compare(g: pa.Table, x: int, y: int, cosine: float) -> pa.RecordBatch | None:
    """Links inside the leaves of one unit, or between two blocks of its only leaf, that no earlier leaf has."""
    block, node, weight = (_column(g, k).to_numpy(zero_copy_only=False) for k in ("block", "node", "n"))
    v = unit(_matrix(_column(g, "v")))
    order = np.argsort(block, kind="stable")
    block, node, weight, v = block[order], node[order], weight[order].astype(float), v[order]
    split = int(np.searchsorted(block, y)) if x != y else None
    row, home = _lists(_column(g, "homes"), np.argsort(order))
    other, others = _lists(_column(g, "others"), np.argsort(order))
    by_leaf = np.lexsort((row, home))
    leaves, first = np.unique(home[by_leaf], return_index=True)
    members = np.split(row[by_leaf], first[1:])
    row, home = np.concatenate([row, other]), np.concatenate([home, others])
    by_row = np.lexsort((home, row))
    home = home[by_row]
    ends = np.searchsorted(row[by_row], np.arange(len(node) + 1))
    total = np.zeros(len(node))
    edges: list[tuple[int, int]] = []
    for leaf, rows in zip(leaves.tolist(), members):
        def earlier() -> tuple[np.ndarray, np.ndarray]:
            """Row and number of the leaves before this one."""
            mine = [home[ends[r] : ends[r + 1]] for r in rows]
            mine = [h[: np.searchsorted(h, leaf)] for h in mine]
            return np.repeat(np.arange(len(rows)), [len(h) for h in mine]), np.concatenate(mine)

        if len(rows) > 1:
            more, joined = _linked(v[rows], weight[rows], split, cosine, earlier)
            if joined:
                total[rows] += more
                edges += [(rows[p], rows[q]) for p, q in joined]
    linked = np.flatnonzero(total)
    if not len(linked):
        return None
    a = np.concatenate([node[linked], node[[e[0] for e in edges]]]).astype(np.int64)
    b = pa.array([None] * len(linked) + node[[e[1] for e in edges]].tolist(), pa.int64())
    m = pa.array(np.concatenate([total[linked], np.zeros(len(edges))]).astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(a), b, m], ["a", "b", "m"])


def _linked(v: np.ndarray, weight: np.ndarray, split: int | None, cosine: float, earlier: Callable[[], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The weight that each row of a leaf links to, and a forest of the links; with ``split``, only links of rows before it to those from it on.
    ``earlier`` gives row and number of the leaves before this one: links that one of them has do not count."""
    n = len(v)
    total, parent = np.zeros(n), np.arange(n)
    edges: list[tuple[int, int]] = []
    known = None
    for i in range(0, n if split is None else split, 512):
        j = min(i + 512, n if split is None else split)
        first = i if split is None else split
        dot = v[i:j] @ v[first:].T
        near = dot >= cosine
        for p, q in zip(*np.nonzero(np.abs(dot - cosine) < 1e-9)):  # at the threshold the order of summing must not decide
            near[p, q] = math.fsum(v[i + p] * v[first + q]) >= cosine
        if split is None:
            near &= np.arange(i, j)[:, None] < np.arange(first, n)[None, :]
        if not near.any():
            continue
        known = known or _Shared(n, *earlier())
        for c in range(0, known.codes, CODES):
            if near.any():
                some = known.inside(c)
                near &= some[i:j] @ some[first:].T == 0
        if not near.any():
            continue
        total[i:j] += near @ weight[first:]
        total[first:] += near.T @ weight[i:j]
        # For the forest the first link of each column, and each row's links to columns of other trees.
        _join(near, i, first, parent, edges)
    return total, edges


class _Shared:
    """Which earlier leaves the ``n`` rows of one share: those of one row alone say nothing."""

    def __init__(self, n: int, row: np.ndarray, leaf: np.ndarray):
        _, code, often = np.unique(leaf, return_inverse=True, return_counts=True)
        shared = often[code] > 1
        self.n, self.row, self.code, self.codes = n, row[shared], (np.cumsum(often > 1) - 1)[code[shared]], int((often > 1).sum())
        self.first = self._inside(0) if self.codes else None

    def inside(self, first: int) -> np.ndarray:
        """Rows by the earlier leaves from ``first`` on, as 0 and 1."""
        return self._inside(first) if first else self.first

    def _inside(self, first: int) -> np.ndarray:
        some = (self.code >= first) & (self.code < first + CODES)
        out = np.zeros((self.n, min(CODES, self.codes - first)), np.float32)
        out[self.row[some], self.code[some] - first] = 1
        return out


def _join(near: np.ndarray, i: int, first: int, parent: np.ndarray, edges: list[tuple[int, int]]) -> None:
    """Adds a spanning forest of the links ``near`` (rows from ``i``, columns from ``first``) to ``edges``; ``parent`` names each row's
    tree. A row is joined once with each tree that it links to."""
    for p in np.flatnonzero(near.any(1)):
        columns = first + np.flatnonzero(near[p])
        roots, at = np.unique(parent[columns], return_index=True)
        mine = parent[i + p]
        new = roots != mine
        if new.any():
            edges.extend((i + int(p), int(columns[k])) for k in at[new])
            parent[np.isin(parent, roots)] = mine


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, leaf: int = LEAF, fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """``id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Rows link when their labels are equal and their cosine, in double precision, is at least ``cosine``. A null vector or
    label, a zero vector and one with a null or non-finite component link with nothing; vectors of different length
    do not meet. Equal vectors of a label are one node and never expanded into pairs; ``n_links`` counts them. A null id
    links like any other but is never a component's name unless it is alone, when that is null and not kept. Rows that
    repeat an id are rows of their own. Of equal component members the smallest id names it. Columns beside the three are
    not read; vectors of any width work; an empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vector_col, label_col)
    # 128 bits of two hashes tell vectors apart; what follows has a number of its own for each.
    rows = rows.withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(1), "v", "label")})
    members = cut(rows.select("id", "ok", "h1", "h2"), "members")
    n = members.count()
    distinct = rows.where("ok").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least"))
    nodes = cut(distinct.withColumns({"w": F.size("v"), "node": F.monotonically_increasing_id()}), "vectors")
    found = cut(leaf_links(nodes.select("node", "label", "w", "v", "n"), cosine, leaf, fit_rows, block), "links")
    around = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("around"))
    roots = connected_components(found.where("b is not null"))
    known = nodes.select("h1", "h2", "node", "n", "least").join(around, "node", "left").join(roots, "node", "left")
    links = (F.coalesce("around", F.lit(0)) + F.col("n") - 1).cast("long")
    known = cut(known.select("h1", "h2", links.alias("n_links"), "least", F.coalesce("component", "node").alias("root")), "nodes", n)
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that a hot vector's partition of the join with its copies can be split.
    named = cut(known.join(named, "root").select("h1", "h2", "n_links", "component_id"), "named", n)
    linked = members.where("ok").join(named, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = members.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select("id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
