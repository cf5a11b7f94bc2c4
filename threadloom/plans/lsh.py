"""Candidate pairs by locality-sensitive hashing of embeddings: one function a stage, all relational."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from threadloom.functions.embed import embed
from threadloom.params import UNREACHED, JoinParams
from threadloom.plans.scratch import cut


def buckets(strings: DataFrame, params: JoinParams, keep: Sequence[str] = ()) -> DataFrame:
    """``t``, ``k``, ``hash_id``, ``i``, ``q``, ``n``, ``sig``: a row for each string, random string, suffix and hash function. A
    column ``g`` of the strings stays: it is part of every bucket's key, so groups never meet. Columns of ``keep`` stay too."""
    both = F.posexplode(F.arrays_zip("sigs", "hashes")).alias("k", "x")
    group = ["g"] if "g" in strings.columns else []
    found = embed(strings, params, keep=keep).select("t", "q", "i", "n", *group, *keep, both)
    return found.select("t", "k", F.col("x.hashes").alias("hash_id"), "i", "q", "n", F.col("x.sigs").alias("sig"), *group, *keep)


def bucket_sizes(table: DataFrame) -> DataFrame:
    """``t``, ``k``, ``hash_id`` (and ``g``), ``size``."""
    return table.groupBy("t", "k", "hash_id", *(["g"] if "g" in table.columns else [])).agg(F.count("*").alias("size"))


def candidate_cardinality(table: DataFrame) -> DataFrame:
    """One row: buckets, those with two rows and more, and the pairs that enumerating them would give."""
    pairs = F.col("size") * (F.col("size") - 1)
    return bucket_sizes(table).agg(
        F.count("*").alias("n_buckets"),
        F.count_if(F.col("size") > 1).alias("n_shared"),
        F.coalesce((F.sum(pairs) / 2).cast("long"), F.lit(0).cast("long")).alias("n_pairs"),
    )


def signatures_agree(a: str, b: str) -> F.Column:
    """Whether two signatures agree wherever both are reached."""
    marker = F.lit(UNREACHED)
    return (F.col(a) == F.col(b)) | F.forall(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) | (x == marker) | (y == marker)), lambda ok: ok
    )


#: Rows of a bucket on either side of a task's share of its pairs: a larger bucket is enumerated by pairs of such blocks.
BLOCK = 2048


def in_blocks(one: DataFrame, two: DataFrame | None, keys: list[str], block: int, pack: Callable[[DataFrame], DataFrame] | None = None, tasks: int = 1) -> DataFrame:
    """Pairs of rows of equal ``keys``, the columns of one row with a 1 and those of the other with a 2 behind their names; within one table (``two`` is
    None) each two different rows meet once, in either order.

    A bucket with more than ``block`` rows is dealt into blocks, by a hash of the row, and each pair of blocks is a key of its own (of
    one table the pairs above the diagonal, and the blocks themselves): so what a bucket costs is shared by as many tasks as it
    has block pairs, and no row travels more often than there are blocks. Other buckets are one block.

    ``pack`` may put rows of one block (column ``own``) together; then packed rows meet. ``tasks`` is the least number of tasks they meet in.
    """
    tables = [one] if two is None else [one, two]
    sizes = [t.groupBy(*keys).agg(F.count("*").alias(f"size{d}")) for d, t in enumerate(tables, 1)]
    blocks = lambda d: F.ceil(F.col(f"size{d}") / block).cast("int").alias(f"b{d}")
    if two is None:
        hot = sizes[0].where(F.col("size1") > block).select(*keys, blocks(1))
    else:
        hot = sizes[0].join(sizes[1], keys).where((F.col("size1") > block) | (F.col("size2") > block)).select(*keys, blocks(1), blocks(2))
    hot = cut(hot, "hot")

    def side(x: DataFrame, d: int) -> DataFrame:
        mine, others = ("b1", "b1") if two is None else (f"b{d}", f"b{3 - d}")  # one table's sides are the same up to here, so packed once
        own = F.pmod(F.xxhash64(*(c for c in x.columns if c not in keys)), F.coalesce(mine, F.lit(1))).cast("int")
        dealt = x.join(hot, keys, "left").select(*x.columns, own.alias("own"), (F.coalesce(others, F.lit(1)) - 1).alias("last"))
        dealt = renamed(dealt if pack is None else pack(dealt), [*keys, "own", "last"], d)
        if two is None:
            reach = F.sequence("own", "last") if d == 1 else F.sequence(F.lit(0), "own")
        else:
            reach = F.sequence(F.lit(0), "last")
        dealt = dealt.select("*", F.explode(reach).alias("there"))
        x_, y_ = ("own", "there") if d == 1 else ("there", "own")
        return dealt.withColumnsRenamed({x_: "x", y_: "y"}).drop("last")

    return joined(side(one, 1), side(one if two is None else two, 2), [*keys, "x", "y"], tasks)


def joined(left: DataFrame, right: DataFrame, on: list[str], tasks: int) -> DataFrame:
    """The join by ``on``, dealt to ``tasks`` tasks if more than one are asked for: rows say little of the pairs that they will make, and adaptive
    execution puts small partitions together by their bytes."""
    if tasks > 1:
        left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
    return left.join(right, on)


def renamed(x: DataFrame, keys: list[str], d: int) -> DataFrame:
    return x.select(*keys, *(F.col(c).alias(f"{c}{d}") for c in x.columns if c not in keys))


#: Ids of a chunk at most: two chunks make their pairs at once, 65,536 rows.
CHUNK = 256
#: Pairs of bucket rows for each task that enumerates them, as far as there are as many.
TASK_PAIRS = 1 << 24


def chunks(table: DataFrame) -> DataFrame:
    """Rows that are equal but for ``i`` as ascending lists ``ids`` of ``CHUNK`` at most, numbered by ``part``. A group is collected whole, so it has to be bounded."""
    same = [c for c in table.columns if c != "i"]
    part = F.posexplode(F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(CHUNK)), lambda at: F.slice("all", at + 1, F.lit(CHUNK)))).alias("part", "ids")
    return table.groupBy(*same).agg(F.sort_array(F.collect_list("i")).alias("all")).select(*same, part)


def pair_sizes(table: DataFrame, other: DataFrame | None = None) -> Row:
    """``largest``, the rows of the largest bucket, and the pairs of rows of one bucket: ``full`` where both signatures are complete, ``rest`` where not."""
    keys = ["t", "k", "hash_id", *(["g"] if "g" in table.columns else [])]
    whole = F.instr("sig", UNREACHED) == 0
    sizes = [x.groupBy(*keys).agg(F.count("*").cast("double").alias(f"a{d}"), F.count_if(whole).cast("double").alias(f"f{d}")) for d, x in enumerate([table, *([] if other is None else [other])], 1)]
    if other is None:
        both, largest, pairs = sizes[0], F.col("a1"), lambda c: F.col(f"{c}1") * (F.col(f"{c}1") - 1) / 2
    else:
        both, largest, pairs = sizes[0].join(sizes[1], keys), F.greatest("a1", "a2"), lambda c: F.col(f"{c}1") * F.col(f"{c}2")
    sums = [F.max(largest).alias("largest"), F.sum(pairs("f")).alias("full"), F.sum(pairs("a") - pairs("f")).alias("rest")]
    return both.agg(*(F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(sums, ("largest", "full", "rest")))).first()


def collisions(table: DataFrame, params: JoinParams, other: DataFrame | None = None, sizes: Row | None = None) -> DataFrame:
    """``i1``, ``i2``, ``q1``, ``q2``, ``t``, ``k``: rows of one bucket whose lengths differ by ``k`` at most and whose signatures agree.

    Within one ``table`` each pair comes once, with ``i1`` < ``i2``; with an ``other`` table the first of a pair is of ``table`` and the second
    of ``other``, and no two rows of the same table meet.

    A signature without unreached places agrees only with an equal one or with one that has such places. So complete
    signatures are joined on themselves, which no accidental collision of bucket numbers can blow up, and only the
    incomplete ones are joined by bucket number. Suffix numbers are no part of the key. The pairs of a hot bucket are
    enumerated by blocks (``in_blocks``); ``sizes`` (``pair_sizes``) saves counting them where they are known.

    Whether two rows collide does not depend on their ids. So what meets and is compared are ``chunks`` of ids that have the rest in common, and only
    chunks that collide are spelled out, in the task where they met: a pair costs no more than the row that it becomes.
    """
    keys = ["t", "k", "hash_id", *(["g"] if "g" in table.columns else [])]
    whole = F.instr("sig", UNREACHED) == 0
    near = F.abs(F.col("n1") - F.col("n2")) <= params.k
    agree = signatures_agree("sig1", "sig2")
    columns = [*keys, "i", "q", "n", "sig"]
    sizes = sizes or pair_sizes(table, other)

    def met(x: DataFrame, y: DataFrame | None, on: list[str], pairs: float) -> DataFrame:
        x, y = x.select(columns), None if y is None else y.select(columns)
        tasks = -(-int(pairs) // TASK_PAIRS)
        if sizes.largest > BLOCK:
            return in_blocks(x, y, on, BLOCK, chunks, tasks)
        return joined(renamed(chunks(x), on, 1), renamed(chunks(x if y is None else y), on, 2), on, tasks)

    def equal(x: DataFrame, y: DataFrame | None) -> DataFrame:
        return met(x, y, [*keys, "sig"], sizes.full).where(near)

    def by_number(x: DataFrame, y: DataFrame | None) -> DataFrame:
        return met(x, y, keys, sizes.rest).where(near & agree)

    def once(found: DataFrame) -> DataFrame:
        """Chunks of one block meet in both orders and with themselves, and those of blocks one above the other in one order. ``itself``: the same chunk."""
        one, two = (F.struct(*(f"{c}{d}" for c in ("n", "q", "part", "sig") if f"{c}{d}" in found.columns)) for d in (1, 2))
        apart = F.col("x") < F.col("y") if "x" in found.columns else F.lit(False)
        return found.where(apart | (one <= two)).withColumn("itself", ~apart & (one == two))

    full, part = table.where(whole), table.where(~whole)
    names = ["t", "k", "q1", "q2", "ids1", "ids2"]
    if other is not None:
        full2, part2 = other.where(whole), other.where(~whole)
        found = [equal(full, full2), by_number(part, part2), by_number(part, full2), by_number(full, part2)]
        return _spelled(_all([m.select(names) for m in found])).select("i1", "i2", "q1", "q2", "t", "k")
    found = [once(equal(full, None)), once(by_number(part, None)), by_number(part, full).withColumn("itself", F.lit(False))]
    pairs = _spelled(_all([m.select(*names, "itself") for m in found])).where((F.col("i1") < F.col("i2")) | (~F.col("itself") & (F.col("i1") > F.col("i2"))))
    turned = F.col("i1") > F.col("i2")
    swap = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    return pairs.select(swap("i1", "i2").alias("i1"), swap("i2", "i1").alias("i2"), swap("q1", "q2").alias("q1"), swap("q2", "q1").alias("q2"), "t", "k")


def _spelled(found: DataFrame) -> DataFrame:
    """A row for each pair of an id of ``ids1`` and one of ``ids2``: ``i1``, ``i2`` and the other columns."""
    return found.select("*", F.explode("ids1").alias("i1")).drop("ids1").select("*", F.explode("ids2").alias("i2")).drop("ids2")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def collisions_of(pairs: DataFrame, table: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Collisions of given pairs ``i1``, ``i2`` (whose lengths are known to be near), looked up rather than enumerated; ``i2`` is
    of the ``other`` table, if there is one."""
    one = table.select("t", "k", "hash_id", *(F.col(c).alias(f"{c}1") for c in ("i", "q", "sig")))
    two = (table if other is None else other).select("t", "k", "hash_id", *(F.col(c).alias(f"{c}2") for c in ("i", "q", "sig")))
    met = pairs.select("i1", "i2").join(one, "i1").join(two, ["i2", "t", "k", "hash_id"]).where(signatures_agree("sig1", "sig2"))
    return met.select("i1", "i2", "q1", "q2", "t", "k")


def collision_counts(found: DataFrame) -> DataFrame:
    """``i1``, ``i2``, ``q1``, ``q2``, ``freq``: how many (random string, hash function) a pair of suffixes shares."""
    return found.groupBy("i1", "i2", "q1", "q2").agg(F.count("*").alias("freq"))


def candidate_pairs(counts: DataFrame, params: JoinParams) -> DataFrame:
    """Distinct ``i1``, ``i2`` of which some pair of suffixes collides more than ``count_filter`` times."""
    return counts.where(F.col("freq") > params.count_filter).select("i1", "i2").distinct()


#: Pairs of bucket rows whose collisions are counted in one pass: what a pass shuffles is gone from the disk before the next.
SLICE_PAIRS = 1 << 29


def counts_by_slices(table: DataFrame, params: JoinParams, last: Callable[[DataFrame], DataFrame] = lambda counts: counts) -> DataFrame:
    """``last`` of the ``collision_counts`` of the ``table``'s ``collisions``, written.

    Every collision is shuffled once to be counted, and there may be many for each pair. So pairs are counted in slices, by the first of
    them, with ``SLICE_PAIRS`` pairs of the buckets each: the disk holds the shuffle of one slice and the rows that ``last`` leaves of those
    before. ``last`` may not look at pairs of different ``i1`` together.
    """
    sizes = pair_sizes(table)
    slices = -(-int(sizes.full + sizes.rest) // SLICE_PAIRS)
    if slices <= 1:
        return cut(last(collision_counts(collisions(table, params, sizes=sizes))), "counts")
    each = Row(largest=sizes.largest, full=2 * sizes.full / slices, rest=2 * sizes.rest / slices)
    parts = []
    for n in range(slices):
        mine = table.where(F.pmod(F.xxhash64("i"), F.lit(slices)) == n)
        found = collisions(mine, params, table, each).where("i1 < i2")
        parts.append(cut(last(collision_counts(found)), "counts"))
    return _all(parts)
