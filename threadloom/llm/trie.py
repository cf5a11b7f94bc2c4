"""Conversation prefix trie: mergeable node tables keyed by the hash of a prefix, and their rollup from the leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrow_text import quoted
from threadloom.plans.running import PART, in_ranges, running
from threadloom.plans.scratch import cut

#: Partial tries that one round of merging makes one of.
FAN = 64
#: Ids of a list's part.
LIST_IDS = 8192
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["k1", "k2"]


def ordered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``c``, ``pos`` (from 0), ``digest`` and ``bytes`` of every turn: its place in its conversation, the MD5 of role and text, and the text's length.

    Turns are ordered by ``turn`` (null first), ties by role, then by the digest. A null role or text is empty; a row without a conversation's id
    is part of none and left out. Only digests are sorted, and a conversation of any length spans several ranges.
    """
    role, text = (F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8")))
    rows = conversations.select(
        F.col(quoted(id_col)).cast("long").alias("c"), F.col(quoted(turn_col)).alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    ).where("c is not null")
    found = running(in_ranges(rows, "c", "turn", "role", "digest"), "c", ["turn", "role", "digest"], pos=("sum", F.lit(1).cast("long")))
    return found.select("c", (F.col("pos") - 1).alias("pos"), "digest", "bytes")


def with_heads_of(turns: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """``turns`` (of ``ordered``) rebuilt: a conversation ``c`` begins with the first ``taken`` turns (``most`` at most) of conversation ``base`` and goes
    on with its own after its first ``taken``. Both are columns over ``c``; a conversation that is a base has itself as base.

    A base that is shorter gives what it has, one that is absent nothing. Of other conversations' turns only the first ``most`` of bases travel.
    """
    sizes = turns.groupBy("c").agg(F.count("*").alias("n"))
    known = sizes.select("c", base.alias("b"), taken.cast("long").alias("h"))
    heads = turns.where((F.col("pos") < most) & (base == F.col("c"))).withColumnRenamed("c", "b")
    begin = known.join(heads, "b").where(F.col("pos") < F.col("h")).select("c", "pos", "digest", "bytes")
    # Own turns move up where the base has fewer turns than are taken; few conversations have such a base.
    has = F.least(F.coalesce("n", F.lit(0)), F.col("h"))
    moved = known.join(sizes.select(F.col("c").alias("b"), "n"), "b", "left").select("c", (has - F.col("h")).alias("by")).where("by < 0")
    rest = turns.where(F.col("pos") >= taken).join(moved, "c", "left")
    return begin.unionByName(rest.select("c", (F.col("pos") + F.coalesce("by", F.lit(0))).alias("pos"), "digest", "bytes"))


def merged(partial: DataFrame, parts: int) -> DataFrame:
    """Node tables of partitions (``part``) as one: every round adds up the tables of ``FAN`` neighbours by key, so a node that all of them
    hold (the first turn of most conversations) never has more than that many rows in one task."""
    while True:
        parts = -(-parts // FAN)
        keys = KEY if parts <= 1 else [*KEY, "part"]
        partial = partial.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy(*keys).agg(
            F.sum("n").alias("n"), F.min("owner").alias("owner"), *(F.min(x).alias(x) for x in ("depth", "bytes", "p1", "p2"))
        )
        if parts <= 1:
            return partial


def end_lists(ends: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``ends_sha256``: SHA-256 of the ids ``c`` of each key in numerical order, comma-joined.

    Ids are sorted over ranges and joined to parts of ``LIST_IDS`` where they are, so a list of any length is sorted and spelled out by many tasks; a hash
    is sequential, and the one task that computes it reads the parts one after the other.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, c = (b.column(k).to_numpy() for k in range(3))
            new = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            at = np.unique(np.concatenate([[0], new, np.arange(0, len(c), LIST_IDS)])) if len(c) else np.empty(0, int)
            ids = [",".join(map(str, c[i:j].tolist())) for i, j in zip(at, [*at[1:], len(c)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in (k1, k2, c)), pa.array(ids, pa.string())], ["k1", "k2", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, sha = None, None
        names, kinds = ["k1", "k2", "ends_sha256"], [pa.int64(), pa.int64(), pa.string()]
        table = lambda: pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names)
        for b in batches:
            for k1, k2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if key == (k1, k2):
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = (k1, k2), hashlib.sha256(ids.encode())
            yield table()
            done.clear()
        if key is not None:
            done.append((*key, sha.hexdigest()))
        yield table()

    sorted_ = ends.select(*KEY, "c").repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c")
    parts = sorted_.mapInArrow(spell, "k1 long, k2 long, first long, ids string")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Every node of the trie of the conversations ``ids`` (``c``, each once) with ``turns`` (of ``ordered``): ``conv_id`` (its smallest member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    A node's key is the exclusive-or of the 128-bit hashes of (turn, depth) along its path, a running aggregate over ranges of rows, and its
    parent's key is its own without the last term. Spark's map-side aggregation makes a node table of each partition, which ``merged`` adds
    up. The rollup needs no round for each depth: a node counts at its smallest member, whose nodes are a tail of its path, so
    what lies below any node is the sum over its members of what each has to count from there on, a running sum from the last
    turn to the first. Turns go by hash, so two different prefixes are one if both halves collide (chance about 2**-128 a pair).

    A conversation without turns ends at the root; an empty table has no node. Repeated rows are turns of their own.
    """
    key = [F.xxhash64(F.lit(seed), "digest", F.col("pos")) for seed in (1, 2)]
    ranged = in_ranges(turns, "c", "pos")
    parts = ranged.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = running(ranged, "c", ["pos"], k1=("bit_xor", key[0]), k2=("bit_xor", key[1]))
    rows = cut(rows.select("c", (F.col("pos") + 1).alias("depth"), "bytes", PART, *KEY, *(F.col(k).bitwiseXOR(y).alias(p) for k, y, p in zip(KEY, key, ("p1", "p2")))), "prefixes")

    single = rows.select(*KEY, F.col(PART).alias("part"), F.lit(1).cast("long").alias("n"), F.col("c").alias("owner"), "depth", "bytes", "p1", "p2")
    nodes = merged(single, int(parts))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = ids.agg(F.count("*").alias("n"), F.min("c").alias("owner")).where("n > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), "n", "owner", zero.alias("depth"), zero.alias("bytes"), none.alias("p1"), none.alias("p2"))
    nodes = cut(nodes.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children")).withColumnsRenamed({"p1": "k1", "p2": "k2"})
    nodes = cut(nodes.join(children, KEY, "left").na.fill(0, ["n_children"]), "counted")

    own = F.col("c") == F.col("owner")
    leaf = F.when(own & (F.col("n_children") == 0), 1).otherwise(0).cast("long")
    saved = F.when(own, (F.col("n") - 1) * F.col("node_bytes")).otherwise(0).cast("long")
    met = rows.select("c", "depth", *KEY).join(nodes.select(*KEY, "n", "owner", "n_children", F.col("bytes").alias("node_bytes")), KEY)
    met = in_ranges(met.select("c", (-F.col("depth")).alias("up"), *KEY, leaf.alias("leaf"), saved.alias("save")), "c", "up")
    below = running(met, "c", ["up"], leaves=("sum", F.col("leaf")), saves=("sum", F.col("save")))
    below = below.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saves").alias("saved_tokens"))
    # The root is a leaf where there is no turn at all.
    leaves = F.when(F.count("*") == 0, 1).otherwise(F.sum("leaf")).cast("long")
    top = met.agg(leaves.alias("n_leaves"), F.coalesce(F.sum("save"), zero).alias("saved_tokens"))
    top = top.select(zero.alias("k1"), zero.alias("k2"), "n_leaves", "saved_tokens")
    below = below.unionByName(top)

    last = rows.groupBy("c").agg(F.max_by(F.struct(*KEY), "depth").alias("end"))
    ends = ids.join(last, "c", "left").select("c", *(F.coalesce(F.col(f"end.{k}"), zero).alias(k) for k in KEY))
    up = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent_conv_id"))
    out = nodes.join(below, KEY).join(up, ["p1", "p2"], "left").join(end_lists(ends), KEY, "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
