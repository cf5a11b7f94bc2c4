"""Near copies by exact Jaccard similarity of word shingles, with min-hash bands for candidates, and by SimHash."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrow_text import each, frugal, quoted
from threadloom.llm.simhash import RADIUS, fingerprint, fingerprint_links, least_of_each
from threadloom.operators.components import connected_components
from threadloom.plans.scratch import cut, drop

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Two sets of similarity s share a band with chance 1 - (1 - s^BAND_ROWS)^BANDS: 0.999993 at 0.8, more above.
BANDS, BAND_ROWS = 30, 5
#: Sets of a bucket that one task holds against as many others.
BLOCK = 512
#: Bits of the map that tells which texts are candidates; a bit set by another text costs time only.
MAP_BITS = 1 << 24

_WALKS = np.random.default_rng(42).integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct XXH64 (seed 42) of all word shingles, sorted; words as ``simhash.fingerprint`` has them."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: 1 - words].tolist()
    pieces = map(joined.__getitem__, map(slice, begins, ends[words - 1 :].tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, len(begins)))


def bands(found: np.ndarray) -> np.ndarray:
    """One number for each band of min-hashes of a set; none for an empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(len(_WALKS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        np.minimum(least, (found[None, i : i + 2048] * _WALKS[:, None]).min(1), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)), np.uint64, BANDS).view(np.int64)


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), 42)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, simhash: bool = False) -> DataFrame:
    """``id``, ``key`` (a hash of the text), ``node`` (a hash of its set of shingles), ``bands`` and, with ``simhash``, ``fp`` (its
    fingerprint, as ``simhash.fingerprints`` has it; else null) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, words) for t in each(b.column(2))]
            node = np.fromiter(map(_node, sets), np.uint64, b.num_rows).view(np.int64)
            fp = pa.nulls(b.num_rows, pa.int64())
            if simhash:
                fp = pa.array(np.fromiter(map(fingerprint, each(b.column(2))), np.uint64, b.num_rows).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(map(bands, sets), pa.list_(pa.int64())), fp], ["id", "key", "node", "bands", "fp"])

    text = F.col(quoted(text_col)).cast("string")
    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("t")).mapInArrow(
        frugal(run), "id long, key long, node long, bands array<long>, fp long"
    )


def _sets(docs: DataFrame, keys: DataFrame, text_col: str, words: int) -> DataFrame:
    """``node`` and ``found`` (its sorted shingles) of the texts whose hash is in ``keys``, and perhaps of a few others.

    The hashes travel as a map of ``MAP_BITS`` bits, so the texts are not shuffled.
    """
    bit = F.pmod(F.col("key"), F.lit(MAP_BITS))
    words_of = keys.groupBy(F.floor(bit / 64).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {MAP_BITS}) % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[words_of.column("at").to_numpy()] = words_of.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bits = shared.value
        for b in batches:
            at = b.column(0).to_numpy() % MAP_BITS
            rows = np.flatnonzero(bits[at >> 6] >> (at & 63) & 1)
            if not len(rows):
                continue
            nodes, out = [], []
            for t in each(b.column(1).take(pa.array(rows))):
                found = shingles(t, words)
                node = _node(found)
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    out.append(found.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(out, pa.binary())], ["node", "found"])

    text = F.col(quoted(text_col)).cast("string")
    found = docs.select(F.xxhash64(text).alias("key"), text.alias("t")).mapInArrow(frugal(run), "node long, found binary")
    return found.dropDuplicates(["node"])


def forest(sets: list[np.ndarray], blocks: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of at least ``similarity``; where there are two blocks, of the pairs between them."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    rows = np.repeat(np.arange(n), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)
    which = np.cumsum(first) - 1
    many = np.bincount(which)[which] > 1 if len(values) else first
    which, rows = which[many], rows[many]
    # Only shingles of several sets count; they are numbered anew and summed up in passes.
    which = np.cumsum(np.concatenate([[1], which[1:] != which[:-1]])) - 1 if len(which) else which
    both = np.zeros((n, n), np.float32)
    top = int(which[-1]) + 1 if len(which) else 0
    step = max(64, (1 << 21) // n)
    for i in range(0, top, step):
        a, z = np.searchsorted(which, [i, i + step])
        has = np.zeros((n, min(step, top - i)), np.float32)
        has[rows[a:z], which[a:z] - i] = 1
        both += has @ has.T
    near = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    if len(set(blocks.tolist())) > 1:
        near &= blocks[:, None] != blocks[None, :]
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(*(z.tolist() for z in np.nonzero(np.triu(near, 1)))):
        a, b = root(x), root(y)
        if a != b:
            parent[a] = b
            out.append((x, y))
    return out


def similar(members: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` that connect exactly the nodes that share a bucket and have at least ``similarity``.

    ``members`` has every ``bucket`` and ``node`` once. All pairs of a bucket are compared. A bucket of more than ``block``
    nodes is dealt into blocks by hash and each two blocks meet in a task, so no task grows with a group; equal
    buckets of several bands are compared once. A task gives a spanning forest, not all pairs.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    dealt = members.join(sizes, "bucket")
    small = dealt.where("n_blocks = 1").groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    small = small.groupBy(F.xxhash64("nodes").alias("h"), "nodes").agg(F.min("bucket").alias("bucket"))
    small = small.select("bucket", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("block"), F.explode("nodes").alias("node"))
    large = dealt.where("n_blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    large = large.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node")
    tasks = cut(small.unionByName(large), "copies-tasks")
    dealt = tasks.join(sets, "node").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nodes, blocks, found = None, [], [], []

        def done() -> pa.RecordBatch:
            at = np.array(forest(found, np.array(blocks), similarity) if len(found) > 1 else [], np.int64).reshape(-1, 2)
            here = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(here[at[:, 0]]), pa.array(here[at[:, 1]])], ["a", "b"])

        for b in batches:
            for *now, block, node, s in zip(*(c.to_pylist() for c in b.columns)):
                if now != task:
                    if nodes:
                        yield done()
                    task, nodes, blocks, found = now, [], [], []
                nodes.append(node)
                blocks.append(block)
                found.append(np.frombuffer(s, "<u8"))
        if nodes:
            yield done()

    return dealt.select("bucket", "lo", "hi", "block", "node", "found").mapInArrow(frugal(run), "a long, b long")


def simhash_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links ``a``, ``b`` that connect the nodes of ``rows`` (``node``, ``fp``) whose fingerprints are equal or linked within ``radius`` bits.

    Fingerprints are compared by ``simhash.fingerprint_links``; the smallest node of each stands for it.
    """
    both = rows.select("node", "fp").distinct()
    of = cut(both.groupBy("fp").agg(F.min("node").alias("first")), "copies-fingerprints")
    equal = both.join(of, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    one, two = (of.select(F.col("fp").alias(f"fp{c}"), F.col("first").alias(c)) for c in "ab")
    near = fingerprint_links(of.select("fp"), radius).select(F.col("a").alias("fpa"), F.col("b").alias("fpb"))
    return equal.unionByName(near.join(one, "fpa").join(two, "fpb").where("a <> b").select("a", "b"))


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = SHINGLE_WORDS, radius: int | None = None
) -> DataFrame:
    """``id``, ``key`` and ``component_id`` of every row.

    ``component_id`` is the smallest id that links reach from the row. A link is a Jaccard similarity of the sets of
    word shingles of at least ``similarity``, computed in full for each two sets that share a band. Rows of equal sets are one
    node, so copies are never expanded into pairs. Texts without words have the empty set and are one node; a
    shorter text than a shingle is one shingle. Nulls, ties, repeated rows and empty tables as in ``simhash.near_duplicates``.
    With a ``radius`` rows whose SimHash fingerprints differ in that many bits at most, repeats of shingles counted, link too, whatever
    their similarity.
    """
    rows = cut(sketches(docs, id_col, text_col, words, radius is not None), "copies")
    n = rows.count()
    each_band = rows.select("node", "key", F.explode("bands").alias("bucket"))
    shared = each_band.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    members = cut(each_band.join(shared, "bucket").groupBy("bucket", "node").agg(F.min("key").alias("key")), "copies-members")
    sets = cut(_sets(docs, members.select("key"), text_col, words), "copies-sets")
    links = similar(members.select("bucket", "node"), sets, similarity)
    links = cut(links if radius is None else links.unionByName(simhash_links(rows, radius)), "copies-links")
    roots = connected_components(links)
    nodes = rows.groupBy("node").agg(F.min("id").alias("least"))
    rooted = nodes.join(roots.withColumnRenamed("node", "_tl_node"), F.col("node") == F.col("_tl_node"), "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    rooted = cut(rooted, "copies-roots", n)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = cut(rows.select("id", "key", "node").join(rooted.join(named, "root").select("node", "component_id"), "node").select("id", "key", "component_id"), "copies-found", n)
    for frame in (rows, members, sets, links, rooted):
        drop(frame)
    return found


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int | None = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component of ``near_copies``, all columns unchanged, as ``simhash.drop_near_duplicates`` picks it."""
    return least_of_each(docs, near_copies(docs, id_col, text_col, similarity, radius=radius), id_col, text_col)
