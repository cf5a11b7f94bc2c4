"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrow_text import each, frugal, quoted
from threadloom.operators.components import connected_components
from threadloom.plans.scratch import cut

SHINGLE_WORDS = 3
RADIUS = 2
#: A fingerprint's tile is the population counts of this many equal parts of it; more parts for more fingerprints.
PARTS, FINE_PARTS, FINE_FROM = 4, 8, 1 << 24
#: Fingerprints in a tile before it is dealt into several.
TILE_ROWS = 2048


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; 0 without words.

    Only A-Z is lower-cased and words part at ASCII white space, which is what ``bytes`` methods do.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: 1 - words].tolist()
    pieces = map(joined.__getitem__, map(slice, begins, ends[words - 1 :].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, len(begins))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((ones * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``id``, ``key`` (a hash of the text) and ``fp`` (the fingerprint as a signed 64-bit integer) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in each(b.column(2))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["id", "key", "fp"])

    text = F.col(quoted(text_col)).cast("string")
    given = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("t"))
    return given.mapInArrow(frugal(run), "id long, key long, fp long")


def _tile(fp: str, parts: int) -> F.Column:
    """Population counts of the parts, as the digits of one number."""
    bits = 64 // parts
    code = F.lit(0).cast("long")
    for i in range(parts):
        part = F.shiftrightunsigned(fp, i * bits).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        code = code * (bits + 1) + F.bit_count(part)
    return code


def tile_steps(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Half of the changes of the population counts that ``radius`` differing bits can cause, zero first."""
    near = [s for s in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, s)) <= radius]
    return [s for s in near if s >= (0,) * parts]


def _links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside ``left`` or between both; the pairs themselves stay here."""
    other = left if right is None else right
    n = len(left)
    parent = list(range(n + (0 if right is None else len(other))))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []
    step = max(1, (1 << 20) // max(1, len(other)))
    for i in range(0, n, step):
        close = np.bitwise_count(left[i : i + step, None] ^ other[None, :]) <= radius
        for x, y in zip(*(z.tolist() for z in np.nonzero(close))):
            x += i
            if right is None and y <= x:
                continue
            a, b = find(x), find(y if right is None else n + y)
            if a != b:
                parent[a] = b
                out.append((x, y))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    at = np.array(out)
    return left[at[:, 0]], other[at[:, 1]]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, parts: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links ``a``, ``b`` that connect exactly the fingerprints (column ``fp``, distinct) within ``radius`` bits.

    A tile holds the fingerprints whose parts have the same population counts. Two fingerprints that differ in
    ``radius`` bits lie in tiles whose counts differ by ``radius`` in sum at most, so all other tile pairs are
    skipped; what is left is compared in full. Four parts make at most 17^4 = 83,521 tiles, which is the proven bound of
    the one broadcast here; with eight parts, for more than 2^24 fingerprints, the tiles' sizes are joined instead. Large
    tiles are dealt into blocks by hash, so no task gets a group that grows with the corpus. A tile pair gives a
    spanning forest of its links, not all pairs.
    """
    n = distinct.count()
    if parts is None:
        parts = PARTS if n <= FINE_FROM else FINE_PARTS
    small = F.broadcast if parts <= PARTS else lambda df: df
    bits = 64 // parts
    tiled = distinct.select("fp", _tile("fp", parts).alias("tile"))
    sizes = cut(tiled.groupBy("tile").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("n_blocks")), "tiles", n)
    blocks = cut(
        tiled.join(small(sizes), "tile")
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int"))
        .groupBy("tile", "block")
        .agg(F.collect_list("fp").alias("fps")),
        "blocks",
        n,
    )
    weights = [(bits + 1) ** (parts - 1 - i) for i in range(parts)]
    counts = [F.floor(F.col("tile") / w) % (bits + 1) for w in weights]
    nears = []
    for s in tile_steps(parts, radius):
        inside = F.lit(True)
        for c, d in zip(counts, s):
            inside = inside & (c + d).between(0, bits)
        nears.append(F.when(inside, F.col("tile") + sum(d * w for d, w in zip(s, weights))))
    left = blocks.select("tile", "block", "fps", F.explode(F.array_compact(F.array(*nears))).alias("tile2"))
    pairs = (
        left.join(small(sizes.withColumnRenamed("tile", "tile2")), "tile2")
        .withColumn("block2", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .where("tile < tile2 or tile > tile2 or block <= block2")
        .join(blocks.select(F.col("tile").alias("tile2"), F.col("block").alias("block2"), F.col("fps").alias("fps2")), ["tile2", "block2"])
        .select("fps", "fps2", F.expr("tile = tile2 and block = block2").alias("same"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = b.column(0)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                y = None if b.column(2)[i].as_py() else b.column(1)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                p, q = _links(x, y, radius)
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(q.view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(frugal(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """``id``, ``key``, ``fp`` and ``component_id`` of every row.

    ``component_id`` is the smallest id that links of at most ``radius`` differing bits reach from the row's
    fingerprint; rows of equal fingerprints are one node, so copies are never expanded into pairs. Null and empty
    texts have fingerprint zero and are linked like any other. A null id is kept; it is never the smallest unless
    its component has no other. Repeated rows stay repeated. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words), "simhash")
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes", fps.count())
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(found, "fp").select("id", "key", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component, all columns unchanged: the one with its smallest id.

    Of rows that share that id the smallest text hash decides, and of rows equal in id and text one stays. A null
    id counts as larger than all others.
    """
    return least_of_each(docs, near_duplicates(docs, id_col, text_col, radius), id_col, text_col)


def least_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each ``component_id`` of ``found`` (``id``, ``key``) that ``drop_near_duplicates`` keeps."""
    last = F.lit((1 << 63) - 1)
    best = found.groupBy("component_id").agg(F.min(F.struct(F.coalesce("id", last).alias("_tl_id"), F.col("key").alias("_tl_key"))).alias("r"))
    copies = found.groupBy(F.coalesce("id", last).alias("_tl_id"), F.col("key").alias("_tl_key")).agg(F.count("*").alias("n"))
    best = cut(best.select("r.*").join(copies, ["_tl_id", "_tl_key"]), "simhash-kept")
    keyed = docs.withColumns({"_tl_id": F.coalesce(F.col(quoted(id_col)).cast("long"), last), "_tl_key": F.xxhash64(F.col(quoted(text_col)).cast("string"))})
    on = ["_tl_id", "_tl_key"]
    kept = keyed.join(best.where("n = 1"), on, "left_semi")
    if best.where("n > 1").limit(1).count():
        kept = kept.unionByName(keyed.join(best.where("n > 1"), on, "left_semi").dropDuplicates(on))
    return kept.select(*map(quoted, docs.columns))
