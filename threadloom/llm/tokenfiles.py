"""Token ids in files: one Zstandard frame a document, a dictionary shared by all of them, an index of offsets."""

from __future__ import annotations

import gc
import hashlib
import json
import os
import struct
import sys
import uuid
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrow_text import each, frugal, quoted, runs, utf8
from threadloom.llm.warc import filesystem
from threadloom.plans.scratch import cut, scratch_path

#: First and last bytes of a file, and the version of its layout (fixed by the format).
MAGIC, VERSION = b"TLTOKENS", 1
_HEAD, _FOOT = struct.Struct("<8sII32s"), struct.Struct("<QQ8s")
#: Bounds of the sample that the dictionary is trained on (documents in expectation, characters of one), and of the dictionary.
SAMPLE_DOCS, SAMPLE_TEXT, DICTIONARY_BYTES = 2000, 1 << 14, 112 << 10
#: A file is closed once it has this many bytes.
FILE_BYTES = 64 << 20
LEVEL = 3
#: Words of a generation that a worker remembers (it has two), and the longest worth it.
CACHE_WORDS, CACHE_CHARS = 800_000, 48
#: Rows of a batch, and bytes of texts, or of frames, in one pass: a word is looked up once in each.
RUN_ROWS, RUN_BYTES = 1000, 1 << 23
#: Texts that are not words between single spaces: white space before a space, or at the beginning.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ODD = f"[{_WHITE}] |^[{_WHITE}]"


def vocabulary(path: str | None = None) -> bytes:
    """The tokenizer's JSON file; by default the public byte-level one of 50,257 ids. Its size is fixed (some MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """A tokenizer of the library, whatever its JSON says; built once in each worker.

    A byte-level one without normalizer splits a text where white space begins, so every different word is encoded once and
    remembered, in two generations: what was not met for a whole one is forgotten. Any other tokenizer, and a text
    that holds the string of an added token, goes through the library whole.
    """

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.width, self.code = (2, "H") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else (4, "I")
        split = spec.get("pre_tokenizer") or {}
        plain = not (spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or split.get("add_prefix_space"))
        self.by_word = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and spec["model"]["type"] == "BPE"
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        # Where white space follows something else: no match of the byte-level pattern goes across.
        self.gap = regex.compile(r"(?<=\S)(?=\s)")
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of each of ``words``; only new ones are handed to the library."""
        found = list(map(self.now.get, words))
        new = dict.fromkeys(w for w, ids in zip(words, found) if ids is None)
        if new:
            before, unknown = self.before.get, []
            for w in new:
                if (ids := before(w)) is None:
                    unknown.append(w)
                else:
                    new[w] = ids
            new.update(zip(unknown, self._whole(unknown)))
            self.now |= new
            found = [new[w] if ids is None else ids for w, ids in zip(words, found)]
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (none null) as little-endian unsigned integers of ``width`` bytes."""
        whole = pa.array(np.full(len(texts), not self.by_word))
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        odd = pc.match_substring_regex(texts, ODD)
        kind = np.where(whole, 2, odd)  # 0: words between single spaces, 1: white space of other kinds, 2: not by words
        out = np.empty(len(texts), object)
        out[kind == 2] = self._whole(texts.filter(pa.array(kind == 2)).to_pylist())

        parts = [self.gap.split(t) for t in texts.filter(pa.array(kind == 1)).to_pylist()]
        lists = pc.split_pattern(texts.filter(pa.array(kind == 0)), " ")
        ends, flat = lists.offsets.to_numpy(), lists.flatten()
        first = ends[:-1]
        coded = flat.dictionary_encode()
        begins, words = flat.take(pa.array(first)).to_pylist(), list(map(" ".__add__, coded.dictionary.to_pylist()))
        out[kind == 1] = [b"".join(self._known(p)) for p in parts]

        # The first word of a text has no space before it, so it is an entry of its own.
        entries = self._known(words + begins)
        at = coded.indices.to_numpy().copy()
        at[first] = np.arange(len(words), len(entries))
        size = np.fromiter(map(len, entries), np.int64, len(entries)) // self.width
        ids, start, n = np.frombuffer(b"".join(entries), f"<u{self.width}"), np.cumsum(size) - size, size[at]
        stop = np.cumsum(n)
        ids = ids[np.repeat(start[at] - (stop - n), n) + np.arange(n.sum())].tobytes()
        cut = np.concatenate(([0], stop))[ends] * self.width
        out[kind == 0] = [ids[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
        if len(self.now) > CACHE_WORDS:
            self.before, self.now = {k: v for k, v in self.now.items() if len(k) <= CACHE_CHARS}, {}
        return out.tolist()


@lru_cache(maxsize=2)
def _encoder(raw: bytes) -> Encoder:
    return Encoder(raw)


@lru_cache(maxsize=2)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared:
        shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)


@lru_cache(maxsize=2)
def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


@contextmanager
def _uncollected() -> Iterator[None]:
    """No search for cycles inside: a run makes hundreds of thousands of strings and no cycle."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Columns of rows of at most ``RUN_BYTES`` of text (or one longer text), put together from several batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    whole = lambda: [pa.concat_arrays([h.column(k) for h in held]) for k in range(2)]
    for b in batches:
        _, at = utf8(b.column(1))
        for i, j in runs(at, RUN_BYTES):
            if held and size + at[j] - at[i] > RUN_BYTES:
                yield whole()
                held, size = [], 0
            held.append(b.slice(i, j - i))
            size += at[j] - at[i]
    if held:
        yield whole()


def pack(docs: DataFrame, dictionary: bytes | None, id_col: str = "doc_id", text_col: str = "text", vocab: bytes | None = None, end_id: int = 0) -> DataFrame:
    """``doc_id``, ``n`` and ``frame`` of every row: the ids of the whole text and ``end_id``, as one compressed frame; where
    ``dictionary`` is None as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab or vocabulary(), dictionary))
    given = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, dictionary = shared.value
        encoder = _encoder(raw)
        press = (lambda x: x) if dictionary is None else _compressor(dictionary).compress
        end = encoder.pack([end_id])
        for doc, text in _together(batches):
            with _uncollected():
                ids = [x + end for x in encoder.encode(pc.fill_null(text, ""))]
            n = pa.array([len(x) // encoder.width for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([doc, n, pa.array(map(press, ids), pa.binary())], ["doc_id", "n", "frame"])

    return given.mapInArrow(frugal(run, RUN_ROWS), "doc_id long, n long, frame binary")


def train_dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: bytes | None = None, rows: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary trained on the serialized ids of about ``rows`` documents of at most ``SAMPLE_TEXT`` characters, picked by a
    hash of id and text; none where they are too few to train on. Only the sample reaches the driver."""
    share = rows / max(rows, docs.count())
    text = F.col(quoted(text_col)).cast("string")
    picked = docs.where((F.pmod(F.xxhash64(F.col(quoted(id_col)).cast("long"), text), F.lit(1 << 30)) < int(share * (1 << 30))) & F.length(text).between(1, SAMPLE_TEXT))
    samples = sorted(bytes(r.frame) for r in pack(picked, None, id_col, text_col, vocab).select("frame").collect())
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


@dataclass
class TokenFiles:
    """Files of one write: a row of ``manifest`` for each (``path``, ``start``, ``docs``, ``ids``, ``bytes``, ``first``, ``last``), in the
    order of their ids; ``start`` counts the ids of all files before it. ``dictionary`` is in a file of its own, named by its SHA-256."""

    folder: str
    manifest: DataFrame
    dictionary: bytes


class _Writer:
    """One open file: header, frames, index, footer."""

    def __init__(self, store: pafs.FileSystem, root: str, width: int, digest: bytes):
        self.name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tokens"
        self.out = store.open_output_stream(f"{root}/{self.name}", compression=None)
        self.out.write(_HEAD.pack(MAGIC, VERSION, width, digest))
        self.size = _HEAD.size
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.ends: list[int] = []

    def add(self, doc: int | None, n: int, frame: bytes) -> None:
        self.out.write(frame)
        self.size += len(frame)
        self.docs.append(doc)
        self.counts.append(n)
        self.ends.append(self.size)

    def close(self) -> tuple:
        known = [d for d in self.docs if d is not None]
        self.out.write(np.array([d if d is not None else 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is not None for d in self.docs], "<u1").tobytes())
        self.out.write(np.array(self.counts, "<i8").tobytes() + np.array(self.ends, "<i8").tobytes())
        self.out.write(_FOOT.pack(self.size, len(self.docs), MAGIC))
        self.out.close()
        return self.name, len(self.docs), sum(self.counts), self.size, min(known, default=None), max(known, default=None)


class Shard:
    """A file opened for reading: its index, and any of its documents without the others."""

    def __init__(self, store: pafs.FileSystem, path: str, dictionary: bytes):
        self.file = store.open_input_file(path)
        magic, version, self.width, digest = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        at, n, last = _FOOT.unpack(self.file.read_at(_FOOT.size, self.file.size() - _FOOT.size))
        if (magic, version, last) != (MAGIC, VERSION, MAGIC):
            raise ValueError(f"not a file of token ids: {path}")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"another dictionary than the one given was used in {path}")
        index = self.file.read_at(25 * n, at)
        self.known = np.frombuffer(index, "<u1", n, 8 * n).astype(bool)
        self.docs = np.frombuffer(index, "<i8", n)
        self.counts = np.frombuffer(index[9 * n : 17 * n], "<i8")
        self.ends = np.frombuffer(index[17 * n :], "<i8")
        self.begins = np.concatenate(([_HEAD.size], self.ends[:-1])).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.unpack = _decompressor(dictionary)

    def ids(self, k: int, data: bytes | None = None) -> np.ndarray:
        """Ids of the document at place ``k``, its end id included."""
        if data is None:
            data = self.file.read_at(int(self.ends[k] - self.begins[k]), int(self.begins[k]))
        n = int(self.counts[k])
        ids = np.frombuffer(self.unpack.decompress(data, max_output_size=n * self.width), f"<u{self.width}")
        if len(ids) != n:
            raise ValueError(f"document {k} has {len(ids)} ids and not {n}")
        return ids.astype("<u4")

    def rows(self, start: int, places: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """``doc_id``, ``start``, ``n_tokens``, ``ids`` of the documents at ``places`` (all if None), in runs of neighbours."""
        n = len(self.docs) if places is None else len(places)
        at = np.arange(n) if places is None else places
        lo = 0
        while lo < n:
            hi = lo + 1
            while hi < n and at[hi] == at[hi - 1] + 1 and self.ends[at[hi]] - self.begins[at[lo]] <= RUN_BYTES:
                hi += 1
            part, base = at[lo:hi], int(self.begins[at[lo]])
            data = self.file.read_at(int(self.ends[part[-1]]) - base, base)
            ids = [self.ids(k, data[int(self.begins[k]) - base : int(self.ends[k]) - base]).tobytes() for k in part]
            docs = pa.array(self.docs[part], pa.int64(), mask=~self.known[part])
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(self.starts[part] + start), pa.array(self.counts[part]), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"]
            )
            lo = hi


def write(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, vocab: bytes | None = None, end_id: int = 0, most: int = FILE_BYTES
) -> TokenFiles:
    """Token ids of every row's whole text, ``end_id`` after each, in files in ascending order of the id.

    Rows are encoded and compressed where they are; only frames are ranged over partitions, by id, so the order holds
    within and across files and no task sees more than a range. Each task attempt writes files of its own, and the manifest
    that Spark commits names those of successful attempts only. A null or empty text is its end id alone; null ids
    come first; rows that repeat an id stand beside each other (shorter ones first, then by their bytes), dealt to several ranges if
    there are many. A very long text is one frame. A string of an added token in a text becomes that token, as in the library.
    An empty table has a manifest without rows. Other columns, of any name, are not written. ``folder`` is any store that
    pyarrow opens and all executors share.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    raw = vocab or vocabulary()
    dictionary = train_dictionary(docs, id_col, text_col, raw)
    digest, width = hashlib.sha256(dictionary), _encoder(raw).width
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{digest.hexdigest()}.dictionary", compression=None) as out:
        out.write(dictionary)
    packed = cut(pack(docs, dictionary, id_col, text_col, raw, end_id), "frames")
    ranged = packed.repartitionByRange("doc_id", "n", F.xxhash64("frame")).sortWithinPartitions("doc_id", "n", "frame")
    sha = digest.digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        done: list[tuple] = []
        open_: _Writer | None = None
        for b in batches:
            ids, counts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for doc, n, frame in zip(ids, counts, each(b.column(2))):
                open_ = open_ or _Writer(store, root, width, sha)
                open_.add(doc, n, frame)
                if open_.size >= most:
                    done.append(open_.close())
                    open_ = None
        if open_:
            done.append(open_.close())
        part, kinds = TaskContext.get().partitionId(), [pa.string(), *[pa.int64()] * 5]
        columns = [pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)]
        place = [pa.array([part] * len(done), pa.int32()), pa.array(range(len(done)), pa.int32())]
        yield pa.RecordBatch.from_arrays([*place, *columns], ["part", "nr", "path", "docs", "ids", "bytes", "first", "last"])

    files = cut(ranged.mapInArrow(frugal(run), "part int, nr int, path string, docs long, ids long, bytes long, first long, last long"), "files")
    rows, start = [], 0
    for r in files.orderBy("part", "nr").collect():  # a row a file
        rows.append((r.path, start, r.docs, r.ids, r.bytes, r.first, r["last"]))
        start += r.ids
    manifest = spark.createDataFrame(rows, "path string, start long, docs long, ids long, bytes long, first long, last long")
    return TokenFiles(folder, cut(manifest, "manifest", len(rows)), dictionary)


_ROWS = "doc_id long, start long, n_tokens long, ids binary"


def read(files: TokenFiles) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every document,
    out of the files. Each is checked against its index, and each file against the hash of the dictionary."""
    shared = files.manifest.sparkSession.sparkContext.broadcast(files.dictionary)
    folder = files.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from Shard(store, f"{root}/{path}", shared.value).rows(start)

    named = files.manifest.select("path", "start").repartition(max(1, min(10_000, files.manifest.count())))
    return named.mapInArrow(frugal(run), _ROWS)


def lookup(files: TokenFiles, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The same columns for the ids of ``wanted`` alone (each once, null ids none): only the files that may hold one are opened,
    and of them only the index and the frames asked for are read.

    What every task gets is a row a file of the manifest; ids travel to the file that may hold them, so a file is opened by one
    task, unless its ids are many and spread over several.
    """
    sc = wanted.sparkSession.sparkContext
    known = [tuple(r) for r in files.manifest.where("first is not null").select("path", "start", "first", "last").orderBy("start").collect()]
    shared, folder = sc.broadcast((known, files.dictionary)), files.folder
    ids = wanted.select(F.col(quoted(id_col)).cast("long").alias("doc_id")).where("doc_id is not null").distinct()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0]
        first, last = (np.array([k[c] for k in known], np.int64) for c in (2, 3))
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            # Files are in the order of their ids, so those that may hold one are neighbours.
            lo, hi = np.searchsorted(last, doc, "left"), np.searchsorted(first, doc, "right")
            n = np.maximum(hi - lo, 0)
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(doc, n)), pa.array(at.astype(np.int32))], ["doc_id", "file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, dictionary = shared.value
        store, root = filesystem(folder)
        shard, at = None, -1
        for b in batches:
            doc, file = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for f in np.unique(file):
                if f != at:
                    shard, at = Shard(store, f"{root}/{known[f][0]}", dictionary), f
                yield from shard.rows(known[f][1], np.flatnonzero(shard.known & np.isin(shard.docs, doc[file == f])))

    return ids.mapInArrow(places, "doc_id long, file int").repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(run, _ROWS)
