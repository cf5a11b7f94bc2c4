"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrow_text import apart, beside, each, frugal, quoted, runs, utf8

#: Pieces of a generation that a worker remembers (it has two), and the longest piece worth it.
CACHE_PIECES, CACHE_CHARS = 100_000, 48
#: Bytes of texts or ids in one pass.
RUN_BYTES = 1 << 20
#: Characters split at once.
CHUNK = 1 << 18


def byte_alphabet() -> dict[int, str]:
    """One printable character for each byte: bytes that are printable Latin-1 stand for themselves, the others
    take the characters from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every way to put a token together from two others, in order of the token's rank: a merge by ranks may join
    any two neighbours whose bytes form a token."""
    out = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        ways = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        out += sorted(ways, key=lambda w: (ranks[w[0]], ranks[w[1]]))
    return out


class Codec:
    """Encodes texts by ranks and decodes ids; built once in each worker from the bytes of the vocabulary file."""

    def __init__(self, raw: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(raw)
        letters = byte_alphabet()
        word = lambda token: "".join(map(letters.__getitem__, token))
        model = models.BPE(
            vocab={word(t): r for t, r in ranks.items()}, merges=[(word(a), word(b)) for a, b in merges_of(ranks)], ignore_merges=True
        )
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        self.gap = regex.compile(r"(?<=\S)(?=\s)")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        size = max(ranks.values(), default=-1) + 1
        # What the library has for each id, in its byte alphabet; the reversed table turns its characters into bytes again.
        back = np.zeros(max(map(ord, letters.values())) + 1, np.uint8)
        back[[ord(c) for c in letters.values()]] = list(letters)
        table = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.length = np.fromiter(map(len, table), np.int64, size)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = back[np.frombuffer("".join(table).encode("utf-32-le"), "<u4")]

    def _chunks(self, text: str) -> Iterator[str]:
        """Parts that end where a space follows something else: no match of the pattern goes across such a place."""
        at = 0
        while len(text) - at > CHUNK:
            cut = self.gap.search(text, at + CHUNK)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for chunk in self._chunks(text):
            pieces = self.pattern.findall(chunk)
            found = self.known
            new = [p for p in set(pieces).difference(found) if not self._recall(p)]
            if new:
                encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
                found |= ((p, struct.pack(f"<{len(ids)}I", *ids)) for p, ids in zip(new, (e.ids for e in encoded)))
            out.append(b"".join(map(found.__getitem__, pieces)))
            for piece in new:
                if len(piece) > CACHE_CHARS:
                    del found[piece]
            if len(found) > CACHE_PIECES:
                self.older, self.known = found, {}
        return b"".join(out)

    def _recall(self, piece: str) -> bool:
        """Takes over what the generation of pieces before this one knew."""
        ids = self.older.get(piece)
        if ids is not None:
            self.known[piece] = ids
        return ids is not None

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, by the reversed byte table, in one array; characters that tokens split come together again here."""
        n = self.length[ids]
        end = np.cumsum(n)
        if not len(end) or not end[-1]:
            return np.empty(0, np.uint8)
        return self.flat[np.repeat(self.begin[ids] - (end - n), n) + np.arange(end[-1])]

    def decode_column(self, packed: pa.Array) -> pa.Array:
        """Bytes of each row's packed ids."""
        data, ends = utf8(packed)
        ids = np.frombuffer(data.tobytes(), "<u4")
        at = np.concatenate(([0], np.cumsum(self.length[ids]))).astype(np.int64)[ends >> 2]
        whole = self.decode(ids)
        return pa.Array.from_buffers(pa.large_binary(), len(packed), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(whole.tobytes())]).cast(pa.binary())

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; a character that several tokens share
        belongs to each of them."""
        data, end = self.decode(ids), np.cumsum(self.length[ids])
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        begin = end - self.length[ids]
        first = lead[np.minimum(begin + 1, len(data))] - 1
        return np.where(begin < end, first, lead[end]), lead[end]


@lru_cache(maxsize=2)
def _codec(raw: bytes, pattern: str) -> Codec:
    return Codec(raw, pattern)


def vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file; by default the public multilingual one. Its size is fixed (under 1 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return pattern


def encode(docs: DataFrame, text_col: str = "text", vocab: bytes | None = None, pattern: str | None = None, offsets: bool = False, back: bool = False) -> DataFrame:
    """``row`` (all columns but the text), ``n_tokens`` and ``ids`` (packed little-endian 32-bit) of every row.

    With ``offsets`` also ``begin`` and ``end``, packed alike: the characters that each token covers. With ``back`` also
    ``decoded``, what ``decode`` makes of the ids, without sending them to a second worker for it. A null or
    empty text has no tokens. Special tokens' strings are ordinary text; of pieces whose merges tie the leftmost goes first, as
    the ranks have it. A text of any length is split where no match of the pattern crosses, so memory follows the batch.
    Repeated rows are encoded alike, an empty table gives an empty result, and columns of any name travel in ``row``.
    """
    given = apart(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocab or vocabulary())
    pattern = _pattern(pattern)
    names = ["row", "n_tokens", "ids", *["begin", "end"] * offsets, *["decoded"] * back]
    schema = beside(given, "n_tokens long" + "".join(f", {n} binary" for n in names[2:]), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for b in batches:
            _, at = utf8(b.column(1))
            for i, j in runs(at, RUN_BYTES):
                part = b.slice(i, j - i)
                ids = [codec.encode(t.decode()) for t in each(part.column(1))]
                columns = [part.column(0), pa.array([len(x) >> 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if offsets:
                    spans = [codec.offsets(np.frombuffer(x, "<u4")) for x in ids]
                    columns += [pa.array([s[k].astype("<u4").tobytes() for s in spans], pa.binary()) for k in range(2)]
                if back:
                    columns.append(codec.decode_column(columns[2]))
                yield pa.RecordBatch.from_arrays(columns, names)
        codec.older = {}

    return given.mapInArrow(frugal(run), schema)


def decode(encoded: DataFrame, ids_col: str = "ids", vocab: bytes | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` with a further binary column ``decoded`` (one of that name is replaced): the bytes of the ids. A null is no
    ids, an id beyond the vocabulary an error.

    Bytes, because ids need not end where a character does; ``decode(decoded, 'UTF-8')`` gives text.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocab or vocabulary())
    pattern = _pattern(pattern)
    rest = [c for c in encoded.columns if c != "decoded"]
    names = [f"c{k}" for k in range(len(rest))]
    given = encoded.select(*(F.col(quoted(c)).alias(k) for c, k in zip(rest, names)))
    at = rest.index(ids_col)
    schema = beside(given, "decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for b in batches:
            _, offsets = utf8(b.column(at))
            for i, j in runs(offsets, RUN_BYTES):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, codec.decode_column(part.column(at))], [*names, "decoded"])

    return given.mapInArrow(frugal(run), schema).toDF(*rest, "decoded")
