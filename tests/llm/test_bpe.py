import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from threadloom.llm import bpe
from threadloom.llm.bpe import Codec, decode, encode, vocabulary


@pytest.fixture(scope="module")
def theirs():
    raw = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(vocabulary(), public_tokenizers.PATTERN)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    letters = "aéüZ \n\t　漢字🙂'stx.,1234½Ⅷ\u0301\u200b\x85\x0b\x1c\x00<|endoftext|>A"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1 << 18, 7])
def test_ids_are_those_of_the_ranks(codec, theirs, monkeypatch, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    for t in [*odd_texts(3000), "x" * 5000, "don't we'll " * 3000, " " * 3000, "漢" * 900]:
        ids = np.frombuffer(codec.encode(t), "<u4")
        assert ids.tolist() == theirs.encode_ordinary(t)
        assert codec.decode(ids).tobytes().decode() == t


def test_offsets_cover_each_token(codec):
    for t in odd_texts(500, 2):
        ids = np.frombuffer(codec.encode(t), "<u4")
        begin, end = codec.offsets(ids)
        for i, a, b in zip(ids, begin, end):
            token = codec.decode(np.array([i])).tobytes()
            assert token in t[a:b].encode() and (b - a == 1 or token == t[a:b].encode() or b - a <= len(token))
        assert not len(ids) or (begin[0] == 0 and end[-1] == len(t))


def test_alphabet_is_one_to_one():
    letters = bpe.byte_alphabet()
    assert len(set(letters.values())) == 256 and letters[ord("A")] == "A" and letters[0] == "Ā" and letters[32] == "Ġ"


def test_frames(documents, theirs, monkeypatch):
    texts = [None, "", *odd_texts(60, 3), "Über 漢字 " * 2000]
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    rows = [*enumerate(texts), (1, "twice"), (None, "no id")]
    got = decode(encode(documents(rows), offsets=True)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), theirs.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.row.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) == len(r.begin) == len(r.end) and r.row.score == "x" for r in got)
    both = encode(documents(rows), back=True).collect()
    assert sorted((str(r.row.doc_id), bytes(r.ids), bytes(r.decoded)) for r in both) == sorted((str(r.row.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got)
    assert encode(documents([])).count() == 0


def test_decoding_any_ids(spark, theirs):
    rng = np.random.default_rng(0)
    lists = [rng.integers(0, 50256, n) for n in (0, 1, 5, 400)]
    df = spark.createDataFrame([(k, bytearray(x.astype("<u4").tobytes())) for k, x in enumerate(lists)] + [(9, None)], "k int, ids binary")
    got = {r.k: bytes(r.decoded) for r in decode(df).collect()}
    assert got == {k: theirs.decode_bytes(x.tolist()) for k, x in enumerate(lists)} | {9: b""}
