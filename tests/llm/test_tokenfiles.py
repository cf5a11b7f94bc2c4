import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from threadloom.llm import tokenfiles
from threadloom.llm.tokenfiles import Encoder, Shard, lookup, read, train_dictionary, vocabulary, write
from threadloom.llm.warc import filesystem

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    letters = "aéüZ \n\t　漢字🙂'stx.,1234½Ⅷ́​\x85\x0b\x1c\x1f\x00 \xa0A"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) + "<|endoftext|>!" * (k % 9 == 0) for k in range(n)]


@pytest.mark.parametrize("words", [250_000, 60])
def test_ids_are_the_librarys(theirs, monkeypatch, words):
    monkeypatch.setattr(tokenfiles, "CACHE_WORDS", words)
    encoder = Encoder(vocabulary())
    texts = [*odd_texts(3000), "", "x" * 5000, "don't we'll " * 3000, " " * 3000, "漢" * 900, "a  b   c\n d"]
    for i in range(0, len(texts), 100):
        got = encoder.encode(pa.array(texts[i : i + 100]))
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [theirs.encode(t, add_special_tokens=False).ids for t in texts[i : i + 100]]


def test_any_tokenizer(theirs):
    raw = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
    other = Tokenizer.from_str(raw.decode())
    texts = ["Some  words, lower CASE.", "", "x\ny"]
    assert [np.frombuffer(x, "<u2").tolist() for x in Encoder(raw).encode(pa.array(texts))] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def want_of(theirs, rows):
    ids = [(i, theirs.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]
    return sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))


def same(found, want):
    rows = found.orderBy("start").collect()
    assert [r.n_tokens for r in rows] == [len(x) for _, x in want]
    assert [r.start for r in rows] == np.cumsum([0, *[len(x) for _, x in want]])[:-1].tolist()
    assert [r.doc_id for r in rows] == [i for i, _ in want]
    by_id = lambda pairs: sorted((str(i), x) for i, x in pairs)  # noqa: E731 (rows of one id and length in any order)
    assert by_id((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == by_id(want)


@pytest.mark.parametrize("most", [64 << 20, 3000])
def test_round_trip(spark, documents, theirs, prose, most):
    rows = [(k * 7 - 40, prose(k, 20 + k % 50)) for k in range(300)]
    rows += [(5, None), (5, ""), (5, "twice"), (None, "no id"), (None, None), (9000, prose(1, 30_000)), (2**62, "far"), *enumerate(odd_texts(40))]
    random.Random(3).shuffle(rows)
    files = write(documents(rows), most=most)
    want = want_of(theirs, rows)
    same(read(files), want)
    assert (files.manifest.count() > 8) == (most == 3000)
    manifest = files.manifest.orderBy("start").collect()
    assert [m.start for m in manifest] == np.cumsum([0, *[m.ids for m in manifest]])[:-1].tolist() and sum(m.docs for m in manifest) == len(rows)
    wanted = spark.createDataFrame([(5,), (9000,), (9000,), (None,), (-33,), (123456789,)], "other long").withColumnRenamed("other", "x.y")
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.start) for r in lookup(files, wanted, "x.y").collect())
    starts = {(r.doc_id, bytes(r.ids)): r.start for r in read(files).collect()}
    assert [(i, x) for i, x, _ in got] == sorted((i, x) for i, x in want if i in (5, 9000, -33))
    assert all(starts[i, np.array(x, "<u4").tobytes()] == s or i == 5 for i, x, s in got)


def test_a_document_alone(spark, documents, theirs, prose):
    files = write(documents([(k, prose(k, 200)) for k in range(60)]))
    assert len(files.dictionary) > 256
    store, root = filesystem(files.folder)
    with store.open_input_stream(f"{root}/{hashlib.sha256(files.dictionary).hexdigest()}.dictionary") as f:
        assert f.read() == files.dictionary
    path = files.manifest.first().path
    shard = Shard(store, f"{root}/{path}", files.dictionary)
    k = len(shard.docs) // 2
    assert shard.ids(k).tolist() == theirs.encode(prose(int(shard.docs[k]), 200), add_special_tokens=False).ids + [0]
    with pytest.raises(ValueError, match="dictionary"):
        Shard(store, f"{root}/{path}", b"other")
    with store.open_output_stream(f"{root}/broken") as f:
        f.write(b"x" * 100)
    with pytest.raises(ValueError, match="not a file"):
        Shard(store, f"{root}/broken", files.dictionary)


def test_small_and_empty_tables(documents):
    assert train_dictionary(documents([])) == b""
    files = write(documents([]))
    assert files.manifest.count() == 0 and read(files).count() == 0 and lookup(files, documents([(1, "x")])).count() == 0
    one = read(write(documents([(3, None)]))).collect()
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in one] == [(3, 0, 1, b"\0\0\0\0")]


def test_op11_as_registered(spark, theirs):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want, start = {}, 0
    for i, x in want_of(theirs, rows):
        want[i] = (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    got = __spark_entry__.queries()["op11_tokens"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
