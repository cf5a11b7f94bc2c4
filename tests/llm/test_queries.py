"""Every opN query as it is registered, against its contract by slow versions."""

import hashlib
import json
import math
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
import xxhash

import __spark_entry__
from threadloom.llm import bpe, language, queries, toxicity, urls

SF = "/root/testdata/sf0.001"
OUT = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


@pytest.fixture(scope="module")
def tables():
    return {t: duckdb.sql(f"SELECT * FROM '{SF}/{t}.parquet'").fetchall() for t in ("documents", "pages", "labels")}


@pytest.fixture(scope="module")
def documents_(tables):
    return [(i, t) for i, t, *_ in tables["documents"]]


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF).collect()


def crc(i):
    return zlib.crc32(str(i).encode())


def rule_of(host, path):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(((r, rules[r]) for r in fits), key=lambda x: len(x[0]), default=(None, None))


def test_op1(spark, tables):
    model = urls.fit(spark.read.parquet(f"{SF}/pages.parquet"), queries.URL_RULES, html_col="html")
    got = {r.page_id: r for r in run(spark, "op1_urls")}
    assert set(got) == {p for p, *_ in tables["pages"]}
    for page, url, _ in tables["pages"]:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match("[^/?#]*", rest).group())
        path = re.match("[^?#]*", rest[len(host) :]).group()
        rule, action = rule_of(host, path)
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (action or ("block" if model.score(model.tokens(host, path)) > 0.5 else "allow"))


def slow_language(model, text):
    """Mean of the subwords' weights, one at a time."""
    text = text.encode()
    folded = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text)
    total, n = np.zeros(len(model.langs)), 0
    for word in folded.split(b" "):
        if not word:
            continue
        word = b" " + word + b" "
        for k in language.ORDERS:
            for i in range(len(word) - k + 1):
                gram = word[i : i + k]
                code = int.from_bytes(gram, "little") ^ (k - 1)
                bucket = ((code * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - language.BUCKET_BITS)
                total += model.weights[bucket or 1].astype(float)
                n += 1
    z = (total / max(1, n) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return p / p.sum()


def test_op2(spark, documents_):
    model = queries.language_model(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r for r in run(spark, "op2_language")}
    assert set(got) == {i for i, _ in documents_}
    for i, text in documents_:
        r = got[i]
        assert r.held_out == (crc(i) % 3 == 1) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        p = slow_language(model, text)
        assert r.lang_pred == model.langs[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-6
        assert math.isclose(r.score, p.max(), rel_tol=1e-4)


def slow_segments(scores):
    """Maximal scoring segments by their definition: the best one, then the same in what is left on either side of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2] + 1e-12):
                best = (i, j + 1, total)
    if best is None:
        return []
    i, j, _ = best
    return slow_segments(scores[:i]) + [best] + [(a + j, b + j, s) for a, b, s in slow_segments(scores[j:])]


def test_op5(spark, documents_):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(queries._bucket("doc_id", 5) != 0))
    got = {r.doc_id: r for r in run(spark, "op5_toxicity")}
    assert set(got) == {i for i, _ in documents_}
    checked = 0
    for i, text in documents_:
        r = got[i]
        assert r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if len(words) > 120:
            continue
        scores = []
        for k, w in enumerate(words):
            s = model.words[w] if w in model.words else model.stems.get(w[: toxicity.STEM], 0.0)
            scores.append(-toxicity.DRIFT if k and words[k - 1] == w else s - toxicity.DRIFT)
        beyond = [-math.log(max(1e-300, model.scale * max(1, len(words)) * math.exp(-model.decay * s))) for _, _, s in slow_segments(scores)]
        x, y = min(30.0, max([0.0, *beyond])), math.log1p(sum(b for b in beyond if b > -math.log(toxicity.SIGNIFICANT)))
        a, b, c = model.weights
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * x + c * y)))), rel_tol=1e-6, abs_tol=1e-12)
        checked += 1
    assert checked > 20


def test_op9(spark, documents_):
    got = {r.doc_id: r for r in run(spark, "op9_simhash")}
    prints = {}
    for i, text in documents_:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i].fingerprint == f"{prints[i]:016x}"
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in ids}


def test_op10(spark, documents_):
    import public_tokenizers

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary()), special_tokens={})
    got = {r.doc_id: r for r in run(spark, "op10_bpe")}
    assert len(got) == len(documents_)
    for i, text in documents_:
        ids = own.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(own.decode_bytes(ids)).hexdigest()


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n.startswith("op")))
def test_columns_of_the_contract(spark, name):
    want = {
        1: "page_id host path rule verdict", 2: "doc_id held_out lang_pred score", 3: "doc_id n_words n_hit n_items items_sha256 contaminated",
        4: "vec_id n_links component_id kept", 5: "doc_id held_out score predicted", 6: "doc_id n_words n_removed kept_sha256", 7: "conv_id turn",
        8: "page_id payload_bytes payload_digest record_type refers_to", 9: "doc_id fingerprint component_id", 10: "doc_id n_tokens ids_sha256 decoded_sha256",
        11: "doc_id start n_tokens ids_crc32", 12: "lang source part item value rank",
        13: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    }
    found = dict(__spark_entry__.queries()[name](spark, SF).dtypes)
    assert set(want[int(name[2:].split("_")[0])].split()) <= set(found)
    kinds = {"held_out": "boolean", "score": "double", "predicted": "int", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "contaminated": "boolean", "n_links": "bigint", "n_removed": "bigint", "payload_bytes": "bigint", "refers_to": "bigint", "n_tokens": "bigint", "kept": "boolean"}
    assert all(found[c] == kinds[c] for c in found if c in kinds)


ODD = "doc_id long, text string, `my col` int, `n-chars` int, `a.b` string, row string, kept string, items string, lang string, n_chars long, `x``y` int"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "c", "r", "k", "i", "en", len(t or ""), 3) for i, t in rows], ODD)


def test_odd_names_in_every_operator(spark, prose):
    from threadloom.llm import copies, decontaminate, repeats, simhash

    rows = [(k, prose(k, 45)) for k in range(12)] + [(20, prose(3, 45)), (20, prose(3, 45)), (None, None), (21, "")]
    docs = odd(spark, rows)
    bench = spark.createDataFrame([(1, " ".join(prose(2, 45).split()[5:20]))], "item_id long, text string")
    found = {
        "language": language.identify(docs, language.fit(docs)),
        "toxicity": toxicity.score_toxicity(docs, toxicity.Model({}, {})),
        "decontaminate": decontaminate.contamination(docs, bench),
        "repeats": repeats.without_repeats(docs),
        "bpe": bpe.encode(docs, offsets=True, back=True),
        "urls": urls.judge(docs, urls.Model({}, {}, 0.0), queries.URL_RULES, url_col="text"),
    }
    for name, df in found.items():
        out = df.collect()
        assert len(out) == len(rows), name
        assert {(r.row["my col"], r.row["n-chars"], r.row["a.b"], r.row["row"], r.row["x`y"]) for r in out} == {(1, 2, "c", "r", 3)}, name
    for keep in (simhash.drop_near_duplicates, copies.drop_near_copies):
        left = keep(docs)
        assert left.columns == docs.columns and sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(map(str, [*range(12), 21]))
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    twice = bpe.decode(bpe.decode(odd(spark, [(1, "a b")]).withColumnRenamed("text", "t").selectExpr("`my col`", "`a.b`", "cast(null as binary) AS ids")))
    assert twice.columns == ["my col", "a.b", "ids", "decoded"] and twice.count() == 1


def test_odd_names_in_the_pipeline(spark, tmp_path, prose):
    import corpus_pipeline

    rows = [(k, prose(k, 60)) for k in range(10)] + [(30, prose(4, 60)), (None, None), (31, "")]
    odd(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(prose(2, 60).split()[5:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [k for k in range(10) if k != 2]


def test_settings_of_the_session_stay(spark, prose):
    before = dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    bpe.encode(odd(spark, [(1, prose(1, 9))])).count()
    language.identify(odd(spark, [(1, prose(1, 9))]), None).count()
    after = dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    assert {k: v for k, v in after.items() if "checkpoint" not in k} == {k: v for k, v in before.items() if "checkpoint" not in k}
    assert json.dumps(sorted(after))
