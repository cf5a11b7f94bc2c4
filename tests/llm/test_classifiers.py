import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import language, toxicity
from threadloom.llm.arrow_text import utf8
from threadloom.llm.language import Model, fit, identify, subwords

SYLLABLES = {"aa": "ka lo mi tu re", "bb": "sch ein ung ver ich", "cc": "eau que oui ais ment"}


def sentence(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    return [(k, sentence(rng, lang, rng.randrange(4, 80)), lang) for k in range(240) for lang in [rng.choice(sorted(SYLLABLES))]]


def test_language_held_out_accuracy_and_edges(spark, corpus):
    docs = spark.createDataFrame([(i, t, lang, 1.0) for i, t, lang in corpus], "doc_id long, text string, lang string, score double")
    model = fit(docs.where("doc_id % 3 <> 1"))
    assert model.langs == sorted(SYLLABLES)
    odd = [(900, None), (901, ""), (902, "123 !? ٣"), (903, "x" * 300_000), (904, sentence(random.Random(1), "bb", 60_000)), (904, "ka lo")]
    more = spark.createDataFrame([(i, t, None, 0.5) for i, t in odd], docs.schema)
    got = identify(docs.unionByName(more), model).collect()
    truth = {i: lang for i, _, lang in corpus}
    held = [r for r in got if r.row.doc_id in truth and r.row.doc_id % 3 == 1]
    assert np.mean([r.lang_pred == truth[r.row.doc_id] for r in held]) > 0.97
    assert sum(r.rejected for r in held) <= 1
    by = {(r.row.doc_id, r.text): r for r in got}
    for k in (900, 901, 902):
        r = next(r for key, r in by.items() if key[0] == k)
        assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert by[904, odd[4][1]].lang_pred == "bb" and by[904, "ka lo"].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    assert identify(docs.limit(0), model).count() == 0


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert fit(docs) is None
    assert {(r.lang_pred, r.score) for r in identify(docs, None).collect()} == {("und", 0.0)}


def test_long_texts_in_parts_score_as_one():
    rng = np.random.default_rng(0)
    m = Model(["a", "b"], rng.normal(size=(1 << language.BUCKET_BITS, 2)).astype(np.float32), np.zeros(2))
    m.weights[0] = 0
    word = b"longer words here "
    data = np.frombuffer(word * 200_000, np.uint8)
    whole = m.logits(data, np.array([0, len(data)]))
    short = m.logits(np.frombuffer(word * 100, np.uint8), np.array([0, len(word) * 100]))
    assert np.allclose(whole, short, atol=1e-2)


def test_subwords_stay_within_words():
    import pyarrow as pa

    texts = ["ab cd", "", "Ab", None, "é"]
    data, at = utf8(pa.array(texts))
    buckets, first = subwords(data, at)
    alone = [subwords(*(lambda b: (np.frombuffer(b, np.uint8), np.array([0, len(b)])))((t or "").encode()))[0] for t in texts]
    for order, row in enumerate(buckets):
        for k, start in enumerate(first):
            stop = first[k + 1] if k + 1 < len(first) else len(row)
            assert sorted(x for x in row[start:stop] if x) == sorted(x for x in alone[k][order] if x)
    assert sorted(x for x in alone[0][0] if x)[:1] and set(alone[2][1]) - {0} <= set(alone[0][1])


def slow_segments(s):
    out = []

    def part(a, b):
        best = (0, 0, 0)
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += s[j]
                if total > best[0] + 1e-9:
                    best = (total, i, j + 1)
        if best[0] > 0:
            part(a, best[1])
            out.append(best[1:])
            part(best[2], b)

    part(0, len(s))
    return out


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(3)
    for _ in range(500):
        s = rng.normal(-0.3, 1, rng.integers(0, 24))
        assert [x[:2] for x in toxicity.segments(s)] == slow_segments(s)


def test_gumbel_finds_its_parameters():
    rng = np.random.default_rng(1)
    n = rng.integers(50, 500, 4000)
    s = -np.log(-np.log(rng.random(4000)) / (0.2 * n)) / 1.5
    decay, scale = toxicity.gumbel(n, s)
    assert abs(decay - 1.5) < 0.1 and abs(scale - 0.2) < 0.08


def test_toxicity_held_out_and_edges(spark, prose):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        words = prose(k, rng.randrange(5, 150)).split()
        bad = k % 5 == 0
        for _ in range(rng.randrange(2, 6) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Nasty", "vile", "HORRID", "foul"]))
        rows.append((k, " ".join(words), "x"))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (0, 0), (None, 1), (5000, None), (7000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where("doc_id % 4 <> 1"))
    odd = spark.createDataFrame([(900, None, ""), (901, "", ""), (902, "... 12", ""), (903, "calm " * 100_000 + "vile foul nasty", ""), (903, "vile foul", "")], docs.schema)
    got = {(r.row.doc_id, len(r.passages)): r for r in toxicity.score_toxicity(docs.unionByName(odd), model).collect()}
    held = [r for r in got.values() if r.row.doc_id < 900 and r.row.doc_id % 4 == 1]
    assert np.mean([(r.score >= 0.5) == (r.row.doc_id % 5 == 0) for r in held]) > 0.97
    for k in (900, 901, 902):
        assert got[k, 0].score < 0.5
    for (k, _), r in got.items():
        if k < 900 and k % 5 == 0 and r.score >= 0.5:
            best = r.passages[0]
            assert best.e <= toxicity.SIGNIFICANT
            words = toxicity.tokens(rows[k][1].encode())[best.first : best.end]
            assert set(words) & {"nasty", "vile", "horrid", "foul"}
    assert sum(k == 903 for k, _ in got) >= 1
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, None), (2, 1)]])
def test_toxicity_without_both_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model is None
    assert [r.score for r in toxicity.score_toxicity(docs, model).select(F.col("score")).collect()] == [0.0, 0.0]


def test_a_language_that_was_not_taught_is_rejected(spark):
    rng = random.Random(5)
    taught = {**SYLLABLES, "dd": "на ро мы ли", "ee": "wa zu pik nor"}
    rows = [(k, " ".join("".join(rng.choice(taught[lang].split()) for _ in range(2)) for _ in range(rng.randrange(8, 60))), lang) for k in range(300) for lang in [sorted(taught)[k % 5]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs)
    strange = [(k, " ".join("".join(rng.choice("ψω φξ θδ λγ".split()) for _ in range(3)) for _ in range(40)), None) for k in range(40)]
    got = identify(spark.createDataFrame(strange, docs.schema), model).collect()
    assert np.mean([r.rejected for r in got]) > 0.9
    own = identify(docs, model).collect()
    assert sum(r.rejected for r in own) <= 3 and sum(r.lang_pred == r.row["lang"] for r in own) > 290


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{k:03d}" for k in range(230)]
    rows = [(lang, " ".join(lang_word + rng.choice(letters) for _ in range(8))) for k, lang in enumerate(names) for lang_word in [letters[k % 26] + letters[k // 26] + "q"] for _ in range(3)]
    model = fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.langs == names


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "ka lo mi"), (1, "ka lo mi"), (2, None)], "doc_id long, text string")
    model = toxicity.Model({"lo": 3.0}, {})
    for found in (identify(docs, Model(["a", "b"], np.zeros((1 << language.BUCKET_BITS, 2), np.float32), np.zeros(2))), toxicity.score_toxicity(docs, model)):
        out = [r.asDict(True) for r in found.collect() if r.row.doc_id == 1]
        assert out[0] == out[1]
    assert identify(docs.limit(0), None).count() == 0 and toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_features_from_all_segments(spark):
    """The fit sees as many segments as scoring does."""
    model = toxicity.Model({"bad": 6.0}, {}, 1.0, 1e-3)
    text = ("bad " + "calm " * 12) * 500
    rows = spark.createDataFrame([(1, True, text), (0, True, "calm")], "y int, held boolean, text string")
    got = {r.y: r for r in toxicity._measure(rows, model).collect()}
    found = model.passages(toxicity.tokens(text.encode()))
    assert len(found) == 500 and (got[1].beyond, got[1].summed) == pytest.approx(model.features(found))
    assert got[0].n == 1 and got[0].best == 0.0


def test_parts_of_a_long_text_end_with_words():
    """Done in parts a text has the same subwords, and so the same scores, as done at once."""
    rng = np.random.default_rng(2)
    text = " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(1, 30))) for _ in range(9000)).encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    buckets, _ = subwords(data, at)
    weights = rng.normal(size=(max(int(b.max()) for b in buckets) + 1, 128))
    weights[0] = 0
    model = Model([f"l{k}" for k in range(128)], weights, np.zeros(128))
    assert len(text) > 4 * (1 << 14)
    want = sum(weights[b].sum(0) for b in buckets) / sum(int((b > 0).sum()) for b in buckets)
    assert np.allclose(model.logits(data, at)[0], want)


def test_a_text_column_of_any_name(spark, corpus):
    docs = spark.createDataFrame([(t, lang) for _, t, lang in corpus], "`a.b` string, `l``x` string")
    model = fit(docs, "a.b", "l`x")
    assert set(model.langs) and identify(docs, model, "a.b").where("lang_pred <> 'und'").count() > 0
