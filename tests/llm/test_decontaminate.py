import random
import re

import pytest

from threadloom.llm import decontaminate
from threadloom.llm.decontaminate import contamination, drop_contaminated


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, names = words_of(t), set(), set()
        for item, text in items:
            v = words_of(text)
            n = min(window, len(v))
            for k in range(len(v) - n + 1 if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[k : k + n]:
                        hit.update(range(j, j + n))
                        if item is not None:
                            names.add(str(item))
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2 << 20, 60])
def test_equals_brute_force(spark, documents, prose, block):
    long = prose(1, 40)
    items = [(1, long), (2, "Answer"), (3, "two words"), (4, None), (5, ""), (6, "..."), (7, long.upper()), (None, "nameless item here"), (3, "again three"), (10, prose(2, 10)), (11, "é Ünï 42x")]
    w = long.split()
    docs = [
        (1, f"start {' '.join(w[3:20])} end"), (2, "  ".join(w[:9])), (3, "-".join(w[5:15])), (4, "answers ANSWER, answer!"), (5, None), (6, ""), (7, "two-words two"),
        (8, "the nameless item here"), (9, prose(2, 10)[:-1]), (10, "x " + prose(2, 10)), (11, "É ünï 42X é Ünï 42x"), (12, prose(9, 3000) + " " + " ".join(w[20:])), (13, "two"), (14, "a\x00answer"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(documents(docs), bench, block_bytes=block).collect()
    have = sorted(((r.row.doc_id, r.n_words, sum(b - a for a, b in zip(r.begin, r.end)), r["items"]) for r in got), key=str)
    assert have == slow(docs, items)
    kept = drop_contaminated(documents(docs), bench, block_bytes=block)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, n, _ in have if not n}
    assert kept.columns == documents(docs).columns


@pytest.mark.parametrize("window", [1, 4, 300])
def test_other_windows_long_texts_and_repeated_rows(spark, documents, prose, window):
    items = [(1, prose(1, 420)), (2, prose(2, 5))]
    far = prose(7, 2000)
    docs = [(1, prose(1, 420)), (2, far + " " + prose(1, 330) + " " + far), (2, far + " " + prose(1, 330) + " " + far), (3, prose(1, 299)), (4, "x " + prose(2, 5)), (4, "x " + prose(2, 5))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items, window) if window > 100 else None
    each = []
    for block in (1 << 20, 60):
        got = contamination(documents(docs), bench, window=window, block_bytes=block).collect()
        each.append(sorted(((r.row.doc_id, r.n_words, sum(b - a for a, b in zip(r.begin, r.end)), r["items"]) for r in got), key=str))
    assert each[0] == each[1] and (want is None or each[0] == want)


def test_a_text_beyond_one_pass(spark, documents, prose, monkeypatch):
    leak = prose(999, 14)
    text = " ".join(prose(k, 4000) for k in range(60)) + " " + leak
    assert len(text) > decontaminate.RUN_BYTES
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    for block in (1 << 20, 10):
        r = contamination(documents([(1, text), (2, leak)]), bench, block_bytes=block).orderBy("row.doc_id").collect()
        assert [(list(x.begin), list(x.end)) for x in r] == [([240000], [240014]), ([0], [14])]


def test_no_benchmark_and_no_documents(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(documents([(1, "a b")]), bench).first().n_words == 2
    assert contamination(documents([]), bench).count() == 0


def test_a_large_benchmark_leaves_few_places(spark, documents):
    """Of a benchmark beyond what is carried whole, next to no word becomes a row but those where a window ends."""
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(3000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [text(400) for _ in range(500)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [text(2000) for _ in range(30)] + [text(50) + " " + " ".join(items[7].split()[20:45]) + " " + text(50)]
    made = []
    cut, decontaminate.cut = decontaminate.cut, lambda df, name="cut", *a: made.append((name, out := cut(df, name, *a))) or out
    try:
        got = contamination(documents(list(enumerate(docs))), bench, block_bytes=1000).collect()
    finally:
        decontaminate.cut = cut
    assert [(r.row.doc_id, list(zip(r.begin, r.end)), r["items"]) for r in got if r.begin] == [(30, [(50, 75)], ["7"])]
    places = dict(made)["leak-places"].count()
    assert 16 <= places < 16 + 0.005 * 60_000
