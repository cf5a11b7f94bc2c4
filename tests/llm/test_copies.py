import random

import numpy as np

import corpus_pipeline
from threadloom.llm.copies import forest, near_copies, similar
from threadloom.llm.simhash import fingerprint, near_duplicates


def shingled(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def edited(text, edits, rng):
    """Changed words apart from each other, each of which costs five shingles."""
    w = text.split()
    for at in rng.sample(range(5, len(w) - 5, 10), edits):
        w[at] = "changed"
    return " ".join(w)


def test_stage_drops_edited_copies(documents, prose, spark):
    rng = random.Random(3)
    base = [prose(k, 300) for k in range(20)]
    rows = list(enumerate(base)) + [(100 + 10 * e + k, edited(base[k], e, rng)) for k in range(20) for e in (1, 3, 5)]
    rows += [(500 + k, edited(base[k], 14, rng)) for k in range(20)]
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, documents(rows), "").collect()}
    assert kept == {i for i, _ in rows if i < 20 or i >= 500}


def test_equals_brute_force(documents, prose):
    rng = random.Random(4)
    base = [prose(k, rng.randrange(30, 200)) for k in range(12)]
    texts = [*base, *base[:3], None, "", " \n", "one", "One", "one two"]
    texts += [edited(b, rng.randrange(0, len(b.split()) // 20), rng) for b in base for _ in range(6)]
    rows = list(enumerate(texts, 10))
    sets = {i: shingled(t or "") for i, t in rows}
    got = near_copies(documents(rows).repartition(3)).collect()
    assert {r.id: r.component_id for r in got} == components(list(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert near_copies(documents([])).count() == 0


def test_blocks_miss_no_link(spark):
    rng = np.random.default_rng(5)
    seeds = [rng.choice(5000, 60, replace=False) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(s, 60 - k, replace=False), rng.choice(5000, k, replace=False)])).astype(np.uint64) for s in seeds for k in range(9)]
    linked = lambda a, b: jaccard(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8
    want = components(range(len(sets)), linked)
    edges = forest(sets, np.zeros(len(sets)), 0.8)
    assert all(linked(*e) for e in edges) and components(range(len(sets)), lambda a, b: (a, b) in edges or (b, a) in edges) == want
    members = spark.createDataFrame([(b, n) for b in (7, 8) for n in range(len(sets))], "bucket long, node long")
    found = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in enumerate(sets)], "node long, found binary")
    for block in (5, 100):
        edges = {(r.a, r.b) for r in similar(members, found, 0.8, block).collect()}
        assert all(linked(*e) for e in edges) and components(range(len(sets)), lambda a, b: (a, b) in edges or (b, a) in edges) == want


def test_stage_drops_what_simhash_links(documents, prose, spark):
    """Two texts of mostly one repeated word have one fingerprint, though few of their different shingles are common."""
    rows = [(k, "again " * 500 + prose(k, 40)) for k in (1, 2)] + [(3, prose(3, 300))]
    sets = [shingled(t) for _, t in rows]
    near = {r.id: r.component_id for r in near_duplicates(documents(rows)).collect()}
    assert jaccard(*sets[:2]) < 0.3 and near == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, documents(rows), "").collect()} == {1, 3}


def test_groups_by_both_kinds_of_links(documents, prose):
    """Brute force over SimHash and Jaccard together: a text may link one way to one text and the other way to another."""
    rng = random.Random(8)
    base = [prose(k, rng.randrange(30, 200)) for k in range(8)]
    texts = [*base, *base[:2], None, "", "one", "One", *(edited(b, rng.randrange(0, len(b.split()) // 20), rng) for b in base for _ in range(3))]
    texts += ["la la lo " * 80 + prose(50 + k // 2, 40) + (" end" if k % 2 else "") for k in range(6)]
    rows = list(enumerate(texts, 10))
    sets = {i: shingled(t or "") for i, t in rows}
    prints = {i: fingerprint((t or "").encode()) for i, t in rows}
    got = near_copies(documents(rows).repartition(3), radius=2).collect()
    linked = lambda a, b: jaccard(sets[a], sets[b]) >= 0.8 or (prints[a] ^ prints[b]).bit_count() <= 2
    assert {r.id: r.component_id for r in got} == components(list(sets), linked)
