import random
import re

import numpy as np
import pytest
import xxhash

from threadloom.llm.simhash import drop_near_duplicates, fingerprint, fingerprint_links, near_duplicates
from threadloom.operators.components import connected_components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_fingerprints_of_odd_texts(prose):
    for t in ["", " \t\r\n\x0b\x0c", "One", "one TWO", "é É ß", "a\xa0b c d", "a " * 70_000, prose(1, 400), "x" * 100_000]:
        assert fingerprint(t.encode()) == slow_fingerprint(t)


def test_equals_brute_force(documents, prose):
    rng = random.Random(5)
    base = [prose(k, 60) for k in range(12)]
    texts = [*base, *base[:4], None, "", " ", "one", "one"]
    for b in base:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(60)] = "changed"
            texts.append(" ".join(w))
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    got = near_duplicates(documents(rows)).collect()
    want = {i: slow_fingerprint(t) for i, t in rows}
    assert {r.id: r.fp % (1 << 64) for r in got} == want
    parts = slow_components([i for i, _ in rows], list(want.values()), 2)
    assert {r.id: r.component_id for r in got} == parts
    assert len(set(parts.values())) < len(rows)
    kept = drop_near_duplicates(documents(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(parts.values()))
    assert kept.columns == documents(rows).columns


@pytest.mark.parametrize("radius,tile_rows,parts", [(0, 4, None), (1, 7, 4), (2, 3, None), (3, 100, 2), (2, 5, 8)])
def test_tiles_miss_no_link(spark, radius, tile_rows, parts):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.int64)
    fps = {0, -1, *map(int, seeds)}
    for s in seeds:
        for _ in range(6):
            flip = 0
            for b in rng.integers(0, 63, rng.integers(1, 5)):
                flip ^= 1 << int(b)
            fps.add(int(s) ^ flip)
    fps = sorted(fps)
    links = fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius, parts, tile_rows=tile_rows)
    got = links.collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= radius for r in got)
    want = slow_components(fps, [x % (1 << 64) for x in fps], radius)
    found = {x: x for x in fps} | {r.node: r.component for r in connected_components(links).collect()}
    assert found == want


def test_repeated_rows_null_ids_and_no_rows(documents):
    rows = [(5, "same text here"), (5, "same text here"), (None, "same text here"), (7, None), (None, "alone in the world tonight")]
    got = near_duplicates(documents(rows)).collect()
    assert sorted((str(r.id), str(r.component_id)) for r in got) == [("5", "5"), ("5", "5"), ("7", "7"), ("None", "5"), ("None", "None")]
    kept = drop_near_duplicates(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("5", "same text here"), ("7", None), ("None", "alone in the world tonight")]
    assert near_duplicates(documents([])).count() == 0 == drop_near_duplicates(documents([])).count()
