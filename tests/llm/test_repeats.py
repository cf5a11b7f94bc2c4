import random
import re
from collections import Counter

import pytest

from threadloom.llm import repeats
from threadloom.llm.repeats import without_repeats


def slow(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def fast(df, window):
    return sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in without_repeats(df, window=window).collect()), key=str)


@pytest.mark.parametrize("window,piece", [(35, 1 << 17), (35, 64), (7, 50), (12, 1 << 17), (2, 1 << 17), (5, 1 << 17), (80, 1 << 17)])
def test_equals_brute_force(documents, prose, monkeypatch, window, piece):
    rng = random.Random(window)
    monkeypatch.setattr(repeats, "PIECE", piece)
    passage, other = prose(1, 90), prose(2, 36)
    texts = []
    for k in range(25):
        parts = [prose(100 + k, rng.randrange(0, 60)), rng.choice([passage, other, "", passage[: len(passage) // 2]]), prose(200 + k, rng.randrange(0, 60))]
        texts.append((" " if k % 2 else "\n\t ").join(parts))
    texts += [texts[0], texts[0] + " tail", "la " * 120, passage + " " + passage, None, "", "  \n", "short one"]
    near = passage.split()
    for k in range(6):
        w = near[:]
        w[rng.randrange(90)] = f"new{k}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    assert fast(documents(rows), window) == slow(rows, window)


def test_random_words_from_a_tiny_vocabulary(documents):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 120)))) for k in range(30)]
    assert fast(documents(rows), 12) == slow(rows, 12)


def test_equal_rows_null_ids_and_no_rows(documents, prose):
    t = prose(3, 50)
    for rows in ([(1, t), (1, t)], [(None, t), (None, t), (None, prose(4, 50))], [(1, t), (2, t + " x")], []):
        assert fast(documents(rows), 35) == slow(rows, 35)


def test_as_is_leaves_untouched_texts_alone(documents):
    rows = [(1, "two  words\n"), (2, None)]
    assert [(r.row.doc_id, r.kept) for r in without_repeats(documents(rows), as_is=True).orderBy("row.doc_id").collect()] == rows


def slow_paths(units):
    """Unit -> (first unit of its path, edges before it), by walking back while a node has one unit on either side."""
    ends, starts = {}, {}
    for uid, n, u, v in units:
        starts.setdefault(u, []).append(uid)
        ends.setdefault(v, []).append(uid)
    by = {x[0]: x for x in units}
    out = {}
    for uid, _, u, _ in units:
        at, off, seen = uid, 0, {uid}
        while True:
            node = by[at][2]
            if len(starts[node]) != 1 or len(ends.get(node, [])) != 1:
                out[uid] = (at, off)
                break
            at = ends[node][0]
            if at in seen:  # a ring has no first
                out[uid] = (uid, 0)
                break
            seen.add(at)
            off += by[at][1]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_paths_are_compacted_as_by_walking(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(0, 70)] + [(k, k + 1) for k in range(100, 109)] + [(110, 111), (111, 112), (112, 110), (200, 200)]
    edges += [(5, 300), (300, 301), (40, 41), (400, 100), (401, 100), (109, 402), (109, 403)] + [(rng.randrange(500, 540), rng.randrange(500, 540)) for _ in range(40)]
    rng.shuffle(edges)
    units = [(7 * k + 1, rng.randrange(1, 31), u, v) for k, (u, v) in enumerate(edges)]
    labels = repeats.compact(spark.createDataFrame(units, "uid long, n long, u long, v long")).collect()
    got = {x[0]: (x[0], 0) for x in units} | {r.uid: (r.unitig, r.off) for r in labels}
    want = slow_paths(units)
    ring = {x[0] for x in units if x[2] in (110, 111, 112) and x[3] in (110, 111, 112)}
    assert {k: v for k, v in got.items() if k not in ring} == {k: v for k, v in want.items() if k not in ring}
    assert max(off for _, off in got.values()) > 300 and all(got[k] == (k, 0) for k in ring)


def test_only_equal_words_are_taken_out():
    """What a hash says is not enough: a block whose words differ from those beside it stays, but for its equal parts."""
    import zstandard

    words = [b"w%d" % k for k in range(60)]
    pack, unpack = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor()
    whole = (4, 1, [(1 << 6) | 3, (4 << 6) | 2], pack(b" ".join(words[5:16])))
    assert (repeats._repeated(words, [whole], 7, unpack) > 0).nonzero()[0].tolist() == list(range(5, 16))
    other = words[5:16]
    other[9] = b"other"
    part = (4, 1, [(1 << 6) | 3, (4 << 6) | 2], pack(b" ".join(other)))
    assert (repeats._repeated(words, [part], 7, unpack) > 0).nonzero()[0].tolist() == list(range(5, 14))
    assert not repeats._repeated(words, [(4, 1, [(1 << 6) | 3, (4 << 6) | 2], pack(b" ".join(words[6:17])))], 7, unpack).any()


def test_a_long_text_and_columns_of_any_name(spark, documents, prose):
    passage = prose(77, 200)
    long = " ".join([prose(50, 3000), passage, prose(51, 3000), passage])
    rows = [(1, long), (2, passage), (3, prose(52, 30))]
    assert fast(documents(rows), 35) == slow(rows, 35)
