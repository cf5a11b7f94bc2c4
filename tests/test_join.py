import random
import time
from dataclasses import replace
from itertools import cycle

import pytest
from pyspark.sql import functions as F

from threadloom import queries
from threadloom.functions import lanes
from threadloom.functions.embed import embed, embedded, embedded_column
from threadloom.functions.strings import as_bytes, bit_distance, edit_distance, letter_codes
from threadloom.operators import join
from threadloom.operators.cluster import labels_of
from threadloom.operators.join import JoinResult, Side, edit_join_exact, edit_join_lsh, edit_join_tables, links_between
from threadloom.params import UNREACHED, JoinParams
from threadloom.plans import counting, lsh, segments
from threadloom.plans.lsh import buckets, candidate_cardinality, candidate_pairs, collision_counts, collisions
from threadloom.plans.segments import price, segment_candidates

P = JoinParams(num_str=3, num_hash=4, num_bits=5, alphabet=4, k=3, shift=2, sampling_range=30)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def walk(s, p, t, q):
    out, j, i = [UNREACHED] * (p.last_position + 1), 0, p.shift * q
    while i < len(s) and j <= p.last_position:
        code = max(p.letters.find(s[i]), 0)
        for _ in range(p.walks[t][code][j] + 1):
            if j < len(out):
                out[j] = s[i]
            j += 1
        i += 1
    return "".join(out)


def reads(n, seed=1, letters="ACGT"):
    rng = random.Random(seed)
    out = ["", "A", "AC"]
    while len(out) < n:
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
        out.append(s)
        for _ in range(rng.randint(0, 3)):
            x = list(s)
            for _ in range(rng.randint(0, 4)):
                k = rng.randint(0, len(x))
                x[k : k + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 1)
            out.append("".join(x))
    return out[:n]


def frame(spark, strings):
    return spark.createDataFrame(list(enumerate(strings)), "i long, s string")


def test_embedding_is_the_walk(spark):
    texts = [*reads(60, letters="ACGTN"), "acgt", "é" * 40, "A" * 500]
    for t in range(P.num_str):
        for q in range(P.num_rep):
            assert ["".join(map(chr, r)) for r in embedded(texts, P, t, q)] == [walk(s, P, t, q) for s in texts]
    rows = {(r.i, r.t, r.q): r for r in embed(frame(spark, texts), P).collect()}
    assert len(rows) == len(texts) * P.num_str * P.num_rep
    native = frame(spark, texts).select("i", embedded_column(F.col("s"), P, 1, 1).alias("e")).collect()
    for r in native:
        assert r.e == walk(texts[r.i], P, 1, 1)
        got = rows[r.i, 1, 1]
        assert got.n == len(texts[r.i])
        assert got.sigs == ["".join(r.e[p] for p in row) for row in P.positions]
        code = [[max(P.letters.find(c), 0) for c in s] for s in got.sigs]
        assert got.hashes == [sum(x * w for x, w in zip(row, P.weights)) % P.hash_size for row in code]


def by_rule(texts, p):
    rows = []
    for i, s in enumerate(texts):
        for t in range(p.num_str):
            for q in range(p.num_rep):
                e = walk(s, p, t, q)
                for k, at in enumerate(p.positions):
                    sig = "".join(e[x] for x in at)
                    code = sum(max(p.letters.find(c), 0) * w for c, w in zip(sig, p.weights)) % p.hash_size
                    rows.append((t, k, code, i, q, len(s), sig))
    hits = []
    for a in rows:
        for b in rows:
            if a[:3] == b[:3] and a[3] < b[3] and abs(a[5] - b[5]) <= p.k and all(UNREACHED in (x, y) or x == y for x, y in zip(a[6], b[6])):
                hits.append((a[3], b[3], a[4], b[4], a[0], a[1]))
    return rows, hits


@pytest.mark.parametrize("p", [P, JoinParams(num_str=2, num_hash=3, num_bits=4, alphabet=5, k=4, shift=9, sampling_range=12, count_filter=2, hash_size=7)])
def test_stages_are_their_definition(spark, p):
    texts = reads(40, 3, "ACGTN")
    rows, hits = by_rule(texts, p)
    table = buckets(frame(spark, texts), p).cache()
    assert sorted(tuple(r) for r in table.collect()) == sorted(rows)
    got = collisions(table, p)
    assert sorted(tuple(r) for r in got.collect()) == sorted(hits)
    counts = {}
    for h in hits:
        counts[h[:4]] = counts.get(h[:4], 0) + 1
    found = collision_counts(got)
    assert {tuple(r)[:4]: r.freq for r in found.collect()} == counts
    assert {tuple(r) for r in candidate_pairs(found, p).collect()} == {k[:2] for k, n in counts.items() if n > p.count_filter}
    sizes = {}
    for r in rows:
        sizes[r[:3]] = sizes.get(r[:3], 0) + 1
    assert tuple(candidate_cardinality(table).first()) == (len(sizes), sum(n > 1 for n in sizes.values()), sum(n * (n - 1) // 2 for n in sizes.values()))
    want = {(i, j, lev(texts[i], texts[j])) for i, j in {k[:2] for k, n in counts.items() if n > p.count_filter}}
    for plan in ("auto", "buckets", "segments"):
        joined = edit_join_lsh(frame(spark, texts), p, "i", "s", plan=plan).pairs()
        assert sorted(tuple(r) for r in joined.collect()) == sorted(w for w in want if w[2] <= p.k)


@pytest.mark.parametrize("k", [0, 1, 3, 6])
def test_exact_join_finds_every_pair(spark, k):
    texts = reads(70, 5)
    want = {(i, j, lev(a, b)) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and lev(a, b) <= k}
    found = edit_join_exact(frame(spark, texts), k, "i", "s")
    assert sorted(tuple(r) for r in found.pairs().collect()) == sorted(want)
    degrees = {i: sum(i in w[:2] for w in want) for i in range(len(texts))}
    assert {r.id: r.n_links for r in found.degrees().collect()} == degrees
    assert {r.i: min(j for j, s in enumerate(texts) if s == texts[r.i]) for r in found.degrees().collect()} == {r.i: r.i for r in found.degrees().collect()}


@pytest.mark.parametrize("texts", [[], ["ACGT"], ["", ""], [None, "A", None], ["ACGTACGT"] * 5])
def test_small_inputs(spark, texts):
    rows = frame(spark, texts)
    some = [i for i, s in enumerate(texts) if s is not None]
    want = {(i, j) for i in some for j in some if i < j and lev(texts[i], texts[j]) <= P.k}
    for found in (edit_join_lsh(rows, P, "i", "s"), edit_join_exact(rows, P.k, "i", "s")):
        assert {(r.id1, r.id2) for r in found.pairs().collect()} == want
        assert found.funnel().first().n_links == 0


@pytest.mark.parametrize("k", [0, 1, 3, 9])
@pytest.mark.parametrize("plan", ["by_length", "by_place", "by_count:2", "by_count:3", "by_tile"])
def test_segments_miss_no_pair(spark, k, plan):
    texts = reads(60, 6)
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and lev(a, b) <= k}
    got = {tuple(r) for r in segment_candidates(frame(spark, texts), k, plan=plan).collect()}
    assert want <= got and all(i < j for i, j in got)
    assert plan != "by_tile" or got == want


@pytest.mark.parametrize("plan", ["by_length", "by_place", "by_count:2", "by_tile"])
def test_plans_keep_groups_and_sides_apart(spark, plan):
    texts = reads(50, 13)
    rows = spark.createDataFrame([(i, s, i % 3, i % 2) for i, s in enumerate(texts)], "i long, s string, g int, side int")
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and i % 3 == j % 3 and i % 2 != j % 2 and lev(a, b) <= 3}
    got = {tuple(r) for r in segment_candidates(rows, 3, plan=plan).collect()}
    assert want <= got and all(i < j and i % 3 == j % 3 and i % 2 != j % 2 for i, j in got)


@pytest.mark.parametrize("letters,k,plan,most", [("ACGT", 20, "by_tile", 0.05), ("ACGT", 9, "by_", 0.07), ("abcdefghijklmnopqrstuvwxyz", 20, "by_", 0.05)])
def test_short_strings_with_many_edits(spark, letters, k, plan, most):
    """Strings of 60 letters and thresholds up to a third of them: few pairs are candidates, none is missed."""
    rng = random.Random(k)
    texts = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(120)]
    for s in texts[:40]:
        t = list(s)
        for _ in range(rng.randrange(k + 4)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        texts.append("".join(t)[:64])
    rows = frame(spark, texts)
    assert price(rows.selectExpr("i", "s"), k)[0].startswith(plan)
    want = {(i, j): d for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and (d := bit_distance(a, b, k)) >= 0}
    found = edit_join_exact(rows, k, "i", "s")
    assert {(r.id1, r.id2): r.dist for r in found.pairs().collect()} == want and len(want) > 20
    assert found.candidates.count() < most * len(texts) * (len(texts) - 1) / 2


def test_blocks_of_one_length_are_split(spark, monkeypatch):
    from threadloom.plans import segments

    monkeypatch.setattr(segments, "TILE", 7)
    texts = ["".join(random.Random(i // 2).choice("AC") for _ in range(9)) for i in range(60)]
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and lev(a, b) <= 2}
    got = [tuple(r) for r in segment_candidates(frame(spark, texts), 2, plan="by_tile").collect()]
    assert set(got) == want and len(got) == len(want)


def long_reads(n, size, most, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ACGT") for _ in range(size)) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(most)):
            at = rng.randrange(len(s))
            s[at : at + rng.randrange(2)] = rng.choice(["", "A", "C", "GT"])
        out.append("".join(s))
    return out


def test_default_threshold_on_long_strings(spark):
    texts = long_reads(30, 1200, 150, 3)
    assert price(frame(spark, texts), 150)[0] == "by_place"
    want = {(i, j): d for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and (d := bit_distance(a, b, 150)) >= 0}
    assert len(want) > 10
    assert {(r.id1, r.id2): r.dist for r in edit_join_exact(frame(spark, texts), 150, "i", "s").pairs().collect()} == want
    p = JoinParams(sampling_range=800)
    for plan in ("buckets", "segments"):
        got = {(r.id1, r.id2): r.dist for r in edit_join_lsh(frame(spark, texts), p, "i", "s", plan=plan).pairs().collect()}
        assert got.items() <= want.items() and len(got) > 0.5 * len(want)


def test_bit_distance_is_the_distance():
    rng = random.Random(8)
    for _ in range(400):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(40))) for _ in range(2))
        b = a[: rng.randrange(40)] + b[:5] + a[rng.randrange(40) :] if rng.random() < 0.6 else b
        for k in (0, 2, 7, 50):
            assert bit_distance(a, b, k) == (lev(a, b) if lev(a, b) <= k else -1)


@pytest.mark.parametrize("letters", ["ACGT", "ab", "aéü漢🙂\ud800"])
def test_lanes_are_the_distance(monkeypatch, letters):
    monkeypatch.setattr(lanes, "CELLS", 3000)
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    xs = [some(60) for _ in range(300)] + ["", "", "a"]
    ys = [x[: rng.randrange(60)] + some(6) + x[rng.randrange(60) :] if rng.random() < 0.7 else some(70) for x in xs[:300]] + ["", "abc", ""]
    for k in (0, 1, 4, 17):
        assert lanes.diagonal_distances(xs, ys, k).tolist() == [bit_distance(a, b, k) for a, b in zip(xs, ys)]
    short = [x[:64] for x in xs[:40]] + ["", (letters * 64)[:64]]
    got = lanes.word_distances(short, ys[:50] + ["", "ACGT" * 40])
    assert [[int(d) for d in row] for row in got] == [[bit_distance(a, b, 999) for b in ys[:50] + ["", "ACGT" * 40]] for a in short]
    assert lanes.diagonal_distances([], [], 5).tolist() == [] and lanes.word_distances([], ["a"]).shape == (0, 1)


def test_lanes_take_k_squared_steps():
    """Strings of 5,000 letters at a threshold of 150, against the distance found a letter at a time."""
    near = long_reads(12, 5000, 150, 5)
    xs, ys = near[:-1], near[1:]
    start = time.perf_counter()
    got = lanes.diagonal_distances(xs, ys, 150).tolist()
    middle = time.perf_counter()
    assert got == [bit_distance(a, b, 150) for a, b in zip(xs, ys)]
    assert middle - start < time.perf_counter() - middle


@pytest.mark.parametrize("other", [False, True])
def test_blocks_of_a_hot_bucket(spark, monkeypatch, other):
    """The same collisions whatever the blocks are, and those of one bucket spread over many keys."""
    texts = reads(60, 21) + ["A" * (k % 9) for k in range(25)]
    table = buckets(frame(spark, texts).distinct(), P)
    two = buckets(frame(spark, texts[20:]).selectExpr("i + 1000 AS i", "s"), P) if other else None
    want = sorted(tuple(r) for r in collisions(table, P, two).collect())
    monkeypatch.setattr(lsh, "BLOCK", 4)
    got = sorted(tuple(r) for r in collisions(table, P, two).collect())
    assert got == want and len(want) > 100
    rows = spark.range(900).selectExpr("0 AS t", "id AS i")
    met = lsh.in_blocks(rows, None, ["t"], 100)
    per_key = met.groupBy("x", "y").count().collect()
    assert len(per_key) == 45 and max(r["count"] for r in per_key) < 4 * 100 * 100
    pairs = met.where("(x < y AND i1 <> i2) OR i1 < i2").selectExpr("least(i1, i2) AS a", "greatest(i1, i2) AS b")
    assert pairs.count() == pairs.distinct().count() == 900 * 899 // 2


def rows_of_joins(plan):
    """Rows that the joins of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return rows_of_joins(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return rows_of_joins(plan.plan())
    found = plan.children()
    below = sum(rows_of_joins(found.apply(n)) for n in range(found.size()))
    return below + (plan.metrics().apply("numOutputRows").value() if "Join" in kind else 0)


@pytest.mark.parametrize("other", [False, True])
def test_collisions_are_spelled_out_after_the_join(spark, monkeypatch, other):
    """Rows of a bucket that differ in their ids only meet as lists, in as many tasks as their pairs ask for: not every pair is a row of a join."""
    p = replace(P, shift=3)  # one suffix
    texts = ["ACGGT" * 24 + "ACGT"[n % 4] * 3 for n in range(64)]
    table = buckets(frame(spark, texts), p)
    two = buckets(frame(spark, texts).selectExpr("i + 7 AS i", "s"), p) if other else None
    keys = [(t, k) for t in range(p.num_str) for k in range(p.num_hash)]
    want = sorted((a, b, 0, 0, t, k) for t, k in keys for a in range(64) for b in (range(7, 71) if other else range(a + 1, 64)))
    for chunk, block, pairs in ((256, 2048, 1 << 24), (7, 2048, 1 << 24), (256, 2048, 1000), (3, 10, 1000)):
        for name, value in (("CHUNK", chunk), ("BLOCK", block), ("TASK_PAIRS", pairs)):
            monkeypatch.setattr(lsh, name, value, raising=False)
        found = collisions(table, p, two)
        assert sorted(tuple(r) for r in found.collect()) == want
        if block == 2048:
            assert 0 < rows_of_joins(found._jdf.queryExecution().executedPlan()) < len(want) / 20
        if pairs == 1000:
            assert found.rdd.getNumPartitions() > len(want) / 1000


def test_addresses_are_embedded_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(queries, "TASK_STRINGS", 20, raising=False)
    assert queries._buckets(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == 13


def test_native_embedding_is_dealt_by_number(spark, monkeypatch, tmp_path):
    """Null, empty, long, foreign and repeated addresses and ids: the rows of the other embedding, as many in each task."""
    odd = [(900, None), (901, ""), (902, "x" * 500), (903, "h\u00e9 \U0001f600#?"), (3, "https://a.b/3"), (3, "https://a.b/3"), (None, "https://a.b/c")]
    spark.createDataFrame(odd + [(k, f"https://a.b/{k % 50}/{k * k}") for k in range(10, 202)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(queries, "TASK_STRINGS", 20)
    found = queries.cgk_embed_native(spark, str(tmp_path))
    each = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) == 10 and max(each) <= 1.5 * min(each)
    rows = lambda df: sorted((r.i, r.t, r.q, r.sigs) for r in df.collect())
    assert len(rows(found)) == 198 * queries.PARAMS.num_str * queries.PARAMS.num_rep
    assert rows(found) == rows(queries.cgk_embed(spark, str(tmp_path)))


def test_native_embedding_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.cgk_embed_native(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("params", [None, P])
def test_two_tables(spark, params):
    one, two = reads(40, 9), reads(40, 9)[10:] + reads(15, 10)
    left, right = frame(spark, one), frame(spark, two).selectExpr("i * 5 - 20 AS i", "s")
    want = {(i, 5 * j - 20, lev(a, b)) for i, a in enumerate(one) for j, b in enumerate(two) if lev(a, b) <= P.k}
    got = {tuple(r) for r in edit_join_tables(left, right, P.k, "i", "s", params=params).collect()}
    assert got == want if params is None else got <= want and {w for w in want if w[2] == 0} <= got
    if params is not None:
        sides = [Side.of(x, "i", "s", params=params) for x in (left, right)]
        each = [{tuple(r) for r in links_between(*sides, P.k, params, plan).collect()} for plan in ("buckets", "segments")]
        assert each[0] == each[1]
        within = edit_join_lsh(frame(spark, one + two), params, "i", "s", plan="buckets").pairs().collect()
        across = {(r.id1, 5 * (r.id2 - len(one)) - 20, r.dist) for r in within if r.id1 < len(one) <= r.id2}
        assert got == across
    assert edit_join_tables(left.limit(0), right, 2, "i", "s").count() == 0


@pytest.mark.parametrize("name,count_filter", [("by_tile", 0), ("by_kind", 2)])
def test_collisions_are_looked_up_where_strings_are_compared(spark, monkeypatch, name, count_filter):
    """Pairs of compared blocks are not joined with the buckets, a row for each pair and bucket, and the same pairs come out."""
    params = replace(P, count_filter=count_filter)
    texts = [s[:8] + str(n % 12) + s[8:] for n, s in enumerate(reads(70, 21))]
    want = [{tuple(r) for r in edit_join_lsh(frame(spark, texts), params, "i", "s", plan="buckets").pairs().collect()}]
    sides = [Side.of(frame(spark, x), "i", "s", params=params) for x in (texts[:40], texts[30:])]
    want.append({tuple(r) for r in links_between(*sides, P.k, params, "buckets").collect()})
    plans = cycle([name, "by_tile"])  # kinds are joined by a plan of their own
    monkeypatch.setattr(segments, "price", lambda rows, k: (next(plans), 1.0))
    monkeypatch.setattr(join, "collisions_of", None)
    got = [{tuple(r) for r in edit_join_lsh(frame(spark, texts), params, "i", "s", plan="segments").pairs().collect()}]
    got.append({tuple(r) for r in links_between(*sides, P.k, params, "segments").collect()})
    assert got == want and all(len(x) > 10 for x in got)


def test_bytes_or_characters(spark):
    df = spark.createDataFrame([("größe", "grosse")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert tuple(df.select(edit_distance(a, b, 9), edit_distance(as_bytes(a), as_bytes(b), 9), edit_distance(a, b, 2)).first()) == (3, 4, -1)
    assert df.select(letter_codes(F.lit("ACGTNaé"), 4)).first()[0] == [0, 1, 2, 3, 0, 0, 0]
    rows = frame(spark, ["é", "e"])
    assert edit_join_exact(rows, 1, "i", "s").pairs().count() == 0
    assert edit_join_exact(rows, 1, "i", "s", byte_mode=False).pairs().count() == 1


def addresses(n, seed=5):
    rng = random.Random(seed)
    hosts = ["".join(rng.choice(["TH", "EN", "OR", "AL"]) for _ in range(3)) for _ in range(6)]
    ends = ["", "/", ".HTML", "#TOP", "?UTM_SOURCE=FEED", "?PAGE=2&REF=X"]
    return [f"HTTP{rng.choice(['', 'S'])}://{rng.choice(hosts)}.EXAMPLE.NET/{rng.choice(['EN', 'DE'])}/{rng.randrange(4 * n)}{rng.choice(ends)}" for _ in range(n)]


def test_kinds_miss_no_pair(spark):
    texts = [*dict.fromkeys(addresses(150)), "", "7", "12345", "9 A", "A" * 80 + "17" + "B" * 80, "A" * 79 + "27C" + "B" * 78, "ÅÄ1", "ÅÄ", "x" * 70, "y1" + "x" * 70]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if lev(texts[i], texts[j]) <= 4}
    rows = frame(spark, texts)
    got = segment_candidates(rows, 4, plan="by_kind").collect()
    assert len(got) == len(set(got)) and {(r.i1, r.i2) for r in got} == want
    for name in ("g", "side"):
        parted = rows.withColumn(name, (F.col("i") % 2).cast("int"))
        got = segment_candidates(parted, 4, plan="by_kind").collect()
        assert {(r.i1, r.i2) for r in got} == {(i, j) for i, j in want if ((i - j) % 2 == 0) == (name == "g")}


def test_blocks_of_kinds(spark, monkeypatch):
    from threadloom.plans import segments

    for name in ("KIND_TILE", "NEAR_TILE", "PART"):
        monkeypatch.setattr(segments, name, 7)
    rows = frame(spark, [*dict.fromkeys(addresses(200, 6))])
    got = segments.segment_candidates(rows, 4, plan="by_kind").collect()
    want = segments.segment_candidates(rows, 4, plan="by_tile").collect()
    assert len(got) == len(set(got)) and sorted(got) == sorted(want)


def test_addresses_are_not_all_compared(spark):
    """The cheapest plan for many addresses of few hosts looks at a small part of all pairs."""
    rows = frame(spark, [*dict.fromkeys(addresses(20_000))])
    plan, each = price(rows, 4)
    assert plan == "by_kind" and each < 20_000 / 50


def test_kinds_of_many_groups_are_not_joined_by_kinds(spark):
    """Kinds have no digits, so joining them by their own kinds never ends, however often the same kinds stand in other groups."""
    kinds = [*dict.fromkeys(_without_digits(s) for s in addresses(400))]
    rows = spark.createDataFrame([(g * len(kinds) + j, s, g) for g in range(12) for j, s in enumerate(kinds)], "i long, s string, g long")
    assert price(rows, 4)[0] != "by_kind"
    want = {(g * len(kinds) + i, g * len(kinds) + j) for g in range(12) for j, y in enumerate(kinds) for i, x in enumerate(kinds[:j]) if lev(x, y) <= 4}
    assert {(r.id1, r.id2) for r in edit_join_exact(rows, 4, "i", "s", group_col="g").pairs().collect()} == want


def _without_digits(s):
    return "".join(c for c in s if not c.isdigit())


@pytest.mark.parametrize("many,text", [(1, "reads"), (8, "addresses")])
def test_counts_by_blocks_make_no_row_of_a_collision(spark, monkeypatch, many, text):
    """What blocks count is what collisions add up to, wildcards, copies, short strings and letters outside the alphabet included."""
    p = P if text == "reads" else replace(queries.PARAMS, num_str=2, num_hash=4, count_filter=2)
    texts = [*(reads(90, 21, "ACGT-é") if text == "reads" else addresses(70, 8)), "AC", "", "A" * 30]
    rows = frame(spark, [*texts, *texts[5:9], None])
    want = collision_counts(collisions(buckets(rows.where("s is not null"), p), p)).collect()
    pairs = {(r.i1, r.i2) for r in want if r.freq > p.count_filter}
    for name, value in (("MOST", 29), ("LEAST", 7), ("ROWS", 5), ("MANY", many), ("OUT", 50), ("OFTEN", 0), ("counts_by_slices", None)):
        monkeypatch.setattr(counting, name, value)
    assert sorted(counting.pair_counts(rows, p).collect()) == sorted(want) and len({(r.q1, r.q2) for r in want}) == 4
    got = counting.pair_set(rows, p).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == pairs and len(pairs) > 50
    assert counting.pair_number(rows, p).first().n == len(pairs)
    assert counting.pair_counts(rows.limit(0), p).count() == counting.pair_set(rows.limit(1), p).count() == 0


def test_funnel_counts_without_candidates(spark, monkeypatch):
    texts = [*addresses(60, 3), *addresses(5, 3)]
    p = replace(queries.PARAMS, num_str=3, num_hash=3)
    want = edit_join_lsh(frame(spark, texts), p, "i", "s", plan="buckets").funnel().collect()
    monkeypatch.setattr(counting, "counts_by_slices", None)
    monkeypatch.setattr(join, "MOST_FAN", -1)
    assert join.lsh_funnel(frame(spark, texts), p, "i", "s").collect() == want and want[0].n_candidates > want[0].n_links > 0


def test_counts_in_slices(spark, monkeypatch):
    """Slices by the first string of a pair give the counts of one pass, and each is a small part of the shuffle."""
    table = buckets(frame(spark, reads(60)), P).cache()
    one = collision_counts(collisions(table, P)).collect()
    passes = []
    monkeypatch.setattr(lsh, "cut", lambda df, name="cut", rows=None: passes.append(name) or df)
    monkeypatch.setattr(lsh, "SLICE_PAIRS", 1 + candidate_cardinality(table).first().n_pairs // 3)
    assert sorted(lsh.counts_by_slices(table, P).collect()) == sorted(one) and passes.count("counts") == 3
    pairs = lsh.counts_by_slices(table, P, lambda counts: candidate_pairs(counts, P)).collect()
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(r.i1, r.i2) for r in one if r.freq > P.count_filter}


@pytest.mark.parametrize("letters", ["AC", "ACGT", "abé𝄞zy"])
def test_slices_are_the_distance(monkeypatch, letters):
    rng = random.Random(letters)
    text = lambda n: "".join(rng.choices(letters, k=n))
    for n, m, k in ((0, 3, 4), (1, 4, 5), (9, 9, 3), (12, 10, 6), (30, 30, 20), (7, 1, 2)):
        one, two = text(n // 2), text(m // 2)
        xs, ys = [one + text(n - n // 2) for _ in range(30)], [two + text(m - m // 2) for _ in range(130)]
        want = [[min(d if (d := bit_distance(x, y, k)) >= 0 else k + 1, k + 1) for y in ys] for x in xs]
        for words in (1, 40, 8192):
            monkeypatch.setattr(lanes, "SLICE", words)
            for some in (1, 64, 130):
                got = lanes.sliced_distances(lanes.Sliced(xs), lanes.Sliced(ys[:some]), k)
                assert got.tolist() == [row[:some] for row in want]


@pytest.mark.parametrize("plan", ["by_tile", "by_kind", "by_length"])
def test_sums_and_clusters_need_no_links(spark, monkeypatch, plan):
    """What is added up where strings are compared is what the links give, and no link is written for it."""
    for name, value in (("TILE", 7), ("KIND_TILE", 5), ("NEAR_TILE", 9), ("PART", 4)):
        monkeypatch.setattr(segments, name, value)
    rng = random.Random(plan)
    texts = [f"{rng.choice(['ab', 'abc', 'xyzxyzxy'])}/{rng.randint(1, 999)}{rng.choice(['', '.html'])}" for _ in range(50)] + ["a/1", "a/1", "", None]
    rows = frame(spark, texts)
    found = edit_join_exact(rows, 2, "i", "s")
    found.plan = plan
    got = {r.id: tuple(r)[2:] for r in found.near().collect()}
    labels = sorted(map(tuple, labels_of(rows.where("s is not null"), found, 3).collect()))
    assert ("links" in vars(found)) == (plan == "by_length")
    every = {(x, y): bit_distance(texts[x], texts[y], 2) for x in range(53) for y in range(53)}
    first = {s: texts.index(s) for s in texts}
    for x in range(53):
        dist = [every[x, y] for y in set(first.values()) - {first[None]} if texts[y] != texts[x] and every[x, y] >= 0]
        links = sum(every[x, y] >= 0 for y in range(53) if y != x)
        assert got[x] == (links, len(dist), min(dist, default=None), sum(dist) if dist else None)
    plain = JoinResult(found.links, found.members, found.candidates)
    assert labels == sorted(map(tuple, labels_of(rows.where("s is not null"), plain, 3).collect()))
    assert sorted(map(tuple, found.pairs().collect())) == sorted((x, y, d) for (x, y), d in every.items() if x < y and d >= 0)
