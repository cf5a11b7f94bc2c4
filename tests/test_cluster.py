import random

import pytest

from threadloom.operators.cluster import cluster, labels_of
from threadloom.operators.components import connected_components
from threadloom.operators.consensus import consensus
from threadloom.operators.graph import core_points, dbscan, degrees, neighbors
from threadloom.operators.join import edit_join_exact, edit_join_lsh
from threadloom.params import JoinParams
from threadloom.plans.numbering import numbered


def components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 120
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (5, 5), (None, 3)], "a long, b long")
    want = {k: v for k, v in components(e for e in edges if e[0] != e[1]).items()}
    assert {r.node: r.component for r in connected_components(df).collect()} == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def dbscan_by_loop(n, pairs, min_pts):
    near = {i: {i} for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    core = [i for i in range(n) if len(near[i]) >= min_pts]
    label, count = {}, 0
    for c in core:
        if c in label:
            continue
        count += 1
        todo = [c]
        while todo:
            x = todo.pop()
            if x in label:
                continue
            label[x] = count
            todo += [y for y in near[x] if y in core]
    for i in range(n):
        if i not in core:
            label[i] = min((label[x] for x in near[i] if x in core), default=-1)
    return label


@pytest.mark.parametrize("seed,min_pts", [(0, 2), (1, 3), (2, 4), (3, 1)])
def test_dbscan(spark, seed, min_pts):
    rng = random.Random(seed)
    n = 80
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(85)}
    nodes, links = spark.createDataFrame([(i,) for i in range(n)], "i long"), spark.createDataFrame(sorted(pairs), "i1 long, i2 long")
    assert {r.i: r.label for r in dbscan(nodes, links, min_pts).collect()} == dbscan_by_loop(n, pairs, min_pts)
    both = neighbors(links)
    deg = {i: 1 + sum(i in p for p in pairs) for i in range(n)}
    assert {r.i: r.degree for r in degrees(nodes, both).collect()} == deg
    assert {r.i for r in core_points(nodes, both, min_pts).collect()} == {i for i, d in deg.items() if d >= min_pts}


@pytest.mark.parametrize("seed,min_pts,chunk", [(0, 2, None), (1, 4, None), (2, 3, 20)])
def test_copies_are_labelled_as_if_expanded(spark, seed, min_pts, chunk):
    rng = random.Random(seed)
    words = ["".join(rng.choice("AC") for _ in range(7)) for _ in range(14)]
    texts = [rng.choice(words) for _ in range(60)]
    rows = spark.createDataFrame([(i, s, i // (chunk or 1000)) for i, s in enumerate(texts)], "i long, s string, part long")
    found = edit_join_exact(rows, 1, "i", "s", group_col="part" if chunk else None)
    pairs = {(r.id1, r.id2) for r in found.pairs().collect() if not chunk or r.id1 // chunk == r.id2 // chunk}
    got = {r.i: r.label for r in labels_of(rows, found, min_pts).collect()}
    assert got == dbscan_by_loop(len(texts), pairs, min_pts)


def test_border_takes_the_first_cluster(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "i long")
    links = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (4, 5), (4, 6), (5, 6), (2, 3), (3, 4)], "i1 long, i2 long")
    got = {r.i: r.label for r in dbscan(nodes, links, 4).collect()}
    assert got == dbscan_by_loop(7, {(0, 1), (0, 2), (1, 2), (4, 5), (4, 6), (5, 6), (2, 3), (3, 4)}, 4)
    assert got[3] == 1


def test_consensus_ties_and_ragged_ends(spark):
    rows = spark.createDataFrame([(1, "CA"), (1, "AAG"), (2, "T"), (-1, "GGG"), (3, "")], "label int, s string")
    assert {tuple(r) for r in consensus(rows).collect()} == {(1, "AAG", 2), (2, "T", 1), (3, "", 1)}
    assert {r.consensus for r in consensus(rows, 2).collect()} == {"AA", "T", ""}
    with pytest.raises(Exception, match="outside the alphabet"):
        consensus(rows, None, "AG").collect()


def test_numbers_are_dense_and_ordered(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(10_000), 500)], "x long")
    got = sorted((r.x, r.n) for r in numbered(df, "x", name="n", first=3).collect())
    assert [n for _, n in got] == list(range(3, 503))


def test_few_rows_with_large_numbers_are_one_chunk(spark):
    p = JoinParams(num_str=4, num_hash=6, num_bits=6, alphabet=4, k=1, shift=1, sampling_range=4, min_pts=3, chunk_size=100)
    for ids in ([0, 1, 2, 3], [0, 1000, 2000, 3000]):
        rows = spark.createDataFrame([(i, "ACGT") for i in ids], "i long, s string")
        for exact in (True, False):
            assert [(r.consensus, r.points) for r in cluster(rows, p, exact).collect()] == [("ACGT", 4)]


def test_chunks_never_meet(spark):
    rows = spark.createDataFrame([(k, "ACGTACGT", k // 3) for k in range(9)], "i long, s string, part long")
    p = JoinParams(num_str=2, num_hash=3, num_bits=3, alphabet=4, k=2, shift=2, sampling_range=6)
    want = {(i, j) for i in range(9) for j in range(i + 1, 9) if i // 3 == j // 3}
    joins = [edit_join_exact(rows, 2, "i", "s", group_col="part"), *(edit_join_lsh(rows, p, "i", "s", plan=plan, group_col="part") for plan in ("buckets", "segments"))]
    for found in joins:
        assert {(r.id1, r.id2) for r in found.pairs().collect()} == want


def test_cluster_in_one_and_two_levels(spark):
    rng = random.Random(4)
    seeds = ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(4)]
    reads = [s[:k] + rng.choice("ACGT") + s[k + 1 :] for _ in range(12) for s in seeds for k in [rng.randrange(30)]]
    rows = spark.createDataFrame(list(enumerate(reads)), "i long, s string")
    p = JoinParams(num_str=4, num_hash=6, num_bits=6, alphabet=4, k=4, shift=4, sampling_range=40, min_pts=3)
    for exact in (True, False):
        got = cluster(rows, p, exact, "ACGTN").collect()
        assert {r.consensus for r in got} == set(seeds) and all(r.points == r.reads == 12 for r in got)
    two = JoinParams(num_str=4, num_hash=6, num_bits=6, alphabet=4, k=4, shift=4, sampling_range=40, min_pts=3, chunk_size=16)
    got = cluster(rows, two, True).collect()
    assert {(r.consensus, r.points, r.reads) for r in got} == {(s, 3, 12) for s in seeds}
    # Rows are counted, not their numbers.
    apart = rows.selectExpr("i * 1000 + 7 AS i", "s")
    assert {(r.consensus, r.points, r.reads) for r in cluster(apart, two, True).collect()} == {(s, 3, 12) for s in seeds}
    assert {r.consensus for r in cluster(apart, p, True).collect()} == set(seeds)
    assert cluster(rows.limit(0), p).count() == 0
    assert cluster(rows.where("i = 0"), p).count() == 0
