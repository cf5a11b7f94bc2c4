import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from threadloom.llm import trie
from threadloom.llm.trie import end_lists, merged, ordered, prefix_trie, with_heads_of

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(paths):
    """Nodes of conversations (id -> list of (role, text)) by the definition."""
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(rows):
    """The query's conversations from rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + path[h:]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth long, c string, `k.1` long")


def found(frame):
    assert frame.columns == COLUMNS and all(t in ("bigint", "string") for _, t in frame.dtypes)
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def run(conversations):
    """The query, on any table."""
    turns = ordered(conversations)
    again = with_heads_of(turns, F.col("c") - F.col("c") % 5, F.crc32(F.col("c").cast("string")) % 9, 8)
    return prefix_trie(again, turns.select("c").distinct())


def conversations(rng, n, long=0):
    rows = []
    for c in rng.sample(range(-20, 3 * n), n):
        for t in range(rng.choice([0, 1, 2, 5, 12])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "Grüße 漢", f"own {c % 3}"])))
    rows += [(7, t, "user", "again" if t % 3 else f"turn {t}") for t in range(long)]
    rows += [(None, 0, "user", "nobody's")] * 2 + rows[:5]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("spread", [False, True])
def test_equals_brute_force(spark, spread):
    """Also where one conversation has most rows and spans all ranges."""
    rows = conversations(random.Random(6), 60, 600 * spread)
    if spread:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = found(run(table(spark, rows)))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rebuilt(rows))


def test_plain_trie_and_copies(spark, prose):
    paths = {c: [("user", prose(c % 3, 4)), ("assistant", prose(c % 7, 9))][: 1 + c % 2] for c in range(200)}
    paths |= {1000: [], 1001: []}
    rows = [(c, d, *turn) for c, path in paths.items() for d, turn in enumerate(path)]
    ids = spark.createDataFrame([(c,) for c in paths], "c long")
    assert found(prefix_trie(ordered(table(spark, rows)), ids)) == brute(paths)


def test_role_and_text_are_apart(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "", "abc"), (4, 0, "abc", ""), (5, 0, "a", "bc")]
    assert len(found(prefix_trie(ordered(table(spark, rows)), spark.createDataFrame([(c,) for c in range(1, 6)], "c long")))) == 5


def test_empty_tables(spark):
    assert found(run(table(spark, []))) == [] == found(run(table(spark, [(None, 1, "user", "x")])))
    turnless = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert found(run(table(spark, [(turnless, 0, "user", "x")]))) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_lists_in_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "LIST_IDS", 3)
    rng = random.Random(1)
    rows = [(0 if k % 3 else k % 11, k % 2, k - 400) for k in range(900)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    got = {(r.k1, r.k2): r.ends_sha256 for r in end_lists(spark.createDataFrame(rows, "k1 long, k2 long, c long")).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = defaultdict(list)
    for k1, k2, c in sorted(rows):
        want[k1, k2].append(str(c))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


@pytest.mark.parametrize("parts", [1, 64, 5000])
def test_rounds_of_merging(spark, parts):
    rows = [(k % 3, 0, k % parts, 1, k, 2, 3, 4, 5) for k in range(5000)]
    got = merged(spark.createDataFrame(rows, "k1 long, k2 long, part int, n long, owner long, depth long, bytes long, p1 long, p2 long"), parts)
    assert sorted((r.k1, r.n, r.owner, r.p2) for r in got.collect()) == [(0, 1667, 0, 5), (1, 1667, 1, 5), (2, 1666, 2, 5)]


def test_the_oracle_is_the_definition():
    """SQL and brute force agree, also on negative ids, nulls, ties and absent bases."""
    rows = conversations(random.Random(11), 70)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = db.sql(__spark_entry__.oracle_sql()["op13_trie"])
    assert sorted(got.select(*COLUMNS).fetchall(), key=repr) == brute(rebuilt(rows))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_as_registered(spark, sf):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '/root/testdata/{sf}/conversations.parquet'").fetchall()
    assert found(__spark_entry__.queries()["op13_trie"](spark, f"/root/testdata/{sf}")) == brute(rebuilt(rows))
