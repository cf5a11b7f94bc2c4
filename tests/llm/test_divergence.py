import random
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__
from threadloom.llm.divergence import audit, share


def brute(rows, least, top):
    """Rows (text, lang, source) by the definition, with Python's integers."""
    docs = [(lang or "", source or "", terms(text or "")) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == lang]
        in_ = Counter(t for _, _, w in mine for t in set(w))
        kept = [t for t in in_ if in_[t] >= least]
        counts = {s: Counter(t for _, z, w in mine if z == s for t in w if in_[t] >= least) for s in {x[1] for x in mine}}
        whole = sum(counts.values(), Counter())

        def p(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        shares, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in shares:
            pair = [(sum(abs(shares[s][t] - shares[z][t]) for t in kept), z) for z in shares if z != s]
            more = [(shares[s][t] - q[t], t) for t in kept if counts[s][t] and shares[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", more, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def terms(text):
    out, word = [], ""
    for c in text + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "a" <= c <= "z" or c > "\x7f":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def table(spark, rows):
    """Columns whose names clash with results, and one with a dot."""
    schema = "`a.text` string, lang string, source string, item long, term string, n long, gid long"
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema)


def found(frame):
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("sizes", [(512, 256), (5, 3), (1, 1), (4, 2)])
def test_equals_brute_force(spark, sizes):
    rng = random.Random(5)
    words = ["the", "Of", "ÉTÉ", "漢字", "a-b", "x1y", "né", "zoo", "Ωm", "it's", "퟿q", "🙂"]
    rows = [(" ".join(rng.choices(words, [20 - k for k in range(12)], k=rng.randrange(30))), rng.choice(["en", "fr", None, ""]), rng.choice("abcdefg")) for _ in range(120)]
    rows += [(None, "en", "silent"), ("", "en", None), ("the " * 5000, "en", "a"), ("rare words only", "de", "p"), (None, "de", "q"), ("lonely", "it", "s")] + [rows[0]] * 3
    assert found(audit(table(spark, rows), text_col="a.text", least=4, top=3, sides=sizes)) == brute(rows, 4, 3)


def test_empty_tables(spark):
    assert found(audit(table(spark, []), text_col="a.text")) == []
    got = found(audit(table(spark, [(None, None, None), ("x", None, "s")]), text_col="a.text"))
    assert got == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(300):
        v, n = rng.randrange(1, 10**6), rng.randrange(10 ** rng.randrange(1, 16))
        c = rng.randrange(n + 1)
        if n + 5 * v < (1 << 63) // 1000 - 1:
            assert share(np.array([c]), n, v).tolist() == [1 + 10**9 * (c + 5) // (n + 5 * v)]
    with pytest.raises(OverflowError):
        share(np.array([1]), 10**16, 1)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op12_equals_its_oracle(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = sorted(db.sql(__spark_entry__.oracle_sql()["op12_divergence"]).fetchall())
    assert found(__spark_entry__.queries()["op12_divergence"](spark, f"/root/testdata/{sf}")) == want and want
