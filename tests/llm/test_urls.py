import inspect
import math
import random
import re
from collections import Counter
from itertools import product

import pytest

from threadloom.llm.queries import URL_RULES
from threadloom.llm import urls as urls_
from threadloom.llm.urls import PER_CHAR, UNKNOWN, Model, Rule, fit, judge, unigrams, word_counts

URLS = [
    "https://www.example.com/en/7?x=1", "http://EXAMPLE.com/en/71#a", "http://notexample.com/en/7", "https://a.b.net/de/8", "http://example.net/de/81", "http://m.example.net/de/9",
    "ftp://x.org/es/", "x.org/es/1", "http://org/es/1", "http://.org/es/1", "http://a.com/EN/1", "http://ÄB.com/en/", None, "", "://", "http://", "http://h?q=/en/", "a://b://c.com/en/1",
    "http://casino-win.de/fr/1", "http://casinowin.de/", "http://city-library.de/books", "http://a.com:80/en/1", "http://user@a.com/en/", "http://a.com/x\ny?z", "http://" + "a" * 5000 + ".com/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_for(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_verdicts(spark):
    pages = spark.createDataFrame([(k, u, "h", "p", 1) for k, u in enumerate(URLS)] + [(None, URLS[0], "h", "p", 1)], "page_id long, url string, host string, path string, rule int")
    model = fit(pages, URL_RULES)
    got = judge(pages, model, URL_RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = parts(r.row.url)
        rule = rule_for(host, path)
        score = model.score(model.tokens(host, path))
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None)
        assert r.verdict == (rule.action if rule else "block" if score > 0.5 else "allow") and math.isclose(r.score, score)
    assert judge(pages.limit(0), fit(pages.limit(0), URL_RULES), URL_RULES).count() == 0


def test_segmentation_is_the_best_split():
    words = {"casino": -2.0, "win": -2.5, "in": -1.5, "a": -1.0, "cas": -3.0, "o": -2.0}
    model = Model(words, {}, 0.0)
    cost = lambda split: sum(words.get(w, UNKNOWN + PER_CHAR * len(w)) for w in split)
    for text in ["casinowin", "inawin", "xyzin", "winwin", "q", "casi"]:
        best = -math.inf
        for cuts in product([0, 1], repeat=len(text) - 1):
            split, last = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    split.append(text[last:k])
                    last = k
            best = max(best, cost([*split, text[last:]]))
        assert math.isclose(cost(model.segment(text)), best) and "".join(model.segment(text)) == text


#: Hosts of two kinds, made of words that no list of the library holds; the rules know some of them.
BAD, GOOD, ANY = "zorq vlim plonk druss".split(), "quell marn tolv ebbet".split(), "home list page item".split()


def made_urls(seed, n):
    """Urls of hosts that a rule decides (under block.zz and allow.zz) and of others that are made of the same words."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words, zone = rng.choice([(BAD, "block"), (GOOD, "allow")])
        name = rng.choice(["-", ""]).join(rng.sample(words, 2))
        zone = f"{zone}.zz" if k % 2 else "other.yy"
        out.append((f"http://{name}{k}.{zone}/{rng.choice(ANY)}/{rng.choice(words)}/{k}.html", words is BAD))
    return out


RULES = (Rule("block", "block.zz"), Rule("allow", "allow.zz"))


def naive_bayes(rows, prior, alpha):
    """Evidence of each word from rows (tokens, blocked), by the definition."""
    counts = {True: Counter(), False: Counter()}
    for tokens, blocked in rows:
        counts[blocked].update(tokens)
    words = set(counts[True]) | set(counts[False])
    p = {b: {w: (counts[b][w] + alpha) / (sum(counts[b].values()) + alpha * len(words)) for w in words} for b in counts}

    def score(tokens):
        one, two = (math.log(q) + sum(math.log(p[b][t]) for t in tokens if t in words) for b, q in ((True, prior), (False, 1 - prior)))
        return 1 / (1 + math.exp(two - one))

    return score


def test_evidence_is_learned_from_what_rules_decide(spark):
    """Hosts that no rule knows are judged by the words that decided ones have; an independent naive Bayes gives the same scores."""
    rows = made_urls(1, 400)
    frame = spark.createDataFrame([(u,) for u, _ in rows] + [(rows[1][0],)] * 5, "`u.rl` string")
    model = fit(frame, RULES, "u.rl")
    got = {r.row["u.rl"]: r for r in judge(frame, model, RULES, "u.rl").collect()}
    open_ = [(u, bad) for u, bad in rows if got[u].rule is None]
    assert len(open_) == 200
    right = [(got[u].verdict == "block") == bad for u, bad in open_]
    assert sum(right) / len(right) > 0.98
    decided = [(got[u].tokens, got[u].verdict == "block") for u in {u for u, _ in rows} if got[u].rule]
    score = naive_bayes(decided, 0.2, 0.5)
    assert all(math.isclose(r.score, score(r.tokens), rel_tol=1e-9) for r in got.values())
    assert len({round(x, 9) for x in model.evidence.values()}) > 10
    assert model.segment("zorqvlim") == ["zorq", "vlim"]


def test_without_labels_there_is_no_evidence(spark):
    """No word carries evidence that the data did not give it, not even those of the planted hosts."""
    names = "casino-win free-bets ads-track spam-farm cheap-pills adult-x poker viagra".split()
    frame = spark.createDataFrame([(f"http://{n}.com/{k}",) for n in names for k in range(9)], "url string")
    for rules in ((), (Rule("block", "nowhere.zz"),), (Rule("block", "casino-win.com"),)):
        model = fit(frame, rules)
        assert not model.evidence and {round(r.score, 9) for r in judge(frame, model).collect()} == {0.2}
    source = inspect.getsource(urls_)
    assert not any(w in source for name in names for w in name.split("-") if len(w) > 3 and w not in ("free", "track"))


def test_many_rules_give_what_few_give(spark):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)] + [(None, URLS[0])], "page_id long, url string")
    model = Model({}, {}, 0.0)
    more = [Rule("block", f"a{k}.b/") for k in range(700)] + [Rule("allow", "a7.b/"), Rule("block", "net"), Rule("allow", "/"), Rule("block", "h/")]
    got = judge(pages, model, [*URL_RULES, *more]).collect()
    few_rules = [*URL_RULES, *more[-3:]]
    want = {r.row.url: (r.rule, r.verdict) for r in judge(pages, model, few_rules).collect()}
    assert len(got) == len(URLS) + 1 and {r.row.url: (r.rule, r.verdict) for r in got} == want
    far = spark.createDataFrame([("http://x.a699.b/q",), ("http://a7.b/",), ("http://xa7.b/",)], "url string")
    assert [(r.rule, r.verdict) for r in judge(far, model, [*URL_RULES, *more]).orderBy("row.url").collect()] == [("a7.b/", "allow"), ("a699.b/", "block"), (None, "allow")]


def test_chains_of_frequent_words_are_taken_apart(spark):
    urls = [f"http://www.site{k}.fr/uploads/{k}" for k in range(40)] + [f"http://s{k}.fr/foodbets/{k}" for k in range(40)]
    urls += [f"http://food-{k}.fr/bets/{j}" for k in range(12) for j in range(9)]
    counts = {r.w: r.n for r in word_counts(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert counts["foodbets"] == 40 and counts["food"] == 12 and counts["bets"] == 108 and counts["www"] == 40
    assert Model(unigrams(counts), {}, 0.0).segment("foodbets") == ["foodbets"]
    assert Model(unigrams(counts | {"food": 50}), {}, 0.0).segment("foodbets") == ["food", "bets"]


def test_long_words_are_known(spark):
    long = "donaudampfschifffahrtsgesellschaftskapitaen"
    model = fit(spark.createDataFrame([(f"http://s{k}.de/{long}",) for k in range(9)], "url string"))
    assert model.longest == len(long) and model.segment(long) == [long]


def test_hosts_of_one_label_and_of_other_letters(spark):
    model = fit(spark.createDataFrame([("http://größe.example/ünïcode/наука",)] * 6, "url string"))
    assert model.tokens("größe", "/") == ["größe"] and model.tokens("größe:8080", "/наука") == ["größe", "наука"]
    assert model.tokens("größe.example", "/ünïcode/наука.html") == ["größe", "example", "ünïcode", "наука"]


def test_words_of_pages_are_counted(spark):
    pages = spark.createDataFrame([("http://a.b/", "<p class=hidden>Quokka quokka</p> quokka <b>x</b>")] * 4, "url string, html string")
    assert {r.w: r.n for r in word_counts(pages, html_col="html").collect()} == {"quokka": 12, "x": 4, "a": 1, "b": 1}
    assert "quokka" in fit(pages, html_col="html").words and "quokka" not in fit(pages).words


def test_repeated_rows_are_judged_alike(spark):
    pages = spark.createDataFrame([(1, "http://poker.de/x"), (1, "http://poker.de/x")], "page_id long, url string")
    out = [r.asDict(True) for r in judge(pages, fit(pages, URL_RULES), URL_RULES).collect()]
    assert out[0] == out[1] and out[0]["verdict"] == "allow"
