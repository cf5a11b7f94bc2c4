"""URL filter: rules, then host word segmentation and multinomial naive Bayes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrow_text import beside, few, quoted
from threadloom.plans.scratch import cut, drop


#: Log10 probability of an unknown word, and of each of its characters.
UNKNOWN, PER_CHAR = -4.0, -1.3
#: A word of the urls and pages is a unigram from this many counts on and from this share of all counts on, so there are at most
#: as many as the share's inverse however many urls and pages there are; the same share of all labelled words bounds the evidence.
LEAST_COUNT, LEAST_SHARE = 5, 1 / 200_000
#: Letters that each part of a chain of words has at least.
CHAIN = 3
#: Letters from which a known word counts beside an unknown rest; shorter ones stand in too many words (threads, Tibet).
TELLING = 5
#: Rules above which they are a table to join instead of a chain of conditions, and up to which that table is sent to every task.
CHAINED_RULES, SENT_RULES = 64, 100_000

_NAME = re.compile(r"[^\W\d_]+|[0-9]+")
_EXTENSION = re.compile(r"\.(?:html?|xhtml|shtml|php[0-9]?|aspx?|jspx?|cgi|xml|json|txt|pdf|css|js|png|jpe?g|gif|svg)$", re.IGNORECASE)


@dataclass(frozen=True)
class Rule:
    action: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1] if "/" in self.text else ""


def _lower(c: F.Column) -> F.Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.coalesce(_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: Sequence[Rule], host: F.Column, path: F.Column, value) -> F.Column:
    """``value(rule)`` of the longest rule whose host is the url's or a parent of it and whose path begins the
    url's, of equally long ones the last by text; null if none fits."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def matched_by_join(given: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``given`` with ``rule`` and ``_tl_action`` as ``matched`` finds them, for any number of rules.

    Each different (host, path) looks up its host's suffixes, and under each the beginnings of its path that are as long
    as some rule's there: two equi-joins, then an aggregation that keeps the longest. Up to ``SENT_RULES`` rules go to every task, so that
    a suffix that most hosts share is no hot key. A null or malformed url (empty host) meets only rules without host, by conditions.
    """
    spark = given.sparkSession
    rows = [(r.host, r.path, len(r.path), len(r.text), r.text, k, r.action) for k, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "suffix string, start string, size int, length int, text string, k int, action string")
    sent = F.broadcast if len(rows) <= SENT_RULES else (lambda df: df)
    sizes = table.groupBy("suffix").agg(F.collect_set("size").alias("sizes"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = given.where("host <> ''")
    urls = named.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    starts = urls.join(sent(sizes), "suffix").select("host", "path", "suffix", F.explode("sizes").alias("size")).where(F.col("size") <= F.length("path"))
    met = starts.select("host", "path", "suffix", F.expr("substring(path, 1, size)").alias("start")).join(sent(table), ["suffix", "start"])
    best = met.groupBy("host", "path").agg(F.max(F.struct("length", "text", "k", "action")).alias("best"))
    found = named.join(best, ["host", "path"], "left").select(*given.columns, F.col("best.text").alias("rule"), F.col("best.action").alias("_tl_action"))
    bare = [r for r in rules if not r.host]
    value = lambda of: matched(bare, F.col("host"), F.col("path"), of)
    rest = given.where("host = ''").select(*given.columns, value(lambda r: r.text).alias("rule"), value(lambda r: r.action).alias("_tl_action"))
    return found.unionByName(rest)


def _parts(name: str) -> list[str]:
    return _NAME.findall(name.lower())


@dataclass
class Model:
    """Unigram log-probabilities for segmentation and per-word evidence for blocking."""

    words: dict[str, float]
    evidence: dict[str, float]
    prior: float
    _parts: dict[str, list[str]] = field(default_factory=dict, repr=False)

    @cached_property
    def longest(self) -> int:
        """Letters of the longest unigram; a longer run is one unknown word only in parts."""
        return max(map(len, self.words), default=1)

    def segment(self, part: str) -> list[str]:
        """Most likely split of a run of letters (Viterbi over unigrams)."""
        if part.isdigit():
            return ["#"]
        known = self._parts.get(part)
        if known is not None:
            return known
        best = [0.0] + [-math.inf] * len(part)
        back = [0] * (len(part) + 1)
        for end in range(1, len(part) + 1):
            for start in range(max(0, end - self.longest), end):
                s = self.words.get(part[start:end])
                s = best[start] + (UNKNOWN + PER_CHAR * (end - start) if s is None else s)
                if s > best[end]:
                    best[end], back[end] = s, start
        out, end = [], len(part)
        while end:
            out.append(part[back[end] : end])
            end = back[end]
        if len(self._parts) > 200_000:
            self._parts.clear()
        self._parts[part] = out[::-1]
        return out[::-1]

    def split(self, part: str) -> list[str]:
        """``segment``, but whole where a rest is unknown and no known word beside it has ``TELLING`` letters."""
        found = self.segment(part)
        if len(found) > 1 and any(w not in self.words for w in found) and not any(w in self.words and len(w) >= TELLING for w in found):
            return [part]
        return found

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host, its last label too, then of the path without a file's extension."""
        name = host.rsplit(":", 1)[0]
        return [w for part in _parts(name) + _parts(_EXTENSION.sub("", path)) for w in self.split(part)]

    def score(self, tokens: list[str]) -> float:
        """Chance that the url is to be blocked; words that were not learned say nothing."""
        z = self.prior + sum(self.evidence.get(t, 0.0) for t in tokens)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def word_counts(urls: DataFrame, url_col: str = "url", html_col: str | None = None) -> DataFrame:
    """``w`` and ``n`` of every word of all ``urls``: once for each different host that has it, so that a site's pages do not
    vote for its name, once for each time that it stands in a path, and where ``html_col`` is given once for each time that it
    stands in a page, outside its tags."""
    host, path = host_and_path(F.col(quoted(url_col)).cast("string"))
    given = urls.select(host.alias("host"), path.alias("path"))
    name = F.regexp_replace("host", ":[^:]*$", "")
    words = lambda c: F.explode(F.split(F.lower(c), r"[^\p{L}]+")).alias("w")
    hosts = given.select("host").distinct().select(words(name)).groupBy("w").agg(F.count("*").alias("n"))
    found = hosts.unionByName(given.select(words(F.col("path"))).groupBy("w").agg(F.count("*").alias("n")))
    if html_col is not None:
        said = F.regexp_replace(F.col(quoted(html_col)).cast("string"), "<[^>]*>", " ")
        found = found.unionByName(urls.select(words(said)).groupBy("w").agg(F.count("*").alias("n")))
    return found.where("w <> ''").groupBy("w").agg(F.sum("n").alias("n"))


def unigrams(counts: dict[str, int]) -> dict[str, float]:
    """Log10 probabilities of counted words. A word that is a chain of words, each of ``CHAIN`` letters at least and as frequent as itself, is none of
    them: kept whole it would hide what it is made of."""
    total = sum(counts.values())
    words = {w: math.log10(n / total) for w, n in counts.items()}
    model = Model(words, {}, 0.0)
    chains = []
    for w in sorted(words, key=len):
        if len(w) >= 2 * CHAIN:
            own = words.pop(w)
            found = model.segment(w)
            model._parts.clear()
            words[w] = own
            if all(len(x) >= CHAIN and counts.get(x, 0) >= counts[w] for x in found):
                chains.append(w)
    return {w: p for w, p in words.items() if w not in set(chains)}


def labelled_counts(urls: DataFrame, rules: Sequence[Rule], model: Model, url_col: str = "url") -> DataFrame:
    """``w``, ``action``, ``n``: words of the different urls that a rule decides, as the model segments them. Tasks add up before anything is shuffled."""
    host, path = host_and_path(F.col(quoted(url_col)).cast("string"))
    given = urls.select(host.alias("host"), path.alias("path"))
    if len(rules) > CHAINED_RULES:
        given = matched_by_join(given, rules)
    else:
        given = given.withColumn("_tl_action", matched(rules, F.col("host"), F.col("path"), lambda r: r.action))
    decided = given.where("_tl_action is not null").select("host", "path", "_tl_action").distinct()
    shared = urls.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found: Counter = Counter()
            for h, p, action in zip(*(b.column(k).to_pylist() for k in range(3))):
                found.update((w, action) for w in m.tokens(h, p))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], ["w", "action", "n"])

    return decided.mapInArrow(run, "w string, action string, n long").groupBy("w", "action").agg(F.sum("n").alias("n"))


def fit(urls: DataFrame, rules: Sequence[Rule] = (), url_col: str = "url", html_col: str | None = None, prior: float = 0.2, alpha: float = 0.5) -> Model:
    """Unigrams from the words of all ``urls`` (and of their pages); naive Bayes from the urls that ``rules`` decide.

    There is no list of words: what a rule blocks or allows is the label of its url, and a word is evidence by how often it stands in urls of
    either label, so that hosts and paths like the blocked ones are judged like them where no rule says anything. Without labels of both kinds
    there is no evidence, and ``prior`` is the score. All words and all labelled urls are counted; the counts are bounded by ``LEAST_SHARE``.
    """
    counted = cut(word_counts(urls, url_col, html_col), "url-words")
    every = counted.agg(F.sum("n")).first()[0] or 0
    words = {r.w: r.n for r in counted.where(F.col("n") >= max(LEAST_COUNT, every * LEAST_SHARE)).collect()}
    drop(counted)
    model = Model(unigrams(words), {}, math.log(prior / (1 - prior)))
    labels = cut(labelled_counts(urls, rules, model, url_col), "url-labels") if rules else None
    if labels is None:
        return model
    size = {r.action: r.n for r in labels.groupBy("action").agg(F.sum("n").alias("n")).collect()}
    if not (size.get("block") and size.get("allow")):
        return model
    found = labels.groupBy("w").pivot("action", ["block", "allow"]).agg(F.sum("n")).na.fill(0)
    kept = found.where(F.col("block") + F.col("allow") >= max(1, sum(size.values()) * LEAST_SHARE)).collect()
    whole = [size[a] + alpha * len(kept) for a in ("block", "allow")]
    model.evidence = {r.w: math.log((r.block + alpha) / whole[0]) - math.log((r.allow + alpha) / whole[1]) for r in kept}
    drop(labels)
    return model


def judge(pages: DataFrame, model: Model, rules: Sequence[Rule] = (), url_col: str = "url") -> DataFrame:
    """``row`` (all columns), ``host``, ``path``, ``rule``, ``tokens``, ``score`` and ``verdict`` of every row.

    ``verdict`` is the action of the longest fitting rule, else ``block`` where the classifier's ``score`` is above one half
    and ``allow`` otherwise. A null url, an empty one and one without ``://`` have empty host and path, no tokens
    and the classifier's prior; no rule with a host fits an empty one. Any number of rules works: beyond ``CHAINED_RULES`` they
    are joined. Of equally long rules the last by text wins. Repeated rows are judged alike; a very long url is judged whole
    (its words are split in time proportional to its length); an empty table gives an empty result. Columns of any name
    travel in ``row``.
    """
    given = pages.select(F.struct(*map(quoted, pages.columns)).alias("row"), F.col(quoted(url_col)).cast("string").alias("_tl_url"))
    host, path = host_and_path(F.col("_tl_url"))
    given = given.select("row", host.alias("host"), path.alias("path"))
    if len(rules) > CHAINED_RULES:
        given = matched_by_join(given, rules)
    else:
        given = given.withColumn("rule", matched(rules, F.col("host"), F.col("path"), lambda r: r.text))
        given = given.withColumn("_tl_action", matched(rules, F.col("host"), F.col("path"), lambda r: r.action))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in few(batches):
            tokens = [m.tokens(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            score = [m.score(t) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(tokens, pa.list_(pa.string())), pa.array(score, pa.float64())], [*b.schema.names, "tokens", "score"]
            )

    found = given.mapInArrow(run, beside(given, "tokens array<string>, score double"))
    verdict = F.coalesce("_tl_action", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return found.select("row", "host", "path", "rule", "tokens", "score", verdict.alias("verdict"))
