"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrow_text import apart, beside, each, frugal, quoted
from threadloom.plans.scratch import cut, drop

#: Labelled rows of each class that the classifier is fitted on, in expectation.
SAMPLE_PER_CLASS = 6000
#: Bytes beyond which a labelled text is left out of the sample (not of scoring), which bounds the vocabulary that is learned.
SAMPLE_TEXT = 1 << 17
#: Letters of a word's beginning that set the prior of its log-odds, and the weights of the two priors.
STEM, WORD_PRIOR, STEM_PRIOR = 4, 2.0, 4.0
#: Cost of a token, which makes the expected score of ordinary text negative.
DRIFT = 0.7
#: Expected number of segments as good in ordinary text of the same length, below which one counts as significant.
SIGNIFICANT = 0.05
#: Scores a worker remembers.
CACHE = 300_000

_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: bytes) -> list[str]:
    return _TOKEN.findall(text.decode().lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) in linear time.

    Only runs around positive scores can begin or end one, so the list is first brought down to them; each is then
    appended, and joined with an earlier one while its prefix sum allows (Ruzzo and Tompa).
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    out: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum at its end, last with a lower sum before
    for i, before, after in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist()):
        first = i
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= after:
                out.append((first, i + 1, before, after, j))
                break
            first, before = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, y - x) for a, b, x, y, _ in out]


@dataclass
class Model:
    """Log-odds by word and by stem, the extreme-value law of ordinary texts, and the final weights."""

    words: dict[str, float]
    stems: dict[str, float]
    decay: float = 1.0
    scale: float = 0.1
    weights: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def __post_init__(self):
        self._known: dict[str, float] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._known = {}

    def token_scores(self, words: list[str]) -> np.ndarray:
        """A word that only repeats the one before it is no further evidence."""
        known = self._known
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            s = self.words.get(w)
            known[w] = (self.stems.get(w[:STEM], 0.0) if s is None else s) - DRIFT
        out = np.fromiter(map(known.__getitem__, words), float, len(words))
        out[1:][np.fromiter(map(eq, words, words[1:]), bool, max(0, len(words) - 1))] = -DRIFT
        return out

    def passages(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """Maximal segments with their E-values: first word, end word, score, E."""
        n = max(1, len(words))
        return [(a, b, s, self.scale * n * math.exp(-self.decay * s)) for a, b, s in segments(self.token_scores(words))]

    @staticmethod
    def features(found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """How far the best passage lies beyond chance, and the sum of that over the significant ones."""
        beyond = [-math.log(max(e, 1e-300)) for _, _, _, e in found]
        best = max(beyond, default=0.0)
        return min(30.0, max(0.0, best)), math.log1p(sum(b for b in beyond if b > -math.log(SIGNIFICANT)))

    def score(self, found: list[tuple[int, int, float, float]]) -> float:
        x, y = self.features(found)
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * x + c * y))))


def _log_odds(words: dict[str, tuple[int, int]], stems: dict[str, tuple[int, int]], rows: tuple[int, int]) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds against the rate of all rows, with Dirichlet priors: a stem's is the overall rate, a word's is its
    stem's. Counts are of texts; words and stems that say nothing are left out."""
    base = rows[1] / sum(rows)
    logit = lambda p: math.log(p / (1 - p))
    rate = {s: (b + STEM_PRIOR * base) / (a + b + STEM_PRIOR) for s, (a, b) in stems.items()}
    by_stem = {s: logit(p) - logit(base) for s, p in rate.items()}
    by_word = {}
    for w, (a, b) in words.items():
        prior = rate.get(w[:STEM], base)
        v = logit((b + WORD_PRIOR * prior) / (a + b + WORD_PRIOR)) - logit(base)
        if v > 0.2 or by_stem.get(w[:STEM], 0) > 0.2:
            by_word[w] = min(v, 8.0)
    return by_word, {s: min(v, 8.0) for s, v in by_stem.items() if v > 0.2}


def gumbel(lengths: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """Decay and scale of P(best <= s) = exp(-scale * length * exp(-decay * s)), by maximum likelihood."""
    some = (best > 0) & (lengths > 0)
    n, s = lengths[some].astype(float), best[some]
    if len(s) < 5 or np.ptp(s) == 0:
        return 1.0, 0.1

    def gap(d: float) -> float:
        w = n * np.exp(-d * (s - s.min()))
        return 1 / d - s.mean() + (w * s).sum() / w.sum()

    lo, hi = 1e-3, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gap(mid) > 0 else (lo, mid)
    return lo, float(len(s) / (n * np.exp(-lo * s)).sum())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights, intercept first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 3.0 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, per_class: int) -> list[tuple[int, int]]:
    """About ``per_class`` ids of each class with their label, picked by the id's hash. An id that is labelled more
    than once counts as toxic if one label says so."""
    known = labels.where(F.col(quoted(id_col)).isNotNull() & F.col(quoted(label_col)).isin(0, 1)).groupBy(F.col(quoted(id_col)).cast("long").alias("id")).agg(F.max(quoted(label_col)).cast("int").alias("y"))
    pick = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    most = F.lit(0)
    for r in known.groupBy("y").agg(F.count("*").alias("n")).collect():
        most = F.when(F.col("y") == r.y, int((1 << 30) * min(1.0, per_class / r.n))).otherwise(most)
    return sorted((r.id, r.y) for r in known.where(pick < most).collect())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """A model from about ``per_class`` labelled rows of each class, of at most ``SAMPLE_TEXT`` bytes each; none if a class has
    no such row.

    Two thirds of the sample set the log-odds. The others, whose words had no part in that, set the extreme-value law
    (those labelled 0) and the final weights, weighted to the class sizes of ``labels``.
    """
    spark = docs.sparkSession
    sample = labelled_sample(labels, id_col, label_col, per_class)
    if len({y for _, y in sample}) < 2:
        return None
    table = spark.createDataFrame(sample, "id long, y int")
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(table), "id")
    texts = texts.where(F.octet_length("text") <= SAMPLE_TEXT).select("y", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 2).alias("held"), "text")
    texts = cut(texts, "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for y, t in zip(b.column(0).to_pylist(), each(b.column(2))):
                words = set(tokens(t))
                seen[y].update(words)
                seen[y].update({"\t" + w[:STEM] for w in words})
                seen[y]["\n"] += 1
            names = sorted(set(seen[0]) | set(seen[1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[w] for w in names], pa.int64()) for s in seen)], ["w", "n0", "n1"])

    counts = texts.where("not held").mapInArrow(frugal(count), "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = {r.w: (r.n0, r.n1) for r in counts.where("n1 > 1 or n0 > 1").collect()}
    rows = got.pop("\n", (0, 0))
    if not min(rows):
        return None
    words, stems = _log_odds({w: c for w, c in got.items() if w[0] != "\t"}, {w[1:]: c for w, c in got.items() if w[0] == "\t"}, rows)
    model = Model(words, stems)
    ordinary = _measure(texts.where("held and y = 0"), model).collect()
    model.decay, model.scale = gumbel(np.array([r.n for r in ordinary]), np.array([r.best for r in ordinary]))
    measured = _measure(texts.where("held"), model).collect()
    drop(texts)
    y = np.array([r.y for r in measured])
    if len(set(y.tolist())) < 2:
        return model
    x = np.array([(r.beyond, r.summed) for r in measured])
    sizes = {r.y: r.n for r in labels.where(F.col(quoted(label_col)).isin(0, 1)).groupBy(F.col(quoted(label_col)).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    weight = np.where(y == 1, sizes.get(1, 1) / max(1, (y == 1).sum()), sizes.get(0, 1) / max(1, (y == 0).sum()))
    model.weights = tuple(logistic(x, y.astype(float), weight * len(y) / weight.sum()).tolist())
    return model


def _measure(texts: DataFrame, model: Model) -> DataFrame:
    """``y``, ``n`` (words), ``best`` (score of the best segment) and the model's two ``features``, from all segments of each text."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in each(b.column(2)):
                words = tokens(t)
                found = shared.value.passages(words)
                rows.append((len(words), max((s for _, _, s, _ in found), default=0.0), *Model.features(found)))
            numbers = np.array(rows, float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers[:, 0].astype(np.int64)), *(pa.array(numbers[:, k]) for k in (1, 2, 3))], ["y", "n", "best", "beyond", "summed"])

    return texts.mapInArrow(frugal(run), "y int, n long, best double, beyond double, summed double")


def score_toxicity(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``row`` (all columns but the text), ``score`` and ``passages`` of every row.

    ``passages`` are the significant segments as (first word, end word, score, E-value), best first; words are runs of
    letters. ``score`` is the chance of label 1. Null and empty texts have no passage and the score that none
    gives; without a model every score is 0. Only the text is used, all of it however long (memory follows the longest text),
    so repeated rows and texts that tie get equal scores; an empty table gives an empty result.
    """
    given = apart(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e", pa.float64())]))
    schema = beside(given, "score double, passages array<struct<first:bigint,end:bigint,score:double,e:double>>", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            score, passages = [], []
            for t in each(b.column(1)):
                found = m.passages(tokens(t)) if m else []
                score.append(m.score(found) if m else 0.0)
                keep = sorted((p for p in found if p[3] <= SIGNIFICANT), key=lambda p: p[3])
                passages.append([dict(zip(("first", "end", "score", "e"), p)) for p in keep])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(passages, kind)], ["row", "score", "passages"])

    return given.mapInArrow(frugal(run), schema)
