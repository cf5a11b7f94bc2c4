"""Language identification by averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.arrow_text import apart, beside, frugal, quoted, runs, utf8
from threadloom.plans.scratch import cut

#: Buckets of hashed subwords, numbers in an embedding, bytes in a subword.
BUCKET_BITS, WIDTH, ORDERS = 13, 16, (2, 3, 4)
#: Bounds of the labelled sample that the classifier is fitted on: rows and bytes of text in all, dealt evenly to the languages;
#: rows and bytes that every language gets however many there are; bytes of one text.
SAMPLE_ROWS, SAMPLE_BYTES, LANG_ROWS, LANG_BYTES, SAMPLE_TEXT = 1600, 8 << 20, 40, 64 << 10, 1 << 17
#: Part of the calibration rows named rightly that the rejection may cost, and part of the rows of languages that were not
#: learned that it should reach.
LOST, STRANGE = 0.001, 0.99
#: Weight of a row of a language that was not learned when the temperature is set.
DOUBT = 0.1
#: Parts into which languages are dealt so that each part is left out of a model once; passes over the rows of such a model.
FOLDS, FOLD_EPOCHS = 4, 4

_SPACE = 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = _SPACE
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_MULTIPLY = np.uint32(0x9E3779B1)


def subwords(data: np.ndarray, at: np.ndarray, bits: int = BUCKET_BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the subword that begins at each byte, for each order, and where each text's bytes begin.

    Letters count in lower case (A-Z), other ASCII is white space, and a word carries one white space on either
    side. Bucket 0 stands for no subword: those never span two words.
    """
    n = len(at) - 1
    x = np.full(len(data) + n + 1 + max(ORDERS), _SPACE, np.uint8)
    first = at[:-1] + np.arange(n)
    for i in range(n):
        x[first[i] + 1 : first[i] + 1 + at[i + 1] - at[i]] = data[at[i] : at[i + 1]]
    x = _FOLD[x]
    size = len(data) + n
    gap = x == _SPACE
    gram = x[:size].astype(np.uint32)
    inside = np.zeros(size, bool)
    out = []
    for k in range(1, max(ORDERS)):
        gram = gram | (x[k : k + size].astype(np.uint32) << np.uint32(8 * k))
        if k > 1:
            inside = inside | gap[k - 1 : k - 1 + size]
        if k + 1 in ORDERS:
            bucket = (((gram ^ np.uint32(k)) * _MULTIPLY) >> np.uint32(32 - bits)).astype(np.int64)
            bucket |= bucket == 0
            none = inside if k > 1 else gap[:size] & gap[1 : 1 + size]
            bucket[none] = 0
            out.append(bucket)
    return out, first


#: Bytes of white space, at which a long text is cut.
WHITE = np.frombuffer(b" \t\n\r", np.uint8)


@dataclass
class Model:
    """Per bucket and language the product of embedding and output weights; with temperature and rejection."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros((len(at) - 1, len(self.langs) + 1))
        most = max(1 << 14, (1 << 21) // max(1, len(self.langs)))
        for i, j in runs(at, most):
            lo, end = int(at[i]), int(at[j])
            while lo < end:  # a longer text comes alone and in parts, which end with a word
                hi = min(end, lo + most)
                if hi < end:
                    white = np.flatnonzero(np.isin(data[lo + 1 : hi], WHITE))
                    hi = lo + 1 + int(white[-1]) if len(white) else hi
                buckets, first = subwords(data[lo:hi], at[i : j + 1] - at[i] if j > i + 1 else np.array([0, hi - lo]))
                for b in buckets:
                    total[i:j, :-1] += np.add.reduceat(self.weights[b], first, axis=0, dtype=np.float64)
                    total[i:j, -1] += np.add.reduceat(b > 0, first, dtype=np.int64)
                lo = hi
        return total[:, :-1] / np.maximum(total[:, -1:], 1) + self.bias

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(data, at) / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _rows(texts: list[bytes], bits: int, rng: np.random.Generator) -> tuple[Counts, np.ndarray]:
    """Mean subword counts of each text and of two short pieces of it, and whose text each row is."""
    parts, owner = [], []
    for k, t in enumerate(texts):
        words = t.split()
        parts.append(t)
        for _ in range(2 if len(words) > 12 else 0):
            n = int(rng.integers(3, 60))
            i = int(rng.integers(0, max(1, len(words) - n)))
            parts.append(b" ".join(words[i : i + n]))
        owner += [k] * (len(parts) - len(owner))
    found = []
    for t in parts:
        buckets, _ = subwords(np.frombuffer(t, np.uint8), np.array([0, len(t)]), bits)
        at, n = np.unique(np.concatenate(buckets), return_counts=True)
        at, n = at[at > 0], n[at > 0]
        found.append((at, (n / max(1, n.sum())).astype(np.float32)))
    return Counts(found, 1 << bits), np.array(owner)


@dataclass
class Counts:
    """Rows of mean subword counts, kept sparse; ``dense`` gives a few of them."""

    rows: list[tuple[np.ndarray, np.ndarray]]
    width: int

    def dense(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), self.width), np.float32)
        for row, k in zip(out, which.tolist()):
            at, n = self.rows[k]
            row[at] = n
        return out

    def logits(self, which: np.ndarray, model: Model) -> np.ndarray:
        parts = [self.dense(which[i : i + 256]) @ model.weights for i in range(0, len(which), 256)]
        return np.concatenate(parts) + model.bias if parts else np.zeros((0, len(model.langs)))


def train(texts: list[bytes], langs: list[str], bits: int = BUCKET_BITS, epochs: int = 12, seed: int = 7) -> Model | None:
    """Fits embeddings and output weights by stochastic gradient descent on four fifths of the texts; the rest set
    the temperature and the rejection threshold, together with models that each lack a part of the languages."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    x, owner = _rows(texts, bits, rng)
    y = np.array([names.index(v) for v in langs])[owner]
    held = (np.arange(len(texts)) % 5 == 4)[owner]
    fit, kept = np.flatnonzero(~held), np.flatnonzero(held)
    model = descend(x, y, fit, names, epochs, rng)
    strange = []
    part = np.arange(len(names)) % FOLDS
    for fold in range(FOLDS if len(names) > 2 else 0):
        left = np.flatnonzero(part != fold)
        out = kept[part[y[kept]] == fold]
        if len(out) and len(left) > 1:
            place = np.full(len(names), -1)
            place[left] = np.arange(len(left))
            without = descend(x, place[y], fit[part[y[fit]] != fold], [names[k] for k in left], FOLD_EPOCHS, rng)
            strange.append(x.logits(out, without))
    calibrate(model, x.logits(kept, model), y[kept], strange)
    return model


def descend(x: Counts, y: np.ndarray, rows: np.ndarray, names: list[str], epochs: int, rng: np.random.Generator) -> Model:
    emb = rng.normal(0, 1 / WIDTH, (x.width, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    order, size = rows.copy(), 32
    step_at, steps = 0, max(1, epochs * -(-len(order) // size))
    for _ in range(epochs):
        rng.shuffle(order)
        for i in range(0, len(order), size):
            some = order[i : i + size]
            rate = 1 - step_at / steps
            step_at += 1
            counts = x.dense(some)
            mean = counts @ emb
            err = softmax(mean @ out + bias)
            err[np.arange(len(some)), y[some]] -= 1
            err /= len(some)
            slope = counts.T @ (err @ out.T)
            out -= 20 * rate * (mean.T @ err)
            bias -= 0.05 * rate * err.sum(0)
            emb -= 60 * rate * slope
    model = Model(names, (emb @ out).astype(np.float32), bias.astype(np.float64))
    # Subwords that no row had say nothing, rather than what their first values happen to say.
    seen = np.zeros(x.width, bool)
    for k in rows.tolist():
        seen[x.rows[k][0]] = True
    model.weights[~seen] = 0
    return model


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, strange: list[np.ndarray]) -> None:
    """Sets temperature and rejection threshold from the logits ``z`` of held-back rows and from those of ``strange`` ones, whose
    language the model that gave them was not taught.

    The temperature is that of the least log loss, where a strange row counts ``DOUBT`` of a row of which every
    language is equally likely: a model that separates its own languages with ease is not sure of others for that. The
    threshold is what all but ``LOST`` of the rows named rightly reach, short pieces among them, but no more than it takes to
    reject ``STRANGE`` of the strange rows, and never more than an even chance: a language that is likelier than all others
    together is not rejected.
    """
    if not len(y):
        return
    at = np.arange(len(y))

    def loss(t: float) -> float:
        own = -np.log(softmax(z / t)[at, y] + 1e-12).sum()
        return own + DOUBT * sum(-np.log(softmax(o / t) + 1e-12).mean(1).sum() for o in strange)

    model.temperature = float(min(np.geomspace(0.02, 20, 60), key=loss))
    p = softmax(z / model.temperature)
    right = p.max(1)[p.argmax(1) == y]
    if len(right):
        top = np.concatenate([softmax(o / model.temperature).max(1) for o in strange]) if strange else np.ones(1)
        model.reject_below = float(min(0.5, np.quantile(right, LOST), np.quantile(top, STRANGE)))


def labelled_sample(docs: DataFrame, text_col: str, lang_col: str, by: F.Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """About ``rows`` rows and ``size`` bytes, dealt evenly to all languages but at least ``LANG_ROWS`` and ``LANG_BYTES`` to each,
    picked by the hash ``by``."""
    known = docs.where(F.col(quoted(lang_col)).isNotNull() & F.col(quoted(text_col)).isNotNull()).select(
        F.col(quoted(lang_col)).alias("lang"), F.col(quoted(text_col)).cast("string").alias("text"), F.pmod(by, F.lit(1 << 30)).alias("h")
    )
    known = known.where(F.octet_length("text").between(1, SAMPLE_TEXT))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    sizes = cut(sizes, "languages")
    langs = max(1, sizes.count())
    share = F.least(F.lit(1.0), max(rows / langs, LANG_ROWS) / F.col("n"), max(size / langs, LANG_BYTES) / F.col("b"))
    most = sizes.select("lang", (share * (1 << 30)).cast("long").alias("most"))
    return known.join(most, "lang").where("h < most").select("lang", "text")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", by: F.Column | None = None) -> Model | None:
    """A model from a bounded sample of the labelled rows of ``docs``; none without labelled text.

    Every language with labelled text is learned. The bound of the sample is ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` bytes, or
    ``LANG_ROWS`` and ``LANG_BYTES`` for each language where that is more (in expectation, as the pick is by hash).
    """
    by = F.xxhash64(quoted(text_col)) if by is None else by
    rows = sorted((r.text.encode(), r.lang) for r in labelled_sample(docs, text_col, lang_col, by).collect())
    order = np.random.default_rng(3).permutation(len(rows))
    return train([rows[i][0] for i in order], [rows[i][1] for i in order])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``row`` (all other columns), ``text``, ``lang_pred``, ``score`` and ``rejected`` of every row.

    A text that is null or has no letter is ``und`` with score 0 and rejected, and so is every text without a model.
    Others get a learned language, the calibrated probability of it, and ``rejected`` where that is below the
    calibrated threshold; of languages that tie the first by name is given. Only the text is used, all of it: a very long
    one is done in parts. Repeated rows are told alike; an empty table gives an empty result.
    """
    given = apart(docs, text_col).select("row", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = beside(given, "text string, lang_pred string, score double, rejected boolean", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            letters = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            if m is None:
                letters[:] = False
                best, score = np.zeros(b.num_rows, int), np.zeros(b.num_rows)
            else:
                best, score = m.predict(*utf8(b.column(2)))
            names = [m.langs[k] if yes else "und" for k, yes in zip(best.tolist(), letters.tolist())]
            score = np.where(letters, np.clip(score, 0, 1), 0.0)
            rejected = ~letters | (score < (m.reject_below if m else 0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["row", "text", "lang_pred", "score", "rejected"]
            )

    return given.mapInArrow(frugal(run), schema)
