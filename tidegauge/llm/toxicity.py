"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all training rows, whatever their label, is the unlabelled text, so that the class
prior holds for it. Counts of words' character n-grams, screened
by how much more often positives have them, feed linear classifiers trained in numpy on the class-prior-corrected risk
    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]),
where the max keeps the estimated risk of clean text from going below zero. The mean of several members is the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import bounded_sample, materialise, ranked, tidy
from tidegauge.llm.lang_id import words_of

#: Rows that the model is fitted on at most: positives and unlabelled; bytes of text of each.
FIT_POSITIVE, FIT_UNLABELLED, FIT_BYTES = 3000, 9000, 128 << 20
#: n-grams kept after screening, their lengths, members, steps, and words that a worker remembers.
GRAMS, LENGTHS, MEMBERS, STEPS, REMEMBERED = 1500, (4, 5, 6, 7, 8), 3, 250, 300_000
#: Words to which a longer text's counts are scaled down.
FULL = 300
_PENALTY = 3e-4


def grams(word: str) -> set[str]:
    """The word's n-grams and the word itself, marked."""
    w = f"^{word}"
    return {w[i : i + n] for n in LENGTHS for i in range(len(w) - n + 1)} | {f"{w}$"}


class Model:
    """Weights of n-grams for each member; a text's logit is additive over its words, so each distinct word is summed once."""

    def __init__(self, ids: dict[str, int], weights: np.ndarray, per_word: np.ndarray, bias: np.ndarray):
        self.ids, self.weights, self.per_word, self.bias = ids, weights, per_word, bias

    def word(self, w: str) -> np.ndarray:
        known = [self.ids[g] for g in grams(w) if g in self.ids]
        return self.weights[known].sum(0)


def _scale(n: int) -> float:
    return min(1.0, FULL / n) if n else 1.0


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.sums = np.zeros((REMEMBERED, len(self.model.bias)), np.float32)

    def __call__(self, text: str) -> float:
        words, total = words_of(text), np.zeros(len(self.model.bias))
        for i in range(0, len(words), 100_000):
            part = words[i : i + 100_000]
            new = set(part).difference(self.ids)
            if len(self.ids) + len(new) > REMEMBERED:
                self._reset()
                new = set(part)
            for w in new:
                self.sums[len(self.ids)] = self.model.word(w)
                self.ids[w] = len(self.ids)
            total += self.sums[list(map(self.ids.__getitem__, part))].sum(0, dtype=np.float64)
        logit = (total + self.model.per_word * len(words)) * _scale(len(words)) + self.model.bias
        return float(np.mean(1 / (1 + np.exp(-np.clip(logit, -30, 30)))))


def nnpu_fit(x: tuple[np.ndarray, np.ndarray, np.ndarray], features: int, positive: np.ndarray, prior: float, seed: int) -> np.ndarray:
    """Weights (the last is the bias) by Adam on the non-negative risk with logistic loss; x is (row, feature, value)."""
    row, col, val = x
    n = len(positive)
    rng = np.random.default_rng(seed)
    # a member sees each row with a Poisson weight, as in a bootstrap
    share = rng.poisson(1.0, n).astype(np.float64) if seed else np.ones(n)
    at_p, at_u = share * positive, share * ~positive
    if not at_p.sum() or not at_u.sum():
        share = np.ones(n)
        at_p, at_u = share * positive, share * ~positive
    at_p, at_u = at_p / max(at_p.sum(), 1), at_u / max(at_u.sum(), 1)
    w = np.zeros(features + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, val * w[col], n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_minus = np.logaddexp(0, z)
        clean = at_u @ loss_minus - prior * (at_p @ loss_minus)
        if clean >= 0:
            g = -prior * at_p * (1 - p) + at_u * p - prior * at_p * p
        else:  # step back from a negative risk of clean text
            g = prior * at_p * p - at_u * p
        full = np.concatenate([np.bincount(col, val * g[row], features), [g.sum()]]) + _PENALTY * w * (np.arange(features + 1) < features)
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def fit(df: DataFrame, id_col: str = "id", text_col: str = "text", positive_col: str = "positive", known_col: str = "known") -> Model:
    """A model of rows with text: positive_col marks the confirmed toxic, known_col those with any label, whose toxic share is the prior.

    Without a positive every score is the prior's floor, near 0. Of more than FIT_POSITIVE and FIT_UNLABELLED rows (or FIT_BYTES) a sample
    of that size is taken by a hash of id and text.
    """
    df = df if "sample_rank" in df.columns else ranked(df, id_col, text_col)
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(positive_col).alias("positive"), F.col(known_col).alias("known"), "sample_rank", "sample_bytes")
    known, toxic = rows.agg(F.count_if("known"), F.count_if("positive")).first()
    prior = min(max(toxic / max(known, 1), 0.005), 0.5)
    unlabelled = bounded_sample(rows, FIT_UNLABELLED, FIT_BYTES).withColumn("positive", F.lit(False))  # the prior is that of all rows, so positives are among them
    sample = bounded_sample(rows.where("positive"), FIT_POSITIVE, FIT_BYTES).unionByName(unlabelled)
    sample = materialise(sample.select("text", "positive"), "sample")
    top = _screen(sample)
    ids = {g: i for i, g in enumerate(top)}
    row, col, val, positive, n = _features(sample, ids)
    scaled = np.array([_scale(int(k)) for k in n])
    size = len(ids) + 1  # the last feature is the number of words, in tens
    x = (np.concatenate([row, np.arange(len(n))]), np.concatenate([col, np.full(len(n), len(ids))]), np.concatenate([val, n / 10.0]))
    x = (x[0], x[1], x[2] * scaled[x[0]])
    if not positive.any() or positive.all():
        return Model({}, np.zeros((0, 1), np.float32), np.zeros(1), np.array([math.log(prior / (1 - prior))]))
    w = np.stack([nnpu_fit(x, size, positive, prior, seed) for seed in range(MEMBERS)], axis=1)
    return Model(ids, w[: len(ids)].astype(np.float32), w[len(ids)] / 10.0, w[-1])


def _screen(sample: DataFrame) -> list[str]:
    """The n-grams whose rate among positives stands out most, in standard errors."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (Counter(), Counter())
            for t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words_of(t)
                cut = Counter(ws)
                for w, k in cut.items():
                    found[p][w] += k * _scale(len(ws))
            keys = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([float(found[1][k]) for k in keys]), pa.array([float(found[0][k]) for k in keys])], ["word", "p", "u"])

    def chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, u = Counter(), Counter()
            for w, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for g in grams(w):
                    p[g] += x
                    u[g] += y
            keys = list(p)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([float(p[k]) for k in keys]), pa.array([float(u[k]) for k in keys])], ["gram", "p", "u"])

    sums = (F.sum("p").alias("p"), F.sum("u").alias("u"))
    by_word = materialise(sample.mapInArrow(tidy(words), "word string, p double, u double").groupBy("word").agg(*sums), "words")
    all_p, all_u = by_word.agg(F.sum("p"), F.sum("u")).first()
    if not all_p or not all_u:
        return []
    # words that no positive has can add to a gram's u only; all words count
    by_gram = by_word.mapInArrow(tidy(chars), "gram string, p double, u double").groupBy("gram").agg(*sums).where("p >= 4")
    expected = F.col("u") * (all_p / all_u) + 1
    z = (F.col("p") - expected) / F.sqrt(expected)
    top = by_gram.withColumn("z", F.round(z, 6)).where("z > 2").orderBy(F.desc("z"), "gram").limit(GRAMS)
    return [r.gram for r in top.select("gram").collect()]


def _features(sample: DataFrame, ids: dict[str, int]) -> tuple[np.ndarray, ...]:
    """(row, feature, count), positive and number of words of each sampled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in batches:
            out = ([], [], [], [])
            for t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, found = words_of(t), Counter()
                for w, k in Counter(words).items():
                    if w not in known:
                        if len(known) > REMEMBERED:
                            known.clear()
                        known[w] = [ids[g] for g in grams(w) if g in ids]
                    for f in known[w]:
                        found[f] += k
                for c, x in zip(out, (p, len(words), list(found), list(found.values())), strict=True):
                    c.append(x)
            kinds = (pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["positive", "n", "f", "k"])

    got = sample.mapInArrow(tidy(run), "positive boolean, n long, f array<int>, k array<int>").toArrow().combine_chunks()
    sizes = np.array([len(x) for x in got.column("f").to_pylist()], np.int64)
    flat = [(np.concatenate([np.asarray(c.flatten()) for c in got.column(x).chunks]) if len(got) else np.zeros(0, np.int32)) for x in ("f", "k")]
    return np.repeat(np.arange(len(sizes)), sizes), flat[0], flat[1].astype(np.float64), np.array(got.column("positive").to_pylist(), bool), np.array(got.column("n").to_pylist(), np.float64)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1).

    Null text counts as empty, and texts without a word score by the bias alone. Equal texts score the same, so repeated rows and ties come out
    equal. A text of any length is scored whole, 100,000 words at a time. Null and repeated ids are carried along; other columns of any name are
    ignored. An empty table gives an empty result; without a positive to learn from every score is the prior.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer(t or "") for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(tidy(run), "doc_id long, score double")
