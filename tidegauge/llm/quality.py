"""Quality classifier: random-indexing word vectors, pooled per text, and a two-layer network with calibrated probabilities.

Each token type has a sparse random index vector, made from its own hash. A token's vector is the sum of the index vectors around
its occurrences in the fitting rows. A text is the mean of its tokens' vectors with three shares of repetition. A network of one hidden
and one output layer is trained in numpy; its logits are divided by a temperature that is fitted on rows kept aside.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import bounded_sample, parts, ranked, tidy

#: Labelled rows that the model is fitted on at most, and their bytes; token types with a vector of their own; a vector's length and non-zeros.
FIT_ROWS, FIT_BYTES, TYPES, DIM, NONZERO = 6000, 48 << 20, 20_000, 64, 6
#: Hidden units, epochs, tokens on each side that count as around; types that a worker remembers.
HIDDEN, EPOCHS, AROUND, REMEMBERED = 24, 60, 2, 150_000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def shape(token: str) -> str:
    """What stands for a token without a vector of its own: its kind of case and length, or its kind of sign."""
    if token[0].isalpha():
        case = "A" if len(token) > 1 and token.isupper() else "a" if token.islower() else "Aa" if token[1:].islower() else "aA"
        return f"\x00{case}{min(len(token), 12) // 4}"
    return "\x000" if token[0].isdigit() else f"\x00{token[0]}{min(len(token), 3)}"


def index_vector(token: str) -> np.ndarray:
    """NONZERO entries of 1 or -1 at places that the token's hash gives."""
    v, h = np.zeros(DIM, np.float32), xxhash.xxh3_128_intdigest(token)
    for _ in range(NONZERO):
        v[h % DIM] += 1.0 if h >> 8 & 1 else -1.0
        h >>= 16
    return v


def repetition(same: tuple[int, int], n: int, distinct: int) -> tuple[float, float, float]:
    """Shares of tokens equal to the one before and the one before that, and of tokens that came before."""
    if n < 2:
        return 0.0, 0.0, 0.0
    return same[0] / (n - 1), same[1] / (n - 1), 1 - distinct / n


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Network:
    """tanh layer, then two logits; inputs are standardised, probabilities tempered."""

    def __init__(self, inputs: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 1 / np.sqrt(inputs), (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 2)), np.zeros(2)]
        self.mean, self.sd, self.temperature, self.rng = np.zeros(inputs), np.ones(inputs), 1.0, rng

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.sd @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-3
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(EPOCHS):
            order = self.rng.permutation(len(y))
            for i in range(0, len(y), 64):
                at = order[i : i + 64]
                s = (x[at] - self.mean) / self.sd
                h = np.tanh(s @ self.p[0] + self.p[1])
                d = _softmax(h @ self.p[2] + self.p[3])
                d[np.arange(len(at)), y[at]] -= 1
                d /= len(at)
                back = d @ self.p[2].T * (1 - h * h)
                t += 1
                for k, g in enumerate((s.T @ back + 1e-3 * self.p[0], back.sum(0), h.T @ d + 1e-3 * self.p[2], d.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the smallest log loss on these rows; ties go to the first."""
        z = self.logits(x)
        loss = [(-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean(), t) for t in np.geomspace(0.5, 8, 33)]
        self.temperature = float(min(loss)[1])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(x) / self.temperature)[:, 1]


class Model:
    def __init__(self, ids: dict[str, int], vectors: np.ndarray, network: Network | None, share: float):
        self.ids, self.vectors, self.network, self.share = ids, vectors, network, share


class Pooler:
    """Texts to rows of inputs; remembers which vector each token type has, up to a bound."""

    def __init__(self, ids: dict[str, int], vectors: np.ndarray):
        self.known, self.vectors = ids, vectors
        self.ids = dict(ids)

    def row(self, token: str) -> int:
        """The token's own vector, else its shape's, else the zero vector, which is the last."""
        return self.known.get(token, self.known.get(shape(token), len(self.vectors) - 1))

    def __call__(self, text: str) -> np.ndarray:
        tokens = TOKEN.findall(text)
        if not tokens:
            return np.zeros(DIM + 3)
        kinds = set(tokens)
        new = kinds.difference(self.ids)
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids = dict(self.known)
            new = kinds.difference(self.ids)
        self.ids.update((t, self.row(t)) for t in new)
        total = np.zeros(DIM)
        for i in range(0, len(tokens), 50_000):
            total += self.vectors[list(map(self.ids.__getitem__, tokens[i : i + 50_000]))].sum(0, dtype=np.float64)
        same = tuple(sum(map(operator.eq, tokens, tokens[k:])) for k in (1, 2))
        return np.concatenate([total / len(tokens), repetition(same, len(tokens), len(kinds))])


class Encoded:
    """Token types and each text's types in order, as numbers: texts are let go as they are encoded."""

    def __init__(self, texts: Iterator[list[str]]):
        number: dict[str, int] = {}
        self.texts = [np.fromiter((number.setdefault(t, len(number)) for t in ts), np.int32, len(ts)) for ts in texts]
        self.types = list(number)


def random_index(texts: Encoded) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Vectors of the TYPES commonest tokens and of all shapes, of length 1; the last row is zero. Also each type's row."""
    types = texts.types
    count = np.bincount(np.concatenate([*texts.texts, np.zeros(0, np.int32)]), minlength=len(types))
    often = np.flatnonzero(count > 2).tolist()
    common = [types[i] for i in sorted(often, key=lambda i: (-count[i], types[i]))[:TYPES]]
    shapes: dict[str, int] = {}
    kinds = np.fromiter((shapes.setdefault(shape(t), len(shapes)) for t in types), np.int32, len(types))
    ids = {t: i for i, t in enumerate([*common, *sorted(shapes)])}
    index = np.stack([*map(index_vector, ids), np.zeros(DIM, np.float32)])
    of_shape = np.array([ids[s] for s in shapes], np.int32)[kinds]
    own = np.fromiter((ids.get(t, -1) for t in types), np.int32, len(types))
    own = np.where(own < 0, of_shape, own)
    out = np.zeros(index.shape)
    for at in _chunks(texts.texts):
        row, also = (np.where(at < 0, len(ids), x[np.maximum(at, 0)]) for x in (own, of_shape))
        near = np.zeros((len(at), DIM), np.float32)
        both = index[row] + index[also]
        for k in range(1, AROUND + 1):
            near[k:] += both[:-k]
            near[:-k] += both[k:]
        for to in (row, also):  # a common token also counts for its shape
            order = np.argsort(to, kind="stable")
            start = np.flatnonzero(np.diff(to[order], prepend=-1))
            out[to[order][start]] += np.add.reduceat(near[order], start, axis=0)
    out[-1] = 0
    return ids, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32), own


def _chunks(texts: list[np.ndarray], most: int = 20_000) -> Iterator[np.ndarray]:
    """The texts' types with gaps (-1) between texts, in pieces of about `most`; a long text's pieces overlap by no token, so a few pairs at its cuts go uncounted."""
    held: list[np.ndarray] = []
    gap, n = np.full(AROUND, -1, np.int32), 0
    for t in texts:
        for i in range(0, len(t), most):
            held += [t[i : i + most], gap]
            n += len(held[-2])
            if n >= most:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def fit(df: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "label", fit_rows: int = FIT_ROWS) -> Model:
    """A model of rows with a label of 0 or 1; of more than `fit_rows` (or FIT_BYTES) a sample of that size, by a hash of id and text.

    Null text counts as empty; null and repeated ids are rows like others. Without both labels every score is the share of 1, or 0.5 without rows.
    """
    df = df if "sample_rank" in df.columns else ranked(df, id_col, text_col)
    rows = df.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"), "sample_rank", "sample_bytes")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["\n".join(TOKEN.findall(t)) for t in b.column(1).to_pylist()], pa.string()), b.column(2)], ["id", "tokens", "label"])

    got = bounded_sample(rows, fit_rows, FIT_BYTES).mapInArrow(tidy(tokens), "id long, tokens string, label int").toArrow()
    got = got.sort_by([("id", "ascending"), ("tokens", "ascending"), ("label", "ascending")])
    y = np.array(got.column("label").to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        return Model({}, np.zeros((1, DIM), np.float32), None, float(y.mean()) if len(y) else 0.5)
    texts = Encoded(v.as_py().split("\n") if len(v.as_py()) else [] for v in got.column("tokens"))
    del got
    ids, vectors, own = random_index(texts)
    x = np.zeros((len(y), DIM + 3))
    for i, t in enumerate(texts.texts):
        if len(t):
            mean = sum(vectors[own[t[k : k + 50_000]]].sum(0, dtype=np.float64) for k in range(0, len(t), 50_000)) / len(t)
            x[i] = np.concatenate([mean, repetition(tuple(int((t[k:] == t[:-k]).sum()) for k in (1, 2)), len(t), len(np.unique(t)))])
    aside = np.arange(len(y)) % 5 == 4
    network = Network(x.shape[1])
    network.train(x[~aside], y[~aside])
    if aside.any():
        network.calibrate(x[aside], y[aside])
    return Model(ids, vectors, network, float(y.mean()))


def predict(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """df with its own columns and the probability of label 1 as the last, `out`.

    Null text counts as empty. Equal texts score the same, so repeated rows and ties come out equal. A text of any length is scored whole, 50,000 tokens
    at a time. Columns are taken by place, so others may have any name; if one is named `out` (in any case) this raises ValueError, as none is
    replaced. An empty table gives an empty result.
    """
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the column {out} exists: name another")
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in df.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pool = Pooler(m.ids, m.vectors)
        for b in parts(batches):
            texts = b.column(at).to_pylist()
            if m.network and texts:
                score = m.network.probability(np.stack([pool(t or "") for t in texts]))
            else:
                score = np.full(len(texts), m.share)
            yield b.append_column(out, pa.array(score, pa.float64()))

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
