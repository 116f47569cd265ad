"""Language ID by word-first backoff.

A known word adds its log frequency in each language. An unseen word falls back to its character n-grams, the longest
first: the mean log frequency of its known n-grams of length 5, else of 4, and so on. The summed log frequencies, tempered
by the number of words, give a distribution over the languages; its largest value is the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import starmap

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import bounded_sample, materialise, ranked, tidy

#: Labelled rows that the model is fitted on at most, and their bytes; words and n-grams that it keeps (the broadcast model is under 30 MB).
FIT_ROWS, FIT_BYTES, WORDS, GRAMS = 20_000, 512 << 20, 60_000, 60_000
#: Longest n-gram, and unseen words that a worker remembers.
LONGEST, REMEMBERED = 5, 300_000
#: The quick pattern takes number signs (superscripts, fractions, Roman numerals) for letters; texts with such go by the exact one.
_QUICK, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
_SMOOTH = 0.5


def words_of(text: str) -> list[str]:
    """The runs of letters of the lower-cased text."""
    low = text.lower()
    found = _QUICK.findall(low)
    return found if all(map(str.isalpha, found)) else _LETTERS.findall(low)


def grams(word: str, n: int) -> list[str]:
    """The n-grams of the word between its marks; single characters come without the marks."""
    if n == 1:
        return list(word)
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """Word and n-gram tables: each entry's row in a matrix of log frequencies by language."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams_: dict[str, np.ndarray], word_totals: np.ndarray, gram_totals: np.ndarray):
        self.langs = langs
        self.words = self._logs(words, word_totals)
        self.grams = self._logs(grams_, gram_totals)
        self.floor = np.log(_SMOOTH / (word_totals + _SMOOTH * max(1, len(words))))

    @staticmethod
    def _logs(counts: dict[str, np.ndarray], totals: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
        table = np.array(list(counts.values()), np.float64).reshape(len(counts), len(totals))
        return {k: i for i, k in enumerate(counts)}, np.log((table + _SMOOTH) / (totals + _SMOOTH * max(1, len(counts)))).astype(np.float32)

    def backoff(self, word: str) -> np.ndarray:
        """Log frequencies of an unseen word; equal for all languages if no n-gram is known."""
        ids, logs = self.grams
        for n in range(LONGEST, 0, -1):
            if known := [ids[g] for g in grams(word, n) if g in ids]:
                return logs[known].mean(0)
        return np.full(len(self.langs), self.floor.mean(), np.float32)


class Scorer:
    """A worker's view of a model: unseen words are resolved once and remembered, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        ids, logs = self.model.words
        self.ids, self.used = dict(ids), len(ids)
        self.logs = np.zeros((len(ids) + REMEMBERED, len(self.model.langs)), np.float32)
        self.logs[: len(ids)] = logs

    def __call__(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return "und", 0.0
        total, n = np.zeros(len(self.model.langs)), len(words)
        for i in range(0, n, 100_000):
            part = words[i : i + 100_000]
            new = set(part).difference(self.ids)
            if self.used + len(new) > len(self.logs):
                self._reset()
                new = set(part).difference(self.ids)
            for w in new:
                self.logs[self.used] = self.model.backoff(w)
                self.ids[w] = self.used
                self.used += 1
            total += self.logs[list(map(self.ids.__getitem__, part))].sum(0, dtype=np.float64)
        p = np.exp((total - total.max()) / np.sqrt(n))
        best = int(np.argmax(p))  # the first of the sorted languages on ties
        return self.model.langs[best], float(p[best] / p.sum())


def _counted(df: DataFrame, count) -> DataFrame:
    """df's rows through count(list of rows) -> Counter of (gram, lang), summed per task and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter()
            count(found, *(c.to_pylist() for c in b.columns))
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(found.values(), pa.int64())], ["gram", "lang", "n"])

    return df.mapInArrow(tidy(run), "gram string, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def _words(found: Counter, texts: list, langs: list) -> None:
    for t, lang in zip(texts, langs, strict=True):
        found.update((w, lang) for w in words_of(t))


def _grams(found: Counter, words: list, langs: list, counts: list) -> None:
    for w, lang, n in zip(words, langs, counts, strict=True):
        for size in range(1, LONGEST + 1):
            for g in grams(w, size):
                found[g, lang] += n


def fit(df: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """A model of the rows for which `labelled` holds and the language and text aren't null; of more than FIT_ROWS a sample of that size, by a hash of id and text.

    Entries seen once are left out, and the WORDS and GRAMS commonest over all languages are kept, so rarer words go by their n-grams.
    """
    rows = df.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    words = materialise(_counted(bounded_sample(ranked(rows), fit_rows, FIT_BYTES).select("text", "lang"), _words), "words")
    chars = materialise(_counted(words.select("gram", "lang", "n"), _grams), "grams")
    totals = [{r.lang: r.n for r in t.groupBy("lang").agg(F.sum("n").alias("n")).collect()} for t in (words, chars)]
    langs = sorted(totals[0])

    def table(t: DataFrame, most: int) -> dict[str, np.ndarray]:
        top = t.groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).where(F.col("all") > 1)
        rows = top.orderBy(F.desc("all"), "gram").limit(most).select("gram", *(F.coalesce(F.element_at("by", lang), F.lit(0)).alias(f"l{i}") for i, lang in enumerate(langs))).toArrow()
        return dict(zip(rows.column(0).to_pylist(), np.stack([rows.column(i + 1).to_numpy() for i in range(len(langs))], axis=1), strict=True)) if langs else {}

    return Model(langs, table(words, WORDS), table(chars, GRAMS), *(np.array([t.get(lang, 0) for lang in langs], np.float64) for t in totals))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score.

    Null texts and those without a letter are `und` with score 0, as is everything if nothing was learned. On ties the first language by name is
    taken; equal texts score the same. A text of any length is scored whole, 100,000 words at a time. Null and repeated ids are carried along; other
    columns of any name are ignored. An empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            found = list(starmap(scorer, ((t or "",) for t in b.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
