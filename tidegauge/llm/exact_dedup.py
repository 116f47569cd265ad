"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries of `k` counters are made per partition and summed; only digests whose summed count reaches n/(k+1) are
candidates, so there are at most k+1 of them, and every digest of more than 2n/(k+1) rows is among them. Their exact
groups (the verified winners) are broadcast and settle their rows where they lie, without a shuffle. All other
digests are shuffled as usual; none of them can hold more than 2n/(k+1) rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import materialise, materialise_at, parts, scoped, scratch_path, tidy, utf8, without

#: Counters of a Misra-Gries summary; k+1 digests at most are broadcast (under 200 KB).
COUNTERS = 1024


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        sums = [hashlib.sha256(t.lower()).digest() for t in b.column(2).to_pylist()]  # bytes.lower() changes A-Z only
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.binary())], ["id", "raw", "digest"])


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, raw, digest): a hash of the text as it is, and the SHA-256 of each whole text, A-Z lower-cased; null text counts as empty."""
    text = utf8(F.col(text_col))
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("raw"), text.alias("text")).mapInArrow(tidy(_digest), "id long, raw long, digest binary")


class MisraGries:
    """Mergeable summary: each count is too low by rows/(k+1) at most, and a digest that is absent counts as 0."""

    def __init__(self, k: int):
        self.k, self.counts = k, Counter()

    def add(self, keys: list) -> None:
        self.counts.update(keys)
        if len(self.counts) > self.k:
            cut = sorted(self.counts.values(), reverse=True)[self.k]
            self.counts = Counter({x: c - cut for x, c in self.counts.items() if c > cut})


def heavy_candidates(df: DataFrame, key: str, rows: int, k: int = COUNTERS) -> DataFrame:
    """At most k+1 values of the binary column `key`, among them each that holds more than 2*rows/(k+1) of the rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mg = MisraGries(k)
        for b in batches:
            mg.add(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(mg.counts), pa.binary()), pa.array(list(mg.counts.values()), pa.int64())], [key, "n"])

    parts = df.select(key).mapInArrow(tidy(summarise), f"{key} binary, n long")
    return parts.groupBy(key).agg(F.sum("n").alias("n")).where((F.col("n") > 1) & (F.col("n") * (k + 1) >= rows)).select(key)


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """(id, raw, digest, keep_id, group_size) of each row."""
    dig = materialise(digests(df, id_col, text_col), "digests")
    group = (F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    heavy = dig.join(F.broadcast(heavy_candidates(dig, "digest", dig.count(), k)), "digest").groupBy("digest").agg(*group)
    heavy = materialise(heavy, "heavy")
    mapped = dig.join(F.broadcast(heavy), "digest")
    per_text = Window.partitionBy("digest")
    rest = dig.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    rest = rest.withColumns({"keep_id": F.max("id").over(per_text), "group_size": F.count(F.lit(1)).over(per_text)})
    return mapped.select(rest.columns).unionByName(rest)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts (A-Z lower-cased; null counts as empty) the largest id stays. Rows that share an id and a text are one
    document: they stay or go together, each counts in group_size. A null id loses to any other; a group of null ids
    alone keeps all its rows (keep_id null). A text of any length is hashed whole. Other columns of any name are ignored. An empty table gives an
    empty result.
    """
    return groups(df, id_col, text_col, k).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay by exact_dedup's rules, with their own columns, whatever their names.

    A row goes by its id and its text together, so of rows that share an id each is judged by its own text.
    """
    path = scratch_path(docs.sparkSession, "gone")
    with scoped(docs.sparkSession):
        losers = groups(docs, k=k).where(~F.col("id").eqNullSafe(F.col("keep_id")))
        gone = materialise_at(losers.select(F.col("id").alias("gone_id"), F.col("raw").alias("gone_raw")).distinct(), path)
    return without(docs, gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]), F.xxhash64(utf8(docs["text"])) == gone["gone_raw"])
