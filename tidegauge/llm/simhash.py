"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Texts become 64-bit fingerprints; equal fingerprints are one class (map-side combined, so that a hot one is one row).
A vantage-point tree, fitted on a bounded sample, deals ALL classes into shards: a class lives in one shard and also
visits each shard that the triangle bound does not rule out. As one of the two ends of a link is enough, only classes
just outside a ball visit its inside, and visitors branch on by both bounds. In a shard the residents form a tree of their own
and residents and visitors search it, in blocks, with pruning by the same bounds. All links are found exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import materialise, parts, tidy, utf8
from tidegauge.llm.components import connected_components

#: Fingerprints that the shard tree is fitted on: LEAST, or PER_SHARD for each shard, MOST (8 MB) at most; all are dealt by it.
LEAST, PER_SHARD, MOST = 16_384, 16, 1 << 20
#: Classes meant for a shard, and for a leaf of a shard's own tree.
SHARD, LEAF = 8_192, 384


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of lower-cased word shingles, as an unsigned integer; 0 without words."""
    w = text.lower().split()  # bytes: A-Z only, and exactly \x20 and \x09-\x0D part words
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    grams = [h(b" ".join(g), 42) for g in zip(*(w[i:] for i in range(words)), strict=False)] if len(w) >= words else [h(b" ".join(w), 42)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(grams), 65_536):
        part = np.array(grams[i : i + 65_536], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("text")).mapInArrow(tidy(run), "id long, fp long")


class VPTree:
    """Binary tree of balls. Inner node: (vantage, radius, inside, outside); leaf: positions of its points."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int = 7):
        self.points, self.leaves = points, []
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)), leaf)

    def _build(self, at: np.ndarray, leaf: int):
        if len(at) > leaf:
            pts, best = self.points[at], None
            for v in pts[self.rng.integers(0, len(at), 6)]:
                d = np.bitwise_count(pts ^ v)
                r = int(np.sort(d)[len(d) // 2])
                for r in (r - 1, r):  # the median's two sides; few points at the border is better
                    share, edge = np.mean(d <= r), np.mean((d >= r - 1) & (d <= r + 2))
                    if 0.15 < share < 0.85 and (best is None or edge + abs(share - 0.5) < best[0]):
                        best = (edge + abs(share - 0.5), v, r, d <= r)
            if best:
                return (best[1], best[2], self._build(at[best[3]], leaf), self._build(at[~best[3]], leaf))
        self.leaves.append(at)
        return len(self.leaves) - 1

    def deal(self, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(leaf, positions in fps, they live there) for homes and visitors; every pair within the radius meets in the home leaf of one of the two."""

        def down(node, home: np.ndarray, guest: np.ndarray):
            if not len(home) + len(guest):
                return
            if isinstance(node, int):
                if len(home):
                    yield node, home, True
                if len(guest):
                    yield node, guest, False
                return
            v, r, inside, outside = node
            dh, dg = np.bitwise_count(fps[home] ^ v).astype(np.int16), np.bitwise_count(fps[guest] ^ v).astype(np.int16)
            over = home[(dh > r) & (dh <= r + radius)]
            yield from down(inside, home[dh <= r], np.concatenate([guest[dg <= r + radius], over]))
            yield from down(outside, home[dh > r], guest[dg > r - radius])

        every, none = np.arange(len(fps)), np.array([], np.int64)
        yield from down(self.root, every, none)

    def near(self, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (positions in fps, positions in points) within the radius."""

        def down(node, q: np.ndarray):
            if not len(q):
                return
            if isinstance(node, int):
                at = self.leaves[node]
                step = max(1, 4_000_000 // max(1, len(at)))
                for i in range(0, len(q), step):
                    x, y = np.nonzero(np.bitwise_count(fps[q[i : i + step], None] ^ self.points[at][None, :]) <= radius)
                    yield q[i : i + step][x], at[y]
                return
            v, r, inside, outside = node
            d = np.bitwise_count(fps[q] ^ v).astype(np.int16)
            yield from down(inside, q[d <= r + radius])
            yield from down(outside, q[d > r - radius])

        yield from down(self.root, np.arange(len(fps)))


def hamming_links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b), a < b, between the classes (fp, rep) whose fingerprints differ in `radius` bits at most; fp is unique."""
    n = classes.count()
    shards = min(MOST // PER_SHARD, -(-n // SHARD))
    size = max(LEAST, PER_SHARD * shards)
    sample = classes.where(F.pmod(F.xxhash64("fp"), F.lit(max(n, 1))) < size).select("fp").toPandas()["fp"].to_numpy(np.int64)
    tree = VPTree(np.sort(sample).view(np.uint64), max(8, len(sample) // max(1, shards)))
    tree.points, shards, tree.leaves = None, len(tree.leaves), []
    tree.rng = None
    shared = classes.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            for shard, at, home in shared.value.deal(fp.view(np.uint64), radius):
                cols = [np.full(len(at), shard, np.int32), np.full(len(at), 0 if home else 1, np.int32), fp[at], rep[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shard", "guest", "fp", "rep"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, homes, tree = None, [], None
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(4)]
            cuts = np.flatnonzero(np.diff(cols[0]) | np.diff(cols[1])) + 1
            for s, guest, fp, rep in zip(*(np.split(c, cuts) for c in cols), strict=True):
                if not len(s):
                    continue
                if s[0] != shard or (guest[0] and homes):  # all residents of a shard have come: they sort before its guests
                    if homes:
                        tree = Shard(homes)
                        yield from tree.own(radius)
                    homes = []
                    if s[0] != shard:
                        shard, tree = s[0], None
                if not guest[0]:
                    homes.append((fp, rep))
                elif tree is not None:
                    yield from tree.visit(fp, rep, radius)
        if homes:
            yield from Shard(homes).own(radius)

    dealt = classes.select("fp", "rep").mapInArrow(tidy(deal), "shard int, guest int, fp long, rep long")
    return dealt.repartition("shard").sortWithinPartitions("shard", "guest").mapInArrow(tidy(search), "a long, b long").distinct()


class Shard:
    """The residents of a shard, in a tree of their own."""

    def __init__(self, homes: list[tuple[np.ndarray, np.ndarray]]):
        fp, self.rep = (np.concatenate([h[i] for h in homes]) for i in (0, 1))
        self.tree = VPTree(fp.view(np.uint64), LEAF)

    def own(self, radius: int) -> Iterator[pa.RecordBatch]:
        for x, y in self.tree.near(self.tree.points, radius):
            yield _links(self.rep[x[x < y]], self.rep[y[x < y]])

    def visit(self, fp: np.ndarray, rep: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
        for x, y in self.tree.near(fp.view(np.uint64), radius):
            yield _links(rep[x], self.rep[y])


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def simhash_components(df: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable through links).

    Null text counts as empty, and texts without words share fingerprint zero. A text of any length is fingerprinted whole. Rows that share an id are one document, so their texts'
    classes are in one component. A null id is linked by its text too; a fingerprint that only null ids have stays
    apart, with component_id null. Other columns of any name are ignored; an empty table gives an empty result.
    """
    fps = materialise(fingerprints(df, words, id_col, text_col), "fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    comp = connected_components(hamming_links(classes.where("rep is not null"), radius))
    named = classes.join(comp, classes["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
