"""Suffix-array dedup: bytes covered by a string of L bytes that starts more than once anywhere, found by a column-wise collection BWT.

1. Segments. Every L-byte window is owned by its smallest rolling hash of a K-gram (leftmost on ties), so equal windows have
   equal owners wherever they stand. Consecutive windows of one owner are one segment of 100 windows or so, named by the
   owner's hash and the segment's own. Segments are counted map-side first: a hot passage or group of copies is one row with its
   count. Only owners that occur twice can hold a repeated window; the rest of the text is done.
2. Construction. The distinct segments of repeated owners are dealt by owner. A task takes them in bounded collections and
   cuts each into blocks of B bytes counted from its owner; the blocks' ranks are the symbols. From the right end on, one
   symbol per segment is inserted each round into the collection's Burrows-Wheeler transform: the place of each new suffix
   follows from its first symbol and its tail's place, its common prefix with its neighbours from a range minimum over the tails'.
   Columns of the transform live in external files that each round reads and writes in sequence.
3. Exact ends. Suffixes that share L/B-1 blocks form an interval; there the up to B bytes before and after decide each window.
   Counts are those of the occurrences, so copies of a segment repeat all its windows.
An owner with more than HOT distinct segments isn't constructed in one task: its windows are counted by their own 128-bit
hashes in a map-side combined aggregation, which is exact in the same way.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import discard, materialise_at, parts, scratch_path, tidy, utf8

#: Bytes of a block (a symbol), distinct segments of an owner for one task, of a collection, entries of a file read at once.
BLOCK, HOT, COLLECTION, READ = 16, 40_000, 12_000, 1 << 18
#: Bytes of a text that are hashed at once; longer texts go in steps that overlap.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Roller:
    """64-bit hashes of all K-grams of a byte array, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, gram: int, base: int = _BASE):
        self.gram, self.base, self.up = gram, base, np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > len(self.up):
            size = max(1 << 16, 1 << n.bit_length())
            self.up, self.down = _powers(self.base, size), _powers(pow(self.base, -1, 1 << 64), size)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        h = (total[self.gram :] - total[: n + 1 - self.gram]) * self.down[: n + 1 - self.gram]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    pad = np.full(-(-len(x) // w) * w, x.dtype.type(np.iinfo(x.dtype).max))
    pad[: len(x)] = x
    rows = pad.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def segments(text: bytes, window: int, roll: Roller) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (owner hash, start, windows, owner's offset in the segment), step by step; together they hold each window once."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(text) - window + 1), STEP):
        part = data[at : at + STEP + window - 1]
        h = roll(part)
        key = (h & np.uint64(_MASK << 24 & _MASK)) | np.arange(len(h), dtype=np.uint64)
        own = (_sliding_min(key, window - roll.gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(own)) + 1
        s = np.concatenate([[0], cut])
        m = np.diff(np.concatenate([s, [len(own)]]))
        yield h[own[s]].view(np.int64), s + at, m, own[s] - s


class RangeMin:
    """Minimum of x[s..e], both ends included, for arrays of s <= e."""

    W = 64

    def __init__(self, x: np.ndarray):
        rows = -(-len(x) // self.W)
        pad = np.full(rows * self.W, np.iinfo(x.dtype).max, x.dtype)
        pad[: len(x)] = x
        self.x = pad
        grid = pad.reshape(rows, self.W)
        self.left = np.minimum.accumulate(grid, axis=1).ravel()
        self.right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while (half := 1 << len(self.levels) - 1) * 2 <= rows:
            top = self.levels[-1]
            self.levels.append(np.minimum(top[:-half], top[half:]))

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        a, b = s // self.W, e // self.W
        out = np.minimum(self.right[s], self.left[e])
        if len(one := np.flatnonzero(a == b)):
            at = s[one, None] + np.arange(self.W)
            out[one] = np.where(at <= e[one, None], self.x[np.minimum(at, len(self.x) - 1)], np.iinfo(self.x.dtype).max).min(axis=1)
        if len(far := np.flatnonzero(b - a > 1)):
            level = np.frexp((b - a - 1)[far].astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = far[level == k]
                lo_k, hi_k = a[at] + 1, b[at] - (1 << int(k))
                out[at] = np.minimum(out[at], np.minimum(self.levels[k][lo_k], self.levels[k][hi_k]))
        return out


class Transform:
    """Burrows-Wheeler transform of a collection, grown by one symbol per string and round.

    Files hold a column each, one entry per suffix so far, in suffix order: the symbol before it (bwt), its first symbol, the place
    of its tail, its string and its length. Common prefixes with the suffix before and each string's newest place are in memory.
    """

    COLUMNS = ("bwt", "first", "tail", "sid", "length")

    def __init__(self, folder: str):
        self.folder, self.round = folder, 0

    def _file(self, name: str, k: int, mode: str):
        return open(f"{self.folder}/{name}.{k % 2}", mode)  # noqa: SIM115

    def build(self, symbols: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """symbols: all strings', one after another; ends: where each ends. Gives (string, length, common prefix) in suffix order."""
        n, m = len(sizes), np.int32
        start = {"bwt": symbols[ends - 1], "first": np.full(n, -1), "tail": np.arange(n), "sid": np.arange(n), "length": np.zeros(n)}
        for name in self.COLUMNS:
            with self._file(name, 0, "wb") as f:
                start[name].astype(m).tofile(f)
        self.lcp, self.place = np.zeros(n, np.int16), np.arange(n)
        for k in range(1, int(sizes.max()) + 1):
            live = np.flatnonzero(sizes >= k)
            before = np.where(sizes[live] > k, symbols[np.maximum(ends[live] - k - 1, 0)], -1)
            self._insert(k, live, symbols[ends[live] - k], before)
        out = []
        for name in ("sid", "length"):
            with self._file(name, int(sizes.max()), "rb") as f:
                out.append(np.fromfile(f, m))
        return out[0], out[1], self.lcp

    def _insert(self, k: int, live: np.ndarray, symbol: np.ndarray, before: np.ndarray) -> None:
        n, new = len(self.lcp), len(live)
        key = (symbol.astype(np.int64) << 32) | self.place[live]
        order = np.argsort(key)
        key, live, symbol, before = key[order], live[order], symbol[order], before[order]
        at = np.zeros(new, np.int64)  # places before insertion, from one pass over the columns that order the suffixes
        with self._file("first", k - 1, "rb") as f, self._file("tail", k - 1, "rb") as t:
            for lo in range(0, n, READ):
                old = (np.fromfile(f, np.int32, READ).astype(np.int64) << 32) | np.fromfile(t, np.int32, READ)
                some = slice(*np.searchsorted(key, (old[0], old[-1])))
                at[some] = lo + np.searchsorted(old, key[some])
                at[some.stop :] = lo + len(old)
        spot = at + np.arange(new)
        moved = np.arange(n) + np.cumsum(np.bincount(at, minlength=n + 1))[:n]
        fresh = {"bwt": before, "first": symbol, "tail": self.place[live], "sid": live, "length": np.full(new, k)}
        grown = {}
        for name in self.COLUMNS:
            with self._file(name, k - 1, "rb") as src, self._file(name, k, "wb") as to:
                kept = [] if name in ("first", "tail") else None
                for lo in range(0, n, READ):
                    old = np.fromfile(src, np.int32, READ)
                    some = slice(np.searchsorted(at, lo, "left"), np.searchsorted(at, lo + len(old), "right" if lo + len(old) == n else "left"))
                    old = np.insert(old, at[some] - lo, fresh[name][some].astype(np.int32))
                    if kept is not None:
                        kept.append(old)
                    (old if name != "tail" else self._shift(old, moved)).tofile(to)
            if kept is not None:
                grown[name] = np.concatenate(kept)
        lcp = np.insert(self.lcp, at, 0)
        touched = np.unique(np.concatenate([spot, spot + 1]))
        touched = touched[touched < n + new]
        same = grown["first"][touched] == grown["first"][touched - 1]
        lcp[touched[~same]] = 0
        both = touched[same]
        if len(both):
            lcp[both] = 1 + RangeMin(self.lcp)(grown["tail"][both - 1].astype(np.int64) + 1, grown["tail"][both].astype(np.int64))
        self.lcp = lcp
        self.place[live] = spot

    @staticmethod
    def _shift(tail: np.ndarray, moved: np.ndarray) -> np.ndarray:
        return moved[tail].astype(np.int32)


def repeated(strings: list[bytes], offsets: np.ndarray, windows: np.ndarray, counts: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string its window starts that occur twice in the collection, a string of count c standing for c of them."""
    flat = np.frombuffer(b"".join(strings), np.uint8)
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    base = np.cumsum(length) - length
    lead = offsets % BLOCK
    sizes = (length - lead) // BLOCK
    ends = np.cumsum(sizes)
    sid = np.repeat(np.arange(len(strings)), sizes)
    at = base[sid] + lead[sid] + (np.arange(ends[-1]) - (ends - sizes)[sid]) * BLOCK
    blocks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, BLOCK)[at])
    _, symbols = np.unique(blocks.view(f"V{BLOCK}").ravel(), return_inverse=True)
    with tempfile.TemporaryDirectory(prefix="bwt-") as folder:
        string, blocks_left, lcp = Transform(folder).build(symbols.astype(np.int64), ends, sizes)
    shared = window // BLOCK - 1
    interval = np.cumsum(lcp < shared)
    weight = np.bincount(interval, weights=counts[string] * (blocks_left >= shared))
    pick = np.flatnonzero((blocks_left >= shared) & (weight[interval] >= 2))
    string, interval = string[pick].astype(np.int64), interval[pick].astype(np.uint64)
    p = lead[string] + (sizes[string] - blocks_left[pick]) * BLOCK
    padded = np.concatenate([np.zeros(BLOCK, np.uint8), flat, np.zeros(2 * BLOCK + window, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, BLOCK)
    tail = window - BLOCK
    around = np.concatenate([view[base[string] + p], view[base[string] + p + BLOCK + tail]], axis=1)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for left in range(BLOCK):
        ok = np.flatnonzero((p - left >= 0) & (p - left < windows[string]))
        ends16 = np.ascontiguousarray(around[ok, BLOCK - left : 2 * BLOCK - left]).view(np.uint64)
        keys = (interval[ok], ends16[:, 0], ends16[:, 1])
        twice = _group_weights(keys, counts[string[ok]]) >= 2
        hits.append((string[ok][twice], (p - left)[ok][twice]))
    who, where = (np.concatenate([h[i] for h in hits]) for i in (0, 1))
    order = np.lexsort((where, who))
    return np.split(where[order], np.searchsorted(who[order], np.arange(1, len(strings))))


def _group_weights(keys: tuple[np.ndarray, ...], weight: np.ndarray) -> np.ndarray:
    """Each row's sum of weights over the rows with equal keys."""
    if not len(weight):
        return weight
    mixed = np.zeros(len(weight), np.uint64)
    for k in keys:
        mixed = (mixed ^ k) * np.uint64(_BASE)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    differ = np.zeros(len(order), bool)
    differ[0] = True
    for k in keys:
        differ[1:] |= k[order[1:]] != k[order[:-1]]
    if np.any(differ[1:] & (mixed[order[1:]] == mixed[order[:-1]])):  # two keys share a hash: sort by the keys themselves
        order = np.lexsort(keys)
        differ[1:] = False
        for k in keys:
            differ[1:] |= k[order[1:]] != k[order[:-1]]
    group = np.cumsum(differ) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(group, weights=weight[order]).astype(np.int64)[group]
    return out


def _ranges(starts: np.ndarray) -> list[int]:
    """Runs of consecutive starts as a flat list of first and last."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]], axis=1).ravel().tolist()


def _key(id_col: str, text: Column) -> list[Column]:
    """Rows that agree here have equal texts, so the same spans; ids may be null or repeated."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"), F.xxhash64(text).alias("k2")]


def repeated_spans(df: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, spans): for each row key the flat list of first and last repeated window starts, unordered; rows without any are absent."""
    if window % BLOCK or window < 4 * BLOCK:
        raise ValueError(f"window must be a multiple of {BLOCK} and at least {4 * BLOCK}")
    spark, gram = df.sparkSession, window // 2
    text = utf8(F.col(text_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller(gram)
        for b in parts(batches):
            for k1, k2, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                view = memoryview(t)
                for owner, s, m, off in segments(t, window, roll):
                    sig = np.fromiter((xxhash.xxh64_intdigest(view[x:y]) for x, y in zip(s.tolist(), (s + m + window - 1).tolist(), strict=True)), np.uint64, len(s))
                    cols = [owner, sig.view(np.int64), np.full(len(s), k1), np.full(len(s), k2), s.astype(np.int32), m.astype(np.int32), off.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["owner", "sig", "k1", "k2", "s", "m", "off"])

    rows = df.where(F.length(text) >= window).select(*_key(id_col, text), text.alias("text"))
    at = {x: scratch_path(spark, x) for x in ("segments", "distinct", "strings", "found")}
    seg = materialise_at(rows.mapInArrow(tidy(cut), "owner long, sig long, k1 long, k2 long, s int, m int, off int"), at["segments"])
    distinct = seg.groupBy("owner", "sig").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "s", "m", "off")).alias("r"))
    distinct = materialise_at(distinct, at["distinct"])
    owners = distinct.groupBy("owner").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
    wanted = distinct.join(owners.drop("total"), "owner").select("owner", "sig", "n", "kinds", "r.*")
    per_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("owner", "sig", "n", "kinds", "s", "m", "off")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["owner", "sig", "n", "kinds", "off", "m", "string"]
        for b in parts(batches):
            for t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cols = [[w[c] for w in want] for c in names[:-1]] + [[t[w["s"] : w["s"] + w["m"] + window - 1] for w in want]]
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    strings = rows.join(per_text, ["k1", "k2"]).select("text", "want").mapInArrow(tidy(fetch), "owner long, sig long, n long, kinds long, off int, m int, string binary")
    strings = materialise_at(strings, at["strings"])

    def construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(group: list[tuple]) -> pa.RecordBatch:
            owner, sig, n, off, m, string = zip(*group, strict=True)
            found = repeated(list(string), np.array(off, np.int64), np.array(m, np.int64), np.array(n, np.int64), window)
            spans = [_ranges(x) for x in found]
            some = [i for i, x in enumerate(spans) if x]
            return pa.RecordBatch.from_arrays([pa.array([owner[i] for i in some], pa.int64()), pa.array([sig[i] for i in some], pa.int64()), pa.array([spans[i] for i in some], pa.list_(pa.int32()))], ["owner", "sig", "spans"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= COLLECTION and row[0] != held[-1][0]:
                    yield out(held)
                    held = []
                if not held or row[:2] != held[-1][:2]:  # repeated rows of the table fetch the same segment again
                    held.append(row)
        if held:
            yield out(held)

    spans = "owner long, sig long, spans array<int>"
    cold = strings.where(F.col("kinds") <= HOT).select("owner", "sig", "n", "off", "m", "string")
    cold = cold.repartition("owner").sortWithinPartitions("owner", "sig").mapInArrow(tidy(construct), spans)
    hot = _hot_windows(strings.where(F.col("kinds") > HOT), window)
    found = materialise_at(cold.unionByName(hot), at["found"])
    discard(spark, at["strings"])
    where = seg.select("owner", "sig", "k1", "k2", "s").join(found, ["owner", "sig"])
    placed = where.select("k1", "k2", F.transform("spans", lambda x: x + F.col("s")).alias("spans"))
    return placed.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _hot_windows(strings: DataFrame, window: int) -> DataFrame:
    """The same for owners with too many distinct segments for one task: each window is counted by its own two hashes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Roller(window), Roller(window, 0xC2B2AE3D27D4EB4F)
        for b in batches:
            for owner, sig, n, m, string in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = np.frombuffer(string, np.uint8)
                cols = [one(data).view(np.int64), two(data).view(np.int64), np.full(m, owner), np.full(m, sig), np.full(m, n), np.arange(m, dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["w1", "w2", "owner", "sig", "n", "at"])

    each = strings.select("owner", "sig", "n", "m", "string").dropDuplicates(["owner", "sig"]).mapInArrow(tidy(emit), "w1 long, w2 long, owner long, sig long, n long, at int")
    twice = each.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1").select("w1", "w2")
    per = each.join(twice, ["w1", "w2"]).groupBy("owner", "sig").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return per.select("owner", "sig", F.flatten(F.transform("at", lambda x: F.array(x, x))).alias("spans"))


def _by_row(df: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """One column `row`, a struct of df's columns whatever their names, and `spans`."""
    k1, k2 = _key(id_col, utf8(F.col(text_col)))
    found = repeated_spans(df, window, id_col, text_col).toDF("f1", "f2", "spans")
    rows = df.select(F.struct(*df.columns).alias("row"), k1, k2)
    return rows.join(found, (rows["k1"] == found["f1"]) & (rows["k2"] == found["f2"]), "left").select("row", "spans")


def removed_runs(starts: list[int] | None, window: int) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of bytes that windows with these first and last starts cover."""
    runs: list[list[int]] = []
    if starts:
        for a, b in sorted(zip(starts[::2], starts[1::2], strict=True)):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b + window)
            else:
                runs.append([a, b + window])
    return [(a, b) for a, b in runs]


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def repeat_report(df: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the text that is left, without characters that were cut.

    Null text counts as empty; texts shorter than the window keep all. A text of any length is treated whole. Repeated rows are separate texts,
    which repeat each other. Ids may be null or repeated; other columns of any name are ignored. An empty table gives an empty result.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                runs = removed_runs(spans, window)
                kept = _kept(t, runs)
                rows.append((len(t), sum(y - x for x, y in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    found = _by_row(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")), window, "id", "body")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    return found.select("row.id", utf8(F.col("row.body")).alias("text"), "spans").mapInArrow(tidy(report), schema)


def drop_repeats(docs: DataFrame, window: int = 400) -> DataFrame:
    """docs with their own columns, text without the repeated bytes and n_chars as the new text's; bytes of a character that is cut go too.

    Every row stays, one with a null text as it is. Repeated rows repeat each other, so they lose all that fills a window. Other columns may have any
    name. A text of any length is treated whole; an empty table gives an empty result.
    """
    names = docs.columns
    at = names.index("text")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            cols = b.column(0).flatten()
            cols[at] = pa.array([t if not s else _kept(t.encode(), removed_runs(s, window)).decode("utf-8", "ignore") for t, s in zip(cols[at].to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    out = _by_row(docs, window, "doc_id", "text").mapInArrow(tidy(strip), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
