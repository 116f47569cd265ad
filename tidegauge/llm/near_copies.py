"""Near copies by word shingles: several short fingerprints a text, vantage-point trees over them, and an exact check of the likeness.

1. A text is its set of 5-word shingles. The shingles are dealt by their hash into BANDS ranges, and the SimHash of the ROWS smallest
   hashes of a range is one fingerprint. Two texts of likeness s agree in a range's sample with a probability of about s^ROWS: at 0.8 one of
   eight ranges does in 98 of 100 cases, at 0.2 in 1 of 100. A single fingerprint of the whole text would need a radius at which no tree prunes.
2. All fingerprints go through the vantage-point trees of `simhash`; those within the radius form a class, whose texts are candidates.
3. A shingle that no other candidate has can't be in what two texts share. It bounds a text's likeness to any other: texts that can't reach it are done,
   and the text of a class with the least share of such shingles, its centre, is alike to most that are alike to any.
4. In each class every text that is left is checked against the centre by the exact Jaccard likeness, a number of pairs that is linear in the candidates.
   Only classes whose texts are then still in several components are searched on, block by block in matrix products: the texts that
   aren't in the centre's component meet all others. A block gives links that join its components, fewer than it has texts. So no link
   between components of candidates is lost and no group is listed as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import among, materialise, materialise_at, parts, scoped, scratch_path, tidy, utf8, without
from tidegauge.llm.components import connected_components
from tidegauge.llm.simhash import hamming_links

#: Words of a shingle; the likeness from which texts are near copies, as a fraction; ranges of hashes (a power of two), and shingles of a range's sample.
WORDS, LIKE, BANDS, ROWS = 5, (4, 5), 8, 4
#: Texts of a class that meet in a block of the exact search, and shingles of a matrix product.
BLOCK, COLUMNS = 256, 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased word shingles; fewer words are one shingle, none are no shingle."""
    w = text.lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    size = min(words, len(w))
    out = np.zeros(len(w) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        out = _mix((out ^ h[k : len(h) - size + 1 + k]) + _STEP)
    return np.unique(out)


def fingerprints_of(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(position in sets, fingerprint) of each range that has a shingle; a text without shingles has the fingerprint 0."""
    shift = np.uint64(64 - bands.bit_length() + 1)
    heads = np.arange(bands, dtype=np.uint64) << shift
    who, picked, counts = [], [], []
    for i, s in enumerate(sets):
        cut = np.append(np.searchsorted(s, heads), len(s))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            some = s[cut[b] : min(cut[b + 1], cut[b] + rows)]
            who.append(i)
            counts.append(len(some))
            picked.append(some)
    n = np.array(counts, np.int64)
    flat = _mix(np.concatenate([*picked, np.zeros(0, np.uint64)]) * _STEP)
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.add.reduceat(bits.astype(np.int32), np.cumsum(n) - n, axis=0) if len(n) else np.zeros((0, 64), np.int32)
    fp = np.packbits(2 * total > n[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()
    none = np.array([i for i, s in enumerate(sets) if not len(s)], np.int64)
    return np.concatenate([np.array(who, np.int64), none]), np.concatenate([fp.astype(np.uint64), np.zeros(len(none), np.uint64)])


def alike(a: np.ndarray, b: np.ndarray, like: tuple[int, int] = LIKE) -> bool:
    """Whether two sets of shingles have a Jaccard likeness of `like` or more; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * like[1] >= like[0] * (len(a) + len(b) - both)


def across(sets: list[np.ndarray], component: np.ndarray, like: tuple[int, int] = LIKE) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all alike pairs whose components differ, from products of the incidence matrix of shingles that several sets have."""
    n = np.array([len(s) for s in sets], np.int64)
    kinds, at, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = times[at] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[at[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        some = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[some], column[some] - low] = 1
        both += m @ m.T
    good = (both * like[1] >= like[0] * (n[:, None] + n[None, :] - both)) & (component[:, None] != component[None, :])
    return np.nonzero(np.triu(good, 1))


def bridges(component: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places in x and y of links that join the components as all of them do, fewer than there are components."""
    kinds, number = np.unique(component, return_inverse=True)
    top = list(range(len(kinds)))

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    kept = []
    for at, (a, b) in enumerate(zip(number[x].tolist(), number[y].tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            top[max(a, b)] = min(a, b)
            kept.append(at)
    return kept


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, cuts = column.flatten().to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip((cuts - cuts[0])[:-1].tolist(), (cuts - cuts[0])[1:].tolist(), strict=True)]


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, like: tuple[int, int] = LIKE, radius: int = 2) -> DataFrame:
    """Links (a, b), a < b, between ids of candidates with a likeness of `like` or more: enough of them to join all that such links reach."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            who, fp = fingerprints_of([shingles(t, words) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[who]), pa.array(fp.view(np.int64))], ["id", "fp"])

    fps = materialise(rows.mapInArrow(tidy(prints), "id long, fp long"), "band-fingerprints")
    kinds = materialise(fps.groupBy("fp").agg(F.min("id").alias("low"), F.max("id").alias("high")), "band-classes")
    merged = materialise(connected_components(hamming_links(kinds.select("fp", F.col("fp").alias("rep")), radius)), "band-components")
    named = kinds.join(merged, kinds["fp"] == merged["node"], "left").select("fp", F.coalesce("component", "fp").alias("cls"), "low", "high")
    spread = named.groupBy("cls").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("cls")
    wanted = named.select("fp", "cls").join(spread, "cls")
    members = materialise(fps.join(wanted, "fp").select("cls", "id").distinct(), "band-members")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            found = [shingles(t, words).view(np.int64) for t in b.column(1).to_pylist()]
            cuts = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(cuts, np.concatenate([*found, np.zeros(0, np.int64)]))], ["id", "s"])

    asked = materialise(members.select(F.col("id").alias("asked")).distinct(), "asked")
    sets = among(rows, asked, F.col("id") == F.col("asked")).mapInArrow(tidy(sets_of), "id long, s array<long>")
    sets = materialise(sets.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s")) if _repeats(rows) else sets, "shingles")

    able = materialise(_able(members, sets, like), "able-members")
    pairs = able.where("id <> lead").select("lead", "id").distinct()
    own, first = sets.select("id", F.col("s").alias("x")), sets.select(F.col("id").alias("lead"), F.col("s").alias("y"))
    both, n = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    enough = F.least(F.size("x"), F.size("y")) * like[1] >= F.greatest(F.size("x"), F.size("y")) * like[0]
    led = pairs.join(own, "id").join(first, "lead").where(enough).where(both * (like[0] + like[1]) >= n * like[0])
    star = materialise(led.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")), "led-links")
    comp = materialise(connected_components(star), "led-components")
    main = comp.select(F.col("node").alias("head"), F.col("component").alias("main"))
    placed = able.join(comp, able["id"] == comp["node"], "left").join(main, able["lead"] == main["head"], "left")
    placed = placed.select("cls", "id", F.coalesce("component", "id").alias("component"), F.coalesce("main", "lead").alias("main"))
    dealt = _dealt(materialise(placed, "led-members")).join(sets, "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            ids, component = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
            x, y = across([h[2].view(np.uint64) for h in held], component, like)
            some = bridges(component, x, y)
            return _links(ids[x[some]], ids[y[some]])

        for b in parts(batches):
            cols = [b.column(k).to_pylist() for k in range(5)]
            for *now, i, c, s in zip(*cols, _lists(b.column(5)), strict=True):
                if now != key and held:
                    yield out()
                    held = []
                key = now
                held.append((i, c, s))
        if held:
            yield out()

    blocks = dealt.select("cls", "i", "j", "id", "component", "s").repartition("cls", "i", "j").sortWithinPartitions("cls", "i", "j")
    rest = materialise(blocks.mapInArrow(tidy(search), "a long, b long"), "block-links")
    return star.unionByName(rest)


def _able(members: DataFrame, sets: DataFrame, like: tuple[int, int]) -> DataFrame:
    """(cls, id, lead): each class's centre, and the texts whose shingles that other candidates have are enough to be alike to a text of its smallest size."""
    lone = sets.select("id", F.explode("s").alias("x")).groupBy("x").agg(F.min("id").alias("id"), F.max("id").alias("high")).where("id = high")
    lone = lone.groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    core = sets.select("id", F.size("s").alias("n")).join(lone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("shared"))
    seen = members.join(materialise(core, "shared"), "id")
    centre = F.min(F.struct((-F.col("shared") / F.greatest("n", F.lit(1))).alias("by"), "id"))
    head = seen.groupBy("cls").agg(centre.alias("c"), F.min("n").alias("least")).select("cls", F.col("c.id").alias("lead"), "least")
    return seen.join(head, "cls").where(F.col("shared") * (like[0] + like[1]) >= (F.col("n") + F.col("least")) * like[0]).select("cls", "id", "lead")


def _dealt(placed: DataFrame) -> DataFrame:
    """(cls, i, j, id, component): the blocks of classes with several components. What isn't in the main one meets all texts; the main one's don't meet each other."""
    rest = F.col("component") != F.col("main")
    sizes = placed.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count_if(rest).alias("r"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    one = F.col("n") <= BLOCK  # all in one block
    blocks = [F.when(one, alone).otherwise(F.ceil(n / BLOCK)).cast("int") for n, alone in ((F.col("r"), 1), (F.col("n") - F.col("r"), 0))]
    some = placed.join(sizes.select("cls", one.alias("one"), blocks[0].alias("high"), blocks[1].alias("more")), "cls")
    outer = F.col("one") | rest
    h = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1)))
    spot = F.when(outer, h(F.col("high"))).otherwise(F.col("high") + h(F.col("more"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(outer, F.col("high") + F.col("more")).otherwise(F.col("high")) - 1))
    some = some.withColumn("spot", spot).withColumn("other", other).where("spot <> other or high + more = 1")
    return some.select("cls", F.least("spot", "other").alias("i"), F.greatest("spot", "other").alias("j"), "id", "component")


def _repeats(rows: DataFrame) -> bool:
    """Whether an id is on several rows; such rows are one text."""
    return rows.groupBy("id").count().where("count > 1").limit(1).count() > 0


def keep_one(docs: DataFrame, words: int = WORDS, like: tuple[int, int] = LIKE, radius: int = 2) -> DataFrame:
    """The rows of docs whose id is the smallest of its component of near copies, with the columns of docs, whatever their names.

    Null text counts as empty; texts without words are alike. Rows that share an id are one document, the union of their shingles, and stay or go
    together. Rows with a null id stay. Texts of equal shingles are copies, so of ties the smallest id stays. Texts of any length are
    compared whole. An empty table gives an empty result.
    """
    path = scratch_path(docs.sparkSession, "near-gone")
    with scoped(docs.sparkSession):
        gone = materialise_at(connected_components(near_links(docs, words=words, like=like, radius=radius)).select("node"), path)
    return without(docs, gone, docs["doc_id"].cast("long") == gone["node"])
