import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidegauge.llm import exact_dedup as ed
from tidegauge.llm import simhash as sh
from tidegauge.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, "Same Text", "en", "a", 9),
    (7, "same text", None, "b", 9),
    (7, "same text", None, "b", 9),
    (2, None, None, None, None),
    (3, "", "en", "c", 0),
    (4, "É caps", "fr", "c", 6),
    (5, "é caps", "fr", "c", 6),
    (None, "SAME text", "en", "d", 9),
    (None, "alone", "en", "d", 5),
    (8, "word " * 30_000, "en", "d", 150_000),
]


def brute_exact(rows):
    sha = [hashlib.sha256((t or "").encode().lower()).hexdigest() for _, t, *_ in rows]
    groups = defaultdict(list)
    for (i, *_), s in zip(rows, sha, strict=True):
        groups[s].append(i)
    top = {s: max((i for i in g if i is not None), default=None) for s, g in groups.items()}
    return sorted(((r[0], top[s], len(groups[s]), r[0] == top[s], s) for r, s in zip(rows, sha, strict=True)), key=str)


@pytest.mark.parametrize("k", [1, 1024])
def test_exact_dedup_edge_cases(spark, k):
    df = spark.createDataFrame([(*r, "x", "y") for r in EDGE], DOCS + ", keep_id string, digest string")
    assert sorted((tuple(r) for r in ed.exact_dedup(df, k=k).collect()), key=str) == brute_exact(EDGE)


def test_exact_dedup_hot_group_and_empty_table(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}", None, None, None) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    assert sorted((tuple(r) for r in ed.exact_dedup(df, k=16).collect()), key=str) == brute_exact(rows)
    assert ed.exact_dedup(df.where("false")).collect() == []
    assert ed.keep_first(df).columns == df.columns
    assert ed.keep_first(df).count() == len({r[1] for r in rows})


def test_rows_that_share_an_id_stay_or_go_by_their_own_text(spark, monkeypatch):
    rows = [(1, "A", "x"), (2, "a", "x"), (2, "B", "x"), (3, "b", "x"), (None, "a", "x"), (None, "c", "x"), (4, None, "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id string")
    want = [(2, "a", "x"), (3, "b", "x"), (5, "", "x"), (None, "c", "x")]
    assert sorted(map(tuple, ed.keep_first(df).collect()), key=str) == sorted(want, key=str)
    from tidegauge.llm import common

    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, ed.keep_first(df).collect()), key=str) == sorted(want, key=str)


def test_misra_gries_bound():
    keys = ["a"] * 500 + [f"x{i}" for i in range(1000)]
    mg = ed.MisraGries(9)
    for i in range(0, len(keys), 50):
        mg.add(keys[i : i + 50])
    assert len(mg.counts) <= 9 and 500 - len(keys) / 10 <= mg.counts["a"] <= 500


def brute_fp(text, words=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=2):
    top = list(range(len(ids)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                top[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return {x: low[find(i)] for i, x in enumerate(ids)}


def test_simhash_matches_brute_force_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    fps = [brute_fp(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.simhash_components(df).collect()}
    assert got == {r.doc_id: (f"{f:016x}", want[r.doc_id]) for r, f in zip(rows, fps, strict=True)}


def test_hamming_links_are_exact_over_shards(spark, monkeypatch):
    monkeypatch.setattr(sh, "SHARD", 100)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near, near[:100] ^ np.uint64(4), np.arange(200, dtype=np.uint64)]))
    ids = rng.permutation(len(fps))
    df = spark.createDataFrame([(int(f.astype(np.int64)), int(i)) for f, i in zip(fps, ids, strict=True)], "fp long, rep long").repartition(5)
    got = {tuple(r) for r in sh.hamming_links(df).collect()}
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert got == {(min(ids[x], ids[y]), max(ids[x], ids[y])) for x, y in zip(*np.nonzero(d <= 2), strict=True) if x < y}


def test_simhash_edge_cases(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in EDGE], DOCS + ", fp string, rep int")
    got = {(r.doc_id, r.component_id) for r in sh.simhash_components(df).collect()}
    assert got == {(1, 1), (7, 1), (2, 2), (3, 2), (4, 4), (5, 5), (None, 1), (None, None), (8, 8)}
    assert sh.simhash_components(df.where("false")).collect() == []


def test_components_of_a_long_chain(spark):
    e = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(1, 200)] + [(5000, 5000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long").repartition(9)).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)}
