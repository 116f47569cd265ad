import numpy as np
import pytest

from tests.llm.test_dedup import DOCS, EDGE
from tidegauge.llm import near_copies as nc
from tidegauge.llm.components import connected_components


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def likeness(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def brute(rows):
    """Component of each id by all pairs of likeness 0.8 or more."""
    top = {i: i for i, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    sets = [(i, grams(t)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if 5 * len(a & b) >= 4 * len(a | b):
                i_, j_ = find(i), find(j)
                top[max(i_, j_)] = min(i_, j_)
    return {i: find(i) for i, _ in rows}


def found(spark, rows, parts=4):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(parts)
    comp = {r.node: r.component for r in connected_components(nc.near_links(df)).collect()}
    return {i: comp.get(i, i) for i, _ in rows}


def planted(seed=0, families=30):
    """Families of edited copies, chains among them, and texts of their own."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, i = [], 0
    for f in range(families):
        base = word(int(rng.integers(40, 400)))
        for _ in range(int(rng.integers(1, 9))):
            text = list(base)
            for at in rng.integers(0, len(text), int(rng.integers(0, 1 + len(text) // 60))):
                text[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((i, " ".join(text).upper() if i % 3 else " ".join(text)))
            i += 1
            if f % 4 == 0:
                base = text  # the next is a copy of the copy
    return rows + [(1000 + k, " ".join(word(80))) for k in range(60)]


def test_components_of_planted_copies(spark):
    rows = planted()
    want, got = brute(rows), found(spark, rows)
    assert sum(i != c for i, c in want.items()) > 60
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
    assert all(want[i] == want[c] for i, c in got.items())  # no link that isn't one


def test_recall_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    sets = {i: grams(t) for i, t in rows}
    comp = {r.node: r.component for r in connected_components(nc.near_links(df)).collect()}
    pairs = [(q, i) for q in sets if q % 100 == 0 for i in sets if i != q and 5 * len(sets[q] & sets[i]) >= 4 * len(sets[q] | sets[i])]
    assert pairs and np.mean([comp.get(a, a) == comp.get(b, b) for a, b in pairs]) >= 0.9


@pytest.mark.parametrize("block", [256, 7])
def test_a_hot_loose_group_is_searched_block_by_block(spark, monkeypatch, block):
    """Texts that share a passage but mostly aren't alike: links among those that the smallest id isn't linked to are found too."""
    monkeypatch.setattr(nc, "BLOCK", block)
    rng = np.random.default_rng(4)
    shared = [f"s{x}" for x in range(100)]
    rows = [(0, " ".join(shared))]
    for k in range(1, 60):
        own = [f"f{k // 3}x{x}" for x in range(40)] + [f"o{k}"]
        rows.append((k, " ".join(shared + own)))
    rows += [(100 + k, " ".join(shared + [f"z{x}" for x in rng.integers(0, 10**6, 3)])) for k in range(20)]
    want = brute(rows)
    assert len(set(want.values())) == 21
    assert found(spark, rows) == want


def loose_family(n=150, words=300):
    """A base and copies of it with 1 to 8 edits: few are alike to the smallest id, most are to others; the last ones are alike to none."""
    rng = np.random.default_rng(6)
    base, rows = [f"b{x}" for x in range(words)], []
    for k in range(n):
        text = list(base)
        for at in rng.choice(words // 6, 9 if k == 0 else 20 if k > n - 20 else int(rng.integers(1, 8)), replace=False):
            text[6 * at] = f"e{k}x{at}"
        rows.append((k, " ".join(text)))
    return rows


def test_links_of_a_hot_group_grow_with_its_texts_not_with_its_pairs(spark, monkeypatch):
    """Before, all pairs across the components that the smallest id left were listed, and every text went to each block."""
    monkeypatch.setattr(nc, "BLOCK", 16)
    dealt, deal = [], nc._dealt
    monkeypatch.setattr(nc, "_dealt", lambda placed: dealt.append(deal(placed)) or dealt[-1])
    rows = loose_family()
    want = brute(rows)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(4)
    links = [(r.a, r.b) for r in nc.near_links(df).collect()]
    sets = {i: grams(t) for i, t in rows}
    assert all(a < b and likeness(sets[a], sets[b]) >= 0.8 for a, b in links)
    assert len(links) <= len(rows) * nc.BANDS and 100 < sum(want[i] != i for i in want)
    assert dealt[0].count() <= 2 * len(rows) * nc.BANDS
    assert found(spark, rows) == want


def test_blocks_let_all_pairs_of_different_components_meet(spark, monkeypatch):
    monkeypatch.setattr(nc, "BLOCK", 5)
    rng = np.random.default_rng(7)
    placed = [(c, i, i if rng.random() < share else 10**6 * c, 10**6 * c) for c, n, share in ((1, 40, 0.2), (2, 40, 1.0), (3, 4, 0.5), (4, 23, 0.7)) for i in range(n)]
    met = {}
    for r in nc._dealt(spark.createDataFrame(placed, "cls long, id long, component long, main long")).collect():
        met.setdefault((r.cls, r.i, r.j), []).append(r.id)
    pairs = {(c, *sorted((a, b))) for (c, *_), ids in met.items() for a in ids for b in ids if a != b}
    assert all((c, min(a, b), max(a, b)) in pairs for c, a, x, _ in placed for d, b, y, _ in placed if c == d and x != y)


def test_bridges_join_what_all_links_join():
    rng = np.random.default_rng(8)
    component = rng.integers(100, 130, 60)
    x, y = rng.integers(0, 60, (2, 400))
    some = nc.bridges(component, x, y)
    join = lambda at: brute_join(component, x[at], y[at])
    assert len(some) < 30 and join(some) == join(np.arange(400))
    assert nc.bridges(component, x[:0], y[:0]) == []


def brute_join(component, x, y):
    top = {c: {c} for c in component.tolist()}
    for a, b in zip(component[x].tolist(), component[y].tolist(), strict=True):
        whole = top[a] | top[b]
        top |= dict.fromkeys(whole, whole)
    return {frozenset(v) for v in top.values()}


def test_across_is_all_alike_pairs_of_different_components(monkeypatch):
    monkeypatch.setattr(nc, "COLUMNS", 16)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 50, replace=False), rng.integers(0, 2**63, int(rng.integers(0, 8)), dtype=np.uint64)])) for _ in range(40)] + [np.zeros(0, np.uint64)] * 2
    comp = rng.integers(0, 5, 42)
    comp[-2:] = 0, 1
    x, y = nc.across(sets, comp)
    want = {(i, j) for i in range(42) for j in range(i + 1, 42) if comp[i] != comp[j] and nc.alike(sets[i], sets[j])}
    assert want and set(zip(x.tolist(), y.tolist(), strict=True)) == want


def test_shingles_and_fingerprints():
    assert len(nc.shingles(b"")) == 0 and len(nc.shingles(b"one")) == 1 == len(nc.shingles(b"a b c d e"))
    assert np.array_equal(nc.shingles(b"A b\tC d e f"), nc.shingles(b"a b c  d e\nf")) and len(nc.shingles(b"a b c d e f")) == 2
    assert not np.intersect1d(nc.shingles(b"a b c d e"), nc.shingles(b"b a c d e")).size
    sets = [nc.shingles(" ".join(f"w{i}" for i in range(n)).encode()) for n in (0, 1, 5, 300)]
    who, fp = nc.fingerprints_of(sets)
    assert np.bincount(who).tolist() == [1, 1, 1, nc.BANDS] and fp[who == 0].tolist() == [0]
    some = sets[3][sets[3] < np.uint64(1 << 61)][: nc.ROWS]
    h = [int(x) for x in nc._mix(some * nc._STEP)]
    assert int(fp[who == 3][0]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_edge_cases(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in EDGE], DOCS + ", node string, s int")
    kept = sorted((str(r.doc_id), r.text) for r in nc.keep_one(df).collect())
    assert kept == sorted((str(i), t) for i, t, *_ in EDGE if i not in (3, 7))
    assert nc.keep_one(df).columns == df.columns and nc.keep_one(df.where("false")).collect() == []
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (2, "one two three four five six"), (3, "ONE two three four five six")]
    twice = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in nc.keep_one(twice).collect()) == [1, 1, 2]
