import hashlib
import tempfile
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import suffix_array as sa

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - window + 1):
            if seen[t[a : a + window]] > 1:
                gone[a : a + window] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return sorted(out, key=str)


def report(spark, rows, window, parts=3):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS + "").repartition(parts)
    return sorted((tuple(r) for r in sa.repeat_report(df, window).collect()), key=str)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{x:x}é" if x % 17 == 0 else f"w{x:x}" for x in rng.integers(0, vocabulary, n))


def planted(seed=3):
    rng = np.random.default_rng(seed)
    passage = words(rng, 60)
    rows = [(i, words(rng, int(rng.integers(0, 200)))) for i in range(60)]
    rows += [(100 + i, f"{words(rng, int(rng.integers(1, 20)))} {passage[i : len(passage) - i]} {words(rng, 9)}") for i in range(25)]
    base = words(rng, 150)
    rows += [(200 + i, base[: 50 * i] + "#" + base[50 * i :]) for i in range(12)]
    rows += [(300, "a" * 700), (301, "ab" * 400), (302, passage * 3), (303, None), (304, ""), (305, "x" * 64), (306, base), (306, base), (None, base)]
    return rows


@pytest.mark.parametrize("hot", [sa.HOT, 5])
def test_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sa, "HOT", hot)
    monkeypatch.setattr(sa, "COLLECTION", 50)
    rows = planted()
    assert report(spark, rows, 64) == brute(rows, 64)


def test_production_window_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in sa.repeat_report(df).collect()), key=str) == brute(rows, 400)


def test_steps_of_a_long_text_meet(spark, monkeypatch):
    monkeypatch.setattr(sa, "STEP", 100)
    rng = np.random.default_rng(5)
    rows = [(1, words(rng, 300)), (2, words(rng, 300))]
    rows.append((3, rows[0][1][333:900]))
    found = {}
    for i, t in rows:
        m = sum(int(m.sum()) for _, _, m, _ in sa.segments(t.encode(), 64, sa.Roller(32)))
        found[i] = m == len(t.encode()) - 63
    assert all(found.values())
    assert report(spark, rows, 64) == brute(rows, 64)


def test_transform_is_the_collection_bwt(monkeypatch):
    monkeypatch.setattr(sa, "READ", 7)
    rng = np.random.default_rng(0)
    strings = [rng.integers(0, 3, n).tolist() for n in (5, 1, 9, 9, 4)] + [[0, 1, 0], [0, 1, 0]]
    sizes = np.array([len(s) for s in strings])
    with tempfile.TemporaryDirectory() as folder:
        t = sa.Transform(folder)
        sid, length, lcp = t.build(np.array(sum(strings, [])), np.cumsum(sizes), sizes)
        bwt = np.fromfile(f"{folder}/bwt.{int(sizes.max()) % 2}", np.int32)
    suffix = [(strings[s][len(strings[s]) - n :] + [-1]) for s, n in zip(sid, length, strict=True)]
    want = sorted(((*s[len(s) - n :], -1), i, n) for i, s in enumerate(strings) for n in range(len(s) + 1))
    assert [tuple(x) for x in suffix] == [w[0] for w in want]
    assert bwt.tolist() == [strings[s][len(strings[s]) - n - 1] if n < len(strings[s]) else -1 for s, n in zip(sid, length, strict=True)]
    for k in range(1, len(suffix)):
        a, b = suffix[k - 1][:-1], suffix[k][:-1]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == same


def test_range_min():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 99, 1000).astype(np.int16)
    s = rng.integers(0, 1000, 500)
    e = np.minimum(999, s + rng.integers(0, 400, 500))
    assert sa.RangeMin(x)(s, e).tolist() == [x[a : b + 1].min() for a, b in zip(s, e, strict=True)]


def test_empty_table_and_pipeline_stage(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in planted()], DOCS)
    assert sa.repeat_report(df.where("false")).collect() == []
    clash = ("spans", "__spans", "row", "k1", "f1")
    out = sa.drop_repeats(df.select("*", *(df.lang.alias(c) for c in clash)), 64)
    assert out.columns == [*df.columns, *clash] and out.count() == df.count()
    assert {r.text for r in out.where("doc_id = 300").collect()} == {""} and out.where("doc_id = 300").first().n_chars == 0
