import hashlib
import re

import pytest
import xxhash

from tidegauge.llm import winnow

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
M = (1 << 64) - 1


def turn(x, by):
    return (x << by | x >> 64 - by) & M


def brute_kept(text):
    """[(hash, position)] by scanning every window."""
    runs = re.findall(r"[^ \t\n\x0b\f\r]+", text or "")
    h = [xxhash.xxh64_intdigest(u, seed=42) for r in runs for u in ([r] if len(r) <= 16 else r)]
    h += [0] * (3 - len(h)) if h else []
    g = [(turn(h[i], 2) ^ turn(h[i + 1], 1) ^ h[i + 2]) >> 33 for i in range(len(h) - 2)]
    kept = []
    for s in range(max(1, len(g) - 7)):
        part = [(x, -i) for i, x in enumerate(g[s : s + 8], s)]
        if part and (not kept or kept[-1] != min(part)):
            kept.append(min(part))
    return [(x, -i) for x, i in kept]


def jaccard(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return 1.0 if not a | b else len(a & b) / len(a | b)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        digest = lambda x: hashlib.sha256(",".join(str((h << 31) + 2**31 - 1 - p) for h, p in brute_kept(x)).encode()).hexdigest()
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(t), digest(edited), jaccard(brute_kept(t), brute_kept(edited)), jaccard(brute_kept(t), brute_kept(after))))
    return out


ROWS = [(3, "a b c"), (1, "one two"), (9, None), (4, ""), (5, "x" * 100), (5, "x" * 100), (None, "null id here"), (7, "ta ta ta ta " * 9), (8, "é ü ñ " * 40), (12, "word " * 20_000), (10, " \t\n"), (13, "漢字" * 9 + " kurz " + "あいうえお" * 5)]


@pytest.mark.parametrize("size", [2000, 2])
def test_edge_cases_match_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(winnow, "RANGE", size)
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in ROWS], DOCS).withColumnsRenamed({"lang": "text2", "source": "at"}).repartition(3)
    got = [tuple(r) for r in winnow.edited_report(df).collect()]
    assert sorted(got, key=str) == sorted(brute(ROWS), key=str)
    assert winnow.edited_report(df.where("false")).collect() == []


def test_documents_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE", 7)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in winnow.edited_report(df).collect()) == sorted(brute(rows))


def test_a_shared_passage_of_the_guaranteed_length_is_found(spark):
    passage = " ".join(f"p{i}" for i in range(winnow.W + winnow.K - 1))
    rows = [(i, f"{' '.join(f'a{i}x{j}' for j in range(i))} {passage} {' '.join(f'z{i}y{j}' for j in range(30))}") for i in range(20)]
    got = winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [{g.hash for g in r.grams} for r in got]
    assert set.intersection(*sets)
    assert all(r.grams == sorted(r.grams, key=lambda g: g.position) for r in got)


def test_plan_has_no_python(spark):
    plan = winnow.edited_report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("glue", ["", "_"])
def test_the_report_sees_a_shifted_passage_without_spaces(spark, glue):
    """One character in front must not hide what two texts without spaces share."""
    han = [chr(0x4E00 + i * 7 % 20_000) for i in range(400)]
    for shift in (1, 5, 15, 16):
        rows = [(1, glue.join(han)), (2, "甲" * shift + glue.join(han))]
        got = {r.doc_id: r.near_next for r in winnow.edited_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert min(got.values()) > 0.85
