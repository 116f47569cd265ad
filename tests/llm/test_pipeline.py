from collections import defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_near_copies import brute
from tidegauge.llm import queries

SF, W = "/root/testdata/sf0.001", corpus_pipeline.PASSAGE


def test_stages_against_brute_force(spark):
    """Each stage on its own input, as the next one gets it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        if name == "packing":
            tokens = defaultdict(int)
            for r in docs.collect():
                tokens[r.doc_id] += r.length
            assert set(tokens) == set(before)
            break
        assert docs.columns == columns
        after = kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [i for i in before if labels.get(i) == 1]
            assert sum(i in after for i in good) >= 0.95 * len(good)
            assert sum(i in after for i in before if labels.get(i) == 0) <= 0.3 * sum(v == 0 for v in labels.values()) + 1
        if name == "exact_dedup":
            top = {}
            for i, t in before.items():
                key = (t or "").encode().lower()
                top[key] = max(top.get(key, i), i)
            assert set(after) == set(top.values())
        if name == "near_dedup":
            assert set(after) == set(brute(list(before.items())).values())
        if name == "repeats":
            b = [(t or "").encode() for t in before.values()]
            seen = defaultdict(int)
            for t in b:
                for i in range(len(t) - W + 1):
                    seen[t[i : i + W]] += 1
            for (i, _), t in zip(before.items(), b, strict=True):
                gone = bytearray(len(t))
                for a in range(len(t) - W + 1):
                    if seen[t[a : a + W]] > 1:
                        gone[a : a + W] = b"\x01" * W
                assert after[i] == bytes(c for c, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
            assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_run_gives_packed_rows_and_the_query_is_registered(spark):
    out = queries.QUERIES["pipeline"](spark, SF)
    assert out.agg(F.count_distinct("doc_id")).first()[0] > 100 and "ids" not in out.columns


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, gone_id int, row long, node long"


def odd_rows():
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    passage, base = " ".join(f"pass{x}" for x in range(51)), word(120)
    assert len(passage) > W
    texts = [(i, f"{word(60)} {passage if i % 4 == 0 else ''} {word(40)}") for i in range(40)]
    texts += [(50, base), (51, base.upper()), (52, base + " tail"), (52, base + " tail"), (53, None), (53, ""), (54, ""), (None, None), (None, word(30)), (None, base), (55, word(60_000))]
    return [(i, t, "en", "s", 1, 0.5, "x", 1, 2, 3) for i, t in texts], passage


def test_stages_on_nulls_repeats_clashes_and_an_empty_table(spark, monkeypatch):
    rows, passage = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(corpus_pipeline, "read", lambda spark, sf, table: labels)
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality"](spark, docs, SF)
    assert kept.columns == docs.columns and set(kept.collect()) <= set(docs.collect())
    kept = stage["exact_dedup"](spark, docs, SF)
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert kept.columns == docs.columns and ids == sorted([*map(str, range(40)), "51", "52", "52", "54", "None", "55"])
    kept = stage["near_dedup"](spark, docs, SF)
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert kept.columns == docs.columns and ids == sorted([*map(str, range(40)), "50", "53", "53", "None", "None", "None", "55"])
    out = stage["repeats"](spark, docs.where("doc_id < 40"), SF)
    assert out.columns == docs.columns and out.count() == 40
    assert all(passage not in r.text and len(r.text) >= 300 and r.n_chars == len(r.text) for r in out.collect())
    assert stage["repeats"](spark, docs, SF).count() == len(rows)
    pieces = stage["packing"](spark, docs, SF)
    assert sum(r.start == 0 for r in pieces.collect()) == len(rows)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.where("false"), SF).collect() == [], name
