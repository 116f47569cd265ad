import random

from tidegauge.llm import winnow


def test_a_passage_in_unspaced_text_is_found_at_any_offset(spark):
    rng = random.Random(3)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    passage = han(winnow.W + winnow.K - 1)
    rows = [(i, han(20 + i) + passage + han(40)) for i in range(20)]
    got = winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set.intersection(*({g.hash for g in r.grams} for r in got))


def test_runs_up_to_a_unit_stay_whole_beside_longer_ones(spark):
    text = f"{'a' * 16} b {'c' * 17} d"
    got = winnow.F.size(winnow.F.regexp_extract_all(winnow.F.lit(text), winnow.F.lit(winnow.UNITS), winnow.F.lit(0)))
    assert spark.range(1).select(got).first()[0] == 1 + 1 + 17 + 1
