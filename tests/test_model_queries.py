import pytest

from tidegauge.operators.cascade import Cascade
from tidegauge.plans import protocols, queries


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["ml_temporal", "ml_leave_one_family_out"])
def test_registered_model_queries_fit_the_full_size(spark, monkeypatch, name):
    def fit_folds(df, cols, trees):
        raise Seen(trees)

    monkeypatch.setattr(protocols, "fit_folds", fit_folds)
    with pytest.raises(Seen) as seen:
        queries.QUERIES[name](spark, "")
    full = Cascade([])
    assert seen.value.args[0] == (full.stage1.trees, full.stage2.trees) == (500, 400)
