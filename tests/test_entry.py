import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def test_entry_gives_rows(spark):
    assert e.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_a_session_and_without_the_optional_subpackage(tmp_path):
    code = "import sys; sys.modules['tidegauge.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.parametrize("name", ["f1_history", "f3_cusum", "f4_state", "f6_rolling", "f8_upstream", "feat_matrix", "feat_null_profile", "feat_selection", "feat_medians", "eval_compare", "eval_compare_slice", "eval_auc", "audit_trend_drift"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SMALL}/events.parquet')")
    want = con.execute(e.oracle_sql()[name]).df()
    got = e.queries()[name](spark, SMALL).toPandas()[list(want.columns)]
    tidy = lambda d: d.astype(object).where(d.notna(), None).map(lambda v: round(float(v), 5) if isinstance(v, int | float) and not isinstance(v, bool) else v)
    assert sorted(map(str, tidy(got).values.tolist())) == sorted(map(str, tidy(want).values.tolist()))


def test_only_one_exchange_for_a_tables_own_features(spark):
    from tidegauge.plans.feature_matrix import series_features
    from tidegauge.sources import simulate

    plan = series_features(simulate.simulate(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(table_name") == plan.count("Exchange") == 1


def test_a_comparison_runs_its_rows_once(spark):
    from tidegauge.plans import queries

    plan = queries.eval_compare(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
