import pytest
from pyspark.sql import functions as F

from tidegauge.operators import audit, evaluate, features, graph, labels
from tidegauge.plans import feature_matrix, protocols
from tidegauge.schema import RUN
from tidegauge.sources import catalog, files, simulate


@pytest.fixture(scope="module")
def runs(spark):
    return simulate.simulate(spark).cache()


@pytest.fixture(scope="module")
def matrix(spark, runs):
    return feature_matrix.build(runs, catalog.nodes(spark), catalog.edges(spark)).cache()


def counts(df, c):
    return {r[0]: r[1] for r in df.groupBy(c).count().collect()}


def test_shape_and_modes(runs):
    assert runs.count() == 3960 and runs.schema == RUN
    assert counts(runs, "failure_mode") == {"NONE": 3805, "GRADUAL_DRIFT": 86, "EXPECTED_EMPTY": 50, "INFRA_CASCADE": 9, "SILENT_BUSINESS_FAILURE": 8, "PHANTOM_RECOVERY": 2}
    assert simulate.records() == simulate.records() and simulate.records(seed=1) != simulate.records()


def test_modes_change_what_they_should(runs):
    one = lambda mode: runs.where(F.col("failure_mode") == mode)
    outage = one("INFRA_CASCADE").collect()
    assert {r.execution_status for r in outage} == {"FAILED"} and all(r.rows_read == r.rows_written == 0 and r.latency_minutes > 180 for r in outage)
    assert {r.table_name for r in outage} == {"raw_orders", "raw_customers", "raw_products"}
    assert all(r.rows_written < 5 < r.rows_read and r.execution_status == "SUCCESS" for r in one("SILENT_BUSINESS_FAILURE").collect())
    assert all(r.execution_status == "RETRIED" and r.latency_minutes > 90 and r.day_idx in (110, 111) for r in one("PHANTOM_RECOVERY").collect())
    assert one("GRADUAL_DRIFT").agg(F.min("day_idx")).first()[0] == 60


def test_matrix_columns_labels_and_selection(matrix):
    assert len(matrix.columns) == 66
    assert counts(matrix, "event_family") == {"NONE": 3805, "GRADUAL_DRIFT": 120, "EXPECTED_EMPTY": 16, "INFRA_CASCADE": 9, "SILENT_BUSINESS_FAILURE": 8, "PHANTOM_RECOVERY": 2}
    assert counts(matrix, "severity_label") == {0: 3821, 1: 21, 2: 24, 3: 85, 4: 9}
    cols = feature_matrix.select_features(matrix)
    assert len(cols) == 45 and "latency_pct_rank" not in cols and not set(cols) & {"day_idx", "rule_severity", "latency_minutes", "severity_label"}
    differs = matrix.where("severity_label <> rule_severity").count() / 3960
    assert differs > 0.03
    assert matrix.where("event_family = 'PHANTOM_RECOVERY' and diag_state_code <> 0").count() == 0  # the state machine can't see a late recovery
    assert matrix.select(F.sum(sum(F.isnan(c).cast("int") for c, t in matrix.dtypes if t == "double"))).first()[0] in (0, None)


def test_published_counts_of_detectors(matrix):
    """False alarms of the rule on the tables of three families, and EWMA, CUSUM and rule hits on the drift."""
    quiet = lambda tables: matrix.where(F.col("table_name").isin(*tables) & evaluate.normal())
    fired = lambda df: (df.where("rule_severity >= 2").count(), df.count())
    assert fired(quiet(["raw_orders", "raw_customers", "raw_products"])) == (21, 531)
    assert fired(quiet(["stg_payments"])) == (6, 172)
    assert fired(quiet(["raw_sessions"])) == (2, 60)
    drift = matrix.where("event_family = 'GRADUAL_DRIFT'")
    assert [drift.where(c).count() for c in ("ewma_alert > 0", "cusum_alert_up > 0", "rule_severity >= 2")] == [104, 113, 114]
    first = lambda c: {r[0]: r[1] for r in matrix.where(c).groupBy("table_name").agg(F.min("day_idx")).collect()}
    assert first("ewma_alert > 0") == {"raw_sessions": 76}
    assert first("cusum_alert_up > 0 and event_family = 'GRADUAL_DRIFT'") == {"raw_sessions": 67}
    assert matrix.where("cusum_alert_up > 0").where(evaluate.normal()).select("table_name").distinct().count() == 8


def test_graph_values(spark):
    g = {r.table_name: r for r in graph.features(catalog.nodes(spark), catalog.edges(spark)).collect()}
    assert len(g) == 22 and len(catalog.EDGES) == 31 and graph.closure(catalog.edges(spark)).count() == 100
    row = lambda n: tuple(g[n][c] for c in ("dag_in_degree", "dag_out_degree", "dag_depth", "dag_blast_radius", "dag_ancestry_count", "dag_centrality"))
    assert row("raw_orders") == (0, 2, 0, 13, 0, 0.0)
    assert row("int_order_payments") == (2, 3, 2, 5, 5, 0.038492)
    assert row("int_customer_ltv") == (3, 3, 2, 4, 7, 0.046429)
    assert row("mart_exec_summary") == (3, 0, 5, 0, 17, 0.0)
    graph.check_acyclic(catalog.edges(spark))
    with pytest.raises(ValueError, match="cycle"):
        graph.check_acyclic(spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string"))


def test_coverage_and_protocol_bounds(matrix):
    cover = {r.split: r for r in evaluate.coverage(matrix, protocols.TRAIN_END, protocols.VAL_END).collect()}
    assert (cover["train"].last_day, cover["validation"].first_day, cover["validation"].last_day, cover["test"].first_day) == (125, 126, 152, 153)
    assert cover["test"].gradual_drift == 27 and cover["test"].infra_cascade == 0
    assert {r.family for r in evaluate.uncovered(matrix, protocols.TRAIN_END, protocols.VAL_END).where("split = 'test'").collect()} == {"INFRA_CASCADE", "SILENT_BUSINESS_FAILURE", "PHANTOM_RECOVERY"}
    tables = protocols.held_tables(matrix)
    assert tables["INFRA_CASCADE"] == ["raw_customers", "raw_orders", "raw_products"] and all(int(protocols.cutoff(matrix, t)) == 125 for t in tables.values())


def test_stl_audit(runs):
    out = {r.table_name: r for r in audit.trend_drift(audit.decompose(runs)).collect()}
    found = [n for n, r in out.items() if r.drift_detected and 60 < r.first_alert_day <= 81]
    assert "raw_sessions" in found
    peaks = sorted((r.peak_trend_z for r in out.values()), reverse=True)
    assert out["raw_sessions"].peak_trend_z == peaks[0] > 5 * peaks[1]


def test_csv_round_trip(spark, runs, tmp_path):
    path = f"{tmp_path}/runs.csv"
    again = files.load_or_build(spark, path, RUN, lambda: runs)
    assert sorted(again.collect()) == sorted(runs.collect())
    assert files.load_or_build(spark, path, RUN, None).count() == 3960
    assert files.markdown(runs.select("table_name", "layer").orderBy("run_id").limit(1)).splitlines()[1] == "| --- | --- |"


@pytest.mark.parametrize("trees", [(50, 30)])
def test_leave_one_family_out(spark, matrix, trees):
    cols = feature_matrix.select_features(matrix)
    out = {(r.family, r.detector): r for r in protocols.leave_one_family_out(matrix, cols, trees).collect()}
    get = lambda f, d: out[f, d].row_recall
    fp = lambda f, d: out[f, d].false_alarms_per_100_normal
    for family in ("INFRA_CASCADE", "SILENT_BUSINESS_FAILURE", "PHANTOM_RECOVERY"):
        assert get(family, "hybrid") == 1.0
        assert fp(family, "hybrid") <= fp(family, "rule_baseline")
    assert get("GRADUAL_DRIFT", "hybrid") >= 0.8 and fp("GRADUAL_DRIFT", "ewma") == 0.0
    assert get("SILENT_BUSINESS_FAILURE", "cascade_ml") < 0.5 and get("PHANTOM_RECOVERY", "cascade_ml") < 0.5


def test_temporal_protocol(matrix):
    cols = feature_matrix.select_features(matrix)
    model, scored, report = protocols.temporal_protocol(matrix, cols, (30, 20))
    rows = scored.collect()
    assert len(rows) == 594 and all(abs(sum(r[f"p_{s}"] for s in ("normal", "watch", "warn", "degraded", "critical")) - 1) < 1e-6 for r in rows)
    assert all(r.severity_pred >= r.severity_ml_only and r.floor_applied == (r.severity_pred > r.severity_ml_only) for r in rows)
    assert set(model.stage2.importance(cols)) == set(cols)
    assert 0 <= report["ece"].first()[0] <= 1 and report["standard"].first().accuracy > 0.5
