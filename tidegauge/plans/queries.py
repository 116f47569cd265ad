"""The engine's registered queries over events as runs; their SQL is in oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import audit, evaluate, features, graph, labels
from tidegauge.plans import feature_matrix, protocols
from tidegauge.sources import catalog, events, simulate

KEYS = ["table_name", "day_idx"]
#: Digits that results are rounded to, as sums of doubles depend on their order.
DIGITS = 6
#: Trees for the registered model queries: the reference's 500 and 400, at its rates of 0.03 and 0.04.
TREES = (500, 400)


def _round(df: DataFrame, cols: list[str], keys: list[str] = KEYS, digits: int = DIGITS) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*keys, *(F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in cols))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.load(spark, sf_dir)


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return catalog.nodes(spark, events.NAMES), catalog.edges(spark, events.NAMES)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_matrix.build(_runs(spark, sf_dir), *_graph(spark))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule as prediction, labels, detector alerts and a probability, for the evaluation queries."""
    df = _runs(spark, sf_dir)
    for step in (features.baseline, features.temporal, features.drift, features.volume, features.state):
        df = step(df)
    df = features.graph(df, graph.features(*_graph(spark)))
    df = labels.severity(labels.family(labels.rule_severity(df)))
    p = 1 / (1 + F.exp(-F.coalesce("latency_zscore", F.lit(0.0))))
    return evaluate.detector_alerts(df).withColumns({"severity_pred": F.col("rule_severity"), "p": F.round(p, DIGITS), "y": (F.col("severity_label") > 0).cast("int")})


DETECTORS = ["rule_baseline", "ewma", "cusum", "state_machine"]


def src_runs(spark, d):
    return _round(_runs(spark, d), ["day_of_week", "is_weekend", "latency_minutes", "rows_read", "rows_written", "execution_status", "failure_mode"])


def src_run_counts(spark, d):
    return _runs(spark, d).groupBy("failure_mode").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("table_name").alias("tables"))


def src_simulator(spark, d):
    return simulate.simulate(spark)


def f1_history(spark, d):
    return _round(features.temporal(_runs(spark, d)), ["hist_mean_21d", "hist_std_21d", "hist_p90_21d"])


def f1_zscore(spark, d):
    return _round(features.temporal(_runs(spark, d)), ["latency_zscore"])


def f1_outliers(spark, d):
    """The flagship: runs far above their weekday's history."""
    df = features.temporal(_runs(spark, d)).where("latency_zscore > 3")
    return _round(df, ["latency_minutes", "hist_mean_21d", "hist_std_21d", "latency_zscore"])


def f1_pct_rank(spark, d):
    return _round(features.temporal(_runs(spark, d)), ["latency_pct_rank"])


def f2_baseline(spark, d):
    # means of up to 16 values of two digits end in a 5 at the seventh: round behind it
    return _round(features.baseline(_runs(spark, d)), ["lat_ds", "ds_z", "ref_mu", "ref_sd"], digits=8)


def _drift(spark, d):
    return features.drift(features.baseline(_runs(spark, d)))


def f3_ewma(spark, d):
    return _round(_drift(spark, d), ["ewma_z", "ewma_run", "ewma_alert"])


def f3_cusum(spark, d):
    return _round(_drift(spark, d), ["cusum_s_pos", "cusum_s_neg", "cusum_alert_up", "cusum_alert_dn", "cusum_drift_score"])


def f4_state(spark, d):
    return _round(features.state(_runs(spark, d)), ["diag_state_code", "diag_state_label", "diag_owner", "diag_exec_ok", "diag_read_ok", "diag_write_ok", "row_write_ratio", "was_retried"])


def f4_owner_counts(spark, d):
    return features.state(_runs(spark, d)).groupBy("diag_owner", "diag_state_label").agg(F.count(F.lit(1)).alias("n"))


def f5_closure(spark, d):
    return graph.closure(_graph(spark)[1])


def f5_graph(spark, d):
    return _round(graph.features(*_graph(spark)), ["dag_centrality", "dag_in_degree", "dag_out_degree", "dag_depth", "dag_blast_radius", "dag_ancestry_count", "dag_criticality"], ["table_name"])


def f6_rolling(spark, d):
    return _round(features.rolling(_runs(spark, d)), ["roll7_mean", "roll7_std", "roll7_iqr", "roll7_kurtosis", "latency_velocity", "latency_acceleration"])


def f6_entropy(spark, d):
    return _round(features.rolling(_runs(spark, d)), ["roll7_entropy"])


def f7_volume(spark, d):
    return _round(features.volume(_runs(spark, d)), ["rows_roll7_mean", "rows_roll7_std", "rows_zscore", "rows_pct_drop"])


def f8_upstream(spark, d):
    df = features.state(_drift(spark, d))
    return _round(features.upstream(df, graph.closure(_graph(spark)[1])), ["upstream_failed_count", "upstream_alert_count"])


def lbl_rule_severity(spark, d):
    return labelled(spark, d).select(*KEYS, "rule_severity")


def lbl_family(spark, d):
    return labels.family(_runs(spark, d)).select(*KEYS, "event_family")


def lbl_severity(spark, d):
    return labelled(spark, d).select(*KEYS, "severity_label", "severity_name")


def det_floor(spark, d):
    df = labelled(spark, d)
    return df.select(*KEYS, labels.detector_floor(df).alias("floor"))


def det_alerts(spark, d):
    return labelled(spark, d).select(*KEYS, *(f"alert_{n}" for n in DETECTORS))


def feat_null_profile(spark, d):
    """Every numeric feature: how many rows have it, and their share."""
    df = matrix(spark, d)
    cols = feature_matrix.numeric_features(df)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(c) for c in cols))
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return counts.selectExpr("rows", f"stack({len(cols)}, {pairs}) AS (feature, n)").select("feature", "n", F.round(F.col("n") / F.col("rows"), DIGITS).alias("share"))


def feat_selection(spark, d):
    return spark.createDataFrame([(c,) for c in feature_matrix.select_features(matrix(spark, d))], "feature string")


def feat_medians(spark, d):
    """The training rows' median of every selected feature."""
    df = matrix(spark, d)
    found = feature_matrix.medians(df.where(F.col("day_idx") <= protocols.TRAIN_END), feature_matrix.select_features(df))
    rows = spark.createDataFrame([(c, None if v is None else float(v)) for c, v in found.items()], "feature string, median double")
    return rows.select("feature", F.round("median", 4).alias("median"))


def feat_matrix(spark, d):
    """All columns of the matrix; numbers are rounded, the baseline's as in f2_baseline."""
    df = matrix(spark, d)
    digits = dict.fromkeys(("lat_ds", "ds_z", "ref_mu", "ref_sd"), 8)
    return df.select(*KEYS, *(F.round(c, digits.get(c, DIGITS)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in KEYS))


def eval_onsets(spark, d):
    return evaluate.event_onsets(labels.family(_runs(spark, d)))


def _compared(spark, d):
    return evaluate.compare_detectors(labelled(spark, d), DETECTORS)


def eval_compare(spark, d):
    return _compared(spark, d)


def eval_compare_slice(spark, d):
    """Onsets of the full history, rows of the test split: events that began earlier have no lag."""
    df = labelled(spark, d)
    return evaluate.compare_detectors(protocols.temporal_split(df)[2], DETECTORS, evaluate.event_onsets(df))


def eval_recall_pivot(spark, d):
    return _compared(spark, d).groupBy("family").pivot("detector", DETECTORS).agg(F.first("row_recall"))


def eval_false_alarms(spark, d):
    return _compared(spark, d).groupBy("detector").agg(F.avg("false_alarms_per_100_normal").alias("false_alarms"))


def eval_confusion(spark, d):
    return evaluate.confusion(labelled(spark, d))


def eval_per_class(spark, d):
    return _round(evaluate.per_class(labelled(spark, d)), ["precision", "recall", "f1", "support"], ["severity"])


def eval_standard(spark, d):
    return evaluate.standard_metrics(labelled(spark, d))


def eval_miss_cost(spark, d):
    return evaluate.miss_cost(labelled(spark, d))


def eval_alert_quality(spark, d):
    return evaluate.alert_quality(labelled(spark, d))


def _one(df: DataFrame, c: str) -> DataFrame:
    return df.select(F.round(c, DIGITS).alias(c))


def eval_ece(spark, d):
    return _one(evaluate.calibration_error(labelled(spark, d), "y", "p"), "ece")


def eval_auc(spark, d):
    return _one(evaluate.auc(labelled(spark, d), "y", "p"), "auc")


def eval_coverage(spark, d):
    return evaluate.coverage(labels.family(_runs(spark, d)), protocols.TRAIN_END, protocols.VAL_END)


def eval_uncovered(spark, d):
    return evaluate.uncovered(labels.family(_runs(spark, d)), protocols.TRAIN_END, protocols.VAL_END)


def eval_lofo_cutoff(spark, d):
    """For each family: its tables, and the day before which 70 % of the other tables' rows are."""
    df = labels.family(_runs(spark, d))
    rows = [(f, ",".join(t), float(c)) for f, t in protocols.held_tables(df).items() if (c := protocols.cutoff(df, t)) is not None]
    return spark.createDataFrame(rows, "family string, held_out_tables string, cutoff double")


def audit_trend_drift(spark, d):
    """Trend drift of latencies against their own rolling mean; the test is the same for any trend and residual. Tables too short for it have nulls."""
    df = features.rolling(_runs(spark, d)).select(*KEYS, F.coalesce("roll7_mean", "latency_minutes").alias("stl_trend"), "latency_minutes")
    return audit.trend_drift(df.withColumn("stl_residual", F.col("latency_minutes") - F.col("stl_trend")), strict=False)


def audit_stl(spark, d):
    """The decomposition of the simulated ecosystem, with its drift verdicts."""
    return audit.trend_drift(audit.decompose(simulate.simulate(spark)))


def sim_matrix(spark, d):
    """The simulated ecosystem's feature matrix."""
    return feature_matrix.build(simulate.simulate(spark), catalog.nodes(spark), catalog.edges(spark))


def ml_temporal(spark, d):
    df = sim_matrix(spark, d).cache()
    _, scored, _ = protocols.temporal_protocol(df, feature_matrix.select_features(df), TREES)
    return scored.select(*KEYS, "severity_label", "anomaly_prob", "anomaly_flag", "severity_ml_only", "severity_pred", "floor_applied")


def ml_leave_one_family_out(spark, d):
    df = sim_matrix(spark, d).cache()
    return protocols.leave_one_family_out(df, feature_matrix.select_features(df), TREES)


def stream_detectors(spark, d):
    """The detectors as a streaming query over the runs, one pass in day order."""
    from tidegauge.streaming.detectors import replay

    return _round(replay(_runs(spark, d)), ["ds_z", "ewma_z", "ewma_run", "cusum_s_pos", "cusum_s_neg"])


_NAMES = (
    src_runs, src_run_counts, src_simulator, f1_history, f1_zscore, f1_outliers, f1_pct_rank, f2_baseline, f3_ewma, f3_cusum, f4_state, f4_owner_counts,
    f5_closure, f5_graph, f6_rolling, f6_entropy, f7_volume, f8_upstream, lbl_rule_severity, lbl_family, lbl_severity, det_floor, det_alerts,
    feat_null_profile, feat_selection, feat_medians, feat_matrix, eval_onsets, eval_compare, eval_compare_slice, eval_recall_pivot, eval_false_alarms,
    eval_confusion, eval_per_class, eval_standard, eval_miss_cost, eval_alert_quality, eval_ece, eval_auc, eval_coverage, eval_uncovered,
    eval_lofo_cutoff, audit_trend_drift, audit_stl, sim_matrix, ml_temporal, ml_leave_one_family_out, stream_detectors,
)
QUERIES = {f.__name__: f for f in _NAMES}
