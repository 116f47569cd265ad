"""Labels and rules: the event a row belongs to, its true severity, and the severity that fixed thresholds would give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.windows import holds, whole_table
from tidegauge.schema import SEVERITIES


def drift_stage(days: Column) -> Column:
    return F.when(days < 7, 1).when(days < 21, 2).when(days < 45, 3).otherwise(4)


def _onset(family: Column) -> Column:
    return F.min(F.when(family == "GRADUAL_DRIFT", F.col("day_idx"))).over(whole_table())


def family(df: DataFrame) -> DataFrame:
    """event_family: the failure mode, but a drifting table keeps drifting through its empty weekends."""
    df = df.withColumn("__onset", _onset(F.col("failure_mode")))
    still = (F.col("failure_mode") == "EXPECTED_EMPTY") & (F.col("day_idx") >= F.col("__onset"))
    return df.withColumn("event_family", F.when(holds(still), "GRADUAL_DRIFT").otherwise(F.col("failure_mode"))).drop("__onset")


def severity(df: DataFrame) -> DataFrame:
    """severity_label 0..4 and severity_name, from event_family and dag_criticality (2 where there is none)."""
    fam = F.col("event_family")
    df = df.withColumn("__onset", _onset(fam))
    base = F.when(fam == "INFRA_CASCADE", 4).when(fam == "SILENT_BUSINESS_FAILURE", 3).when(fam == "PHANTOM_RECOVERY", 2)
    base = base.when(fam == "GRADUAL_DRIFT", drift_stage(F.col("day_idx") - F.col("__onset"))).otherwise(0)
    crit = F.col("dag_criticality") if "dag_criticality" in df.columns else F.lit(2)
    shift = F.when(crit == 1, -1).when(crit == 4, 1).otherwise(0)
    label = F.when(base > 0, F.greatest(F.lit(1), F.least(F.lit(4), base + shift))).otherwise(0).cast("int")
    names = F.array(*map(F.lit, SEVERITIES))
    return df.withColumn("severity_label", label).withColumn("severity_name", F.element_at(names, F.col("severity_label") + 1)).drop("__onset")


def rule_severity(df: DataFrame) -> DataFrame:
    """rule_severity: the highest level with a threshold that is passed."""
    score, z, rows, code = F.col("cusum_drift_score"), F.col("latency_zscore"), F.col("rows_zscore"), F.col("diag_state_code")
    levels = {
        4: [code.isin(4, 5, 6), score > 4.0],
        3: [score > 2.5, z > 3.0, code == 1],
        2: [score > 1.5, z > 2.0, rows < -2.5],
        1: [score > 0.5, z > 1.0],
    }
    out = None
    for level, tests in levels.items():
        passed = F.greatest(*map(holds, tests))
        out = F.when(passed, level) if out is None else out.when(passed, level)
    return df.withColumn("rule_severity", out.otherwise(0).cast("int"))


def detector_floor(df: DataFrame) -> Column:
    """The least severity that detectors alone give; detectors whose columns are missing don't count."""
    has = set(df.columns)
    floors = [F.lit(0), F.lit(0)]
    if "diag_state_code" in has:
        floors.append(F.when(F.col("diag_state_code").isin(1, 4, 5, 6), 3).otherwise(0))
    if "ewma_alert" in has:
        floors.append(F.when(holds(F.col("ewma_alert") > 0), 2).otherwise(0))
    if {"was_retried", "latency_zscore"} <= has:
        floors.append(F.when(holds((F.col("was_retried") > 0) & (F.col("latency_zscore") > 3.0)), 2).otherwise(0))
    return F.greatest(*floors)
