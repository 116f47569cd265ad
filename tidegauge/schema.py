"""Run record and feature columns, with the enumerations that the engine shares."""

from __future__ import annotations

from pyspark.sql import types as T

RUN = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("run_id", "table_name", "pipeline_name", "source_system")]
    + [T.StructField("layer", T.IntegerType()), T.StructField("criticality", T.StringType())]
    + [T.StructField(c, T.TimestampNTZType()) for c in ("scheduled_at", "started_at", "completed_at")]
    + [T.StructField("latency_minutes", T.DoubleType())]
    + [T.StructField(c, T.LongType()) for c in ("rows_read", "rows_written")]
    + [T.StructField(c, T.StringType()) for c in ("execution_status", "failure_mode")]
    + [T.StructField(c, T.IntegerType()) for c in ("day_of_week", "is_weekend", "day_idx")]
)

# fixed values: severity names, event families, states by (exec, read, write), and weights
SEVERITIES = ("NORMAL", "WATCH", "WARN", "DEGRADED", "CRITICAL")
EVENT_FAMILIES = ("INFRA_CASCADE", "SILENT_BUSINESS_FAILURE", "GRADUAL_DRIFT", "PHANTOM_RECOVERY")
QUIET_FAMILIES = ("NONE", "EXPECTED_EMPTY")
STATES = {
    "111": (0, "HEALTHY", "none"),
    "110": (1, "SILENT_BUSINESS_FAILURE", "analytics_engineer"),
    "100": (2, "EXPECTED_EMPTY", "monitor_only"),
    "101": (3, "IMPOSSIBLE_STATE", "data_quality"),
    "000": (4, "INFRASTRUCTURE_FAILURE", "platform_team"),
    "011": (5, "EXEC_FAILED_DATA_OK", "orchestration_team"),
    "010": (6, "PARTIAL_FAILURE", "platform_team"),
    "001": (7, "IMPOSSIBLE_STATE", "data_quality"),
}
CRITICALITY = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
MISS_WEIGHT = {1: 1, 2: 2, 3: 4, 4: 8}
# columns that no model may learn from
NOT_FEATURES = (
    "run_id", "table_name", "pipeline_name", "source_system", "scheduled_at", "started_at", "completed_at", "execution_status",
    "failure_mode", "event_family", "severity_label", "severity_name", "rule_severity", "diag_state_label", "diag_owner",
    "latency_minutes", "rows_read", "rows_written", "day_idx",
)
