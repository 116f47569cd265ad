"""Runs from an event stream: every event is one run of the table that its id names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_TABLES = 22
NAMES = tuple(f"t{i:02d}" for i in range(N_TABLES))
DRIFTING = "t05"


def runs(events: DataFrame) -> DataFrame:
    """events (event_id, ts, event_type, value, props) as runs: table_name, day_idx, day_of_week, latency_minutes, execution_status, rows, failure_mode."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    table = F.pmod(F.col("event_id"), F.lit(N_TABLES))
    order = Window.partitionBy("table_no").orderBy("ts", "event_id")
    every = Window.partitionBy("table_no")
    error, view, low = F.col("event_type") == "error", F.col("event_type") == "view", F.col("k") < 50
    base = events.select(table.alias("table_no"), "event_id", "ts", "event_type", F.col("value").alias("latency_minutes"), k.alias("k"))
    base = base.withColumns({"day_idx": (F.row_number().over(order) - 1).cast("int"), "n": F.count(F.lit(1)).over(every), "day_of_week": F.weekday("ts")})
    name = F.concat(F.lit("t"), F.lpad(F.col("table_no").cast("string"), 2, "0"))
    mode = (
        F.when((name == DRIFTING) & (F.col("day_of_week") >= 5), "EXPECTED_EMPTY")
        .when((name == DRIFTING) & (F.col("day_idx") >= F.floor(F.col("n") / 3)), "GRADUAL_DRIFT")
        .when(error & low, "INFRA_CASCADE")
        .when(view & low, "SILENT_BUSINESS_FAILURE")
        .when(F.col("event_type") == "signup", "PHANTOM_RECOVERY")
        .otherwise("NONE")
    )
    return base.select(
        name.alias("table_name"),
        "day_idx",
        "day_of_week",
        (F.col("day_of_week") >= 5).cast("int").alias("is_weekend"),
        "latency_minutes",
        F.when(error & low, 0).otherwise(F.col("k") * 10).cast("bigint").alias("rows_read"),
        F.when((error | view) & low, 0).otherwise(F.col("k") * 10).cast("bigint").alias("rows_written"),
        F.when(error, "FAILED").when(F.col("event_type") == "signup", "RETRIED").otherwise("SUCCESS").alias("execution_status"),
        mode.alias("failure_mode"),
    )


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark.read.parquet(f"{sf_dir}/events.parquet"))
