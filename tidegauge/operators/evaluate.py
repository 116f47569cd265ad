"""Evaluation operators: event onsets, detector comparison and the metric suite. Every metric is one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.windows import holds
from tidegauge.schema import EVENT_FAMILIES, MISS_WEIGHT, QUIET_FAMILIES, SEVERITIES

#: Ranges of scores that ranks are made in.
SCORE_RANGES = 1000


def normal() -> Column:
    return F.col("event_family").isin(*QUIET_FAMILIES)


def event_onsets(df: DataFrame) -> DataFrame:
    """(event_family, table_name, onset): first day of each event in the full history."""
    return df.where(F.col("event_family").isin(*EVENT_FAMILIES)).groupBy("event_family", "table_name").agg(F.min("day_idx").alias("onset"))


def detector_alerts(df: DataFrame, ml: str = "severity_ml_only", hybrid: str = "severity_pred") -> DataFrame:
    """Boolean alert columns of the six detectors; those of the model only where its columns are there."""
    found = {
        "rule_baseline": F.col("rule_severity") >= 2,
        "ewma": F.col("ewma_alert") > 0,
        "cusum": F.col("cusum_alert_up") > 0,
        "state_machine": F.col("diag_state_code").isin(1, 4, 5, 6),
    }
    found |= {n: F.col(c) >= 2 for n, c in (("cascade_ml", ml), ("hybrid", hybrid)) if c in df.columns}
    return df.withColumns({f"alert_{n}": holds(c) for n, c in found.items()})


def compare_detectors(df: DataFrame, detectors: list[str], onsets: DataFrame | None = None) -> DataFrame:
    """Per detector (a boolean column alert_<name>) and family: rows, row_recall, events_detected, median_lag_days, false_alarms_per_100_normal.

    A lag counts only for events that began in the slice or whose onset isn't known; it is from the event's onset to the first alert. Without
    `onsets` df is the full history. One aggregation by detector, family and table holds all that is asked, quiet rows too, so df is run once.
    """
    pairs = ", ".join(f"'{d}', alert_{d}" for d in detectors)
    long = df.selectExpr("event_family", "table_name", "day_idx", f"stack({len(detectors)}, {pairs}) AS (detector, alert)")
    each = long.groupBy("detector", "event_family", "table_name")
    each = each.agg(F.count(F.lit(1)).alias("n"), F.count_if("alert").alias("hits"), F.min("day_idx").alias("low"), F.min(F.when(F.col("alert"), F.col("day_idx"))).alias("hit"))
    lag = F.col("hit") - F.col("low")
    if onsets is not None:
        first_day = df.agg(F.min("day_idx")).first()[0]
        each = each.join(onsets, ["event_family", "table_name"], "left").withColumn("onset", F.coalesce("onset", "low"))
        lag = F.when(F.col("onset") >= F.lit(first_day), F.col("hit") - F.col("onset"))
    out = each.groupBy("detector", F.col("event_family").alias("family")).agg(
        F.sum("n").alias("rows"),
        F.sum("hits").alias("__hits"),
        F.concat(F.count_if(F.col("hits") > 0).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("events_detected"),
        F.percentile(lag, 0.5).alias("median_lag_days"),
    )
    quiet = lambda c: F.sum(F.when(F.col("family").isin(*QUIET_FAMILIES), F.col(c))).over(Window.partitionBy("detector"))  # noqa: E731 - a row per family
    out = out.withColumn("false_alarms_per_100_normal", F.round(100 * (quiet("__hits") / quiet("rows")), 2)).where(F.col("family").isin(*EVENT_FAMILIES))
    return out.select("detector", "family", "rows", F.round(F.col("__hits") / F.col("rows"), 3).alias("row_recall"), "events_detected", "median_lag_days", "false_alarms_per_100_normal")


def confusion(df: DataFrame, true: str = "severity_label", pred: str = "severity_pred") -> DataFrame:
    """The full 5x5 grid with counts."""
    grid = df.sparkSession.createDataFrame([(t, p) for t in range(5) for p in range(5)], "true int, pred int")
    counts = df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, true: str = "severity_label", pred: str = "severity_pred") -> DataFrame:
    """severity, precision, recall, f1, support for each class that occurs; a ratio without a denominator is 0."""
    c = confusion(df, true, pred)
    by = lambda key, out: c.groupBy(F.col(key).alias("k")).agg(F.sum("n").alias(out), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias(f"{out}_hit"))
    both = by("true", "support").join(by("pred", "fired"), "k").where("support + fired > 0")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    both = both.withColumns({"p": ratio("support_hit", "fired"), "r": ratio("support_hit", "support")})
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return both.withColumn("f1", f1).select(F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("k") + 1).alias("severity"), F.col("p").alias("precision"), F.col("r").alias("recall"), "f1", "support")


def standard_metrics(df: DataFrame, true: str = "severity_label", pred: str = "severity_pred") -> DataFrame:
    """One row: accuracy, macro_f1, weighted_f1, ordinal_mae, from the confusion counts."""
    f = per_class(df, true, pred).agg(F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"))
    c = confusion(df, true, pred).agg(
        F.round(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("accuracy"),
        F.round(F.sum(F.abs(F.col("true") - F.col("pred")) * F.col("n")) / F.sum("n"), 4).alias("ordinal_mae"),
    )
    return c.crossJoin(F.broadcast(f))  # one row each


def miss_cost(df: DataFrame, true: str = "severity_label", pred: str = "severity_pred") -> DataFrame:
    """One row: false_negatives, raw_fn_cost, normalised_fn_cost, weighted by criticality and log of the blast radius."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in MISS_WEIGHT.items() for x in kv))[F.col("dag_criticality")], F.lit(1))
    weight = weight * F.log1p(F.greatest(F.coalesce("dag_blast_radius", F.lit(0)), F.lit(1)))
    real, missed = F.col(true) > 0, (F.col(true) > 0) & (F.col(pred) == 0)
    cost = F.coalesce(F.sum(F.when(missed, weight)), F.lit(0.0))
    worst = F.coalesce(F.sum(F.when(real, weight)), F.lit(0.0))
    return df.agg(F.count_if(missed).alias("false_negatives"), F.round(cost, 2).alias("raw_fn_cost"), F.round(cost / (worst + 1e-9), 4).alias("normalised_fn_cost"))


def alert_quality(df: DataFrame, true: str = "severity_label", pred: str = "severity_pred") -> DataFrame:
    """One row: alerts_fired, alert_precision, alert_recall, false_alarms_per_100_normal, for severities from WARN up."""
    fired, real = F.col(pred) >= 2, F.col(true) >= 2
    least_one = lambda c: F.greatest(F.lit(1), F.count_if(c))
    return df.agg(
        F.count_if(fired).alias("alerts_fired"),
        F.round(F.count_if(fired & real) / least_one(fired), 4).alias("alert_precision"),
        F.round(F.count_if(fired & real) / least_one(real), 4).alias("alert_recall"),
        F.round(100 * F.avg(F.when(normal(), fired.cast("int"))), 2).alias("false_alarms_per_100_normal"),
    )


def calibration_error(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """One row: ece, over equal-width bins whose inner edges are those of a linspace; a value on an edge is in the upper bin."""
    edges = F.array(*(F.lit(float(i * (1.0 / bins))) for i in range(1, bins)))
    binned = df.groupBy(F.size(F.filter(edges, lambda e: e <= F.col(p))).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(F.col(y).cast("double")).alias("y"))
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: auc (null with one class), ties counted half.

    Scores are dealt into ranges between the smallest and the largest; a window ranks within each, and counts of the ranges below are added from
    a table of SCORE_RANGES rows. No task sees all rows.
    """
    low, high = df.agg(F.min(p), F.max(p)).first()
    width = ((high or 0.0) - (low or 0.0)) / SCORE_RANGES or 1.0
    scores = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("s")).agg(F.count_if(F.col(y) > 0).alias("pos"), F.count_if(~(F.col(y) > 0)).alias("neg"))
    scores = scores.withColumn("range", F.floor((F.col("s") - F.lit(low or 0.0)) / width).cast("int"))
    inside = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    each = scores.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    per_range = each.groupBy("range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"))
    under = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # SCORE_RANGES + 1 rows
    total = per_range.withColumn("under", F.coalesce(F.sum("neg").over(under), F.lit(0)))
    return total.agg((F.sum(F.col("wins") + F.col("pos") * F.col("under")) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def coverage(df: DataFrame, train_end: int, val_end: int) -> DataFrame:
    """Per split (train, validation, test by day): first_day, last_day, rows, and rows of each event family."""
    split = F.when(F.col("day_idx") <= train_end, "train").when(F.col("day_idx") <= val_end, "validation").otherwise("test")
    counts = [F.count_if(F.col("event_family") == f).alias(f.lower()) for f in EVENT_FAMILIES]
    return df.groupBy(split.alias("split")).agg(F.min("day_idx").alias("first_day"), F.max("day_idx").alias("last_day"), F.count(F.lit(1)).alias("rows"), *counts)


def uncovered(df: DataFrame, train_end: int, val_end: int) -> DataFrame:
    """(split, family) of families without a row in the split."""
    pairs = ", ".join(f"'{f}', {f.lower()}" for f in EVENT_FAMILIES)
    return coverage(df, train_end, val_end).selectExpr("split", f"stack({len(EVENT_FAMILIES)}, {pairs}) AS (family, n)").where("n = 0").select("split", "family")


def full_report(df: DataFrame, onsets: DataFrame | None = None) -> dict[str, DataFrame]:
    """All metrics of predictions (severity_pred, anomaly_prob) beside labels; onsets default to the slice's own."""
    d = df.withColumns({"alert_cascade_ml": F.col("severity_pred") >= 2, "__y": (F.col("severity_label") > 0).cast("int")})
    return {
        "standard": standard_metrics(d),
        "fn_cost": miss_cost(d),
        "alerts": alert_quality(d),
        "auc": auc(d, "__y", "anomaly_prob"),
        "ece": calibration_error(d, "__y", "anomaly_prob"),
        "detection": compare_detectors(d, ["cascade_ml"], onsets),
        "per_class": per_class(d),
    }
