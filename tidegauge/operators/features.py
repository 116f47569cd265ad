"""Feature families F1-F8 over runs: each function takes and returns a DataFrame, so that they chain with transform().

All windows partition by table_name or by (table_name, day_of_week), so the whole chain needs one exchange by table_name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import windows as w
from tidegauge.schema import CRITICALITY, STATES

#: Rows of the reference window.
REFERENCE = 28


def temporal(df: DataFrame) -> DataFrame:
    """history of the same weekday."""
    lat = F.col("latency_minutes")
    past = lambda agg, least=5: w.earlier(agg, lat, 21, least, w.by_weekday())
    df = df.withColumns({
        "hist_mean_21d": past(F.avg),
        "hist_std_21d": past(F.stddev_samp),
        "hist_p90_21d": past(lambda c: F.percentile(c, 0.9)),
        "__past": F.when(F.count(lat).over(w.by_weekday().rowsBetween(-21, -1)) == 21, w.earlier_values(lat, 21, w.by_weekday())),
    })
    last = F.element_at("__past", 21)
    below = F.size(F.filter("__past", lambda x: x < last))
    up_to = F.size(F.filter("__past", lambda x: x <= last))
    return df.withColumns({
        "latency_zscore": w.safe_divide(lat - F.col("hist_mean_21d"), F.col("hist_std_21d")),
        "latency_pct_rank": F.when(F.col("__past").isNotNull(), (below + up_to + 1) * 0.5 / 21),
    }).drop("__past")


def baseline(df: DataFrame, reference: int = REFERENCE) -> DataFrame:
    """weekday offsets, level and scale from the first `reference` rows of each table; later rows change nothing earlier."""
    df = df.withColumns({"__rn": F.row_number().over(w.by_table()), "__lat": w.carried_forward("latency_minutes")})
    ref = F.col("__rn") <= reference
    per_day = Window.partitionBy("table_name", "day_of_week")
    df = df.withColumns({"__day": F.avg(F.when(ref, F.col("__lat"))).over(per_day), "__first": F.row_number().over(w.by_weekday()) == 1})
    df = df.withColumn("__all", F.avg(F.when(F.col("__first"), F.col("__day"))).over(w.whole_table()))
    df = df.withColumn("lat_ds", F.col("__lat") - (F.coalesce("__day", "__all") - F.col("__all")))
    median = lambda c: F.percentile(F.when(ref, c), 0.5).over(w.whole_table())
    df = df.withColumn("ref_mu", median(F.col("lat_ds")))
    df = df.withColumn("ref_sd", F.greatest(1.4826 * median(F.abs(F.col("lat_ds") - F.col("ref_mu"))), F.lit(1e-6)))
    return df.withColumn("ds_z", (F.col("lat_ds") - F.col("ref_mu")) / F.col("ref_sd")).drop("__rn", "__lat", "__day", "__first", "__all")


def drift(df: DataFrame, span: int = 10, limit: float = 3.0, run: int = 3, k: float = 1.0, h: float = 5.0, most: float = 3.0) -> DataFrame:
    """EWMA chart and two-sided CUSUM of ds_z."""
    z = F.col("ds_z")
    upto = w.by_table().rowsBetween(Window.unboundedPreceding, 0)
    zc = w.clip(z, -most, most)
    df = w.exponential_mean(df, w.clip(z, -4.0, 4.0), 2.0 / (span + 1), "ewma_z").withColumn("__rn", F.row_number().over(w.by_table()))
    step = lambda sign: F.when(F.col("__rn") > 1, sign * zc - k).otherwise(0.0)
    df = df.withColumns({
        "__up": w.reflected_sum(step(1)),
        "__down": w.reflected_sum(step(-1)),
    })
    df = df.withColumns({
        "ewma_run": w.run_length(w.holds(F.col("ewma_z") > limit), F.col("__rn")).cast("int"),
        "cusum_s_pos": F.col("__up") - F.min("__up").over(upto),
        "cusum_s_neg": F.col("__down") - F.min("__down").over(upto),
    })
    return df.withColumns({
        "ewma_alert": (F.col("ewma_run") >= run).cast("int"),
        "cusum_alert_up": (F.col("cusum_s_pos") > h).cast("int"),
        "cusum_alert_dn": (F.col("cusum_s_neg") > h).cast("int"),
        "cusum_drift_score": w.clip(F.col("cusum_s_pos") / h, 0.0, 5.0),
    }).drop("__rn", "__up", "__down")


def state_of(execution_status: Column, rows_read: Column, rows_written: Column, read_floor: Column | int = 10, write_floor: Column | int = 10) -> dict[str, Column]:
    """The six state columns of a run by three checks: it ended well, it read enough, it wrote enough."""
    ok = execution_status.isin("SUCCESS", "RETRIED"), rows_read >= read_floor, rows_written >= write_floor
    bits = [w.holds(c).cast("int") for c in ok]
    key = F.concat(*(b.cast("string") for b in bits))
    pick = lambda i: F.create_map(*(F.lit(x) for s, v in STATES.items() for x in (s, v[i])))[key]
    return {"diag_state_code": pick(0), "diag_state_label": pick(1), "diag_owner": pick(2), "diag_exec_ok": bits[0], "diag_read_ok": bits[1], "diag_write_ok": bits[2]}


def state(df: DataFrame) -> DataFrame:
    """state machine with each table's floor, the 5th percentile of what its runs wrote, at least 10."""
    written = F.col("rows_written")
    floor = F.greatest(F.lit(10), F.coalesce(F.percentile(F.when(written > 0, written), 0.05).over(w.whole_table()), F.lit(10.0)).cast("bigint"))
    df = df.withColumn("__floor", floor)
    cols = state_of(F.col("execution_status"), F.col("rows_read"), written, F.col("__floor"), F.col("__floor"))
    return df.withColumns(cols | {
        "row_write_ratio": written / F.greatest(F.lit(1), F.col("rows_read")),
        "was_retried": w.holds(F.col("execution_status") == "RETRIED").cast("int"),
    }).drop("__floor")


def graph(df: DataFrame, graph_features: DataFrame) -> DataFrame:
    """the table's place in the graph, 0 (criticality 1) for tables outside it. The graph is a catalog of tables: Catalyst broadcasts it by its size."""
    found = df.join(graph_features, "table_name", "left")
    zero = {c: F.coalesce(c, F.lit(1 if c == "dag_criticality" else 0)) for c in graph_features.columns if c.startswith("dag_")}
    return found.withColumns(zero)


def rolling(df: DataFrame) -> DataFrame:
    """the shape of the last 7 and 14 latencies."""
    lat = F.col("latency_minutes")
    quartile = lambda q: w.earlier(lambda c: F.percentile(c, q), lat, 7, 7)
    df = df.withColumns({
        "roll7_mean": w.earlier(F.avg, lat, 7, 3),
        "roll7_std": w.earlier(F.stddev_samp, lat, 7, 3),
        "roll7_iqr": quartile(0.75) - quartile(0.25),
        "roll7_kurtosis": w.earlier(F.kurtosis, lat, 7, 7),
        "__bag": F.when(F.count(lat).over(w.by_table().rowsBetween(-14, -1)) >= 7, F.filter(w.earlier_values(lat, 14), lambda x: x > 0)),
        "latency_velocity": lat - F.lag(lat).over(w.by_table()),
        "latency_acceleration": lat - 2 * F.lag(lat).over(w.by_table()) + F.lag(lat, 2).over(w.by_table()),
    })
    return histogram_entropy(df, "__bag", "roll7_entropy").drop("__bag")


def histogram_entropy(df: DataFrame, values: str, out: str) -> DataFrame:
    """-sum(d ln(d + 1e-9)) over the densities of an equal-width histogram with min(10, n/2+1) bins; 0 below 3 values, null for null."""
    v = F.col(values)
    flat = F.array_min(v) == F.array_max(v)
    wide = F.when(flat, 0.5).otherwise(0.0)
    df = df.withColumns({
        "__bins": F.least(F.lit(10), F.floor(F.size(v) / 2).cast("int") + 1),
        "__low": F.array_min(v) - wide,
        "__span": F.array_max(v) - F.array_min(v) + 2 * wide,
    })
    bins, low, span = F.col("__bins"), F.col("__low"), F.col("__span")
    which = lambda x: F.least(bins - 1, F.floor((x - low) / span * bins).cast("int"))
    density = F.transform(F.sequence(F.lit(0), bins - 1), lambda b: F.size(F.filter(v, lambda x: which(x) == b)) / (F.size(v) * span / bins))
    entropy = F.aggregate(F.filter(density, lambda d: d > 0), F.lit(0.0), lambda acc, d: acc - d * F.log(d + 1e-9))
    return df.withColumn(out, F.when(v.isNotNull(), F.when(F.size(v) < 3, 0.0).otherwise(entropy))).drop("__bins", "__low", "__span")


def volume(df: DataFrame) -> DataFrame:
    """rows written against the last 7 runs."""
    rows = F.col("rows_written").cast("double")
    df = df.withColumns({"rows_roll7_mean": w.earlier(F.avg, rows, 7, 3), "rows_roll7_std": w.earlier(F.stddev_samp, rows, 7, 3)})
    mean = F.col("rows_roll7_mean")
    return df.withColumns({"rows_zscore": w.safe_divide(rows - mean, F.col("rows_roll7_std")), "rows_pct_drop": w.clip(w.safe_divide(mean - rows, mean), low=0.0)})


def upstream(df: DataFrame, closure: DataFrame) -> DataFrame:
    """F8: how many ancestors failed or alerted on the same day; closure is (ancestor, table_name).

    Only troubled runs are sent along the closure, and their counts come back one row per table and day; both joins are by equal keys.
    """
    failed = F.col("diag_state_code").isin(4, 5, 6)
    alert = F.col("ewma_alert") == 1
    bad = df.where(failed | alert).groupBy(F.col("table_name").alias("ancestor"), "day_idx").agg(F.max(failed.cast("int")).alias("f"), F.max(alert.cast("int")).alias("a"))
    counts = closure.join(bad, "ancestor").groupBy("table_name", "day_idx").agg(F.sum("f").cast("int").alias("upstream_failed_count"), F.sum("a").cast("int").alias("upstream_alert_count"))
    return df.join(counts, ["table_name", "day_idx"], "left").fillna(0, ["upstream_failed_count", "upstream_alert_count"])


def criticality_rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in CRITICALITY.items() for x in kv))[c], F.lit(1))
