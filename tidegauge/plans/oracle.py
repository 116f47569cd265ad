"""DuckDB SQL for the registered queries, written from the definitions and not from the DataFrame code."""

from __future__ import annotations

from tidegauge.schema import CRITICALITY, STATES
from tidegauge.sources.catalog import EDGES, NAMES, TABLES
from tidegauge.sources.events import NAMES as T_NAMES

_T = dict(zip(NAMES, T_NAMES, strict=True))
_EDGES = ", ".join(f"('{_T[a]}', '{_T[b]}')" for a, b in EDGES)
_NODES = ", ".join(f"('{_T[t[0]]}', {CRITICALITY[t[4]]})" for t in TABLES)
_STATES = ", ".join(f"('{k}', {c}, '{s}', '{o}')" for k, (c, s, o) in STATES.items())
_TABLE = "PARTITION BY table_name ORDER BY day_idx"
_DAY = "PARTITION BY table_name, day_of_week ORDER BY day_idx"
_UPTO = f"({_TABLE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

_CTE = {
    "runs": """ev AS (SELECT event_id % 22 AS tno, event_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
        b AS (SELECT *, row_number() OVER (PARTITION BY tno ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY tno) AS n, isodow(ts) - 1 AS dow FROM ev),
        runs AS (SELECT 't' || lpad(CAST(tno AS VARCHAR), 2, '0') AS table_name, CAST(pos AS INTEGER) AS day_idx, CAST(dow AS INTEGER) AS day_of_week,
          CAST(dow >= 5 AS INTEGER) AS is_weekend, value AS latency_minutes,
          CASE WHEN event_type = 'error' AND k < 50 THEN 0 ELSE k * 10 END AS rows_read,
          CASE WHEN event_type IN ('error', 'view') AND k < 50 THEN 0 ELSE k * 10 END AS rows_written,
          CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RETRIED' ELSE 'SUCCESS' END AS execution_status,
          CASE WHEN tno = 5 AND dow >= 5 THEN 'EXPECTED_EMPTY' WHEN tno = 5 AND pos >= n // 3 THEN 'GRADUAL_DRIFT'
            WHEN event_type = 'error' AND k < 50 THEN 'INFRA_CASCADE' WHEN event_type = 'view' AND k < 50 THEN 'SILENT_BUSINESS_FAILURE'
            WHEN event_type = 'signup' THEN 'PHANTOM_RECOVERY' ELSE 'NONE' END AS failure_mode FROM b)""",
    "f1": f"""f1w AS (SELECT *, count(latency_minutes) OVER w AS n, avg(latency_minutes) OVER w AS m, stddev_samp(latency_minutes) OVER w AS s,
          quantile_cont(latency_minutes, 0.9) OVER w AS q, list(latency_minutes) OVER w AS past, lag(latency_minutes) OVER ({_DAY}) AS prev
          FROM runs WINDOW w AS ({_DAY} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)),
        f1 AS (SELECT table_name, day_idx, latency_minutes, CASE WHEN n >= 5 THEN m END AS hist_mean_21d, CASE WHEN n >= 5 THEN s END AS hist_std_21d, CASE WHEN n >= 5 THEN q END AS hist_p90_21d,
          CASE WHEN n >= 5 THEN (latency_minutes - m) / (CASE WHEN s = 0 THEN 1e-9 ELSE s END) END AS latency_zscore,
          CASE WHEN n = 21 THEN (len(list_filter(past, lambda x: x < prev)) + len(list_filter(past, lambda x: x <= prev)) + 1) * 0.5 / 21 END AS latency_pct_rank FROM f1w)""",
    "f2": f"""r AS (SELECT *, row_number() OVER ({_TABLE}) AS rn FROM runs),
        dm AS (SELECT table_name, day_of_week, avg(latency_minutes) AS m FROM r WHERE rn <= 28 GROUP BY ALL),
        am AS (SELECT table_name, avg(m) AS a FROM dm GROUP BY ALL),
        ds AS (SELECT r.*, latency_minutes - (coalesce(dm.m, am.a) - am.a) AS lat_ds FROM r JOIN am USING (table_name) LEFT JOIN dm USING (table_name, day_of_week)),
        mu AS (SELECT table_name, quantile_cont(lat_ds, 0.5) AS ref_mu FROM ds WHERE rn <= 28 GROUP BY ALL),
        sd AS (SELECT table_name, greatest(1.4826 * quantile_cont(abs(lat_ds - ref_mu), 0.5), 1e-6) AS ref_sd FROM ds JOIN mu USING (table_name) WHERE rn <= 28 GROUP BY ALL),
        f2 AS (SELECT ds.*, ref_mu, ref_sd, (lat_ds - ref_mu) / ref_sd AS ds_z FROM ds JOIN mu USING (table_name) JOIN sd USING (table_name))""",
    "f3": f"""e1 AS (SELECT *, list_reduce(list(greatest(-4.0, least(4.0, ds_z))) OVER ({_TABLE} ROWS BETWEEN 200 PRECEDING AND CURRENT ROW), lambda a, x: a * 9 / 11 + x * 2 / 11) AS ewma_z,
          sum(CASE WHEN rn > 1 THEN greatest(-3.0, least(3.0, ds_z)) - 1 ELSE 0 END) OVER {_UPTO} AS up,
          sum(CASE WHEN rn > 1 THEN -greatest(-3.0, least(3.0, ds_z)) - 1 ELSE 0 END) OVER {_UPTO} AS dn FROM f2),
        e2 AS (SELECT *, rn - coalesce(max(CASE WHEN ewma_z <= 3 THEN rn END) OVER {_UPTO}, 0) AS run, up - min(up) OVER {_UPTO} AS sp, dn - min(dn) OVER {_UPTO} AS sn FROM e1),
        f3 AS (SELECT *, CAST(run AS INTEGER) AS ewma_run, CAST(run >= 3 AS INTEGER) AS ewma_alert, sp AS cusum_s_pos, sn AS cusum_s_neg, CAST(sp > 5 AS INTEGER) AS cusum_alert_up,
          CAST(sn > 5 AS INTEGER) AS cusum_alert_dn, least(5.0, sp / 5) AS cusum_drift_score FROM e2)""",
    "f4": f"""fl AS (SELECT table_name, greatest(10, coalesce(CAST(trunc(quantile_cont(rows_written, 0.05)) AS BIGINT), 10)) AS fl FROM runs WHERE rows_written > 0 GROUP BY ALL),
        st(bits, diag_state_code, diag_state_label, diag_owner) AS (VALUES {_STATES}),
        ok AS (SELECT runs.*, CAST(execution_status IN ('SUCCESS', 'RETRIED') AS INTEGER) AS diag_exec_ok, CAST(rows_read >= coalesce(fl, 10) AS INTEGER) AS diag_read_ok,
          CAST(rows_written >= coalesce(fl, 10) AS INTEGER) AS diag_write_ok FROM runs LEFT JOIN fl USING (table_name)),
        f4 AS (SELECT ok.*, st.*, rows_written / greatest(1, rows_read) AS row_write_ratio, CAST(execution_status = 'RETRIED' AS INTEGER) AS was_retried
          FROM ok JOIN st ON bits = concat(diag_exec_ok, diag_read_ok, diag_write_ok))""",
    "f7": f"""v AS (SELECT *, count(rows_written) OVER w AS n, avg(rows_written) OVER w AS m, stddev_samp(rows_written) OVER w AS s FROM runs WINDOW w AS ({_TABLE} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
        f7 AS (SELECT table_name, day_idx, CASE WHEN n >= 3 THEN m END AS rows_roll7_mean, CASE WHEN n >= 3 THEN s END AS rows_roll7_std,
          CASE WHEN n >= 3 THEN (rows_written - m) / (CASE WHEN s = 0 THEN 1e-9 ELSE s END) END AS rows_zscore,
          CASE WHEN n >= 3 THEN greatest(0.0, (m - rows_written) / (CASE WHEN m = 0 THEN 1e-9 ELSE m END)) END AS rows_pct_drop FROM v)""",
    "g": f"""e(p, c) AS (VALUES {_EDGES}), nd(table_name, crit) AS (VALUES {_NODES}),
        reach(a, d) AS (SELECT p, c FROM e UNION SELECT a, c FROM reach JOIN e ON d = p)""",
    "g5": """pth(s, t, d) AS (SELECT p, c, 1 FROM e UNION ALL SELECT s, c, d + 1 FROM pth JOIN e ON t = p),
        sh AS (SELECT s, t, min(d) AS d FROM pth GROUP BY ALL), sg AS (SELECT s, t, d, count(*) AS k FROM pth JOIN sh USING (s, t, d) GROUP BY ALL),
        bw AS (SELECT x.t AS v, sum(x.k * z.k / st.k) / 420 AS c FROM sg x JOIN sg z ON x.t = z.s JOIN sg st ON st.s = x.s AND st.t = z.t AND st.d = x.d + z.d GROUP BY ALL)""",
    "lab": """onset AS (SELECT table_name, min(day_idx) AS o FROM runs WHERE failure_mode = 'GRADUAL_DRIFT' GROUP BY ALL),
        fam AS (SELECT runs.*, o, CASE WHEN failure_mode = 'EXPECTED_EMPTY' AND day_idx >= o THEN 'GRADUAL_DRIFT' ELSE failure_mode END AS event_family FROM runs LEFT JOIN onset USING (table_name)),
        base AS (SELECT fam.*, crit, CASE event_family WHEN 'INFRA_CASCADE' THEN 4 WHEN 'SILENT_BUSINESS_FAILURE' THEN 3 WHEN 'PHANTOM_RECOVERY' THEN 2
          WHEN 'GRADUAL_DRIFT' THEN CASE WHEN day_idx - o < 7 THEN 1 WHEN day_idx - o < 21 THEN 2 WHEN day_idx - o < 45 THEN 3 ELSE 4 END ELSE 0 END AS base FROM fam JOIN nd USING (table_name)),
        lab AS (SELECT *, CAST(CASE WHEN base = 0 THEN 0 ELSE least(4, greatest(1, base + CASE crit WHEN 1 THEN -1 WHEN 4 THEN 1 ELSE 0 END)) END AS INTEGER) AS severity_label FROM base)""",
    "all": """bl AS (SELECT a AS table_name, count(*) AS blast FROM reach GROUP BY ALL),
        x AS (SELECT lab.*, latency_zscore, cusum_drift_score, cusum_alert_up, ewma_alert, ewma_z, ds_z, rows_zscore, diag_state_code, was_retried, coalesce(blast, 0) AS blast,
          CAST(CASE WHEN diag_state_code IN (4, 5, 6) OR cusum_drift_score > 4 THEN 4 WHEN cusum_drift_score > 2.5 OR latency_zscore > 3 OR diag_state_code = 1 THEN 3
            WHEN cusum_drift_score > 1.5 OR latency_zscore > 2 OR rows_zscore < -2.5 THEN 2 WHEN cusum_drift_score > 0.5 OR latency_zscore > 1 THEN 1 ELSE 0 END AS INTEGER) AS rule_severity
          FROM lab JOIN (SELECT * EXCLUDE (latency_minutes) FROM f1) USING (table_name, day_idx) JOIN (SELECT table_name, day_idx, cusum_drift_score, cusum_alert_up, ewma_alert, ewma_z, ds_z FROM f3) USING (table_name, day_idx)
          JOIN f7 USING (table_name, day_idx) JOIN (SELECT table_name, day_idx, diag_state_code, was_retried FROM f4) USING (table_name, day_idx) LEFT JOIN bl USING (table_name)),
        z AS (SELECT *, rule_severity >= 2 AS alert_rule_baseline, ewma_alert > 0 AS alert_ewma, cusum_alert_up > 0 AS alert_cusum, diag_state_code IN (1, 4, 5, 6) AS alert_state_machine,
          round(1 / (1 + exp(-coalesce(latency_zscore, 0))), 6) AS p, CAST(severity_label > 0 AS INTEGER) AS y FROM x)""",
    "cm": """cm AS (SELECT t AS "true", q AS pred, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(5)) AS INTEGER) AS t) JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS q) ON true
          LEFT JOIN (SELECT severity_label AS t, rule_severity AS q, count(*) AS n FROM z GROUP BY ALL) USING (t, q)),
        pc AS (SELECT k, support, fired, hit, CASE WHEN fired > 0 THEN hit / fired ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS rc FROM
          (SELECT "true" AS k, CAST(sum(n) AS BIGINT) AS support, sum(CASE WHEN pred = "true" THEN n ELSE 0 END) AS hit FROM cm GROUP BY ALL) JOIN (SELECT pred AS k, sum(n) AS fired FROM cm GROUP BY ALL) USING (k) WHERE support + fired > 0),
        pf AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM pc)""",
}
_FULL = ("runs", "f1", "f2", "f3", "f4", "f7", "g", "lab", "all")


def _sql(parts: tuple[str, ...] | str, select: str) -> str:
    parts = parts.split() if isinstance(parts, str) else parts
    return f"WITH {'RECURSIVE ' if 'g' in parts else ''}{', '.join(_CTE[p] for p in parts)} {select}"


def _rounded(source: str, doubles: str, others: str = "", keys: str = "table_name, day_idx") -> str:
    cols = [keys, *(f"round({c}, 6) AS {c}" for c in doubles.split()), *others.split()]
    return f"SELECT {', '.join(cols)} FROM {source}"


def _compare(rows: str) -> str:
    return f"""long AS (SELECT event_family, table_name, day_idx, detector, alert FROM (SELECT * FROM z {rows}) UNPIVOT (alert FOR detector IN (alert_rule_baseline AS 'rule_baseline', alert_ewma AS 'ewma', alert_cusum AS 'cusum', alert_state_machine AS 'state_machine'))),
        ons AS (SELECT event_family, table_name, min(day_idx) AS onset FROM z GROUP BY ALL),
        fp AS (SELECT detector, round(100 * avg(CAST(alert AS INTEGER)), 2) AS false_alarms_per_100_normal FROM long WHERE event_family IN ('NONE', 'EXPECTED_EMPTY') GROUP BY ALL),
        g1 AS (SELECT detector, event_family, table_name, count(*) AS n, count(*) FILTER (alert) AS hits, min(day_idx) FILTER (alert) AS hit FROM long WHERE event_family NOT IN ('NONE', 'EXPECTED_EMPTY') GROUP BY ALL),
        cmp AS (SELECT detector, event_family AS family, CAST(sum(n) AS BIGINT) AS rows, round(sum(hits) / sum(n), 3) AS row_recall, concat(count(*) FILTER (hits > 0), '/', count(*)) AS events_detected,
          quantile_cont(CASE WHEN onset >= (SELECT min(day_idx) FROM long) THEN hit - onset END, 0.5) AS median_lag_days, any_value(false_alarms_per_100_normal) AS false_alarms_per_100_normal
          FROM g1 JOIN ons USING (event_family, table_name) LEFT JOIN fp USING (detector) GROUP BY ALL)"""


_COMPARE = f"WITH RECURSIVE {', '.join(_CTE[p] for p in _FULL)}, {_compare('')} "
_COVER = """SELECT CASE WHEN day_idx <= 125 THEN 'train' WHEN day_idx <= 152 THEN 'validation' ELSE 'test' END AS split, min(day_idx) AS first_day, max(day_idx) AS last_day, count(*) AS rows,
    count(*) FILTER (event_family = 'INFRA_CASCADE') AS infra_cascade, count(*) FILTER (event_family = 'SILENT_BUSINESS_FAILURE') AS silent_business_failure,
    count(*) FILTER (event_family = 'GRADUAL_DRIFT') AS gradual_drift, count(*) FILTER (event_family = 'PHANTOM_RECOVERY') AS phantom_recovery FROM lab GROUP BY 1"""
_F6 = f"""l AS (SELECT *, count(latency_minutes) OVER w AS n, avg(latency_minutes) OVER w AS m, stddev_samp(latency_minutes) OVER w AS s, quantile_cont(latency_minutes, 0.75) OVER w - quantile_cont(latency_minutes, 0.25) OVER w AS i,
      kurtosis_pop(latency_minutes) OVER w AS k, lag(latency_minutes) OVER ({_TABLE}) AS l1, lag(latency_minutes, 2) OVER ({_TABLE}) AS l2 FROM runs WINDOW w AS ({_TABLE} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    f6 AS (SELECT table_name, day_idx, CASE WHEN n >= 3 THEN m END AS roll7_mean, CASE WHEN n >= 3 THEN s END AS roll7_std, CASE WHEN n = 7 THEN i END AS roll7_iqr, CASE WHEN n = 7 THEN k END AS roll7_kurtosis,
      latency_minutes - l1 AS latency_velocity, latency_minutes - 2 * l1 + l2 AS latency_acceleration FROM l)"""
_ENTROPY = f"""q AS (SELECT *, count(latency_minutes) OVER w AS n, list_filter(list(latency_minutes) OVER w, lambda x: x > 0) AS v FROM runs WINDOW w AS ({_TABLE} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
    h AS (SELECT *, least(10, len(v) // 2 + 1) AS nb, CASE WHEN list_min(v) = list_max(v) THEN list_min(v) - 0.5 ELSE list_min(v) END AS lo, CASE WHEN list_min(v) = list_max(v) THEN list_max(v) + 0.5 ELSE list_max(v) END AS hi FROM q),
    u AS (SELECT table_name, day_idx, nb, lo, hi, len(v) AS c, unnest(v) AS x FROM h WHERE n >= 7 AND len(v) >= 3),
    bins AS (SELECT table_name, day_idx, least(nb - 1, CAST(floor((x - lo) / (hi - lo) * nb) AS INTEGER)) AS bin, count(*) / (any_value(c) * (any_value(hi) - any_value(lo)) / any_value(nb)) AS d FROM u GROUP BY ALL),
    ent AS (SELECT table_name, day_idx, -sum(d * ln(d + 1e-9)) AS e FROM bins GROUP BY ALL)"""

ORACLE_SQL = {
    "src_runs": _sql("runs", _rounded("runs", "latency_minutes", "day_of_week is_weekend rows_read rows_written execution_status failure_mode")),
    "src_run_counts": _sql("runs", "SELECT failure_mode, count(*) AS n, count(DISTINCT table_name) AS tables FROM runs GROUP BY ALL"),
    "f1_history": _sql("runs f1", _rounded("f1", "hist_mean_21d hist_std_21d hist_p90_21d")),
    "f1_zscore": _sql("runs f1", _rounded("f1", "latency_zscore")),
    "f1_outliers": _sql("runs f1", _rounded("f1", "latency_minutes hist_mean_21d hist_std_21d latency_zscore") + " WHERE f1.latency_zscore > 3"),
    "f1_pct_rank": _sql("runs f1", _rounded("f1", "latency_pct_rank")),
    "f2_baseline": _sql("runs f2", _rounded("f2", "lat_ds ds_z ref_mu ref_sd").replace(", 6)", ", 8)")),
    "f3_ewma": _sql("runs f2 f3", _rounded("f3", "ewma_z", "ewma_run ewma_alert")),
    "f3_cusum": _sql("runs f2 f3", _rounded("f3", "cusum_s_pos cusum_s_neg cusum_drift_score", "cusum_alert_up cusum_alert_dn")),
    "f4_state": _sql("runs f4", _rounded("f4", "row_write_ratio", "diag_state_code diag_state_label diag_owner diag_exec_ok diag_read_ok diag_write_ok was_retried")),
    "f4_owner_counts": _sql("runs f4", "SELECT diag_owner, diag_state_label, count(*) AS n FROM f4 GROUP BY ALL"),
    "f5_closure": _sql("g", "SELECT a AS ancestor, d AS table_name FROM reach"),
    "f5_graph": f"WITH RECURSIVE {_CTE['g']}, {_CTE['g5']}" + """ SELECT table_name, round(coalesce(bw.c, 0), 6) AS dag_centrality, CAST((SELECT count(*) FROM e WHERE e.c = table_name) AS INTEGER) AS dag_in_degree,
        CAST((SELECT count(*) FROM e WHERE e.p = table_name) AS INTEGER) AS dag_out_degree, CAST(coalesce((SELECT max(d) FROM pth WHERE t = table_name), 0) AS INTEGER) AS dag_depth,
        CAST((SELECT count(*) FROM reach WHERE a = table_name) AS INTEGER) AS dag_blast_radius, CAST((SELECT count(*) FROM reach r WHERE r.d = table_name) AS INTEGER) AS dag_ancestry_count, crit AS dag_criticality FROM nd LEFT JOIN bw ON v = table_name""",
    "f6_rolling": f"WITH {_CTE['runs']}, {_F6} " + _rounded("f6", "roll7_mean roll7_std roll7_iqr roll7_kurtosis latency_velocity latency_acceleration"),
    "f6_entropy": f"WITH {_CTE['runs']}, {_ENTROPY} SELECT table_name, day_idx, round(CASE WHEN n >= 7 THEN CASE WHEN len(v) < 3 THEN 0 ELSE e END END, 6) AS roll7_entropy FROM h LEFT JOIN ent USING (table_name, day_idx)",
    "f7_volume": _sql("runs f7", _rounded("f7", "rows_roll7_mean rows_roll7_std rows_zscore rows_pct_drop")),
    "f8_upstream": _sql("runs f2 f3 f4 g", """SELECT t.table_name, t.day_idx, CAST(count(*) FILTER (o.diag_state_code IN (4, 5, 6)) AS INTEGER) AS upstream_failed_count, CAST(count(*) FILTER (w.ewma_alert = 1) AS INTEGER) AS upstream_alert_count
        FROM runs t LEFT JOIN reach ON reach.d = t.table_name LEFT JOIN f4 o ON o.table_name = reach.a AND o.day_idx = t.day_idx LEFT JOIN f3 w ON w.table_name = reach.a AND w.day_idx = t.day_idx GROUP BY ALL"""),
    "lbl_rule_severity": _sql(_FULL, "SELECT table_name, day_idx, rule_severity FROM z"),
    "lbl_family": _sql("runs g lab", "SELECT table_name, day_idx, event_family FROM lab"),
    "lbl_severity": _sql("runs g lab", "SELECT table_name, day_idx, severity_label, (['NORMAL', 'WATCH', 'WARN', 'DEGRADED', 'CRITICAL'])[severity_label + 1] AS severity_name FROM lab"),
    "det_floor": _sql(_FULL, "SELECT table_name, day_idx, CAST(greatest(CASE WHEN diag_state_code IN (1, 4, 5, 6) THEN 3 ELSE 0 END, CASE WHEN ewma_alert > 0 OR (was_retried > 0 AND latency_zscore > 3) THEN 2 ELSE 0 END) AS INTEGER) AS floor FROM z"),
    "det_alerts": _sql(_FULL, "SELECT table_name, day_idx, alert_rule_baseline, alert_ewma, alert_cusum, alert_state_machine FROM z"),
    "eval_onsets": _sql("runs g lab", "SELECT event_family, table_name, min(day_idx) AS onset FROM lab WHERE event_family NOT IN ('NONE', 'EXPECTED_EMPTY') GROUP BY ALL"),
    "eval_compare": _COMPARE + "SELECT * FROM cmp",
    "eval_compare_slice": f"WITH RECURSIVE {', '.join(_CTE[p] for p in _FULL)}, {_compare('WHERE day_idx > 152')} SELECT * FROM cmp",
    "eval_recall_pivot": _COMPARE + "SELECT family, " + ", ".join(f"max(row_recall) FILTER (detector = '{d}') AS {d}" for d in ("rule_baseline", "ewma", "cusum", "state_machine")) + " FROM cmp GROUP BY ALL",
    "eval_false_alarms": _COMPARE + "SELECT detector, avg(false_alarms_per_100_normal) AS false_alarms FROM cmp GROUP BY ALL",
    "eval_confusion": _sql((*_FULL, "cm"), 'SELECT "true", pred, n FROM cm'),
    "eval_per_class": _sql((*_FULL, "cm"), "SELECT (['NORMAL', 'WATCH', 'WARN', 'DEGRADED', 'CRITICAL'])[k + 1] AS severity, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, support FROM pf"),
    "eval_standard": _sql((*_FULL, "cm"), """SELECT (SELECT round(avg(CAST(severity_label = rule_severity AS INTEGER)), 4) FROM z) AS accuracy, (SELECT round(avg(abs(severity_label - rule_severity)), 4) FROM z) AS ordinal_mae,
        round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM pf"""),
    "eval_miss_cost": _sql(_FULL, """SELECT count(*) FILTER (m) AS false_negatives, round(coalesce(sum(w) FILTER (m), 0), 2) AS raw_fn_cost, round(coalesce(sum(w) FILTER (m), 0) / (coalesce(sum(w) FILTER (severity_label > 0), 0) + 1e-9), 4) AS normalised_fn_cost
        FROM (SELECT *, severity_label > 0 AND rule_severity = 0 AS m, (2 ** (crit - 1)) * ln(1 + greatest(blast, 1)) AS w FROM z)"""),
    "eval_alert_quality": _sql(_FULL, """SELECT count(*) FILTER (rule_severity >= 2) AS alerts_fired, round(count(*) FILTER (rule_severity >= 2 AND severity_label >= 2) / greatest(1, count(*) FILTER (rule_severity >= 2)), 4) AS alert_precision,
        round(count(*) FILTER (rule_severity >= 2 AND severity_label >= 2) / greatest(1, count(*) FILTER (severity_label >= 2)), 4) AS alert_recall,
        round(100 * avg(CAST(rule_severity >= 2 AS INTEGER)) FILTER (event_family IN ('NONE', 'EXPECTED_EMPTY')), 2) AS false_alarms_per_100_normal FROM z"""),
    "eval_ece": _sql(_FULL, "SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM (SELECT len(list_filter(list_transform(range(1, 10), lambda i: i * 0.1::DOUBLE), lambda e: e <= p)) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM z GROUP BY bin)"),
    "eval_auc": _sql(_FULL, "SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM z)"),
    "eval_coverage": _sql("runs g lab", _COVER),
    "eval_uncovered": _sql("runs g lab", f"SELECT split, upper(family) AS family FROM (UNPIVOT (SELECT * EXCLUDE (first_day, last_day, rows) FROM ({_COVER})) ON COLUMNS(* EXCLUDE split) INTO NAME family VALUE n) WHERE n = 0"),
    "eval_lofo_cutoff": _sql("runs g lab", """, q AS (SELECT * FROM lab), h AS (SELECT event_family AS family, list_sort(list(DISTINCT table_name)) AS t FROM q WHERE event_family NOT IN ('NONE', 'EXPECTED_EMPTY') GROUP BY ALL)
        SELECT family, array_to_string(t, ',') AS held_out_tables, quantile_cont(day_idx, 0.7) AS cutoff FROM h JOIN q ON NOT list_contains(t, table_name) GROUP BY ALL"""),
    "stream_detectors": _sql("runs f2 f3", _rounded("f3", "ds_z ewma_z cusum_s_pos cusum_s_neg", "ewma_run") + " WHERE table_name IN (SELECT table_name FROM runs GROUP BY table_name HAVING count(*) >= 28)"),
    "audit_trend_drift": f"WITH {_CTE['runs']}, {_F6}" + f""", a AS (SELECT table_name, day_idx, coalesce(roll7_mean, latency_minutes) AS tr, latency_minutes - coalesce(roll7_mean, latency_minutes) AS rs, row_number() OVER ({_TABLE}) AS rn FROM f6 JOIN runs USING (table_name, day_idx)),
        rf AS (SELECT table_name, avg(tr) AS lv, stddev_samp(rs) AS sd FROM a WHERE rn <= 45 GROUP BY ALL), zz AS (SELECT a.*, (tr - lv) / (CASE WHEN sd > 0 THEN sd ELSE 1e-9 END) AS z FROM a JOIN rf USING (table_name)),
        hh AS (SELECT *, sum(CAST(z > 5 AS INTEGER)) OVER ({_TABLE} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) >= 3 AND count(*) OVER (PARTITION BY table_name) >= 48 AS hit FROM zz)
        SELECT table_name, CASE WHEN count(*) >= 48 THEN count(*) FILTER (hit) > 0 END AS drift_detected, min(day_idx) FILTER (hit) AS first_alert_day, CASE WHEN count(*) >= 48 THEN round(max(z), 2) END AS peak_trend_z FROM hh GROUP BY table_name""",
}

#: The matrix is its families' queries side by side; its numeric features.
_FAMILIES = ("src_runs", "f2_baseline", "f1_history", "f1_zscore", "f1_pct_rank", "f3_ewma", "f3_cusum", "f6_rolling", "f6_entropy", "f7_volume", "f4_state", "f8_upstream", "lbl_rule_severity", "lbl_family", "lbl_severity")
_MATRIX = "SELECT * FROM " + " JOIN ".join(f"({ORACLE_SQL[q]}) {q}" + " USING (table_name, day_idx)" * (i > 0) for i, q in enumerate(_FAMILIES)) + f" JOIN ({ORACLE_SQL['f5_graph']}) f5_graph USING (table_name)"
_FEATURES = (
    "day_of_week", "is_weekend", "hist_mean_21d", "hist_std_21d", "hist_p90_21d", "latency_zscore", "latency_pct_rank", "lat_ds", "ref_mu", "ref_sd", "ds_z", "ewma_z", "ewma_run", "ewma_alert", "cusum_s_pos", "cusum_s_neg",
    "cusum_alert_up", "cusum_alert_dn", "cusum_drift_score", "diag_state_code", "diag_exec_ok", "diag_read_ok", "diag_write_ok", "row_write_ratio", "was_retried", "dag_criticality", "dag_centrality", "dag_in_degree", "dag_out_degree",
    "dag_depth", "dag_blast_radius", "dag_ancestry_count", "roll7_mean", "roll7_std", "roll7_iqr", "roll7_kurtosis", "roll7_entropy", "latency_velocity", "latency_acceleration", "rows_roll7_mean", "rows_roll7_std", "rows_zscore",
    "rows_pct_drop", "upstream_failed_count", "upstream_alert_count",
)
_EACH = lambda agg: f"unnest([{', '.join(agg.format(c) for c in _FEATURES)}])"
_COUNTS = f"SELECT {_EACH(chr(39) + '{}' + chr(39))} AS feature, {_EACH('count({})')} AS n, count(*) AS total, {_EACH('CAST(quantile_cont({}, 0.5) FILTER (day_idx <= 125) AS DOUBLE)')} AS median FROM ({_MATRIX})"
ORACLE_SQL |= {
    "feat_matrix": _MATRIX,
    "feat_null_profile": f"SELECT feature, n, round(n / total, 6) AS share FROM ({_COUNTS})",
    "feat_selection": f"SELECT feature FROM ({_COUNTS}) WHERE n > 0.3 * total",
    "feat_medians": f"SELECT feature, round(median, 4) AS median FROM ({_COUNTS}) WHERE n > 0.3 * total",
}
