"""Protocols: temporal split, and leaving one event family out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import evaluate
from tidegauge.operators.cascade import Cascade, fit_folds
from tidegauge.plans.feature_matrix import fill_medians
from tidegauge.schema import EVENT_FAMILIES

TRAIN_END, VAL_END = 125, 152
DETECTORS = ["cascade_ml", "hybrid", "rule_baseline", "ewma", "cusum", "state_machine"]


def temporal_split(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    day = F.col("day_idx")
    return df.where(day <= TRAIN_END), df.where((day > TRAIN_END) & (day <= VAL_END)), df.where(day > VAL_END)


def _parts(fold: str, train: DataFrame, val: DataFrame) -> DataFrame:
    return train.withColumns({"fold": F.lit(fold), "part": F.lit("train")}).unionByName(val.withColumns({"fold": F.lit(fold), "part": F.lit("val")}))


def temporal_protocol(df: DataFrame, cols: list[str], trees: tuple[int, int] = (500, 400)) -> tuple[Cascade, DataFrame, dict[str, DataFrame]]:
    """(model, test rows with predictions, report); medians are the training rows'."""
    train, val, test = fill_medians(cols, *temporal_split(df))
    model = fit_folds(_parts("temporal", train, val), cols, trees)["temporal"]
    scored = model.predict(test)
    return model, scored, evaluate.full_report(scored, evaluate.event_onsets(df))


def held_tables(df: DataFrame) -> dict[str, list[str]]:
    """Tables of each event family; a catalog of tables, so it is small."""
    rows = df.where(F.col("event_family").isin(*EVENT_FAMILIES)).groupBy("event_family").agg(F.array_sort(F.collect_set("table_name")).alias("t")).collect()
    return {r.event_family: list(r.t) for r in rows}


def cutoff(df: DataFrame, tables: list[str]) -> float:
    """Day before which 70 % of the other tables' rows are."""
    return df.where(~F.col("table_name").isin(tables)).agg(F.percentile("day_idx", 0.7)).first()[0]


def leave_one_family_out(df: DataFrame, cols: list[str], trees: tuple[int, int] = (500, 400)) -> DataFrame:
    """compare_detectors for each family on its own tables, with a model that saw neither; all folds are fitted at the same time."""
    folds, tests = [], {}
    for family, tables in sorted(held_tables(df).items()):
        rest, held = df.where(~F.col("table_name").isin(tables)), df.where(F.col("table_name").isin(tables))
        day = cutoff(df, tables)
        train, val, test = fill_medians(cols, rest.where(F.col("day_idx") <= day), rest.where(F.col("day_idx") > day), held)
        folds.append(_parts(family, train, val))
        tests[family] = (test, ",".join(tables))
    models = fit_folds(reduce(DataFrame.unionByName, folds), cols, trees)
    onsets, out = evaluate.event_onsets(df), []
    for family, (test, names) in tests.items():
        scored = evaluate.detector_alerts(models[family].predict(test))
        table = evaluate.compare_detectors(scored, DETECTORS, onsets).where(F.col("family") == family)
        out.append(table.withColumn("held_out_tables", F.lit(names)))
    return reduce(DataFrame.unionByName, out)


def family_by_detector(lofo: DataFrame) -> DataFrame:
    """Row recall as a table of families by detectors."""
    return lofo.groupBy("family").pivot("detector", DETECTORS).agg(F.first("row_recall"))
