"""The severity cascade: is a run anomalous, then how severe, with floors from detectors."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.boost import FIT_ROWS, Booster, Isotonic
from tidegauge.operators.labels import detector_floor
from tidegauge.schema import SEVERITIES

THRESHOLDS = np.arange(0.1, 0.91, 0.02)


@dataclass
class Stage1:
    """Anomaly or not: boosted trees, isotonic calibration and the threshold with the best F-beta on validation rows."""

    trees: int = 500
    beta: float = 0.5
    threshold: float = 0.5
    calibrator: Isotonic | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, x_val: np.ndarray, y_val: np.ndarray) -> Stage1:
        share = max(float(y.mean()), 1e-6)
        self.model = Booster(self.trees, 15.0 / self.trees if self.trees < 500 else 0.03, 63, 25, 0.25).fit(x, y, np.where(y == 1, min((1 - share) / share, 50.0), 1.0))
        if len(np.unique(y_val)) > 1:
            raw = self.model.predict(x_val)
            self.calibrator = Isotonic().fit(raw, y_val)
            p = self.calibrator.predict(raw)
            self.threshold = max(THRESHOLDS, key=lambda t: (self._f(p >= t, y_val), -t))
        return self

    def _f(self, fired: np.ndarray, y: np.ndarray) -> float:
        tp = float((fired & (y == 1)).sum())
        precision, recall = tp / (fired.sum() + 1e-9), tp / ((y == 1).sum() + 1e-9)
        return (1 + self.beta**2) * precision * recall / (self.beta**2 * precision + recall + 1e-9)

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = self.model.predict(x)
        return self.calibrator.predict(raw) if self.calibrator else raw


@dataclass
class Stage2:
    """How severe: a model of P(severity > k) for each k with both outcomes, a constant otherwise."""

    trees: int = 400
    models: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Stage2:
        self.models = []
        for k in range(len(SEVERITIES) - 1):
            above = (y > k).astype(int)
            share = float(above.mean()) if len(above) else 0.0
            if share in (0.0, 1.0):
                self.models.append(share)
            else:
                weight = np.where(above == 1, min((1 - share) / (share + 1e-9), 20.0), 1.0)
                self.models.append(Booster(self.trees, 16.0 / self.trees if self.trees < 400 else 0.04).fit(x, above, weight))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities: exceedances made non-increasing, then differences."""
        above = np.stack([np.full(len(x), m) if isinstance(m, float) else m.predict(x) for m in self.models], axis=1)
        above = np.minimum.accumulate(above, axis=1)
        p = np.clip(-np.diff(above, axis=1, prepend=1.0, append=0.0), 0, 1)
        return p / (p.sum(1, keepdims=True) + 1e-9)

    def importance(self, names: list[str]) -> dict[str, float]:
        parts = [m.gain / max(m.gain.sum(), 1e-300) for m in self.models if isinstance(m, Booster)]
        mean = np.mean(parts, axis=0) if parts else np.zeros(len(names))
        return dict(sorted(zip(names, mean.tolist(), strict=True), key=lambda kv: -kv[1]))


class Cascade:
    def __init__(self, features: list[str], trees: tuple[int, int] = (500, 400)):
        self.features, self.stage1, self.stage2, self.fitted = list(features), Stage1(trees[0]), Stage2(trees[1]), False

    def fit_rows(self, train: pd.DataFrame, val: pd.DataFrame) -> Cascade:
        x, y = train[self.features].to_numpy(float), train["severity_label"].to_numpy()
        x_val, y_val = val[self.features].to_numpy(float), val["severity_label"].to_numpy()
        self.stage1.fit(x, (y > 0).astype(int), x_val, (y_val > 0).astype(int))
        self.stage2.fit(x[y > 0], y[y > 0])
        self.fitted = True
        return self

    def predict(self, df: DataFrame, floors: bool = True) -> DataFrame:
        """df with anomaly_prob, anomaly_flag, severity_ml_only, severity_pred, severity_pred_name, floor_applied and p_<severity>."""
        if not self.fitted:
            raise RuntimeError("fit() comes first")
        shared = df.sparkSession.sparkContext.broadcast(self)
        schema = "anomaly_prob double, anomaly_flag int, severity_ml_only int, " + ", ".join(f"p_{s.lower()} double" for s in SEVERITIES)
        names = [f.split()[0] for f in schema.split(", ")]

        @F.pandas_udf(schema)
        def score(*cols: pd.Series) -> pd.DataFrame:
            m = shared.value
            x = np.stack([c.to_numpy(float) for c in cols], axis=1)
            p, q = m.stage1.predict(x), m.stage2.predict(x)
            flag = (p >= m.stage1.threshold).astype(int)
            return pd.DataFrame(dict(zip(names, (p, flag, np.where(flag == 0, 0, np.maximum(q.argmax(1), 1)), *q.T), strict=True)))

        out = df.withColumn("__m", score(*(F.col(c).cast("double") for c in self.features)))
        floor = detector_floor(df) if floors else F.lit(0)
        out = out.withColumns({n: F.col(f"__m.{n}") for n in names} | {"__floor": floor}).drop("__m")
        out = out.withColumns({"severity_pred": F.greatest("severity_ml_only", "__floor"), "floor_applied": F.col("__floor") > F.col("severity_ml_only")})
        return out.withColumn("severity_pred_name", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("severity_pred") + 1)).drop("__floor")


def fit_folds(df: DataFrame, features: list[str], trees: tuple[int, int]) -> dict[str, Cascade]:
    """A cascade per fold of df (fold, part in train/val, features, severity_label), each in a task of its own; beyond FIT_ROWS rows a fold is sampled by a hash."""
    sizes = {r.fold: r.n for r in df.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(n > FIT_ROWS for n in sizes.values()):
        share = F.create_map(*(F.lit(x) for f, n in sizes.items() for x in (f, n)))[F.col("fold")]
        df = df.where(F.pmod(F.xxhash64("fold", *features), share) < FIT_ROWS)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__key", *features], ignore_index=True)
        model = Cascade(features, trees).fit_rows(pdf[pdf.part == "train"], pdf[pdf.part == "val"])
        return pd.DataFrame({"fold": [pdf.fold.iloc[0]], "model": [pickle.dumps(model)]})

    cols = [F.col(c).cast("double").alias(c) for c in features]
    rows = df.select("fold", "part", "severity_label", F.xxhash64("table_name", "day_idx").alias("__key"), *cols)
    return {r.fold: pickle.loads(r.model) for r in rows.groupBy("fold").applyInPandas(fit, "fold string, model binary").collect()}
