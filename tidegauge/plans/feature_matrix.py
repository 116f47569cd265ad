"""The feature matrix: F1-F8, rule, family and severity over runs and a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators import audit, features, graph, labels
from tidegauge.schema import NOT_FEATURES
from tidegauge.sources.scratch import materialise


def series_features(runs: DataFrame) -> DataFrame:
    """Everything that a table's own history gives. The baseline goes first: its exchange by table_name serves the windows by weekday too."""
    for step in (features.baseline, features.temporal, features.drift, features.rolling, features.volume, features.state):
        runs = step(runs)
    return runs


def build(runs: DataFrame, nodes: DataFrame, edges: DataFrame, with_stl: bool = False) -> DataFrame:
    """The matrix. A table's own features are written once, as both the rows and the troubled runs that are sent along the graph come from them."""
    out = materialise(series_features(runs), "series-features")
    if with_stl:
        out = audit.decompose(out)
    out = features.upstream(features.graph(out, graph.features(nodes, edges)), graph.closure(edges))
    return labels.severity(labels.family(labels.rule_severity(out)))


def numeric_features(df: DataFrame) -> list[str]:
    """Numeric columns that neither name the row nor leak the label."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES]


def select_features(df: DataFrame, share: float = 0.3) -> list[str]:
    """Numeric columns that a model may use: none that names the row or leaks the label, and non-null in more than `share` of the rows."""
    numeric = numeric_features(df)
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count(c).alias(c) for c in numeric)).first()
    return [c for c in numeric if counts[c] > share * counts["__n"]]


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact medians of all columns in one aggregation."""
    return df.agg(*(F.percentile(c, 0.5).alias(c) for c in cols)).first().asDict()


def fill_medians(cols: list[str], train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    found = {c: v for c, v in medians(train, cols).items() if v is not None}
    return [d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in found.items()}) for d in (train, *others)]
