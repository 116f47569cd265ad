"""The baseline and drift detectors as a stateful streaming operator.

Per table the state is constant in size: the reference rows until they are complete, then weekday offsets, level and scale, the EWMA, its run length
and both CUSUM sums. Rows of a table that come in one micro-batch are taken in day order; a day at or before the last one taken
is late and is dropped, since its place in the recurrences has passed. Results for reference rows are emitted when the reference is complete.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.operators.features import REFERENCE
from tidegauge.sources.scratch import scratch_folder

OUT = "table_name string, day_idx int, ds_z double, ewma_z double, ewma_run int, ewma_alert int, cusum_s_pos double, cusum_s_neg double, cusum_alert_up int, cusum_alert_dn int, cusum_drift_score double"


class Series:
    """One table's state."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, float]] = []
        self.last_day, self.last, self.ready = -1, 0.0, False
        self.ewma, self.run, self.up, self.down, self.seen = 0.0, 0, 0.0, 0.0, 0

    def take(self, day: int, weekday: int, latency: float | None) -> list[tuple]:
        if day <= self.last_day:
            return []
        self.last_day = day
        self.last = self.last if latency is None or np.isnan(latency) else float(latency)
        if self.ready:
            return [self._step(day, weekday, self.last)]
        self.rows.append((day, weekday, self.last))
        return self.settle() if len(self.rows) == REFERENCE else []

    def settle(self) -> list[tuple]:
        """Fix the reference from the rows so far and give their results."""
        frame = pd.DataFrame(self.rows, columns=["day", "weekday", "lat"])
        means = frame.groupby("weekday").lat.mean()
        self.level = float(means.mean())
        self.offsets = (means - self.level).to_dict()
        flat = frame.lat - frame.weekday.map(self.offsets)
        self.mu = float(flat.median())
        self.sd = max(1.4826 * float((flat - self.mu).abs().median()), 1e-6)
        self.ready, held, self.rows = True, self.rows, []
        return [self._step(*r) for r in held]

    def _step(self, day: int, weekday: int, latency: float) -> tuple:
        z = (latency - self.offsets.get(weekday, 0.0) - self.mu) / self.sd
        clipped, capped = min(4.0, max(-4.0, z)), min(3.0, max(-3.0, z))
        if self.seen:
            self.ewma = self.ewma * 9 / 11 + clipped * 2 / 11
            self.up, self.down = max(0.0, self.up + capped - 1), max(0.0, self.down - capped - 1)
        else:
            self.ewma = clipped
        self.seen += 1
        self.run = self.run + 1 if self.ewma > 3 else 0
        return (day, z, self.ewma, self.run, int(self.run >= 3), self.up, self.down, int(self.up > 5), int(self.down > 5), min(5.0, self.up / 5))


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    series = pickle.loads(state.get[0]) if state.exists else Series()
    rows = pd.concat(list(frames)).sort_values("day_idx", kind="stable")
    out = [r for d, w, x in zip(rows.day_idx, rows.day_of_week, rows.latency_minutes, strict=True) for r in series.take(int(d), int(w), x)]
    state.update((pickle.dumps(series),))
    if out:
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[c.split()[0] for c in OUT.split(", ")])


def detect(runs: DataFrame) -> DataFrame:
    """A streaming DataFrame of runs (table_name, day_idx, day_of_week, latency_minutes) to detector results."""
    rows = runs.select("table_name", "day_idx", "day_of_week", "latency_minutes")
    return rows.groupBy("table_name").applyInPandasWithState(_update, OUT, "series binary", "append", GroupStateTimeout.NoTimeout)


def replay(runs: DataFrame) -> DataFrame:
    """A batch of runs through the streaming query, to its end: written as files, read as a stream, results read back."""
    spark, folder = runs.sparkSession, scratch_folder(runs.sparkSession, "replay")
    slim = runs.select("table_name", "day_idx", "day_of_week", "latency_minutes")
    slim.write.parquet(f"{folder}/runs")
    stream = detect(spark.readStream.schema(slim.schema).parquet(f"{folder}/runs"))
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
