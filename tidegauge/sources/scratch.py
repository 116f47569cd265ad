"""Scratch folders that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir, which goes when the driver's Python ends.

    Only on one machine (a local master) a temporary folder is set where that is unset, as in tests; elsewhere this raises RuntimeError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidegauge-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tidegauge-{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read back: what several branches of a plan need is computed once, and survives any executor."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder is the cluster's to clear
            return
