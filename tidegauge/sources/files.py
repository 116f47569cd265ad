"""Reading and writing run and feature tables: CSV and Parquet, and reports as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV folder with header or a Parquet table, by the path's ending; CSV needs its schema, so that nothing is inferred by a second pass."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.schema(schema).options(header=True, nullValue="", timestampNTZFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    if path.rstrip("/").endswith(".csv"):
        df.write.mode(mode).options(header=True, nullValue="", timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    else:
        df.write.mode(mode).parquet(path)


def load_or_build(spark: SparkSession, path: str, schema: T.StructType, build) -> DataFrame:
    """The table at path if there is one, else what build() gives, written there first."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        write_table(build(), path)
    return read_table(spark, path, schema)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report of at most `most` rows as a Markdown table."""
    lines = [df.columns, ["---"] * len(df.columns), *([str(v) for v in r] for r in df.limit(most).collect())]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)
