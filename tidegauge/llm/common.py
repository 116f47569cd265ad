"""What the operators share: shared scratch tables, folds, tolerant column access, bounded samples."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on one machine (a local master) a temporary folder is set where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidegauge-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when the driver's Python ends."""
    path = f"{scratch_dir(spark)}/tidegauge-{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage is cut and survives any executor."""
    return materialise_at(df, scratch_path(df.sparkSession, name))


#: Rows of an Arrow batch: whole texts of 10,000 rows, Spark's own choice, are held twice over by an executor's direct memory and its workers.
BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for what runs inside."""
    was = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialise_at(df: DataFrame, path: str) -> DataFrame:
    """The same at a path of the caller's, who may discard() it later. The shuffle files of the write go when it ends."""
    spark = df.sparkSession
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCH_SETTING: str(BATCH)}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow; when a task ends, what its worker has freed goes back to the system, as Spark keeps the worker for later stages."""

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return then_release


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, by the file system that holds it."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are made inside go when it ends; what is to last must have its path from before."""
    mark = len(_made)
    yield
    for _, path in _made[mark:]:
        discard(spark, path)
    del _made[mark:]


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            discard(spark, path)
        except Exception:  # the session has ended; the folder is the cluster's to clear
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that a worker holds the Python objects of few texts at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def held_out(doc_id: Column) -> Column:
    """The test fold: crc32 of the id's decimal text leaves 2 when divided by 4. A null id is in no fold but the training one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def utf8(text: Column) -> Column:
    """Text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


#: Rows of keys that are broadcast (8 to 40 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def few(keys: DataFrame) -> DataFrame:
    """keys, marked for a broadcast if a count finds BROADCAST_KEYS rows at most."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def among(docs: DataFrame, keys: DataFrame, *on: Column) -> DataFrame:
    """The rows of docs that match a row of `keys` by all conditions. keys is a written table: it is counted, and broadcast if it has few rows."""
    return docs.join(few(keys), list(on), "left_semi")


def without(docs: DataFrame, gone: DataFrame, *on: Column) -> DataFrame:
    """The rows of docs that match no row of `gone`, in the same way."""
    return docs.join(few(gone), list(on), "left_anti")


def ranked(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """df with what bounded_sample goes by: a hash of id and text, and the text's bytes. Before a join, so that texts needn't be shuffled for them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text), 1)
    return df.withColumns({"sample_rank": h, "sample_bytes": F.octet_length(text)})


def bounded_sample(df: DataFrame, rows: int, size: int) -> DataFrame:
    """All rows, if they are `rows` with `size` bytes of text at most; else those that come first by ranked()'s hash, as many as keep both bounds.

    The same rows on every run and for any partitioning; null and repeated ids count like others. Of equal rows that only fit in part any are as good.
    A text of over a sixteenth of `size` isn't taken then. What reaches the driver are hashes and counts of about twice as many rows as are taken.
    """
    h, b = F.col("sample_rank"), F.col("sample_bytes")
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(b), F.lit(0))).first()
    if n <= rows and total <= size:
        return df.drop("sample_rank", "sample_bytes")
    df = df.where(b <= size // 16)
    share, top = min(1.0, 2 * min(rows / n, size / max(total, 1))), 1 << 63
    while True:
        by = df if share == 1 else df.where(h < int(share * top))
        taken, left, cut, part, full = rows, size, -1, 0, False
        for r in sorted(by.groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.max(b).alias("b")).collect()):
            fit = min(r.n, taken, left // max(r.b, 1))
            cut, part, full = r.h, fit, fit < r.n
            taken, left = taken - fit, left - fit * r.b
            if full:
                break
        if full or not taken or share == 1:
            break
        share = min(1.0, 4 * share)
    kept = df.where(h < cut).unionByName(df.where(h == cut).limit(int(part))) if full else df.where(h <= cut)
    return kept.drop("sample_rank", "sample_bytes")
