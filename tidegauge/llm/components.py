"""Connected components by alternating large-star and small-star rounds over an edge table.

Each round is two joins on the node id and a distinct; hot nodes are pre-aggregated (min) before the shuffle and their edges
are split by AQE's skew join. Rounds are written to the shared folder. No link or component reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import discard, materialise, materialise_at, scratch_path, tidy

#: Links that one union-find holds before it emits its forest.
LOCAL_LINKS = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shrink a task's links to stars around their smallest node; the components stay the same."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x] = top
            x = up
        return top

    def out() -> pa.RecordBatch:
        stars = [(x, r) for x in root if (r := find(x)) != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                root.setdefault(min(a, b), min(a, b))
        if len(root) > LOCAL_LINKS:
            yield out()
    yield out()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b) that isn't the smallest of its component."""
    edges = materialise(links.where("a <> b").mapInArrow(tidy(_forest), "a long, b long").distinct(), "links")
    last = path = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last, before, path = now, path, scratch_path(links.sparkSession, "star")
        edges = materialise_at(_small_star(_large_star(edges)), path)
        if before:
            discard(links.sparkSession, before)
