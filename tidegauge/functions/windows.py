"""Window expressions over earlier rows, with null for "not enough of them". Null stands for missing throughout; NaN never occurs."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Blocks that an exponential mean looks back on.
BLOCKS = 4


def by_table() -> WindowSpec:
    return Window.partitionBy("table_name").orderBy("day_idx")


def by_weekday() -> WindowSpec:
    """(table_name, weekday) shares the exchange by table_name."""
    return Window.partitionBy("table_name", "day_of_week").orderBy("day_idx")


def whole_table() -> WindowSpec:
    return Window.partitionBy("table_name")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def earlier(agg: Callable[[Column], Column], c: str | Column, n: int, least: int, w: WindowSpec | None = None) -> Column:
    """agg over the n rows before this one, if at least `least` of them have a value."""
    frame = (w or by_table()).rowsBetween(-n, -1)
    return F.when(F.count(col(c)).over(frame) >= least, agg(col(c)).over(frame))


def earlier_values(c: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    """The values of the n rows before this one, oldest first."""
    return F.collect_list(col(c)).over((w or by_table()).rowsBetween(-n, -1))


def safe_divide(a: Column, b: Column) -> Column:
    """a/b with 1e-9 for a b of zero."""
    return a / F.when(b == 0, F.lit(1e-9)).otherwise(b)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null: least and greatest skip nulls, so it is kept by hand."""
    out = c
    if low is not None:
        out = F.greatest(F.lit(low), out)
    if high is not None:
        out = F.least(F.lit(high), out)
    return F.when(c.isNotNull(), out)


def holds(condition: Column) -> Column:
    """A comparison with a missing value doesn't hold."""
    return F.coalesce(condition, F.lit(False))


def carried_forward(c: str | Column, w: WindowSpec | None = None) -> Column:
    """The last value up to here, 0 before the first."""
    return F.coalesce(F.last(col(c), ignorenulls=True).over((w or by_table()).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def run_length(flag: Column, position: Column, w: WindowSpec | None = None) -> Column:
    """How many rows up to here, without a break, have the flag."""
    last_break = F.max(F.when(~flag, position)).over((w or by_table()).rowsBetween(Window.unboundedPreceding, 0))
    return position - F.coalesce(last_break, F.lit(0))


def reflected_sum(step: Column, w: WindowSpec | None = None) -> Column:
    """S_t = max(0, S_{t-1} + step_t): a running sum less its smallest value so far. `step` must be 0 on the first row; needs two passes, see drift."""
    return F.sum(step).over((w or by_table()).rowsBetween(Window.unboundedPreceding, 0))


def exponential_mean(df: DataFrame, value: Column, alpha: float, out: str) -> DataFrame:
    """df with `out`, each table's exponentially weighted mean of the values so far, from the first on; a missing value leaves it as it was.

    Values are summed within blocks, each over the power of 1 - alpha that its place has lost; what the BLOCKS before left is added by their
    distance. A block is as long as a weight takes to fall by e^12.7 (64 values for 2/11), so what is further back weighs under 1e-22.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha is between 0 and 1")
    keep = 1.0 - alpha
    block = math.ceil(12.7 / -math.log(keep))
    df = df.withColumns({"__v": value, "__pos": F.count(value).over(by_table().rowsBetween(Window.unboundedPreceding, 0)).cast("int")})
    df = df.withColumns({"__block": F.floor((F.col("__pos") - 1) / block).cast("int"), "__at": F.pmod(F.col("__pos") - 1, F.lit(block))})
    share = F.when(F.col("__pos") == 1, F.col("__v")).otherwise(alpha * F.col("__v"))
    inside = Window.partitionBy("table_name", "__block").orderBy("day_idx").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__own", F.coalesce(F.sum(share * F.pow(F.lit(keep), -F.col("__at"))).over(inside), F.lit(0.0)) * F.pow(F.lit(keep), F.col("__at")))
    ended = F.when(F.col("__at") == block - 1, F.col("__own"))
    blocks = Window.partitionBy("table_name").orderBy("__block")
    before = [keep ** (block * (k - 1)) * F.coalesce(F.max(ended).over(blocks.rangeBetween(-k, -k)), F.lit(0.0)) for k in range(1, BLOCKS + 1)]
    df = df.withColumn("__before", reduce(operator.add, before))
    mean = F.col("__own") + F.pow(F.lit(keep), F.col("__at") + 1) * F.col("__before")
    return df.withColumn(out, F.when(F.col("__pos") > 0, mean)).drop("__v", "__pos", "__block", "__at", "__own", "__before")
