"""Document fingerprints by winnowing, in DataFrame functions only.

A text is a sequence of units: runs of up to UNIT characters that aren't white space, and each character of a longer run, so that in text without
spaces a passage has the same units at any offset. Rolling hashes (cyclic polynomials) of
K units in a row are taken, and of each window of W such hashes the smallest is kept, the rightmost on ties, with its
position. Any passage of W+K-1 units that two texts share has a gram that both keep. Hash and position are one
number, so the smallest of a window is a plain minimum, and minima over W hashes come from doubling: of 2, of 4, of 8.
Each step is a column of its own: Catalyst doesn't inline a column that is used more than once, so each is made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of a gram (3 is written out in `grams`), hashes of a window (a power of two), characters of a unit at most.
K, W, UNIT = 3, 8, 16
#: A unit: a run of up to UNIT characters between white space, else a character of a longer run.
UNITS = rf"(?<!\S)\S{{1,{UNIT}}}(?!\S)|\S"
#: Documents for a range of ids, and the most ranges: their first ids are broadcast (under 1 MB).
RANGE, RANGES = 2000, 10_000
_BITS = 31
_LOW = (1 << _BITS) - 1


def _turn(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with array<bigint> `out`: the grams kept, in order, each as hash * 2^31 + (2^31 - 1 - position).

    Fewer than K units are one gram of what there is; a text without units (or null) keeps none.
    """
    unit, packed = f"__{out}_units", f"__{out}_packed"
    df = df.withColumn(unit, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNITS), F.lit(0)), lambda u: F.xxhash64(u)))
    h = F.col(unit)
    none = F.lit(0).cast("long")
    rolled = lambda x, i: _turn(x, 2).bitwiseXOR(_turn(F.coalesce(F.get(h, i + 1), none), 1)).bitwiseXOR(F.coalesce(F.get(h, i + 2), none))
    count = F.greatest(F.size(h) - (K - 1), F.least(F.size(h), F.lit(1)))
    grams = F.transform(F.slice(h, 1, count), lambda x, i: F.shiftleft(F.shiftrightunsigned(rolled(x, i), 64 - _BITS), _BITS).bitwiseOR(F.lit(_LOW).cast("long") - i))
    df = df.withColumn(packed, grams).drop(unit)
    low, span = packed, 1
    while span < W:
        low, df = _doubled(df, low, span, f"__{out}_low{span}")
        span *= 2
    windows = F.greatest(F.size(low) - (W - 1), F.least(F.size(low), F.lit(1)))
    return df.withColumn(out, F.array_distinct(F.slice(low, 1, windows))).drop(low)


def _doubled(df: DataFrame, low: str, span: int, out: str) -> tuple[str, DataFrame]:
    """From minima over `span` values to those over twice as many; windows at the end are shorter."""
    return out, df.withColumn(out, F.transform(low, lambda x, i: F.least(x, F.get(F.col(low), i + span)))).drop(low)


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda v: F.shiftright(v, _BITS)))


def grams(kept: Column) -> Column:
    """array<struct<hash, position>> of a fingerprint; positions count units from 0."""
    return F.transform(kept, lambda v: F.struct(F.shiftright(v, _BITS).alias("hash"), (F.lit(_LOW).cast("long") - v.bitwiseAND(F.lit(_LOW).cast("long"))).alias("position")))


def likeness(both: Column, a: Column, b: Column) -> Column:
    """Jaccard likeness from the size of the intersection and the sizes of two sets; two empty sets are alike."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise(both / (a + b - both))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, grams) for each row: grams has the kept hashes with positions, for lookups of shared passages; the same that edited_report compares.

    Null text counts as empty and keeps no gram; a text of any length is taken whole. Repeated rows and null ids are rows like others.
    """
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_fingerprint(slim, "text", "kept").select("id", F.char_length("text").cast("long").alias("n_chars"), grams(F.col("kept")).alias("grams"))


def with_next(df: DataFrame, key: str, columns: list[str], made: callable = lambda x: x) -> DataFrame:
    """df with next_<c> for each column c: its value in the next row by (key, first column), for the last row in the first.

    Rows are dealt by ranges of the key, so only a range is sorted at once; the first rows of a range go to the range before it too.
    made() adds columns to the dealt rows, before they are sorted.
    """
    stats = df.agg(F.count(F.lit(1)).alias("n")).first()
    ranges = int(min(RANGES, max(1, stats.n // RANGE)))
    cuts = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(df.agg(F.percentile_approx(key, shares, 50_000).alias("q")).first().q))
    spot = F.lit(0)
    if cuts:
        some = [cuts[i : i + 100] for i in range(0, len(cuts), 100)]
        longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
        heads = longs([s[0] for s in some])
        group = F.size(F.filter(heads, lambda c: c <= F.col(key)))
        inner = F.element_at(F.array(*map(longs, some)), F.greatest(group, F.lit(1)))
        spot = F.when(group == 0, 0).otherwise((group - 1) * 100 + F.size(F.filter(inner, lambda c: c <= F.col(key))))
    df = df.withColumn("__range", spot)
    order = Window.orderBy("__range")  # over the ranges' first keys: RANGES rows at most
    first = df.groupBy("__range").agg(F.min(key).alias("__first"))
    before = F.coalesce(F.lag("__range").over(order), F.last("__range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    first = first.select("__first", before.alias("__before"))
    own = F.struct(F.col("__range").alias("at"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("__before").alias("at"), F.lit(1).alias("guest"))
    dealt = df.join(F.broadcast(first), df[key] == first["__first"], "left")
    dealt = dealt.withColumn("__in", F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, guest)))).select(*df.columns, "__in.at", "__in.guest").drop("__range")
    dealt = made(dealt.repartition("at"))
    w = Window.partitionBy("at").orderBy("guest", key, columns[0])
    return dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("guest = 0").drop("at", "guest")


def edited_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n/2) code points replaced by the first of the next text, as many or all it has. fingerprint is the
    SHA-256 of the kept grams with positions. Null text counts as empty. Rows go by id, a null id first, then by text;
    repeated rows follow each other, so the next of the first copy is the second. A lone row is its own next. Texts of any length are taken whole. Other
    columns of any name are ignored; an empty table gives an empty result.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    slim = df.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("id"))
    rows = with_next(slim, "key", ["text", "kept"], lambda d: with_fingerprint(d, "text", "kept"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    rows = with_fingerprint(rows, "edited", "edited_kept")
    rows = rows.select("id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "kept", "edited_kept", hashes(F.col("kept")).alias("a"), hashes(F.col("edited_kept")).alias("b"), hashes(F.col("next_kept")).alias("c"))
    digest = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    near = lambda x: likeness(F.size(F.array_intersect("a", x)), F.size("a"), F.size(x))
    return rows.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", digest("kept").alias("fingerprint"), digest("edited_kept").alias("edited_fingerprint"), near("b").alias("near_edited"), near("c").alias("near_next"))
