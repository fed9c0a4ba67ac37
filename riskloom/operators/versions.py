"""The best of the available versions for a version pragma.

A caret, and a version without a patch, allow later patches of the same minor version; an exact version
allows itself; `>=` allows all from there on, below the bound if it has one. Of those available the highest is
chosen; null if there is none, or no pragma. Only the first pragma of a text counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 100_000  # distinct available versions that go along with every row; more are joined by minor version and bound
PATTERN = r"(?i)pragma\s+solidity\s+(\^|>=)?\s*(\d+)\.(\d+)(?:\.(\d+))?(?:\s*<\s*(\d+)\.(\d+)(?:\.(\d+))?)?"
TOP = 10**18


def code(major: Column, minor: Column, patch: Column) -> Column:
    """A version as a number that orders as versions do (parts below a million)."""
    return (major * F.lit(10**12) + minor * F.lit(10**6) + patch).cast("long")


def bounds(text: Column) -> tuple[Column, Column]:
    """(lowest code allowed, the first that isn't) of a text's pragma; nulls without one."""
    got = lambda i: F.regexp_extract(text, PATTERN, i).try_cast("long")
    zero = lambda i: F.coalesce(got(i), F.lit(0))
    low = code(got(2), got(3), zero(4))
    op = F.regexp_extract(text, PATTERN, 1)
    below = F.when(got(5).isNotNull(), code(got(5), got(6), zero(7))).otherwise(F.lit(TOP))
    high = F.when(op == ">=", below).when((op == "^") | got(4).isNull(), code(got(2), got(3) + 1, F.lit(0))).otherwise(low + 1)
    return low, F.when(low.isNotNull(), high)


def written(version: Column) -> Column:
    part = lambda x: x.cast("long").cast("string")
    return F.concat_ws(".", part(F.floor(version / 10**12)), part(F.floor(version / 10**6) % 10**6), part(version % 10**6))


def resolve(texts: DataFrame, text: str, available: DataFrame) -> DataFrame:
    """`texts` with `resolved`. `available`: major, minor, patch.

    Texts ask for few different ranges: each is resolved once and joined back. The versions are one sorted array beside the ranges; above
    `MOST` of them ranges and versions meet by an ordered pass instead, the highest version so far below each bound.
    """
    low, high = bounds(F.col(text))
    asked = texts.withColumns({"_low": low, "_high": high})
    ranges = asked.select("_low", "_high").where("_low IS NOT NULL").distinct()
    codes = available.select(code(F.col("major"), F.col("minor"), F.col("patch")).alias("v")).where("v IS NOT NULL").distinct()
    if codes.count() <= MOST:
        listed = codes.agg(F.collect_set("v").alias("_vs"))
        best = ranges.join(F.broadcast(listed), F.lit(True)).withColumn("_best", F.array_max(F.filter("_vs", lambda v: (v >= F.col("_low")) & (v < F.col("_high")))))
    else:
        best = _by_order(ranges, codes)
    best = best.where("_best IS NOT NULL").select("_low", "_high", written(F.col("_best")).alias("resolved"))
    return asked.join(best, ["_low", "_high"], "left").select(*texts.columns, "resolved")


def _by_order(ranges: DataFrame, codes: DataFrame, parts: int = 64) -> DataFrame:
    """The highest code below each range's end: a running maximum in order, by parts of the order."""
    from pyspark.sql import Window

    both = codes.select(F.col("v").alias("at"), "v", F.lit(None).cast("long").alias("_low")).unionByName(ranges.select(F.col("_high").alias("at"), F.lit(None).cast("long").alias("v"), "_low"))
    cuts = sorted(set(both.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []))
    dealt = both.withColumn("p", F.size(F.filter(F.lit([int(x) for x in cuts]).cast("array<long>"), lambda x: x < F.col("at"))) if cuts else F.lit(0))
    ends = dealt.groupBy("p").agg(F.max("v").alias("most"))
    before = ends.select("p", F.max("most").over(Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # `parts` rows
    run = Window.partitionBy("p").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumn("own", F.max("v").over(run)).where("_low IS NOT NULL").join(F.broadcast(before), "p")
    best = F.greatest("own", "before")
    return found.select("_low", F.col("at").alias("_high"), F.when(best >= F.col("_low"), best).alias("_best"))
