"""Column statistics in one pass over the data, then one row for each column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.rounds import kept

def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null if either side is constant."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def per_column(df: DataFrame, columns: list[str], stats: dict, key: str = "feature") -> DataFrame:
    """`stats` maps a name to a function of a column; one aggregate, then one row for each of `columns`."""
    aggs = [f(F.col(c)).alias(f"{c}__{s}") for c in columns for s, f in stats.items()]
    rows = F.array(*[F.struct(F.lit(c).alias(key), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in columns])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for every ordered pair a < b (by position), from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = [safe_corr(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def quantiles(df: DataFrame, columns: list[str], probs: list[float], parts: int = 64, by: str | None = None) -> DataFrame:
    """feature, p, value, and the group where `by` names one: exact quantiles (linear between neighbours) of several columns, nulls aside.

    Rows are counted by value in one pass and stored; values are dealt into ranges by approximate cut points, and only
    running counts within a range and over the few ranges find a rank. No task holds all values of a column.
    """
    own = [by] if by else []
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]
    counts = kept(df.select(*own, F.explode(F.array(*cells)).alias("e")).select(*own, "e.*").where("v IS NOT NULL").groupBy(*own, "feature", "v").agg(F.count("*").alias("n")), "levels")
    cuts = counts.groupBy("feature").agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 20 * parts).alias("cuts")).collect()  # a row for each column
    below = lambda r: F.size(F.filter(F.lit(sorted(set(r.cuts))), lambda x: x < F.col("v")))
    levels = counts.withColumn("b", F.coalesce(*[F.when(F.col("feature") == r.feature, below(r)) for r in cuts], F.lit(0)))
    of = Window.partitionBy(*own, "feature")  # `parts` rows a column
    before = F.coalesce(F.sum("m").over(of.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = levels.groupBy(*own, "feature", "b").agg(F.sum("n").alias("m")).select(*own, "feature", "b", "m", before.alias("before"), F.sum("m").over(of).alias("total"))
    asked = ranges.select("*", F.explode(F.array(*[F.lit(p) for p in probs])).alias("p")).withColumn("pos", F.col("p") * (F.col("total") - 1))
    asked = asked.withColumn("r", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos"))))).where("r >= before AND r < before + m")
    inner = levels.withColumn("upto", F.sum("n").over(Window.partitionBy(*own, "feature", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    same = F.lit(True)
    for k in (*own, "feature", "b"):
        same = same & F.col(f"i.{k}").eqNullSafe(F.col(f"a.{k}"))
    hit = inner.alias("i").join(F.broadcast(asked.alias("a")), same).where("r >= before + upto - n AND r < before + upto")  # two rows a quantile
    ends = hit.groupBy(*[F.col(f"i.{k}").alias(k) for k in (*own, "feature")], "p", "pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return ends.select(*own, "feature", "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))).alias("value"))


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at most one distinct value (nulls aside): one aggregate, a row of minima and maxima."""
    row = df.agg(*[F.min(c).alias(f"{c}__lo") for c in columns], *[F.max(c).alias(f"{c}__hi") for c in columns]).first()
    return [c for c in columns if row[f"{c}__lo"] == row[f"{c}__hi"]]


def hash_rank(strata: list[str], key: str, seed: int = 42) -> Column:
    """Position of each row in its stratum in the order of a seeded hash: a sample that any engine can repeat."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return F.row_number().over(Window.partitionBy(*strata).orderBy(h, key))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
