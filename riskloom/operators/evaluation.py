"""Metrics of scored rows, from counts by score level rather than from sorted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_level(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, pos, neg: a row for each distinct score."""
    y = F.col(label)
    return df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))


def auc(df: DataFrame, score: str, label: str, parts: int = 64, times: str | None = None) -> DataFrame:
    """One row: the exact area under the curve, ties counting half; null if a class is missing."""
    return areas(df, [], score, label, parts, times)


def areas(df: DataFrame, by: list[str], score: str, label: str, parts: int = 64, times: str | None = None) -> DataFrame:
    """_<by>..., auc: exact areas of many groups at once, ties counting half; null where a class is missing. `times`: how many rows each stands for.

    Rows are counted by level first. Levels are dealt into ranges at quantiles of the levels, so scores that
    crowd together still spread; a window holds a range of one group.
    """
    many = lambda y: F.sum(F.when(y, F.col(times)).otherwise(0)) if times else F.count_if(y)
    levels = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*[F.col(b).alias(f"_{b}") for b in by], F.col(score).alias("s")).agg(many(F.col(label) == 1).alias("pos"), many(F.col(label) != 1).alias("neg"))
    cuts = sorted(set(levels.agg(F.percentile_approx("s", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []))
    at = F.size(F.filter(F.lit([float(x) for x in cuts]), lambda x: x < F.col("s"))) if cuts else F.lit(0)
    keys = [f"_{b}" for b in by]
    inside = Window.partitionBy(*keys, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    dealt = levels.withColumn("b", at).withColumn("w", F.col("pos") * (F.coalesce(F.sum("neg").over(inside), F.lit(0)) + F.col("neg") / 2))
    ranges = dealt.groupBy(*keys, "b").agg(F.sum("w").alias("w"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lower = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over `parts` rows
    total = ranges.withColumn("w", F.col("w") + F.col("pos") * lower).groupBy(*keys)
    return total.agg(F.try_divide(F.sum("w"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def confusion(predicted: Column, label: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if(predicted & (label == 1)), "fp": F.count_if(predicted & (label != 1)),
        "fn": F.count_if(~predicted & (label == 1)), "tn": F.count_if(~predicted & (label != 1)),
    }


def rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 beside tp, fp, fn, tn; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return df.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def grid(df: DataFrame, ml: str, other: str, label: str, shares: list[float], thresholds: list[float]) -> DataFrame:
    """Confusion counts for every pair of weight and threshold.

    Rows with equal scores are counted together first; of those, each gives a row for each weight
    with the number of thresholds that it passes, which add up before anything is moved.
    """
    levels = df.groupBy(ml, other, (F.col(label) == 1).alias("y")).agg(F.count("*").alias("n"))
    cuts = sorted(thresholds)
    passed = lambda w: sum(((F.round(w * F.col(ml) + (1 - w) * F.col(other), 9) > t).cast("int") for t in cuts), F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), passed(w).alias("k")) for w in shares])).alias("e")
    by = levels.select("y", "n", each).groupBy("e.w", "e.k", "y").agg(F.sum("n").alias("n"))  # weights x (thresholds + 1) x 2 rows
    at = by.select("w", "k", "y", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)])).alias("t"))
    above = F.col("k") > F.col("t.i")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    counts = at.groupBy(F.col("w").alias("ml_weight"), F.col("t.threshold").alias("threshold")).agg(
        total(above & F.col("y")).alias("tp"), total(above & ~F.col("y")).alias("fp"), total(~above & F.col("y")).alias("fn"), total(~above & ~F.col("y")).alias("tn"))
    return rates(counts)


def two_sample_ks(df: DataFrame, value: str, side: Column, parts: int = 64) -> DataFrame:
    """Largest gap between two empirical distributions, exact, from counts by value dealt into ranges at quantiles of the values."""
    v = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    cuts = sorted(set(v.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []))
    dealt = v.withColumn("k", F.size(F.filter(F.lit([float(x) for x in cuts]), lambda x: x < F.col("v"))) if cuts else F.lit(0))
    run = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inner = dealt.select("k", F.sum("a").over(run).alias("ca"), F.sum("b").over(run).alias("cb"))
    sums = dealt.groupBy("k").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    every, earlier = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("k", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in ("sa", "sb")], *[F.sum(s).over(every).alias(f"{s}_all") for s in ("sa", "sb")])
    at = inner.join(base, "k")
    gap = F.abs(F.try_divide(F.col("ca") + F.col("sa_before"), F.col("sa_all")) - F.try_divide(F.col("cb") + F.col("sb_before"), F.col("sb_all")))
    return at.agg(F.max(gap).alias("ks"), F.first("sa_all").alias("n_a"), F.first("sb_all").alias("n_b"))
