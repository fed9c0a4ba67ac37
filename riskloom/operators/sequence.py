"""Order-sensitive rules over steps of a group, as aggregates over positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def call_write_rules(steps: DataFrame, group: list[str], pos: str, call: Column, write: Column, checked: Column | None = None) -> DataFrame:
    """For each group of ordered steps, from two aggregates and a join, no array of a group's steps:

    violation: a write at or after the first call; safe: call and write, and no write strictly after
    the first call; before: writes up to the first call; unchecked: calls not checked that a write follows.
    """
    s = steps.withColumn("_call", call).withColumn("_write", write).withColumn("_open", call & ~(checked if checked is not None else F.lit(False)))
    p, c, w = F.col(pos), F.col("_first"), F.col("_last")
    ends = s.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min(F.when(F.col("_call"), p)).alias("_first"), F.max(F.when(F.col("_write"), p)).alias("_last"))
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
    count = lambda when: F.count_if(F.coalesce(when, F.lit(False))).cast("int")
    return s.join(ends, on).groupBy(*group).agg(
        F.max(F.coalesce(w >= c, F.lit(False)).cast("int")).alias("violation"),
        F.max(F.coalesce(w <= c, F.lit(False)).cast("int")).alias("safe"),
        count(F.col("_write") & (p <= c)).alias("before"),
        count(F.col("_open") & (p < w)).alias("unchecked"),
    )


def cei_score(safe: Column, violations: Column) -> Column:
    """safe / (safe + violations), 1 if there is neither."""
    return F.coalesce(F.try_divide(safe.cast("double"), safe + violations), F.lit(1.0))
