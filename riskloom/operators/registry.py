"""A registry of model versions as a table: compare, promote and roll back as rewrites of its rows.

Rows: model, version, semver, auc, brier, features (array), stage ('none', 'staging', 'production', 'retired').
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
METRICS = ["auc", "brier"]


def compare(registry: DataFrame, first: Column, second: Column) -> DataFrame:
    """model, metric, first, second, difference, and how many features were added and removed.

    `first` and `second` hold for the two versions of each model; a model without both has nulls.
    """
    by = registry.groupBy("model").agg(
        *[F.max(F.when(w, c(m))).alias(f"{m}_{i}") for m in METRICS for i, w in enumerate((first, second))],
        *[F.max_by(F.when(w, c("features")), F.when(w, 1)).alias(f"f_{i}") for i, w in enumerate((first, second))],
    )
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), c(f"{m}_0").alias("first"), c(f"{m}_1").alias("second"), (c(f"{m}_0") - c(f"{m}_1")).alias("difference")) for m in METRICS])
    gone = lambda a, b: F.size(F.array_except(a, b))
    return by.select("model", F.explode(rows).alias("r"), gone("f_1", "f_0").alias("added"), gone("f_0", "f_1").alias("removed")).select("model", "r.*", "added", "removed")


def promote(registry: DataFrame, chosen: Column, stage: str = "production") -> DataFrame:
    """`registry` with the chosen version of each model in the stage; who was there before is retired, where one was chosen."""
    some = registry.groupBy(c("model").alias("_m")).agg(F.max(F.when(chosen, c("semver"))).alias("_new"))
    moved = F.when(c("semver") == c("_new"), stage).when((c("stage") == stage) & c("_new").isNotNull(), "retired").otherwise(c("stage"))
    return registry.join(some, c("model") == c("_m")).withColumn("stage", moved).select(registry.columns)


def roll_back(registry: DataFrame) -> DataFrame:
    """`registry` with each model's newest retired version before the one in production back in its place."""
    now = registry.groupBy(c("model").alias("_m")).agg(F.max(F.when(c("stage") == "production", c("semver"))).alias("_now"))
    before = registry.join(now, c("model") == c("_m")).where((c("stage") == "retired") & (c("semver") < c("_now"))).groupBy(c("model").alias("_p")).agg(F.max("semver").alias("_back"))
    rows = registry.join(before, c("model") == c("_p"), "left")
    moved = F.when(c("semver") == c("_back"), "production").when((c("stage") == "production") & c("_back").isNotNull(), "retired").otherwise(c("stage"))
    return rows.withColumn("stage", moved).select(registry.columns)
