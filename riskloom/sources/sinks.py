"""Sinks: exports, upserts and versioned results as DataFrame rewrites."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export(df: DataFrame, path: str, form: str = "parquet") -> None:
    """The table and, beside it, its metadata as JSON."""
    df.write.mode("errorifexists").option("header", True).format(form).save(f"{path}/data")
    meta = {"columns": df.columns, "types": dict(df.dtypes)}
    df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def split_export(df: DataFrame, path: str, parts: dict[str, F.Column]) -> dict[str, str]:
    """One Parquet folder for each named condition; a row may be in several."""
    for name, condition in parts.items():
        df.where(condition).write.parquet(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in parts}


def with_columns_of(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `df` under the columns of both, missing ones null (a schema that grows)."""
    return wanted.limit(0).unionByName(df, allowMissingColumns=True)


def new_rows(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Insert-or-ignore: the rows whose key isn't stored yet."""
    return rows.join(stored.select(*key).distinct(), key, "left_anti")


def upsert(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Insert or update: every key once, new values first, and what was done to it."""
    n, o = rows.alias("n"), stored.alias("o")
    on = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key])
    others = [c for c in stored.columns if c not in key]
    j = o.withColumn("_o", F.lit(True)).alias("o").join(n.withColumn("_n", F.lit(True)).alias("n"), on, "full")
    action = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "kept").otherwise("updated")
    return j.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in [*key, *others]], action.alias("action"))


def update(stored: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `stored` with the values of `changes` where the key matches."""
    done = upsert(stored, changes.join(stored.select(*key), key, "left_semi"), key)
    return done.drop("action")


def build_statistics(df: DataFrame, dataset: str, status: str, reason: str) -> DataFrame:
    """One row, `statistics`: counts by dataset and by reason (a code, not a free text) as one JSON text."""
    failed = F.col(status) == "failed"
    by = df.groupBy(F.col(dataset).alias("d"), F.when(failed, F.col(reason)).alias("r")).agg(F.count("*").alias("n"))

    def counts(name: str):
        one = by.where(F.col(name).isNotNull()).groupBy(name).agg(F.sum("n").alias("n"))
        return one.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "n")))).alias(f"by_{name}"))  # as many entries as names or codes

    total = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    row = total.join(counts("d"), F.lit(True)).join(counts("r"), F.lit(True))  # one row each
    return row.select(F.to_json(F.struct("total", F.col("by_d").alias("by_dataset"), F.col("by_r").alias("by_reason"))).alias("statistics"))


def content_hash(df: DataFrame, names: list[str]) -> DataFrame:
    """md5 of the named columns as JSON in the order of their names."""
    return df.withColumn("hash", F.md5(F.to_json(F.struct(*sorted(names)))))
