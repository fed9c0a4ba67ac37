"""Fixpoints in DataFrame rounds: each round is a stored table in the shared folder, so lineage stays short and lost executors cost a round at most.

Rounds go on until one adds or changes no row, as counted from what it has written.

Tables that grow with the input are merged, not broadcast (`dealt`): Spark goes by the size of their files, rows are several times as
large on the driver, and each of a hundred rounds would send them there again. Only a round with few new facts sends those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from riskloom.session import scratch


FEW = 10_000  # new facts of a round that may be broadcast


def dealt(df: DataFrame) -> DataFrame:
    """`df` as one side of a join that deals both out by key and never broadcasts."""
    return df.hint("merge")


def remove(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, path: str, changed: str | None = None) -> int:
    """Writes `df` and returns how many rows the file footers count, or in how many the column `changed` is true."""
    df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    return rows.count() if changed is None else rows.where(changed).count()


def facts(start: DataFrame, step: Callable[[DataFrame], DataFrame], once: bool = False) -> DataFrame:
    """All facts that follow from `start`, with `round`, the round in which each came first.

    `step` maps the facts of the last round, which it joins with what it knows, to what follows from them at once, columns and types as in `start`. A fact is worked on once (semi-naive); a round joins the new
    ones with those that are known, unless `once` says that `step` never comes upon a fact twice. Facts are whole rows; nulls in them are
    equal to each other.
    """
    spark, folder = start.sparkSession, scratch(start.sparkSession, "facts")
    kind = start.schema
    here = lambda i: spark.read.schema(kind).parquet(f"{folder}/round={i}")
    i, n = 0, written(start.distinct(), f"{folder}/round=0")
    while n:
        new = here(i).hint("broadcast") if n <= FEW else dealt(here(i))
        fresh = step(new).select(*kind.names)
        if not once:
            known = spark.read.schema(kind).option("basePath", folder).parquet(folder).select(kind.names).alias("b")
            same = F.lit(True)
            for c in kind.names:
                same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
            fresh = fresh.distinct().alias("a").join(dealt(known), same, "left_anti")
        i += 1
        n = written(fresh, f"{folder}/round={i}")
    return spark.read.schema(StructType([*kind.fields, StructField("round", IntegerType())])).option("basePath", folder).parquet(folder)


def settled(state: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`state` after `step` has been applied until no row changes; `step` returns the state's columns, of the same types, and `_changed`."""
    spark, names = state.sparkSession, state.columns
    path = scratch(spark, "state")
    written(state, path)
    while True:
        now = spark.read.schema(state.schema).parquet(path)
        after = scratch(spark, "state")
        n = written(step(now).select(*names, "_changed"), after, "_changed")
        remove(spark, path)
        path = after
        if not n:
            return spark.read.schema(state.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
