"""Each key's last values as streaming state, and their export.

`histories` keeps the last `size` (time, id, value) entries of each key in a stream's state, which is
dropped after a time without any, and gives a key's tail whenever it changes. `export_tail` writes the last
tail of every key as JSON beside a line of metadata. `last_values` is the same of a table that is at rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "t array<long>, id array<long>, value array<double>"
TAIL = "key {key}, held long, mean double, tail array<struct<t: long, id: long, value: double>>"


def _tail(size: int, ttl_ms: int | None) -> Callable:
    """Keeps the key's last `size` entries in the order of time and id, whatever the order they come in."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in rows:
            held += zip(pdf["t"].tolist(), pdf["id"].tolist(), pdf["value"].tolist(), strict=True)
            held = sorted(held)[-size:]
        state.update(tuple(list(x) for x in zip(*held, strict=True)))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": [key[0]], "held": [len(held)], "mean": [sum(v for _, _, v in held) / len(held)], "tail": [[{"t": t, "id": i, "value": v} for t, i, v in held]]})

    return run


def _entries(df: DataFrame, key: str, ts: str, ident: str, value: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(ident).cast("long").alias("id"), F.col(value).cast("double").alias("value")).dropna()


def histories(stream: DataFrame, key: str = "user_id", ts: str = "ts", ident: str = "event_id", value: str = "value", size: int = 100, ttl_ms: int | None = None) -> DataFrame:
    """key, held, mean, tail of each key that a micro-batch brings values for; rows with a null in any of the columns take no part."""
    rows = _entries(stream, key, ts, ident, value)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(_tail(size, ttl_ms), TAIL.format(key=dict(rows.dtypes)["key"]), STATE, "update", timeout)


def last_values(df: DataFrame, key: str = "user_id", ts: str = "ts", ident: str = "event_id", value: str = "value", size: int = 100) -> DataFrame:
    """The same of a table: the window's limit is pushed below the shuffle, so a key sends `size` rows from each task at most."""
    newest = Window.partitionBy("key").orderBy(F.col("t").desc(), F.col("id").desc(), F.col("value").desc())
    rows = _entries(df, key, ts, ident, value).withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= size)
    return rows.groupBy("key").agg(F.count("*").alias("held"), F.avg("value").alias("mean"), F.sort_array(F.collect_list(F.struct("t", "id", "value"))).alias("tail"))


def run_histories(stream: DataFrame, path: str, checkpoint: str, **options):
    """Starts the stream of tails; each micro-batch's are a folder of their own below `path`, replaced if the batch runs again.

    It ends when all there is has been read; with `ttl_ms` it goes on until it is stopped, as state may time out at any time.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = histories(stream, **options).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="1 second") if options.get("ttl_ms") else writer.trigger(availableNow=True)).start()


def latest_tails(spark, path: str) -> DataFrame:
    """Every key's newest tail of those that `run_histories` has written."""
    every = spark.read.parquet(path)
    return every.groupBy("key").agg(*[F.max_by(c, "epoch").alias(c) for c in ("held", "mean", "tail")])


def export_tail(tails: DataFrame, path: str) -> None:
    """The tails as JSON, a line a key, and metadata: how many keys and values there are and the times of the first and the last."""
    tails.write.mode("errorifexists").json(f"{path}/tails")
    ends = tails.agg(F.count("*").alias("keys"), F.sum("held").alias("values"), F.min(F.timestamp_micros(F.get("tail", F.lit(0)).t)).alias("first"), F.max(F.timestamp_micros(F.get("tail", F.size("tail") - 1).t)).alias("last"), F.current_timestamp().alias("exported_at"))
    ends.write.mode("errorifexists").json(f"{path}/metadata")
