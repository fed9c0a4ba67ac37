"""Structured Streaming forms of the monitoring operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """A stream of Parquet event files, with the time as a timestamp."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, late: str = "1 day", span: str = "1 day") -> DataFrame:
    """Counters and means by window and type; rows later than the watermark are dropped by Spark."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", span), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def _limiter(seconds: int, most: int):
    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used, over, n, wins = state.get if state.exists else (-1, 0, 0, 0, 0)
        times = sorted(t for pdf in pdfs for t in pdf["t"])
        for t in times:
            if opened < 0 or t - opened >= seconds * 1_000_000:
                opened, used, wins = t, 0, wins + 1
            used += 1
            over += used > most
            n += 1
        state.update((opened, used, over, n, wins))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "over_limit": [over], "windows": [wins]})

    return run


def rate_limit(stream: DataFrame, seconds: int, most: int) -> DataFrame:
    """Fixed windows anchored at the first request of each user; state is five numbers a user."""
    s = stream.select("user_id", F.unix_micros("ts").alias("t"))
    return s.groupBy("user_id").applyInPandasWithState(
        _limiter(seconds, most), "user_id long, n long, over_limit long, windows long", "opened long, used long, over long, n long, wins long", "update", GroupStateTimeout.NoTimeout)


def _history(size: int):
    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for pdf in pdfs:
            held += pdf.sort_values(["ts", "event_id"])["value"].tolist()
        held = held[-size:]
        state.update((held,))
        yield pd.DataFrame({"user_id": [key[0]], "held": [len(held)], "mean": [sum(held) / len(held)]})

    return run


def bounded_history(stream: DataFrame, size: int = 100) -> DataFrame:
    """The last `size` values of each user, and their mean, as they arrive."""
    return stream.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(
        _history(size), "user_id long, held long, mean double", "values array<double>", "update", GroupStateTimeout.NoTimeout)


def drift_alerts(stream: DataFrame, reference: DataFrame, path: str, checkpoint: str, threshold: float = 0.05):
    """Each micro-batch's type shares against the reference's; an alert row is appended where they are apart."""
    total = reference.count()
    ref = reference.groupBy("event_type").agg((F.count("*") / F.lit(float(total or 1))).alias("q"))

    def check(batch: DataFrame, epoch: int) -> None:
        n = batch.count()
        if not n:
            return
        now = batch.groupBy("event_type").agg((F.count("*") / F.lit(float(n))).alias("p"))
        gap = now.join(ref, "event_type", "full").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / F.count("*")).alias("drift"))
        gap.where(F.col("drift") > threshold).withColumn("epoch", F.lit(epoch)).write.mode("append").json(path)

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
