"""Streams over the events table agree with the batch forms."""

from pyspark.sql import functions as F

from riskloom.operators import windows
from riskloom.session import table
from riskloom.streaming import monitor


def folder(spark, sf_dir, tmp_path):
    table(spark, sf_dir, "events").repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def drained(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_windowed_counts(spark, sf_dir, tmp_path):
    src = folder(spark, sf_dir, tmp_path)
    got = drained(spark, monitor.windowed_counts(monitor.events(spark, src, files=10)), "counts", "complete")
    assert got.agg(F.sum("n")).first()[0] == table(spark, sf_dir, "events").count()


def test_rate_limit_matches_batch(spark, sf_dir, tmp_path):
    src = folder(spark, sf_dir, tmp_path)
    got = drained(spark, monitor.rate_limit(monitor.events(spark, src, files=10), 86_400, 2), "limits", "update")
    want = windows.anchored(table(spark, sf_dir, "events"), ["user_id"], F.col("ts"), 86_400, 2)
    pick = lambda df: {r.user_id: (r.n, r.over_limit, r.windows) for r in df.orderBy("n").collect()}
    assert pick(got) == pick(want)


def test_drift_alerts(spark, sf_dir, tmp_path):
    src = folder(spark, sf_dir, tmp_path)
    ref = table(spark, sf_dir, "events").where("event_type = 'click'")
    monitor.drift_alerts(monitor.events(spark, src, files=10), ref, str(tmp_path / "alerts"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "alerts")).count() >= 1
