"""The model store, streaming progress and histories."""

import time

import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from riskloom.plans.learning import halves
from riskloom.session import table
from riskloom.sources.models import ModelStore, bumped
from riskloom.streaming import history, monitor, progress


def fitted(train, reg):
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="s"), LogisticRegression(featuresCol="s", labelCol="label", regParam=reg, maxIter=5)]).fit(train)


def test_versions():
    assert [bumped(None), bumped("1.0.0"), bumped("1.9.9", "minor"), bumped("1.2.3", "major")] == ["1.0.0", "1.0.1", "1.10.0", "2.0.0"]


def test_model_round_trip(spark, sf_dir, tmp_path):
    train, test = halves(spark, sf_dir)
    store = ModelStore(spark, f"file://{tmp_path}/store")
    assert store.entries("risk") == [] and store.versions("risk").collect() == []
    with pytest.raises(ValueError, match="no version"):
        store.load("risk")
    models = [fitted(train, r) for r in (0.01, 0.5)]
    first = store.register("risk", models[0], {"auc": 0.9}, ["a", "b"], {"reg": "0.01"}, "one")
    second = store.register("risk", models[1], {"auc": 0.8}, ["a"], bump="minor")
    assert (first, second) == ("1.0.0", "1.1.0")
    for v, m in ((first, models[0]), (second, models[1]), (None, models[1])):
        loaded, entry = store.load("risk", v)
        assert isinstance(loaded, PipelineModel) and entry["version"] == (v or second)
        got, want = ({r.vec_id: list(r.probability) for r in x.transform(test).collect()} for x in (loaded, m))
        assert got == want
    rows = {r.version: r for r in store.versions("risk").collect()}
    assert rows["1.0.0"].metrics == {"auc": 0.9} and rows["1.0.0"].features == ["a", "b"] and rows["1.0.0"].description == "one"
    with pytest.raises(ValueError, match="has a version"):
        store.register("risk", models[0], version="1.0.0")


def test_torn_and_racing_writes(spark, sf_dir, tmp_path, monkeypatch):
    train, _ = halves(spark, sf_dir)
    store, model = ModelStore(spark, f"file://{tmp_path}/store"), fitted(train, 0.1)
    store.register("risk", model)
    # a writer that dies before its index is in place
    monkeypatch.setattr(ModelStore, "_replace", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.register("risk", fitted(train, 0.2))
    monkeypatch.undo()
    (tmp_path / "store" / "risk" / ".half").write_text('{"version": "9.')
    assert [e["version"] for e in store.entries("risk")] == ["1.0.0"] and store.load("risk")[1]["version"] == "1.0.0"
    # another writer is first with the next index
    real = ModelStore._replace

    def late(self, name, number, entries, once=[True]):
        if once:
            once.clear()
            real(self, name, number, [*entries[:-1], {**entries[-1], "description": "other"}])
        return real(self, name, number, entries)

    monkeypatch.setattr(ModelStore, "_replace", late)
    assert store.register("risk", model) == "1.0.2"
    assert [e["version"] for e in store.entries("risk")] == ["1.0.0", "1.0.1", "1.0.2"]
    monkeypatch.undo()
    # stages and retention
    store.stage("risk", "1.0.0")
    store.stage("risk", "1.0.1", "staging")
    store.stage("risk", "1.0.2")
    assert [e["stage"] for e in store.entries("risk")] == ["retired", "staging", "production"]
    assert store.retain("risk", 0) == ["1.0.0"] and [e["version"] for e in store.entries("risk")] == ["1.0.1", "1.0.2"]
    assert store.load("risk", "1.0.1")
    # files that changed are noticed
    part = next(p for p in (tmp_path / "store" / "objects" / store.entries("risk")[-1]["digest"]).rglob("part-*"))
    part.write_bytes(part.read_bytes() + b" ")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="changed"):
        store.load("risk")


def stream_of(spark, sf_dir, tmp_path, n=4):
    src = tmp_path / "in"
    table(spark, sf_dir, "events").repartitionByRange(n, "ts").sortWithinPartitions("ts").write.parquet(str(src))
    return src


def test_progress_marks_of_a_stream(spark, sf_dir, tmp_path):
    src, told = stream_of(spark, sf_dir, tmp_path), []
    marks = progress.ProgressMarks(25, told.append)
    spark.streams.addListener(marks)
    try:
        q = monitor.events(spark, str(src)).writeStream.format("noop").queryName("marked").trigger(availableNow=True).start()
        q.awaitTermination(60)
        n, end = table(spark, sf_dir, "events").count(), time.time() + 20
        while not marks.ended and time.time() < end:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(marks)
    assert [m.number for m in told] == list(range(1, n // 25 + 1)) and [m.rows for m in told] == [25 * k for k in range(1, n // 25 + 1)]
    assert all(m.query == "marked" and m.seen >= m.rows for m in told) and len({m.batch for m in told}) == 4
    assert list(marks.marks) == told[-1_000:] and list(marks.ended.values()) == [None]


def test_histories_equal_the_batch_form_after_restarts(spark, sf_dir, tmp_path):
    src = stream_of(spark, sf_dir, tmp_path)
    files = sorted(src.glob("part-*"))
    held = [(p, p.read_bytes()) for p in files[1:]]
    for p, _ in held:
        p.unlink()
        (src / f".{p.name}.crc").unlink(missing_ok=True)
    out, cp = str(tmp_path / "tails"), str(tmp_path / "cp")
    history.run_histories(monitor.events(spark, str(src)), out, cp, size=5).awaitTermination(60)
    for p, content in held:  # more files, and the query starts again
        p.write_bytes(content)
        history.run_histories(monitor.events(spark, str(src)), out, cp, size=5).awaitTermination(60)
    got = {r.key: (r.held, r["mean"], [tuple(e) for e in r.tail]) for r in history.latest_tails(spark, out).collect()}
    want = {r.key: (r.held, r["mean"], [tuple(e) for e in r.tail]) for r in history.last_values(table(spark, sf_dir, "events"), size=5).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][2] == want[k][2] and got[k][1] == pytest.approx(want[k][1])
    history.export_tail(history.latest_tails(spark, out), str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export" / "tails")).count() == len(want)
    meta = spark.read.json(str(tmp_path / "export" / "metadata")).first()
    assert meta["keys"] == len(want) and meta["values"] == sum(v[0] for v in want.values())


def test_histories_time_out():
    """A key without values for the time limit loses its state."""

    class State:
        hasTimedOut, exists, get, timeout = False, False, None, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, ms):
            self.timeout = ms

    state, run = State(), history._tail(2, 1_000)
    rows = pd.DataFrame({"t": [3, 1, 2], "id": [1, 1, 1], "value": [0.3, 0.1, 0.2]})
    (got,) = run(("k",), iter([rows]), state)
    assert got["held"][0] == 2 and [e["t"] for e in got["tail"][0]] == [2, 3] and state.get == ([2, 3], [1, 1], [0.2, 0.3]) and state.timeout == 1_000
    state.hasTimedOut = True
    assert list(run(("k",), iter([]), state)) == [] and not state.exists


def test_bounded_history(spark, sf_dir, tmp_path):
    src = stream_of(spark, sf_dir, tmp_path)
    q = monitor.bounded_history(monitor.events(spark, str(src), files=10), 3).writeStream.format("memory").queryName("bounded").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.user_id: (r.held, r["mean"]) for r in spark.table("bounded").collect()}
    want = {r.key: (r.held, r["mean"]) for r in history.last_values(table(spark, sf_dir, "events").where(F.col("value").isNotNull()), size=3).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)
