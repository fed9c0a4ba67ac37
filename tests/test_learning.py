"""Learning queries: what must hold of their results, and brute force where there is one."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from riskloom.operators import engineering as fe
from riskloom.operators import evaluation as ev
from riskloom.operators import learning as ml
from riskloom.plans import learning as plans
from riskloom.plans.base import frame
from riskloom.plans.registry import queries
from riskloom.session import table


def area(p, y):
    p, y = np.array(p), np.array(y)
    pos, neg = p[y == 1], p[y == 0]
    return float(((pos[:, None] > neg[None, :]).sum() + (pos[:, None] == neg[None, :]).sum() / 2) / (len(pos) * len(neg)))


def test_out_of_fold_scores(spark, sf_dir):
    """Every training row once, by a model that never saw it; a fold's area by brute force."""
    train, _ = plans.halves(spark, sf_dir)
    learner = ml.learners()["logistic"]
    found = ml.out_of_fold(train, learner, "label", "vec_id").collect()
    assert sorted(r.vec_id for r in found) == sorted(r.vec_id for r in train.select("vec_id").collect())
    here = ml.in_fold("vec_id", 5) == 2
    want = {r.vec_id: r.p_x for r in ml.score_all({"x": learner.fit(train.where(~here))}, train.where(here)).collect()}
    assert all(abs(r.p - want[r.vec_id]) < 1e-6 for r in found if r.vec_id in want)
    label = {r.vec_id: r.label for r in train.select("vec_id", "label").collect()}
    got = {r.fold: r.auc for r in queries()["fold_areas"](spark, sf_dir).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    if len({label[i] for i in want}) == 2:
        assert got[2] == pytest.approx(area([round(p, 9) for p in want.values()], [label[i] for i in want]), abs=1e-3)


def test_calibration(spark, sf_dir):
    got = {r.method: r.brier for r in queries()["isotonic_calibration"](spark, sf_dir).collect()}
    assert set(got) == {"none", "isotonic", "sigmoid"} and all(0 <= b < 0.25 for b in got.values())
    d = spark.createDataFrame([(i, p, float(i % 10 < 10 * p * p)) for i in range(400) for p in (0.1, 0.4, 0.6, 0.9)], "i long, p double, label double")
    s = ml.calibrate(d, d, "p", "label").groupBy("p").agg(F.avg("calibrated").alias("c"), F.avg("label").alias("y")).collect()
    assert all(abs(r.c - r.y) < 1e-9 for r in s)  # monotone here, so isotonic gives the shares themselves


def test_intervals_and_votes(spark, sf_dir):
    rows = queries()["prediction_intervals"](spark, sf_dir).collect()
    assert all(0 <= r.lo <= r["mean"] <= r.hi <= 1 for r in rows) and any(r.std > 0 for r in rows)
    votes = queries()["vote_contributions"](spark, sf_dir).collect()
    assert votes and all(abs(r.p - r.part_boosted - r.part_forest - r.part_logistic) < 1e-8 for r in votes)
    mean = queries()["bootstrap_uncertainty"](spark, sf_dir).first()
    whole = frame(spark, sf_dir).agg(F.avg("ml")).first()[0]
    assert mean.lo <= whole <= mean.hi and mean.std > 0


def test_ensembles(spark, sf_dir):
    m = queries()["ensemble_metrics"](spark, sf_dir).first()
    _, test = plans.halves(spark, sf_dir)
    assert m.tp + m.fp + m.fn + m.tn == test.count() and 0 <= m.brier <= 1 and m.accuracy == pytest.approx((m.tp + m.tn) / test.count())
    w = queries()["ensemble_weights"](spark, sf_dir).collect()
    assert {r.model for r in w} == {"boosted", "forest", "logistic"} and sum(r.weight for r in w) == pytest.approx(1.0)
    s = spark.createDataFrame([(float(i % 2), (i % 2) * 0.8 + 0.1, 0.5) for i in range(40)], "label double, p_a double, p_b double")
    assert ml.best_weights(s, ["a", "b"], "label")[1] == 1.0


def test_searches_and_reports(spark, sf_dir):
    t = queries()["tuning_trials"](spark, sf_dir).orderBy("trial").collect()
    assert [r.best for r in t] == list(np.maximum.accumulate([r.auc for r in t]))
    a = {r.without: r for r in queries()["group_ablation"](spark, sf_dir).collect()}
    assert set(a) == {"all", "size", "findings", "scores"} and all(r.lost == pytest.approx(a["all"].auc - r.auc) for r in a.values())
    i = queries()["importance_comparison"](spark, sf_dir).collect()
    assert len(i) == len(plans.COLUMNS) and sorted(r.boosted_rank for r in i) == list(range(1, len(i) + 1)) and sum(r.forest_importance for r in i) == pytest.approx(1.0)
    p = queries()["source_prediction"](spark, sf_dir).collect()
    assert {r.feature for r in p} == set(plans.TEXT_FEATURES) and all(r.proxy == (r.importance > 0.015) for r in p) and len({r.auc for r in p}) == 1


def test_augmented_rows(spark, sf_dir):
    """Mixes lie between rows, noise is the same in any partitioning, new minority rows lie on a segment between two of the class."""
    f = frame(spark, sf_dir)
    lo, hi = (f.agg(*[g(c).alias(c) for c in ("num_external_calls", "max_complexity", "lines_of_code")]).first() for g in (F.min, F.max))
    mixed = queries()["mixup_rows"](spark, sf_dir).collect()
    assert mixed and all(lo[c] - 1e-9 <= r[c] <= hi[c] + 1e-9 for r in mixed for c in lo.asDict()) and any(0 < r.risky < 1 for r in mixed)
    d = f.select("id", "risky", F.col("lines_of_code").cast("double").alias("lines_of_code"))
    one, two = (sorted((r.id, r.risky, round(r.lines_of_code, 6)) for r in fe.jitter(x, ["lines_of_code"], "id").collect()) for x in (d, d.repartition(7)))
    assert one == two
    seen = Counter(r.id for r in d.collect())
    before = {r.id: r.lines_of_code if seen[r.id] == 1 else 0 for r in d.collect()}  # some ids stand twice
    noise = [r[2] - before[r[0]] for r in one if before[r[0]] > 300]
    spread = d.agg(F.stddev_pop("lines_of_code")).first()[0]
    assert abs(np.mean(noise)) < 0.02 * spread and 0.8 < np.std(noise) / (0.05 * spread) < 1.2
    e = table(spark, sf_dir, "embeddings").where("label = 0").collect()
    own = np.array([r.embedding for r in e], float)
    new = queries()["smote_rows"](spark, sf_dir).limit(20).collect()
    name = next(k for k, v in new[0].asDict().items() if isinstance(v, list))
    for r in new[:5]:
        v = np.array(r[name], float)
        gap = np.linalg.norm(own - v, axis=1)
        a = own[gap.argmin()]
        along = [np.linalg.norm((v - a) - ((v - a) @ (b - a)) / max((b - a) @ (b - a), 1e-12) * (b - a)) for b in own]
        assert min(along) < 1e-5


def test_ranks_within_classes(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(500)] + [(i, None) for i in range(500, 520)]
    df = spark.createDataFrame(rows, "id long, y string")
    got = fe.hash_ranks(df, "y", "id").collect()
    for y, n in (("a", 333), ("b", 167), (None, 20)):
        assert sorted(r._k for r in got if r.y == y) == list(range(1, n + 1)) and {r._n for r in got if r.y == y} == {n}
    small = fe.split(spark.createDataFrame([(1, "a")] + [(i, "b") for i in range(2, 42)], "id long, y string"), "y", "id").collect()
    assert len(small) == 41 and {r.split for r in small} == {"train", "val", "test"}


def test_source_prediction_stores_features(spark, sf_dir, monkeypatch):
    """Texts are turned into numbers once, before the learner's passes; the numbers are plain counts."""
    seen = []

    def stop(df, name):
        seen.append(df)
        raise InterruptedError(name)

    monkeypatch.setattr(plans, "kept", stop)
    with pytest.raises(InterruptedError):
        queries()["source_prediction"](spark, sf_dir)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in seen[0].collect():
        t = texts[r.doc_id]
        if t is not None and t.isascii():
            assert (r.n_chars, r.n_digits, r.n_upper) == (len(t), sum(c.isdigit() for c in t), sum(c.isupper() for c in t)) and r.n_marks == sum(not (c.isalnum() or c in "_ \t\n\r\x0b\x0c") for c in t)


def test_counted_rows_fit_the_same_models(spark):
    """Rows that are alike are one row with a weight: areas and trials are those of the rows one by one, however many copies there are."""
    rng = np.random.default_rng(3)
    x, z = rng.integers(0, 4, 900), rng.integers(0, 3, 900)
    y = rng.random(900) < 0.2 + 0.15 * x
    rows = spark.createDataFrame([(int(i), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))], "id int, x double, z double, label double")
    few = ml.counted(rows, ["x", "z"], "label")
    assert few.count() <= 24 and few.groupBy().sum("times").first()[0] == 900
    train, test = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    got = dict(ml.ablation(train, test, {"a": ["x"], "b": ["z"]}, "label"))
    for name, columns in {"all": ["x", "z"], "a": ["z"], "b": ["x"]}.items():
        m = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01).fit(ml.assembled(train, columns))
        s = ml.score_all({"x": m}, ml.assembled(test, columns)).select(F.round("p_x", 9).alias("p"), "label")
        assert got[name] == pytest.approx(ev.auc(s, "p", "label").first()[0], abs=1e-6)
    dealt = rows.withColumn("fold", F.col("id") % 2)
    one = ml.tune(ml.assembled(dealt, ["x", "z"]), "label", 2, fold="fold")[1]
    two = ml.tune(ml.assembled(ml.counted(dealt, ["x", "z"], "label", "fold"), ["x", "z"]), "label", 2, fold="fold", weight="times")[1]
    assert [a for _, a in one] == pytest.approx([a for _, a in two], abs=1e-3) and len(one) == 6
