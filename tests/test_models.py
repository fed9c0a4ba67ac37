"""Search, ensemble weights, attribution and evaluation of models against brute force."""

import math
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from riskloom.operators import attribution, search, weights
from riskloom.operators import evaluation as ev
from riskloom.operators import learning as ml
from riskloom.plans import learning as plans
from riskloom.plans import models
from riskloom.plans.registry import queries


def area(p, y):
    p, y = np.array(p, float), np.array(y, float)
    pos, neg = p[y == 1], p[y != 1]
    return None if not len(pos) or not len(neg) else float(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)))


# search


def bowl(name, s):
    """A made-up area with its top of 0.95 at the boosted learner near depth 4 and a step of 0.1."""
    top = {"boosted": 0.95, "forest": 0.9, "logistic": 0.85}[name]
    off = {"boosted": lambda: 0.02 * abs(s["maxDepth"] - 4) + 0.04 * abs(math.log(s["stepSize"] / 0.1)), "forest": lambda: 0.01 * abs(s["maxDepth"] - 6), "logistic": lambda: 0.02 * abs(math.log10(s["regParam"]) + 2)}[name]
    return top - off()


def test_search_beats_the_grid_and_chance():
    """At as many fits, over seeds: better than a grid of six settings in the same space, and than random draws."""
    grid = max(bowl("logistic", {"regParam": r}) for r in (0.001, 0.01, 0.1))
    ours, chance = [], []
    for seed in range(10):
        sampler = search.Sampler(search.SPACE, startup=8, seed=seed)
        ours.append(max(t.value for t in search.optimise(lambda n, s: [bowl(n, s)], search.SPACE, 40, sampler)))
        blind = search.Sampler(search.SPACE, startup=10**6, seed=seed)
        chance.append(max(t.value for t in search.optimise(lambda n, s: [bowl(n, s)], search.SPACE, 40, blind)))
    assert np.mean(ours) > np.mean(chance) and min(ours) > grid and np.mean(ours) > 0.935


def test_settings_stay_in_range():
    trials = search.optimise(lambda n, s: [bowl(n, s)], search.SPACE, 60, search.Sampler(search.SPACE, startup=5))
    assert len({t.learner for t in trials}) == 3
    for t in trials:
        for k, r in search.SPACE[t.learner].items():
            assert r.low <= t.settings[k] <= r.high and (not r.whole or t.settings[k] == int(t.settings[k]))


def test_pruned_trials_stop_early():
    calls = []

    def steps(name, s):
        bad = len(calls) >= 6  # all trials after the sixth
        calls.append([])
        for i in range(5):
            calls[-1].append(i)
            yield 0.5 if bad else 0.8 + 0.01 * i

    trials = search.optimise(steps, search.SPACE, 8, prune_startup=5, prune_warmup=1)
    assert [t.state for t in trials] == ["complete"] * 6 + ["pruned"] * 2
    assert [len(c) for c in calls] == [5] * 6 + [2] * 2 and len(trials[-1].scores) == 2


def test_density_is_one():
    for values in ([], [0.2], [0.1, 0.1, 0.9], [0.0, 1.0]):
        d = search.Density(values, 0.0, 1.0)
        x = np.linspace(0, 1, 4001)
        assert np.trapezoid([math.exp(d.log_density(v)) for v in x], x) == pytest.approx(1.0, abs=1e-3)


def test_search_on_spark(spark, sf_dir):
    """A trial's scores are the areas of its learner fitted fold by fold; the tables add up."""
    train, _ = plans.halves(spark, sf_dir)
    trials = search.search(train, "label", "vec_id", trials=6, folds=2, space=models.SMALL, startup=4)
    t = trials[-1]
    fold = ml.in_fold("vec_id", 2) == 0
    n, pos = train.count(), train.where("label = 1").count()
    weighted = train.withColumn("_weight", F.when(F.col("label") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos))))
    model = search.learner(t.learner, t.settings, "label", "_weight").fit(weighted.where(~fold))
    rows = ml.score_all({"x": model}, weighted.where(fold)).collect()
    assert t.scores[0] == pytest.approx(area([round(r.p_x, 9) for r in rows], [r.label for r in rows]), abs=0.02)
    table = search.trial_table(spark, trials)
    got = table.orderBy("trial").collect()
    assert [r.best for r in got if r.best is not None] == sorted(r.best for r in got if r.best is not None) and got[-1].best == max(x.value for x in trials if x.state == "complete")
    whole = {r.learner: r for r in search.trial_summary(table).collect()}
    assert whole[None].trials == 6 and sum(r.trials for k, r in whole.items() if k) == 6 and whole[None].most == got[-1].best and trials[whole[None].best_trial].value == got[-1].best
    named = search.setting_importance(table, t.learner).collect()
    assert {r.setting for r in named} == set(models.SMALL[t.learner])
    assert search.setting_importance(table, "nothing").collect() == []


# weights


def test_projection():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v = rng.normal(size=4)
        w = weights.projected(v)
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        for _ in range(20):
            other = rng.dirichlet(np.ones(4))
            assert ((v - w) ** 2).sum() <= ((v - other) ** 2).sum() + 1e-12


def members(seed, n=1500):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(float)
    signal = rng.normal(size=(n, 3))
    squash = lambda x: 1 / (1 + np.exp(-x))
    return y, np.stack([squash(1.2 * y + signal[:, 0]), squash(0.9 * y + 0.3 * signal[:, 0] + signal[:, 1]), 0.48 + 0.04 * squash(0.5 * y + 2 * signal[:, 2])], axis=1)


@pytest.mark.parametrize("seed", [0, 1])
def test_weights_reach_the_fine_grid(spark, seed):
    """Within 0.001 of the best of all weights in steps of 0.01, by exact areas."""
    y, p = members(seed)
    df = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(y, p, strict=True)] + [(1.0, None, 0.5, 0.5), (None, 0.1, 0.5, 0.5)], "label double, p_a double, p_b double, p_c double")
    w, _, jobs = weights.best_weights(df, ["a", "b", "c"], "label")

    def exact(v):
        s = p @ v
        order = np.argsort(np.argsort(s)) + 1
        pos = y == 1
        return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())

    best = max(exact(np.array([i, j, 100 - i - j]) / 100) for i in range(101) for j in range(101 - i))
    got = np.array([w[k] for k in "abc"])
    assert got.min() >= 0 and got.sum() == pytest.approx(1) and exact(got) >= best - 1e-3 and jobs <= 21


def test_gradient_of_the_smooth_area(spark):
    y, p = members(3, 300)
    df = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(y, p, strict=True)], "label double, p_a double, p_b double, p_c double")
    w, h = np.array([0.41, 0.33, 0.26]), 1e-7
    found = weights.smooth_areas(df, ["p_a", "p_b", "p_c"], "label", [w, *[w + h * e for e in np.eye(3)]], 0.0, 1.0)
    assert found[0][1] == pytest.approx([(found[i + 1][0] - found[0][0]) / h for i in range(3)], abs=1e-4)
    s = p @ w
    assert found[0][0] == pytest.approx(area(s, y), abs=2e-3)


def test_weights_without_rows(spark):
    df = spark.createDataFrame([], "label double, p_a double, p_b double")
    assert weights.best_weights(df, ["a", "b"], "label")[:2] == ({"a": 0.5, "b": 0.5}, 0.0)
    one = spark.createDataFrame([(1.0, 0.2, 0.4)], "label double, p_a double, p_b double")
    w, a, _ = weights.best_weights(one, ["a", "b"], "label")
    assert a == 0 and sum(w.values()) == pytest.approx(1)


# attribution


def rows_of(spark, n=300, categories=False):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 4)).round(2)
    if categories:
        x[:, 3] = rng.integers(0, 5, n)
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2) ^ (x[:, 3] > 1)).astype(float)
    return spark.createDataFrame([(i, float(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, x, strict=True))], "id long, label double, x array<double>").withColumn("features", array_to_vector("x"))


def expected(node, x, known, value):
    """The tree's expectation with the features in `known` known, by a walk of the JVM's nodes."""
    if node.getClass().getSimpleName() == "LeafNode":
        return value(node)
    split, parts = node.split(), (node.leftChild(), node.rightChild())
    f = split.featureIndex()
    if f in known:
        if split.getClass().getSimpleName() == "ContinuousSplit":
            return expected(parts[0] if x[f] <= split.threshold() else parts[1], x, known, value)
        return expected(parts[0] if x[f] in set(split.leftCategories()) else parts[1], x, known, value)
    n = node.impurityStats().count()
    return sum(p.impurityStats().count() / n * expected(p, x, known, value) for p in parts)


def by_subsets(trees, x, value):
    out = []
    for i in range(len(x)):
        rest = [j for j in range(len(x)) if j != i]
        total = 0.0
        for k in range(len(rest) + 1):
            share = math.factorial(k) * math.factorial(len(x) - k - 1) / math.factorial(len(x))
            for s in combinations(rest, k):
                total += share * sum(w * (expected(t, x, {*s, i}, value) - expected(t, x, set(s), value)) for t, w in trees)
        out.append(total)
    return out


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "regression", "categories"])
def test_shapley_by_enumeration(spark, kind):
    df = rows_of(spark, categories=kind == "categories")
    if kind == "categories":
        from pyspark.ml.feature import VectorIndexer

        df = VectorIndexer(inputCol="features", outputCol="f2", maxCategories=5).fit(df).transform(df).drop("features").withColumnRenamed("f2", "features")
    learner = {"tree": DecisionTreeClassifier(maxDepth=3), "forest": RandomForestClassifier(numTrees=3, maxDepth=3, seed=1), "boosted": GBTClassifier(maxIter=3, maxDepth=3, seed=1), "regression": DecisionTreeRegressor(maxDepth=3), "categories": DecisionTreeClassifier(maxDepth=3)}[kind]
    model = learner.fit(df)
    names = ["a", "b", "c", "d"]
    made = attribution.attribute(model, model.transform(df), names).orderBy("id")
    rows = made.limit(12).collect()
    java = model._java_obj
    many = hasattr(model, "trees")
    every = list(zip(java.trees(), java.treeWeights(), strict=True)) if many else [(java, 1.0)]
    every = [(t.rootNode(), w if kind == "boosted" or not many else w / len(every)) for t, w in every]
    value = (lambda n: float(n.prediction())) if kind in ("boosted", "regression") else (lambda n: n.impurityStats().stats()[1] / sum(n.impurityStats().stats()))
    for r in rows:
        got = {e.feature: e.contribution for e in r.contributions}
        assert [got[n] for n in names] == pytest.approx(by_subsets(every, r.x, value), abs=1e-9)
        assert [abs(e.contribution) for e in r.contributions] == sorted((abs(e.contribution) for e in r.contributions), reverse=True)
        whole = r.base + sum(got.values())
        want = r.prediction if kind == "regression" else r.probability[1]
        assert (1 / (1 + math.exp(-2 * whole)) if kind == "boosted" else whole) == pytest.approx(want, abs=1e-9)


def test_attribution_query(spark, sf_dir):
    rows = queries()["tree_attribution"](spark, sf_dir).collect()
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, []).append(r)
    assert by and all(len(v) <= 5 and [x.place for x in sorted(v, key=lambda x: -abs(x.contribution))] == sorted(x.place for x in v) for v in by.values())
    assert attribution.attribute(DecisionTreeClassifier(maxDepth=1).fit(rows_of(spark)), rows_of(spark).where("false"), list("abcd")).collect() == []


# evaluation


def test_fold_metrics_by_brute_force(spark, sf_dir):
    train, _ = plans.halves(spark, sf_dir)
    learner = LogisticRegression(featuresCol="scaled", labelCol="label", regParam=0.01)
    scored = ml.fold_scores(train, learner, "label", "vec_id").withColumn("p", F.round("p", 9)).persist()
    rows = scored.collect()
    assert sorted(r.vec_id for r in rows) == sorted(r.vec_id for r in train.select("vec_id").collect())
    ones = [sum(r.label for r in rows if r.fold == f) for f in range(5)]
    assert max(ones) - min(ones) <= 1  # stratified
    got = {r.fold: r for r in ml.fold_metrics(scored, "label").collect()}
    assert set(got) == {None, 0, 1, 2, 3, 4}
    for f, r in got.items():
        own = [x for x in rows if f is None or x.fold == f]
        p, y = np.array([x.p for x in own]), np.array([x.label for x in own])
        assert r.n == len(own) and r.positives == (y == 1).sum() and r.auc == pytest.approx(area(p, y)) and r.accuracy == pytest.approx(((p > 0.5) == (y == 1)).mean()) and r.brier == pytest.approx(((p - y) ** 2).mean())
    # the scaler is the other folds' own
    means = train.join(scored.select("vec_id", "fold"), "vec_id").where("fold != 0").select(*[F.avg(F.col("embedding")[i]).alias(str(i)) for i in range(2)]).first()
    from pyspark.ml.feature import StandardScaler

    fitted = StandardScaler(inputCol="features", outputCol="s", withMean=True).fit(train.join(scored.select("vec_id", "fold"), "vec_id").where("fold != 0"))
    assert list(fitted.mean[:2]) == pytest.approx(list(means))


def test_areas_of_groups(spark):
    """Scores that crowd, ties, one class only, nulls."""
    rng = np.random.default_rng(2)
    rows = [(g, float(s), float(y)) for g in range(3) for s, y in zip(np.where(rng.random(400) < 0.1, 1e6, rng.random(400).round(2)), rng.random(400) < 0.4, strict=True)]
    rows += [(7, 0.5, 1.0), (7, 0.4, 1.0), (8, None, 1.0), (8, 0.3, 0.0)]
    got = {r._g: r.auc for r in ev.areas(spark.createDataFrame(rows, "g int, s double, y double"), ["g"], "s", "y").collect()}
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        assert got[g] == pytest.approx(area([r[1] for r in own], [r[2] for r in own]), rel=1e-12)
    assert got[7] is None and got[8] is None


def test_holdout_rows(spark, sf_dir):
    rows = queries()["holdout_correctness"](spark, sf_dir).collect()
    _, test = plans.halves(spark, sf_dir)
    label = {r.vec_id: int(r.label) for r in test.select("vec_id", "label").collect()}
    assert {(r.vec_id, r.model) for r in rows} == set(product(label, ("boosted", "forest", "logistic")))
    assert all(r.label == label[r.vec_id] and r.predicted == int(r.p > 0.5) and r.correct == (r.predicted == r.label) for r in rows)


def test_model_queries(spark, sf_dir):
    t = queries()["adaptive_search"](spark, sf_dir).orderBy("trial").collect()
    assert len(t) == 12 and all(0 <= r.value <= 1 and len(r.scores) == 3 for r in t if r.state == "complete")
    w = queries()["optimised_weights"](spark, sf_dir).collect()
    assert {r.model for r in w} == {"boosted", "forest", "logistic"} and sum(r.weight for r in w) == pytest.approx(1.0) and all(r.weight >= 0 for r in w)
    single, held, _ = models._members(spark, sf_dir)
    alone = [ev.auc(held.select(F.round(f"p_{n}", 9).alias("p"), "label"), "p", "label").first()[0] for n in single]
    assert w[0].validation_auc >= max(alone) - 2e-3
