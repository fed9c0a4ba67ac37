"""Adaptive search of a learner and its settings: a tree-structured Parzen sampler with median pruning.

The fits are Spark's: a trial fits its learner on all folds but one and takes the area under the curve
on that one, fold by fold, so a trial that falls behind the median of the earlier ones at the same fold
stops there. What the driver holds is the history, a few numbers a trial.

The learner is drawn by its share of the best trials, one added to each. The sampler parts the learner's
own trials into the best and the rest; each of its settings gets a Parzen density of either part, a
Gaussian at each value as wide as the gap to its neighbours plus one over the whole range, and of
several draws from the best part's density the one with the largest ratio of both is taken. Settings on
a logarithmic scale are sampled on it, whole ones are rounded.

A fold without rows of either class counts as 0.5. Ties go to the earlier trial.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators import evaluation as ev
from riskloom.operators import learning as ml


@dataclass(frozen=True)
class Range:
    """A setting's bounds, both included."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inner(self, value: float) -> float:
        return math.log(value) if self.log else float(value)

    def outer(self, x: float) -> float:
        value = min(max(math.exp(x) if self.log else x, self.low), self.high)
        return float(round(value)) if self.whole else value

    @property
    def ends(self) -> tuple[float, float]:
        """Of the scale that is sampled on; whole settings have half a step more at each end."""
        more = 0.5 if self.whole and not self.log else 0.0
        return self.inner(self.low) - more, self.inner(self.high) + more


Space = dict[str, dict[str, Range]]  # learner -> setting -> range

SPACE: Space = {
    "boosted": {"maxIter": Range(5, 30, whole=True), "maxDepth": Range(2, 6, whole=True), "stepSize": Range(0.01, 0.3, log=True), "subsamplingRate": Range(0.6, 1.0), "minInstancesPerNode": Range(1, 10, whole=True)},
    "forest": {"numTrees": Range(10, 50, whole=True), "maxDepth": Range(3, 10, whole=True), "minInstancesPerNode": Range(1, 10, whole=True), "subsamplingRate": Range(0.6, 1.0)},
    "logistic": {"regParam": Range(1e-4, 1.0, log=True), "elasticNetParam": Range(0.0, 1.0)},
}


@dataclass
class Trial:
    number: int
    learner: str
    settings: dict[str, float]
    scores: list[float] = field(default_factory=list)  # by fold
    state: str = "running"

    @property
    def value(self) -> float:
        return statistics.fmean(self.scores) if self.scores else 0.0


class Density:
    """A Parzen mixture on an interval: a Gaussian for each value, cut at the ends, and a wide one."""

    def __init__(self, values: Iterable[float], low: float, high: float):
        middle = (low + high) / 2
        at = np.sort(np.array([*values, middle], float))
        self.low, self.high, wide = low, high, max(high - low, 1e-12)
        gaps = np.diff(np.concatenate([[low], at, [high]]))
        width = np.clip(np.maximum(gaps[:-1], gaps[1:]), wide / min(100, len(at) + 1), wide)
        width[np.searchsorted(at, middle)] = wide
        self.at, self.width = at, width
        self.share = np.array([_below((high - a) / w) - _below((low - a) / w) for a, w in zip(at, width, strict=True)])

    def draw(self, rng: np.random.Generator) -> float:
        k = rng.integers(len(self.at))
        while True:
            x = rng.normal(self.at[k], self.width[k])
            if self.low <= x <= self.high:
                return float(x)

    def log_density(self, x: float) -> float:
        z = (x - self.at) / self.width
        return float(np.log(np.mean(np.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * self.width * self.share) + 1e-300)))


def _below(z: float) -> float:
    return (1 + math.erf(z / math.sqrt(2))) / 2


class Sampler:
    """Proposes a learner and its settings from the trials so far."""

    def __init__(self, space: Space, startup: int = 10, best: float = 0.2, draws: int = 24, seed: int = 42):
        self.space, self.startup, self.best, self.draws = space, startup, best, draws
        self.rng = np.random.default_rng(seed)

    def propose(self, trials: list[Trial]) -> tuple[str, dict[str, float]]:
        done = sorted((t for t in trials if t.scores), key=lambda t: (-len(t.scores) if t.state == "pruned" else -math.inf, -t.value, t.number))
        names = list(self.space)
        if len(done) < self.startup:
            name = names[self.rng.integers(len(names))]
            return name, {k: r.outer(self.rng.uniform(*r.ends)) for k, r in self.space[name].items()}
        best = lambda part: part[: max(1, math.ceil(self.best * len(part)))]
        share = np.array([1.0 + sum(t.learner == x for t in best(done)) for x in names])
        name = names[self.rng.choice(len(names), p=share / share.sum())]
        own = [t for t in done if t.learner == name]
        return name, {k: self._setting(k, r, best(own), own[len(best(own)) :]) for k, r in self.space[name].items()}

    def _setting(self, key: str, r: Range, good: list[Trial], rest: list[Trial]) -> float:
        of = lambda part: Density((r.inner(t.settings[key]) for t in part), *r.ends)
        near, far = of(good), of(rest)
        tried = [near.draw(self.rng) for _ in range(self.draws)]
        return r.outer(max(tried, key=lambda x: near.log_density(x) - far.log_density(x)))


def behind(trial: Trial, trials: list[Trial], startup: int, warmup: int) -> bool:
    """Is the trial's mean so far below the median of the others' means at the same fold?"""
    step = len(trial.scores)
    if step <= warmup or sum(t.state == "complete" for t in trials) < startup:
        return False
    others = [statistics.fmean(t.scores[:step]) for t in trials if t is not trial and len(t.scores) >= step]
    return bool(others) and trial.value < statistics.median(others)


def optimise(steps: Callable[[str, dict[str, float]], Iterable[float]], space: Space, trials: int, sampler: Sampler | None = None, prune_startup: int = 5, prune_warmup: int = 1) -> list[Trial]:
    """Runs `trials` trials; `steps` gives a trial's scores one after another and is left when the trial is pruned."""
    sampler = sampler or Sampler(space)
    history: list[Trial] = []
    for i in range(trials):
        t = Trial(i, *sampler.propose(history))
        history.append(t)
        t.state = "complete"
        for score in steps(t.learner, t.settings):
            t.scores.append(score)
            if behind(t, history, prune_startup, prune_warmup):
                t.state = "pruned"
                break
    return history


def learner(name: str, settings: dict[str, float], label: str, weight: str | None = None):
    """Spark's learner with these settings."""
    kind = {"boosted": GBTClassifier, "forest": RandomForestClassifier, "logistic": LogisticRegression}[name]
    made = kind(featuresCol="features", labelCol=label, **({"weightCol": weight} if weight else {}))
    if name != "logistic":
        made.setSeed(42)
    for key, value in settings.items():
        made.set(made.getParam(key), int(value) if SPACE.get(name, {}).get(key, Range(0, 0)).whole else value)
    return made


def search(train: DataFrame, label: str, key: str, trials: int = 30, folds: int = 5, space: Space = SPACE, startup: int = 10, seed: int = 42) -> list[Trial]:
    """Trials over `train` (features, label, key): areas on folds by a hash of the key, rows weighted to balance the classes."""
    fold = ml.in_fold(key, folds)
    sums = train.groupBy(label).count().collect()  # two rows
    n = {float(r[0]): r[1] for r in sums if r[0] is not None}
    weight = F.when(F.col(label) == 1, sum(n.values()) / (2.0 * max(n.get(1.0, 0), 1))).otherwise(sum(n.values()) / (2.0 * max(n.get(0.0, 0), 1)))
    rows = train.where(F.col(label).isNotNull()).select("features", label, fold.alias("_fold"), weight.alias("_weight")).persist()

    def steps(name: str, settings: dict[str, float]) -> Iterable[float]:
        for i in range(folds):
            model = learner(name, settings, label, "_weight").fit(rows.where(F.col("_fold") != i))
            scored = ml.score_all({"x": model}, rows.where(F.col("_fold") == i)).select(F.round("p_x", 9).alias("p"), label)
            area = ev.auc(scored, "p", label).first()[0]
            yield 0.5 if area is None or area != area else float(area)

    try:
        return optimise(steps, space, trials, Sampler(space, startup, seed=seed), prune_startup=min(5, startup))
    finally:
        rows.unpersist()


def trial_table(spark: SparkSession, trials: list[Trial]) -> DataFrame:
    """trial, learner, settings (a map), scores by fold, value, state, and the best complete value so far."""
    rows = [(t.number, t.learner, {k: float(v) for k, v in t.settings.items()}, [float(x) for x in t.scores], float(t.value), t.state) for t in trials]
    made = spark.createDataFrame(rows, "trial int, learner string, settings map<string, double>, scores array<double>, value double, state string")
    so_far = Window.partitionBy(F.lit(0)).orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as trials
    return made.withColumn("best", F.max(F.when(F.col("state") == "complete", F.col("value"))).over(so_far))


def trial_summary(trials: DataFrame) -> DataFrame:
    """learner (null: all), trials, pruned, mean, std, least and most of the values, and the trial that is best."""
    done = F.when(F.col("state") == "complete", F.col("value"))
    columns = [
        F.count("*").alias("trials"), F.count_if(F.col("state") == "pruned").alias("pruned"), F.avg(done).alias("mean"), F.stddev(done).alias("std"), F.min(done).alias("least"), F.max(done).alias("most"),
        F.max_by("trial", F.struct(done.alias("v"), -F.col("trial"))).alias("best_trial"), F.max_by("settings", F.struct(done.alias("v"), -F.col("trial"))).alias("best_settings"),
    ]
    return trials.groupBy("learner").agg(*columns).unionByName(trials.agg(F.lit(None).cast("string").alias("learner"), *columns))


def setting_importance(trials: DataFrame, name: str) -> DataFrame:
    """setting, importance: how much of the values' spread a forest over the learner's settings explains by each, summing to one."""
    own = trials.where((F.col("learner") == name) & (F.size("scores") > 0))
    keys = sorted({k for r in own.select(F.map_keys("settings").alias("k")).distinct().collect() for k in r.k})  # the learner's settings
    if not keys:
        return trials.sparkSession.createDataFrame([], "setting string, importance double")
    wide = own.select("value", *[F.col("settings")[k].alias(k) for k in keys])
    model = RandomForestRegressor(labelCol="value", numTrees=30, maxDepth=4, seed=42).fit(VectorAssembler(inputCols=keys, outputCol="features").transform(wide))
    return trials.sparkSession.createDataFrame([(k, float(v)) for k, v in zip(keys, model.featureImportances.toArray(), strict=True)], "setting string, importance double")
