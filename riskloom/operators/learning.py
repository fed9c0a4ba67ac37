"""Learners, calibration and ensembles on pyspark.ml; every transformer is fitted on training rows only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators import evaluation as ev
from riskloom.operators.engineering import hash_ranks
from riskloom.operators.rounds import kept


def learners(label: str = "label", weight: str | None = None) -> dict:
    """Boosted trees, a forest, and a logistic model with an L1 penalty."""
    more = {"labelCol": label, "featuresCol": "features", **({"weightCol": weight} if weight else {})}
    return {
        "boosted": GBTClassifier(maxIter=10, maxDepth=4, seed=42, **more),
        "forest": RandomForestClassifier(numTrees=20, maxDepth=6, seed=42, **more),
        "logistic": LogisticRegression(elasticNetParam=1.0, regParam=0.005, **more),
    }


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def counted(df: DataFrame, columns: list[str], label: str, *more: str) -> DataFrame:
    """A row for each combination of the columns, with `times`, how many rows it stands for.

    Fitted with these weights, a model without a bootstrap has the same objective, and its passes no longer go over rows that are alike.
    """
    return kept(df.groupBy(*columns, label, *more).agg(F.count("*").alias("times")), "counted")


def from_array(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def fit_all(train: DataFrame, label: str = "label", weight: str | None = None) -> dict:
    return {name: m.fit(train) for name, m in learners(label, weight).items()}


def score_all(models: dict, df: DataFrame) -> DataFrame:
    """A p_<name> column for each model: the probability of class 1."""
    for name, m in models.items():
        done = m.transform(df)
        df = done.withColumn(f"p_{name}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    return df


def soft_vote(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = sum(weights.values())
    vote = sum((F.col(f"p_{n}") * F.lit(w / total) for n, w in weights.items()), F.lit(0.0))
    return df.withColumn("p", vote)


def contributions(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Each member's weighted part of the vote."""
    total = sum(weights.values())
    return df.withColumns({f"part_{n}": F.col(f"p_{n}") * F.lit(w / total) for n, w in weights.items()})


def calibrate(train: DataFrame, df: DataFrame, score: str, label: str, method: str = "isotonic") -> DataFrame:
    """`df` with a calibrated column, fitted on `train`: isotonic, or sigmoid (a logistic model of the score)."""
    if method == "isotonic":
        m = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated").fit(train)
        return m.transform(df)
    if method != "sigmoid":
        raise ValueError(method)
    m = LogisticRegression(featuresCol="_s", labelCol=label).fit(VectorAssembler(inputCols=[score], outputCol="_s").transform(train))
    done = m.transform(VectorAssembler(inputCols=[score], outputCol="_s").transform(df))
    return done.withColumn("calibrated", vector_to_array("probability")[1]).drop("_s", "probability", "rawPrediction", "prediction")


def in_fold(key: str, folds: int, seed: int = 42):
    """A row's fold, by a hash of its key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds))


def out_of_fold(train: DataFrame, learner, label: str, key: str, folds: int = 5) -> DataFrame:
    """key, p, label: every training row's score by a model that wasn't fitted on its fold."""
    parts = []
    for i in range(folds):
        here = in_fold(key, folds) == i
        parts.append(score_all({"x": learner.fit(train.where(~here))}, train.where(here)).select(key, F.col("p_x").alias("p"), label))
    return reduce(DataFrame.unionByName, parts)


def calibrated_by_folds(train: DataFrame, df: DataFrame, learner, label: str, key: str, method: str = "isotonic", folds: int = 5) -> DataFrame:
    """`df` with p, the score of a model of all training rows, and calibrated; the calibrator is fitted on out-of-fold scores only."""
    scored = score_all({"x": learner.fit(train)}, df).withColumnRenamed("p_x", "p")
    return calibrate(out_of_fold(train, learner, label, key, folds), scored, "p", label, method)


def fold_areas(train: DataFrame, learner, label: str, key: str, folds: int = 5) -> DataFrame:
    """fold, n, auc of a model fitted on the other folds."""
    scored = out_of_fold(train, learner, label, key, folds).withColumn("fold", in_fold(key, folds)).persist()
    parts = []
    for i in range(folds):
        own = scored.where(F.col("fold") == i)
        area = ev.auc(own.select(F.round("p", 9).alias("p"), label), "p", label)
        parts.append(own.agg(F.lit(i).alias("fold"), F.count("*").alias("n")).join(area, F.lit(True)))  # one row each
    return reduce(DataFrame.unionByName, parts)


def prediction_intervals(train: DataFrame, df: DataFrame, learner, key: str, rounds: int = 8, seed: int = 42) -> DataFrame:
    """`df` with mean, std, lo and hi of its scores by models of resampled training rows (Poisson weights from a hash of the key).

    `learner` takes its weights from the column `w`.
    """
    scored = df
    for i in range(rounds):
        u = (F.pmod(F.xxhash64(key, F.lit(seed + i)), F.lit(1_000_003)) + 0.5) / 1_000_003
        edges = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563]  # of Poisson's distribution with mean 1
        model = learner.fit(train.withColumn("w", sum(((u > e).cast("double") for e in edges), F.lit(0.0))).where("w > 0"))
        scored = score_all({f"b{i}": model}, scored)
    each = F.array(*[F.col(f"p_b{i}") for i in range(rounds)])
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / rounds
    with_mean = scored.withColumn("mean", mean)
    std = F.sqrt(F.aggregate(each, F.lit(0.0), lambda a, x: a + F.pow(x - F.col("mean"), F.lit(2))) / (rounds - 1))
    out = with_mean.withColumn("std", std).drop(*[f"p_b{i}" for i in range(rounds)])
    return out.withColumns({"lo": F.greatest(F.lit(0.0), F.col("mean") - 1.96 * F.col("std")), "hi": F.least(F.lit(1.0), F.col("mean") + 1.96 * F.col("std"))})


def bootstrap_interval(df: DataFrame, value: str, key: str, rounds: int = 50, seed: int = 42) -> DataFrame:
    """Mean, deviation and 95 % interval of the mean: Poisson weights, from a hash of the key, for every round in one pass."""
    out = []
    for i in range(rounds):
        u = (F.pmod(F.xxhash64(key, F.lit(seed + i)), F.lit(1_000_003)) + 0.5) / 1_000_003
        n = F.lit(0)
        edge, term = 0.0, 2.718281828459045**-1
        for k in range(6):
            edge += term
            n = n + (u > edge).cast("int")
            term /= k + 1
        out.append((F.sum(n * F.col(value)) / F.sum(n)).alias(f"m{i}"))
    means = df.agg(*out).select(F.array(*[f"m{i}" for i in range(rounds)]).alias("m"))
    sorted_means = F.sort_array("m")
    avg = F.aggregate("m", F.lit(0.0), lambda a, x: a + x) / rounds
    return means.select(avg.alias("mean"), F.sqrt(F.aggregate(F.transform("m", lambda x: F.pow(x - avg, F.lit(2))), F.lit(0.0), lambda a, x: a + x) / (rounds - 1)).alias("std"),
                        F.greatest(F.lit(0.0), sorted_means[int(rounds * 0.025)]).alias("lo"), F.least(F.lit(1.0), sorted_means[int(rounds * 0.975)]).alias("hi"))


def best_weights(df: DataFrame, names: list[str], label: str, steps: int = 4) -> tuple[dict[str, float], float]:
    """The weights, on a grid that sums to one, whose vote has the largest area under the curve."""
    def grid(k: int, left: int):
        if k == 1:
            yield (left,)
            return
        for i in range(left + 1):
            for rest in grid(k - 1, left - i):
                yield (i, *rest)

    scored = df.select(label, *[f"p_{n}" for n in names]).persist()
    best: tuple = ({}, -1.0)
    for g in grid(len(names), steps):
        w = {n: x / steps for n, x in zip(names, g, strict=True)}
        a = ev.auc(soft_vote(scored, w).select(F.round("p", 6).alias("p"), label), "p", label).first()[0] or 0.0
        if a > best[1]:
            best = (w, a)
    scored.unpersist()
    return best


def tune(train: DataFrame, label: str, folds: int = 3, fold: str | None = None, weight: str | None = None) -> tuple[dict, list[tuple[dict, float]]]:
    """Grid search of the logistic model by cross-validated area; the best settings, and every trial. `fold`: a row's fold (int); else at random."""
    more = {"weightCol": weight} if weight else {}
    lr = LogisticRegression(featuresCol="features", labelCol=label, **more)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.01, 0.1]).addGrid(lr.elasticNetParam, [0.0, 1.0]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label, **more), numFolds=folds, seed=42, parallelism=2, **({"foldCol": fold} if fold else {}))
    m = cv.fit(train)
    trials = [({p.name: v for p, v in g.items()}, a) for g, a in zip(grid, m.avgMetrics, strict=True)]
    return max(trials, key=lambda t: t[1])[0], trials


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, list[str]], label: str) -> list[tuple[str, float]]:
    """Area of the logistic model with every column, then without each group. Rows that are alike are counted, not fitted and scored one by one."""
    every = [c for g in groups.values() for c in g]
    train, test = (counted(df, every, label) for df in (train, test))
    out = []
    for name, gone in {"": [], **groups}.items():
        columns = [c for c in every if c not in gone]
        fewer = lambda df: assembled(df.groupBy(*columns, label).agg(F.sum("times").alias("times")), columns)  # noqa: E731, B023
        m = LogisticRegression(featuresCol="features", labelCol=label, regParam=0.01, weightCol="times").fit(fewer(train))
        s = score_all({"x": m}, fewer(test))
        out.append((name or "all", ev.auc(s.select(F.round("p_x", 9).alias("p_x"), label, "times"), "p_x", label, times="times").first()[0] or 0.0))
    return out


def importances(models: dict, columns: list[str], spark) -> DataFrame:
    """model, feature, importance, rank of the tree models."""
    rows = [(n, c, float(v)) for n, m in models.items() if hasattr(m, "featureImportances") for c, v in zip(columns, m.featureImportances.toArray(), strict=True)]
    df = spark.createDataFrame(rows, "model string, feature string, importance double")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.col("importance").desc(), "feature")))


def stratified_fold(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """`df` with fold: within each class, rows in the order of a hash of the key are dealt in turn."""
    return hash_ranks(df, label, key, seed).withColumn("fold", F.pmod(F.col("_k"), F.lit(folds))).drop("_k", "_n")


def fold_scores(df: DataFrame, learner, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """key, label, fold, p: each row's score by a scaler and model fitted, as one pipeline, on the other stratified folds.

    `learner` reads the column `scaled`; rows without a label take no part.
    """
    dealt = stratified_fold(df.where(F.col(label).isNotNull()), label, key, folds, seed).persist()
    parts = []
    for i in range(folds):
        line = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), learner]).fit(dealt.where(F.col("fold") != i))
        parts.append(score_all({"x": line}, dealt.where(F.col("fold") == i)).select(key, label, "fold", F.col("p_x").alias("p")))
    return reduce(DataFrame.unionByName, parts)


def fold_metrics(scored: DataFrame, label: str, fold: str = "fold") -> DataFrame:
    """fold, n, positives, auc (ties count half; null without either class), accuracy at 0.5, brier; one more row for all folds (null).

    Areas of all folds come from one pass: scores are counted by level, levels are dealt into ranges of the fold, so no window holds a whole fold.
    """
    both = scored.select(F.explode(F.array(F.col(fold).cast("int"), F.lit(None).cast("int"))).alias("fold"), F.col("p").cast("double").alias("p"), F.col(label).cast("double").alias("y"))
    plain = both.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("positives"), F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("int")).alias("accuracy"), F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("brier"))
    return plain.join(ev.areas(both, ["fold"], "p", "y"), plain["fold"].eqNullSafe(F.col("_fold")), "left").drop("_fold")


def holdout_rows(models: dict, df: DataFrame, key: str, label: str, threshold: float = 0.5) -> DataFrame:
    """A row for each held-out row and model: key, model, label, p, predicted, correct."""
    scored = score_all(models, df)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("p")) for n in models])).alias("m")
    predicted = (F.col("m.p") > threshold).cast("int")
    return scored.select(key, F.col(label).cast("int").alias("label"), each).select(key, "m.model", "label", "m.p", predicted.alias("predicted"), (predicted == F.col("label")).alias("correct"))
