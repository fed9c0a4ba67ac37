"""Search, ensemble weights, attribution and evaluation of models, fitted on the training part of a hash split."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from riskloom.operators import attribution, search, weights
from riskloom.operators import evaluation as ev
from riskloom.operators import learning as ml
from riskloom.plans.base import Plan
from riskloom.plans.learning import halves

plan = Plan()
c = F.col
SMALL = {
    "boosted": {"maxIter": search.Range(3, 10, whole=True), "maxDepth": search.Range(2, 4, whole=True), "stepSize": search.Range(0.05, 0.3, log=True)},
    "forest": {"numTrees": search.Range(5, 20, whole=True), "maxDepth": search.Range(2, 6, whole=True), "minInstancesPerNode": search.Range(1, 10, whole=True)},
    "logistic": {"regParam": search.Range(1e-4, 1.0, log=True), "elasticNetParam": search.Range(0.0, 1.0)},
}  # narrower than the search's own: a query has to end


def _trials(spark, sf_dir):
    train, _ = halves(spark, sf_dir)
    return search.trial_table(spark, search.search(train, "label", "vec_id", trials=12, folds=3, space=SMALL, startup=5))


@plan("adaptive_search")
def adaptive_search(spark, sf_dir):
    """Trials of a Parzen search over three learners with median pruning: settings, areas by fold, state, best so far."""
    return _trials(spark, sf_dir)


@plan("search_summary")
def search_summary(spark, sf_dir):
    """The trials by learner and in all: how many, how many pruned, their areas, the best one's settings."""
    return search.trial_summary(_trials(spark, sf_dir))


def _members(spark, sf_dir):
    """Scores of three members on validation rows and on test rows."""
    train, test = halves(spark, sf_dir)
    held = ml.in_fold("vec_id", 4, seed=7) == 0
    models = ml.fit_all(train.where(~held))
    return list(models), ml.score_all(models, train.where(held)), ml.score_all(models, test)


@plan("optimised_weights")
def optimised_weights(spark, sf_dir):
    """Weights on the simplex by quasi-Newton steps on the validation rows' smooth area, and the vote's exact areas on both sides."""
    names, held, test = _members(spark, sf_dir)
    w, _, jobs = weights.best_weights(held, names, "label")
    area = lambda df, name: ev.auc(ml.soft_vote(df, w).select(F.round("p", 9).alias("p"), "label"), "p", "label").withColumnRenamed("auc", name)
    rows = spark.createDataFrame([(n, x, jobs) for n, x in w.items()], "model string, weight double, aggregates int")
    return rows.join(area(held, "validation_auc"), F.lit(True)).join(area(test, "test_auc"), F.lit(True))  # a row for each member


@plan("tree_attribution")
def tree_attribution(spark, sf_dir):
    """The five features that move a held-out row's forest score most, by exact Shapley values."""
    train, test = halves(spark, sf_dir)
    model = ml.learners()["forest"].fit(train)
    width = train.select(F.size("embedding").alias("n")).first()
    names = [f"x{i}" for i in range(width.n if width else 0)]
    made = attribution.attribute(model, ml.score_all({"forest": model}, test), names, top=5)
    return made.select("vec_id", F.round("p_forest", 9).alias("p"), F.round("base", 9).alias("base"), F.posexplode("contributions").alias("place", "e")).select("vec_id", "p", "base", "place", "e.feature", F.round("e.contribution", 9).alias("contribution"))


@plan("fold_metrics")
def fold_metrics(spark, sf_dir):
    """Area, accuracy and Brier score of five stratified folds, each by a scaler and model of the other four; and of all rows."""
    train, _ = halves(spark, sf_dir)
    learner = LogisticRegression(featuresCol="scaled", labelCol="label", regParam=0.01)
    return ml.fold_metrics(ml.fold_scores(train, learner, "label", "vec_id").withColumn("p", F.round("p", 9)), "label")


@plan("holdout_correctness")
def holdout_correctness(spark, sf_dir):
    """Every model on every held-out row: its score, its side, and whether it is right."""
    train, test = halves(spark, sf_dir)
    return ml.holdout_rows(ml.fit_all(train), test, "vec_id", "label").withColumn("p", F.round("p", 9))


QUERIES, ORACLE_SQL = plan.queries, plan.oracle_sql
