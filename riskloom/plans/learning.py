"""Learning queries: fitted on the training part of a hash split, evaluated on the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import evaluation as ev
from riskloom.operators import learning as ml
from riskloom.operators.rounds import kept
from riskloom.plans.base import Plan, frame
from riskloom.session import table

plan = Plan()
c = F.col
COLUMNS = ["num_functions", "num_external_calls", "max_complexity", "lines_of_code", "detectors", "high", "medium", "low", "ml", "has_unchecked_call"]


def halves(spark, sf_dir):
    """Vectors of label 0 against the rest, split by hash, never by order."""
    e = ml.from_array(table(spark, sf_dir, "embeddings"), "embedding").withColumn("label", (c("label") == 0).cast("double"))
    h = F.pmod(F.xxhash64("vec_id"), F.lit(10))
    return e.where(h < 7), e.where(h >= 7)


def frames(spark, sf_dir):
    f = frame(spark, sf_dir).withColumn("label", c("risky").cast("double"))
    h = F.pmod(F.xxhash64("id"), F.lit(10))
    return f.where(h < 7), f.where(h >= 7)


@plan("ensemble_metrics")
def ensemble_metrics(spark, sf_dir):
    """Area, Brier score and counts of three learners' weighted vote on held-out rows."""
    train, test = halves(spark, sf_dir)
    n = train.agg(F.count("*"), F.sum("label")).first()
    weighted = train.withColumn("w", F.when(c("label") == 1, n[0] / (2.0 * max(n[1], 1))).otherwise(n[0] / (2.0 * max(n[0] - n[1], 1))))
    models = ml.fit_all(weighted, "label", "w")
    s = ml.soft_vote(ml.score_all(models, test), {"boosted": 0.4, "forest": 0.3, "logistic": 0.3}).select(F.round("p", 9).alias("p"), "label").persist()
    counts = s.agg(*[v.alias(k) for k, v in ev.confusion(c("p") > 0.5, c("label")).items()], F.avg(F.pow(c("p") - c("label"), F.lit(2))).alias("brier"))
    return ev.rates(counts.join(ev.auc(s, "p", "label"), F.lit(True)))


@plan("isotonic_calibration")
def isotonic_calibration(spark, sf_dir):
    """Brier score on held-out rows before and after each calibration, fitted on the training rows' out-of-fold scores."""
    train, test = halves(spark, sf_dir)
    learner = ml.learners()["logistic"]
    brier = lambda df, s, name: df.agg(F.avg(F.pow(c(s) - c("label"), F.lit(2))).alias("brier")).select(F.lit(name).alias("method"), "brier")
    done = {m: ml.calibrated_by_folds(train, test, learner, "label", "vec_id", m) for m in ("isotonic", "sigmoid")}
    out = brier(done["isotonic"], "p", "none")
    for method, df in done.items():
        out = out.unionByName(brier(df, "calibrated", method))
    return out


@plan("fold_areas")
def fold_areas(spark, sf_dir):
    """Area of each of five folds by a model of the other four."""
    train, _ = halves(spark, sf_dir)
    return ml.fold_areas(train, ml.learners()["logistic"], "label", "vec_id")


@plan("prediction_intervals")
def prediction_intervals(spark, sf_dir):
    """Each held-out row's score with its interval over resampled models."""
    train, test = halves(spark, sf_dir)
    made = ml.prediction_intervals(train, test, ml.learners(weight="w")["logistic"], "vec_id")
    return made.select("vec_id", "label", *[F.round(x, 6).alias(x) for x in ("mean", "std", "lo", "hi")])


@plan("vote_contributions")
def vote_contributions(spark, sf_dir):
    """Each member's part of a held-out row's weighted vote."""
    train, test = halves(spark, sf_dir)
    weights = {"boosted": 0.4, "forest": 0.3, "logistic": 0.3}
    s = ml.contributions(ml.soft_vote(ml.score_all(ml.fit_all(train), test), weights), weights)
    return s.select("vec_id", F.round("p", 9).alias("p"), *[F.round(f"part_{n}", 9).alias(f"part_{n}") for n in weights])


@plan("bootstrap_uncertainty")
def bootstrap_uncertainty(spark, sf_dir):
    return ml.bootstrap_interval(frame(spark, sf_dir), "ml", "id")


@plan("group_ablation")
def group_ablation(spark, sf_dir):
    """Area lost without each group of columns."""
    train, test = frames(spark, sf_dir)
    rows = ml.ablation(train, test, {"size": COLUMNS[:4], "findings": COLUMNS[4:8], "scores": COLUMNS[8:]}, "label")
    return spark.createDataFrame([(n, a, rows[0][1] - a) for n, a in rows], "without string, auc double, lost double")


TEXT_FEATURES = {
    "n_chars": "length(text)", "n_words": r"size(split(text, '\\s+'))", "n_lines": r"size(split(text, '\n'))", "n_digits": "length(regexp_replace(text, '[^0-9]+', ''))",
    "n_upper": "length(regexp_replace(text, '[^A-Z]+', ''))", "n_marks": r"length(regexp_replace(text, '[\\w\\s]+', ''))", "toxic": "coalesce(toxic, -1)", "quality": "coalesce(quality, -1)",
}


@plan("source_prediction")
def source_prediction(spark, sf_dir):
    """Adversarial validation: can features of a text tell whether it is from the largest source? Proxies carry over .015 of the importance."""
    labels = table(spark, sf_dir, "labels").dropDuplicates(["doc_id"])
    d = kept(table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", "source", *[F.expr(v).cast("double").alias(k) for k, v in TEXT_FEATURES.items()]), "text-features")  # texts are read once, not in every pass of the learner
    largest = d.groupBy("source").count().orderBy(F.desc("count"), "source").first()
    d = ml.assembled(d.withColumn("label", (c("source") == F.lit(largest[0] if largest else None)).cast("double")).where("label IS NOT NULL"), list(TEXT_FEATURES))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    models = {"forest": ml.learners()["forest"].fit(d.where(h < 7))}
    s = ml.score_all(models, d.where(h >= 7)).select(F.round("p_forest", 9).alias("p"), "label")
    band = F.when(c("auc") > 0.95, "severe").when(c("auc") > 0.9, "high").when(c("auc") > 0.7, "moderate").otherwise("low")
    area = ev.auc(s, "p", "label").withColumn("band", band)
    by = ml.importances(models, list(TEXT_FEATURES), spark).select("feature", "importance", "rank", (c("importance") > 0.015).alias("proxy"))
    return by.join(area, F.lit(True))  # a row for each feature


@plan("feature_importances")
def feature_importances(spark, sf_dir):
    """Importances in boosted trees, fitted on counts of rows that are alike, and in a forest, whose bootstrap draws rows one by one."""
    train, _ = frames(spark, sf_dir)
    rows = ml.counted(train, COLUMNS, "label")
    m = {"boosted": ml.learners(weight="times")["boosted"].fit(ml.assembled(rows, COLUMNS)), "forest": ml.learners()["forest"].fit(ml.assembled(train, COLUMNS))}
    return ml.importances(m, COLUMNS, spark)


@plan("importance_comparison")
def importance_comparison(spark, sf_dir):
    """A row for each feature: its importance and rank in both tree models, their mean and how far the ranks are apart."""
    i = feature_importances(spark, sf_dir)
    by = i.groupBy("feature").pivot("model", ["boosted", "forest"]).agg(F.first("importance").alias("importance"), F.first("rank").alias("rank"))
    return by.select("*", ((c("boosted_importance") + c("forest_importance")) / 2).alias("mean_importance"), F.abs(c("boosted_rank") - c("forest_rank")).alias("rank_gap"))


@plan("one_versus_rest")
def one_versus_rest(spark, sf_dir):
    """A binary model for each class with at least 20 positives."""
    e = ml.from_array(table(spark, sf_dir, "embeddings"), "embedding")
    h = F.pmod(F.xxhash64("vec_id"), F.lit(10))
    labels = [r[0] for r in e.groupBy("label").count().where("label IS NOT NULL AND count >= 20").orderBy("label").collect()]
    rows = []
    for y in labels:
        one = e.withColumn("label", (c("label") == y).cast("double"))
        m = ml.learners()["logistic"].fit(one.where(h < 7))
        s = ml.score_all({"x": m}, one.where(h >= 7)).select(F.round("p_x", 9).alias("p"), "label")
        rows.append((y, ev.auc(s, "p", "label").first()[0]))
    return spark.createDataFrame(rows, "label int, auc double")


QUERIES, ORACLE_SQL = plan.queries, plan.oracle_sql
