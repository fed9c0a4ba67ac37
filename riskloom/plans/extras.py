"""Column audits, label audits, staged extraction and hold-out checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import evaluation as ev
from riskloom.operators import learning as ml
from riskloom.operators.stats import per_column
from riskloom.plans.base import FRAME, FRAME_SQL, Plan, frame
from riskloom.plans.learning import COLUMNS, frames, halves
from riskloom.session import table

plan = Plan()
c = F.col
AUDITED = ["num_functions", "high", "medium", "has_reentrancy", "zero"]


@plan("constant_columns", " UNION ALL ".join(f"SELECT '{n}' AS feature, count(DISTINCT {n}) <= 1 AS constant FROM (SELECT *, 0 AS zero FROM {FRAME_SQL})" for n in AUDITED))
def constant_columns(spark, sf_dir):
    """Columns of one value: smallest and largest agree, so nothing has to be told apart."""
    f = frame(spark, sf_dir).withColumn("zero", F.lit(0))
    rows = per_column(f, AUDITED, {"lo": lambda x: F.min(x).cast("double"), "hi": lambda x: F.max(x).cast("double")})
    return rows.select("feature", F.coalesce(c("lo") == c("hi"), F.lit(True)).alias("constant"))


@plan("column_set_difference", """
    SELECT column_name AS missing, (SELECT count(*) FROM documents) AS rows FROM (DESCRIBE documents) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE labels))""")
def column_set_difference(spark, sf_dir):
    """Columns that one table has and the other lacks, with the rows concerned."""
    d, other = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    names = lambda df: F.array(*[F.lit(n) for n in df.columns])
    return d.agg(F.count("*").alias("rows")).select(F.explode(F.array_except(names(d), names(other))).alias("missing"), "rows")


PREFIXES = ["cei_", "num_", "has_"]


@plan("prefix_first_match", f"SELECT prefix, sum(v)::BIGINT AS total FROM (SELECT unnest(['cei_', 'num_', 'has_', 'other']) AS prefix, unnest([cei_violations, num_functions, has_reentrancy, high]) AS v FROM {FRAME_SQL}) GROUP BY prefix")
def prefix_first_match(spark, sf_dir):
    """Each column counts for the first prefix that it has."""
    def kind(n: str) -> str:
        return next((p for p in PREFIXES if n.startswith(p)), "other")

    f = frame(spark, sf_dir)
    picked = ["cei_violations", "num_functions", "has_reentrancy", "high"]
    sums = f.agg(*[F.sum(n).alias(n) for n in picked])
    rows = F.array(*[F.struct(F.lit(kind(n)).alias("prefix"), c(n).alias("total")) for n in picked])
    return sums.select(F.explode(rows).alias("r")).groupBy("r.prefix").agg(F.sum("r.total").alias("total"))


@plan("ground_truth_labels", """
    SELECT count(DISTINCT l.doc_id) AS labelled, count(DISTINCT CASE WHEN toxic = 1 THEN l.doc_id END) AS toxic, count(DISTINCT CASE WHEN quality = 1 AND toxic = 0 THEN l.doc_id END) AS good, count(DISTINCT d.source) AS sources
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")  # fmt: skip
def ground_truth_labels(spark, sf_dir):
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source")
    by = l.join(d, "doc_id").groupBy("doc_id", "source").agg(F.max("toxic").alias("t"), F.max(((c("quality") == 1) & (c("toxic") == 0)).cast("int")).alias("g"))
    return by.agg(F.countDistinct("doc_id").alias("labelled"), F.countDistinct(F.when(c("t") == 1, c("doc_id"))).alias("toxic"), F.countDistinct(F.when(c("g") == 1, c("doc_id"))).alias("good"), F.countDistinct("source").alias("sources"))


@plan("train_holdout_masks", f"""
    SELECT CASE WHEN id % 5 = 0 THEN 'holdout' ELSE 'train' END AS part, count(*) AS n, sum(risky)::BIGINT AS positives, sum(CASE WHEN (ml > 0.5) = (risky = 1) THEN 1 ELSE 0 END)::BIGINT AS correct FROM (SELECT id, risky, round(ml, 6) AS ml FROM {FRAME_SQL}) GROUP BY 1""")  # fmt: skip
def train_holdout_masks(spark, sf_dir):
    """Row masks, and how often a score is right on each side."""
    f = frame(spark, sf_dir).select("id", "risky", F.round("ml", 6).alias("ml"))
    part = F.when(c("id") % 5 == 0, "holdout").otherwise("train")
    return f.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("risky").alias("positives"), F.sum(((c("ml") > 0.5) == (c("risky") == 1)).cast("int")).alias("correct"))


@plan("staged_extraction", """
    WITH t1 AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS loc FROM documents), t2 AS (SELECT doc_id, quality, toxic FROM labels)
    SELECT t1.doc_id, loc, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, CASE WHEN t2.doc_id IS NULL THEN 1 ELSE 2 END AS tiers, round(coalesce(quality, 0) / greatest(loc, 1)::DOUBLE, 6) AS per_line FROM t1 LEFT JOIN t2 ON t1.doc_id = t2.doc_id""")  # fmt: skip
def staged_extraction(spark, sf_dir):
    """Tiers joined one after another; a record without a tier keeps its defaults."""
    from riskloom.functions.text import lines_of_code

    one = table(spark, sf_dir, "documents").select("doc_id", lines_of_code(c("text")).alias("loc"))
    two = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(2).alias("_t"))
    both = one.join(two, "doc_id", "left")
    q = F.coalesce("quality", F.lit(0))
    return both.select("doc_id", "loc", q.alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("_t", F.lit(1)).alias("tiers"), F.round(q / F.greatest("loc", F.lit(1)), 6).alias("per_line"))


@plan("six_way_export", f"""
    SELECT 'full' AS part, count(*) AS n FROM {FRAME_SQL} UNION ALL SELECT 'labelled', count(*) FILTER (WHERE risky = 1) FROM {FRAME_SQL} UNION ALL SELECT 'unlabelled', count(*) FILTER (WHERE risky = 0) FROM {FRAME_SQL}
    UNION ALL SELECT 'clean', count(*) FILTER (WHERE high = 0) FROM {FRAME_SQL} UNION ALL SELECT 'large', count(*) FILTER (WHERE lines_of_code > 500) FROM {FRAME_SQL} UNION ALL SELECT 'guarded', count(*) FILTER (WHERE has_reentrancy_guard = 1) FROM {FRAME_SQL}""")  # fmt: skip
def six_way_export(spark, sf_dir):
    """Sizes of six overlapping parts in one pass; `sinks.split_export` writes them."""
    parts = {"full": F.lit(True), "labelled": c("risky") == 1, "unlabelled": c("risky") == 0, "clean": c("high") == 0, "large": c("lines_of_code") > 500, "guarded": c("has_reentrancy_guard") == 1}
    one = frame(spark, sf_dir).agg(*[F.count_if(w).alias(n) for n, w in parts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("part"), c(n).alias("n")) for n in parts])).alias("r")).select("r.*")


@plan("pattern_update", """
    SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%a%' AND length(coalesce(p_brand, '')) < 100 THEN concat('recovered:', p_brand) ELSE p_brand END AS source FROM part""")  # fmt: skip
def pattern_update(spark, sf_dir):
    """Update by a pattern on the lower-cased name behind a guard for short or missing values."""
    hit = F.lower("p_name").like("%a%") & (F.length(F.coalesce("p_brand", F.lit(""))) < 100)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(hit, F.concat(F.lit("recovered:"), c("p_brand"))).otherwise(c("p_brand")).alias("source"))


@plan("address_uniqueness", """
    SELECT count(*) AS duplicates FROM (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0 GROUP BY ALL HAVING count(*) > 1)""")  # fmt: skip
def address_uniqueness(spark, sf_dir):
    """Keys that break a partial unique constraint."""
    by = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return by.where("n > 1").agg(F.count("*").alias("duplicates"))


@plan("failure_states", """
    SELECT o_orderstatus AS status, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY 1""")  # fmt: skip
def failure_states(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy(c("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))
    return by.withColumn("pct", F.round(F.lit(100.0) * c("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


@plan("ensemble_weights")
def ensemble_weights(spark, sf_dir):
    """Weights of the three members that give the largest area on validation rows, and that area on test rows that chose nothing."""
    train, test = halves(spark, sf_dir)
    held = ml.in_fold("vec_id", 4, seed=7) == 0
    models = ml.fit_all(train.where(~held))
    w, a = ml.best_weights(ml.score_all(models, train.where(held)), list(models), "label")
    final = ml.soft_vote(ml.score_all(models, test), w).select(F.round("p", 9).alias("p"), "label")
    rows = spark.createDataFrame([(n, x, a) for n, x in w.items()], "model string, weight double, validation_auc double")
    return rows.join(ev.auc(final, "p", "label"), F.lit(True))  # three rows


@plan("tuning_trials")
def tuning_trials(spark, sf_dir):
    """Cross-validated area of every setting tried, the best so far beside it."""
    train, _ = frames(spark, sf_dir)
    rows = ml.counted(train.withColumn("fold", ml.in_fold("id", 2).cast("int")), COLUMNS, "label", "fold")
    _, trials = ml.tune(ml.assembled(rows, COLUMNS), "label", folds=2, fold="fold", weight="times")
    t = spark.createDataFrame([(i, float(s["regParam"]), float(s["elasticNetParam"]), float(a)) for i, (s, a) in enumerate(trials)], "trial int, reg double, l1 double, auc double")
    return t.withColumn("best", F.max("auc").over(Window.partitionBy(F.lit(1)).orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)))


QUERIES, ORACLE_SQL = plan.queries, plan.oracle_sql
