"""Feature engineering, sampling, scaling and augmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import engineering as fe
from riskloom.operators.stats import per_column
from riskloom.plans.base import FRAME_SQL, Plan, frame
from riskloom.session import table

plan = Plan()


def _sql(e: str) -> str:
    return e.replace("0.4D", "0.4::DOUBLE").replace("0.3D", "0.3::DOUBLE").replace("100D", "100.0::DOUBLE").replace("10D", "10.0::DOUBLE")


def rounded(df, names):
    return df.select("id", *[F.round(n, 6).alias(n) for n in names])


@plan("fe_interactions", "SELECT id, " + ", ".join(f"round(({e})::DOUBLE, 6) AS fe_{n}" for n, e in fe.INTERACTIONS.items()) + f" FROM {FRAME_SQL}")
def fe_interactions(spark, sf_dir):
    return rounded(fe.interactions(frame(spark, sf_dir)), [f"fe_{n}" for n in fe.INTERACTIONS])


@plan("fe_ratios", "SELECT id, " + ", ".join(f"round({a}::DOUBLE / ({b} + 1), 6) AS fe_{n}" for n, (a, b) in fe.RATIOS.items()) + f" FROM {FRAME_SQL}")
def fe_ratios(spark, sf_dir):
    return rounded(fe.ratios(frame(spark, sf_dir)), [f"fe_{n}" for n in fe.RATIOS])


@plan("fe_domain", "SELECT id, " + ", ".join(f"round(({_sql(e)})::DOUBLE, 6) AS fe_{n}" for n, e in fe.DOMAIN.items()) + f" FROM {FRAME_SQL}")
def fe_domain(spark, sf_dir):
    return rounded(fe.domain(frame(spark, sf_dir)), [f"fe_{n}" for n in fe.DOMAIN])


@plan("fe_polynomial", f"SELECT id, pow(max_complexity, 2)::DOUBLE AS fe_max_complexity2_lines_of_code0, (max_complexity * lines_of_code)::DOUBLE AS fe_max_complexity1_lines_of_code1, pow(lines_of_code, 2)::DOUBLE AS fe_max_complexity0_lines_of_code2 FROM {FRAME_SQL}")
def fe_polynomial(spark, sf_dir):
    f = fe.polynomial(frame(spark, sf_dir), "max_complexity", "lines_of_code")
    return f.select("id", *[c for c in f.columns if c.startswith("fe_")])


@plan("fe_pipeline", f"SELECT count(*) AS n, round(avg(high * detectors), 6) AS a, round(avg(num_external_calls::DOUBLE / (num_functions + 1)), 6) AS b, round(avg(max_complexity * lines_of_code), 6) AS c FROM {FRAME_SQL}")
def fe_pipeline(spark, sf_dir):
    f = fe.engineered(frame(spark, sf_dir))
    return f.agg(F.count("*").alias("n"), F.round(F.avg("fe_high_severity_density"), 6).alias("a"), F.round(F.avg("fe_external_calls_ratio"), 6).alias("b"), F.round(F.avg("fe_max_complexity1_lines_of_code1"), 6).alias("c"))


SCALED = ["num_external_calls", "max_complexity", "lines_of_code"]


@plan("robust_scaled", "WITH f AS (SELECT * FROM " + FRAME_SQL + "), s AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS r_{c}" for c in SCALED) + " FROM f WHERE id % 5 <> 0) SELECT id, " + ", ".join(f"round(({c} - m_{c}) / r_{c}, 6) AS {c}" for c in SCALED) + " FROM f, s")
def robust_scaled(spark, sf_dir):
    """Median and range of the training rows (ids not divisible by five), applied to all."""
    f = frame(spark, sf_dir).select("id", *SCALED)
    return rounded(fe.scale(f, fe.fit_robust(f.where("id % 5 != 0"), SCALED)), SCALED)


@plan("standard_scaled", "WITH f AS (SELECT * FROM " + FRAME_SQL + "), s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS r_{c}" for c in SCALED) + " FROM f WHERE id % 5 <> 0) SELECT id, " + ", ".join(f"round(({c} - m_{c}) / r_{c}, 6) AS {c}" for c in SCALED) + " FROM f, s")
def standard_scaled(spark, sf_dir):
    f = frame(spark, sf_dir).select("id", *SCALED)
    return rounded(fe.scale(f, fe.fit_standard(f.where("id % 5 != 0"), SCALED)), SCALED)


HASH = "md5(concat_ws('|', doc_id::VARCHAR, '42'))"


@plan("stratified_sample", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {HASH}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE k <= floor(0.3::DOUBLE * n)")
def stratified_sample(spark, sf_dir):
    return fe.exact_share(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.3)


@plan("dedup_strata_sample", f"""
    WITH s AS (SELECT doc_id, lang, lower(md5(text)) AS name FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {HASH}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE k <= floor(0.5::DOUBLE * n))
    SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY lang, doc_id) AS j FROM s) WHERE j = 1""")  # fmt: skip
def dedup_strata_sample(spark, sf_dir):
    """Sample by stratum, then one row for each name over all strata, the first stratum's."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("name"))
    s = fe.exact_share(d, "lang", "doc_id", 0.5)
    return s.groupBy("name").agg(F.min(F.struct("lang", "doc_id")).alias("m")).select("m.doc_id", "m.lang")


@plan("balanced_sample", f"SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {HASH}, doc_id) AS k FROM labels) WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))")
def balanced_sample(spark, sf_dir):
    return fe.balanced(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


@plan("split_60_20_20", f"SELECT doc_id, quality, CASE WHEN r < 0.6 THEN 'train' WHEN r < 0.8 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, quality, percent_rank() OVER (PARTITION BY quality ORDER BY {HASH}, doc_id) AS r FROM labels)")
def split_60_20_20(spark, sf_dir):
    return fe.split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


@plan("random_per_class", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {HASH}, doc_id) AS k FROM documents) WHERE k <= 10")
def random_per_class(spark, sf_dir):
    """Ten rows of each class in hash order; Spark cuts each task's rows to ten before the shuffle."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("lang").orderBy(fe.hash_order("doc_id"), "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("k", k).where("k <= 10").drop("k")


@plan("augment_validation", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(a - b) / abs(b), 6) <= 0.1 AS mean_ok, qa <= 2 * qb AS tail_ok FROM (SELECT avg(CASE WHEN id % 2 = 0 THEN {c} END) AS a, avg(CASE WHEN id % 2 = 1 THEN {c} END) AS b, quantile_cont(CASE WHEN id % 2 = 0 THEN {c} END, 0.99) AS qa, quantile_cont(CASE WHEN id % 2 = 1 THEN {c} END, 0.99) AS qb FROM {FRAME_SQL})" for c in SCALED))
def augment_validation(spark, sf_dir):
    """Do two halves agree in mean and upper tail?"""
    half = lambda c, h: F.when(F.col("id") % 2 == h, c)
    rows = per_column(frame(spark, sf_dir), SCALED, {
        "a": lambda c: F.avg(half(c, 0)), "b": lambda c: F.avg(half(c, 1)), "qa": lambda c: F.percentile(half(c, 0), 0.99), "qb": lambda c: F.percentile(half(c, 1), 0.99)})
    return rows.select("feature", (F.round(F.abs(F.col("a") - F.col("b")) / F.abs("b"), 6) <= 0.1).alias("mean_ok"), (F.col("qa") <= 2 * F.col("qb")).alias("tail_ok"))


@plan("mixup_rows")
def mixup_rows(spark, sf_dir):
    return fe.mixup(frame(spark, sf_dir), SCALED, "risky", "id")


@plan("jitter_rows")
def jitter_rows(spark, sf_dir):
    return fe.jitter(frame(spark, sf_dir).select("id", "risky", *[F.col(c).cast("double").alias(c) for c in SCALED]), SCALED, "id")


@plan("smote_rows")
def smote_rows(spark, sf_dir):
    return fe.smote(table(spark, sf_dir, "embeddings"), "embedding", "label", "vec_id", 0)


QUERIES, ORACLE_SQL = plan.queries, plan.oracle_sql
