"""Score and decision queries, and the evaluation of scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.text import bands
from riskloom.operators.engineering import hash_ranks
from riskloom.operators import evaluation as ev
from riskloom.operators import scoring as sc
from riskloom.plans.base import FRAME_SQL, Plan, frame
from riskloom.session import table

plan = Plan()
c = F.col

SOURCE, STATIC = "id % 3 <> 0", "detectors > 0"
QUALITY_SQL = f"CASE WHEN {SOURCE} THEN (cei_score + cei_safe_functions::DOUBLE / greatest(num_functions, 1) + (1 - cei_violations::DOUBLE / (cei_violations + cei_safe_functions + 1))) / 3 ELSE 0 END"
COMPLETE_SQL = f"(0.3::DOUBLE * CASE WHEN {SOURCE} THEN 1 ELSE 0.5 END + 0.3::DOUBLE * cei_score + 0.2::DOUBLE * CASE WHEN {STATIC} THEN 1 ELSE 0.5 END + 0.1::DOUBLE * (num_modifiers > 0)::INT + 0.1::DOUBLE * ({QUALITY_SQL}))"
SEM_RAW = "(0.4::DOUBLE * least(cei_violations / 5.0::DOUBLE, 1) + CASE WHEN cei_score < 0.8 THEN 0.2::DOUBLE * (1 - cei_score) ELSE 0 END + 0.3::DOUBLE * least(state_after_call_count / 3.0::DOUBLE, 1) + 0.2::DOUBLE * least(unchecked_calls / 2.0::DOUBLE, 1))"
SEM_SQL = f"least(1.0::DOUBLE, CASE WHEN has_reentrancy_guard = 1 AND num_external_calls > 0 THEN {SEM_RAW} * 0.5 ELSE {SEM_RAW} END)"
NOSRC_RAW = "(0.4::DOUBLE * has_reentrancy + 0.3::DOUBLE * has_unchecked_call + least(num_external_calls / 10.0::DOUBLE * 0.2, 0.2) + 0.1::DOUBLE * has_delegatecall)"
NOSRC_SQL = f"least(0.5::DOUBLE, CASE WHEN has_reentrancy_guard = 1 THEN {NOSRC_RAW} * 0.5 ELSE {NOSRC_RAW} END)"
STATIC_SQL = "least(1.0::DOUBLE, 0.3::DOUBLE * has_reentrancy + 0.2::DOUBLE * has_unchecked_call + 0.2::DOUBLE * has_access_control + 0.1::DOUBLE * least(num_external_calls / 10.0::DOUBLE, 1) + 0.1::DOUBLE * least(high / 10.0::DOUBLE, 1) + 0.1::DOUBLE * has_assembly)"


def completeness_of():
    source, static = F.expr(SOURCE), F.expr(STATIC)
    q = sc.cei_quality(c("cei_score"), c("cei_safe_functions"), c("cei_violations"), c("num_functions"), source)
    return sc.completeness(source, c("cei_score"), static, (c("num_modifiers") > 0).cast("int"), q)


def semantic_of():
    return sc.semantic_risk(c("cei_violations"), c("cei_score"), c("state_after_call_count"), c("unchecked_calls"), c("has_reentrancy_guard"), c("num_external_calls"))


def static_of():
    return sc.static_risk(c("has_reentrancy"), c("has_unchecked_call"), c("has_access_control"), c("num_external_calls"), c("high"), c("has_assembly"))


LEVEL_SQL = "CASE WHEN round(q, 6) >= 0.9 THEN 'excellent' WHEN round(q, 6) >= 0.7 THEN 'good' WHEN round(q, 6) >= 0.5 THEN 'fair' WHEN round(q, 6) >= 0.3 THEN 'poor' ELSE 'minimal' END"
LEVELS = [(0.9, "excellent"), (0.7, "good"), (0.5, "fair"), (0.3, "poor")]


@plan("data_completeness", f"SELECT id, round(q, 6) AS completeness, {LEVEL_SQL} AS level FROM (SELECT id, {COMPLETE_SQL} AS q FROM {FRAME_SQL})")
def data_completeness(spark, sf_dir):
    q = frame(spark, sf_dir).select("id", F.round(completeness_of(), 6).alias("completeness"))
    return q.withColumn("level", bands(c("completeness"), LEVELS, "minimal"))


@plan("semantic_risk", f"""
    SELECT id, round({SEM_SQL}, 6) AS semantic, round({NOSRC_SQL}, 6) AS without_source,
           concat_ws(',', CASE WHEN cei_violations > 0 THEN 'cei_violations' END, CASE WHEN cei_score < 0.8 THEN 'low_cei_score' END, CASE WHEN state_after_call_count > 0 THEN 'state_after_call' END, CASE WHEN unchecked_calls > 0 THEN 'unchecked_calls' END) AS reasons FROM {FRAME_SQL}""")  # fmt: skip
def semantic_risk(spark, sf_dir):
    no_source = sc.semantic_risk_without_source(c("has_reentrancy"), c("has_unchecked_call"), c("num_external_calls"), c("has_delegatecall"), c("has_reentrancy_guard"))
    why = sc.reasons(c("cei_violations"), c("cei_score"), c("state_after_call_count"), c("unchecked_calls"))
    return frame(spark, sf_dir).select("id", F.round(semantic_of(), 6).alias("semantic"), F.round(no_source, 6).alias("without_source"), F.array_join(why, ",").alias("reasons"))


@plan("static_risk", f"SELECT id, round({STATIC_SQL}, 6) AS static FROM {FRAME_SQL}")
def static_risk(spark, sf_dir):
    return frame(spark, sf_dir).select("id", F.round(static_of(), 6).alias("static"))


SCORED_SQL = f"""
    WITH s AS (SELECT id, risky, round(ml, 6) AS ml, round({SEM_SQL}, 6) AS sem, round({STATIC_SQL}, 6) AS st, round({COMPLETE_SQL}, 6) AS q, has_reentrancy AS r, has_unchecked_call AS u, has_access_control AS a FROM {FRAME_SQL}),
      l AS (SELECT *, {LEVEL_SQL} AS level, (ml > 0.7 AND r + u + a = 0) OR (ml < 0.3 AND r + u > 0) OR (sem > 0.7 AND ml < 0.3) AS against FROM s),
      w AS (SELECT *, CASE level WHEN 'excellent' THEN 0.6 WHEN 'good' THEN 0.65 WHEN 'fair' THEN 0.7 WHEN 'poor' THEN 0.8 ELSE 0.5 END::DOUBLE AS wm, CASE level WHEN 'excellent' THEN 0.4 WHEN 'good' THEN 0.35 WHEN 'fair' THEN 0.3 WHEN 'poor' THEN 0.2 ELSE 0.5 END::DOUBLE AS ws FROM l),
      c1 AS (SELECT *, CASE WHEN ml > 0.9 AND st > 0.7 THEN least((ml + sem) / 2 + 0.4, 1) WHEN ml > 0.6 AND st > 0.5 THEN least((ml + sem) / 2 + 0.25, 0.9) ELSE (ml + sem) / 2 END AS x1 FROM w),
      c2 AS (SELECT *, CASE WHEN st > 0.7 AND ml > 0.4 THEN least(x1 + 0.15, 1) ELSE x1 END AS x2 FROM c1),
      c3 AS (SELECT *, CASE WHEN q > 0.8 THEN least(x2 * 1.3, 1) WHEN q < 0.4 THEN x2 * greatest(q, 0.3) ELSE x2 END AS x3 FROM c2),
      c4 AS (SELECT *, CASE WHEN against THEN greatest(x3 - 0.2, 0.2) ELSE x3 END AS x4 FROM c3)
"""


def scored(spark, sf_dir):
    """ml, sem, st, q, level, weights, final score and confidence of every row, one projection after another."""
    f = frame(spark, sf_dir)
    s = f.select("id", "risky", F.round("ml", 6).alias("ml"), F.round(semantic_of(), 6).alias("sem"), F.round(static_of(), 6).alias("st"), F.round(completeness_of(), 6).alias("q"),
                 c("has_reentrancy").alias("r"), c("has_unchecked_call").alias("u"), c("has_access_control").alias("a"))
    s = s.withColumns({"level": bands(c("q"), LEVELS, "minimal"), "against": sc.contradiction(c("ml"), c("sem"), c("r"), c("u"), c("a"))})
    wm, ws = sc.weights(c("level"))
    return s.withColumns({"final": F.round(wm * c("ml") + ws * c("sem"), 6), "confidence": F.round(sc.confidence(c("ml"), c("sem"), c("st"), c("q"), c("against")), 6)})


@plan("final_score", SCORED_SQL + "SELECT id, level, against, round(wm * ml + ws * sem, 6) AS final, round(wm * ml + ws * sem, 6) > 0.15 AS vulnerable, round(least(1, greatest(0.1, x4)), 6) AS confidence FROM c4")
def final_score(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "level", "against", "final", (c("final") > 0.15).alias("vulnerable"), "confidence")


@plan("score_records", SCORED_SQL + "SELECT level, count(*) AS n, round(avg(wm * ml + ws * sem), 6) AS mean_final, count(*) FILTER (WHERE against) AS contradictions FROM c4 GROUP BY level")
def score_records(spark, sf_dir):
    """The nested result record of each row, summed by level from the records themselves."""
    wm, ws = sc.weights(c("level"))
    r = scored(spark, sf_dir).select(F.struct("id", F.struct(wm.alias("ml"), ws.alias("semantic")).alias("weights"), "level", "against", (wm * c("ml") + ws * c("sem")).alias("final")).alias("r"))
    return r.groupBy(c("r.level").alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("r.final"), 6).alias("mean_final"), F.count_if(c("r.against")).alias("contradictions"))


@plan("routing_scores", f"""
    SELECT id, round(s, 6) AS score, CASE WHEN s < 50 THEN 'simple' ELSE 'complex' END AS route FROM (SELECT id, 0.3::DOUBLE * least(lines_of_code, 300) / 300.0::DOUBLE * 100 + 0.3::DOUBLE * least(avg_complexity, 20) / 20.0::DOUBLE * 100
      + 0.2::DOUBLE * least(num_external_calls, 5) / 5.0::DOUBLE * 100 + least(10 * has_assembly + 10 * has_delegatecall, 20) AS s FROM {FRAME_SQL})""")  # fmt: skip
def routing_scores(spark, sf_dir):
    s = sc.routing_score(c("lines_of_code"), c("avg_complexity"), c("num_external_calls"), c("has_assembly"), c("has_delegatecall"))
    return frame(spark, sf_dir).select("id", F.round(s, 6).alias("score")).withColumn("route", F.when(c("score") < 50, "simple").otherwise("complex"))


@plan("routing_stats", "WITH r AS (" + plan.oracle_sql["routing_scores"] + ") SELECT route, count(*) AS n, round(avg(score), 4) AS mean, min(score) AS lo, max(score) AS hi FROM r GROUP BY route")
def routing_stats(spark, sf_dir):
    return routing_scores(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.min("score").alias("lo"), F.max("score").alias("hi"))


@plan("target_risk", f"SELECT id, least(100, least(100, 30 * high + 15 * medium + 5 * low + 3 * detectors) + 20 * risky) AS risk, round(CASE WHEN risky = 0 THEN 1 - ml ELSE ml END, 4) AS api_score FROM {FRAME_SQL}")
def target_risk(spark, sf_dir):
    return frame(spark, sf_dir).select("id", sc.target_risk(c("high"), c("medium"), c("low"), c("detectors"), c("risky")).alias("risk"), F.round(F.when(c("risky") == 0, 1 - c("ml")).otherwise(c("ml")), 4).alias("api_score"))


def _points_sql() -> str:
    return " + ".join("CASE " + " ".join(f"WHEN {n} > {a} THEN {p}" for a, p in steps) + " ELSE 0 END" for n, steps in sc.POINTS.items())


@plan("complexity_category", f"SELECT CASE WHEN p < 25 THEN 'simple' WHEN p < 50 THEN 'moderate' WHEN p < 75 THEN 'complex' ELSE 'critical' END AS category, count(*) AS n, sum(p)::BIGINT AS points FROM (SELECT {_points_sql()} AS p FROM {FRAME_SQL}) GROUP BY 1")
def complexity_category(spark, sf_dir):
    p = frame(spark, sf_dir).select(sc.complexity_points().alias("p"))
    return p.groupBy(bands(c("p"), [(75, "critical"), (50, "complex"), (25, "moderate")], "simple").alias("category")).agg(F.count("*").alias("n"), F.sum("p").alias("points"))


@plan("expected_range_check", """
    WITH e(source, lo, hi) AS (VALUES ('src0', 0, 3000), ('src1', 1000, 100000), ('src2', 0, 500))
    SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars BETWEEN lo AND hi) AS inside FROM documents JOIN e USING (source) GROUP BY source""")  # fmt: skip
def expected_range_check(spark, sf_dir):
    e = F.broadcast(spark.createDataFrame([("src0", 0, 3000), ("src1", 1000, 100000), ("src2", 0, 500)], "source string, lo long, hi long"))  # a fixed list
    d = table(spark, sf_dir, "documents").select("source", "n_chars").join(e, "source")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(c("n_chars").between(c("lo"), c("hi"))).alias("inside"))


@plan("linear_attribution", f"""
    WITH m AS (SELECT avg(high) AS h, avg(max_complexity) AS x, avg(num_external_calls) AS e FROM {FRAME_SQL}), a AS (
      SELECT id, n, unnest(['high', 'max_complexity', 'num_external_calls']) AS feature, unnest([round(0.5 * (high - h), 6), round(0.1 * (max_complexity - x), 6), round(0.2 * (num_external_calls - e), 6)]) AS part FROM (SELECT *, row_number() OVER () AS n FROM {FRAME_SQL}), m)
    SELECT id, feature, part FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY abs(part) DESC, feature) AS k FROM a) WHERE k <= 2""")  # fmt: skip
def linear_attribution(spark, sf_dir):
    """The two largest parts of a linear score, sorted inside each row."""
    weights = {"high": 0.5, "max_complexity": 0.1, "num_external_calls": 0.2}
    f = frame(spark, sf_dir).select("id", *weights)
    m = f.agg(*[F.avg(n).alias(n) for n in weights]).first()
    parts = F.array(*[F.struct((-F.abs(p)).alias("k"), F.lit(n).alias("feature"), p.alias("part")) for n, w in weights.items() for p in [F.round(F.lit(w) * (c(n) - F.lit(m[n])), 6)]])
    return f.select("id", F.explode(F.slice(F.sort_array(parts), 1, 2)).alias("r")).select("id", "r.feature", "r.part")


EV_SQL = f"(SELECT id, risky, round(ml, 6) AS ml, round({SEM_SQL}, 6) AS sem FROM {FRAME_SQL})"


def evaluated(spark, sf_dir):
    return frame(spark, sf_dir).select("id", "risky", F.round("ml", 6).alias("ml"), F.round(semantic_of(), 6).alias("sem"))


@plan("metrics_row", f"""
    WITH e AS {EV_SQL}, m AS (SELECT count(*) FILTER (WHERE sem > 0.3 AND risky = 1) AS tp, count(*) FILTER (WHERE sem > 0.3 AND risky = 0) AS fp, count(*) FILTER (WHERE sem <= 0.3 AND risky = 1) AS fn, count(*) FILTER (WHERE sem <= 0.3 AND risky = 0) AS tn, round(avg((sem - risky) ** 2), 9) AS brier FROM e),
      r AS (SELECT risky, avg(k) OVER (PARTITION BY sem) AS k FROM (SELECT risky, sem, row_number() OVER (ORDER BY sem) AS k FROM e)),
      a AS (SELECT round((sum(CASE WHEN risky = 1 THEN k END) - count(*) FILTER (WHERE risky = 1) * (count(*) FILTER (WHERE risky = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE risky = 1)::DOUBLE * count(*) FILTER (WHERE risky = 0)), 9) AS auc FROM r)
    SELECT tp, fp, fn, tn, brier, auc, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END AS f1 FROM m, a""")  # fmt: skip
def metrics_row(spark, sf_dir):
    e = evaluated(spark, sf_dir)
    m = e.agg(*[v.alias(k) for k, v in ev.confusion(c("sem") > 0.3, c("risky")).items()], F.round(F.avg(F.pow(c("sem") - c("risky"), F.lit(2))), 9).alias("brier"))
    a = ev.auc(e, "sem", "risky").select(F.round("auc", 9).alias("auc"))
    return ev.rates(m.join(a, F.lit(True)))  # one row each


SHARES, THRESHOLDS = [0.4, 0.5, 0.6, 0.7, 0.8, 0.9], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]


@plan("grid_search", f"""
    WITH e AS {EV_SQL}, g AS (SELECT unnest({SHARES})::DOUBLE AS ml_weight), t AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold),
      k AS (SELECT ml_weight, threshold, count(*) FILTER (WHERE p AND risky = 1) AS tp, count(*) FILTER (WHERE p AND risky = 0) AS fp, count(*) FILTER (WHERE NOT p AND risky = 1) AS fn, count(*) FILTER (WHERE NOT p AND risky = 0) AS tn
            FROM (SELECT *, round(ml_weight * ml + (1 - ml_weight) * sem, 9) > threshold AS p FROM e, g, t) GROUP BY ALL)
    SELECT *, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END AS f1 FROM k""")  # fmt: skip
def grid_search(spark, sf_dir):
    return ev.grid(evaluated(spark, sf_dir), "ml", "sem", "risky", SHARES, THRESHOLDS)


@plan("precision_at_recall", "WITH k AS (" + plan.oracle_sql["grid_search"] + ") SELECT ml_weight, threshold, precision, recall FROM k WHERE recall >= 0.5 ORDER BY precision DESC, recall DESC, ml_weight, threshold LIMIT 1")
def precision_at_recall(spark, sf_dir):
    return grid_search(spark, sf_dir).where("recall >= 0.5").select("ml_weight", "threshold", "precision", "recall").orderBy(c("precision").desc(), c("recall").desc(), "ml_weight", "threshold").limit(1)


@plan("calibration_bins", f"SELECT CAST(floor(ml * 10) AS BIGINT) AS bin, count(*) AS n, round(avg(ml), 6) AS mean_conf, round(avg(risky), 6) AS accuracy FROM {EV_SQL} WHERE ml < 1 GROUP BY 1")
def calibration_bins(spark, sf_dir):
    """Ten equal bins of [0, 1); a confidence of exactly 1 falls in none."""
    return evaluated(spark, sf_dir).where("ml < 1").groupBy(F.floor(c("ml") * 10).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("ml"), 6).alias("mean_conf"), F.round(F.avg("risky"), 6).alias("accuracy"))


@plan("calibration_curve", f"SELECT least(9, CAST(floor(ml * 10) AS BIGINT)) AS bin, round(avg(risky), 6) AS fraction_positive, round(avg(ml), 6) AS mean_predicted FROM {EV_SQL} GROUP BY 1")
def calibration_curve(spark, sf_dir):
    b = F.least(F.lit(9).cast("long"), F.floor(c("ml") * 10))
    return evaluated(spark, sf_dir).groupBy(b.alias("bin")).agg(F.round(F.avg("risky"), 6).alias("fraction_positive"), F.round(F.avg("ml"), 6).alias("mean_predicted"))


@plan("class_weights", f"SELECT risky, count(*) AS n, round(sum(count(*)) OVER () / (2.0::DOUBLE * count(*)), 6) AS weight FROM {FRAME_SQL} GROUP BY risky")
def class_weights(spark, sf_dir):
    from pyspark.sql import Window

    by = frame(spark, sf_dir).groupBy("risky").agg(F.count("*").alias("n"))
    return by.withColumn("weight", F.round(F.sum("n").over(Window.partitionBy(F.lit(1))) / (2.0 * c("n")), 6))


@plan("stratified_folds", f"""
    SELECT risky, fold, count(*) AS n, round(avg((sem - risky) ** 2), 9) AS brier FROM (SELECT risky, sem, (row_number() OVER (PARTITION BY risky ORDER BY md5(concat_ws('|', id::VARCHAR, '42')), id, sem) - 1) % 5 AS fold FROM {EV_SQL}) GROUP BY ALL""")  # fmt: skip
def stratified_folds(spark, sf_dir):
    """Five folds, each class dealt to them in hash order, and a score's error in each."""
    ranked = hash_ranks(evaluated(spark, sf_dir), "risky", "id", then=["sem"])
    return ranked.withColumn("fold", (c("_k") - 1) % 5).groupBy("risky", "fold").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(c("sem") - c("risky"), F.lit(2))), 9).alias("brier"))


@plan("soft_vote", f"SELECT id, round((0.5 * ml + 0.3 * sem + 0.2 * least(1, sem + ml)) / 1.0, 6) AS vote, round(abs(ml - sem), 6) AS spread FROM {EV_SQL}")
def soft_vote(spark, sf_dir):
    """Weighted average of three members, and how far two of them are apart."""
    v = 0.5 * c("ml") + 0.3 * c("sem") + 0.2 * F.least(F.lit(1.0), c("sem") + c("ml"))
    return evaluated(spark, sf_dir).select("id", F.round(v, 6).alias("vote"), F.round(F.abs(c("ml") - c("sem")), 6).alias("spread"))


@plan("flag_response", f"SELECT count(*) AS n, round(avg(least(1.0, 0.7 + 0.1 * least(num_external_calls / 10.0, 1) + 0.1 * least(high / 10.0, 1) + 0.1) - least(1.0, 0.1 * least(num_external_calls / 10.0, 1) + 0.1 * least(high / 10.0, 1))), 6) AS response FROM {FRAME_SQL}")
def flag_response(spark, sf_dir):
    """Score with every flag on less the score with every flag off, from two projections of one row."""
    at = lambda v: sc.static_risk(F.lit(v), F.lit(v), F.lit(v), c("num_external_calls"), c("high"), F.lit(v))
    return frame(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(at(1) - at(0)), 6).alias("response"))


QUERIES, ORACLE_SQL = plan.queries, plan.oracle_sql
