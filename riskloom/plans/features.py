"""Feature extraction: aggregates, ordered rules and graphs over a record's parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import graph, sequence
from riskloom.plans.base import FRAME_SQL, Plan, frame
from riskloom.session import table

plan = Plan()

# Event type (as a detector's name) -> impact.
IMPACT = {"error": "high", "purchase": "medium", "click": "low", "view": "informational", "signup": "optimization"}
CASES = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IMPACT.items()) + " ELSE 'informational' END"


@plan("detector_flags", f"""
    SELECT user_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS has_error, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS has_purchase, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS has_click,
           count(*) FILTER (WHERE i = 'high') AS high, count(*) FILTER (WHERE i = 'medium') AS medium, count(*) FILTER (WHERE i IN ('low', 'informational')) AS low, count(DISTINCT event_type) AS fired
    FROM (SELECT *, {CASES} AS i FROM events) GROUP BY user_id""")  # fmt: skip
def detector_flags(spark, sf_dir):
    """Detector results to flags and severity counts; the mapping is a literal, informational counts as low."""
    impact = F.coalesce(F.create_map(*[F.lit(x) for kv in IMPACT.items() for x in kv])[F.col("event_type")], F.lit("informational"))
    has = lambda t: F.max((F.col("event_type") == t).cast("int")).alias(f"has_{t}")
    return table(spark, sf_dir, "events").withColumn("i", impact).groupBy("user_id").agg(
        has("error"), has("purchase"), has("click"), F.count_if(F.col("i") == "high").alias("high"), F.count_if(F.col("i") == "medium").alias("medium"),
        F.count_if(F.col("i").isin("low", "informational")).alias("low"), F.countDistinct("event_type").alias("fired"),
    )


@plan("detector_pivot", "SELECT user_id, " + ", ".join(f"coalesce(bool_or(event_type = '{t}'), false) AS detector_{t}" for t in IMPACT) + ", round(count(DISTINCT event_type) / 5.0::DOUBLE, 3) AS fire_rate FROM events GROUP BY user_id")
def detector_pivot(spark, sf_dir):
    """One boolean for each detector of a fixed list, and the share that fired."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(*[F.coalesce(F.bool_or(F.col("event_type") == t), F.lit(False)).alias(f"detector_{t}") for t in IMPACT], F.round(F.countDistinct("event_type") / F.lit(5.0), 3).alias("fire_rate"))


@plan("api_counts", """
    SELECT l_orderkey, count(*) AS functions, count(*) FILTER (WHERE l_returnflag = 'N') AS external_calls, count(*) FILTER (WHERE l_linestatus = 'O') AS writes, round(avg(l_quantity), 2) AS avg_size, max(l_linenumber) AS deepest FROM lineitem GROUP BY l_orderkey""")  # fmt: skip
def api_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("functions"), F.count_if(F.col("l_returnflag") == "N").alias("external_calls"), F.count_if(F.col("l_linestatus") == "O").alias("writes"),
        F.round(F.avg("l_quantity"), 2).alias("avg_size"), F.max("l_linenumber").alias("deepest"))


@plan("cyclomatic", """
    SELECT conv_id, max(c) AS max_complexity, floor(avg(c))::BIGINT AS avg_complexity, sum(c)::BIGINT AS total FROM (
      SELECT conv_id, role, 1 + count(*) FILTER (WHERE length(text) % 3 = 0) AS c FROM conversations GROUP BY ALL) GROUP BY conv_id""")  # fmt: skip
def cyclomatic(spark, sf_dir):
    """One and the branch nodes of each function, then maximum, truncated mean and sum for each record."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg((F.lit(1) + F.count_if(F.length("text") % 3 == 0)).alias("c"))
    return c.groupBy("conv_id").agg(F.max("c").alias("max_complexity"), F.floor(F.avg("c")).alias("avg_complexity"), F.sum("c").alias("total"))


@plan("detector_stats", f"SELECT id, detectors, round(detectors / greatest(num_functions, 1)::DOUBLE, 2) AS per_function, round(detectors * 100.0::DOUBLE / CASE WHEN lines_of_code = 0 THEN 1 ELSE lines_of_code END, 2) AS per_100_loc FROM {FRAME_SQL}")
def detector_stats(spark, sf_dir):
    d = F.col("detectors")
    loc = F.when(F.col("lines_of_code") == 0, 1).otherwise(F.col("lines_of_code"))
    return frame(spark, sf_dir).select("id", "detectors", F.round(d / F.greatest("num_functions", F.lit(1)), 2).alias("per_function"), F.round(d * 100.0 / loc, 2).alias("per_100_loc"))


@plan("risk_scores", f"""
    SELECT id, sec, round(q, 6) AS quality, round(sec + 0.5 * q, 6) AS overall, sec > 20 OR high >= 3 OR detectors >= 7 AS high_risk
    FROM (SELECT id, high, detectors, 10 * high + 5 * medium + low AS sec, greatest(0, 2 * max_complexity + avg_complexity - 10 * comment_ratio) AS q FROM {FRAME_SQL})""")  # fmt: skip
def risk_scores(spark, sf_dir):
    f = frame(spark, sf_dir)
    sec = 10 * F.col("high") + 5 * F.col("medium") + F.col("low")
    q = F.greatest(F.lit(0.0), 2 * F.col("max_complexity") + F.col("avg_complexity") - 10 * F.col("comment_ratio"))
    return f.select("id", sec.alias("sec"), F.round(q, 6).alias("quality"), F.round(sec + 0.5 * q, 6).alias("overall"), ((sec > 20) | (F.col("high") >= 3) | (F.col("detectors") >= 7)).alias("high_risk"))


@plan("call_write_order", """
    WITH s AS (SELECT user_id, ts::DATE AS day, event_id AS pos, event_type = 'click' AS c, event_type = 'purchase' AS w, value > 50 AS ok FROM events),
         a AS (SELECT user_id, day, min(CASE WHEN c THEN pos END) AS fc, max(CASE WHEN w THEN pos END) AS lw FROM s GROUP BY ALL)
    SELECT user_id, day, max(CASE WHEN coalesce(lw >= fc, false) THEN 1 ELSE 0 END) AS violation, max(CASE WHEN coalesce(lw <= fc, false) THEN 1 ELSE 0 END) AS safe,
           count(*) FILTER (WHERE w AND pos <= fc)::INT AS before, count(*) FILTER (WHERE c AND NOT ok AND pos < lw)::INT AS unchecked FROM s JOIN a USING (user_id, day) GROUP BY ALL""")  # fmt: skip
def call_write_order(spark, sf_dir):
    """Writes after calls, by user and day."""
    s = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("pos"), "event_type", "value")
    return sequence.call_write_rules(s, ["user_id", "day"], "pos", F.col("event_type") == "click", F.col("event_type") == "purchase", F.col("value") > 50)


@plan("cei_pattern_score", """
    WITH s AS (SELECT user_id, ts::DATE AS day, event_id AS pos, event_type = 'click' AS c, event_type = 'purchase' AS w FROM events),
         a AS (SELECT user_id, day, min(CASE WHEN c THEN pos END) AS fc, max(CASE WHEN w THEN pos END) AS lw FROM s GROUP BY ALL)
    SELECT user_id, count(*) FILTER (WHERE lw >= fc) AS violations, count(*) FILTER (WHERE lw <= fc) AS safe,
           CASE WHEN count(*) FILTER (WHERE lw >= fc OR lw <= fc) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE lw <= fc)::DOUBLE / (count(*) FILTER (WHERE lw >= fc) + count(*) FILTER (WHERE lw <= fc)), 6) END AS score FROM a GROUP BY user_id""")  # fmt: skip
def cei_pattern_score(spark, sf_dir):
    by = call_write_order(spark, sf_dir).groupBy("user_id").agg(F.sum("violation").alias("violations"), F.sum("safe").alias("safe"))
    return by.withColumn("score", F.round(sequence.cei_score(F.col("safe"), F.col("violations")), 6))


@plan("guard_detection", "SELECT source, count(*) AS docs, count(*) FILTER (WHERE regexp_matches(lower(text), 'lock|mutex|guard|entered')) AS guarded FROM documents GROUP BY source")
def guard_detection(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("lock", "mutex", "guard", "entered")])  # Fixed values: names of guards
    d = table(spark, sf_dir, "documents").select("source", F.exists(words, lambda w: F.contains(F.lower("text"), w)).alias("g"))
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.count_if("g").alias("guarded"))


@plan("dataflow_counts", """
    WITH t AS (SELECT conv_id, regexp_matches(lower(text), 'the|und|les') AS sink, role = 'user' AS source, length(text) > 200 AS validated FROM conversations)
    SELECT conv_id, count(*) FILTER (WHERE sink) AS sinks, count(*) FILTER (WHERE sink AND source) AS tainted, count(*) FILTER (WHERE validated) AS validated, count(*) FILTER (WHERE source AND NOT validated) AS unvalidated FROM t GROUP BY conv_id""")  # fmt: skip
def dataflow_counts(spark, sf_dir):
    sink, source, valid = F.lower("text").rlike("the|und|les"), F.col("role") == "user", F.length("text") > 200
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(sink).alias("sinks"), F.count_if(sink & source).alias("tainted"), F.count_if(valid).alias("validated"), F.count_if(source & ~valid).alias("unvalidated"))


@plan("taint_fold", """
    WITH s AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) > 0 AS t FROM events)
    SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS sources, count(*) FILTER (WHERE t AND event_type = 'purchase') AS tainted_sinks, round(count(*) FILTER (WHERE t)::DOUBLE / count(*), 6) AS ratio FROM s GROUP BY user_id""")  # fmt: skip
def taint_fold(spark, sf_dir):
    """Forward taint: steps at or after a source are tainted, which is a minimum, not a fold over rows."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("from_id"))
    t = F.coalesce(F.col("event_id") >= F.col("from_id"), F.lit(False))
    return e.join(first, "user_id", "left").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "signup").alias("sources"), F.count_if(t & (F.col("event_type") == "purchase")).alias("tainted_sinks"), F.round(F.count_if(t) / F.count("*"), 6).alias("ratio"))


@plan("ir_op_counts", "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in IMPACT) + " FROM events GROUP BY user_id")
def ir_op_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in IMPACT])


@plan("extended_api", f"""
    SELECT num_modifiers, count(*) AS n, sum(num_functions)::BIGINT AS functions, round(avg(num_external_calls), 2) AS avg_external, round(avg(num_state_vars), 2) AS avg_state FROM {FRAME_SQL} GROUP BY num_modifiers""")  # fmt: skip
def extended_api(spark, sf_dir):
    return frame(spark, sf_dir).groupBy("num_modifiers").agg(F.count("*").alias("n"), F.sum("num_functions").alias("functions"), F.round(F.avg("num_external_calls"), 2).alias("avg_external"), F.round(F.avg("num_state_vars"), 2).alias("avg_state"))


@plan("aggregated_ratios", f"""
    SELECT id, round(high / t::DOUBLE, 3) AS high_ratio, round(medium / t::DOUBLE, 3) AS medium_ratio, round(low / t::DOUBLE, 3) AS low_ratio, round(num_external_calls / greatest(num_functions, 1)::DOUBLE, 3) AS external_ratio,
           abs(max_complexity - avg_complexity) AS complexity_gap, max_complexity > 10 AS complex, avg_complexity < 3 AS simple, round(loc / greatest(num_functions, 1)::DOUBLE, 2) AS loc_per_function,
           CASE WHEN high + medium + low = 0 THEN 0.0 ELSE round((high + medium + low) * 100 / loc::DOUBLE, 2) END AS density
    FROM (SELECT *, CASE WHEN high + medium + low = 0 THEN 1 ELSE high + medium + low END AS t, CASE WHEN lines_of_code = 0 THEN 100 ELSE lines_of_code END AS loc FROM {FRAME_SQL})""")  # fmt: skip
def aggregated_ratios(spark, sf_dir):
    """Cross-tier ratios; a record without findings has density 0."""
    c = F.col
    every = c("high") + c("medium") + c("low")
    t, loc = F.when(every == 0, 1).otherwise(every), F.when(c("lines_of_code") == 0, 100).otherwise(c("lines_of_code"))
    nf = F.greatest("num_functions", F.lit(1))
    return frame(spark, sf_dir).select(
        "id", *[F.round(c(x) / t, 3).alias(f"{x}_ratio") for x in ("high", "medium", "low")], F.round(c("num_external_calls") / nf, 3).alias("external_ratio"),
        F.abs(c("max_complexity") - c("avg_complexity")).alias("complexity_gap"), (c("max_complexity") > 10).alias("complex"), (c("avg_complexity") < 3).alias("simple"),
        F.round(loc / nf, 2).alias("loc_per_function"), F.when(every == 0, 0.0).otherwise(F.round(every * 100 / loc, 2)).alias("density"),
    )


@plan("default_vector", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic, CASE WHEN l.doc_id IS NULL THEN 'failed' ELSE 'success' END AS status, CASE WHEN l.doc_id IS NULL THEN 'NO_LABEL' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def default_vector(spark, sf_dir):
    """Records without features keep a row of defaults, with status and reason."""
    l = table(spark, sf_dir, "labels").withColumn("_seen", F.lit(True))
    d = table(spark, sf_dir, "documents").select("doc_id").join(l, "doc_id", "left")
    gone = F.col("_seen").isNull()
    return d.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.when(gone, "failed").otherwise("success").alias("status"), F.when(gone, "NO_LABEL").alias("reason"))


EDGES = "SELECT DISTINCT src, dst FROM (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL"


def transitions(spark, sf_dir):
    """user_id, src, dst: one event type following another."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return e.where("dst IS NOT NULL")


@plan("call_graph_degrees", f"WITH e AS ({EDGES}) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
def call_graph_degrees(spark, sf_dir):
    return graph.degrees(transitions(spark, sf_dir).select("src", "dst").distinct(), [])


@plan("call_graph_depth", """
    WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS src, o_custkey % 25 AS dst FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey <> o_custkey % 25 AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000),
      w AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM w JOIN e ON w.node = e.src WHERE depth < 6)
    SELECT node, min(depth) AS depth FROM w GROUP BY node""")  # fmt: skip
def call_graph_depth(spark, sf_dir):
    """Fewest steps from node 0, by rounds of joins over the distinct edges."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").select("o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    e = c.join(o, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").cast("long").alias("src"), (F.col("o_custkey") % 25).alias("dst")).where("src != dst").distinct()
    roots = spark.range(1).select(F.col("id").alias("node"))
    return graph.depths(e, roots, 6)


@plan("graph_measures")
def graph_measures(spark, sf_dir):
    """Cycles, strong components, longest path, depth, exits and dominance frontier of each user's transition graph."""
    t = transitions(spark, sf_dir)
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("entry"))
    return graph.measures(t.join(first, "user_id"), "user_id", "entry")


QUERIES, ORACLE_SQL = plan.queries, plan.oracle_sql
