"""Version resolution, notes beside scores, totals of routing, tails of a history, stored models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from riskloom.operators import evaluation as ev
from riskloom.operators import learning as ml
from riskloom.operators import scoring as sc
from riskloom.operators import versions
from riskloom.plans import scoring
from riskloom.plans.base import Plan
from riskloom.plans.learning import halves
from riskloom.session import scratch, table
from riskloom.sources.models import ModelStore
from riskloom.streaming import history

plan = Plan()
c = F.col
#: a pragma from a document's numbers; the same text is valid in Spark and DuckDB
PRAGMA = "concat('// SPDX ', CASE n_chars % 7 WHEN 0 THEN 'pragma none' ELSE concat('Pragma solidity ', CASE n_chars % 3 WHEN 0 THEN '^' WHEN 1 THEN '>=' ELSE '' END, '0.', n_chars % 9, CASE WHEN n_chars % 5 = 0 THEN '' ELSE concat('.', doc_id % 27) END, CASE WHEN n_chars % 3 = 1 AND n_chars % 2 = 0 THEN concat(' <0.', n_chars % 11, '.0') ELSE '' END, ';') END)"


@plan("pragma_resolution", f"""
    WITH q AS (SELECT doc_id, {PRAGMA} AS s, n_chars FROM documents), v AS (SELECT DISTINCT n_chars % 9 AS b, doc_id % 31 AS c FROM documents WHERE doc_id % 5 = 0),
      r AS (SELECT doc_id, n_chars % 3 AS kind, n_chars % 9 AS b, CASE WHEN n_chars % 5 = 0 THEN 0 ELSE doc_id % 27 END AS c, n_chars % 5 = 0 AS open, CASE WHEN n_chars % 3 = 1 AND n_chars % 2 = 0 THEN n_chars % 11 END AS below FROM documents WHERE n_chars % 7 <> 0),
      m AS (SELECT r.doc_id, max(v.b * 1000 + v.c) AS best FROM r JOIN v ON v.b * 1000 + v.c >= r.b * 1000 + r.c AND CASE WHEN kind = 1 THEN below IS NULL OR v.b < below WHEN kind = 0 OR open THEN v.b = r.b ELSE v.b = r.b AND v.c = r.c END GROUP BY r.doc_id)
    SELECT d.doc_id, CASE WHEN best IS NOT NULL THEN concat('0.', best // 1000, '.', best % 1000) END AS resolved FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id""")  # fmt: skip
def pragma_resolution(spark, sf_dir):
    """The highest available version that each document's pragma allows; the available ones are a table, too."""
    d = table(spark, sf_dir, "documents")
    available = d.where("doc_id % 5 = 0").select(F.lit(0).alias("major"), (c("n_chars") % 9).alias("minor"), (c("doc_id") % 31).alias("patch"))
    return versions.resolve(d.select("doc_id", F.expr(PRAGMA).alias("source")), "source", available).select("doc_id", "resolved")


@plan("confidence_notes", scoring.SCORED_SQL + """
    SELECT id, concat_ws(',', CASE WHEN ml > 0.9 AND st > 0.7 THEN 'aligned_certainty' WHEN ml > 0.6 AND st > 0.5 THEN 'moderate_certainty' END, CASE WHEN st > 0.7 AND ml > 0.4 THEN 'static_signals' END,
      CASE WHEN q > 0.8 THEN 'high_quality' WHEN q < 0.4 THEN 'low_quality' END, CASE WHEN against THEN 'contradiction' END) AS notes, round(least(1, greatest(0.1, x4)), 6) AS confidence FROM c4""")  # fmt: skip
def confidence_notes(spark, sf_dir):
    """Each row's confidence with what raised or lowered it."""
    return scoring.scored(spark, sf_dir).select("id", F.array_join(sc.confidence_notes(c("ml"), c("st"), c("q"), c("against")), ",").alias("notes"), "confidence")


def totals(routed):
    """One row: counts, shares in per cent, and the scores' mean and ends; zeros without any row."""
    n, simple = F.count("*"), F.count_if(c("route") == "simple")
    share = lambda x: F.coalesce(F.round(F.try_divide(x * F.lit(100.0), n), 4), F.lit(0.0))
    zero = lambda x, name: F.coalesce(x, F.lit(0.0)).alias(name)
    return routed.agg(n.alias("n"), simple.alias("simple"), (n - simple).alias("complex"), share(simple).alias("simple_pct"), share(n - simple).alias("complex_pct"), zero(F.round(F.avg("score"), 4), "mean"), zero(F.min("score"), "lo"), zero(F.max("score"), "hi"))


TOTALS_SQL = "SELECT count(*) AS n, count(*) FILTER (WHERE route = 'simple') AS simple, count(*) FILTER (WHERE route <> 'simple') AS complex, coalesce(round(count(*) FILTER (WHERE route = 'simple') * 100.0::DOUBLE / nullif(count(*), 0), 4), 0) AS simple_pct, coalesce(round(count(*) FILTER (WHERE route <> 'simple') * 100.0::DOUBLE / nullif(count(*), 0), 4), 0) AS complex_pct, coalesce(round(avg(score), 4), 0) AS mean, coalesce(min(score), 0) AS lo, coalesce(max(score), 0) AS hi"


@plan("routing_totals", f"WITH r AS ({scoring.plan.oracle_sql['routing_scores']}) SELECT 'all' AS part, * FROM ({TOTALS_SQL} FROM r) UNION ALL SELECT 'above 100', * FROM ({TOTALS_SQL} FROM r WHERE score > 100)")
def routing_totals(spark, sf_dir):
    """Totals of all routed rows, and of those above the largest score there can be: none, so zeros."""
    r = scoring.routing_scores(spark, sf_dir)
    return totals(r).select(F.lit("all").alias("part"), "*").unionByName(totals(r.where("score > 100")).select(F.lit("above 100").alias("part"), "*"))


@plan("history_tails", """
    WITH e AS (SELECT user_id AS key, epoch_us(ts) AS t, event_id AS id, value::DOUBLE AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, value DESC) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL)
    SELECT key, count(*) AS held, round(avg(value), 6) AS mean, string_agg(id, ',' ORDER BY t, id) AS ids FROM e WHERE k <= 20 GROUP BY key""")  # fmt: skip
def history_tails(spark, sf_dir):
    """Each user's last 20 values: their mean, and their ids in order."""
    tails = history.last_values(table(spark, sf_dir, "events"), size=20)
    return tails.select("key", "held", F.round("mean", 6).alias("mean"), F.array_join(F.transform("tail", lambda e: e.id.cast("string")), ",").alias("ids"))


@plan("stored_models")
def stored_models(spark, sf_dir):
    """Three settings of a model registered in a store in the shared folder, read back by version and asked for their held-out area."""
    train, test = halves(spark, sf_dir)
    store = ModelStore(spark, scratch(spark, "models"))
    for reg in (0.001, 0.03, 0.3):
        line = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled"), LogisticRegression(featuresCol="scaled", labelCol="label", regParam=reg)]).fit(train)
        store.register("risk", line, config={"regParam": str(reg)}, bump="minor")
    parts = []
    for entry in store.entries("risk"):
        model, _ = store.load("risk", entry["version"])
        s = ml.score_all({"x": model}, test).select(F.round("p_x", 9).alias("p"), "label")
        parts.append(ev.auc(s, "p", "label").select(F.lit(entry["version"]).alias("version"), F.lit(entry["config"]["regParam"]).alias("reg"), "auc"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES, ORACLE_SQL = plan.queries, plan.oracle_sql
