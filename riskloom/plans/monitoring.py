"""Monitoring of predictions and requests, in batch form, and the registry of models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import evaluation as ev
from riskloom.operators import registry, windows
from riskloom.operators.stats import quantiles
from riskloom.plans.base import Plan
from riskloom.session import table

plan = Plan()
c = F.col


@plan("distribution_snapshot", """
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS lo, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS hi
    FROM events GROUP BY event_type""")  # fmt: skip
def distribution_snapshot(spark, sf_dir):
    events, named = table(spark, sf_dir, "events"), {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    q = quantiles(events, ["value"], list(named), by="event_type").groupBy(c("event_type").alias("_type")).agg(*[F.round(F.max(F.when(c("p") == p, c("value"))), 6).alias(n) for p, n in named.items()])
    by = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return by.join(F.broadcast(q), c("event_type").eqNullSafe(c("_type")), "left").select("event_type", "n", "mean", "std", "lo", *named.values(), "hi")  # a row for each type




def halves(spark, sf_dir):
    """Events with `late`: in the second half of the time covered."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.unix_micros(c("ts").cast("timestamp")).alias("t"))
    lo, hi = e.agg(F.min("t"), F.max("t")).first()
    return e.withColumn("late", c("t") >= F.lit(((lo or 0) + (hi or 0)) / 2))


LATE = "epoch_us(ts) >= (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) / 2.0::DOUBLE FROM events)"


@plan("ks_drift", f"""
    WITH e AS (SELECT value AS v, {LATE} AS late FROM events WHERE value IS NOT NULL), n AS (SELECT count(*) FILTER (WHERE late) AS a, count(*) FILTER (WHERE NOT late) AS b FROM e),
      d AS (SELECT v, sum(count(*) FILTER (WHERE late)) OVER (ORDER BY v) AS ca, sum(count(*) FILTER (WHERE NOT late)) OVER (ORDER BY v) AS cb FROM e GROUP BY v)
    SELECT round(max(abs(ca::DOUBLE / a - cb::DOUBLE / b)), 9) AS ks, max(a)::BIGINT AS n_a, max(b)::BIGINT AS n_b FROM d, n""")  # fmt: skip
def ks_drift(spark, sf_dir):
    k = ev.two_sample_ks(halves(spark, sf_dir), "value", c("late"))
    return k.select(F.round("ks", 9).alias("ks"), "n_a", "n_b")


@plan("categorical_drift", f"""
    WITH e AS (SELECT event_type, count(*) FILTER (WHERE late) AS a, count(*) FILTER (WHERE NOT late) AS b FROM (SELECT event_type, {LATE} AS late FROM events) GROUP BY event_type)
    SELECT round(sum(abs(a::DOUBLE / ta - b::DOUBLE / tb)) / count(*), 9) AS drift, count(*) AS categories, round(sum(abs(a::DOUBLE / ta - b::DOUBLE / tb)) / count(*), 9) > 0.05 AS drifted FROM e, (SELECT sum(a) AS ta, sum(b) AS tb FROM e)""")  # fmt: skip
def categorical_drift(spark, sf_dir):
    e = halves(spark, sf_dir).groupBy("event_type").agg(F.count_if("late").alias("a"), F.count_if(~c("late")).alias("b"))
    w = Window.partitionBy(F.lit(1))
    gap = e.select(F.abs(c("a") / F.sum("a").over(w) - c("b") / F.sum("b").over(w)).alias("g"))
    d = gap.agg(F.round(F.sum("g") / F.count("*"), 9).alias("drift"), F.count("*").alias("categories"))
    return d.withColumn("drifted", c("drift") > 0.05)


@plan("performance_degradation", """
    WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS j FROM events)
    SELECT user_id, round(avg(value) FILTER (WHERE i <= 20), 6) AS baseline, round(avg(value) FILTER (WHERE j <= 10), 6) AS recent, round(avg(value) FILTER (WHERE i <= 20), 6) - round(avg(value) FILTER (WHERE j <= 10), 6) > 0.1 AS degraded FROM k GROUP BY user_id""")  # fmt: skip
def performance_degradation(spark, sf_dir):
    """First rows of each key as the baseline, the last as the present."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    first = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = Window.partitionBy("user_id").orderBy(c("ts").desc(), c("event_id").desc())
    k = e.withColumn("i", F.row_number().over(first)).withColumn("j", F.row_number().over(last))
    by = k.groupBy("user_id").agg(F.round(F.avg(F.when(c("i") <= 20, c("value"))), 6).alias("baseline"), F.round(F.avg(F.when(c("j") <= 10, c("value"))), 6).alias("recent"))
    return by.withColumn("degraded", c("baseline") - c("recent") > 0.1)


@plan("performance_report", """
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value > 50) AS positives FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type""")  # fmt: skip
def performance_report(spark, sf_dir):
    """The last seven days; the end is one aggregate, the filter then reaches the scan."""
    e = table(spark, sf_dir, "events")
    end = e.agg(F.max("ts")).first()[0]
    return e.where(c("ts") > F.lit(end).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(c("value") > 50).alias("positives"))


def _anchored_sql(seconds: int, most: int, select: str) -> str:
    return f"""
    WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS i FROM events),
      w AS (SELECT user_id, event_type, i, t AS open, 1 AS used, 1 AS fresh FROM e WHERE i = 1
            UNION ALL SELECT e.user_id, e.event_type, e.i, CASE WHEN e.t - w.open >= {seconds * 1_000_000} THEN e.t ELSE w.open END, CASE WHEN e.t - w.open >= {seconds * 1_000_000} THEN 1 ELSE w.used + 1 END, CASE WHEN e.t - w.open >= {seconds * 1_000_000} THEN 1 ELSE 0 END
            FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.i = w.i + 1)
    SELECT user_id, event_type, {select} FROM w GROUP BY user_id, event_type"""


@plan("rate_limit_windows", _anchored_sql(86_400, 2, "count(*) AS n, count(*) FILTER (WHERE used > 2) AS over_limit, sum(fresh)::BIGINT AS windows"))
def rate_limit_windows(spark, sf_dir):
    """Fixed windows of a day anchored at their first request, two requests each."""
    return windows.anchored(table(spark, sf_dir, "events"), ["user_id", "event_type"], c("ts"), 86_400, 2)


@plan("cache_hit_rate", _anchored_sql(43_200, 1, "count(*) AS requests, sum(fresh)::BIGINT AS misses, count(*) - sum(fresh)::BIGINT AS hits, round((count(*) - sum(fresh)) / count(*)::DOUBLE, 6) AS hit_rate"))
def cache_hit_rate(spark, sf_dir):
    return windows.cache_hits(table(spark, sf_dir, "events"), ["user_id", "event_type"], c("ts"), 43_200)


@plan("rate_limited_paths", """
    WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) AS t FROM events WHERE event_type <> 'view' AND NOT (user_id % 7 = 0)),
      w AS (SELECT user_id, i, t AS open, 1 AS used FROM e WHERE i = 1
            UNION ALL SELECT e.user_id, e.i, CASE WHEN e.t - w.open >= 86400000000 THEN e.t ELSE w.open END, CASE WHEN e.t - w.open >= 86400000000 THEN 1 ELSE w.used + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
    SELECT user_id, count(*) AS n, count(*) FILTER (WHERE used > 3) AS over_limit, count(*) FILTER (WHERE used = 1) AS windows FROM w GROUP BY user_id""")  # fmt: skip
def rate_limited_paths(spark, sf_dir):
    """The same for limited paths only, private callers passing by."""
    ip = F.when(c("user_id") % 7 == 0, F.concat(F.lit("10.0.0."), c("user_id"))).otherwise(F.concat(F.lit("203.0.113."), c("user_id")))
    path = F.concat(F.lit("/api/"), c("event_type"))
    private = ip.rlike(r"^(10\.|192\.168\.|127\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    return windows.anchored(table(spark, sf_dir, "events"), ["user_id"], c("ts"), 86_400, 3, free=private | path.startswith("/api/view"))


@plan("cache_errors", "SELECT event_type, count(*) AS requests, count(*) FILTER (WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) >= 90) AS errors, round(count(*) FILTER (WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) >= 90) / count(*)::DOUBLE, 6) AS error_rate FROM events GROUP BY event_type")
def cache_errors(spark, sf_dir):
    """Requests whose cache call failed, which count as neither hit nor miss."""
    bad = F.coalesce(F.get_json_object("props", "$.k").try_cast("long") >= 90, F.lit(False))
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if(bad).alias("errors"))
    return by.withColumn("error_rate", F.round(c("errors") / c("requests"), 6))


# Upper edges of the latency histogram.
EDGES = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


@plan("latency_histogram", " UNION ALL ".join([f"SELECT event_type, '{e}' AS le, count(*) FILTER (WHERE value <= {e}) AS n FROM events GROUP BY event_type" for e in EDGES] + ["SELECT event_type, '+Inf', count(value) FROM events GROUP BY event_type"]))
def latency_histogram(spark, sf_dir):
    return windows.cumulative_histogram(table(spark, sf_dir, "events"), ["event_type"], "value", EDGES)


@plan("labelled_counters", "SELECT event_type, user_id % 3 AS shard, count(*) AS total, round(sum(value), 2) AS sum_value, max(value) AS gauge FROM events GROUP BY ALL")
def labelled_counters(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (c("user_id") % 3).alias("shard")).agg(F.count("*").alias("total"), F.round(F.sum("value"), 2).alias("sum_value"), F.max("value").alias("gauge"))


@plan("progress_marks", "SELECT user_id, max(i) // 25 AS checkpoints, max(i) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) GROUP BY user_id")
def progress_marks(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.floor(c("n") / 25).alias("checkpoints"), "n")


REGISTRY = "(SELECT p_partkey AS version_id, p_brand AS model, (p_size % 3) * 10000 + (p_size % 7) * 100 + p_partkey % 50 AS semver, p_retailprice / 2500 AS auc FROM part)"


@plan("registry_history", f"""
    SELECT model, count(*) AS versions, max(semver) AS latest, arg_max(version_id, struct_pack(a := auc, v := -version_id)) AS best, round(max(auc), 6) AS best_auc,
           round(max(auc) - avg(auc), 6) AS over_mean, max(semver) + 1 AS next_patch FROM {REGISTRY} GROUP BY model""")  # fmt: skip
def registry_history(spark, sf_dir):
    """Latest, best and next version of each model."""
    p = c("p_size")
    r = table(spark, sf_dir, "part").select(c("p_partkey").alias("version_id"), c("p_brand").alias("model"), ((p % 3) * 10000 + (p % 7) * 100 + c("p_partkey") % 50).alias("semver"), (c("p_retailprice") / 2500).alias("auc"))
    return r.groupBy("model").agg(
        F.count("*").alias("versions"), F.max("semver").alias("latest"), F.max_by("version_id", F.struct("auc", -c("version_id"))).alias("best"), F.round(F.max("auc"), 6).alias("best_auc"),
        F.round(F.max("auc") - F.avg("auc"), 6).alias("over_mean"), (F.max("semver") + 1).alias("next_patch"))


@plan("registry_retained", f"SELECT model, version_id, semver FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY semver DESC, version_id DESC) AS k FROM {REGISTRY}) WHERE k <= 5")
def registry_retained(spark, sf_dir):
    p = c("p_size")
    r = table(spark, sf_dir, "part").select(c("p_brand").alias("model"), c("p_partkey").alias("version_id"), ((p % 3) * 10000 + (p % 7) * 100 + c("p_partkey") % 50).alias("semver"))
    k = F.row_number().over(Window.partitionBy("model").orderBy(c("semver").desc(), c("version_id").desc()))
    return r.withColumn("k", k).where("k <= 5").drop("k")


#: column -> expression: a row for each version of a model
VERSIONS = {
    "model": "p_brand",
    "semver": "p_size",
    "auc": "round(avg(p_retailprice) / 2500, 6)",
    "brier": "round(1 - avg(p_retailprice) / 2500, 6)",
    "stage": "CASE WHEN p_size % 6 = 0 THEN 'production' WHEN p_size % 6 = 3 THEN 'retired' ELSE 'none' END",
}
VERSIONS_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in VERSIONS.items()) + " FROM part GROUP BY p_brand, p_size)"


def versions(spark, sf_dir):
    grouped = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.round(F.avg("p_retailprice") / 2500, 6).alias("auc"), F.round(1 - F.avg("p_retailprice") / 2500, 6).alias("brier"))
    features = F.transform(F.sequence(c("p_size"), c("p_size") + 3), lambda i: F.concat(F.lit("f"), i % 5))
    return grouped.select(c("p_brand").alias("model"), c("p_size").cast("long").alias("semver"), "auc", "brier", F.expr(VERSIONS["stage"]).alias("stage"), features.alias("features"))


@plan("registry_compare", f"""
    WITH v AS (SELECT *, min(semver) OVER (PARTITION BY model) AS lo, max(semver) OVER (PARTITION BY model) AS hi FROM {VERSIONS_SQL}),
      b AS (SELECT model, max(auc) FILTER (WHERE semver = lo) AS a0, max(auc) FILTER (WHERE semver = hi) AS a1, max(brier) FILTER (WHERE semver = lo) AS b0, max(brier) FILTER (WHERE semver = hi) AS b1,
              max(list_transform(range(4), lambda i: (semver + i) % 5)) FILTER (WHERE semver = lo) AS f0, max(list_transform(range(4), lambda i: (semver + i) % 5)) FILTER (WHERE semver = hi) AS f1 FROM v GROUP BY model)
    SELECT model, metric, x AS first, y AS second, round(x - y, 6) AS difference, len(list_filter(f1, lambda e: NOT list_contains(f0, e))) AS added, len(list_filter(f0, lambda e: NOT list_contains(f1, e))) AS removed
    FROM (SELECT model, 'auc' AS metric, a0 AS x, a1 AS y, f0, f1 FROM b UNION ALL SELECT model, 'brier', b0, b1, f0, f1 FROM b)""")  # fmt: skip
def registry_compare(spark, sf_dir):
    """The oldest and the newest version of each model."""
    v = versions(spark, sf_dir)
    ends = v.groupBy(c("model").alias("_e")).agg(F.min("semver").alias("lo"), F.max("semver").alias("hi"))
    found = registry.compare(v.join(ends, c("model") == c("_e")), c("semver") == c("lo"), c("semver") == c("hi"))
    return found.withColumn("difference", F.round("difference", 6))


STAGED_SQL = f"""
    SELECT model, semver, CASE WHEN semver = new THEN 'production' WHEN stage = 'production' AND new IS NOT NULL THEN 'retired' ELSE stage END AS stage
    FROM (SELECT *, max(CASE WHEN auc > 0.4 AND semver % 6 <> 0 THEN semver END) OVER (PARTITION BY model) AS new FROM {VERSIONS_SQL})"""


@plan("registry_promote", STAGED_SQL)
def registry_promote(spark, sf_dir):
    """The newest version with a large enough area goes to production; those that were there retire."""
    return registry.promote(versions(spark, sf_dir), (c("auc") > 0.4) & (c("semver") % 6 != 0)).select("model", "semver", "stage")


@plan("registry_rollback", f"""
    WITH s AS ({STAGED_SQL}), n AS (SELECT *, max(CASE WHEN stage = 'production' THEN semver END) OVER (PARTITION BY model) AS now FROM s),
      b AS (SELECT *, max(CASE WHEN stage = 'retired' AND semver < now THEN semver END) OVER (PARTITION BY model) AS back FROM n)
    SELECT model, semver, CASE WHEN semver = back THEN 'production' WHEN stage = 'production' AND back IS NOT NULL THEN 'retired' ELSE stage END AS stage FROM b""")  # fmt: skip
def registry_rollback(spark, sf_dir):
    """The promotion taken back: the newest retired version before the one in production returns."""
    staged = registry.promote(versions(spark, sf_dir), (c("auc") > 0.4) & (c("semver") % 6 != 0))
    return registry.roll_back(staged).select("model", "semver", "stage")


@plan("upsert_merge", """
    SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.quality, o.quality) AS quality, coalesce(n.toxic, o.toxic) AS toxic, CASE WHEN o.doc_id IS NULL THEN 'inserted' WHEN n.doc_id IS NULL THEN 'kept' ELSE 'updated' END AS action
    FROM labels o FULL JOIN (SELECT doc_id, (n_chars % 2)::INT AS quality, 0 AS toxic FROM documents WHERE doc_id % 3 = 0) n ON o.doc_id = n.doc_id""")  # fmt: skip
def upsert_merge(spark, sf_dir):
    """Insert or update by key as one full join."""
    from riskloom.sources.sinks import upsert

    new = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", (c("n_chars") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    old = table(spark, sf_dir, "labels").select("doc_id", c("quality").cast("int").alias("quality"), c("toxic").cast("int").alias("toxic"))
    return upsert(old, new, ["doc_id"])


@plan("skip_existing", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def skip_existing(spark, sf_dir):
    from riskloom.sources.sinks import new_rows

    return new_rows(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"])


@plan("conditional_update", """
    SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN CAST(round(greatest(o_totalprice / 1000, 1)) AS BIGINT) ELSE 0 END AS imputed FROM orders""")  # fmt: skip
def conditional_update(spark, sf_dir):
    """UPDATE ... SET greatest(expr, 1) WHERE EXISTS, as a semi-join flag."""
    hit = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(hit, "o_orderkey", "left")
    return o.select("o_orderkey", F.when(c("hit"), F.round(F.greatest(c("o_totalprice") / 1000, F.lit(1.0))).cast("long")).otherwise(F.lit(0)).alias("imputed"))


QUERIES, ORACLE_SQL = plan.queries, plan.oracle_sql
