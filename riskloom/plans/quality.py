"""Relational quality reports over documents, labels and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators.stats import correlations, per_column, quantiles, safe_corr, union_all
from riskloom.plans.base import FRAME_SQL, Plan, frame
from riskloom.session import table

plan = Plan()


def labelled(spark: SparkSession, sf_dir: str, how: str = "left") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", how)


@plan("source_quality_report", """
    SELECT d.source, count(*) AS total, count(l.doc_id) AS labelled, count(*) - count(l.doc_id) AS unlabelled,
           round(100.0::DOUBLE * count(l.doc_id) / count(*), 1) AS rate
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""")  # fmt: skip
def source_quality_report(spark, sf_dir):
    """By source: documents, those with and without a label, and the labelled share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("seen"))
    by = docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count("seen").alias("labelled"))
    return by.select("source", "total", "labelled", (F.col("total") - F.col("labelled")).alias("unlabelled"), F.round(F.lit(100.0) * F.col("labelled") / F.col("total"), 1).alias("rate"))


@plan("label_class_pct", """
    SELECT class, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct
    FROM (SELECT CASE WHEN l.toxic IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS class
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY class""")  # fmt: skip
def label_class_pct(spark, sf_dir):
    """Share of each label class; the total is a window over the few groups, not over rows."""
    named = labelled(spark, sf_dir).select(F.when(F.col("toxic").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("class"))
    counts = named.groupBy("class").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("class", "n", F.round(F.lit(100.0) * F.col("n") / total, 2).alias("pct"))


@plan("dataset_stats", """
    SELECT count(*) AS total, count(CASE WHEN n_chars >= 1000 THEN 1 END) AS long_docs, count(CASE WHEN lang = 'en' THEN 1 END) AS english,
           round(avg(n_chars), 4) AS avg_chars, count(DISTINCT source) AS sources, count(DISTINCT CASE WHEN lang <> 'en' THEN source END) AS foreign_sources
    FROM documents""")  # fmt: skip
def dataset_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(
        F.count("*").alias("total"), F.count_if(F.col("n_chars") >= 1000).alias("long_docs"), F.count_if(F.col("lang") == "en").alias("english"),
        F.round(F.avg("n_chars"), 4).alias("avg_chars"), F.countDistinct("source").alias("sources"),
        F.countDistinct(F.when(F.col("lang") != "en", F.col("source"))).alias("foreign_sources"),
    )


@plan("balanced_flags", """
    SELECT d.doc_id, CASE WHEN v.doc_id IS NOT NULL THEN 1 ELSE 0 END AS flagged
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) v ON d.doc_id = v.doc_id""")  # fmt: skip
def balanced_flags(spark, sf_dir):
    """An existence flag for each document by way of the distinct keys of the other side."""
    marked = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("f", F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id").join(marked, "doc_id", "left").select("doc_id", F.coalesce("f", F.lit(0)).alias("flagged"))


@plan("exists_filter_stats", """
    SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)) AS toxic,
           count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS unlabelled, count(*) AS total FROM documents d""")  # fmt: skip
def exists_filter_stats(spark, sf_dir):
    """Correlated EXISTS inside aggregate filters, as one left join."""
    by = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("t"))
    d = table(spark, sf_dir, "documents").select("doc_id").join(by.withColumn("seen", F.lit(True)), "doc_id", "left")
    return d.agg(F.count_if(F.col("t") == 1).alias("toxic"), F.count_if(F.col("seen").isNull()).alias("unlabelled"), F.count("*").alias("total"))


@plan("fanout_vs_distinct", """
    SELECT o_orderstatus, count(*) AS line_rows, count(DISTINCT o_orderkey) AS orders, count(DISTINCT CASE WHEN l_discount > 0.05 THEN o_orderkey END) AS discounted
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus""")  # fmt: skip
def fanout_vs_distinct(spark, sf_dir):
    """A three-way join's row counts beside distinct counts: lines are summed by order before they meet."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max(F.col("l_discount") > 0.05).alias("deep"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    j = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("o_orderstatus").agg(F.sum("n").alias("line_rows"), F.count("*").alias("orders"), F.count_if("deep").alias("discounted"))


QUANTILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@plan("quantile_summary", " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, min({c}) AS lo, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY {c}), 6) AS q25, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY {c}), 6) AS med,
           round(percentile_cont(0.75) WITHIN GROUP (ORDER BY {c}), 6) AS q75, max({c}) AS hi FROM lineitem""" for c in QUANTILED))  # fmt: skip
def quantile_summary(spark, sf_dir):
    """Exact quartiles of several columns, from counts by value dealt into ranges."""
    lines = table(spark, sf_dir, "lineitem")
    named = {0.25: "q25", 0.5: "med", 0.75: "q75"}
    q = quantiles(lines, QUANTILED, list(named)).groupBy("feature").agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 6).alias(n) for p, n in named.items()])
    return per_column(lines, QUANTILED, {"lo": F.min, "hi": F.max}).join(F.broadcast(q), "feature")  # a row for each column


@plan("segment_means", " UNION ALL ".join(f"""
    SELECT '{n}' AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance, round(avg(CASE WHEN c_acctbal < 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS negative_share
    FROM customer WHERE {w}""" for n, w in (("all", "TRUE"), ("building", "c_mktsegment = 'BUILDING'"), ("negative", "c_acctbal < 0"))))  # fmt: skip
def segment_means(spark, sf_dir):
    """Overlapping segments as conditional means of one pass, instead of a union of scans."""
    c = table(spark, sf_dir, "customer")
    parts = {"all": F.lit(True), "building": F.col("c_mktsegment") == "BUILDING", "negative": F.col("c_acctbal") < 0}
    one = F.when(F.col("c_acctbal") < 0, 1.0).otherwise(0.0)
    aggs = [f(w).alias(f"{n}__{s}") for n, w in parts.items() for s, f in {
        "n": F.count_if, "m": lambda w: F.round(F.avg(F.when(w, F.col("c_acctbal"))), 4), "s": lambda w: F.round(F.avg(F.when(w, one)), 6)}.items()]
    rows = F.array(*[F.struct(F.lit(n).alias("segment"), F.col(f"{n}__n").alias("n"), F.col(f"{n}__m").alias("mean_balance"), F.col(f"{n}__s").alias("negative_share")) for n in parts])
    return c.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


@plan("value_counts", "SELECT event_type, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def value_counts(spark, sf_dir):
    by = table(spark, sf_dir, "events").where("event_type IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n"))
    return by.select("event_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


@plan("crosstab_source_lang", """
    SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr
    FROM documents GROUP BY source""")  # fmt: skip
def crosstab_source_lang(spark, sf_dir):
    """Pivot with its values listed, so no extra job finds them."""
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@plan("group_agg_stats", """
    SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS med, round(stddev_samp(l_extendedprice), 4) AS std, round(sum(l_quantity), 2) AS total
    FROM lineitem GROUP BY l_returnflag""")  # fmt: skip
def group_agg_stats(spark, sf_dir):
    r = lambda c, n: F.round(c, n)
    lines = table(spark, sf_dir, "lineitem")
    med = quantiles(lines, ["l_extendedprice"], [0.5], by="l_returnflag").select(F.col("l_returnflag").alias("_flag"), r("value", 4).alias("med"))  # a row for each flag
    by = lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.avg("l_extendedprice"), 4).alias("mean"), r(F.stddev_samp("l_extendedprice"), 4).alias("std"), r(F.sum("l_quantity"), 2).alias("total"))
    return by.join(F.broadcast(med), F.col("l_returnflag").eqNullSafe(F.col("_flag")), "left").select("l_returnflag", "n", "mean", "med", "std", "total")


MAYBE = ["lang", "source", "quality", "toxic"]


@plan("missing_profile", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, count(*) - count({c}) AS missing, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 4) AS pct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id" for c in MAYBE))
def missing_profile(spark, sf_dir):
    return per_column(labelled(spark, sf_dir), MAYBE, {
        "n": lambda c: F.count("*"), "missing": lambda c: F.count_if(c.isNull()), "pct": lambda c: F.round(F.lit(100.0) * F.count_if(c.isNull()) / F.count("*"), 4)})


SPARSE = ["num_external_calls", "num_low_level_calls", "cei_violations", "has_reentrancy", "has_delegatecall", "has_assembly", "lines_of_code", "detectors"]


@plan("sparsity_profile", "SELECT *, CASE WHEN zero_pct >= 90 THEN 'very sparse' WHEN zero_pct >= 50 THEN 'sparse' WHEN zero_pct >= 10 THEN 'moderate' ELSE 'dense' END AS band FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(100.0::DOUBLE * count(*) FILTER (WHERE {c} = 0) / count(*), 4) AS zero_pct, count(*) FILTER (WHERE {c} <> 0) AS non_zero, round(avg({c}), 6) AS mean, max({c})::DOUBLE AS hi FROM {FRAME_SQL}" for c in SPARSE) + ")")
def sparsity_profile(spark, sf_dir):
    rows = per_column(frame(spark, sf_dir), SPARSE, {
        "zero_pct": lambda c: F.round(F.lit(100.0) * F.count_if(c == 0) / F.count("*"), 4), "non_zero": lambda c: F.count_if(c != 0),
        "mean": lambda c: F.round(F.avg(c), 6), "hi": lambda c: F.max(c).cast("double")})
    z = F.col("zero_pct")
    return rows.withColumn("band", F.when(z >= 90, "very sparse").when(z >= 50, "sparse").when(z >= 10, "moderate").otherwise("dense"))


@plan("feature_metadata", "SELECT *, CASE WHEN feature LIKE 'has\\_%' ESCAPE '\\' THEN 'flag' WHEN feature LIKE 'num\\_%' ESCAPE '\\' THEN 'count' ELSE 'other' END AS category FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} <> 0) AS non_zero_count, round(avg({c}), 6) AS mean_value, round(stddev_samp({c}), 6) AS std_value FROM {FRAME_SQL}" for c in SPARSE) + ")")
def feature_metadata(spark, sf_dir):
    rows = per_column(frame(spark, sf_dir), SPARSE, {"non_zero_count": lambda c: F.count_if(c != 0), "mean_value": lambda c: F.round(F.avg(c), 6), "std_value": lambda c: F.round(F.stddev_samp(c), 6)})
    return rows.withColumn("category", F.when(F.col("feature").startswith("has_"), "flag").when(F.col("feature").startswith("num_"), "count").otherwise("other"))


TARGETED = ["num_external_calls", "max_complexity", "lines_of_code", "high", "has_unchecked_call", "ml"]


def corr_sql(x: str, y: str) -> str:
    return f"CASE WHEN stddev_samp({x}) = 0 OR stddev_samp({y}) = 0 THEN NULL ELSE round(covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})), 9) END"


@plan("corr_with_target", " UNION ALL ".join(f"SELECT '{c}' AS feature, {corr_sql(c, 'risky')} AS r FROM {FRAME_SQL}" for c in TARGETED))
def corr_with_target(spark, sf_dir):
    """Correlation with the target; null, not an error, for constant columns."""
    return per_column(frame(spark, sf_dir), TARGETED, {"r": lambda c: F.round(safe_corr(c, F.col("risky")), 9)})


@plan("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {corr_sql(a, b)} AS r FROM {FRAME_SQL}" for i, a in enumerate(TARGETED) for b in TARGETED[i + 1:]))
def correlation_matrix(spark, sf_dir):
    return correlations(frame(spark, sf_dir), TARGETED).withColumn("r", F.round("r", 9))


@plan("leakage_counts", "SELECT count(*) FILTER (WHERE abs(r) > 0.99) AS perfect, count(*) FILTER (WHERE abs(r) > 0.5) AS high, count(*) AS pairs FROM (" + " UNION ALL ".join(f"SELECT {corr_sql(a, b)} AS r FROM {FRAME_SQL}" for i, a in enumerate([*TARGETED, 'risky', 'has_reentrancy']) for b in [*TARGETED, 'risky', 'has_reentrancy'][i + 1:]) + ")")
def leakage_counts(spark, sf_dir):
    r = F.abs("r")
    return correlations(frame(spark, sf_dir), [*TARGETED, "risky", "has_reentrancy"]).agg(F.count_if(r > 0.99).alias("perfect"), F.count_if(r > 0.5).alias("high"), F.count("*").alias("pairs"))


FLAGS = ["has_reentrancy", "has_unchecked_call", "has_access_control", "has_tx_origin", "has_delegatecall", "has_assembly"]


@plan("flag_distribution", " UNION ALL ".join(f"SELECT '{c}' AS flag, sum({c})::BIGINT AS n, round(100.0::DOUBLE * sum({c}) / count(*), 4) AS pct, round(sum({c})::DOUBLE / (count(*) - sum({c}) + 0.001::DOUBLE), 6) AS ratio, {corr_sql(c, 'high')} AS r FROM {FRAME_SQL}" for c in FLAGS))
def flag_distribution(spark, sf_dir):
    return per_column(frame(spark, sf_dir), FLAGS, {
        "n": lambda c: F.sum(c), "pct": lambda c: F.round(F.lit(100.0) * F.sum(c) / F.count("*"), 4),
        "ratio": lambda c: F.round(F.sum(c) / (F.count("*") - F.sum(c) + F.lit(0.001)), 6), "r": lambda c: F.round(safe_corr(c, F.col("high")), 9)}, key="flag")


@plan("histogram_20", """
    WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT least(20, 1 + CAST(floor((l_extendedprice - lo) / (hi - lo) * 20) AS BIGINT)) AS bin, count(*) AS n, min(l_extendedprice) AS least_value, max(l_extendedprice) AS most_value
    FROM lineitem, b GROUP BY 1""")  # fmt: skip
def histogram_20(spark, sf_dir):
    """Twenty equal bins; the range is one aggregate, sent out as two numbers."""
    x = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    lo, hi = x.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    bin_of = F.least(F.lit(20).cast("long"), F.lit(1) + F.floor((F.col("l_extendedprice") - F.lit(lo)) / F.lit((hi or 1) - (lo or 0)) * 20))
    return x.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("least_value"), F.max("l_extendedprice").alias("most_value"))


@plan("duplicate_groups", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("n > 1")


@plan("duplicate_rows_all_copies", "SELECT doc_id, n FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) WHERE n > 1")
def duplicate_rows_all_copies(spark, sf_dir):
    """All copies of each duplicate: counts by digest joined back, so a hot digest never sits in one window."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    many = d.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return d.join(many, "h").select("doc_id", "n")


@plan("ordered_dedup", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY 2")
def ordered_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@plan("extra_copies", "SELECT count(*) - count(DISTINCT md5(text)) AS extra, count(*) AS total FROM documents")
def extra_copies(spark, sf_dir):
    by = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"))
    return by.agg((F.sum("n") - F.count("*")).alias("extra"), F.sum("n").alias("total"))


@plan("nunique_filter", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def nunique_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.countDistinct("c_mktsegment").alias("segments")).where("segments > 1")


@plan("pair_count", "SELECT count(*) AS pairs FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def pair_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().agg(F.count("*").alias("pairs"))


@plan("describe_lineitem", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS lo, round(quantile_cont({c}, 0.5), 6) AS med, max({c}) AS hi FROM lineitem" for c in QUANTILED))
def describe_lineitem(spark, sf_dir):
    """One aggregate for all but the median, which would send every distinct value to one task."""
    lines = table(spark, sf_dir, "lineitem")
    med = quantiles(lines, QUANTILED, [0.5]).select("feature", F.round("value", 6).alias("med"))  # a row for each column
    rows = per_column(lines, QUANTILED, {"n": F.count, "mean": lambda c: F.round(F.avg(c), 6), "std": lambda c: F.round(F.stddev_samp(c), 6), "lo": F.min, "hi": F.max})
    return rows.join(F.broadcast(med), "feature", "left").select("feature", "n", "mean", "std", "lo", "med", "hi")


@plan("variance_ranking", "SELECT feature, var, row_number() OVER (ORDER BY var DESC, feature) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_samp({c}), 6) AS var FROM lineitem" for c in QUANTILED) + ")")
def variance_ranking(spark, sf_dir):
    rows = per_column(table(spark, sf_dir, "lineitem"), QUANTILED, {"var": lambda c: F.round(F.var_samp(c), 6)})
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("var").desc(), "feature")).cast("long"))


@plan("class_mean_gap", "SELECT feature, gap FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(avg(CASE WHEN risky = 1 THEN {c} END) - avg(CASE WHEN risky = 0 THEN {c} END)), 6) AS gap FROM {FRAME_SQL}" for c in TARGETED) + ") ORDER BY gap DESC, feature LIMIT 3")
def class_mean_gap(spark, sf_dir):
    gap = lambda c: F.round(F.abs(F.avg(F.when(F.col("risky") == 1, c)) - F.avg(F.when(F.col("risky") == 0, c))), 6)
    return per_column(frame(spark, sf_dir), TARGETED, {"gap": gap}).orderBy(F.col("gap").desc(), "feature").limit(3)


@plan("gate_checks", """
    WITH s AS (SELECT source, count(*) AS n, count(l.doc_id) AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source),
         t AS (SELECT count(*) AS sources, sum(n)::BIGINT AS total, max(100.0::DOUBLE * n) / sum(n) AS share, min(n) AS least_n FROM s)
    SELECT 'sources' AS gate, sources::DOUBLE AS value, sources >= 2 AS ok FROM t UNION ALL SELECT 'max_share', round(share, 4), share < 70 FROM t
    UNION ALL SELECT 'least_source', least_n::DOUBLE, least_n >= 30 FROM t UNION ALL SELECT 'total', total::DOUBLE, total >= 300 FROM t""")  # fmt: skip
def gate_checks(spark, sf_dir):
    t = labelled(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("sources"), F.sum("n").alias("total"), (F.max(F.lit(100.0) * F.col("n")) / F.sum("n")).alias("share"), F.min("n").alias("least_n"))
    gate = lambda name, value, ok: F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"), ok.alias("ok"))
    c = F.col
    rows = F.array(gate("sources", c("sources"), c("sources") >= 2), gate("max_share", F.round("share", 4), c("share") < 70), gate("least_source", c("least_n"), c("least_n") >= 30), gate("total", c("total"), c("total") >= 300))
    return t.select(F.explode(rows).alias("r")).select("r.*")


@plan("usefulness_audit", "SELECT feature, distinct_values, null_pct, distinct_values > 1 AND distinct_values < 0.9 * n AND null_pct < 50 AS useful, distinct_values < 50 AS encodable FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS distinct_values, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 4) AS null_pct, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id" for c in [*MAYBE, 'n_chars']) + ")")
def usefulness_audit(spark, sf_dir):
    rows = per_column(labelled(spark, sf_dir), [*MAYBE, "n_chars"], {
        "distinct_values": F.countDistinct, "null_pct": lambda c: F.round(F.lit(100.0) * F.count_if(c.isNull()) / F.count("*"), 4), "n": lambda c: F.count("*")})
    d, n = F.col("distinct_values"), F.col("n")
    return rows.select("feature", "distinct_values", "null_pct", ((d > 1) & (d < F.lit(0.9) * n) & (F.col("null_pct") < 50)).alias("useful"), (d < 50).alias("encodable"))


@plan("build_rates", """
    SELECT date_trunc('day', ts) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed, round(count(*) / 1440.0::DOUBLE, 6) AS per_minute FROM events GROUP BY 1""")  # fmt: skip
def build_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.count("*") / F.lit(1440.0), 6).alias("per_minute"))


@plan("strata_report", """
    SELECT lang, count(*) AS population, count(*) FILTER (WHERE k <= floor(0.3 * n)) AS sampled FROM (
      SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', doc_id::VARCHAR, '42')), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) GROUP BY lang""")  # fmt: skip
def strata_report(spark, sf_dir):
    by = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("population"))
    return by.withColumn("sampled", F.floor(F.lit(0.3) * F.col("population")))


@plan("score_profile", """
    SELECT count(*) AS n, round(avg(ml), 6) AS mean, round(stddev_pop(ml), 6) AS std_pop, round(stddev_samp(ml), 6) AS std_samp, round(median(ml), 6) AS med,
           count(*) FILTER (WHERE ml < 0.3) AS low_n, round(100.0::DOUBLE * count(*) FILTER (WHERE ml < 0.3) / count(*), 4) AS low_pct, round(avg(CASE WHEN ml < 0.3 THEN lines_of_code END), 4) AS low_loc
    FROM """ + FRAME_SQL + " WHERE risky = 1")  # fmt: skip
def score_profile(spark, sf_dir):
    """Scores of the risky class and the profile of its low-scored rows."""
    low = F.col("ml") < 0.3
    return frame(spark, sf_dir).where("risky = 1").agg(
        F.count("*").alias("n"), F.round(F.avg("ml"), 6).alias("mean"), F.round(F.stddev_pop("ml"), 6).alias("std_pop"), F.round(F.stddev_samp("ml"), 6).alias("std_samp"),
        F.round(F.percentile("ml", 0.5), 6).alias("med"), F.count_if(low).alias("low_n"), F.round(F.lit(100.0) * F.count_if(low) / F.count("*"), 4).alias("low_pct"),
        F.round(F.avg(F.when(low, F.col("lines_of_code"))), 4).alias("low_loc"),
    )


@plan("losses_by_type", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def losses_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@plan("partition_count", "SELECT o_orderkey, count(o_orderkey) OVER (PARTITION BY o_custkey) AS by_customer FROM orders")
def partition_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.count("o_orderkey").over(Window.partitionBy("o_custkey")).alias("by_customer"))


@plan("running_best", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best_so_far FROM events")
def running_best(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.max("value").over(w).alias("best_so_far"))


@plan("last_n_performance", """
    SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_last, min(value) AS lo, max(value) AS hi
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 50 GROUP BY user_id""")  # fmt: skip
def last_n_performance(spark, sf_dir):
    """The last fifty events of each user: a ranked window that Spark cuts off before its shuffle."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return table(spark, sf_dir, "events").withColumn("k", k).where("k <= 50").groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_last"), F.min("value").alias("lo"), F.max("value").alias("hi"))


IMPORTANCE = "SELECT feature, abs(r) AS importance FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {corr_sql(c, 'risky')} AS r FROM {FRAME_SQL}" for c in TARGETED) + ")"


@plan("cumulative_importance", f"SELECT feature, round(importance, 9) AS importance, round(sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) / sum(importance) OVER (), 6) AS cumulative FROM ({IMPORTANCE})")
def cumulative_importance(spark, sf_dir):
    rows = corr_with_target(spark, sf_dir).select("feature", F.abs("r").alias("importance"))
    all_rows = Window.partitionBy(F.lit(1))  # a row for each feature, never more
    running = all_rows.orderBy(F.col("importance").desc(), "feature").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("feature", "importance", F.round(F.sum("importance").over(running) / F.sum("importance").over(all_rows), 6).alias("cumulative"))


@plan("topk_value", "SELECT event_id, user_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 10")
def topk_value(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value").orderBy(F.col("value").desc_nulls_last(), "event_id").limit(10)


@plan("topk_filtered", """
    SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 200000) ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""")  # fmt: skip
def topk_filtered(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' AND o_totalprice < 200000")
    return o.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(1)


@plan("semver_order", """
    SELECT DISTINCT v AS version, dense_rank() OVER (ORDER BY string_split(v, '.')::INT[]) AS position
    FROM (SELECT concat_ws('.', (p_size % 3)::VARCHAR, (p_size % 11)::VARCHAR, (p_size % 13)::VARCHAR) AS v FROM part)""")  # fmt: skip
def semver_order(spark, sf_dir):
    """Versions in numeric, not text, order; distinct first, so that the one ranking window is small."""
    p = F.col("p_size")
    v = table(spark, sf_dir, "part").select(F.concat_ws(".", (p % 3).cast("string"), (p % 11).cast("string"), (p % 13).cast("string")).alias("version")).distinct()
    return v.withColumn("position", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(F.split("version", "\\.").cast("array<int>"))).cast("long"))


@plan("failure_reasons", "SELECT o_orderpriority AS reason, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY n DESC, reason")
def failure_reasons(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "reason")


@plan("left_join_predicate", """
    SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0 AND d.lang = 'en'""")  # fmt: skip
def left_join_predicate(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang").alias("d"), table(spark, sf_dir, "labels").alias("l")
    return d.join(l, F.expr("d.doc_id = l.doc_id AND l.toxic = 0 AND d.lang = 'en'"), "left").select("d.doc_id", "l.quality")


@plan("semi_anti", """
    SELECT 'known' AS side, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT 'new', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")  # fmt: skip
def semi_anti(spark, sf_dir):
    """Rows already stored and rows still to do."""
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda how, name: d.join(l, "doc_id", how).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return count("left_semi", "known").unionByName(count("left_anti", "new"))


@plan("scalar_subquery", """
    SELECT n_name, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS suppliers FROM nation n""")  # fmt: skip
def scalar_subquery(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


ASKED = "CASE p_size % 5 WHEN 0 THEN n_name WHEN 1 THEN lower(concat(n_name, '-v_2')) WHEN 2 THEN concat('_', substr(n_name, 1, 5)) WHEN 3 THEN concat('Q', p_size) ELSE lower(replace(n_name, 'A', 'a_')) END"


@plan("fuzzy_name_match", f"""
    WITH q AS (SELECT DISTINCT {ASKED} AS q FROM part JOIN nation ON n_nationkey = p_partkey % 25), c AS (SELECT n_nationkey AS pos, n_name AS c, n_nationkey % 4 <> 0 AS concrete FROM nation),
         k AS (SELECT *, regexp_replace(lower(q), '[_-]', '', 'g') AS qk, regexp_replace(lower(c), '[_-]', '', 'g') AS ck FROM q, c),
         m AS (SELECT q, c, pos, CASE WHEN q = c THEN 1 WHEN contains(qk, ck) OR contains(ck, qk) THEN 2 ELSE 3 END AS stage, concrete FROM k)
    SELECT q AS asked, c AS found, stage FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY stage, pos) AS n FROM m WHERE stage < 3 OR concrete) WHERE n = 1""")  # fmt: skip
def fuzzy_name_match(spark, sf_dir):
    """Three-stage name resolution against the fixed list of nations: exact, normalised containment either way, the first concrete one."""
    nations = table(spark, sf_dir, "nation")
    names = F.broadcast(nations.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("c"), (F.col("n_nationkey") % 4 != 0).alias("concrete")))  # 25 rows at any scale
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").join(F.broadcast(nations.select("n_nationkey", "n_name")), F.col("n_nationkey") == F.col("p_partkey") % 25)
    plain = lambda x: F.regexp_replace(F.lower(x), "[_-]", "")
    near = F.contains(plain("q"), plain("c")) | F.contains(plain("c"), plain("q"))
    stage = F.when(F.col("q") == F.col("c"), 1).when(near, 2).when(F.col("concrete"), 3)
    best = parts.select(F.expr(ASKED).alias("q")).distinct().join(names, F.lit(True)).where(stage.isNotNull()).groupBy("q").agg(F.min(F.struct(stage.alias("stage"), "pos", "c")).alias("m"))
    return best.select(F.col("q").alias("asked"), F.col("m.c").alias("found"), F.col("m.stage").alias("stage"))


VERSIONS = [(0, 4, p) for p in (11, 16, 24, 26)] + [(0, 8, p) for p in (0, 4, 7, 19, 20)]


@plan("version_resolution", f"""
    WITH v(a, b, c) AS (VALUES {', '.join(map(str, VERSIONS))}), q AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 8 END AS b, p_size % 22 AS c, p_size % 3 AS kind FROM part)
    SELECT p_partkey, max(CASE WHEN v.a IS NULL THEN NULL ELSE v.b * 1000 + v.c END)::BIGINT AS resolved FROM q LEFT JOIN v ON
      CASE kind WHEN 0 THEN v.b = q.b AND v.c >= q.c WHEN 1 THEN v.b * 1000 + v.c >= q.b * 1000 + q.c ELSE v.b * 1000 + v.c >= q.b * 1000 + q.c AND v.b < q.b + 1 END GROUP BY p_partkey""")  # fmt: skip
def version_resolution(spark, sf_dir):
    """The highest listed version in a caret, at-least or half-open range: a fold over the fixed list, no join."""
    p = F.col("p_size")
    q = table(spark, sf_dir, "part").select("p_partkey", F.when(p % 2 == 0, 4).otherwise(8).alias("b"), (p % 22).alias("c"), (p % 3).alias("kind"))
    listed = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(c).alias("c")) for _, b, c in VERSIONS])
    code = lambda b, c: b * 1000 + c
    fits = F.filter(listed, lambda v: F.when(F.col("kind") == 0, (v.b == F.col("b")) & (v.c >= F.col("c"))).when(F.col("kind") == 1, code(v.b, v.c) >= code(F.col("b"), F.col("c"))).otherwise((code(v.b, v.c) >= code(F.col("b"), F.col("c"))) & (v.b < F.col("b") + 1)))
    return q.select("p_partkey", F.array_max(F.transform(fits, lambda v: code(v.b, v.c))).cast("long").alias("resolved"))


@plan("tier_merge", """
    SELECT d.doc_id, coalesce(l.quality, 0) AS quality, CASE WHEN l.toxic = 1 THEN 'risky' ELSE d.source END AS category FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")  # fmt: skip
def tier_merge(spark, sf_dir):
    """Later tier wins where it has a value."""
    return labelled(spark, sf_dir).select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.when(F.col("toxic") == 1, "risky").otherwise(F.col("source")).alias("category"))


@plan("union_concat", """
    SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2""")  # fmt: skip
def union_concat(spark, sf_dir):
    by = lambda name, key: table(spark, sf_dir, name).groupBy(F.col(key).alias("nation")).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "nation", "n")
    return union_all([by("customer", "c_nationkey"), by("supplier", "s_nationkey")])


@plan("set_operations", """
    WITH a AS (SELECT source, list_sort(list(DISTINCT lang)) AS l FROM documents GROUP BY source)
    SELECT source, len(list_intersect(l, ['de', 'en']))::INT AS shared, len(list_filter(l, lambda x: NOT list_contains(['de', 'en'], x)))::INT AS extra FROM a""")  # fmt: skip
def set_operations(spark, sf_dir):
    langs = F.array(F.lit("de"), F.lit("en"))
    a = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("l"))
    return a.select("source", F.size(F.array_intersect("l", langs)).alias("shared"), F.size(F.array_except("l", langs)).alias("extra"))


QUERIES, ORACLE_SQL = plan.queries, plan.oracle_sql
