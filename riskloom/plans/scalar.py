"""Scalar functions, filters and cleaning, one query for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import cleaning, text
from riskloom.plans.base import FRAME_SQL, Plan, frame
from riskloom.session import table

plan = Plan()


@plan("lines_and_comments", r"""
    SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS loc,
           len(list_filter(string_split(text, chr(10)), lambda x: trim(x) LIKE '//%'))::BIGINT AS slashes FROM documents""")  # fmt: skip
def lines_and_comments(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    slashes = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x).startswith("//"))).cast("long")
    return d.select("doc_id", text.lines_of_code(F.col("text")).alias("loc"), slashes.alias("slashes"))


@plan("comment_ratio_blocks")
def comment_ratio_blocks(spark, sf_dir):
    """Comment lines with block state, beside the lines; a fold over each text's lines."""
    c, loc = text.comment_lines(F.col("text")), text.lines_of_code(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("comments"), loc.alias("loc")).withColumn("ratio", F.round(F.col("comments") / F.greatest("loc", F.lit(1)), 3))


PRAGMA = "concat('pragma solidity ', CASE p_size % 4 WHEN 0 THEN '^' WHEN 1 THEN '>=' WHEN 2 THEN '' ELSE 'x' END, '0.', p_size % 9, CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('.', p_size % 27) END, CASE WHEN p_size % 4 = 1 THEN ' <0.9.0' ELSE '' END, ';')"
RX = r"pragma\s+solidity\s+(\^|>=)?\s*(\d+)\.(\d+)(?:\.(\d+))?(?:\s*<\s*(\d+)\.(\d+)\.(\d+))?"


@plan("pragma_parse", f"""
    SELECT p_partkey, CASE WHEN maj <> '' THEN coalesce(nullif(op, ''), 'exact') END AS op, nullif(maj, '')::INT AS major, nullif(mi, '')::INT AS minor,
           CASE WHEN maj <> '' THEN coalesce(nullif(pa, '')::INT, 0) END AS patch, CASE WHEN b <> '' THEN '0.9.0' END AS below
    FROM (SELECT p_partkey, regexp_extract(s, '{RX}', 1) AS op, regexp_extract(s, '{RX}', 2) AS maj, regexp_extract(s, '{RX}', 3) AS mi, regexp_extract(s, '{RX}', 4) AS pa, regexp_extract(s, '{RX}', 5) AS b
          FROM (SELECT p_partkey, {PRAGMA} AS s FROM part))""")  # fmt: skip
def pragma_parse(spark, sf_dir):
    s = table(spark, sf_dir, "part").select("p_partkey", F.expr(PRAGMA).alias("s"))
    return s.select("p_partkey", *[c.alias(n) for n, c in text.version_range(F.col("s")).items()])


@plan("declared_names", r"SELECT page_id, len(regexp_extract_all(html, '<h([1-6])', 1))::INT AS headings, regexp_extract(html, '<title>([^<]*)', 1) AS first_title FROM pages")
def declared_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.size(F.regexp_extract_all("html", F.lit("<h([1-6])"), F.lit(1))).alias("headings"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("first_title"))


DECLARED = "concat('pragma solidity ^0.8.0; interface I', p_size, ' {} contract ', replace(p_brand, '#', ''), CASE WHEN p_size % 3 = 0 THEN ' is Owned {} contract  Second' ELSE ' { address c; } library ' END, p_partkey, ' {}')"


@plan("contract_names", f"""
    SELECT p_partkey, replace(p_brand, '#', '') AS first_name, CASE WHEN p_size % 3 = 0 THEN concat(replace(p_brand, '#', ''), ',Second', p_partkey) ELSE replace(p_brand, '#', '') END AS names, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS n FROM part""")  # fmt: skip
def contract_names(spark, sf_dir):
    """Names that a source declares: the first and all."""
    every = F.regexp_extract_all("s", F.lit(r"contract\s+(\w+)"), F.lit(1))
    s = table(spark, sf_dir, "part").select("p_partkey", F.expr(DECLARED).alias("s")).withColumn("e", every)
    return s.select("p_partkey", F.get("e", F.lit(0)).alias("first_name"), F.array_join("e", ",").alias("names"), F.size("e").alias("n"))


ADDRESS = "concat(CASE WHEN p_size % 3 = 0 THEN 'plain' ELSE concat('contract_0x', lower(hex(p_partkey * 7919))) END, '.sol')"


@plan("address_from_path", f"""
    SELECT p_partkey, CASE WHEN a <> '' THEN rpad(left(a, 42), 42, '0') END AS address, coalesce(regexp_full_match(CASE WHEN a <> '' THEN rpad(left(a, 42), 42, '0') END, '0x[0-9a-fA-F]{{40}}'), false) AS valid,
           regexp_replace(p, '_[^_]*$', '') AS stem FROM (SELECT p_partkey, p, regexp_extract(p, '_(0x[0-9a-fA-F]+)', 1) AS a FROM (SELECT p_partkey, {ADDRESS} AS p FROM part))""")  # fmt: skip
def address_from_path(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(ADDRESS).alias("p"))
    a = text.address_from_path(F.col("p"))
    return p.select("p_partkey", a.alias("address"), text.valid_address(a).alias("valid"), F.regexp_replace("p", "_[^_]*$", "").alias("stem"))


@plan("sanitised_names", "SELECT DISTINCT p_type, concat('tier4_', lower(replace(replace(p_type, ' ', '-'), '-', '_'))) AS name FROM part")
def sanitised_names(spark, sf_dir):
    dash = F.replace("p_type", F.lit(" "), F.lit("-"))
    return table(spark, sf_dir, "part").select("p_type", F.concat(F.lit("tier4_"), F.lower(F.replace(dash, F.lit("-"), F.lit("_")))).alias("name")).distinct()


MESSAGES = """CASE l_linenumber + 7 * (l_partkey % 2) WHEN 1 THEN 'Source file requires different compiler version' WHEN 2 THEN '"A.sol" is not found' WHEN 3 THEN 'ParserError: expected ;'
    WHEN 4 THEN 'solc timed out' WHEN 5 THEN 'Compilation failed' WHEN 6 THEN 'Unknown option --x' WHEN 7 THEN 'Cannot import "b.sol"' WHEN 8 THEN 'File import: no such file' WHEN 9 THEN '@OpenZeppelin/x.sol missing'
    WHEN 10 THEN 'list index out of range' WHEN 11 THEN 'slither error in import' WHEN 12 THEN 'TypeError: x' WHEN 13 THEN 'version mismatch' END"""
KINDS = "CASE WHEN l_linenumber + 7 * (l_partkey % 2) IN (10, 12) THEN 'IndexError' END"


@plan("error_category", """
    SELECT CASE l_linenumber + 7 * (l_partkey % 2) WHEN 1 THEN 'VERSION_MISMATCH' WHEN 2 THEN 'FILE_NOT_FOUND' WHEN 3 THEN 'COMPILATION_ERROR' WHEN 5 THEN 'COMPILATION_ERROR' WHEN 6 THEN 'SLITHER_INCOMPATIBLE' WHEN 7 THEN 'IMPORT_ERROR'
      WHEN 8 THEN 'FILE_NOT_FOUND' WHEN 9 THEN 'IMPORT_ERROR' WHEN 10 THEN 'ANALYSIS_ERROR' WHEN 11 THEN 'IMPORT_ERROR' WHEN 12 THEN 'ANALYSIS_ERROR' WHEN 13 THEN 'VERSION_MISMATCH' ELSE 'UNKNOWN_ERROR' END AS category, count(*) AS n
    FROM lineitem GROUP BY 1""")  # fmt: skip
def error_category(spark, sf_dir):
    """Failures by code; the SQL holds the codes of the messages, worked out by hand."""
    m = table(spark, sf_dir, "lineitem").select(F.expr(MESSAGES).alias("m"), F.expr(KINDS).alias("k"))
    return m.groupBy(text.error_category(F.col("m"), F.col("k")).alias("category")).agg(F.count("*").alias("n"))


@plan("cache_keys", """
    SELECT doc_id, sha256(concat('{"doc_id":', doc_id, ',"lang":"', lang, '","source":"', source, '"}')) AS key, md5(text) AS content FROM documents""")  # fmt: skip
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.canonical_digest(["source", "lang", "doc_id"]).alias("key"), F.md5("text").alias("content"))


@plan("minmax_normalised", "SELECT o_orderkey, least(greatest(o_totalprice, 0), 300000) / 300000 * 100 AS score, o_totalprice / (o_custkey + 1.0::DOUBLE) AS ratio, coalesce(nullif(o_custkey % 3, 0), 1) AS at_least_one FROM orders")
def minmax_normalised(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.least(F.greatest(p, F.lit(0.0)), F.lit(300000.0)) / 300000 * 100).alias("score"),
        (p / (F.col("o_custkey") + 1.0)).alias("ratio"), F.coalesce(F.nullif(F.col("o_custkey") % 3, F.lit(0)), F.lit(1)).cast("long").alias("at_least_one"),
    )


@plan("bucketised_scores", """
    SELECT severity, confidence, count(*) AS n FROM (SELECT CASE WHEN value >= 75 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS severity,
      CASE WHEN value / 100 >= 0.9 THEN 'very high' WHEN value / 100 >= 0.7 THEN 'high' WHEN value / 100 >= 0.5 THEN 'medium' WHEN value / 100 >= 0.3 THEN 'low' ELSE 'very low' END AS confidence FROM events) GROUP BY ALL""")  # fmt: skip
def bucketised_scores(spark, sf_dir):
    v = F.col("value")
    severity = text.bands(v, [(75, "critical"), (50, "high"), (25, "medium")], "low")
    confidence = text.bands(v / 100, [(0.9, "very high"), (0.7, "high"), (0.5, "medium"), (0.3, "low")], "very low")
    return table(spark, sf_dir, "events").groupBy(severity.alias("severity"), confidence.alias("confidence")).agg(F.count("*").alias("n"))


# Price of a million tokens in and out, by model.
RATES = {"llama3.1": (0.5, 0.75), "mistral": (0.25, 0.25), "codellama": (0.75, 1.0), "phi3": (0.1, 0.1)}


@plan("token_cost", r"""
    SELECT role, sum(t)::BIGINT AS tokens, round(sum(round(t * CASE role WHEN 'user' THEN 0.5 ELSE 0.75 END / 1000000.0::DOUBLE, 6)), 6) AS cost
    FROM (SELECT role, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+'), lambda x: x <> '')) AS t FROM conversations) GROUP BY role""")  # fmt: skip
def token_cost(spark, sf_dir):
    into, out = RATES["llama3.1"]
    n = F.size(F.filter(F.split("text", "[ \\t\\n\\r\\f\\x0b]+"), lambda x: x != ""))
    c = table(spark, sf_dir, "conversations").select("role", n.alias("t"))
    cost = F.round(F.col("t") * F.when(F.col("role") == "user", into).otherwise(out) / 1000000.0, 6)
    return c.groupBy("role").agg(F.sum("t").alias("tokens"), F.round(F.sum(cost), 6).alias("cost"))


@plan("truncated_prompt", "SELECT doc_id, length(left(text, 2000)) AS kept, md5(left(text, 2000)) AS digest FROM documents")
def truncated_prompt(spark, sf_dir):
    cut = F.left("text", F.lit(2000))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("long").alias("kept"), F.md5(cut).alias("digest"))


@plan("json_props", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(props->>'$.k') AS present FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k long").k
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("present"))


@plan("json_round_trip", "SELECT doc_id, lang, n_chars FROM documents")
def json_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("lang", F.struct("n_chars").alias("inner"))).alias("j"))
    back = F.from_json("j", "lang string, inner struct<n_chars: long>")
    return d.select("doc_id", back.lang.alias("lang"), back.inner.n_chars.alias("n_chars"))


@plan("date_partitions", "SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY ALL")
def date_partitions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@plan("membership_top", """
    SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n, list(DISTINCT o_orderstatus) AS seen FROM orders GROUP BY 1) WHERE list_contains(seen, 'P') ORDER BY n DESC, o_custkey LIMIT 20""")  # fmt: skip
def membership_top(spark, sf_dir):
    """Keys whose set holds a value, the largest first."""
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_set("o_orderstatus").alias("seen"))
    return by.where(F.array_contains("seen", "P")).select("o_custkey", "n").orderBy(F.col("n").desc(), "o_custkey").limit(20)


@plan("flatten_nested", "SELECT user_id, count(*) AS findings, count(*) FILTER (WHERE event_type IS NOT NULL AND value > 10) AS kept FROM events GROUP BY user_id")
def flatten_nested(spark, sf_dir):
    """Lists of lists of findings, flattened, with malformed elements left out."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("event_type", "value").alias("f"), F.to_date("ts").alias("day"))
    lists = e.groupBy("user_id", "day").agg(F.collect_list("f").alias("fs")).groupBy("user_id").agg(F.flatten(F.collect_list("fs")).alias("fs"))
    good = F.filter("fs", lambda f: f.event_type.isNotNull() & (f.value > 10))
    return lists.select("user_id", F.size("fs").cast("long").alias("findings"), F.size(good).cast("long").alias("kept"))


@plan("substring_labels", """
    SELECT label, count(*) AS n FROM (SELECT CASE WHEN lower(p_type) LIKE '%brass%' THEN 'a' WHEN lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%tin%' THEN 'b' WHEN regexp_matches(p_name, '(?i)a.*e|x') THEN 'c' ELSE 'none' END AS label
    FROM part WHERE p_size BETWEEN 5 AND 45 AND length(coalesce(p_name, '')) > 3 AND p_brand IN (SELECT DISTINCT p_brand FROM part)) GROUP BY label""")  # fmt: skip
def substring_labels(spark, sf_dir):
    """Ordered substring and regex labels behind range, length and list filters, all of which reach the scan or its filter."""
    low = F.lower("p_type")
    p = table(spark, sf_dir, "part").where(F.col("p_size").between(5, 45) & (F.length(F.coalesce("p_name", F.lit(""))) > 3) & F.col("p_brand").isNotNull())
    label = F.when(F.contains(low, F.lit("brass")), "a").when(low.like("%steel%") | low.like("%tin%"), "b").when(F.coalesce(F.col("p_name").rlike("(?i)a.*e|x"), F.lit(False)), "c").otherwise("none")
    return p.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@plan("null_and_list_filters", """
    SELECT count(*) FILTER (WHERE l.quality IS NULL) AS unlabelled, count(*) FILTER (WHERE source IN ('src1', 'src2')) AS listed, count(*) FILTER (WHERE (lang = 'en' AND n_chars > 500) OR (lang = 'fr' AND n_chars > 1000)) AS either
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")  # fmt: skip
def null_and_list_filters(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    lang, n = F.col("lang"), F.col("n_chars")
    return d.agg(F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if(F.col("source").isin("src1", "src2")).alias("listed"), F.count_if(((lang == "en") & (n > 500)) | ((lang == "fr") & (n > 1000))).alias("either"))


RAW = "CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 3 THEN CAST('Infinity' AS DOUBLE) WHEN l_linenumber = 4 THEN CAST('-Infinity' AS DOUBLE) ELSE l_quantity END"


@plan("clean_infinite", f"SELECT round(sum(CASE WHEN x IS NULL OR isnan(x) THEN 0 WHEN isinf(x) THEN 999999 ELSE x END), 2) AS total, count(*) AS n FROM (SELECT {RAW} AS x FROM lineitem)")
def clean_infinite(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.expr(RAW).alias("x"))
    return x.agg(F.round(F.sum(cleaning.finite(F.col("x"))), 2).alias("total"), F.count("*").alias("n"))


TEXTUAL = "CASE p_size % 6 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN '12.5' WHEN 4 THEN 'n/a' END"


@plan("clean_text_values", f"""
    SELECT p_partkey, coalesce(CASE WHEN lower(t) IN ('true', '1', 'yes') THEN 1 ELSE 0 END, 0) AS flag, coalesce(TRY_CAST(t AS DOUBLE), 0) AS number,
           CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS level, least(p_retailprice / 10, 100) AS clipped
    FROM (SELECT *, {TEXTUAL} AS t FROM part)""")  # fmt: skip
def clean_text_values(spark, sf_dir):
    names = ["simple", "moderate", "complex", "critical"]
    p = table(spark, sf_dir, "part").withColumn("t", F.expr(TEXTUAL)).withColumn("c", F.expr("CASE p_size % 5 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' WHEN 2 THEN 'complex' WHEN 3 THEN 'critical' ELSE 'other' END"))
    return p.select("p_partkey", cleaning.as_flag(F.col("t")).alias("flag"), cleaning.as_number(F.col("t")).alias("number"), cleaning.ordinal(F.col("c"), names).alias("level"), F.least(F.col("p_retailprice") / 10, F.lit(100.0)).alias("clipped"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@plan("one_hot_segments", "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS seg_{s}" for s in SEGMENTS[1:]) + " FROM customer")
def one_hot_segments(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", *cleaning.one_hot(F.col("c_mktsegment"), SEGMENTS, "seg"))


@plan("id_like_columns", f"SELECT feature, distinct_values = n AND abs(r) > 0.7 AS id_like FROM (SELECT 'id' AS feature, count(DISTINCT id) AS distinct_values, count(*) AS n, covar_samp(id, risky) / (stddev_samp(id) * stddev_samp(risky)) AS r FROM {FRAME_SQL} UNION ALL SELECT 'high', count(DISTINCT high), count(*), covar_samp(high, risky) / (stddev_samp(high) * stddev_samp(risky)) FROM {FRAME_SQL})")
def id_like_columns(spark, sf_dir):
    """Columns that are unique and track the target."""
    from riskloom.operators.stats import per_column, safe_corr

    rows = per_column(frame(spark, sf_dir), ["id", "high"], {"d": F.countDistinct, "n": lambda c: F.count("*"), "r": lambda c: safe_corr(c, F.col("risky"))})
    return rows.select("feature", ((F.col("d") == F.col("n")) & (F.abs("r") > 0.7)).alias("id_like"))


@plan("validation_errors", """
    SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice IS NULL OR o_totalprice <= 1000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END, CASE WHEN o_custkey % 7 = 0 THEN 'customer' END) AS errors FROM orders""")  # fmt: skip
def validation_errors(spark, sf_dir):
    c = F.col
    rules = {"price": c("o_totalprice") > 1000, "status": c("o_orderstatus").isin("O", "F"), "customer": c("o_custkey") % 7 != 0}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(cleaning.violations(rules), ",").alias("errors"))


@plan("column_groups", "SELECT kind, sum(total)::BIGINT AS total FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, sum({c})::BIGINT AS total FROM {FRAME_SQL}" for k, c in (("flag", "has_reentrancy + has_unchecked_call + has_access_control + has_reentrancy_guard + has_tx_origin + has_delegatecall + has_assembly"), ("count", "num_functions + num_external_calls + num_low_level_calls + num_state_vars + num_modifiers + num_library_calls + num_comments + num_unused"))) + ") GROUP BY kind")
def column_groups(spark, sf_dir):
    """Sums over groups of columns that the schema gives by prefix."""
    f = frame(spark, sf_dir)
    total = lambda prefix: F.sum(sum((F.col(c) for c in f.columns if c.startswith(prefix)), F.lit(0))).alias(prefix)
    one = f.agg(total("has_"), total("num_"))
    return one.select(F.explode(F.array(F.struct(F.lit("flag").alias("kind"), F.col("has_").alias("total")), F.struct(F.lit("count").alias("kind"), F.col("num_").alias("total")))).alias("r")).select("r.*")


QUERIES, ORACLE_SQL = plan.queries, plan.oracle_sql
