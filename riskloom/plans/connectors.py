"""Sources and sinks as queries: what is written to the shared folder from the tables is read back and summed."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.plans.base import Plan
from riskloom.session import scratch, table
from riskloom.sources import files, sinks

plan = Plan()
c = F.col
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"


def exported_orders(spark, sf_dir, name: str) -> str:
    folder = scratch(spark, name)
    sinks.export(table(spark, sf_dir, "orders").select(*[x.split()[0] for x in ORDERS.split(", ")]), folder, "csv")
    return folder


@plan("csv_round_trip", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last, 5 AS columns FROM orders GROUP BY o_orderstatus")
def csv_round_trip(spark, sf_dir):
    """CSV export with its metadata, read back by schema; the number of columns comes from the metadata."""
    folder = exported_orders(spark, sf_dir, "csv")
    meta = spark.read.text(f"{folder}/metadata").select(F.size(F.from_json("value", "columns array<string>")["columns"]).alias("columns"))
    by = files.csv(spark, f"{folder}/data", ORDERS).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderkey").alias("last"))
    return by.join(meta, F.lit(True))


@plan("csv_inferred_fallback", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority")
def csv_inferred_fallback(spark, sf_dir):
    """The first CSV that exists of several paths, its types inferred."""
    folder = exported_orders(spark, sf_dir, "csv")
    found = files.first_csv(spark, [f"{folder}/missing", f"{folder}/data", f"{folder}/metadata"])
    return found.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@plan("jsonl_log", "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def jsonl_log(spark, sf_dir):
    """A log of JSON lines in a folder for each month, appended to in two writes and read by schema."""
    folder = scratch(spark, "log")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM").alias("month"))
    for part in (0, 1):
        e.where(c("event_id") % 2 == part).write.mode("append").partitionBy("month").json(folder)
    log = files.jsonl(spark, folder, "event_id long, event_type string, value double, month string")
    return log.groupBy("month", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@plan("text_files_scan", r"SELECT CASE WHEN source LIKE '%1%' THEN 'one' WHEN source LIKE '%2%' THEN 'two' ELSE 'other' END AS label, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents WHERE source NOT LIKE '%3%' GROUP BY 1")
def text_files_scan(spark, sf_dir):
    """Text files found recursively, some paths left out, labelled by their path; whole files, their lines counted."""
    folder = scratch(spark, "texts")
    table(spark, sf_dir, "documents").select("source", "text").write.partitionBy("source").text(folder)
    found = files.texts(spark, folder, "*.txt")
    within = F.regexp_extract("path", "source=([^/]*)", 1)
    label = files.label_from_path("folder", {"1": "one", "2": "two"})
    found = found.withColumn("folder", within).where(~F.contains("folder", F.lit("3")))
    return found.groupBy(F.coalesce(label, F.lit("other")).alias("label")).agg(F.sum(F.size(F.split("text", "\n")) - 1).alias("lines"))


@plan("curated_addresses", """
    SELECT protocol, count(*) AS addresses, count(*) FILTER (WHERE length(address) = 42) AS valid FROM (
      SELECT DISTINCT protocol, address FROM (SELECT p_brand AS protocol, concat('0x', lpad(lower(hex(p_partkey)), 40, '0')) AS address FROM part UNION ALL
        SELECT p_brand, concat('0x', lower(hex(p_size + 16))) FROM part WHERE p_partkey % 2 = 0)) GROUP BY protocol""")  # fmt: skip
def curated_addresses(spark, sf_dir):
    """Addresses from metadata of two shapes: objects in one list, texts in another."""
    folder = scratch(spark, "curated")
    long, short = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("p_partkey")), 40, "0")), F.concat(F.lit("0x"), F.lower(F.hex(c("p_size") + 16)))
    rows = table(spark, sf_dir, "part").select(
        F.when(c("p_partkey") % 2 == 0, c("p_brand")).alias("protocol"), F.when(c("p_partkey") % 2 == 1, c("p_brand")).alias("name"),
        F.array(F.struct(long.alias("address"))).alias("contracts"), F.when(c("p_partkey") % 2 == 0, F.array(short)).alias("addresses"),
    )
    rows.write.json(folder)
    found = files.curated(spark, folder, lines=True)
    return found.groupBy("protocol").agg(F.count("*").alias("addresses"), F.count_if("valid").alias("valid"))


@plan("unwrapped_files", "SELECT doc_id, 'lib/' || lang || '.sol' AS file, length(text) + 7 AS size FROM documents WHERE doc_id % 3 <> 2 AND NOT contains(text, '@version') UNION ALL SELECT doc_id, 'main', length(text) + 7 FROM documents WHERE doc_id % 3 = 2 AND NOT contains(text, '@version')")
def unwrapped_files(spark, sf_dir):
    """Sources of several files in one or two braces, or plain; those of another language and without a pragma are left out."""
    body = F.concat(F.lit("pragma "), c("text"))
    entry = F.create_map(F.concat(F.lit("lib/"), c("lang"), F.lit(".sol")), F.struct(body.alias("content")), F.lit("README"), F.struct(F.lit("nothing").alias("content")))
    wrapped = F.to_json(F.struct(entry.alias("sources")))
    source = F.when(c("doc_id") % 3 == 0, F.concat(F.lit("{"), wrapped, F.lit("}"))).when(c("doc_id") % 3 == 1, wrapped).otherwise(body)
    return files.unwrapped_sources(table(spark, sf_dir, "documents").select("doc_id", source.alias("source"))).select("doc_id", "file", F.length("content").alias("size"))


@plan("build_statistics", """
    WITH x AS (SELECT d.source, CASE WHEN l.doc_id IS NULL THEN 'failed' ELSE 'success' END AS status, CASE WHEN n_chars < 1000 THEN 'SHORT' ELSE 'UNLABELLED' END AS reason FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id)
    SELECT 'dataset' AS kind, source AS name, count(*) AS n, (SELECT count(*) FROM x) AS total FROM x GROUP BY source UNION ALL SELECT 'reason', reason, count(*), (SELECT count(*) FROM x) FROM x WHERE status = 'failed' GROUP BY reason""")  # fmt: skip
def build_statistics(spark, sf_dir):
    """A build's statistics as one JSON text, and what a reader of it finds there."""
    l = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("seen", F.lit(True))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(l, "doc_id", "left")
    rows = d.select("source", F.when(c("seen"), "success").otherwise("failed").alias("status"), F.when(c("n_chars") < 1000, "SHORT").otherwise("UNLABELLED").alias("reason"))
    said = sinks.build_statistics(rows, "source", "status", "reason").select(F.from_json("statistics", "total long, by_dataset map<string, long>, by_reason map<string, long>").alias("s"))
    entries = lambda kind: F.transform(F.map_entries(c("s")[f"by_{kind}"]), lambda e: F.struct(F.lit(kind).alias("kind"), e.key.alias("name"), e.value.alias("n")))
    return said.select(F.explode(F.concat(entries("dataset"), entries("reason"))).alias("e"), c("s.total").alias("total")).select("e.*", "total")


@plan("grown_schema", "SELECT doc_id, quality, NULL::BIGINT AS n_chars FROM labels UNION ALL SELECT doc_id, NULL, n_chars FROM documents")
def grown_schema(spark, sf_dir):
    """Rows of two schemas under the columns of both."""
    l, d = table(spark, sf_dir, "labels").select("doc_id", c("quality").cast("long").alias("quality")), table(spark, sf_dir, "documents").select("doc_id", c("n_chars").cast("long").alias("n_chars"))
    both = sinks.with_columns_of(l, d)
    return sinks.with_columns_of(both, l).unionByName(sinks.with_columns_of(d, l)).select("doc_id", "quality", "n_chars")


@plan("point_update", "SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'flagged' ELSE d.lang END AS lang, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def point_update(spark, sf_dir):
    """New values where the key matches; changes for unknown keys are ignored."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    hit = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").join(d, "doc_id")
    changes = hit.select("doc_id", F.lit("flagged").alias("lang"), "n_chars").unionByName(spark.range(1).select(F.lit(-5).cast(d.schema["doc_id"].dataType).alias("doc_id"), F.lit("new").alias("lang"), F.lit(0).cast(d.schema["n_chars"].dataType).alias("n_chars")))
    return sinks.update(d, changes, ["doc_id"])


@plan("content_hashes", """SELECT doc_id, md5(concat('{"doc_id":', doc_id, ',"quality":', quality, ',"toxic":', toxic, '}')) AS hash FROM labels""")
def content_hashes(spark, sf_dir):
    """md5 of a record as JSON in the order of its names, whatever the order of its columns."""
    return sinks.content_hash(table(spark, sf_dir, "labels").select("toxic", "doc_id", "quality"), ["toxic", "quality", "doc_id"]).select("doc_id", "hash")


@plan("six_written_parts", """
    SELECT part, count(*) AS n FROM (SELECT unnest(CASE WHEN l.doc_id IS NULL THEN ['full', 'prediction'] ELSE ['full', 'labelled'] END || CASE WHEN n_chars >= 1000 THEN ['production'] ELSE ['mocks'] END || CASE WHEN toxic = 0 THEN ['clean'] ELSE [] END) AS part
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY part""")  # fmt: skip
def six_written_parts(spark, sf_dir):
    """Six overlapping exports of one table, written and counted where they were written."""
    l = table(spark, sf_dir, "labels").select("doc_id", "toxic").withColumn("seen", F.lit(True))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(l, "doc_id", "left")
    parts = {"full": F.lit(True), "production": c("n_chars") >= 1000, "mocks": c("n_chars") < 1000, "clean": c("toxic") == 0, "labelled": c("seen").isNotNull(), "prediction": c("seen").isNull()}
    found = [spark.read.schema(d.schema).parquet(path).select(F.lit(name).alias("part")) for name, path in sinks.split_export(d, scratch(spark, "parts"), parts).items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("part").agg(F.count("*").alias("n"))


QUERIES, ORACLE_SQL = plan.queries, plan.oracle_sql
