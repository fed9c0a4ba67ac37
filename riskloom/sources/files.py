"""Sources: tables from files, by explicit schema, by pattern, with fallbacks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.functions.text import valid_address


def csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """CSV with a header; without a schema one more pass infers it."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def first_csv(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """The first of the paths that exists, wherever Spark can look."""
    for p in paths:
        if exists(spark, p):
            return csv(spark, p, schema)
    raise FileNotFoundError(", ".join(paths))


def query(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """SQL text over the named frames."""
    return spark.sql(sql, **views)


def texts(spark: SparkSession, path: str, pattern: str = "*", without: list[str] | None = None) -> DataFrame:
    """path, name, text of every file below `path` that matches; a name in lower case is capitalised.

    Paths that hold one of `without` are left out.
    """
    f = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    stem = F.regexp_extract(at, r"([^/]+?)(?:\.[^./]*)?$", 1)
    out = f.select(at.alias("path"), F.when(stem == F.lower(stem), F.initcap(stem)).otherwise(stem).alias("name"), F.col("value").alias("text"))
    for w in without or []:
        out = out.where(~F.contains("path", F.lit(w)))
    return out


def label_from_path(path: str, labels: dict[str, str]) -> F.Column:
    """The value of the first key that the path holds."""
    out = F.when(F.lit(False), "")
    for part, label in labels.items():
        out = out.when(F.contains(F.col(path), F.lit(part)), label)
    return out


def curated(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """protocol, address, valid of nested metadata JSON: contracts[] of {address}, or addresses[] of text.

    With `lines`, a file holds an object on each line.
    """
    kind = "protocol string, name string, contracts array<struct<address: string>>, addresses array<string>"
    j = spark.read.schema(kind).option("multiLine", not lines).json(path)
    every = F.concat(F.coalesce(F.transform("contracts", lambda x: x.address), F.array().cast("array<string>")), F.coalesce("addresses", F.array().cast("array<string>")))
    return j.select(F.coalesce("protocol", "name").alias("protocol"), F.explode(every).alias("address")).withColumn("valid", valid_address(F.col("address"))).dropDuplicates()


def unwrapped_sources(df: DataFrame, source: str = "source") -> DataFrame:
    """file, content of multi-file source JSON, wrapped in one or two braces; plain text is one file."""
    raw = F.col(source)
    body = F.when(raw.startswith("{{"), raw.substr(F.lit(2), F.length(raw) - 2)).otherwise(raw)
    files = F.from_json(body, "sources map<string, struct<content: string>>").sources
    many = F.coalesce(F.map_entries(files), F.array(F.struct(F.lit("main").alias("key"), F.struct(raw.alias("content")).alias("value"))))
    keep = [c for c in df.columns if c != source]
    out = df.select(*keep, F.explode(many).alias("f")).select(*keep, F.col("f.key").alias("file"), F.col("f.value.content").alias("content"))
    return out.where(~F.contains("content", F.lit("@version")) & F.contains("content", F.lit("pragma")))


def static(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A curated list."""
    return spark.createDataFrame(rows, schema)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON settings file over defaults; a missing file gives the defaults."""
    if not exists(spark, path):
        return dict(defaults)
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return defaults | json.loads(text)
