"""Registration of queries, and the numeric frame that feature and score queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import table


class Plan:
    """Queries of one module, with their DuckDB SQL where SQL can express them."""

    def __init__(self):
        self.queries: dict = {}
        self.oracle_sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql:
                self.oracle_sql[name] = sql
            return f

        return put


#: column -> expression over lineitem joined with part; the same text is valid in Spark and DuckDB
FRAME = {
    "id": "l_orderkey * 10 + l_linenumber",
    "num_functions": "l_linenumber + p_size % 20",
    "num_external_calls": "p_size % 12",
    "num_low_level_calls": "p_size % 4",
    "cei_violations": "l_linenumber % 3",
    "cei_safe_functions": "p_size % 6",
    "state_after_call_count": "(l_linenumber + p_size) % 3",
    "unchecked_calls": "p_size % 3",
    "has_reentrancy": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "has_unchecked_call": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END",
    "has_access_control": "CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END",
    "has_reentrancy_guard": "CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END",
    "has_tx_origin": "CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END",
    "has_delegatecall": "CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END",
    "has_assembly": "CASE WHEN p_size % 13 = 0 THEN 1 ELSE 0 END",
    "max_complexity": "p_size % 25",
    "avg_complexity": "CAST(p_size % 25 AS DOUBLE) / 2",
    "lines_of_code": "CAST(floor(l_extendedprice) AS BIGINT) % 1500",
    "num_state_vars": "p_size % 23",
    "detectors": "p_size % 9",
    "high": "l_linenumber % 4",
    "medium": "p_size % 3",
    "low": "p_size % 5",
    "cei_score": "1.0 - l_discount * 5",
    "comment_ratio": "l_tax",
    "num_modifiers": "p_size % 6",
    "inheritance_depth": "l_linenumber % 5",
    "num_library_calls": "p_size % 8",
    "num_comments": "CAST(floor(l_quantity) AS BIGINT)",
    "num_unused": "p_size % 3",
    "ml": "l_discount * 10",
    "risky": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
}

FRAME_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in FRAME.items()) + " FROM lineitem JOIN part ON l_partkey = p_partkey)"


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line: counts, flags and scores in the shape of an extracted feature vector."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(*[F.expr(v).alias(k) for k, v in FRAME.items()])
