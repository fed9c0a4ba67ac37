"""riskloom: risk analytics, data quality reports and model monitoring on Spark DataFrames."""

from riskloom.session import get_spark, table

__all__ = ["get_spark", "table"]
