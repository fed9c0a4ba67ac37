"""Forward taint over a contract's operations as a fixpoint of (contract, variable, since).

Functions are taken in order; those that don't change state (constructors, views, pure ones) are left
out with their parameters and operations. A parameter is tainted from its function's first operation on. An
assignment of a variable that is tainted by then taints what it writes, from the operation after it.
`since` is the earliest such place; a round joins variables with the assignments that read them later
and keeps the least, until none gets any earlier, so a contract's operations may lie in any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.rounds import dealt, kept, settled

c = F.col


def spread(functions: DataFrame, operations: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(tainted: key, variable, since) and the operations of the functions that change state, with `at`.

    functions: key, function (its order), params (array), is_constructor, is_view, is_pure (null: no). operations: key, function, pos,
    op, name, reads (array), rvalue, lvalue. A place is (function, pos); a parameter's is before all of its function's.
    """
    acting = functions.where(~(F.coalesce("is_constructor", F.lit(False)) | F.coalesce("is_view", F.lit(False)) | F.coalesce("is_pure", F.lit(False)))).select(key, "function", "params")
    place = F.struct(c("function").cast("long").alias("function"), c("pos").cast("long").alias("pos"))
    own = kept(operations.join(dealt(acting.select(key, "function").distinct()), [key, "function"], "left_semi").withColumn("at", place), "operations")
    moves = kept(own.where("op = 'Assignment' AND rvalue IS NOT NULL AND lvalue IS NOT NULL").select(key, c("rvalue").alias("variable"), c("lvalue").alias("to"), "at"), "assignments")
    sources = acting.select(key, "function", F.explode("params").alias("variable")).where("variable IS NOT NULL")
    start = sources.groupBy(key, "variable").agg(F.min(F.struct(c("function").cast("long").alias("function"), F.lit(-1).cast("long").alias("pos"))).alias("since"))

    def step(now: DataFrame) -> DataFrame:
        more = now.join(dealt(moves), [key, "variable"]).where(c("at") > c("since")).groupBy(key, c("to").alias("variable")).agg(F.min("at").alias("since"))
        both = now.withColumn("before", c("since")).unionByName(more.withColumn("before", F.lit(None)))
        least = both.groupBy(key, "variable").agg(F.min("since").alias("since"), F.min("before").alias("before"))
        return least.withColumn("_changed", c("before").isNull() | (c("since") < c("before")))

    return settled(start, step), own


def taint(functions: DataFrame, operations: DataFrame, key: str) -> DataFrame:
    """key, sources (parameters, by function), operations, tainted (variables), tainted_delegatecall, propagation_ratio (to the operations, 3 places; 0 without any)."""
    tainted, own = spread(functions, operations, key)
    calls = own.where((c("op") == "LowLevelCall") & F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit("delegatecall"))).select(key, "at", F.explode(F.array_distinct("reads")).alias("variable"))
    hit = calls.join(dealt(tainted), [key, "variable"]).where(c("at") > c("since")).select(key, "at").distinct().groupBy(key).agg(F.count("*").alias("tainted_delegatecall"))
    acting = functions.where(~(F.coalesce("is_constructor", F.lit(False)) | F.coalesce("is_view", F.lit(False)) | F.coalesce("is_pure", F.lit(False))))
    sources = acting.groupBy(key).agg(F.sum(F.size(F.coalesce("params", F.array()))).alias("sources"))
    out = functions.select(key).distinct()
    for more in (sources, own.groupBy(key).agg(F.count("*").alias("operations")), tainted.groupBy(key).agg(F.count("*").alias("tainted")), hit):
        out = out.join(dealt(more), key, "left")
    out = out.na.fill(0, ["sources", "operations", "tainted", "tainted_delegatecall"])
    return out.withColumn("propagation_ratio", F.when(c("operations") > 0, F.round(c("tainted") / c("operations"), 3)).otherwise(0.0))
