"""Feature extraction over relations of a contract's parts: findings, functions and operations.

Each operator is one aggregation by contract; sets of variables are of names, so they stay small
whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

# Flag -> detectors. A detector that stands under several flags counts for the last.
FLAGS = {
    "has_reentrancy": ["reentrancy-eth", "reentrancy-no-eth", "reentrancy-unlimited-gas"],
    "has_tx_origin": ["tx-origin"],
    "has_unchecked_call": ["unchecked-send", "unchecked-lowlevel", "low-level-calls"],
    "has_delegatecall": ["controlled-delegatecall", "delegatecall-loop"],
    "has_timestamp_dependence": ["timestamp", "weak-prng", "block-timestamp"],
    "has_access_control_issue": ["arbitrary-send-eth", "arbitrary-send-erc20", "arbitrary-send-erc20-no-permit", "suicidal", "unprotected-upgrade", "unprotected-upgradeable"],
    "has_arithmetic_issue": ["divide-before-multiply", "incorrect-shift", "too-many-digits"],
    "has_unchecked_low_level_call": ["unchecked-transfer"],
    "has_dangerous_strict_equality": ["dangerous-strict-equalities"],
    "has_locked_ether": ["locked-ether"],
    "has_state_variable_shadowing": ["shadowing-state", "shadowing-local", "shadowing-abstract"],
    "has_uninitialized_storage": ["uninitialized-state", "uninitialized-storage", "uninitialized-local", "uninitialized-state-variables"],
    "has_naming_convention_violation": ["naming-convention"],
    "has_unused_state_variable": ["unused-state", "unused-return"],
    "has_costly_loop": ["costly-loop"],
    "has_external_function": ["external-function"],
    "has_deprecated_construct": ["deprecated-standards", "solc-version", "incorrect-version", "pragma", "floating-pragma"],
    "has_incorrect_equality": ["incorrect-equality"],
    "has_boolean_constant_misuse": ["boolean-cst", "boolean-equal"],
    "has_divide_before_multiply": ["divide-before-multiply"],
    "has_weak_randomness": ["weak-prng"],
    "has_assembly_usage": ["assembly", "incorrect-assembly"],
    "has_low_level_calls": ["low-level-calls", "controlled-array-length"],
}
FLAG_OF = {d: flag for flag, detectors in FLAGS.items() for d in detectors}
GUARD_WORDS = ["lock", "mutex", "guard", "entered"]  # Fixed values: names of mutex variables
SINK_WORDS = ["transfer", "send", "call", "delegatecall", "selfdestruct"]  # Fixed values: calls that data must not reach unchecked
OPERATIONS = ["HighLevelCall", "LowLevelCall", "InternalCall", "LibraryCall", "Assignment", "Binary", "Unary", "Transfer", "Send"]  # Fixed values
SINKS = ["LowLevelCall", "Transfer", "Send"]  # Fixed values


def any_of(text: Column, words: list[str]) -> Column:
    """Does the text hold one of the words, in any case?"""
    low = F.lower(text)
    return F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(False))


def flag_vector(findings: DataFrame, key: str, name: Column, detector: str = "detector", impact: str = "impact", description: str = "description") -> DataFrame:
    """A row for each key: its flags and severity counts, from the findings whose description names it.

    Informational findings count as low; `fired` is the number of detectors that stand under a flag.
    """
    own = findings.where(F.contains(F.lower(description), F.lower(name)))
    flag = F.create_map(*[F.lit(x) for kv in FLAG_OF.items() for x in kv])[c(detector)]
    known = own.withColumn("_flag", flag).groupBy(key).agg(
        *[F.max(F.coalesce(c("_flag") == f, F.lit(False)).cast("int")).alias(f) for f in FLAGS],
        F.count_if(c(impact) == "high").alias("high"), F.count_if(c(impact) == "medium").alias("medium"), F.count_if(c(impact).isin("low", "informational")).alias("low"),
        F.countDistinct(F.when(c("_flag").isNotNull(), c(detector))).alias("fired"),
    )
    return findings.select(key).distinct().join(known, key, "left").na.fill(0)


def api_counts(functions: DataFrame, key: str) -> DataFrame:
    """Eight counts of a contract's declared parts."""
    n = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    return functions.groupBy(key).agg(
        F.count("*").alias("num_functions"), F.countDistinct("state_variable").alias("num_state_vars"), F.countDistinct("modifier").alias("num_modifiers"),
        n(c("emits")).alias("num_events"), n(c("call_text").isNotNull()).alias("num_external_calls"), n(c("low_level")).alias("num_low_level_calls"),
        n(c("payable")).alias("num_payable_functions"), F.max("base_depth").alias("inheritance_depth"),
    )


def extended_api(functions: DataFrame, key: str) -> DataFrame:
    """Functions by visibility and kind, state reads and writes, and their means by function."""
    n = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    by = functions.groupBy(key).agg(
        F.count("*").alias("num_functions_declared"),
        *[n(c("visibility") == v).alias(f"num_{v}_functions") for v in ("public", "external", "internal", "private")],
        n(c("is_view")).alias("num_view_functions"), n(c("is_pure")).alias("num_pure_functions"), n(c("is_constructor")).alias("num_constructors"),
        F.count("read_variable").alias("total_state_reads"), F.count("written_variable").alias("total_state_writes"),
    )
    mean = lambda x: F.round(c(f"total_state_{x}") / c("num_functions_declared"), 2).alias(f"avg_state_{x}_per_function")
    return by.select("*", mean("reads"), mean("writes"))


def acts(functions: DataFrame) -> DataFrame:
    """Functions that change state when called: no constructors, no views, nothing pure."""
    return functions.where(~(F.coalesce("is_constructor", F.lit(False)) | F.coalesce("is_view", F.lit(False)) | F.coalesce("is_pure", F.lit(False))))


def guards(functions: DataFrame, key: str) -> DataFrame:
    """Has the contract a reentrancy guard, by a modifier or a mutex variable, and how many functions does it protect?"""
    modified = any_of(c("modifier"), ["nonreentrant"])
    free = ~(F.coalesce("is_constructor", F.lit(False)) | F.coalesce("is_view", F.lit(False)) | F.coalesce("is_pure", F.lit(False)))
    return functions.groupBy(key).agg(
        F.max((modified | any_of(c("state_variable"), GUARD_WORDS)).cast("int")).alias("has_reentrancy_guard"),
        F.count_if(modified & free).alias("guarded_functions"),
    )


def dataflow(functions: DataFrame, key: str) -> DataFrame:
    """Sinks, tainted flows, validation, and variables that are both written and read."""
    takes, calls, writes = c("params") > 0, c("call_text").isNotNull(), c("written_variable").isNotNull()
    n = lambda when, name: F.count_if(F.coalesce(when, F.lit(False))).alias(f"dataflow_{name}")
    by = functions.groupBy(key).agg(
        n(takes & (calls | writes), "num_tainted_flows"), n(any_of(c("call_text"), SINK_WORDS), "num_sinks"),
        n(takes & ~c("checked"), "unvalidated_inputs"), n(takes & writes, "tainted_storage_writes"), n(takes & calls, "tainted_external_calls"), n(takes & c("checked"), "sanitization_points"),
        F.array_intersect(F.collect_set("written_variable"), F.collect_set("read_variable")).alias("both"),
    )
    return by.withColumn("dataflow_cross_function_flows", F.size("both").cast("long")).drop("both")


def operation_counts(operations: DataFrame, key: str) -> DataFrame:
    """How often each kind of operation occurs, sinks, and calls whose result nobody takes."""
    return operations.groupBy(key).agg(
        *[F.count_if(c("op") == o).alias(f"ir_{o.lower()}_count") for o in OPERATIONS],
        F.count_if(c("op") == "Binary").alias("ir_arithmetic_ops"), F.count_if(c("op").isin(SINKS)).alias("ir_taint_sinks"),
        F.count_if((c("op") == "HighLevelCall") & c("lvalue").isNull()).alias("ir_unchecked_return_values"),
    )


def taint(operations: DataFrame, key: str, pos: str, sources: list[int]) -> DataFrame:
    """key, operations, tainted variables, delegate calls that take one, and their ratio to the operations.

    Taint starts in `sources`, and an assignment of a tainted variable taints what it writes. Rows come
    sorted by key and position, and only the open key's set of variables is held.
    """
    kinds = f"{key} long, operations long, tainted long, tainted_delegatecall long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known, n, hits = None, set(sources), 0, 0
        for pdf in batches:
            out = []
            for k, op, name, arg, lvalue in pdf.itertuples(index=False):
                if k != now:
                    if now is not None:
                        out.append((now, n, len(known), hits))
                    now, known, n, hits = k, set(sources), 0, 0
                n += 1
                if arg in known:
                    hits += op == "LowLevelCall" and "delegatecall" in (name or "").lower()
                    if op == "Assignment" and lvalue == lvalue and lvalue is not None:
                        known.add(int(lvalue))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in kinds.split(", ")])
        if now is not None:
            yield pd.DataFrame([(now, n, len(known), hits)], columns=[x.split()[0] for x in kinds.split(", ")])

    together = operations.repartition(key).sortWithinPartitions(key, pos).select(key, "op", "name", "arg", "lvalue")
    return together.mapInPandas(run, kinds).withColumn("ir_taint_propagation_ratio", F.round(c("tainted") / c("operations"), 3))


def cross_tier(fixed: bool = True) -> dict[str, Column]:
    """The 38 aggregations over a record's other features; without findings the density is 0 if `fixed`, 1 finding's else.

    Some are constants by definition: nothing measures them.
    """
    or_one = lambda x: F.when(x == 0, 1).otherwise(x)
    share = lambda a, b, n=3: F.round(a / b, n)
    flag = lambda x: x.cast("int")
    zero = F.lit(0)
    levels = {"high": c("high"), "medium": c("medium"), "low": c("low")}
    found = c("high") + c("medium") + c("low")
    functions, loc = or_one(c("num_functions")), F.when(c("lines_of_code") == 0, 100).otherwise(c("lines_of_code"))
    out = {f"{k}_confidence_ratio": share(v, or_one(found)) for k, v in levels.items()}  # confidence follows severity
    out |= {f"{k}_severity_ratio": share(v, or_one(found)) for k, v in levels.items()} | {"critical_to_total_ratio": share(c("high"), or_one(found))}
    out |= {f"{k}_to_total_functions": share(c(f"num_{k}_functions"), functions) for k in ("external", "public", "view", "payable")}
    out["state_reads_to_writes_ratio"] = F.when(c("total_state_writes") > 0, share(c("total_state_reads"), c("total_state_writes"))).otherwise(0.0)
    out["external_calls_to_functions_ratio"] = share(c("num_external_calls"), functions)
    out |= {"security_detector_count": c("high") + c("medium"), "optimization_detector_count": zero, "best_practice_detector_count": c("low"), "gas_detector_count": zero}
    out |= {"reentrancy_detector_count": c("has_reentrancy"), "access_control_detector_count": c("has_access_control"), "arithmetic_detector_count": c("has_arithmetic")}
    out |= {"complexity_variance": F.abs(c("max_complexity") - c("avg_complexity")), "high_complexity_function_count": flag(c("max_complexity") > 10), "low_complexity_function_count": flag(c("avg_complexity") < 3)}
    out |= {"avg_loc_per_function": share(loc, functions, 2), "max_loc_per_function": zero, "functions_with_comments_ratio": c("comment_ratio")}
    out |= {"recursive_call_count": zero, "self_destruct_count": zero, "create_contract_count": zero}
    out |= {"if_node_count": c("max_complexity"), "require_node_count": zero, "assert_node_count": zero, "assembly_node_count": c("has_assembly"), "return_node_count": functions}
    out |= {"high_risk_pattern_count": c("high"), "medium_risk_pattern_count": c("medium"), "low_risk_pattern_count": c("low")}
    out["vulnerability_density"] = share((found if fixed else or_one(found)) * 100, loc, 2)
    return out
