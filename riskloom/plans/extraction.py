"""Feature extraction queries over relations of findings, functions and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import extraction as ex
from riskloom.operators import sequence
from riskloom.plans.base import FRAME_SQL, Plan, frame
from riskloom.session import table

plan = Plan()

#: column -> expression; the same text is valid in Spark and DuckDB
FUNCTIONS = {
    "contract": "l_orderkey",
    "visibility": "CASE l_partkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'external' WHEN 2 THEN 'internal' ELSE 'private' END",
    "is_view": "l_suppkey % 5 = 0",
    "is_pure": "l_suppkey % 7 = 3",
    "is_constructor": "l_linenumber = 1 AND l_orderkey % 3 = 0",
    "payable": "l_suppkey % 4 = 1",
    "emits": "l_discount > 0.05",
    "params": "l_partkey % 3",
    "modifier": "CASE WHEN l_orderkey % 4 = 0 AND l_linenumber % 2 = 0 THEN 'nonReentrant' WHEN l_linenumber % 3 = 0 THEN 'onlyOwner' END",
    "state_variable": "CASE WHEN l_orderkey % 10 = 1 AND l_linenumber = 2 THEN 'reentrancyLock' ELSE concat('v', l_linenumber) END",
    "call_text": "CASE WHEN l_returnflag = 'R' THEN 'token.Transfer(to)' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'oracle.price()' END",
    "low_level": "l_suppkey % 6 = 2",
    "read_variable": "CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 5 END",
    "written_variable": "CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 5 END",
    "checked": "l_quantity > 25",
    "base_depth": "l_suppkey % 4",
}
FUNCTIONS_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in FUNCTIONS.items()) + " FROM lineitem)"

OPERATIONS = {
    "contract": "user_id",
    "pos": "event_id",
    "op": "CASE (event_id * 7 + user_id) % 9 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(ex.OPERATIONS)) + " END",
    "name": "CASE WHEN event_type = 'click' THEN 'target.delegatecall' ELSE 'target.call' END",
    "arg": "event_id % 6",
    "lvalue": "CASE WHEN event_id % 5 <> 0 THEN (event_id + user_id) % 7 END",
}
OPERATIONS_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in OPERATIONS.items()) + " FROM events)"

FINDINGS = {
    "contract": "user_id",
    "name": "concat('C', user_id, 'x')",
    "detector": f"CASE (event_id * 11 + user_id) % {len(ex.FLAG_OF) + 1} " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(sorted(ex.FLAG_OF))) + " ELSE 'other-finding' END",
    "impact": "CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'click' THEN 'low' WHEN 'view' THEN 'informational' ELSE 'optimization' END",
    "description": "CASE WHEN event_id % 4 = 0 THEN 'Issue elsewhere' ELSE concat('Issue in c', user_id, 'X.run') END",
}
FINDINGS_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in FINDINGS.items()) + " FROM events)"


def relation(spark, sf_dir, of: str, columns: dict[str, str]):
    return table(spark, sf_dir, of).select(*[F.expr(v).alias(k) for k, v in columns.items()])


def functions(spark, sf_dir):
    """One row for each function of a contract (an order line of an order)."""
    return relation(spark, sf_dir, "lineitem", FUNCTIONS)


def _has(flag: str, *detectors: str) -> str:
    return f"max(CASE WHEN own AND detector IN ({', '.join(repr(d) for d in detectors)}) THEN 1 ELSE 0 END) AS {flag}"


@plan("flag_vector", f"""
    SELECT contract, {_has('has_reentrancy', 'reentrancy-eth', 'reentrancy-no-eth', 'reentrancy-unlimited-gas')}, {_has('has_tx_origin', 'tx-origin')}, {_has('has_unchecked_call', 'unchecked-send', 'unchecked-lowlevel')},
      {_has('has_delegatecall', 'controlled-delegatecall', 'delegatecall-loop')}, {_has('has_timestamp_dependence', 'timestamp', 'block-timestamp')},
      {_has('has_access_control_issue', 'arbitrary-send-eth', 'arbitrary-send-erc20', 'arbitrary-send-erc20-no-permit', 'suicidal', 'unprotected-upgrade', 'unprotected-upgradeable')},
      {_has('has_arithmetic_issue', 'incorrect-shift', 'too-many-digits')}, {_has('has_unchecked_low_level_call', 'unchecked-transfer')}, {_has('has_dangerous_strict_equality', 'dangerous-strict-equalities')},
      {_has('has_locked_ether', 'locked-ether')}, {_has('has_state_variable_shadowing', 'shadowing-state', 'shadowing-local', 'shadowing-abstract')},
      {_has('has_uninitialized_storage', 'uninitialized-state', 'uninitialized-storage', 'uninitialized-local', 'uninitialized-state-variables')}, {_has('has_naming_convention_violation', 'naming-convention')},
      {_has('has_unused_state_variable', 'unused-state', 'unused-return')}, {_has('has_costly_loop', 'costly-loop')}, {_has('has_external_function', 'external-function')},
      {_has('has_deprecated_construct', 'deprecated-standards', 'solc-version', 'incorrect-version', 'pragma', 'floating-pragma')}, {_has('has_incorrect_equality', 'incorrect-equality')},
      {_has('has_boolean_constant_misuse', 'boolean-cst', 'boolean-equal')}, {_has('has_divide_before_multiply', 'divide-before-multiply')}, {_has('has_weak_randomness', 'weak-prng')},
      {_has('has_assembly_usage', 'assembly', 'incorrect-assembly')}, {_has('has_low_level_calls', 'low-level-calls', 'controlled-array-length')},
      count(*) FILTER (WHERE own AND impact = 'high') AS high, count(*) FILTER (WHERE own AND impact = 'medium') AS medium, count(*) FILTER (WHERE own AND impact IN ('low', 'informational')) AS low,
      count(DISTINCT CASE WHEN own AND detector <> 'other-finding' THEN detector END) AS fired
    FROM (SELECT *, contains(lower(description), lower(name)) AS own FROM {FINDINGS_SQL}) GROUP BY contract""")  # fmt: skip
def flag_vector(spark, sf_dir):
    """23 flags and severity counts from the findings that name their contract."""
    return ex.flag_vector(relation(spark, sf_dir, "events", FINDINGS), "contract", F.col("name"))


@plan("tier4_statistics", f"""
    SELECT contract, count(DISTINCT detector) AS fired, round(count(DISTINCT detector) / {len(ex.FLAG_OF)}.0::DOUBLE, 3) AS fire_rate,
           count(DISTINCT CASE WHEN impact = 'high' THEN detector END) AS high_fired, count(DISTINCT CASE WHEN impact = 'medium' THEN detector END) AS medium_fired, count(DISTINCT CASE WHEN impact IN ('low', 'informational') THEN detector END) AS low_fired,
           round(count(DISTINCT CASE WHEN impact = 'high' THEN detector END) / {len(ex.FLAG_OF)}.0::DOUBLE, 3) AS high_rate
    FROM {FINDINGS_SQL} WHERE detector <> 'other-finding' GROUP BY contract""")  # fmt: skip
def tier4_statistics(spark, sf_dir):
    """Detectors that fired, their rate, and the same by impact."""
    n = F.lit(float(len(ex.FLAG_OF)))
    d = relation(spark, sf_dir, "events", FINDINGS).where("detector != 'other-finding'").groupBy("contract", "detector").agg(
        *[F.max(F.col("impact").isin(*i)).alias(k) for k, i in {"h": ["high"], "m": ["medium"], "l": ["low", "informational"]}.items()])
    by = d.groupBy("contract").agg(F.count("*").alias("fired"), F.count_if("h").alias("high_fired"), F.count_if("m").alias("medium_fired"), F.count_if("l").alias("low_fired"))
    return by.select("*", F.round(F.col("fired") / n, 3).alias("fire_rate"), F.round(F.col("high_fired") / n, 3).alias("high_rate"))


@plan("function_counts", f"""
    SELECT contract, count(*) AS num_functions, count(DISTINCT state_variable) AS num_state_vars, count(DISTINCT modifier) AS num_modifiers, count(*) FILTER (WHERE emits) AS num_events,
           count(call_text) AS num_external_calls, count(*) FILTER (WHERE low_level) AS num_low_level_calls, count(*) FILTER (WHERE payable) AS num_payable_functions, max(base_depth) AS inheritance_depth FROM {FUNCTIONS_SQL} GROUP BY contract""")  # fmt: skip
def function_counts(spark, sf_dir):
    return ex.api_counts(functions(spark, sf_dir), "contract")


@plan("extended_api_counts", f"""
    SELECT contract, count(*) AS num_functions_declared, count(*) FILTER (WHERE visibility = 'public') AS num_public_functions, count(*) FILTER (WHERE visibility = 'external') AS num_external_functions,
           count(*) FILTER (WHERE visibility = 'internal') AS num_internal_functions, count(*) FILTER (WHERE visibility = 'private') AS num_private_functions, count(*) FILTER (WHERE is_view) AS num_view_functions,
           count(*) FILTER (WHERE is_pure) AS num_pure_functions, count(*) FILTER (WHERE is_constructor) AS num_constructors, count(read_variable) AS total_state_reads, count(written_variable) AS total_state_writes,
           round(count(read_variable) / count(*)::DOUBLE, 2) AS avg_state_reads_per_function, round(count(written_variable) / count(*)::DOUBLE, 2) AS avg_state_writes_per_function FROM {FUNCTIONS_SQL} GROUP BY contract""")  # fmt: skip
def extended_api_counts(spark, sf_dir):
    return ex.extended_api(functions(spark, sf_dir), "contract")


@plan("guarded_functions", f"""
    SELECT contract, max(CASE WHEN lower(modifier) LIKE '%nonreentrant%' OR regexp_matches(lower(state_variable), 'lock|mutex|guard|entered') THEN 1 ELSE 0 END) AS has_reentrancy_guard,
           count(*) FILTER (WHERE lower(modifier) LIKE '%nonreentrant%' AND NOT is_constructor AND NOT is_view AND NOT is_pure) AS guarded_functions FROM {FUNCTIONS_SQL} GROUP BY contract""")  # fmt: skip
def guarded_functions(spark, sf_dir):
    return ex.guards(functions(spark, sf_dir), "contract")


@plan("dataflow_features", f"""
    WITH f AS {FUNCTIONS_SQL}, r AS (SELECT DISTINCT contract, read_variable AS v FROM f WHERE read_variable IS NOT NULL), w AS (SELECT DISTINCT contract, written_variable AS v FROM f WHERE written_variable IS NOT NULL),
      x AS (SELECT contract, count(*) AS n FROM r JOIN w USING (contract, v) GROUP BY contract)
    SELECT f.contract, count(*) FILTER (WHERE params > 0 AND (call_text IS NOT NULL OR written_variable IS NOT NULL)) AS dataflow_num_tainted_flows,
           count(*) FILTER (WHERE regexp_matches(lower(call_text), 'transfer|send|call|selfdestruct')) AS dataflow_num_sinks, count(*) FILTER (WHERE params > 0 AND NOT checked) AS dataflow_unvalidated_inputs,
           count(*) FILTER (WHERE params > 0 AND written_variable IS NOT NULL) AS dataflow_tainted_storage_writes, count(*) FILTER (WHERE params > 0 AND call_text IS NOT NULL) AS dataflow_tainted_external_calls,
           count(*) FILTER (WHERE params > 0 AND checked) AS dataflow_sanitization_points, coalesce(max(x.n), 0) AS dataflow_cross_function_flows FROM f LEFT JOIN x USING (contract) GROUP BY f.contract""")  # fmt: skip
def dataflow_features(spark, sf_dir):
    return ex.dataflow(functions(spark, sf_dir), "contract")


@plan("ir_operation_counts", "SELECT contract, " + ", ".join(f"count(*) FILTER (WHERE op = '{o}') AS ir_{o.lower()}_count" for o in ex.OPERATIONS) + f"""
    , count(*) FILTER (WHERE op = 'Binary') AS ir_arithmetic_ops, count(*) FILTER (WHERE op IN ('LowLevelCall', 'Transfer', 'Send')) AS ir_taint_sinks,
    count(*) FILTER (WHERE op = 'HighLevelCall' AND lvalue IS NULL) AS ir_unchecked_return_values FROM {OPERATIONS_SQL} GROUP BY contract""")  # fmt: skip
def ir_operation_counts(spark, sf_dir):
    return ex.operation_counts(relation(spark, sf_dir, "events", OPERATIONS), "contract")


@plan("ir_taint")
def ir_taint(spark, sf_dir):
    """Forward taint from two parameters through assignments, in the order of a contract's operations."""
    return ex.taint(relation(spark, sf_dir, "events", OPERATIONS), "contract", "pos", [0, 1])


NODES = {
    "function": "l_orderkey", "pos": "l_linenumber", "is_constructor": "l_orderkey % 11 = 0", "is_view": "l_orderkey % 5 = 0", "is_pure": "l_orderkey % 7 = 0",
    "calls": "l_returnflag = 'R'", "writes": "l_linestatus = 'F'", "checked": "l_quantity > 25",
}
NODES_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in NODES.items()) + " FROM lineitem)"


@plan("acting_call_write_order", f"""
    WITH s AS (SELECT * FROM {NODES_SQL} WHERE NOT (is_constructor OR is_view OR is_pure)), a AS (SELECT function, min(CASE WHEN calls THEN pos END) AS fc, max(CASE WHEN writes THEN pos END) AS lw FROM s GROUP BY function)
    SELECT function, max(CASE WHEN coalesce(lw >= fc, false) THEN 1 ELSE 0 END) AS violation, max(CASE WHEN coalesce(lw <= fc, false) THEN 1 ELSE 0 END) AS safe,
           count(*) FILTER (WHERE writes AND pos <= fc)::INT AS before, count(*) FILTER (WHERE calls AND NOT checked AND pos < lw)::INT AS unchecked FROM s JOIN a USING (function) GROUP BY function""")  # fmt: skip
def acting_call_write_order(spark, sf_dir):
    """Writes after calls in functions that change state: no constructors, views or pure ones."""
    nodes = ex.acts(relation(spark, sf_dir, "lineitem", NODES))
    return sequence.call_write_rules(nodes, ["function"], "pos", F.col("calls"), F.col("writes"), F.col("checked"))


#: columns of a mode, each one more tier than the one before; what is left out is metadata or gives the label away
TIERS = [["num_functions", "num_external_calls", "max_complexity", "lines_of_code", "high", "medium", "low"], ["cei_violations", "cei_score", "state_after_call_count"], ["num_library_calls", "inheritance_depth"]]
MODES = {"optimized": 1, "comprehensive": 2, "maximum": 3}


def of_mode(df, mode: str):
    """The id and the columns of a mode's tiers, in order; metadata and columns that give the label away are in none."""
    return df.select("id", *[n for tier in TIERS[: MODES[mode]] for n in tier])


@plan("mode_columns", f"""
    SELECT 'comprehensive' AS mode, 10 AS columns, count(*) AS n, sum(num_functions + num_external_calls + max_complexity + lines_of_code + high + medium + low + cei_violations + state_after_call_count)::BIGINT AS total, round(sum(cei_score), 4) AS score FROM {FRAME_SQL}""")  # fmt: skip
def mode_columns(spark, sf_dir):
    """Columns picked by mode."""
    d = of_mode(frame(spark, sf_dir), "comprehensive").drop("id")
    whole = sum((F.col(n) for n in d.columns if n != "cei_score"), F.lit(0))
    return d.agg(F.lit("comprehensive").alias("mode"), F.lit(len(d.columns)).alias("columns"), F.count("*").alias("n"), F.sum(whole).alias("total"), F.round(F.sum("cei_score"), 4).alias("score"))


MORE = {
    "num_external_functions": "num_functions % 4", "num_public_functions": "num_functions % 3", "num_view_functions": "num_functions % 5", "num_payable_functions": "num_external_calls % 2",
    "total_state_reads": "num_state_vars % 7", "total_state_writes": "num_state_vars % 3", "has_arithmetic": "CASE WHEN detectors % 4 = 1 THEN 1 ELSE 0 END",
}


@plan("cross_tier_aggregates", f"""
    SELECT id, round(high / t::DOUBLE, 3) AS high_confidence_ratio, round(medium / t::DOUBLE, 3) AS medium_confidence_ratio, round(low / t::DOUBLE, 3) AS low_confidence_ratio,
           round(high / t::DOUBLE, 3) AS high_severity_ratio, round(medium / t::DOUBLE, 3) AS medium_severity_ratio, round(low / t::DOUBLE, 3) AS low_severity_ratio, round(high / t::DOUBLE, 3) AS critical_to_total_ratio,
           round(num_external_functions / nf::DOUBLE, 3) AS external_to_total_functions, round(num_public_functions / nf::DOUBLE, 3) AS public_to_total_functions, round(num_view_functions / nf::DOUBLE, 3) AS view_to_total_functions, round(num_payable_functions / nf::DOUBLE, 3) AS payable_to_total_functions,
           CASE WHEN total_state_writes > 0 THEN round(total_state_reads / total_state_writes::DOUBLE, 3) ELSE 0 END AS state_reads_to_writes_ratio, round(num_external_calls / nf::DOUBLE, 3) AS external_calls_to_functions_ratio,
           high + medium AS security_detector_count, 0 AS optimization_detector_count, low AS best_practice_detector_count, 0 AS gas_detector_count, has_reentrancy AS reentrancy_detector_count, has_access_control AS access_control_detector_count, has_arithmetic AS arithmetic_detector_count,
           abs(max_complexity - avg_complexity) AS complexity_variance, CASE WHEN max_complexity > 10 THEN 1 ELSE 0 END AS high_complexity_function_count, CASE WHEN avg_complexity < 3 THEN 1 ELSE 0 END AS low_complexity_function_count,
           round(loc / nf::DOUBLE, 2) AS avg_loc_per_function, 0 AS max_loc_per_function, comment_ratio AS functions_with_comments_ratio, 0 AS recursive_call_count, 0 AS self_destruct_count, 0 AS create_contract_count,
           max_complexity AS if_node_count, 0 AS require_node_count, 0 AS assert_node_count, has_assembly AS assembly_node_count, nf AS return_node_count, high AS high_risk_pattern_count, medium AS medium_risk_pattern_count, low AS low_risk_pattern_count,
           round((high + medium + low) * 100 / loc::DOUBLE, 2) AS vulnerability_density
    FROM (SELECT *, CASE WHEN high + medium + low = 0 THEN 1 ELSE high + medium + low END AS t, CASE WHEN num_functions = 0 THEN 1 ELSE num_functions END AS nf, CASE WHEN lines_of_code = 0 THEN 100 ELSE lines_of_code END AS loc, {", ".join(f"{v} AS {k}" for k, v in MORE.items())} FROM {FRAME_SQL})""")  # fmt: skip
def cross_tier_aggregates(spark, sf_dir):
    """The 38 aggregations over the other tiers."""
    f = frame(spark, sf_dir)
    return f.select("*", *[F.expr(v).alias(k) for k, v in MORE.items()]).select("id", *[v.alias(k) for k, v in ex.cross_tier().items()])


QUERIES, ORACLE_SQL = plan.queries, plan.oracle_sql
