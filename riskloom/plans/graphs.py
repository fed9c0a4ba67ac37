"""Control-flow, call-graph and taint queries: a conversation is a contract, a message a function, a line a node or an operation."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import extraction as ex
from riskloom.operators import graph, taint
from riskloom.plans.base import Plan
from riskloom.session import table

plan = Plan()
c = F.col
FLOW, CALLS = ["contract", "function"], ["contract"]

#: column -> expression over a message's lines (line from 0, n of them, size in characters); the same text is valid in Spark and DuckDB
KIND = "CASE size % 27 WHEN 0 THEN 'NodeType.RETURN' WHEN 9 THEN 'NodeType.THROW' WHEN 18 THEN 'NodeType.Revert' ELSE 'NodeType.EXPRESSION' END"
JUMPS = "size % 3 = 0"
TARGET = "least(n - 1, greatest(0, line + size % 7 - 3))"
OPERATION = {
    "op": "CASE (size + line) % 9 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(ex.OPERATIONS)) + " END",
    "name": "CASE WHEN size % 2 = 0 THEN 'to.DelegateCall' ELSE 'to.call' END",
    "rvalue": "size % 11",
    "lvalue": "CASE WHEN size % 4 <> 3 THEN (size * 3 + line) % 13 END",
}
FUNCTION = {"is_constructor": "turn % 11 = 10", "is_view": "turn % 5 = 4", "is_pure": "turn % 13 = 6"}

LINES_SQL = """lines AS (SELECT conv_id AS contract, turn AS function, role, s - 1 AS line, n, length(parts[s]) AS size FROM (SELECT *, string_split(text, chr(10)) AS parts, len(string_split(text, chr(10))) AS n FROM conversations) m, unnest(range(1, n + 1)) t(s))"""
FLOW_SQL = f"""{LINES_SQL}, nodes AS (SELECT contract, function, line AS node, regexp_matches(lower({KIND}), 'return|throw|revert') AS exit, n FROM lines),
      e0 AS (SELECT contract, function, line AS src, line + 1 AS dst FROM lines WHERE line < n - 1 AND NOT regexp_matches(lower({KIND}), 'return|throw|revert') UNION ALL SELECT contract, function, line, {TARGET} FROM lines WHERE {JUMPS}),
      e AS (SELECT DISTINCT * FROM e0),
      walk AS (SELECT contract, function, node, 0 AS d, n FROM nodes WHERE node = 0 UNION SELECT w.contract, w.function, e.dst, w.d + 1, w.n FROM walk w JOIN e ON w.contract = e.contract AND w.function = e.function AND w.node = e.src WHERE w.d < w.n),
      live AS (SELECT contract, function, node, min(d) AS d FROM walk GROUP BY ALL)"""
AROUND_SQL = """around AS (SELECT contract, function, node AS gone, 0::BIGINT AS node FROM live WHERE node <> 0 UNION SELECT a.contract, a.function, a.gone, e.dst FROM around a JOIN e ON a.contract = e.contract AND a.function = e.function AND a.node = e.src WHERE e.dst <> a.gone),
      dom AS (SELECT x.contract, x.function, x.node AS d, y.node FROM live x JOIN live y USING (contract, function) WHERE NOT EXISTS (SELECT 1 FROM around a WHERE a.contract = x.contract AND a.function = x.function AND a.gone = x.node AND a.node = y.node)),
      front AS (SELECT DISTINCT dom.contract, dom.function, dom.d AS node, e.dst AS frontier FROM dom JOIN e ON dom.contract = e.contract AND dom.function = e.function AND dom.node = e.src
                WHERE NOT EXISTS (SELECT 1 FROM dom s WHERE s.contract = e.contract AND s.function = e.function AND s.d = dom.d AND s.node = e.dst AND s.d <> s.node))"""
CYCLES_SQL = """clos AS (SELECT {k}, src AS a, dst AS b FROM e UNION SELECT {ck}, c.a, e.dst FROM clos c JOIN e ON {on} AND c.b = e.src),
      paths AS (SELECT {k}, src AS start, src AS node, [src] AS path, false AS closed FROM e UNION SELECT {pk}, p.start, e.dst, list_append(p.path, e.dst), e.dst = p.start FROM paths p JOIN e ON {pon} AND p.node = e.src AND e.dst >= p.start
                WHERE NOT p.closed AND (e.dst = p.start OR NOT list_contains(p.path, e.dst)) AND EXISTS (SELECT 1 FROM clos r WHERE {ron} AND r.a = e.dst AND r.b = p.start)),
      cyc AS (SELECT {k}, count(*) AS cycles FROM paths WHERE closed GROUP BY ALL)"""


def _cycles(keys: list[str]) -> str:
    same = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    at = lambda a: ", ".join(f"{a}.{x}" for x in keys)
    return CYCLES_SQL.format(k=", ".join(keys), ck=at("c"), pk=at("p"), on=same("c", "e"), pon=same("p", "e"), ron=same("r", "e"))


def lines(spark, sf_dir):
    """contract, function, role, line, n, size: a row for each line of a message."""
    m = table(spark, sf_dir, "conversations").select(c("conv_id").alias("contract"), c("turn").alias("function"), "role", F.split("text", "\n").alias("parts"))
    return m.select("contract", "function", "role", F.size("parts").alias("n"), F.posexplode("parts").alias("line", "body")).select("contract", "function", "role", c("line").cast("long").alias("line"), "n", F.length("body").alias("size"))


def flow(spark, sf_dir):
    """Nodes with `exit`, edges (fall through, unless the node leaves the function, and jumps), and entries."""
    l = lines(spark, sf_dir)
    leaves = ex.any_of(F.expr(KIND), ["return", "throw", "revert"])
    nodes = l.select(*FLOW, c("line").alias("node"), leaves.alias("exit"))
    through = l.where((c("line") < c("n") - 1) & ~leaves).select(*FLOW, c("line").alias("src"), (c("line") + 1).alias("dst"))
    jumps = l.where(JUMPS).select(*FLOW, c("line").alias("src"), F.expr(TARGET).cast("long").alias("dst"))
    return nodes, through.unionByName(jumps), l.where("line = 0").select(*FLOW, c("line").alias("root")).distinct()


@plan("cfg_measures", f"""
    WITH RECURSIVE {FLOW_SQL}, {AROUND_SQL}, {_cycles(FLOW)}
    SELECT n.contract, n.function, n.nodes, coalesce(edges, 0) AS edges, coalesce(cycles, 0) AS cycles, CASE WHEN coalesce(cycles, 0) > 1 THEN 1 ELSE 0 END AS complex, l.depth, n.exits, l.dominators, coalesce(f.frontiers, 0) AS frontiers, coalesce(f.frontier_pairs, 0) AS frontier_pairs
    FROM (SELECT contract, function, count(*) AS nodes, count(*) FILTER (WHERE exit) AS exits FROM nodes GROUP BY ALL) n
      LEFT JOIN (SELECT contract, function, count(*) AS edges FROM e0 GROUP BY ALL) USING (contract, function) LEFT JOIN cyc USING (contract, function)
      LEFT JOIN (SELECT contract, function, max(d) AS depth, count(*) AS dominators FROM live GROUP BY ALL) l USING (contract, function)
      LEFT JOIN (SELECT contract, function, count(DISTINCT node) AS frontiers, count(*) AS frontier_pairs FROM front GROUP BY ALL) f USING (contract, function)""")  # fmt: skip
def cfg_measures(spark, sf_dir):
    """Control-flow measures of each function."""
    return graph.flow_measures(*flow(spark, sf_dir), FLOW)


@plan("cfg_contract_measures", f"""
    WITH RECURSIVE {FLOW_SQL}, {_cycles(FLOW)}
    SELECT n.contract, sum(coalesce(cycles, 0))::BIGINT AS cfg_num_cycles, max(depth)::INT AS cfg_max_depth, round(sum(coalesce(edges, 0)) / sum(nodes)::DOUBLE, 2) AS cfg_avg_branching_factor, count(*) FILTER (WHERE cycles > 1) AS cfg_num_complex_loops,
           sum(exits)::BIGINT AS cfg_num_exit_points, sum(dominators)::BIGINT AS cfg_dominators_count
    FROM (SELECT contract, function, count(*) AS nodes, count(*) FILTER (WHERE exit) AS exits FROM nodes GROUP BY ALL) n
      LEFT JOIN (SELECT contract, function, count(*) AS edges FROM e0 GROUP BY ALL) USING (contract, function) LEFT JOIN cyc USING (contract, function)
      LEFT JOIN (SELECT contract, function, max(d) AS depth, count(*) AS dominators FROM live GROUP BY ALL) USING (contract, function) GROUP BY n.contract""")  # fmt: skip
def cfg_contract_measures(spark, sf_dir):
    """The same by contract: sums, the deepest function, edges for each node."""
    by = graph.flow_measures(*flow(spark, sf_dir), FLOW, frontiers=False).groupBy("contract")
    total = lambda x, name: F.sum(x).cast("long").alias(name)
    return by.agg(total("cycles", "cfg_num_cycles"), F.max("depth").alias("cfg_max_depth"), F.round(F.sum("edges") / F.sum("nodes"), 2).alias("cfg_avg_branching_factor"),
                  total("complex", "cfg_num_complex_loops"), total("exits", "cfg_num_exit_points"), total("dominators", "cfg_dominators_count"))


@plan("dominance_frontiers", f"WITH RECURSIVE {FLOW_SQL}, {AROUND_SQL} SELECT contract, function, node, frontier FROM front")
def dominance_frontiers(spark, sf_dir):
    """Each node's dominance frontier."""
    _, edges, entries = flow(spark, sf_dir)
    return graph.dominance(edges, entries, FLOW)[1]


NAME = "concat('f', turn - turn % 2 * (length(text) % 2))"  # some messages share a name, as overloads do
CALLEE = "CASE WHEN size % 7 = 0 THEN function - 2 ELSE function + size % 4 END"  # of a line of 5, 10, ... characters
CALL_SQL = f"""{LINES_SQL}, m AS (SELECT conv_id AS contract, turn, role, {NAME} AS node FROM conversations WHERE text IS NOT NULL), nodes AS (SELECT DISTINCT contract, node FROM m),
      e0 AS (SELECT l.contract, x.node AS src, y.node AS dst FROM (SELECT contract, function, {CALLEE} AS callee FROM lines WHERE size % 5 = 0) l JOIN m x ON x.contract = l.contract AND x.turn = l.function JOIN m y ON y.contract = l.contract AND y.turn = l.callee), e AS (SELECT DISTINCT * FROM e0)"""
SCC_SQL = """comp AS (SELECT n.contract, n.node, coalesce(max(x.b), n.node) AS component FROM nodes n LEFT JOIN (SELECT f.contract, f.a, f.b FROM clos f JOIN clos g ON f.contract = g.contract AND f.a = g.b AND f.b = g.a) x ON x.contract = n.contract AND x.a = n.node GROUP BY n.contract, n.node),
      cyclic AS (SELECT DISTINCT contract, a AS node FROM clos WHERE a = b)"""


def calls(spark, sf_dir):
    """Function names (overloads fall together), calls of other messages' functions by lines, and the public functions."""
    m = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(c("conv_id").alias("contract"), "turn", "role", F.expr(NAME).alias("node"))
    called = lines(spark, sf_dir).where("size % 5 = 0").select("contract", c("function").alias("turn"), F.expr(CALLEE).alias("callee"))
    end = lambda turn, name: m.select("contract", c("turn").alias(turn), c("node").alias(name))
    edges = called.join(end("turn", "src"), ["contract", "turn"]).join(end("callee", "dst"), ["contract", "callee"]).select("contract", "src", "dst")
    return m.select("contract", "node").distinct(), edges, m.where("role = 'user'").select("contract", c("node").alias("root")).distinct()


@plan("call_graph_components", f"""
    WITH RECURSIVE {CALL_SQL}, clos AS (SELECT contract, src AS a, dst AS b FROM e UNION SELECT c.contract, c.a, e.dst FROM clos c JOIN e ON c.contract = e.contract AND c.b = e.src), {SCC_SQL}
    SELECT comp.contract, comp.node, component, count(*) OVER (PARTITION BY comp.contract, component) AS size, cyclic.node IS NOT NULL AS cyclic FROM comp LEFT JOIN cyclic ON cyclic.contract = comp.contract AND cyclic.node = comp.node""")  # fmt: skip
def call_graph_components(spark, sf_dir):
    """Each function's strong component, named by its largest member."""
    nodes, edges, _ = calls(spark, sf_dir)
    return graph.components(nodes, edges, CALLS)


@plan("call_graph_measures", f"""
    WITH RECURSIVE {CALL_SQL}, {_cycles(CALLS)}, {SCC_SQL},
      root AS (SELECT DISTINCT contract, node AS root FROM m WHERE role = 'user'), size AS (SELECT contract, count(*) AS n FROM nodes GROUP BY contract),
      walk AS (SELECT contract, root, root AS node, 0 AS d FROM root UNION SELECT w.contract, w.root, e.dst, w.d + 1 FROM walk w JOIN e ON w.contract = e.contract AND w.node = e.src JOIN size ON size.contract = w.contract WHERE w.d < size.n),
      depth AS (SELECT contract, max(d) AS depth FROM (SELECT contract, root, node, min(d) AS d FROM walk GROUP BY ALL) GROUP BY contract),
      plain AS (SELECT contract FROM nodes EXCEPT SELECT contract FROM cyclic), long AS (SELECT contract, node, 0 AS d FROM nodes WHERE contract IN (SELECT contract FROM plain) UNION SELECT l.contract, e.dst, l.d + 1 FROM long l JOIN e ON l.contract = e.contract AND l.node = e.src),
      deg AS (SELECT n.contract, n.node, (SELECT count(*) FROM e WHERE e.contract = n.contract AND e.src = n.node) AS o, (SELECT count(*) FROM e WHERE e.contract = n.contract AND e.dst = n.node) AS i FROM nodes n)
    SELECT d.contract, d.functions, coalesce(calls, 0) AS calls, coalesce(depth, 0) AS depth, coalesce(cycles, 0) AS cycles, d.leaves, d.fan_out, d.fan_in, k.components, coalesce(longest, 0) AS longest, d.critical
    FROM (SELECT contract, count(*) AS functions, count(*) FILTER (WHERE o = 0) AS leaves, max(o) AS fan_out, max(i) AS fan_in, count(*) FILTER (WHERE i >= 3) AS critical FROM deg GROUP BY contract) d
      LEFT JOIN (SELECT contract, count(*) AS calls FROM e0 GROUP BY contract) USING (contract) LEFT JOIN depth USING (contract) LEFT JOIN cyc USING (contract)
      LEFT JOIN (SELECT contract, count(DISTINCT component) AS components FROM comp GROUP BY contract) k USING (contract) LEFT JOIN (SELECT contract, max(d) AS longest FROM long GROUP BY contract) USING (contract)""")  # fmt: skip
def call_graph_measures(spark, sf_dir):
    """Call-graph measures of each contract: depth from public functions, cycles, strong components, longest path, fans, critical functions."""
    return graph.call_measures(*calls(spark, sf_dir), CALLS)


@plan("taint_flow", f"""
    WITH RECURSIVE {LINES_SQL}, fun AS (SELECT conv_id AS contract, turn AS function, CASE WHEN role = 'user' THEN [turn % 4, 7 + turn % 3] ELSE [turn % 6] END AS params FROM conversations WHERE NOT ({' OR '.join(FUNCTION.values())})),
      ops AS (SELECT contract, function, line AS pos, {', '.join(f'{v} AS {k}' for k, v in OPERATION.items())}, [size % 5, (size + 3) % 11] AS reads FROM lines SEMI JOIN fun USING (contract, function)),
      t AS (SELECT contract, unnest(params)::BIGINT AS v, function::BIGINT AS f, -1::BIGINT AS p FROM fun UNION SELECT t.contract, o.lvalue, o.function, o.pos FROM t JOIN ops o ON o.contract = t.contract AND o.op = 'Assignment' AND o.rvalue = t.v AND o.lvalue IS NOT NULL AND (o.function > t.f OR (o.function = t.f AND o.pos > t.p))),
      first AS (SELECT contract, v, min({{'f': f, 'p': p}}) AS since FROM t GROUP BY ALL),
      hits AS (SELECT DISTINCT o.contract, o.function, o.pos FROM ops o JOIN first ON first.contract = o.contract AND list_contains(o.reads, first.v) WHERE op = 'LowLevelCall' AND contains(lower(o.name), 'delegatecall') AND (o.function > since.f OR (o.function = since.f AND o.pos > since.p)))
    SELECT d.contract, coalesce(sources, 0) AS sources, coalesce(operations, 0) AS operations, coalesce(tainted, 0) AS tainted, coalesce(tainted_delegatecall, 0) AS tainted_delegatecall, CASE WHEN operations > 0 THEN round(coalesce(tainted, 0) / operations::DOUBLE, 3) ELSE 0.0 END AS propagation_ratio
    FROM (SELECT DISTINCT conv_id AS contract FROM conversations) d LEFT JOIN (SELECT contract, sum(len(params))::BIGINT AS sources FROM fun GROUP BY contract) USING (contract) LEFT JOIN (SELECT contract, count(*) AS operations FROM ops GROUP BY contract) USING (contract)
      LEFT JOIN (SELECT contract, count(*) AS tainted FROM first GROUP BY contract) USING (contract) LEFT JOIN (SELECT contract, count(*) AS tainted_delegatecall FROM hits GROUP BY contract) USING (contract)""")  # fmt: skip
def taint_flow(spark, sf_dir):
    """Taint from parameters through assignments, function by function, in the functions that change state."""
    m = table(spark, sf_dir, "conversations")
    params = F.when(c("role") == "user", F.array(c("turn") % 4, 7 + c("turn") % 3)).otherwise(F.array(c("turn") % 6)).cast("array<long>")
    functions = m.select(c("conv_id").alias("contract"), c("turn").alias("function"), params.alias("params"), *[F.expr(v).alias(k) for k, v in FUNCTION.items()])
    operations = lines(spark, sf_dir).select("contract", "function", c("line").alias("pos"), *[F.expr(v).alias(k) for k, v in OPERATION.items()], F.array(c("size") % 5, (c("size") + 3) % 11).cast("array<long>").alias("reads"))
    operations = operations.withColumns({x: c(x).cast("long") for x in ("rvalue", "lvalue")})
    return taint.taint(functions, operations, "contract")


QUERIES, ORACLE_SQL = plan.queries, plan.oracle_sql
