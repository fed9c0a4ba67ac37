"""Graph measures, dominance and taint over many small random graphs against brute force."""

import random
from collections import Counter, defaultdict

import pytest

from riskloom.operators import graph, rounds, taint
from riskloom.operators.graph import measure
from riskloom.operators.rounds import facts, settled

KEY = ["g"]


def graphs(many, seed):
    rng = random.Random(seed)
    for g in range(many):
        n = rng.randrange(1, 8)
        yield g, n, [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 2 * n))]


@pytest.fixture(scope="module")
def random_graphs(spark):
    every = list(graphs(60, 11))
    every.append((60, 12, [(i, (i + 1) % 12) for i in range(12)]))  # one long cycle
    every.append((61, 15, [(i, i + 1) for i in range(14)]))  # one long path
    every.append((62, 9, [(0, i) for i in range(1, 9)] + [(i, 0) for i in range(1, 9)]))  # a hub
    nodes = spark.createDataFrame([(g, i, i % 3 == 1) for g, n, _ in every for i in range(n)], "g int, node int, exit boolean")
    edges = spark.createDataFrame([(g, a, b) for g, _, es in every for a, b in es], "g int, src int, dst int")
    return every, nodes, edges


def reach(es, start, without=None):
    seen, todo = {start}, [start]
    while todo:
        a = todo.pop()
        for x, y in es:
            if x == a and y not in seen and y != without:
                seen.add(y)
                todo.append(y)
    return seen


def distances(es, start):
    d, layer = {start: 0}, [start]
    while layer:
        layer = list({y for x, y in es if x in layer and y not in d})
        d |= {y: max(d.values()) + 1 for y in layer}
    return d


def cycles(es):
    after, n = defaultdict(set), 0
    for a, b in es:
        after[a].add(b)

    def walk(start, at, path):
        nonlocal n
        for b in after[at]:
            if b == start:
                n += 1
            elif b > start and b not in path:
                walk(start, b, path | {b})

    for s in list(after):
        walk(s, s, {s})
    return n


def longest(n, es):
    if cycles(es):
        return 0
    best = [0] * n
    for _ in range(n):
        for a, b in es:
            best[b] = max(best[b], best[a] + 1)
    return max(best)


def test_components(spark, random_graphs):
    every, nodes, edges = random_graphs
    got = {(r.g, r.node): (r.component, r.size, r.cyclic) for r in graph.components(nodes, edges, KEY).collect()}
    for g, n, es in every:
        for i in range(n):
            own = {j for j in range(n) if j in reach(es, i) and i in reach(es, j)}
            assert got[g, i] == (max(own), len(own), len(own) > 1 or (i, i) in es)
    assert len(got) == sum(n for _, n, _ in every)


def test_flow_measures(spark, random_graphs):
    every, nodes, edges = random_graphs
    entries = nodes.where("node = 0").selectExpr("g", "node AS root")
    got = {r.g: r for r in graph.flow_measures(nodes, edges, entries, KEY).collect()}
    over, _ = graph.dominance(edges, entries, KEY)
    dominators = {(r.g, r.dominator, r.node) for r in over.collect()}
    want = set()
    for g, n, es in every:
        r, live = got[g], reach(es, 0)
        assert (r.nodes, r.edges, r.exits, r.cycles, r.complex) == (n, len(es), sum(i % 3 == 1 for i in range(n)), cycles(es), int(cycles(es) > 1))
        assert r.depth == max(distances(es, 0).values()) and r.dominators == len(live)
        dom = {(d, x) for d in live for x in live if d == x or d == 0 or x not in reach(es, 0, without=d)}
        want |= {(g, *p) for p in dom}
        front = {(d, w) for d, p in dom for a, w in es if a == p and not ((d, w) in dom and d != w)}
        assert r.frontier_pairs == len(front) and r.frontiers == len({d for d, _ in front})
    assert dominators == want


def test_call_measures(spark, random_graphs):
    every, nodes, edges = random_graphs
    got = {r.g: r for r in graph.call_measures(nodes, edges, nodes.where("node % 2 = 0").selectExpr("g", "node AS root"), KEY).collect()}
    for g, n, es in every:
        ones, r = set(es), got[g]
        fan_out, fan_in = Counter(a for a, _ in ones), Counter(b for _, b in ones)
        parts = {max(j for j in range(n) if j in reach(es, i) and i in reach(es, j)) for i in range(n)}
        assert (r.functions, r.calls, r.cycles, r.components, r.longest) == (n, len(es), cycles(es), len(parts), longest(n, es))
        assert r.depth == max(max(distances(es, i).values()) for i in range(0, n, 2))
        assert (r.leaves, r.fan_out, r.fan_in, r.critical) == (sum(i not in fan_out for i in range(n)), max(fan_out.values(), default=0), max(fan_in.values(), default=0), sum(v >= 3 for v in fan_in.values()))


def test_the_older_measures_agree(spark, random_graphs):
    every, nodes, edges = random_graphs
    for g, n, es in every[:30]:
        if es and any(0 in e for e in es):
            m = measure(set(es), 0)
            listed = {x for e in es for x in e}
            assert m["cycles"] == cycles(es) and m["nodes"] == len(listed)


def test_graphs_without_edges(spark):
    nodes = spark.createDataFrame([(1, 0, True), (2, 5, False)], "g int, node int, exit boolean")
    edges = spark.createDataFrame([], "g int, src int, dst int")
    rows = {r.g: r for r in graph.flow_measures(nodes, edges, nodes.selectExpr("g", "node AS root"), KEY).collect()}
    assert rows[1].dominators == 1 and rows[2].exits == 0 and rows[1].frontier_pairs == 0
    assert graph.call_measures(nodes.where("false"), edges, nodes.where("false").selectExpr("g", "node AS root"), KEY).collect() == []


def fold(functions, operations):
    """The rule as one walk in order."""
    tainted, sources, n, hits = set(), 0, 0, 0
    for f, params, skip in functions:
        if skip:
            continue
        tainted |= set(params or [])
        sources += len(params or [])
        for _, op, name, reads, r, l in sorted(operations.get(f, []), key=lambda x: x[0]):
            n += 1
            if op == "LowLevelCall" and "delegatecall" in (name or "").lower() and tainted & set(reads):
                hits += 1
            if op == "Assignment" and r is not None and l is not None and r in tainted:
                tainted.add(l)
    return sources, n, len(tainted), hits, round(len(tainted) / n + 1e-12, 3) if n else 0.0


def test_taint_by_a_walk(spark):
    rng = random.Random(7)
    functions, operations, want = [], [], {}
    for k in range(40):
        fs = [(f, [rng.randrange(12) for _ in range(rng.randrange(3))] if rng.random() < 0.8 else None, rng.choice([None, None, "is_view", "is_pure", "is_constructor"])) for f in range(rng.randrange(1, 6))]
        ops = {f: [(p, rng.choice(["Assignment", "Assignment", "LowLevelCall", "Send"]), rng.choice(["x.delegateCall", "call", None]), [rng.randrange(12) for _ in range(rng.randrange(3))], rng.choice([None, *range(12)]), rng.choice([None, *range(12)])) for p in range(rng.randrange(9))] for f, _, _ in fs}
        want[k] = fold(fs, ops)
        functions += [(k, f, p, s == "is_constructor" if s else None, s == "is_view", s == "is_pure" or None) for f, p, s in fs]
        operations += [(k, f, *o) for f, os in ops.items() for o in os]
    rng.shuffle(operations)
    f = spark.createDataFrame(functions, "contract int, function int, params array<int>, is_constructor boolean, is_view boolean, is_pure boolean")
    o = spark.createDataFrame(operations, "contract int, function int, pos int, op string, name string, reads array<int>, rvalue int, lvalue int").repartition(5)
    got = {r.contract: tuple(r)[1:] for r in taint.taint(f, o, "contract").collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:4] == want[k][:4] and got[k][4] == pytest.approx(want[k][4], abs=1.1e-3)


def test_rounds(spark):
    """Facts come once, in their first round; a state settles."""
    steps = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 9)], "a int, b int")
    start = spark.createDataFrame([(1,), (1,), (None,)], "n int")
    got = facts(start, lambda new: new.join(steps, new.n.eqNullSafe(steps.a)).selectExpr("b AS n"))
    assert sorted((r.n or 0, r.round) for r in got.collect()) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (9, 1)]
    down = settled(start.na.fill(7).distinct(), lambda now: now.selectExpr("greatest(n - 2, 0) AS n", "n > 0 AS _changed"))
    assert {r.n for r in down.collect()} == {0}


def test_rounds_send_no_tables_to_the_driver(spark, random_graphs):
    """Plans of the rounds' joins broadcast nothing that grows, however small its files; a round with few facts may be broadcast."""
    nodes, edges = (df.where("g < 6") for df in random_graphs[1:])
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    entries = nodes.where("node = 0").selectExpr("g", "node AS root")
    _, front = graph.dominance(edges, entries, KEY)
    plans = [shown(front), shown(graph.components(nodes, edges, KEY))]
    assert not any("BroadcastExchange" in p for p in plans)
    seen = []

    def step(new):
        out = graph.along(edges, new, KEY).selectExpr("g", "next AS node")
        seen.append(shown(out))
        return out

    many = spark.range(rounds.FEW + 1).selectExpr("CAST(id AS INT) AS g", "0 AS node")
    facts(many, step)
    assert "BroadcastExchange" not in seen[0] and "BroadcastHashJoin" in seen[-1]


def test_flow_measures_without_frontiers(spark, random_graphs):
    nodes, edges = (df.where("g < 6") for df in random_graphs[1:])
    entries = nodes.where("node = 0").selectExpr("g", "node AS root")
    short, whole = graph.flow_measures(nodes, edges, entries, KEY, frontiers=False), graph.flow_measures(nodes, edges, entries, KEY)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, whole.select(short.columns).collect()))
    assert set(whole.columns) - set(short.columns) == {"frontiers", "frontier_pairs"}
