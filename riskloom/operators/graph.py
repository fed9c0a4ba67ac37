"""Graph measures over many graphs at once: degrees, depths, components, cycles, paths and dominance as joins over (key, node).

A graph is the rows of one key (a function, a contract): nodes as (key..., node), edges as (key..., src, dst).
Rounds go on until nothing changes, so there is no bound on depth, and no graph is handed to one call as
a whole (`measures`, for small graphs, is the older form). Edges that stand twice count once; edges between
nodes that aren't listed are an error of the caller's. Edges are stored once, not worked out again in each round.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.rounds import dealt, facts, kept, settled


def degrees(edges: DataFrame, key: list[str]) -> DataFrame:
    """node, out_degree, in_degree of (key..., src, dst) rows; a node of any edge has a row."""
    out = edges.groupBy(*key, F.col("src").alias("node")).agg(F.count("*").alias("out_degree"), F.lit(0).cast("long").alias("in_degree"))
    into = edges.groupBy(*key, F.col("dst").alias("node")).agg(F.lit(0).cast("long").alias("out_degree"), F.count("*").alias("in_degree"))
    return out.unionByName(into).groupBy(*key, "node").agg(F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree"))


def depths(edges: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """node, depth: fewest steps from a root, up to `most` rounds of one join each."""
    seen = roots.select("node", F.lit(0).alias("depth"))
    for d in range(1, most + 1):
        reached = seen.where(F.col("depth") == d - 1).join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(d).alias("depth"))
        seen = seen.unionByName(reached).groupBy("node").agg(F.min("depth").alias("depth"))
    return seen


MEASURES = "nodes int, edges int, cycles int, components int, longest int, depth int, exits int, frontier int"


def measure(edges: set[tuple], entry, limit: int = 10_000) -> dict:
    """Simple cycles (null above `limit`: there can be more than anything can list), strong components, longest path (0 if cyclic), depth from
    the entry, exits, and nodes with a dominance frontier, of one small graph."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    nodes = sorted(after)
    rank = {n: i for i, n in enumerate(nodes)}
    cycles = 0
    for start in nodes:  # every simple cycle once, from its smallest node
        todo = [(start, frozenset([start]))] if cycles <= limit else []
        while todo and cycles <= limit:
            n, path = todo.pop()
            for m in after[n]:
                if m == start:
                    cycles += 1
                elif m not in path and rank[m] > rank[start]:
                    todo.append((m, path | {m}))
    reach = {n: _reach(after, n) for n in nodes}
    components = len({frozenset([n, *[m for m in reach[n] if n in reach[m]]]) for n in nodes})
    longest = 0
    if not any(n in reach[n] for n in nodes):
        length: dict = {}
        for n in sorted(nodes, key=lambda x: len(reach[x])):
            length[n] = max([length[m] + 1 for m in after[n]], default=0)
        longest = max(length.values(), default=0)
    level, depth, layer = {entry}, 0, {entry} if entry in after else set()
    while layer:
        layer = {m for n in layer for m in after[n]} - level
        depth += bool(layer)
        level |= layer
    live = {entry} | reach.get(entry, set())
    dominators = {n: set(live) for n in live}
    dominators[entry] = {entry}
    before = {n: [a for a in live if n in after.get(a, ())] for n in live}
    changed = entry in after
    while changed:
        changed = False
        for n in live - {entry}:
            new = {n} | set.intersection(*[dominators[p] for p in before[n]]) if before[n] else {n}
            changed |= new != dominators[n]
            dominators[n] = new
    frontier = sum(any(d in dominators[p] and (d not in dominators[n] or d == n) for n in live for p in before[n]) for d in live) if entry in after else 0
    return {"nodes": len(nodes), "edges": len(edges), "cycles": cycles if cycles <= limit else None, "components": components, "longest": longest, "depth": depth, "exits": sum(not after[n] for n in nodes), "frontier": frontier}


def _reach(after: dict, start) -> set:
    seen, todo = set(), [start]
    while todo:
        for m in after[todo.pop()]:
            if m not in seen:
                seen.add(m)
                todo.append(m)
    return seen


def measures(edges: DataFrame, key: str, entry: str) -> DataFrame:
    """One row of measures for each graph; a graph is one function or contract, small by nature."""
    kind = dict(edges.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = set(zip(pdf["src"], pdf["dst"], strict=True))
        return pd.DataFrame([{key: pdf[key].iloc[0], **measure(own, pdf[entry].iloc[0])}])

    return edges.select(key, "src", "dst", entry).distinct().groupBy(key).applyInPandas(run, f"{key} {kind}, {MEASURES}")


def along(edges: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """`rows` (key, node, ...) with `next`: where each edge from the node leads."""
    return rows.join(edges.select(*key, F.col("src").alias("node"), F.col("dst").alias("next")), [*key, "node"])


def reached(edges: DataFrame, starts: DataFrame, key: list[str]) -> DataFrame:
    """key, root, node, round: the fewest steps to each node from each root in `starts` (key, root)."""
    first = starts.select(*key, "root", F.col("root").alias("node"))
    return facts(first, lambda new: along(edges, new, key).select(*key, "root", F.col("next").alias("node")))


def components(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """key, node, component (the largest node of the strong component), size, cyclic.

    In each pass nodes get two colours: the largest node that reaches them and the largest that they reach. Nodes of a component share
    both, and where both are equal the component is that node's. The rest goes on in groups of equal colours, edges between groups left out;
    the largest node of a group finds its component, so every pass ends some.
    """
    left, own = nodes.select(*key, "node").distinct(), kept(edges.where("src != dst").select(*key, "src", "dst").distinct(), "edges")
    done = None
    while True:
        state = left.select(*key, "node", F.col("node").alias("f"), F.col("node").alias("b"))
        links = own.select(*key, F.col("src").alias("node"), F.col("dst").alias("next"), F.lit(True).alias("forth")).unionByName(own.select(*key, F.col("dst").alias("node"), F.col("src").alias("next"), F.lit(False).alias("forth")))

        def pass_on(now: DataFrame, links=links) -> DataFrame:
            told = dealt(now).join(links, [*key, "node"]).select(*key, F.col("next").alias("node"), F.when(F.col("forth"), F.col("f")).alias("f"), F.when(~F.col("forth"), F.col("b")).alias("b"), F.lit(None).alias("f0"), F.lit(None).alias("b0"))
            most = now.select("*", F.col("f").alias("f0"), F.col("b").alias("b0")).unionByName(told).groupBy(*key, "node").agg(*[F.max(c).alias(c) for c in ("f", "b", "f0", "b0")])
            return most.withColumn("_changed", (F.col("f") != F.col("f0")) | (F.col("b") != F.col("b0")))

        coloured = settled(state, pass_on)
        found = coloured.where("f = b").select(*key, "node", F.col("f").alias("component"))
        done = found if done is None else done.unionByName(found)
        rest = coloured.where("f != b")
        if rest.isEmpty():
            break
        colour = lambda end: rest.select(*key, F.col("node").alias(end), F.col("f").alias(f"f_{end}"), F.col("b").alias(f"b_{end}"))  # noqa: E731, B023
        inside = own.join(dealt(colour("src")), [*key, "src"]).join(dealt(colour("dst")), [*key, "dst"]).where("f_src = f_dst AND b_src = b_dst")
        left, own = rest.select(*key, "node"), kept(inside.select(*key, "src", "dst"), "edges")
    done = kept(done, "components")
    sizes = done.groupBy(*key, "component").agg(F.count("*").alias("size"))
    loops = edges.where("src = dst").select(*key, F.col("src").alias("node")).distinct().withColumn("_loop", F.lit(True))
    both = done.join(dealt(sizes), [*key, "component"]).join(dealt(loops), [*key, "node"], "left")
    return both.select(*key, "node", "component", "size", ((F.col("size") > 1) | F.coalesce("_loop", F.lit(False))).alias("cyclic"))


def longest_paths(nodes: DataFrame, edges: DataFrame, parts: DataFrame, key: list[str]) -> DataFrame:
    """key, longest: edges of the longest path of each graph, 0 for graphs with a cycle. `parts`: its `components`."""
    plain = parts.groupBy(*key).agg(F.max(F.col("cyclic").cast("int")).alias("c")).where("c = 0").select(*key)
    own = kept(edges.select(*key, "src", "dst").distinct().join(dealt(plain), key, "left_semi"), "acyclic")

    def longer(now: DataFrame) -> DataFrame:
        more = along(own, dealt(now), key).select(*key, F.col("next").alias("node"), (F.col("d") + 1).alias("d"), F.lit(None).cast("int").alias("d0"))
        most = now.withColumn("d0", F.col("d")).unionByName(more).groupBy(*key, "node").agg(F.max("d").alias("d"), F.max("d0").alias("d0"))
        return most.withColumn("_changed", F.col("d") != F.col("d0"))

    start = nodes.select(*key, "node").distinct().join(dealt(plain), key, "left_semi").withColumn("d", F.lit(0))
    found = settled(start, longer).groupBy(*key).agg(F.max("d").alias("longest"))
    return nodes.select(*key).distinct().join(dealt(found), key, "left").select(*key, F.coalesce("longest", F.lit(0)).alias("longest"))


def simple_cycles(edges: DataFrame, parts: DataFrame, key: list[str]) -> DataFrame:
    """key, cycles: how many simple cycles each graph with any has, each found once, from its smallest node.

    Paths grow by a join a round, inside a strong component only. There can be exponentially many in one component: they are rows of
    their own, spread over the cluster, and all are counted.
    """
    colour = lambda end: parts.where("cyclic").select(*key, F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    own = kept(edges.select(*key, "src", "dst").distinct().join(dealt(colour("src")), [*key, "src"]).join(dealt(colour("dst")), [*key, "dst"]).where("c_src = c_dst").select(*key, "src", "dst"), "inside")

    def grow(new: DataFrame) -> DataFrame:
        on = along(own, new.where("NOT closed"), key).where("next >= start")
        closed = F.col("next") == F.col("start")
        return on.where(closed | ~F.array_contains("path", F.col("next"))).select(*key, "start", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), closed.alias("closed"))

    first = own.select(*key, F.col("src").alias("start"), F.col("src").alias("node"), F.array("src").alias("path"), F.lit(False).alias("closed"))
    return facts(first, grow, once=True).where("closed").groupBy(*key).agg(F.count("*").alias("cycles"))


def dominance(edges: DataFrame, entries: DataFrame, key: list[str], live: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, dominator, node) and (key, node, frontier) of the nodes that the entry in `entries` (key, root) reaches.

    d dominates n if no path from the entry to n leaves d out; so the facts are (left out, node), each derived once, and what isn't one is
    a pair of dominance: as many as a function has nodes, squared, dealt over tasks. The frontier of n: nodes that n doesn't strictly
    dominate, with an edge from a node that n dominates. `live`: what is `reached`, if it is there already.
    """
    own = kept(edges.select(*key, "src", "dst").distinct(), "edges")
    live = kept((reached(own, entries, key) if live is None else live).select(*key, "root", "node"), "live")
    start = live.where("node != root").select(*key, F.col("node").alias("gone"), F.col("root").alias("node"))
    around = facts(start, lambda new: along(own, new, key).where("next != gone").select(*key, "gone", F.col("next").alias("node"))).drop("round")
    pairs = live.select(*key, F.col("node").alias("gone")).join(dealt(live.select(*key, "node")), key)
    over = kept(pairs.join(dealt(around), [*key, "gone", "node"], "left_anti").select(*key, F.col("gone").alias("dominator"), "node"), "dominance")
    onward = over.join(dealt(own.select(*key, F.col("src").alias("node"), F.col("dst").alias("frontier"))), [*key, "node"]).select(*key, F.col("dominator").alias("node"), "frontier").distinct()
    strict = over.where("dominator != node").select(*key, F.col("dominator").alias("node"), F.col("node").alias("frontier"))
    return over, onward.join(dealt(strict), [*key, "node", "frontier"], "left_anti")


def flow_measures(nodes: DataFrame, edges: DataFrame, entries: DataFrame, key: list[str], frontiers: bool = True) -> DataFrame:
    """A row for each control-flow graph: nodes, edges (all), cycles, complex (over one cycle), depth, exits, dominators (nodes reached, each
    with its dominators), frontiers (nodes with a frontier), frontier_pairs; the last two only if asked for. `nodes` has `exit`, whether the node leaves the function."""
    listed = nodes.groupBy(*key).agg(F.count("*").alias("nodes"), F.count_if("exit").alias("exits"))
    ones = kept(edges.select(*key, "src", "dst").distinct(), "edges")
    parts = kept(components(nodes, ones, key), "parts")
    live = reached(ones, entries, key)
    parted = [edges.groupBy(*key).agg(F.count("*").alias("edges")), simple_cycles(ones, parts, key), live.groupBy(*key).agg(F.max("round").alias("depth"), F.count("*").alias("dominators"))]
    last = ["frontiers", "frontier_pairs"] if frontiers else []
    if frontiers:
        _, frontier = dominance(ones, entries, key, live)
        parted.append(frontier.groupBy(*key).agg(F.countDistinct("node").alias("frontiers"), F.count("*").alias("frontier_pairs")))
    out = listed
    for more in parted:
        out = out.join(dealt(more), key, "left")
    out = out.na.fill(0, ["edges", "cycles", "depth", "dominators", *last])
    return out.select(*key, "nodes", "edges", "cycles", (F.col("cycles") > 1).cast("int").alias("complex"), "depth", "exits", "dominators", *last)


def call_measures(nodes: DataFrame, edges: DataFrame, roots: DataFrame, key: list[str], many: int = 3) -> DataFrame:
    """A row for each call graph: functions, calls (all), depth from any of `roots` (key, root), cycles, leaves, fan_out, fan_in, components,
    longest path (0 with a cycle), critical (functions with `many` callers or more)."""
    every, ones = kept(nodes.select(*key, "node").distinct(), "nodes"), kept(edges.select(*key, "src", "dst").distinct(), "edges")
    parts = kept(components(every, ones, key), "parts")
    by = every.join(dealt(degrees(ones, key)), [*key, "node"], "left").na.fill(0, ["out_degree", "in_degree"]).groupBy(*key).agg(
        F.count("*").alias("functions"), F.count_if(F.col("out_degree") == 0).alias("leaves"), F.max("out_degree").alias("fan_out"), F.max("in_degree").alias("fan_in"), F.count_if(F.col("in_degree") >= many).alias("critical"))
    joined = (
        edges.groupBy(*key).agg(F.count("*").alias("calls")), reached(ones, roots, key).groupBy(*key).agg(F.max("round").alias("depth")), simple_cycles(ones, parts, key),
        parts.groupBy(*key).agg(F.countDistinct("component").alias("components")), longest_paths(every, ones, parts, key),
    )
    for more in joined:
        by = by.join(dealt(more), key, "left")
    return by.na.fill(0, ["calls", "depth", "cycles"]).select(*key, "functions", "calls", "depth", "cycles", "leaves", "fan_out", "fan_in", "components", "longest", "critical")
