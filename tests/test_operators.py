"""Operators on small hand-made frames with known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import cleaning, text
from riskloom.operators import engineering, evaluation, graph, sequence, stats, windows
from riskloom.plans import extras as extras_plans
from riskloom.plans import learning as learning_plans
from riskloom.plans import registry
from riskloom.session import table
from riskloom.sources import files, sinks


def one(df, c="v"):
    return [r[c] for r in df.collect()]


def test_comment_lines(spark):
    t = "// a\nx = 1;\n/* b\n c */\n/* d */ y\n\ncode"
    d = spark.createDataFrame([(t,), ("",), (None,)], "t string")
    assert one(d.select(text.comment_lines(F.col("t")).alias("v"))) == [4, 0, None]
    assert one(d.select(text.lines_of_code(F.col("t")).alias("v")))[0] == 6


def test_error_categories(spark):
    """The codes and their order as the failure reasons define them."""
    d = spark.createDataFrame([("Source file requires different compiler version", None), ("ParserError: x", None), ('"a.sol" is not found', None), ("import of no such file", None), ("import x", "KeyError"), ("?", "KeyError"), ("unknown option", "KeyError"), ("?", "ValueError"), (None, None)], "t string, k string")
    got = one(d.select(text.error_category(F.col("t"), F.col("k")).alias("v")))
    assert got == ["VERSION_MISMATCH", "COMPILATION_ERROR", "FILE_NOT_FOUND", "FILE_NOT_FOUND", "IMPORT_ERROR", "ANALYSIS_ERROR", "SLITHER_INCOMPATIBLE", "UNKNOWN_ERROR", "UNKNOWN_ERROR"]


def test_finite(spark):
    d = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-float("inf"),), (2.5,)], "x double")
    assert one(d.select(cleaning.finite(F.col("x")).alias("v"))) == [0.0, 0.0, 999999.0, 999999.0, 2.5]


def test_call_write_rules(spark):
    rows = [("bad", 1, True, False), ("bad", 2, False, True), ("good", 1, False, True), ("good", 2, True, False), ("none", 1, False, False)]
    s = spark.createDataFrame(rows, "g string, pos int, c boolean, w boolean")
    got = {r.g: (r.violation, r.safe, r.unchecked) for r in sequence.call_write_rules(s, ["g"], "pos", F.col("c"), F.col("w")).collect()}
    assert got == {"bad": (1, 0, 1), "good": (0, 1, 0), "none": (0, 0, 0)}
    scores = spark.createDataFrame([(1, 0), (0, 1), (1, 1), (0, 0)], "s int, v int").select(sequence.cei_score(F.col("s"), F.col("v")).alias("v"))
    assert one(scores) == [1.0, 0.0, 0.5, 1.0]


def test_graph_measures():
    loop = graph.measure({("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")}, "a")
    assert (loop["cycles"], loop["components"], loop["longest"], loop["depth"], loop["exits"]) == (1, 2, 0, 3, 1)
    diamond = graph.measure({("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")}, "a")
    assert (diamond["cycles"], diamond["longest"], diamond["depth"], diamond["frontier"]) == (0, 2, 2, 2)
    assert graph.measure({(i, j) for i in range(8) for j in range(8) if i != j}, 0, limit=100)["cycles"] is None  # more than are listed


def test_depths(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "src long, dst long")
    assert {r.node: r.depth for r in graph.depths(e, spark.range(1).withColumnRenamed("id", "node"), 5).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}


def test_auc_and_ks(spark):
    d = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (None, 1)], "p double, y int")
    assert evaluation.auc(d, "p", "y").first()[0] == pytest.approx(0.875)
    same = spark.createDataFrame([(1.0, True), (2.0, True), (1.0, False), (2.0, False)], "v double, s boolean")
    assert evaluation.two_sample_ks(same, "v", F.col("s")).first()[0] == 0.0
    apart = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False)], "v double, s boolean")
    assert evaluation.two_sample_ks(apart, "v", F.col("s")).first()[0] == 1.0
    assert evaluation.auc(d.where("y = 1"), "p", "y").first()[0] is None


def test_anchored_windows(spark):
    rows = [("u", t) for t in (0, 10, 59, 60, 61, 200)]
    d = spark.createDataFrame(rows, "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    r = windows.anchored(d, ["k"], F.col("ts"), 60, 2).first()
    assert (r.n, r.over_limit, r.windows) == (6, 1, 3)
    h = windows.cache_hits(d, ["k"], F.col("ts"), 60).first()
    assert (h.hits, h.misses) == (3, 3)


def test_constant_column_correlation(spark):
    d = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert d.agg(stats.safe_corr(F.col("a"), F.col("b")).alias("v")).first()[0] is None
    assert stats.constant_columns(d, ["a", "b"]) == ["a"]


def test_scalers_fit_on_train_only(spark):
    d = spark.createDataFrame([(float(i),) for i in range(5)], "x double")
    fitted = engineering.fit_robust(d, ["x"])
    assert fitted == {"x": (2.0, 2.0)}
    assert one(engineering.scale(spark.createDataFrame([(6.0,)], "x double"), fitted), "x") == [2.0]
    assert engineering.fit_robust(d.where("x = 1"), ["x"])["x"] == (1.0, 1.0)


def test_upsert_and_new_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert {(r.k, r.v, r.action) for r in sinks.upsert(old, new, ["k"]).collect()} == {(1, "a", "kept"), (2, "B", "updated"), (3, "C", "inserted")}
    assert one(sinks.new_rows(old, new, ["k"]), "k") == [3]
    assert {tuple(r) for r in sinks.update(old, new, ["k"]).collect()} == {(1, "a"), (2, "B")}


def test_files(spark, tmp_path):
    (tmp_path / "src" / "skip").mkdir(parents=True)
    (tmp_path / "src" / "vault.sol").write_text("pragma solidity ^0.8.0;\ncontract Vault {}")
    (tmp_path / "src" / "skip" / "Other.sol").write_text("x")
    got = files.texts(spark, str(tmp_path / "src"), "*.sol", ["/skip/"]).collect()
    assert [r.name for r in got] == ["Vault"] and got[0].text.startswith("pragma")
    sinks.export(spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "out"), "csv")
    assert files.first_csv(spark, [str(tmp_path / "none.csv"), str(tmp_path / "out/data")], "k int, v string").collect()[0].v == "a"
    (tmp_path / "m.json").write_text('[{"protocol": "p", "contracts": [{"address": "0x' + "a" * 40 + '"}]}, {"name": "q", "addresses": ["0x1"]}]')
    assert {(r.protocol, r.valid) for r in files.curated(spark, str(tmp_path / "m.json")).collect()} == {("p", True), ("q", False)}
    assert files.config(spark, str(tmp_path / "no.json"), {"a": 1}) == {"a": 1}
    s = spark.createDataFrame([(1, '{{"sources": {"A.sol": {"content": "pragma x"}, "B.vy": {"content": "# @version pragma"}}}}'), (2, "pragma y")], "id int, source string")
    assert {(r.id, r.file) for r in files.unwrapped_sources(s).collect()} == {(1, "A.sol"), (2, "main")}


def test_smote_neighbours_of_the_whole_class(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 3))
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)] + [(900, 2, [0.0, 0.0, 0.0])], "id long, label int, v array<double>")
    got = {q.id: np.array(q.v) for q in engineering.smote(df, "v", "label", "id", 1, k=3, block=20).collect()}
    assert set(got) == set(range(300))
    for i, m in got.items():
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        # the new row lies on the line to one of the three nearest of all
        assert any(np.linalg.norm(m - x[i]) + np.linalg.norm(m - x[j]) < np.sqrt(d[j]) + 1e-9 for j in np.argsort(d)[:3])
    assert [q.v for q in engineering.smote(df, "v", "label", "id", 2).collect()] == [[0.0, 0.0, 0.0]]


def test_learning_queries_use_every_label_and_member(spark, sf_dir):
    labels = {q[0] for q in table(spark, sf_dir, "embeddings").groupBy("label").count().where("count >= 20").collect()}
    assert len(labels) > 3 and {q.label for q in learning_plans.one_versus_rest(spark, sf_dir).collect()} == labels
    assert {q.model for q in extras_plans.ensemble_weights(spark, sf_dir).collect()} == {"boosted", "forest", "logistic"}


def test_flags_by_hand(spark):
    """A detector under several flags counts for the last; findings that don't name the contract don't count."""
    from riskloom.operators import extraction as ex

    rows = [(1, "Vault", "divide-before-multiply", "medium", "in VAULT.run"), (1, "Vault", "weak-prng", "high", "Vault"), (1, "Vault", "low-level-calls", "informational", "vault x"), (1, "Vault", "tx-origin", "high", "Other"), (2, "Bank", "tx-origin", "low", "none")]
    df = spark.createDataFrame(rows, "contract long, name string, detector string, impact string, description string")
    got = {r.contract: r.asDict() for r in ex.flag_vector(df, "contract", F.col("name")).collect()}
    assert {k for k, v in got[1].items() if k.startswith("has_") and v} == {"has_divide_before_multiply", "has_weak_randomness", "has_low_level_calls"}
    assert (got[1]["high"], got[1]["medium"], got[1]["low"], got[1]["fired"]) == (1, 1, 1, 3) and sum(v for k, v in got[2].items() if k != "contract") == 0
    assert len(ex.FLAGS) == 23 and len(ex.cross_tier()) == 38


def test_taint_by_brute_force(spark, sf_dir):
    from riskloom.plans import extraction as plans
    from riskloom.plans.registry import queries

    want = {}
    for r in sorted(plans.relation(spark, sf_dir, "events", plans.OPERATIONS).collect(), key=lambda r: (r.contract, r.pos)):
        s = want.setdefault(r.contract, [0, {0, 1}, 0])
        s[0] += 1
        s[2] += r.op == "LowLevelCall" and r.arg in s[1] and "delegatecall" in r.name
        if r.op == "Assignment" and r.arg in s[1] and r.lvalue is not None:
            s[1].add(r.lvalue)
    got = {r.contract: (r.operations, r.tainted, r.tainted_delegatecall, r.ir_taint_propagation_ratio) for r in queries()["ir_taint"](spark, sf_dir).collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: (n, len(t), h) for k, (n, t, h) in want.items()}
    assert all(abs(v[3] - v[1] / v[0]) < 6e-4 for v in got.values()) and sum(v[2] for v in got.values()) > 0


def test_density_without_findings(spark):
    from riskloom.operators import extraction as ex

    names = "num_functions num_external_functions num_public_functions num_view_functions num_payable_functions total_state_reads total_state_writes num_external_calls lines_of_code has_reentrancy has_access_control has_arithmetic max_complexity avg_complexity has_assembly comment_ratio high medium low".split()
    df = spark.createDataFrame([tuple([0] * len(names))], ", ".join(f"{n} long" for n in names))
    r = df.select(ex.cross_tier(True)["vulnerability_density"].alias("a"), ex.cross_tier(False)["vulnerability_density"].alias("b")).first()
    assert (r.a, r.b) == (0.0, 1.0)


def test_exact_quantiles(spark):
    r = np.random.default_rng(4)
    cols = {"a": r.normal(size=1_001), "b": np.repeat([1.0, 2.0, 9.0], [500, 1, 500]), "c": np.full(1_001, 7.0), "d": r.lognormal(3, 2, 1_001)}
    df = spark.createDataFrame([tuple(float(v[i]) for v in cols.values()) for i in range(1_001)] + [(None,) * 4], "a double, b double, c double, d double")
    probs = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 1.0]
    got = {(q.feature, q.p): q.value for q in stats.quantiles(df, list(cols), probs, parts=8).collect()}
    assert got == pytest.approx({(c, p): float(np.quantile(v, p)) for c, v in cols.items() for p in probs})
    assert stats.quantiles(df.limit(0), ["a"], [0.5]).count() == 0


def test_mixup_partners(spark):
    """As many rows as the growth allows, each between two rows of any two partitions; shares are beta."""
    import numpy as np

    from riskloom.operators import engineering as fe

    n = 3_000
    df = spark.createDataFrame([(i, float(i % 2), float(i)) for i in range(n)], "id long, y double, x double").repartition(6)
    ranks = {r._k: r.x for r in fe.hash_ranks(df.withColumn("_all", F.lit(1)), "_all", "id", 42, ["y", "x"]).collect()}
    turn = 1 + int(np.random.default_rng(42).integers(n - 1))
    want = sorted((min(ranks[k], ranks[(k - 1 + turn) % n + 1]), max(ranks[k], ranks[(k - 1 + turn) % n + 1])) for k in range(1, n // 2 + 1))
    got = sorted(r.x for r in fe.mixup(df, ["x"], "y", "id").collect())
    assert len(got) == n // 2 and all(any(a - 1e-6 <= v <= b + 1e-6 for a, b in want) for v in got[:50])
    apart = [abs(ranks[k] - ranks[(k - 1 + turn) % n + 1]) for k in range(1, n // 2 + 1)]
    assert np.mean(apart) > n / 4  # a third of n for pairs from anywhere
    assert fe.mixup(df, ["x"], "y", "id", factor=1.1).count() == 300 and fe.mixup(df, ["x"], "y", "id", factor=1.0).count() == 0
    assert fe.mixup(df.limit(1), ["x"], "y", "id", share=1.0).count() == 0
    q = np.array(fe.beta_quantiles(0.2))
    rng = np.random.default_rng(1).beta(0.2, 0.2, 200_000)
    assert np.abs(np.quantile(rng, np.linspace(0.05, 0.95, 19)) - np.interp(np.linspace(0.05, 0.95, 19), np.linspace(0, 1, len(q)), q)).max() < 0.01
    y = np.array([r.y for r in fe.mixup(df, ["x"], "y", "id").collect()])
    assert ((y > 0) & (y < 1)).mean() > 0.3


def test_versions_in_order_too(spark, monkeypatch):
    """Carets, exact and open versions, bounds, none; the ordered pass gives the same."""
    from riskloom.operators import versions

    have = spark.createDataFrame([(0, 4, 11), (0, 4, 26), (0, 8, 0), (0, 8, 20), (1, 0, 0), (0, 8, 20)], "major int, minor int, patch int")
    asked = {"pragma solidity ^0.4.12;": "0.4.26", "pragma solidity 0.4;": "0.4.26", "pragma solidity 0.8.20;": "0.8.20", "pragma solidity 0.8.1;": None, "PRAGMA  solidity >=0.4.27;": "1.0.0", "x\npragma solidity >=0.4.12 <0.8.20; pragma solidity 0.4.11;": "0.8.0",
             "pragma solidity >=0.4.12 <0.4.13;": None, "": None, "no pragma": None, "pragma solidity ^0.9.0;": None, "pragma solidity >= 0.8 <0.9;": "0.8.20"}
    texts = spark.createDataFrame([(t, 1) for t in asked] + [(None, 1)], "s string, resolved_before int")
    for most in (100_000, 0):
        monkeypatch.setattr(versions, "MOST", most)
        got = {r.s: r.resolved for r in versions.resolve(texts, "s", have).collect()}
        assert got == {**asked, None: None}
    assert {r.resolved for r in versions.resolve(texts, "s", have.where("false")).collect()} == {None}


def test_anchored_windows_by_a_walk(spark):
    """Hot and rare keys, null keys, equal times, runs cut by batches."""
    rng = np.random.default_rng(9)
    rows = [(int(k) if k else None, int(t)) for k, t in zip(rng.choice([0, 1, 2, 3, 4], 3_000, p=[0.1, 0.6, 0.1, 0.1, 0.1]), rng.integers(0, 4_000, 3_000), strict=True)]
    df = spark.createDataFrame(rows, "k int, s int").withColumn("ts", F.timestamp_seconds("s")).withColumn("j", F.when(F.col("k") == 1, "x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for seconds, most in ((60, 3), (1, 0), (5_000, 2)):
            want = {}
            for k in {r[0] for r in rows}:
                opened, used, over, wins = None, 0, 0, 0
                times = sorted(t for x, t in rows if x == k)
                for t in times:
                    if opened is None or t - opened >= seconds:
                        opened, used, wins = t, 0, wins + 1
                    used += 1
                    over += used > most
                want[k] = (len(times), over, wins)
            assert {r.k: (r.n, r.over_limit, r.windows) for r in windows.anchored(df, ["k", "j"], F.col("ts"), seconds, most).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seconds,most", [(50, 3), (700, 2), (7, 0), (9_000, 5)])
def test_one_key_over_many_tasks(spark, seconds, most):
    """All events of one key, dense and regular or with gaps: as the walk has it, from runs in many tasks."""
    rng = np.random.default_rng(seconds)
    times = {1: np.arange(0, 4_000), 2: np.cumsum(rng.choice([1, 2, 90], 1_500, p=[0.6, 0.3, 0.1])), None: np.array([5, 5, 5])}
    df = spark.createDataFrame([(k, int(t)) for k, ts in times.items() for t in ts], "k int, s int").withColumn("ts", F.timestamp_seconds("s"))
    before = {x: spark.conf.get(x) for x in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: (r.n, r.over_limit, r.windows) for r in windows.anchored(df, ["k"], F.col("ts"), seconds, most).collect()}
    finally:
        for x, v in before.items():
            spark.conf.set(x, v)
    for k, ts in times.items():
        opened, used, over, wins = None, 0, 0, 0
        for t in sorted(ts):
            if opened is None or t - opened >= seconds:
                opened, used, wins = t, 0, wins + 1
            used += 1
            over += used > most
        assert got[k] == (len(ts), over, wins)


def test_tables_of_runs():
    """Any cut of a key's times into runs composes to the fold, in any nesting."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        times = np.sort(rng.integers(0, rng.choice([20, 200, 2_000]), rng.integers(2, 40)))
        span, most = int(rng.choice([1, 5, 30, 300])), int(rng.integers(0, 4))
        fold = windows.Anchor(span, most)
        fold.add(times)
        cuts = np.unique(np.searchsorted(times, rng.choice(times, rng.integers(1, 6))))
        parts = [p for p in np.split(times, cuts) if len(p)]
        tables = [windows.run_table(p, span, most, i == 0) | {"n": len(p), "first": p[0], "last": p[-1], "begins": i == 0} for i, p in enumerate(parts)]
        while len(tables) > 1:
            i = int(rng.integers(len(tables) - 1))
            tables[i : i + 2] = [windows.composed(tables[i], tables[i + 1], span, most)]
        t = tables[0]
        assert (t["n"], t["over"][0] + max(0, t["used"][0] - most), t["windows"][0]) == (fold.n, fold.over, fold.windows)


def test_quantiles_by_group(spark):
    """Medians of groups, one of them null, without an aggregate that holds a column's distinct values in one task."""
    rows = [(g, float(x)) for g, xs in ((None, [3, 1]), ("a", [5, 5, 1, 2]), ("b", range(300))) for x in xs] + [("c", None)]
    got = {r.g: r.value for r in stats.quantiles(spark.createDataFrame(rows, "g string, x double"), ["x"], [0.5], parts=8, by="g").collect()}
    assert got == {None: 2.0, "a": 3.5, "b": 149.5}
    for name in ("describe_lineitem", "group_agg_stats", "distribution_snapshot"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert " percentile(" not in plan and "(percentile(" not in plan
