"""Every query against its DuckDB SQL on the smallest tables; the rest must give rows."""

import math

import duckdb
import pytest

from riskloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# run by test_learning.py and test_models.py
SLOW = {"fold_areas", "prediction_intervals", "vote_contributions", "importance_comparison", "ensemble_metrics", "group_ablation", "feature_importances", "isotonic_calibration", "bootstrap_uncertainty", "one_versus_rest", "source_prediction", "ensemble_weights", "tuning_trials"} | {"adaptive_search", "search_summary", "optimised_weights", "tree_attribution", "fold_metrics", "holdout_correctness"}


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    r = duck.execute(registry.oracle_sql()[name])
    theirs = [d[0] for d in r.description]
    assert sorted(theirs) == names
    at = [theirs.index(n) for n in names]
    want = sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_gives_rows(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).take(1)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
