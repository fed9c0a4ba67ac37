"""Composite risk and confidence scores as column expressions over a feature frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col


def completeness(source: Column, semantic: Column, static: Column, graph: Column, cei_quality: Column) -> Column:
    """Weighted completeness of a record: a missing source or static part counts half."""
    part = lambda b: F.when(b, 1.0).otherwise(0.5)
    return 0.3 * part(source) + 0.3 * semantic + 0.2 * part(static) + 0.1 * graph + 0.1 * cei_quality


def cei_quality(score: Column, safe: Column, violations: Column, functions: Column, source: Column) -> Column:
    """Mean of the pattern score, the safe share and one less the violation share; 0 without a source."""
    q = (score + safe / F.greatest(functions, F.lit(1)) + (1 - violations / (violations + safe + 1))) / 3
    return F.when(source, q).otherwise(0.0)


# Quality level -> weights of the learned and the semantic score.
WEIGHTS = {"excellent": (0.6, 0.4), "good": (0.65, 0.35), "fair": (0.7, 0.3), "poor": (0.8, 0.2)}


def weights(level: Column) -> tuple[Column, Column]:
    """Both weights by level, one half each if the level isn't listed."""
    pick = lambda i: F.coalesce(F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.lit(w[i]))])[level], F.lit(0.5))
    return pick(0), pick(1)


def semantic_risk(violations: Column, score: Column, state_after: Column, unchecked: Column, guard: Column, calls: Column) -> Column:
    """With a source: capped shares of violations, low pattern score, late writes and unchecked calls; halved behind a guard."""
    cap = lambda x, n: F.least(x / n, F.lit(1.0))
    raw = 0.4 * cap(violations, 5) + F.when(score < 0.8, 0.2 * (1 - score)).otherwise(0.0) + 0.3 * cap(state_after, 3) + 0.2 * cap(unchecked, 2)
    return F.least(F.lit(1.0), F.when((guard == 1) & (calls > 0), raw * 0.5).otherwise(raw))


def semantic_risk_without_source(reentrancy: Column, unchecked: Column, calls: Column, delegate: Column, guard: Column) -> Column:
    raw = 0.4 * reentrancy + 0.3 * unchecked + F.least(calls / 10 * 0.2, F.lit(0.2)) + 0.1 * delegate
    return F.least(F.lit(0.5), F.when(guard == 1, raw * 0.5).otherwise(raw))


def reasons(violations: Column, score: Column, state_after: Column, unchecked: Column) -> Column:
    """Names of the parts that add to the semantic risk, in order."""
    return F.array_compact(F.array(F.when(violations > 0, "cei_violations"), F.when(score < 0.8, "low_cei_score"), F.when(state_after > 0, "state_after_call"), F.when(unchecked > 0, "unchecked_calls")))


def static_risk(reentrancy: Column, unchecked: Column, access: Column, calls: Column, high: Column, assembly: Column) -> Column:
    tenth = lambda x: F.least(x / 10, F.lit(1.0))
    return F.least(F.lit(1.0), 0.3 * reentrancy + 0.2 * unchecked + 0.2 * access + 0.1 * tenth(calls) + 0.1 * tenth(high) + 0.1 * assembly)


def contradiction(ml: Column, semantic: Column, reentrancy: Column, unchecked: Column, access: Column) -> Column:
    """Does the learned score disagree with the flags or the semantic score?"""
    return ((ml > 0.7) & (reentrancy + unchecked + access == 0)) | ((ml < 0.3) & (reentrancy + unchecked > 0)) | ((semantic > 0.7) & (ml < 0.3))


def confidence(ml: Column, semantic: Column, static: Column, quality: Column, against: Column) -> Column:
    """Calibrated confidence: boosts, then quality, then the contradiction penalty, clamped to [0.1, 1].

    Every step is linear in what comes in, then capped, so each reads the step before once.
    """
    strong, fair = (ml > 0.9) & (static > 0.7), (ml > 0.6) & (static > 0.5)
    x = F.least((ml + semantic) / 2 + F.when(strong, 0.4).when(fair, 0.25).otherwise(0.0), F.when(strong, 1.0).when(fair, 0.9).otherwise(float("inf")))
    lifted = (static > 0.7) & (ml > 0.4)
    x = F.least(x + F.when(lifted, 0.15).otherwise(0.0), F.when(lifted, 1.0).otherwise(float("inf")))
    x = F.least(x * F.when(quality > 0.8, 1.3).when(quality < 0.4, F.greatest(quality, F.lit(0.3))).otherwise(1.0), F.when(quality > 0.8, 1.0).otherwise(float("inf")))
    x = F.greatest(x - F.when(against, 0.2).otherwise(0.0), F.when(against, 0.2).otherwise(0.1))
    return F.least(F.lit(1.0), x)


def confidence_notes(ml: Column, static: Column, quality: Column, against: Column) -> Column:
    """What changed the confidence, in the order in which it did."""
    strong, fair = (ml > 0.9) & (static > 0.7), (ml > 0.6) & (static > 0.5)
    return F.array_compact(F.array(
        F.when(strong, "aligned_certainty").when(fair, "moderate_certainty"), F.when((static > 0.7) & (ml > 0.4), "static_signals"),
        F.when(quality > 0.8, "high_quality").when(quality < 0.4, "low_quality"), F.when(against, "contradiction"),
    ))


def routing_score(loc: Column, complexity: Column, external: Column, assembly: Column, delegate: Column) -> Column:
    """0 to 100: normalised size, complexity and calls, and ten points each for two risky features."""
    norm = lambda x, most: F.least(F.greatest(x, F.lit(0)), F.lit(most)) / F.lit(float(most)) * 100
    return 0.3 * norm(loc, 300) + 0.3 * norm(complexity, 20) + 0.2 * norm(external, 5) + F.least(10 * assembly + 10 * delegate, F.lit(20))


# Measure -> (above, points), the first that holds.
POINTS = {
    "num_functions": [(20, 30), (10, 20), (5, 10), (2, 5)],
    "max_complexity": [(20, 25), (15, 20), (10, 15), (5, 10)],
    "lines_of_code": [(1000, 20), (500, 15), (200, 10), (100, 5)],
    "num_state_vars": [(20, 15), (15, 12), (10, 10), (5, 5)],
    "num_external_calls": [(15, 10), (10, 7), (5, 5)],
}


def complexity_points() -> Column:
    total = F.lit(0)
    for name, steps in POINTS.items():
        p = F.when(F.lit(False), 0)
        for above, n in steps:
            p = p.when(c(name) > above, n)
        total = total + p.otherwise(0)
    return total


def target_risk(high: Column, medium: Column, low: Column, detectors: Column, label: Column) -> Column:
    """30, 15, 5 and 3 points, clipped to 100, twenty more for labelled rows, clipped again."""
    base = F.least(F.lit(100), 30 * high + 15 * medium + 5 * low + 3 * detectors)
    return F.least(F.lit(100), base + 20 * label)
