"""Weights of an ensemble's members by a bounded optimiser of the area under the curve.

A vote s = sum of w * p falls between two knots of an even grid over the scores' range and is dealt to
both by its distance, so positives and negatives by knot, and with them the area, change smoothly with w.
One aggregate by knot and label, for many candidate weights at once, gives each candidate's area and its
gradient: a few thousand numbers come to the driver, however many rows there are, and no row does.

The weights stay on the simplex (not negative, summing to one): steps are projected onto it. Directions
are those of a quasi-Newton model of the area's curvature, with the plain gradient beside it; a round
tries a ladder of lengths along both in one aggregate. Rounds end when the best candidate gains less than
`enough`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KNOTS = 512
LENGTHS = [2.0**-i for i in range(8)]


def projected(w: np.ndarray) -> np.ndarray:
    """The nearest point of the simplex."""
    down = np.sort(w)[::-1]
    over = (np.cumsum(down) - 1) / np.arange(1, len(w) + 1)
    return np.maximum(w - over[np.flatnonzero(down > over)[-1]], 0.0)


def smooth_areas(scored: DataFrame, columns: list[str], label: str, weights: list[np.ndarray], low: float, high: float, knots: int = KNOTS) -> list[tuple[float, np.ndarray]]:
    """(area, gradient) for each of `weights`, from one aggregate; an area without either class is 0."""
    scale = (knots - 1) / max(high - low, 1e-12)
    votes = [sum((F.col(c) * F.lit(float(x)) for c, x in zip(columns, w, strict=True)), F.lit(0.0)) for w in weights]
    places = F.array(*[F.struct(F.lit(i).alias("i"), ((v - F.lit(float(low))) * F.lit(scale)).alias("x")) for i, v in enumerate(votes)])
    each = scored.select(label, *columns, F.explode(places).alias("at"))
    knot = F.greatest(F.lit(0), F.least(F.lit(knots - 2), F.floor("at.x"))).cast("int")
    sums = each.groupBy(F.col("at.i").alias("i"), knot.alias("b"), (F.col(label) == 1).alias("positive")).agg(
        F.count("*").alias("n"), F.sum(F.col("at.x") - knot).alias("f"), *[F.sum(c).alias(f"p{j}") for j, c in enumerate(columns)]).toPandas()
    out = []
    for i in range(len(weights)):
        counts, slopes = np.zeros((2, knots)), np.zeros((2, knots, len(columns)))
        own = sums[sums["i"] == i]
        for side in (0, 1):
            rows = own[own["positive"] == bool(side)]
            b, p = rows["b"].to_numpy(), rows[[f"p{j}" for j in range(len(columns))]].to_numpy(float) * scale
            np.add.at(counts[side], b, (rows["n"] - rows["f"]).to_numpy(float))
            np.add.at(counts[side], b + 1, rows["f"].to_numpy(float))
            np.add.at(slopes[side], b, -p)
            np.add.at(slopes[side], b + 1, p)
        neg, pos = counts
        pairs = neg.sum() * pos.sum()
        if not pairs:
            out.append((0.0, np.zeros(len(columns))))
            continue
        below, above = np.cumsum(neg) - neg / 2, pos.sum() - np.cumsum(pos) + pos / 2
        out.append((float(pos @ below / pairs), (below @ slopes[1] + above @ slopes[0]) / pairs))
    return out


def best_weights(scored: DataFrame, names: list[str], label: str, rounds: int = 20, enough: float = 1e-6) -> tuple[dict[str, float], float, int]:
    """The weights of the members p_<name>, their smooth area, and the number of aggregates that it took.

    Rows with a null label or score take no part. A table without rows, or without either class, has equal weights and area 0.
    """
    columns = [f"p_{n}" for n in names]
    rows = scored.select(F.col(label).cast("double").alias(label), *[F.col(c).cast("double").alias(c) for c in columns]).dropna().persist()
    try:
        ends = rows.agg(F.min(F.least(*columns) if len(columns) > 1 else columns[0]), F.max(F.greatest(*columns) if len(columns) > 1 else columns[0])).first()
        k = len(names)
        equal = np.full(k, 1 / k)
        if ends[0] is None or k == 1:
            return dict(zip(names, equal.tolist(), strict=True)), 0.0, 0
        areas = lambda ws: smooth_areas(rows, columns, label, ws, *ends)
        starts = [equal, *np.eye(k), *((np.eye(k)[a] + np.eye(k)[b]) / 2 for a, b in combinations(range(k), 2))]
        found, jobs = areas(starts), 1
        at = max(range(len(starts)), key=lambda i: found[i][0])
        w, (area, slope) = starts[at], found[at]
        inverse = np.eye(k)
        for _ in range(rounds):
            tangent = slope - slope.mean()
            ways = [d / max(np.abs(d).max(), 1e-12) for d in (inverse @ tangent, tangent)]
            tries = [projected(w + t * d) for d in ways for t in (*LENGTHS, 0.5 * LENGTHS[-1], 0.25 * LENGTHS[-1])]
            found, jobs = areas(tries), jobs + 1
            at = max(range(len(tries)), key=lambda i: found[i][0])
            if found[at][0] <= area + enough:
                break
            step, change = tries[at] - w, -(found[at][1] - found[at][1].mean() - tangent)
            if (curve := step @ change) > 1e-12:  # else the area isn't concave along the step
                left = np.eye(k) - np.outer(step, change) / curve
                inverse = left @ inverse @ left.T + np.outer(step, step) / curve
            w, (area, slope) = tries[at], found[at]
        return dict(zip(names, w.tolist(), strict=True)), area, jobs
    finally:
        rows.unpersist()
