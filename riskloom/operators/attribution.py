"""What each feature adds to a tree model's score of a row: exact Shapley values along the trees' paths.

A coalition's value is the tree's expectation when only its features are known: at a split on a known
feature the row's side is taken, at any other both, weighted by the training rows that went there. For
a leaf whose path asks m features that is a product over them of `o` (1 if the row passes all the
feature's splits on the path) or `z` (the share of training rows that do), so a feature's Shapley
value at the leaf is its (o - z) times a sum over the coefficients of the others' product of (z + o * t),
weighted as coalitions of that size are. Leaves and trees add up; with the base, the sum is the score itself.

Trees go out as a broadcast, a few numbers a leaf; rows are worked on in batches, so the work grows with
rows times leaves, and nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4_096  # rows worked on together


@dataclass
class Leaf:
    """value, and for each feature on the path: its bounds (low < x <= high, or the categories allowed) and the share of rows."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    allowed: list[frozenset | None]
    share: list[float]


def leaves_of(node, weight: float, value) -> list[Leaf]:
    """The leaves below a JVM tree node; `value` maps a leaf node to its prediction."""
    out: list[Leaf] = []

    def walk(n, path: dict):
        if n.getClass().getSimpleName() == "LeafNode":
            keys = sorted(path)
            out.append(Leaf(weight * value(n), keys, *[[path[k][i] for k in keys] for i in range(4)]))
            return
        split = n.split()
        feature, count = split.featureIndex(), float(n.impurityStats().count())
        continuous = split.getClass().getSimpleName() == "ContinuousSplit"
        for left, child in ((True, n.leftChild()), (False, n.rightChild())):
            low, high, allowed, share = path.get(feature, (-np.inf, np.inf, None, 1.0))
            share *= float(child.impurityStats().count()) / count if count else 0.0
            if continuous:
                low, high = (low, min(high, split.threshold())) if left else (max(low, split.threshold()), high)
            else:
                own = frozenset(split.leftCategories() if left else split.rightCategories())
                allowed = own if allowed is None else allowed & own
            walk(child, {**path, feature: (low, high, allowed, share)})

    walk(node, {})
    return out


def leaves(model) -> tuple[list[Leaf], str]:
    """All leaves of a Spark tree model, weighted, and what they add up to: the probability of class 1, the margin, or the prediction."""
    java = model._java_obj
    kind = java.getClass().getSimpleName()
    trees = [java] if kind.startswith("DecisionTree") else list(java.trees())
    weights = [1.0] * len(trees) if kind.startswith("DecisionTree") else list(java.treeWeights())
    if kind.startswith("GBT"):
        what, value, scale = "margin", lambda n: float(n.prediction()), 1.0
    elif kind.endswith("ClassificationModel"):
        def value(n):
            stats = list(n.impurityStats().stats())
            return float(stats[1]) / sum(stats) if len(stats) > 1 and sum(stats) else 0.0

        what, scale = "probability", 1.0 / sum(weights)
    else:
        what, value, scale = "prediction", lambda n: float(n.prediction()), 1.0 / sum(weights)
    return [x for t, w in zip(trees, weights, strict=True) for x in leaves_of(t.rootNode(), w * scale, value)], what


def passes(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    """rows x the leaf's features: 1 where the row passes the feature's splits. NaN goes right, as in Spark."""
    out = np.empty((len(x), len(leaf.features)))
    for j, f in enumerate(leaf.features):
        if leaf.allowed[j] is not None:
            out[:, j] = np.isin(x[:, f], list(leaf.allowed[j]))
        else:
            v = np.where(np.isnan(x[:, f]), np.inf, x[:, f])
            out[:, j] = (v <= leaf.high[j]) & ((v > leaf.low[j]) | np.isneginf(leaf.low[j]))
    return out


def shapley(every: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """rows x features: the Shapley values; and the base, the expectation without any feature."""
    out, base = np.zeros(x.shape), 0.0
    for leaf in every:
        z = np.array(leaf.share)
        base += leaf.value * float(np.prod(z))
        m = len(z)
        if not m or not leaf.value:
            continue
        o = passes(leaf, x)
        sizes = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
        for i in range(m):
            known = np.zeros((len(x), m))  # coefficients of the others' product, by coalition size
            known[:, 0] = 1.0
            for j in range(m):
                if j != i:
                    known[:, 1:] = known[:, 1:] * z[j] + known[:, :-1] * o[:, j : j + 1]
                    known[:, 0] *= z[j]
            out[:, leaf.features[i]] += leaf.value * (o[:, i] - z[i]) * (known @ sizes)
    return out, base


def attribute(model, df: DataFrame, names: list[str], top: int | None = None, features: str = "features") -> DataFrame:
    """`df` with base and contributions: array<struct<feature, contribution>>, the `top` largest in size first (None: all; ties by name).

    base plus all contributions is the probability of class 1 (forests), the margin (boosted trees) or the prediction (regression).
    """
    every, _ = leaves(model)
    sent = df.sparkSession.sparkContext.broadcast(every)
    base = float(sum(x.value * float(np.prod(x.share)) for x in every))

    @F.pandas_udf("array<double>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list = []
            for at in range(0, len(batch), BLOCK):
                block = batch.iloc[at : at + BLOCK]
                out += list(shapley(sent.value, np.stack(block.to_list()))[0]) if len(block) else []
            yield pd.Series(out)

    each = F.arrays_zip(F.lit(names).alias("feature"), values(vector_to_array(features)).alias("contribution"))
    order = F.array_sort(F.transform(each, lambda e: F.struct((-F.abs(e.contribution)).alias("size"), e.feature.alias("feature"), e.contribution.alias("contribution"))))
    picked = F.transform(F.slice(order, 1, top) if top else order, lambda e: F.struct(e.feature.alias("feature"), e.contribution.alias("contribution")))
    return df.withColumn("base", F.lit(base)).withColumn("contributions", picked)
