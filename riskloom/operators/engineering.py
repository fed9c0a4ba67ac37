"""Feature engineering, sampling, scaling and augmentation on numeric frames."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.cleaning import finite
from riskloom.operators.stats import quantiles

# Engineered feature -> formula over the frame's columns.
INTERACTIONS = {
    "cei_reentrancy_risk": "cei_violations * has_reentrancy",
    "state_external_danger": "state_after_call_count * num_external_calls",
    "unchecked_lowlevel_risk": "has_unchecked_call * num_low_level_calls",
    "complexity_size_product": "max_complexity * lines_of_code",
    "functions_calls_interaction": "num_functions * num_external_calls",
    "high_severity_density": "high * detectors",
    "guard_effectiveness": "has_reentrancy_guard * (1 - cei_score)",
}
RATIOS = {
    "external_calls_ratio": ("num_external_calls", "num_functions"),
    "low_level_calls_ratio": ("num_low_level_calls", "num_external_calls"),
    "complexity_per_loc": ("max_complexity", "lines_of_code"),
    "avg_function_size": ("lines_of_code", "num_functions"),
    "detector_density": ("detectors", "lines_of_code"),
    "high_severity_ratio": ("high", "detectors"),
    "cei_violation_rate": ("cei_violations", "num_functions"),
    "state_after_call_ratio": ("state_after_call_count", "num_external_calls"),
}
DOMAIN = {
    "reentrancy_risk_score": "0.4D * cei_violations + 0.3D * state_after_call_count + 10 * has_reentrancy + 5 * has_unchecked_call - 15 * has_reentrancy_guard",
    "access_control_risk": "10 * has_access_control + 8 * has_tx_origin + 6 * has_delegatecall",
    "code_quality_score": "10 * comment_ratio + 5 * (1 - max_complexity / 100D) + 2 * num_modifiers - 3 * num_unused",
    "contract_maturity": "2 * inheritance_depth + 3 * num_library_calls + num_comments / 10D",
    "has_critical_pattern": "CASE WHEN cei_violations >= 2 OR has_reentrancy = 1 OR high >= 3 THEN 1 ELSE 0 END",
}


def interactions(df: DataFrame) -> DataFrame:
    return df.withColumns({f"fe_{n}": F.expr(e).cast("double") for n, e in INTERACTIONS.items()})


def ratios(df: DataFrame) -> DataFrame:
    """a / (b + 1), cleaned of what isn't finite."""
    return df.withColumns({f"fe_{n}": finite(F.try_divide(F.col(a).cast("double"), F.col(b) + 1)) for n, (a, b) in RATIOS.items()})


def domain(df: DataFrame) -> DataFrame:
    return df.withColumns({f"fe_{n}": F.expr(e).cast("double") for n, e in DOMAIN.items()})


def polynomial(df: DataFrame, x: str, y: str, degree: int = 2) -> DataFrame:
    """All products of powers of two columns with total degree 2..`degree`."""
    terms = [(d - j, j) for d in range(2, degree + 1) for j in range(d + 1)]
    return df.withColumns({f"fe_{x}{i}_{y}{j}": F.pow(x, F.lit(i)) * F.pow(y, F.lit(j)) for i, j in terms})


def engineered(df: DataFrame) -> DataFrame:
    """Interactions, ratios, domain composites, then squares and product of complexity and size."""
    return polynomial(domain(ratios(interactions(df))), "max_complexity", "lines_of_code")


def fit_robust(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range (1 if it is 0) of each column, exact, from the training rows alone."""
    q = {(r.feature, r.p): r.value for r in quantiles(train, columns, [0.25, 0.5, 0.75]).collect()}  # three rows a column
    return {c: (q[c, 0.5], (q[c, 0.75] - q[c, 0.25]) or 1.0) for c in columns if (c, 0.5) in q}


def fit_standard(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation (1 if it is 0)."""
    row = train.agg(*[F.avg(c).alias(f"{c}__m") for c in columns], *[F.stddev_pop(c).alias(f"{c}__s") for c in columns]).first()
    return {c: (row[f"{c}__m"], row[f"{c}__s"] or 1.0) for c in columns}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def hash_order(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def hash_ranks(df: DataFrame, stratum: str, key: str, seed: int = 42, then: list[str] | None = None) -> DataFrame:
    """`df` with _k, each row's rank in its stratum in the order of a seeded hash (then key, then `then`), and _n, the stratum's size.

    Strata are dealt by the first 16 bits of the hash; a rank is that in the row's part plus the sizes
    of the parts before, so no window holds a stratum, whatever share of the rows it has.
    """
    h = hash_order(key, seed)
    dealt = df.withColumn("_h", h).withColumn("_p", F.conv(F.left("_h", F.lit(4)), 16, 10).cast("int"))
    sizes = dealt.groupBy(F.col(stratum).alias("_s"), "_p").agg(F.count("*").alias("_c"))
    of = Window.partitionBy("_s")  # at most 65,536 rows a stratum
    before = F.coalesce(F.sum("_c").over(of.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_s", F.col("_p").alias("_q"), before.alias("_before"), F.sum("_c").over(of).alias("_n"))
    inner = F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_h", key, *(then or [])))
    ranked = dealt.withColumn("_i", inner).join(sizes, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q")))
    return ranked.select(*df.columns, (F.col("_before") + F.col("_i")).alias("_k"), "_n")


def exact_share(df: DataFrame, stratum: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """The first floor(share * n) rows of each stratum in the order of a seeded hash."""
    return hash_ranks(df, stratum, key, seed).where(F.col("_k") <= F.floor(F.lit(share) * F.col("_n"))).select(df.columns)


def balanced(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest class has."""
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    return hash_ranks(df, label, key, seed).where(F.col("_k") <= least).select(df.columns)


def split(df: DataFrame, label: str, key: str, shares: tuple[float, float] = (0.6, 0.8), seed: int = 42, least: int = 2) -> DataFrame:
    """A `split` column: train, val or test, by the relative hash rank within each class.

    If a class has fewer than `least` rows, all rows are split together, without regard to the class.
    """
    smallest = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    if smallest < least:
        one = hash_ranks(df.withColumn("_all", F.lit(1)), "_all", key, seed)
    else:
        one = hash_ranks(df, label, key, seed)
    r = F.coalesce(F.try_divide(F.col("_k") - 1, F.col("_n") - 1), F.lit(0.0))
    return one.select(*df.columns, F.when(r < shares[0], "train").when(r < shares[1], "val").otherwise("test").alias("split"))


def beta_quantiles(alpha: float, parts: int = 2_048) -> list[float]:
    """The symmetric beta distribution's quantiles at 0, 1/parts, ... 1, by integration over x ** alpha, where its density has no pole."""
    s = np.linspace(0.0, 0.5**alpha, 20_001)
    x = s ** (1 / alpha)
    density = (1 - x) ** (alpha - 1)
    below = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(s))])
    half = np.interp(np.linspace(0, 0.5, parts // 2 + 1), below / below[-1] / 2, x)
    return [*half.tolist(), *(1 - half[-2::-1]).tolist()]


def mixup(df: DataFrame, columns: list[str], label: str, key: str, alpha: float = 0.2, share: float = 0.5, factor: float = 2.0, seed: int = 42) -> DataFrame:
    """New rows: convex mixes of two rows of the whole table, min(share * n, (factor - 1) * n) of them, rounded down.

    Rows are ranked by a hash of the key; the first of them mix with the rows a seeded turn further on, so partners
    come from anywhere and are met by a join on the rank. A mix's share is beta(alpha, alpha), from a hash of its rank.
    Fewer than two rows give none. Nulls in a column make its mix null.
    """
    ranked = hash_ranks(df.select(key, label, *columns).withColumn("_all", F.lit(1)), "_all", key, seed, [label, *columns])
    n = df.count()
    many = min(int(n * share), int(n * (factor - 1)))
    if n < 2 or many <= 0:
        return df.select(*[F.col(c).cast("double").alias(c) for c in [label, *columns]]).limit(0)
    turn = 1 + int(np.random.default_rng(seed).integers(n - 1))
    table = beta_quantiles(alpha)
    first = ranked.where(F.col("_k") <= many).select("_k", (F.pmod(F.col("_k") - 1 + turn, F.lit(n)) + 1).alias("_with"), *[F.col(c).cast("double").alias(c) for c in [label, *columns]])
    other = ranked.select(F.col("_k").alias("_with"), *[F.col(c).cast("double").alias(f"_{c}") for c in [label, *columns]])
    at = (F.pmod(F.xxhash64("_k", F.lit(seed + 1)), F.lit(1_000_003)) + 0.5) / 1_000_003 * (len(table) - 1)
    both = first.join(other, "_with").withColumn("_at", at).withColumn("_i", F.floor("_at").cast("int"))
    low, high = F.get(F.lit(table), F.col("_i")), F.get(F.lit(table), F.col("_i") + 1)
    mixed = both.withColumn("_l", low + (high - low) * (F.col("_at") - F.col("_i")))
    return mixed.select(*[(F.col("_l") * F.col(c) + (1 - F.col("_l")) * F.col(f"_{c}")).alias(c) for c in [label, *columns]])


def jitter(df: DataFrame, columns: list[str], key: str, sigma: float = 0.05, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Rows with noise of sigma standard deviations on the named columns, floored at 0, each with its own label.

    The noise comes from hashes of the key, so it is the same however the rows are dealt out.
    """
    spread = fit_standard(df, columns)
    some = df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000)) < F.lit(int(share * 1000)))
    uniform = lambda i: (F.pmod(F.xxhash64(key, F.lit(seed + i)), F.lit(1_000_003)) + 0.5) / 1_000_003
    normal = lambda i: F.sqrt(-2 * F.log(uniform(2 * i + 1))) * F.cos(2 * math.pi * uniform(2 * i + 2))
    return some.withColumns({c: F.greatest(F.lit(0.0), F.col(c) + normal(i) * F.lit(sigma * spread[c][1])) for i, c in enumerate(columns)})



def smote(df: DataFrame, vector: str, label: str, key: str, target, k: int = 5, block: int = 2_000, seed: int = 42) -> DataFrame:
    """One new vector between each row of class `target` and one of its k nearest rows of the whole class.

    Every block of rows asks every block; a row's k nearest are the best of its blocks' k nearest.
    """
    own = df.where(F.col(label) == target).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-own.count() // block))
    placed = own.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asking = placed.withColumnRenamed("_b", "_i").withColumn("_j", every).groupBy("_i", "_j")
    asked = placed.withColumnRenamed("_b", "_j").withColumn("_i", every).groupBy("_i", "_j")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({key: [], "near": [], "d": []})
        right = right.sort_values(key)
        y, y_keys = np.stack(right["v"].to_numpy()), right[key].to_numpy()
        out = []
        for at in range(0, len(left), 256):
            x, x_keys = np.stack(left["v"].to_numpy()[at : at + 256]), left[key].to_numpy()[at : at + 256]
            d = np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T)
            d[x_keys[:, None] == y_keys[None]] = np.inf
            first = np.argsort(d, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({key: np.repeat(x_keys, first.shape[1]), "near": y_keys[first].ravel(), "d": np.take_along_axis(d, first, 1).ravel()}))
        found = pd.concat(out)
        return found[np.isfinite(found["d"])]

    near = asking.cogroup(asked).applyInPandas(nearest, f"{key} long, near long, d double")
    best = near.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "near"))), 1, k).alias("best"))  # k for each block
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.size("best").cast("long")).cast("int")
    picked = best.select(F.col(key).alias("_k"), F.get("best", draw)["near"].alias("_near"))
    share = F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(1_000_000)) / F.lit(1e6)
    pairs = own.join(picked, F.col(key) == F.col("_k"), "left").join(own.select(F.col(key).alias("_near"), F.col("v").alias("_w")), "_near", "left")
    made = F.when(F.col("_w").isNull(), F.col("v")).otherwise(F.zip_with("v", "_w", lambda a, b: a + share * (b - a)))
    return pairs.select(key, made.alias("v"))
