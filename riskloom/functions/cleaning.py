"""Cleaning of raw columns as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIG = 999_999.0


def finite(x: Column) -> Column:
    """Null and NaN become 0, either infinity 999999."""
    inf = F.lit(float("inf"))
    return F.when(x.isNull() | F.isnan(x), 0.0).when((x == inf) | (x == -inf), BIG).otherwise(x)


def as_flag(x: Column) -> Column:
    """'True', 'true', '1', 'yes' become 1; anything else, null included, 0."""
    return F.coalesce(F.lower(x).isin("true", "1", "yes").cast("int"), F.lit(0))


def as_number(x: Column) -> Column:
    """The number that a text holds, else 0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def ordinal(x: Column, names: list[str]) -> Column:
    """Position in a list, null if absent."""
    out = F.when(F.lit(False), 0)
    for i, n in enumerate(names):
        out = out.when(x == n, i)
    return out


def one_hot(x: Column, values: list[str], prefix: str) -> list[Column]:
    """A 0/1 column for each value but the alphabetically first."""
    return [F.coalesce((x == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in sorted(values)[1:]]


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order; a rule that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
