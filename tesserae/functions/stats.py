"""Mergeable statistics: what a leaf stores, how leaves merge, and what is derived from them.

A leaf stores sums relative to an origin that it carries with it: o_f, the sum s_f of the differences from it, the sum
q_f of their squares, and the sums p_a_b of products of differences. With an origin near the values nothing cancels,
however large they are; so merging is sum, min and max in one pass, with partial sums in generated code. A sketch takes
its origins from its ticks. Without given origins, a group's own mean is taken, and merging needs rebased() first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Extra:
    """A further statistic of a leaf, a function of raw rows that merges by another: UDAF as two expressions in SQL.
    merge takes the name of the stored column."""

    name: str
    of_rows: str
    merge: str

    def leaf(self) -> Column:
        return F.expr(self.of_rows).alias(self.name)

    def merged(self) -> Column:
        return F.expr(self.merge).alias(self.name)


def _value(feature: str) -> Column:
    return F.col(feature).cast("double")


def leaf_aggregates(features: list[str], shifts: dict[str, float] | None = None) -> list[Column]:
    """n; per feature origin, sum, sum of squares, minimum, maximum; per pair the sum of products. Features without an
    entry in shifts have the origin 0; without shifts, the origin is the group's mean."""
    out = [F.count(F.lit(1)).alias("n")]
    for f in features:
        if shifts is None:
            own = [F.avg(_value(f)).alias(f"o_{f}"), F.when(F.count(f) > 0, 0.0).alias(f"s_{f}"), (F.var_pop(_value(f)) * F.count(f)).alias(f"q_{f}")]
        else:
            x = _value(f) - F.lit(float(shifts.get(f, 0.0)))
            own = [F.lit(float(shifts.get(f, 0.0))).alias(f"o_{f}"), F.sum(x).alias(f"s_{f}"), F.sum(x * x).alias(f"q_{f}")]
        out += [*own, F.min(_value(f)).alias(f"min_{f}"), F.max(_value(f)).alias(f"max_{f}")]
    for a, b in combinations(features, 2):
        if shifts is None:
            pair = F.covar_pop(_value(a), _value(b)) * F.regr_count(_value(a), _value(b))
        else:
            pair = F.sum((_value(a) - F.lit(float(shifts.get(a, 0.0)))) * (_value(b) - F.lit(float(shifts.get(b, 0.0)))))
        out.append(pair.alias(f"p_{a}_{b}"))
    return out


def merge_aggregates(features: list[str]) -> list[Column]:
    """The same columns from rows that have them. All rows must have the same origins; others fail the query."""
    out = [F.sum("n").alias("n")]
    for f in features:
        one = F.when(F.min(f"o_{f}") == F.max(f"o_{f}"), F.min(f"o_{f}")).when(F.count(f"o_{f}") > 0, F.raise_error(F.lit(f"leaves with other origins of {f}: rebase them")).cast("double"))
        out += [one.alias(f"o_{f}"), F.sum(f"s_{f}").alias(f"s_{f}"), F.sum(f"q_{f}").alias(f"q_{f}"), F.min(f"min_{f}").alias(f"min_{f}"), F.max(f"max_{f}").alias(f"max_{f}")]
    return out + [F.sum(f"p_{a}_{b}").alias(f"p_{a}_{b}") for a, b in combinations(features, 2)]


def rebased(df: DataFrame, features: list[str], shifts: dict[str, float]) -> DataFrame:
    """Rows of statistics with other origins."""
    by = {f: F.col(f"o_{f}") - F.lit(float(shifts.get(f, 0.0))) for f in features}
    out = {f"p_{a}_{b}": F.col(f"p_{a}_{b}") + by[a] * F.col(f"s_{b}") + by[b] * F.col(f"s_{a}") + F.col("n") * by[a] * by[b] for a, b in combinations(features, 2)}
    for f in features:
        out |= {f"q_{f}": F.col(f"q_{f}") + 2 * by[f] * F.col(f"s_{f}") + F.col("n") * by[f] * by[f], f"s_{f}": F.col(f"s_{f}") + F.col("n") * by[f], f"o_{f}": F.lit(float(shifts.get(f, 0.0)))}
    return df.withColumns(out)


def sums(features: list[str]) -> list[Column]:
    """n and the sums of values, squares and products themselves, minima and maxima."""
    out = [F.col("n")]
    for f in features:
        o, s = F.col(f"o_{f}"), F.col(f"s_{f}")
        out += [(s + F.col("n") * o).alias(f"s_{f}"), (F.col(f"q_{f}") + 2 * o * s + F.col("n") * o * o).alias(f"q_{f}"), F.col(f"min_{f}"), F.col(f"max_{f}")]
    for a, b in combinations(features, 2):
        out.append((F.col(f"p_{a}_{b}") + F.col(f"o_{a}") * F.col(f"s_{b}") + F.col(f"o_{b}") * F.col(f"s_{a}") + F.col("n") * F.col(f"o_{a}") * F.col(f"o_{b}")).alias(f"p_{a}_{b}"))
    return out


def mean(f: str) -> Column:
    return F.col(f"o_{f}") + F.col(f"s_{f}") / F.col("n")


def m2(f: str) -> Column:
    """Sum of squared differences from the mean."""
    return F.greatest(F.col(f"q_{f}") - F.col(f"s_{f}") * F.col(f"s_{f}") / F.col("n"), F.lit(0.0))


def variance(f: str, ddof: int = 1) -> Column:
    """Null when no more rows than ddof."""
    return F.when(F.col("n") > ddof, m2(f) / (F.col("n") - ddof))


def std(f: str, ddof: int = 1) -> Column:
    return F.sqrt(variance(f, ddof))


def cross(a: str, b: str) -> Column:
    """Sum of products of differences from the means."""
    return F.col(f"p_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")


def slope(x: str, y: str, pair: Column | None = None) -> Column:
    return F.when(m2(x) > 0, (cross(x, y) if pair is None else pair) / m2(x))


def intercept(x: str, y: str) -> Column:
    return mean(y) - slope(x, y) * mean(x)


def correlation(x: str, y: str) -> Column:
    """With its sign."""
    return F.when((m2(x) > 0) & (m2(y) > 0), cross(x, y) / F.sqrt(m2(x) * m2(y)))


def standard_error(f: str) -> Column:
    return F.sqrt(m2(f)) / F.col("n")


def density(f: str, at: float) -> Column:
    """Of the normal distribution with the leaf's mean and sample variance."""
    v = variance(f)
    return F.exp(-F.pow(F.lit(float(at)) - mean(f), 2) / (2 * v)) / F.sqrt(2 * F.lit(math.pi) * v)


def retract(f: str, value: float) -> dict[str, Column]:
    """n, sum and sum of squares without one value; origin, minimum and maximum stay as they were. An only value leaves
    zeros."""
    left, x = F.col("n") > 1, F.lit(float(value)) - F.col(f"o_{f}")
    return {"n": F.when(left, F.col("n") - 1).otherwise(0), f"s_{f}": F.when(left, F.col(f"s_{f}") - x).otherwise(0.0), f"q_{f}": F.when(left, F.col(f"q_{f}") - x * x).otherwise(0.0)}


def errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """RMSE, and it over the range (nrmse) and over the mean (cvrmse) of the actual values."""
    a = F.col(actual).cast("double")
    rmse = F.sqrt(F.avg(F.pow(a - F.col(predicted), 2)))
    return df.agg(rmse.alias("rmse"), (rmse / (F.max(a) - F.min(a))).alias("nrmse"), (rmse / F.avg(a)).alias("cvrmse"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            out *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def welch(n1: int, mean1: float, var1: float, n2: int, mean2: float, var2: float) -> tuple[float, float, float]:
    """t, degrees of freedom and two-sided p of Welch's test."""
    a, b = var1 / n1, var2 / n2
    t = (mean1 - mean2) / math.sqrt(a + b)
    df = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return t, df, t_two_sided(t, df)


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation."""
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
