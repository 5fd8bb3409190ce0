"""Quantizer training, and distribution estimates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import exprs, stats


def fit_ticks(df: DataFrame, column: str, n: int, accuracy: int = 10_000) -> list[float]:
    """Ticks of bins that hold equally many values: n quantiles, the first the minimum. A list of n numbers."""
    got = df.agg(F.percentile_approx(column, [i / n for i in range(n)], accuracy).alias("t")).first()["t"]
    return sorted({float(x) for x in got or []})


def midpoint_errors(df: DataFrame, column: str, ticks: list[float]) -> DataFrame:
    return stats.errors(df.where(F.col(column).isNotNull()).withColumn("_p", F.expr(exprs.bin_midpoint(column, ticks))), column, "_p")


def _fine(df: DataFrame, column: str, bins: int) -> list:
    """(edge, n, s, q) of at most `bins` bins of about equal mass: their lower edges, counts, and the sums of differences
    from the edge and of their squares. Two passes over the column, whatever is searched for afterwards."""
    edges = fit_ticks(df, column, bins, 10 * bins)
    if not edges:
        return []
    at = df.sparkSession.createDataFrame([(e,) for e in edges], "edge double").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    # the greatest edge at or below a value, by bisection in width_bucket's manner over a sorted array
    own = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x")).crossJoin(F.broadcast(at))
    k = F.expr("aggregate(sequence(1, 20), named_struct('lo', 0, 'hi', size(edges)), (a, i) -> CASE WHEN a.hi - a.lo <= 1 THEN a WHEN edges[CAST((a.lo + a.hi) / 2 AS INT)] <= x THEN named_struct('lo', CAST((a.lo + a.hi) / 2 AS INT), 'hi', a.hi) ELSE named_struct('lo', a.lo, 'hi', CAST((a.lo + a.hi) / 2 AS INT)) END).lo")
    own = own.select("x", F.get("edges", k).alias("edge"))
    d = F.col("x") - F.col("edge")
    rows = own.groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return sorted(rows.collect())


def search_ticks(df: DataFrame, column: str, max_nrmse: float = 0.025, start: int = 10, bins: int = 4096) -> list[float]:
    """The fewest equal-mass ticks from start whose midpoint error is at most max_nrmse. The column is read twice, for
    `bins` fine bins (a bounded table); all tick counts are then tried on them. ValueError if even the fine bins miss
    the bound."""
    fine = _fine(df, column, bins)
    if not fine:
        return []
    total, spread = sum(r["n"] for r in fine), max(r["hi"] for r in fine) - min(r["lo"] for r in fine)
    for n in range(start, len(fine) + 1):
        ticks, seen = [], 0
        for r in fine:  # a tick where the mass passes the next n-th
            if seen * n >= len(ticks) * total:
                ticks.append(r["edge"])
            seen += r["n"]
        square, k = 0.0, 0
        for r in fine:
            while k + 1 < len(ticks) and ticks[k + 1] <= r["edge"]:
                k += 1
            middle = (ticks[k] + ticks[k + 1]) / 2 if k + 1 < len(ticks) else ticks[k]
            off = r["edge"] - middle
            square += r["q"] + 2 * off * r["s"] + r["n"] * off * off
        if not spread or math.sqrt(square / total) / spread <= max_nrmse:
            return ticks
    if len(fine) < start:
        return [r["edge"] for r in fine]
    raise ValueError(f"no {len(fine)} ticks reach an error of {max_nrmse}")


def sampling_plan(df: DataFrame, key: str, first: int = 1000, every: int = 50) -> DataFrame:
    """The sample a density is estimated from: the first rows by an integer key, then those whose key is divisible by
    `every`. ValueError if there are fewer than the first."""
    head = df.orderBy(key).limit(first).agg(F.max(key).alias("last"), F.count(F.lit(1)).alias("n")).first()
    if head["n"] < first:
        raise ValueError(f"a density needs {first} values, there are {head['n']}")
    return df.where((F.col(key) <= head["last"]) | (F.col(key) % every == 0))


def mass(leaves: DataFrame, feature: str, ticks: list[float]) -> DataFrame:
    """(tick, p, density, below) from leaves: the share of rows in each bin, that over the bin's width, and the share
    below the bin: the integral of the density up to it. The open last bin has no density. A row per tick."""
    own = leaves.where(F.col(feature).isNotNull()).groupBy(F.col(feature).alias("tick")).agg(F.sum("n").alias("n"))
    whole = own.agg(F.sum("n").alias("total"))
    up_to = Window.partitionBy(F.lit(0)).orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    width = F.expr(exprs.next_tick("tick", ticks)) - F.col("tick")
    out = own.crossJoin(F.broadcast(whole)).withColumn("p", F.col("n") / F.col("total"))
    return out.select("tick", "p", (F.col("p") / width).alias("density"), F.coalesce(F.sum("n").over(up_to) / F.col("total"), F.lit(0.0)).alias("below"))


def tick_errors(train: DataFrame, test: DataFrame, column: str, ticks: list[float]) -> DataFrame:
    """Per tick: the mean of the training values, and the RMSE of predicting the test values by it."""
    tick = F.expr(exprs.quantize(column, ticks)).alias("tick")
    means = train.select(tick, column).groupBy("tick").agg(F.avg(column).alias("mean"))
    joined = test.select(tick, column).join(F.broadcast(means), "tick")  # a row per tick at most
    return joined.groupBy("tick").agg(F.count(F.lit(1)).alias("n"), F.first("mean").alias("mean"), F.sqrt(F.avg(F.pow(F.col(column) - F.col("mean"), 2))).alias("rmse"))


def kde(df: DataFrame, column: str, points: list[float], bins: int = 200) -> list[tuple[float, float]]:
    """Gaussian kernel density at points, over counts in equal bins (at most `bins` rows), with Silverman's bandwidth."""
    s = df.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.stddev_samp(column).alias("sd")).first()
    if not s["n"]:
        return [(p, 0.0) for p in points]
    width = (s["hi"] - s["lo"]) / bins or 1.0
    at = F.least(F.floor((F.col(column) - s["lo"]) / width), F.lit(bins - 1))
    counts = [(s["lo"] + (r["b"] + 0.5) * width, r["n"]) for r in df.where(F.col(column).isNotNull()).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()]
    h = 1.06 * (s["sd"] or 1.0) * s["n"] ** -0.2
    return [(p, sum(n * math.exp(-(((p - x) / h) ** 2) / 2) for x, n in counts) / (s["n"] * h * math.sqrt(2 * math.pi))) for p in points]
