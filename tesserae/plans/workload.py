"""Random query workloads, and weighted mixes of kinds of queries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.exprs import ALPHABET
from tesserae.operators.sketch import CONFIG, SketchConfig
from tesserae.plans.query import Expr, Query

#: Width of a range as a share of a feature's range, by the length of the prefix.
WIDTHS = {1: 0.10, 2: 0.05, 3: 0.01}


def prefixes(length: int, under: str = "") -> list[str]:
    """All prefixes of a length below another."""
    out = [under]
    while out and len(out[0]) < length:
        out = [p + c for p in out for c in ALPHABET]
    return out


def generate(n: int, scope: list[str], seed: int = 7, booleans: tuple[str, ...] = ("err",), least: int = 1, config: SketchConfig = CONFIG) -> list[Query]:
    """n queries: a prefix of the scope and at least so many features, a boolean one equal to 0 or 1, another in a range
    from a random start. Equal seeds give equal queries."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        prefix = rng.choice(scope)
        chosen = rng.sample(config.features, rng.randint(min(least, len(config.features)), len(config.features)))
        q = Query([Expr("location", "[=", prefix)])
        for f in chosen:
            if f in booleans:
                q.add(Expr(f, "==", float(rng.randint(0, 1))))
            else:
                low, high = config.ticks[f][0], config.ticks[f][-1]
                start, width = rng.uniform(low, high), WIDTHS[min(max(len(prefix), 1), 3)] * (high - low)
                q.add(Expr(f, "[)", start, start + width))
        out.append(q)
    return out


def matches(leaves: DataFrame, queries: list[Query]) -> DataFrame:
    """(query, leaves, rows) for each of the queries, in one pass over the leaves."""
    own = [q.check(leaves.columns).predicate() for q in queries]
    hit = leaves.select("n", F.explode(F.filter(F.array(*[F.when(p, F.lit(i)) for i, p in enumerate(own)]), lambda x: x.isNotNull())).alias("query"))
    return hit.groupBy("query").agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("rows"))


def mix(weights: dict[str, float], n: int, seed: int = 7) -> list[str]:
    """n kinds of queries, drawn by their weights in per cent, which must add up to 100."""
    if abs(sum(weights.values()) - 100) > 1e-9 or min(weights.values()) < 0:
        raise ValueError("weights must be per cents that add up to 100")
    rng, out = random.Random(seed), []
    for _ in range(n):
        at = rng.uniform(0, 100)
        for kind, w in weights.items():
            at -= w
            if at < 0:
                break
        out.append(kind)
    return out


def run(leaves: DataFrame, kinds: list[str], queries: list[Query], ask: Callable[[DataFrame, str, dict], DataFrame], warm_up: int = 100) -> dict[str, float]:
    """Asks kinds[i] with queries[i], one after the other; seconds a query, mean and 95th of 100, and queries a second.
    The first warm_up ones are not counted."""
    took = []
    for kind, q in zip(kinds, queries, strict=True):
        began = time.perf_counter()
        ask(leaves, kind, q.to_dict()).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    took = sorted(took[warm_up:])
    if not took:
        raise ValueError("all queries were taken for the warm-up")
    return {"mean": sum(took) / len(took), "p95": took[min(len(took) - 1, int(0.95 * len(took)))], "per_second": len(took) / sum(took)}
