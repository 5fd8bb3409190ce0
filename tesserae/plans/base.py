"""What the modules of registered queries share: the registry, the stored sketch and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import exprs, stats
from tesserae.operators import sketch
from tesserae.operators.sketch import CONFIG
from tesserae.session import shared_folder
from tesserae.sources.observations import observations, observations_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Run = Callable[[SparkSession, str], DataFrame]
FS = CONFIG.features
PLANES = CONFIG.planes
HASH = exprs.geohash("lat", "lon")
BUCKET = exprs.time_bucket("ms")
TICKS = CONFIG.ticks["value"]


_stored: dict[tuple[str, str], str] = {}


def leaves(spark: SparkSession, d: str) -> DataFrame:
    """The sketch of a folder's observations: built and stored by the first query of an application that asks for it,
    read by all others."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stored:
        path = shared_folder(spark, "sketch")
        sketch.write(sketch.build(observations(spark, d)), path, characters=1)
        _stored[key] = path
    return sketch.read(spark, _stored[key])


def sums() -> list:
    """The statistics of leaves as plain sums, in the order of STATS."""
    return stats.sums(FS)


def _leaf_sql(planes: dict[str, str] | None = None, source: str = "obs") -> str:
    own = planes or {"time": BUCKET} | {f: exprs.quantize(f"o.{f}", CONFIG.ticks[f]) for f in FS} | {"location": HASH}
    sums = ["count(*) AS n"]
    for f in FS:
        sums += [f"sum(o.{f}) AS s_{f}", f"sum(o.{f} * o.{f}) AS q_{f}", f"min(o.{f}) AS min_{f}", f"max(o.{f}) AS max_{f}"]
    sums += [f"sum(o.{a} * o.{b}) AS p_{a}_{b}" for a, b in combinations(FS, 2)]
    return f"SELECT {', '.join(f'{e} AS {p}' for p, e in own.items())}, {', '.join(sums)} FROM {source} o GROUP BY {', '.join(str(i) for i in range(1, len(own) + 1))}"


WITH = f"WITH obs AS ({observations_sql()}), leaves AS ({_leaf_sql()}) "
MERGED = "sum(n)::BIGINT AS n, " + ", ".join(f"sum(s_{f}) AS s_{f}, sum(q_{f}) AS q_{f}, min(min_{f}) AS min_{f}, max(max_{f}) AS max_{f}" for f in FS) + ", " + ", ".join(f"sum(p_{a}_{b}) AS p_{a}_{b}" for a, b in combinations(FS, 2))


def register(name: str, run: Run, sql: str | None = None) -> None:
    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _listed(columns: list[str], doubles: set[str] | None = None, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" if doubles is None or c in doubles else c for c in columns)


LEAF_DOUBLES = {f"{p}_{f}" for f in FS for p in ("s", "q", "min", "max")} | {f"p_{a}_{b}" for a, b in combinations(FS, 2)} | set(FS)
LEAF_COLUMNS = [*PLANES, "n", *[c for f in FS for c in (f"s_{f}", f"q_{f}", f"min_{f}", f"max_{f}")], *[f"p_{a}_{b}" for a, b in combinations(FS, 2)]]
LEAF_OUT = _listed(LEAF_COLUMNS, LEAF_DOUBLES)
STATS = [c for c in LEAF_COLUMNS if c not in PLANES]
STATS_OUT = _listed(STATS, LEAF_DOUBLES)

