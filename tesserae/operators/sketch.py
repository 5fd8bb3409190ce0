"""The sketch: a leaf table grouped by its planes, and what is done to it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import exprs, stats


@dataclass
class SketchConfig:
    """ticks: per feature, in plane order. Planes are time, the features, location. shifts: the origin of a feature's
    sums, its middle tick if it is not given. extra: further statistics of a leaf."""

    ticks: dict[str, list[float]]
    hours: int = 6
    precision: int = 5
    shifts: dict[str, float] = field(default_factory=dict)
    extra: tuple[stats.Extra, ...] = ()

    def __post_init__(self):
        self.shifts = {f: float(t[len(t) // 2]) for f, t in self.ticks.items()} | self.shifts

    @property
    def features(self) -> list[str]:
        return list(self.ticks)

    @property
    def planes(self) -> list[str]:
        return ["time", *self.ticks, "location"]


#: For the observations view: density ticks of value, linear ticks of k, and two of a boolean.
CONFIG = SketchConfig({"value": [0.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0], "k": exprs.linear_ticks(0.0, 100.0, 10.0), "err": [0.0, 1.0]})


def quantized(obs: DataFrame, config: SketchConfig = CONFIG, strict: bool = True) -> DataFrame:
    """obs with the plane labels plane_<name>. strict drops rows that lack a feature, time or place; else they get a null
    label. Statistics of a feature that rows lack cover only leaves that have it."""
    obs = obs.dropna(subset=[*config.features, "ms", "lat", "lon"]) if strict else obs
    labels = {"time": exprs.time_bucket("ms", config.hours), "location": exprs.geohash("lat", "lon", config.precision)}
    labels |= {f: exprs.quantize(f, t) for f, t in config.ticks.items()}
    return obs.withColumns({f"plane_{p}": F.expr(labels[p]) for p in config.planes})


def build(obs: DataFrame, config: SketchConfig = CONFIG, strict: bool = True) -> DataFrame:
    """The leaf table. One shuffle, of partial sums."""
    out = quantized(obs, config, strict).groupBy(*[f"plane_{p}" for p in config.planes])
    out = out.agg(*stats.leaf_aggregates(config.features, config.shifts), *[x.leaf() for x in config.extra])
    return out.withColumnsRenamed({f"plane_{p}": p for p in config.planes})


def merge(*leaves: DataFrame, config: SketchConfig = CONFIG) -> DataFrame:
    """Leaves of equal labels become one; null labels are equal."""
    return regroup(reduce(lambda a, b: a.unionByName(b), leaves), config.planes, config)


def merged(config: SketchConfig) -> list[Column]:
    """The aggregates that merge leaves."""
    return [*stats.merge_aggregates(config.features), *[x.merged() for x in config.extra]]


def regroup(leaves: DataFrame, planes: list[str], config: SketchConfig = CONFIG) -> DataFrame:
    """Leaves merged over fewer planes, or over planes whose labels were made coarser."""
    return leaves.groupBy(*planes).agg(*merged(config))


def split(leaves: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Leaves outside and inside a geohash prefix."""
    inside = F.coalesce(F.col("location").startswith(prefix), F.lit(False))
    return leaves.where(~inside), leaves.where(inside)


def vertices(leaves: DataFrame, planes: list[str]) -> DataFrame:
    """(depth, n): vertices of the tree at each depth from 1, the distinct path prefixes."""
    depth = len(planes) - F.length(F.regexp_replace(F.conv(F.grouping_id().cast("string"), 10, 2), "0", ""))
    rolled = leaves.rollup(*planes).agg(depth.cast("int").alias("depth"), F.count(F.lit(1)).alias("leaves"))
    return rolled.where("depth > 0").groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def counts(leaves: DataFrame, planes: list[str]) -> DataFrame:
    """One row: vertices without the root, and leaves."""
    levels = vertices(leaves, planes)
    return levels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vertices"), F.coalesce(F.max(F.when(F.col("depth") == len(planes), F.col("n"))), F.lit(0)).alias("leaves"))


def memory(leaves: DataFrame, planes: list[str], prefix: str | None = None) -> DataFrame:
    """Estimated bytes of the tree, or of the part below a geohash prefix."""
    own = leaves if prefix is None else leaves.where(F.col("location").startswith(prefix))
    return counts(own, planes).select("vertices", "leaves", F.expr(exprs.memory_bytes("vertices", "leaves", len(planes))).alias("bytes"))


def memory_by_prefix(leaves: DataFrame, planes: list[str], length: int) -> DataFrame:
    """(prefix, vertices, leaves, bytes): the same for every geohash prefix of a length, in one aggregate."""
    own = leaves.withColumn("prefix", F.substring("location", 1, length))
    depth = len(planes) + 1 - F.bit_count(F.grouping_id())
    rolled = own.rollup("prefix", *planes).agg(depth.cast("int").alias("depth")).where("depth > 1")
    out = rolled.groupBy("prefix").agg(F.count(F.lit(1)).alias("vertices"), F.count_if(F.col("depth") == len(planes) + 1).alias("leaves"))
    return out.withColumn("bytes", F.expr(exprs.memory_bytes("vertices", "leaves", len(planes))))


def first_locations(leaves: DataFrame, planes: list[str], length: int) -> DataFrame:
    """(prefix, vertices): each vertex counts for the least location of its leaves, so that the sum is that of the tree."""
    depth = len(planes) - F.bit_count(F.grouping_id())
    own = leaves.withColumn("_at", F.col("location"))
    rolled = own.rollup(*planes).agg(depth.alias("depth"), F.min("_at").alias("first")).where("depth > 0")
    return rolled.groupBy(F.substring("first", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("vertices"))


def hierarchy(leaves: DataFrame, config: SketchConfig = CONFIG) -> list[tuple[int, str, str]]:
    """(plane, name, type) as a leaf table has them; ValueError if it lacks a plane."""
    types = dict(leaves.dtypes)
    if missing := [p for p in config.planes if p not in types]:
        raise ValueError(f"no such plane: {', '.join(missing)}")
    return [(i, p, types[p]) for i, p in enumerate(config.planes)]


def plane_sizes(leaves: DataFrame, planes: list[str]) -> DataFrame:
    """One row: the distinct labels of each plane."""
    return leaves.agg(*[F.count_distinct(p).alias(p) for p in planes])


def fan_out(leaves: DataFrame, planes: list[str]) -> DataFrame:
    """(plane, vertices, edges_out, score): edges to the next plane over vertices."""
    levels = vertices(leaves, planes)
    names = F.create_map(*[x for i, p in enumerate(planes, 1) for x in (F.lit(i), F.lit(p))])
    below = levels.select((F.col("depth") - 1).alias("depth"), F.col("n").alias("edges_out"))
    return levels.join(F.broadcast(below), "depth").select(F.element_at(names, F.col("depth")).alias("plane"), F.col("n").alias("vertices"), "edges_out", (F.col("edges_out") / F.col("n")).alias("score"))


def compact_order(leaves: DataFrame, planes: list[str]) -> list[str]:
    """Planes by ascending fan-out; the last plane stays last. The result of fan_out has a row per plane."""
    scores = {r["plane"]: r["score"] for r in fan_out(leaves, planes).collect()}
    return [*sorted(planes[:-1], key=lambda p: (scores.get(p, 0.0), planes.index(p))), planes[-1]]


def vertex_bounds(sizes: list[int]) -> tuple[int, int]:
    """Vertices of a full tree with planes of these sizes, in ascending and in descending order."""
    def total(order: list[int]) -> int:
        out, at = 0, 1
        for s in order:
            at *= s
            out += at
        return out

    return total(sorted(sizes)), total(sorted(sizes, reverse=True))


def structure(leaves: DataFrame, planes: list[str]) -> DataFrame:
    """One row: leaves, vertices below the root, and 2 * children - 1 summed over vertices with children."""
    levels = vertices(leaves, planes)
    inner = F.sum(F.when(F.col("depth") < len(planes), F.col("n")).otherwise(0)) + 1  # with the root
    total = F.sum("n")
    return levels.agg(F.max(F.when(F.col("depth") == len(planes), F.col("n"))).alias("leaves"), total.alias("descendants"), (2 * total - inner).alias("descendant_edges"))


def fold(leaves: DataFrame, before_ms: int, hours: int, config: SketchConfig = CONFIG, ticks: dict[str, list[float]] | None = None) -> DataFrame:
    """Buckets that end at or before a time are merged into longer ones, and their labels into coarser ticks."""
    old = F.col("time") <= before_ms
    labels: dict[str, Column] = {"time": F.when(old, F.expr(exprs.time_bucket("time", hours))).otherwise(F.col("time"))}
    for f, t in (ticks or {}).items():
        labels[f] = F.when(old, F.expr(exprs.quantize(f, t))).otherwise(F.col(f))
    return regroup(leaves.withColumns(labels), config.planes, config)


def prefix_counts(leaves: DataFrame, length: int) -> DataFrame:
    """(prefix, leaves, rows) per geohash prefix."""
    return leaves.groupBy(F.substring("location", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("rows"))


def write(leaves: DataFrame, path: str, codec: str = "zstd", characters: int = 2) -> None:
    """A snapshot, by the first characters of the location in the partition column p<characters>, so that a prefix query
    reads only its folders. Rebalancing splits folders of very many leaves over tasks and puts small ones together.
    codec: none, gzip, zstd or another of the file format."""
    place = f"p{characters}"
    own = leaves.withColumn(place, F.substring("location", 1, characters)).hint("rebalance", place)
    own.sortWithinPartitions(place, "location", "time").write.mode("overwrite").option("compression", codec).partitionBy(place).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The leaves of a snapshot, with the partition column on which Query prunes."""
    return spark.read.parquet(path)


def write_prefix_counts(leaves: DataFrame, path: str, length: int = 4) -> None:
    """prefix, leaves, rows as CSV files."""
    prefix_counts(leaves, length).write.mode("overwrite").option("header", True).csv(path)


def write_prefix_memory(leaves: DataFrame, planes: list[str], path: str, length: int = 2) -> None:
    """prefix, bytes as CSV files."""
    memory_by_prefix(leaves, planes, length).select("prefix", "bytes").write.mode("overwrite").option("header", True).csv(path)
