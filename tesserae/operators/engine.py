"""Queries over leaves, and join-, window- and order-shaped operators."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import exprs, stats
from tesserae.operators import sketch
from tesserae.operators.sketch import CONFIG, SketchConfig
from tesserae.plans.query import Query

_pool = ThreadPoolExecutor(4)


def relational(leaves: DataFrame, q: Query, unknown: str = "raise") -> DataFrame:
    """The leaves of the surviving sub-tree."""
    return leaves.where(q.check(leaves.columns, unknown).predicate())


def tree(leaves: DataFrame, planes: list[str], config: SketchConfig = CONFIG) -> DataFrame:
    """The sub-tree as rows: every path prefix with its depth and merged statistics."""
    depth = len(planes) - F.bit_count(F.grouping_id())
    return leaves.rollup(*planes).agg(depth.alias("depth"), *sketch.merged(config))


def meta(leaves: DataFrame, q: Query, config: SketchConfig = CONFIG, unknown: str = "raise") -> DataFrame:
    """One row: all matching leaves merged."""
    return relational(leaves, q, unknown).agg(*sketch.merged(config))


def synth(leaves: DataFrame, q: Query, config: SketchConfig = CONFIG, unknown: str = "raise") -> DataFrame:
    """The statistics of each matching leaf."""
    return relational(leaves, q, unknown).drop(*config.planes, *[f"p{k}" for k in range(1, 13)])


def count(leaves: DataFrame, q: Query, config: SketchConfig = CONFIG, unknown: str = "raise") -> DataFrame:
    """One row: vertices with the root, and leaves, of the surviving tree."""
    own = sketch.counts(relational(leaves, q, unknown), config.planes)
    return own.select((F.col("vertices") + 1).alias("vertices"), "leaves")


def pruned(leaves: DataFrame, q: Query, config: SketchConfig = CONFIG) -> DataFrame:
    """One row: vertices of the whole tree that the query takes away, and whether anything is left. One rollup: a vertex
    stays if a leaf below it does."""
    depth = len(config.planes) - F.bit_count(F.grouping_id())
    own = leaves.withColumn("_stays", F.coalesce(q.check(leaves.columns).predicate(), F.lit(False)))
    rolled = own.rollup(*config.planes).agg(depth.alias("depth"), F.max("_stays").alias("stays")).where("depth > 0")
    return rolled.agg(F.count_if(~F.col("stays")).alias("pruned"), F.coalesce(F.max("stays"), F.lit(False)).alias("has_results"))


def partition(leaves: DataFrame, q: Query, unknown: str = "raise") -> tuple[DataFrame, DataFrame]:
    """Matching leaves, and the others."""
    own = q.check(leaves.columns, unknown).predicate()
    return leaves.where(own), leaves.where(~F.coalesce(own, F.lit(False)))


def parts(leaves: DataFrame, q: Query, unknown: str = "raise") -> DataFrame:
    """partition() as one table, with the column part: in or out."""
    inside, outside = partition(leaves, q, unknown)
    return inside.withColumn("part", F.lit("in")).unionByName(outside.withColumn("part", F.lit("out")))


Kind = Callable[[DataFrame, Query], DataFrame]
KINDS: dict[str, Kind] = {"relational": relational, "meta": meta, "synthetic": synth, "count": count, "partition": parts}


def register_kind(name: str, run: Kind) -> None:
    """A further kind of query: a function of leaves and a Query."""
    if name in KINDS or name == "memory":
        raise ValueError(f"there is such a kind: {name}")
    KINDS[name] = run


def query(leaves: DataFrame, kind: str, spec: dict, log: Callable[[str], None] | None = None) -> DataFrame:
    """Dispatch by kind; "memory" takes {"prefix": ...}. log gets the query as SQL."""
    if kind == "memory":
        return sketch.memory(leaves, CONFIG.planes, spec.get("prefix"))
    if kind not in KINDS:
        raise ValueError(f"unknown kind of query: {kind}")
    q = Query.from_dict(spec)
    if log:
        log(q.to_sql())
    return KINDS[kind](leaves, q)


def file_log(path: str) -> Callable[[str], None]:
    """Appends a line for each query to a file of the driver."""

    def write(line: str) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.write(line + ";\n")

    return write


class Answers:
    """Collects the answers of several holders to one query; complete when as many as expected have come."""

    def __init__(self, expected: int, callback: Callable[[DataFrame], None] | None = None):
        if expected < 1:
            raise ValueError("a query has at least one holder")
        self.expected, self.callback, self.held = expected, callback, []

    @property
    def complete(self) -> bool:
        return len(self.held) >= self.expected

    def add(self, holder: str, answer: DataFrame) -> bool:
        """Whether the answer was the last one. A holder's second answer is an error, as is one too many."""
        if self.complete or holder in dict(self.held):
            raise ValueError(f"no answer expected from {holder}")
        self.held.append((holder, answer))
        if self.complete and self.callback:
            self.callback(self.rows())
        return self.complete

    def rows(self) -> DataFrame:
        """All answers, one below the other, with the column holder."""
        own = [a.withColumn("holder", F.lit(h)) for h, a in self.held]
        out = own[0]
        for x in own[1:]:
            out = out.unionByName(x)
        return out

    def merged(self, config: SketchConfig = CONFIG) -> DataFrame:
        """One row: the statistics of all answers merged."""
        return self.rows().agg(*sketch.merged(config))


def query_async(leaves: DataFrame, kind: str, spec: dict, callback: Callable[[list], None]) -> Future:
    """Runs a query beside others of the session and hands its rows, an answer for a client, to the callback."""
    return _pool.submit(lambda: callback(query(leaves, kind, spec).collect()))


# --- joins


def as_of_ticks(df: DataFrame, column: str, ticks: list[float]) -> DataFrame:
    """Floor, next and previous tick of a column, without a join."""
    return df.withColumns({"floor_tick": F.expr(exprs.quantize(column, ticks)), "next_tick": F.expr(exprs.next_tick(column, ticks)), "prev_tick": F.expr(exprs.prev_tick(column, ticks))})


def longest_prefix(df: DataFrame, routes: DataFrame, lengths: list[int], location: str = "location") -> DataFrame:
    """df with the route (prefix, target) whose prefix is the longest that the location begins with. An equi-join per
    prefix length, so it scales whatever the size of routes; lengths lists those in use."""
    out = df
    for n in sorted(lengths, reverse=True):
        own = routes.where(F.length("prefix") == n).select(F.col("prefix").alias(f"_p{n}"), F.col("target").alias(f"_t{n}"))
        out = out.join(own, F.substring(location, 1, n) == F.col(f"_p{n}"), "left")
    order = sorted(lengths, reverse=True)
    best = out.withColumns({"prefix": F.coalesce(*[f"_p{n}" for n in order]), "target": F.coalesce(*[f"_t{n}" for n in order])})
    return best.drop(*[f"_{x}{n}" for n in order for x in "pt"])


def routes_for(routes: DataFrame, prefix: str) -> DataFrame:
    """Routes under a prefix; if there are none, those of its longest prefix that has some."""
    under = F.col("prefix").startswith(prefix)
    own = routes.where(under | F.lit(prefix).startswith(F.col("prefix"))).withColumn("rank", F.when(under, 1000).otherwise(F.length("prefix")))
    best = own.agg(F.max("rank").alias("rank"))  # one row
    return own.join(F.broadcast(best), "rank").drop("rank")


def route_depth(routes: DataFrame, prefix: str) -> DataFrame:
    """One row: the length of the longest route that a prefix begins with, 0 if there is none."""
    own = routes.where(F.lit(prefix).startswith(F.col("prefix")))
    return own.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0)).alias("depth"))


def registered(routes: DataFrame, added: DataFrame) -> DataFrame:
    """A registry of prefixes (prefix, target) after others are added; of equal prefixes the added one counts."""
    return routes.join(added.select("prefix").distinct(), "prefix", "left_anti").unionByName(added)


def contrast(leaves: DataFrame, by: list[str], one: Column, other: Column, x: str, y: str, config: SketchConfig = CONFIG) -> DataFrame:
    """Per common label of the planes by: correlation of two features in the leaves of one and of the other region or
    period, and their difference."""

    def side(of: Column, name: str) -> DataFrame:
        return sketch.regroup(leaves.where(of), by, config).select(*by, F.col("n").alias(f"n_{name}"), stats.correlation(x, y).alias(f"r_{name}"))

    both = side(one, "one").join(side(other, "other"), by)
    return both.withColumn("difference", F.col("r_one") - F.col("r_other"))


def with_dimension(leaves: DataFrame, dimension: DataFrame, key: Column, on: str, by: list[str], config: SketchConfig = CONFIG) -> DataFrame:
    """Leaves merged by columns of a dimension table; key is an expression over leaves equal to the dimension's column on."""
    own = leaves.withColumn("_key", key).join(dimension, F.col("_key") == F.col(on))
    return sketch.regroup(own, by, config)


# --- windows


def stable_over(df: DataFrame, by: list[str], order: list[str], value: str, n: int, low: float, high: float) -> DataFrame:
    """Whether the last n values were all at least high (scale_out) or at most low (scale_in), and their mean."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    full = F.count(F.lit(1)).over(w) == n
    return df.withColumns({"scale_out": full & (F.min(value).over(w) >= high), "scale_in": full & (F.max(value).over(w) <= low), "mean": F.avg(value).over(w)})


def rate(df: DataFrame, by: list[str], ts_ms: str) -> DataFrame:
    """Records a second since the one before."""
    before = F.lag(ts_ms).over(Window.partitionBy(*by).orderBy(ts_ms, "obs_id"))
    return df.withColumn("gap_ms", F.col(ts_ms) - before).withColumn("rate", F.when(F.col("gap_ms") > 0, 1000.0 / F.col("gap_ms")))


def cover(loads: DataFrame, key: str, load: str, excess: float) -> DataFrame:
    """The fewest keys whose loads reach the excess: the heaviest first. Loads are one row per region, a small table."""
    w = Window.orderBy(F.col(load).desc(), key)
    before = F.sum(load).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return loads.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < excess).drop("_before")


def best_fit(hosts: DataFrame, required: float, exclude: str, cooldown: int = 2) -> DataFrame:
    """The host with the most free memory, at least required, not excluded and idle for so many updates."""
    own = hosts.where((F.col("free") >= required) & (F.col("host") != exclude) & (F.col("updates") >= cooldown))
    return own.agg(F.max_by("host", F.struct("free", "host")).alias("host"), F.max("free").alias("free"))


def scale_advice(samples: DataFrame, by: list[str], order: list[str], n: int, low: float, high: float, heap: float, used: float = 0.45, keep: float = 0.40) -> DataFrame:
    """samples (backlog, memory) with advice and amount. Memory of at least `used` of the heap comes first: scale out by
    what exceeds `keep` of it. Else a backlog of at least `high` in the last n samples scales out by their mean less
    high, and one of at most `low` scales in by low less their mean."""
    own = stable_over(samples, by, order, "backlog", n, low, high)
    crowded = F.col("memory") >= used * heap
    advice = F.when(crowded, "out: memory").when(F.col("scale_out"), "out: backlog").when(F.col("scale_in"), "in").otherwise("none")
    amount = F.when(crowded, F.col("memory") - keep * heap).when(F.col("scale_out"), F.col("mean") - high).when(F.col("scale_in"), low - F.col("mean"))
    return own.withColumns({"advice": advice, "amount": amount}).drop("scale_out", "scale_in", "mean")


def metric_sums(metrics: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Sums over instances of metrics of which -1 means not set, the instances that hold a prefix, and all instances."""
    own = [F.sum(F.when(F.col(c) != -1, F.col(c))).alias(c) for c in columns]
    return metrics.groupBy(*by).agg(*own, F.count_if(F.col("prefix_count") >= 1).alias("active"), F.count(F.lit(1)).alias("instances"))


def outliers(df: DataFrame, column: str, k: float) -> DataFrame:
    """Rows more than k standard deviations from the mean. The statistics are one row."""
    s = df.agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_std"))
    return df.join(F.broadcast(s), F.abs(F.col(column) - F.col("_mean")) > k * F.col("_std")).drop("_mean", "_std")


def sigma_trim(df: DataFrame, column: str, k: float = 2.0) -> DataFrame:
    """Rows at most k standard deviations from the mean."""
    s = df.agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_std"))
    return df.join(F.broadcast(s), F.abs(F.col(column) - F.col("_mean")) <= k * F.col("_std")).drop("_mean", "_std")


def mad_filter(df: DataFrame, column: str, k: float, accuracy: int | None = None) -> DataFrame:
    """Rows within k median absolute deviations of the median. The exact median holds a column's distinct values in a
    task; accuracy takes an approximate one instead, off by at most a share of 1 / accuracy of the rows' ranks."""
    middle = F.median if accuracy is None else lambda c: F.percentile_approx(c, 0.5, accuracy)
    m = df.agg(middle(column).alias("_median"))
    far = df.join(F.broadcast(m), F.lit(True)).withColumn("_far", F.abs(F.col(column) - F.col("_median")))
    d = far.agg(middle("_far").alias("_mad"))
    return far.join(F.broadcast(d), F.col("_far") <= k * F.col("_mad")).drop("_median", "_far", "_mad")


def route_partition(geohash: str, partitions: int) -> Column:
    """Partition of a geohash from its first bits, the first bit with weight 1."""
    bits = exprs.geohash_bits(geohash, 5)
    return F.expr("(" + " + ".join(f"{b} * CAST({2**i} AS BIGINT)" for i, b in enumerate(bits)) + f") % {partitions}")


def ingest_partition(geohash: str, prefixes: list[str], partitions: int) -> Column:
    """Partition of the first two characters by their place in a list; those not in it follow in order of their code,
    so that the place does not depend on arrival."""
    known = F.create_map(*[F.lit(x) for i, p in enumerate(prefixes) for x in (p, i)]) if prefixes else None
    code = F.expr(exprs.geohash_to_long(f"substr({geohash}, 1, 2)", 2)) + len(prefixes)
    place = F.coalesce(F.element_at(known, F.substring(geohash, 1, 2)).cast("long"), code) if prefixes else code
    return place % partitions
