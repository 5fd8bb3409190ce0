"""Approximate sets, frequencies and quantiles, and synthetic data."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import stats
from tesserae.operators.sketch import CONFIG, SketchConfig


def cardinality(df: DataFrame, by: list[str], column: str, bits: int = 12) -> DataFrame:
    """HyperLogLog sketches per group; they merge by union."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(column, bits).alias("hll"))


def merge_cardinality(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("estimate"))


def _buckets(column: str, rows: int, width: int) -> Column:
    """Per hash function its number and the place of a value."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.struct(i.alias("row"), F.pmod(F.xxhash64(F.col(column), i), F.lit(width)).alias("bucket")))


@dataclass(frozen=True)
class CountMin:
    """A count-min sketch: table (row, bucket, n) of at most rows * width counts, and the number of items. It merges by
    sums. An estimate is never below the count, and above it by more than eps * total with a probability of 1 - confidence."""

    table: DataFrame
    total: DataFrame
    eps: float
    rows: int
    width: int

    def estimate(self, items: DataFrame, column: str) -> DataFrame:
        """items with estimate and bound, what the estimate is at most above the count (with the confidence)."""
        own = items.select(column).distinct().withColumn("_at", F.explode(_buckets(column, self.rows, self.width)))
        own = own.select(column, "_at.row", "_at.bucket").join(self.table, ["row", "bucket"], "left")
        least = own.groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
        return items.join(least, column).crossJoin(F.broadcast(self.total.select((F.lit(self.eps) * F.col("total")).alias("bound"))))


def count_min(df: DataFrame, column: str, eps: float = 0.001, confidence: float = 0.99) -> CountMin:
    rows, width = max(1, math.ceil(-math.log(1 - confidence))), math.ceil(math.e / eps)
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    table = counts.select("n", F.explode(_buckets(column, rows, width)).alias("_at")).groupBy("_at.row", "_at.bucket").agg(F.sum("n").alias("n"))
    return CountMin(table, df.agg(F.count(column).alias("total")), eps, rows, width)


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter: a row (part, bits, set) for each of its parts: its bitmaps in their order, and how many bits are
    set. A hash of a combination names the one part that it is in. A filter of one part is broadcast, others are joined."""

    rows: DataFrame
    size: int
    hashes: int
    parts: int = 1

    def might_contain(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """df with the column might: false for what is surely not in the filter."""
        place = [_place(columns, i, self.size) for i in range(self.hashes)]

        def is_set(p: Column) -> Column:
            at = p % BITMAP
            byte = F.substring(F.get("_bits", F.floor(p / BITMAP).cast("int")), (at / 8).cast("int") + 1, F.lit(1))
            return F.coalesce(F.floor(F.conv(F.hex(byte), 16, 10).cast("int") / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))

        hit = [is_set(p) for p in place]
        bits = self.rows.select(F.col("part").alias("_part"), F.col("bits").alias("_bits"))
        if self.parts == 1:
            own = df.crossJoin(F.broadcast(bits))
        else:
            own = df.withColumn("_part", _part(columns, self.parts)).join(bits.hint("shuffle_hash"), "_part")
        out = hit[0]
        for h in hit[1:]:
            out = out & h
        return own.withColumn("might", out).drop("_part", "_bits")

    def rate(self) -> DataFrame:
        """One row: the rate of false positives that the bits set now give."""
        return self.rows.agg(F.avg(F.pow(F.col("set") / self.size, self.hashes)).alias("rate"))


def _place(columns: list[str], i: int, size: int) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(i)), F.lit(size))


def _part(columns: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(-1)), F.lit(parts)).cast("long")


#: The bits of one of Spark's bitmaps. Fixed value.
BITMAP = 1 << 15
#: A Bloom filter of one part is broadcast; it may have so many bits, 64 MB.
MOST_BITS = 1 << 29
#: One that would have more is cut into parts of about so many bits, 512 KB.
PART_BITS = 1 << 22


def _bits(items: float, fpp: float) -> int:
    """The size of a filter for so many items, in whole bitmaps."""
    return -(-math.ceil(-items * math.log(fpp) / math.log(2) ** 2) // BITMAP) * BITMAP


def bloom(df: DataFrame, columns: list[str], items: int, fpp: float = 0.01, parts: int = 1) -> Bloom:
    """A filter over combinations of values, for so many of them at a rate of false positives. ValueError if a part would
    be too large to broadcast; bloom_of() and members() have no such bound."""
    size = _bits(items / parts, fpp)
    if size > MOST_BITS:
        raise ValueError(f"a filter of {size} bits is too large to broadcast")
    hashes = max(1, round(size / (items / parts) * math.log(2)))
    hashes = min(hashes, 16)
    # bitmaps are numbered through all parts
    own = df.select(_part(columns, parts).alias("part"), F.explode(F.array(*[_place(columns, i, size) for i in range(hashes)])).alias("p"))
    maps = own.groupBy((F.col("part") * (size // BITMAP) + F.floor(F.col("p") / BITMAP)).alias("id")).agg(F.bitmap_construct_agg(F.col("p") % BITMAP).alias("bitmap"))
    every = df.sparkSession.range(parts * (size // BITMAP)).join(maps, "id", "left")
    rows = every.groupBy(F.floor(F.col("id") / (size // BITMAP)).alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "bitmap"))), lambda m: m["bitmap"]).alias("bits"), F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("set")
    )
    return Bloom(rows, size, hashes, parts)


def bloom_of(df: DataFrame, columns: list[str], fpp: float = 0.01) -> Bloom:
    """A filter over all combinations of values in df. They are counted first, so that it keeps to the rate however many
    there are; one too large to broadcast is in parts."""
    own = df.select(*columns).distinct()
    items = max(own.count(), 1)
    bits = _bits(items, fpp)
    return bloom(own, columns, items, fpp, 1 if bits <= MOST_BITS else -(-bits // PART_BITS))


def members(df: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Exact membership."""
    return df.join(known.select(column).distinct(), column, "left_semi")


def quantiles(df: DataFrame, by: list[str], column: str, at: list[float]) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile_approx(column, at, 10_000).alias("quantiles"))


#: Coefficients of the rational approximation to the inverse normal distribution by P. J. Acklam, relative error 1.2e-9,
#: and of formula 7.1.26 of Abramowitz and Stegun for the error function, absolute error 1.5e-7. Fixed values.
INVERSE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
INVERSE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
INVERSE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
INVERSE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ERROR = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _polynomial(coefficients: tuple, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(z: Column) -> Column:
    """Of the standard normal distribution."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    upper = _polynomial(ERROR[::-1], t) * t * F.exp(-x * x) / 2
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def normal_quantile(p: Column) -> Column:
    """The inverse of normal_cdf, for 0 < p < 1."""
    q, low = p - 0.5, 0.02425
    r = q * q
    middle = _polynomial(INVERSE_A, r) * q / (_polynomial(INVERSE_B, r) * r + 1)

    def tail(share: Column) -> Column:
        t = F.sqrt(-2 * F.ln(share))
        return _polynomial(INVERSE_C, t) / (_polynomial(INVERSE_D, t) * t + 1)

    return F.when(p < low, tail(p)).when(p > 1 - low, -tail(1 - p)).otherwise(middle)


def synthesize(leaves: DataFrame, fraction: float = 1.0, booleans: tuple[str, ...] = ("err",), seed: int = 7, config: SketchConfig = CONFIG) -> DataFrame:
    """Rows drawn per leaf and feature from a normal distribution cut to [min, max], n * fraction of each leaf, rounded
    up or down by a hash of its labels so that the total comes out right. Values come from the inverse distribution
    function at a number hashed from the leaf's labels and the row's place in it, so that none is drawn twice and a
    task that is repeated gives the same rows. A leaf without spread gives its mean."""
    # the bounds' places in the distribution are taken once for a leaf, before its rows are made
    for f in config.features:
        leaves = leaves.withColumns({f"_mean_{f}": stats.mean(f), f"_std_{f}": stats.std(f)})
        z = {side: (F.col(f"{side}_{f}") - F.col(f"_mean_{f}")) / F.col(f"_std_{f}") for side in ("min", "max")}
        leaves = leaves.withColumns({f"_{side}_{f}": F.when(F.col(f"_std_{f}") > 0, normal_cdf(x)) for side, x in z.items()})
    share = F.pmod(F.xxhash64(*config.planes, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    rows = _numbered(leaves, F.floor(F.col("n") * fraction + share).cast("int"))
    for k, f in enumerate(config.features):
        u = (F.shiftrightunsigned(F.xxhash64(*config.planes, "_i", F.lit(seed * 1000 + k)), 11) + 0.5) / float(1 << 53)
        p = F.col(f"_min_{f}") + u * (F.col(f"_max_{f}") - F.col(f"_min_{f}"))
        rows = rows.withColumn(f"_p_{f}", F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12)))
    out = []
    for f in config.features:
        drawn = F.col(f"_mean_{f}") + F.col(f"_std_{f}") * normal_quantile(F.col(f"_p_{f}"))
        value = F.when(F.col(f"_std_{f}") > 0, F.least(F.greatest(drawn, F.col(f"min_{f}")), F.col(f"max_{f}"))).otherwise(F.col(f"_mean_{f}"))
        out.append((F.when(value > 0.5, 1.0).otherwise(0.0) if f in booleans else value).alias(f))
    return rows.select("time", "location", *out)


def _numbered(leaves: DataFrame, times: Column) -> DataFrame:
    """Each leaf so many times, numbered in _i."""
    return leaves.withColumn("_i", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))


def split(df: DataFrame, key: str, test: float = 0.05, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, at random by a hash of the key: the same rows whatever the partitions."""
    own = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(test * (1 << 30))
    return df.where(~own), df.where(own)


def forest(train: DataFrame, test: DataFrame, label: str, features: list[str], trees: int = 32, depth: int = 20, bins: int = 32, seed: int = 7) -> DataFrame:
    """RMSE and its relatives of a random-forest regression on the test rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    pack = VectorAssembler(inputCols=features, outputCol="features")
    model = RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed).fit(pack.transform(train))
    return stats.errors(model.transform(pack.transform(test)), label, "prediction")
