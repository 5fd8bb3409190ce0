"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Scratch

ROUNDS = 60


def components(links: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(node, label) for each node of links (a, b): label is the least node of its component. The links stay
    distributed; each round's stars are a written table, so a lost executor costs at most a round. The number of rounds
    grows with the logarithm of a component's diameter."""
    spark = links.sparkSession
    stars = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, before = scratch.table(stars, name), None
    for _ in range(ROUNDS):
        both = stars.union(stars.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.greatest("u", "m").alias("u"), F.least("u", "m").alias("v")).union(small.where("v <> m").select(F.greatest("v", "m"), F.least("v", "m"))).where("u <> v").distinct()
        after = scratch.table(small, name)
        scratch.drop(name, last=2)
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        stars = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("the components did not settle")
    out = stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return out.union(stars.select(F.col("v"), F.col("v")).distinct())
