"""Registered queries of sources, sinks, dispatch, workloads, the SQL surface and placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import exprs, stats
from tesserae.operators import engine, sketch
from tesserae.operators.sketch import CONFIG
from tesserae.plans import surface, workload
from tesserae.plans.base import BUCKET, HASH, MERGED, PLANES, STATS_OUT, WITH, leaves, register, rounded, sums
from tesserae.plans.query import Expr, Query
from tesserae.session import shared_folder
from tesserae.sources import observations as src
from tesserae.sources.observations import observations

Q = Query([Expr("value", "[)", 10.0, 150.0), Expr("err", "=", 0.0)])

# --- functions

_BUILT = exprs.Quantizer.linear(0.0, 100.0, 25.0).add(10.0, 60.0).remove(50.0)
_IN = "[" + ", ".join(map(str, _BUILT.ticks)) + "]::DOUBLE[]"
register("fn12_quantizer_builder", lambda s, d: observations(s, d).select("obs_id", F.expr(_BUILT.quantize("k")).alias("tick"), F.expr(_BUILT.next("k")).alias("above")), WITH + f"SELECT obs_id, list_max(list_filter({_IN}, lambda t: t <= k)) AS tick, list_min(list_filter({_IN}, lambda t: t > k)) AS above FROM obs")


def _primitives(s: SparkSession, d: str) -> DataFrame:
    """The types that plain values of a small table get, and how many there are of each."""
    rows = [tuple(r) for r in s.read.parquet(f"{d}/nation.parquet").selectExpr("CAST(n_nationkey AS INT) AS a", "n_name AS b", "n_regionkey / 2.0D AS c", "9000000000 + n_nationkey AS e").collect()]
    own = src.from_values(s, ["a", "b", "c", "e"], rows)
    return own.agg(*[F.count(c).alias(f"n_{c}") for c in own.columns], *[F.lit(t).alias(f"type_{c}") for c, t in own.dtypes])


register("fn18_from_primitive", _primitives, "SELECT count(n_nationkey) AS n_a, count(n_name) AS n_b, count(n_regionkey) AS n_c, count(n_nationkey) AS n_e, 'int' AS type_a, 'string' AS type_b, 'double' AS type_c, 'bigint' AS type_e FROM nation")
register("fn22_memory_of_leaves", lambda s, d: leaves(s, d).groupBy("err").agg(F.count(F.lit(1)).alias("leaves")).select("err", F.expr(exprs.memory_bytes("leaves", "leaves", len(PLANES))).alias("bytes")), WITH + "SELECT err, count(*) * (16 + 8 + 32 * 5 + 8 * 10) AS bytes FROM leaves GROUP BY err")

# --- sources and sinks


def _blobs(s: SparkSession, d: str) -> DataFrame:
    """Observations written as files of a year each and read back, strings and arrays included."""
    root = shared_folder(s, "blobs")
    own = observations(s, d).select("lat", "lon", F.concat(F.lit("o"), "obs_id").alias("name"), F.col("ms").alias("time_start"), (F.col("ms") + 1).alias("time_end"), F.create_map(F.lit("value"), "value", F.lit("k"), "k").alias("features"), F.create_map(F.lit("type"), "event_type").alias("texts"), F.create_map(F.lit("grid"), F.struct(F.array(F.lit(1), F.lit(2)).alias("dims"), F.array("value", "err").alias("data"))).alias("arrays"))
    for year, part in ((2014, 0), (2015, 1)):
        src.write_blobs(own.where(F.expr(f"time_start % 2 = {part}")), f"{root}/year={year}").agg(F.sum("n_records")).collect()
    got = src.read_blobs(s, root, as_long=True)
    return got.select(F.expr("CAST(substr(name, 2) AS BIGINT)").alias("obs_id"), F.col("year").cast("bigint").alias("year"), "time_start", "time_end", "location", "location_code", F.col("features")["value"].alias("value"), F.col("texts")["type"].alias("event_type"), F.col("arrays")["grid"]["data"][1].alias("err"), F.size(F.col("arrays")["grid"]["dims"]).cast("bigint").alias("dims"))


register("src1_src2_src4_snk1_blobs", _blobs, WITH + f"SELECT obs_id, (2014 + ms % 2)::BIGINT AS year, ms AS time_start, ms + 1 AS time_end, {HASH} AS location, {exprs.geohash_to_long(HASH, 5)} AS location_code, value, event_type, err, 2::BIGINT AS dims FROM obs")


def _points(s: SparkSession, d: str) -> DataFrame:
    """Lines of points, one in seven with another number of blanks, as geohashes of nine characters."""
    path = shared_folder(s, "points")
    blanks = F.when(F.col("obs_id") % 7 == 0, "  ").otherwise("   ")
    observations(s, d).select(F.concat(F.col("lat").cast("string"), blanks, F.col("lon").cast("string"))).write.text(path)
    return src.read_points(s, path, 9).groupBy("location").agg(F.count(F.lit(1)).alias("n"))


register("src3_points", _points, WITH + f"SELECT {exprs.geohash('lat', 'lon', 9)} AS location, count(*) AS n FROM obs WHERE obs_id % 7 <> 0 GROUP BY 1")


def _prefix_only(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "prefixes")
    observations(s, d).select(F.concat_ws("   ", F.col("lat").cast("string"), F.col("lon").cast("string"))).write.text(path)
    return src.read_points(s, path, prefix_only=2).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


register("src3_prefix_only", _prefix_only, WITH + f"SELECT {exprs.geohash('lat', 'lon', 2)} AS prefix, count(*) AS n FROM obs GROUP BY 1")
register("src6_sine_load", lambda s, d: observations(s, d).select("obs_id", F.expr(src.sine_delay("ms", 3_600_000)).alias("delay_ms")), WITH + "SELECT obs_id, CAST(round(3 + 4.5 * (1 - sin(2 * pi() * (ms % 3600000) / 3600000))) AS BIGINT) AS delay_ms FROM obs")


def _dump(s: SparkSession, d: str, what: str) -> DataFrame:
    path = shared_folder(s, what)
    if what == "counts":
        sketch.write_prefix_counts(leaves(s, d), path)
        return s.read.option("header", True).schema("prefix string, leaves long, rows long").csv(path)
    sketch.write_prefix_memory(leaves(s, d), PLANES, path, 2)
    return s.read.option("header", True).schema("prefix string, bytes long").csv(path)


_BY_TWO = " UNION ALL ".join(f"SELECT {i} AS depth, prefix, count(*) AS n FROM (SELECT DISTINCT substr(location, 1, 2) AS prefix, {', '.join(PLANES[:i])} FROM leaves) GROUP BY prefix" for i in range(1, len(PLANES) + 1))
register("snk5_prefix_counts_csv", lambda s, d: _dump(s, d, "counts"), WITH + "SELECT substr(location, 1, 4) AS prefix, count(*) AS leaves, sum(n)::BIGINT AS rows FROM leaves GROUP BY 1")
register("snk6_prefix_memory_csv", lambda s, d: _dump(s, d, "memory"), WITH + f"SELECT prefix, (16 * sum(n) + {8 + 32 * len(PLANES) + 4 * len(PLANES) * (len(PLANES) - 1)} * max(CASE WHEN depth = {len(PLANES)} THEN n END))::BIGINT AS bytes FROM ({_BY_TWO}) GROUP BY prefix")
register("sk5_first_locations", lambda s, d: sketch.first_locations(leaves(s, d), PLANES, 2), WITH + "SELECT substr(first, 1, 2) AS prefix, count(*) AS vertices FROM (" + " UNION ALL ".join(f"SELECT min(place) AS first FROM (SELECT *, location AS place FROM leaves) GROUP BY {', '.join(PLANES[:i])}" for i in range(1, len(PLANES) + 1)) + ") GROUP BY 1")
register("sk5_remove_prefix", lambda s, d: sketch.prefix_counts(sketch.split(leaves(s, d), "d")[0], 2), WITH + "SELECT substr(location, 1, 2) AS prefix, count(*) AS leaves, sum(n)::BIGINT AS rows FROM leaves WHERE location NOT LIKE 'd%' GROUP BY 1")

# --- dispatch, answers, logs, workloads


def _dispatch(s: SparkSession, d: str) -> DataFrame:
    """How many rows each kind of query answers with."""
    own = leaves(s, d)
    out = None
    for kind in ("relational", "meta", "synthetic", "count", "partition"):
        row = engine.query(own, kind, Q.to_dict()).agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out.unionByName(engine.query(own, "memory", {"prefix": "d"}).agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit("memory")))


register("qry7_dispatch", _dispatch, WITH + f"SELECT 'relational' AS kind, count(*) AS rows FROM leaves WHERE {Q.where()} UNION ALL SELECT 'synthetic', count(*) FROM leaves WHERE {Q.where()} UNION ALL SELECT 'partition', count(*) FROM leaves UNION ALL SELECT k, 1 FROM (VALUES ('meta'), ('count'), ('memory')) t(k)")


def _assembled(s: SparkSession, d: str) -> DataFrame:
    """The answers of 32 holders, each of the leaves under a character, merged into one."""
    own, holders = leaves(s, d), list(exprs.ALPHABET)
    answers = engine.Answers(len(holders))
    for h in holders:
        answers.add(h, engine.meta(own.where(F.col("location").startswith(h)), Q))
    return rounded(answers.merged().select(*sums()))


register("qry13_answers", _assembled, WITH + f"SELECT {STATS_OUT} FROM (SELECT {MERGED} FROM leaves WHERE {Q.where()})")


def _logged(s: SparkSession, d: str) -> DataFrame:
    """The SQL that queries leave in the log, run again."""
    lines: list[str] = []
    engine.query(leaves(s, d), "relational", Q.to_dict(), log=lines.append)
    leaves(s, d).createOrReplaceTempView("leaves")
    return s.sql(lines[0]).select(*PLANES, "n")


register("snk8_query_log", _logged, WITH + f"SELECT {', '.join(PLANES)}, n FROM leaves WHERE {Q.where()}")
_LOAD = workload.generate(24, workload.prefixes(1), seed=11, least=2) + workload.generate(24, workload.prefixes(2, "d") + workload.prefixes(2, "7"), seed=12)
_KINDS = workload.mix({"relational": 60, "meta": 30, "count": 10}, len(_LOAD), seed=5)
register("qry10_qry11_workload", lambda s, d: workload.matches(leaves(s, d), _LOAD).join(F.broadcast(s.createDataFrame(list(enumerate(_KINDS)), "query int, kind string")), "query"), WITH + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS query, count(*) AS leaves, sum(n)::BIGINT AS rows, '{k}' AS kind FROM leaves WHERE {q.where()} HAVING count(*) > 0" for i, (q, k) in enumerate(zip(_LOAD, _KINDS, strict=True))))

# --- the SQL surface

_TEXT = "SELECT MEAN(value), MAX(k), COUNT(), CORRELATION(value, k) WHERE value > MEAN(value) + 0.5 * STD(value) AND k >= 10 AND CORRELATION(value, k) < 0.02 GROUP BY err, time"
_DICT = {"select": ["MEAN(value)", "STD(k)", "COUNT()"], "where": {"location": {"LIKE": "d%"}, "value": {">": "MEAN(value)"}, "COUNT()": {">=": 3}}, "group": ["time"]}
register("qry12_sql_surface", lambda s, d: rounded(surface.run(leaves(s, d), _TEXT), 8), WITH + f", w AS (SELECT avg(value) + 0.5 * stddev_samp(value) AS bound FROM obs) SELECT err, time, round(mean_value, 8) AS mean_value, max_k, count, round(correlation_value_k, 8) AS correlation_value_k FROM (SELECT err, {BUCKET} AS time, avg(value) AS mean_value, max(k) AS max_k, count(*) AS count, corr(k, value) AS correlation_value_k FROM obs, w WHERE {exprs.quantize('value', CONFIG.ticks['value'])} > bound AND {exprs.quantize('k', CONFIG.ticks['k'])} >= 10 GROUP BY 1, 2) WHERE correlation_value_k < 0.02")
register("qry12_dict_form", lambda s, d: rounded(surface.run(leaves(s, d), _DICT), 8), WITH + f", w AS (SELECT avg(value) AS bound FROM obs) SELECT {BUCKET} AS time, round(avg(value), 8) AS mean_value, round(stddev_samp(k), 8) AS std_k, count(*) AS count FROM obs, w WHERE {HASH} LIKE 'd%' AND {exprs.quantize('value', CONFIG.ticks['value'])} > bound GROUP BY 1 HAVING count(*) >= 3")

# --- statistics, order, placement

register("ag07_light_statistics", lambda s, d: rounded(sketch.regroup(leaves(s, d), ["k"]).select("k", "n", stats.mean("value").alias("mean"), stats.variance("value").alias("var")).where("n > 2"), 6), WITH + f"SELECT {exprs.quantize('k', CONFIG.ticks['k'])} AS k, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS var FROM obs GROUP BY 1 HAVING count(*) > 2")
register("ux2_extra_statistic", lambda s, d: sketch.merge(*[sketch.build(observations(s, d).where(f"obs_id % 2 = {i}"), _EXTRA) for i in (0, 1)], config=_EXTRA).groupBy("err").agg(F.sum("views").alias("views"), F.max("last_ms").alias("last_ms")), WITH + "SELECT err, count(*) FILTER (WHERE event_type = 'view') AS views, max(ms) AS last_ms FROM obs GROUP BY err")
_EXTRA = sketch.SketchConfig(CONFIG.ticks, extra=(stats.Extra("views", "count_if(event_type = 'view')", "sum(views)"), stats.Extra("last_ms", "max(ms)", "max(last_ms)")))
register("ux3_registered_kind", lambda s, d: engine.query(leaves(s, d), "heaviest", Q.to_dict()), WITH + f"SELECT location, n FROM (SELECT location, sum(n)::BIGINT AS n FROM leaves WHERE {Q.where()} GROUP BY 1) ORDER BY n DESC, location LIMIT 5")


def _heaviest(own: DataFrame, q: Query) -> DataFrame:
    """The five locations with the most rows."""
    return engine.relational(own, q).groupBy("location").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "location").limit(5)


engine.register_kind("heaviest", _heaviest)
_PARTLY = "CASE WHEN obs_id % 5 <> 0 THEN value END"
register("st1_nulls_first", lambda s, d: observations(s, d).select("obs_id", "user_id", F.expr(_PARTLY).alias("v")).select("obs_id", F.row_number().over(_order()).cast("bigint").alias("place")), WITH + f"SELECT obs_id, row_number() OVER (PARTITION BY user_id ORDER BY {_PARTLY} ASC NULLS FIRST, obs_id) AS place FROM obs")


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy(F.asc_nulls_first("v"), "obs_id")


register("st8_sigma_trim", lambda s, d: engine.sigma_trim(observations(s, d).select("obs_id", "value"), "value").select("obs_id", "value"), WITH + "SELECT obs_id, value FROM obs, (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM obs) WHERE abs(value - m) <= 2 * sd")
_SEED = ["d1", "7z", "s0", "9q"]
register("ss5_ingest_partition", lambda s, d: observations(s, d).select("obs_id", F.expr(HASH).alias("h")).select("obs_id", engine.ingest_partition("h", _SEED, 6).alias("part")), WITH + f"SELECT obs_id, (CASE substr(h, 1, 2) {' '.join(f'WHEN {chr(39)}{p}{chr(39)} THEN {i}' for i, p in enumerate(_SEED))} ELSE 4 + (instr('{exprs.ALPHABET}', substr(h, 1, 1)) - 1) * 32 + instr('{exprs.ALPHABET}', substr(h, 2, 1)) - 1 END) % 6 AS part FROM (SELECT obs_id, {HASH} AS h FROM obs)")
_WIN = "OVER (PARTITION BY user_id ORDER BY ms, obs_id ROWS 2 PRECEDING)"
register("ss11_scale_advice", lambda s, d: rounded(engine.scale_advice(observations(s, d).select("obs_id", "user_id", "ms", F.col("value").alias("backlog"), F.col("k").alias("memory")), ["user_id"], ["ms", "obs_id"], 3, 10.0, 30.0, 200.0).select("obs_id", "advice", "amount")), WITH + f"SELECT obs_id, CASE WHEN k >= 90 THEN 'out: memory' WHEN full3 AND lo >= 30 THEN 'out: backlog' WHEN full3 AND hi <= 10 THEN 'in' ELSE 'none' END AS advice, round(CASE WHEN k >= 90 THEN k - 80 WHEN full3 AND lo >= 30 THEN m - 30 WHEN full3 AND hi <= 10 THEN 10 - m END, 4) AS amount FROM (SELECT obs_id, k, count(*) {_WIN} = 3 AS full3, min(value) {_WIN} AS lo, max(value) {_WIN} AS hi, avg(value) {_WIN} AS m FROM obs)")
