"""The registered queries of the sketch engine and their SQL twins.

A name begins with the identifiers of the operators it covers. Sums of doubles are rounded, as engines add in
different orders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import exprs, stats
from tesserae.operators import approx, engine, quantizer, sketch
from tesserae.operators.sketch import CONFIG
from tesserae.plans.base import BUCKET, FS, HASH, LEAF_COLUMNS, LEAF_OUT, MERGED, PLANES, QUERIES, SQL, STATS_OUT, TICKS, WITH, leaves, register, rounded, sums
from tesserae.plans.query import Expr, Query
from tesserae.session import shared_folder
from tesserae.sources.observations import ingest_filter, observations, read_json

# --- scalar functions


def _projected(name: str, columns: dict[str, str], source: str = "obs") -> None:
    """A query of obs_id and SQL expressions over observations that both engines read."""
    register(name, lambda s, d: observations(s, d).select("obs_id", *[F.expr(e).alias(c) for c, e in columns.items()]), WITH + f"SELECT obs_id, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM obs")


_GONE = "CASE WHEN obs_id % 50 <> 0 THEN lat END"
#: A geohash by halving the globe 35 times, as an oracle that shares nothing with the closed form.
_HALVED = """, g AS (SELECT obs_id, CAST(CASE WHEN obs_id % 50 <> 0 THEN lat END AS DOUBLE) AS y, CAST(lon AS DOUBLE) AS x, 0 AS k, CAST(-90 AS DOUBLE) AS s, CAST(90 AS DOUBLE) AS n, CAST(-180 AS DOUBLE) AS w, CAST(180 AS DOUBLE) AS e, 0 AS code, '' AS h FROM obs
UNION ALL SELECT obs_id, y, x, k + 1, CASE WHEN k % 2 = 1 AND y > (s + n) / 2 THEN (s + n) / 2 ELSE s END, CASE WHEN k % 2 = 1 AND NOT y > (s + n) / 2 THEN (s + n) / 2 ELSE n END,
CASE WHEN k % 2 = 0 AND x > (w + e) / 2 THEN (w + e) / 2 ELSE w END, CASE WHEN k % 2 = 0 AND NOT x > (w + e) / 2 THEN (w + e) / 2 ELSE e END,
CASE WHEN k % 5 = 4 THEN 0 ELSE 2 * code + CAST(CASE WHEN k % 2 = 0 THEN x > (w + e) / 2 ELSE y > (s + n) / 2 END AS INT) END,
CASE WHEN k % 5 = 4 THEN h || substr('0123456789bcdefghjkmnpqrstuvwxyz', 2 * code + CAST(CASE WHEN k % 2 = 0 THEN x > (w + e) / 2 ELSE y > (s + n) / 2 END AS INT) + 1, 1) ELSE h END FROM g WHERE k < 35 AND y IS NOT NULL)"""
register(
    "fn01_fn08_geohash",
    lambda s, d: observations(s, d).withColumn("lat", F.expr(_GONE)).select("obs_id", F.expr(HASH).alias("location"), F.expr(exprs.prefix(HASH, 2)).alias("prefix2"), F.expr(exprs.geohash("lat", "lon", 7)).alias("precise")),
    WITH.replace("WITH", "WITH RECURSIVE", 1).rstrip() + _HALVED + " SELECT obs_id, substr(h, 1, 5) AS location, substr(h, 1, 2) AS prefix2, h AS precise FROM g WHERE k = 35 UNION ALL SELECT obs_id, NULL, NULL, NULL FROM g WHERE k = 0 AND y IS NULL",
)
_projected("fn02_geohash_of_box", {"location": exprs.geohash_of_box("(lat - 1)", "(lat + 1)", "(lon - 1)", "(lon + 1)")})
register(
    "fn03_fn07_geohash_codes",
    lambda s, d: observations(s, d).withColumn("h", F.expr(HASH)).select("obs_id", F.expr(exprs.geohash_to_long("h", 5)).alias("code"), F.expr(exprs.geohash_to_long_rev("h", 5)).alias("reversed"), F.bin(F.expr(exprs.geohash_to_long_rev("h", 5))).alias("binary")),
    WITH + f"SELECT obs_id, {exprs.geohash_to_long('h', 5)} AS code, {exprs.geohash_to_long_rev('h', 5)} AS reversed, bin({exprs.geohash_to_long_rev('h', 5)}) AS \"binary\" FROM (SELECT obs_id, {HASH} AS h FROM obs)",
)
_BOX = exprs.geohash_box("h", 5)
register(
    "fn05_geohash_decode",
    lambda s, d: observations(s, d).select("obs_id", F.expr(HASH).alias("h")).select("obs_id", *[F.expr(e).alias(c) for c, e in _BOX.items()]),
    WITH + f"SELECT obs_id, {', '.join(f'{e} AS {c}' for c, e in _BOX.items())} FROM (SELECT obs_id, {HASH} AS h FROM obs)",
)
register(
    "fn06_geohash_bits",
    lambda s, d: observations(s, d).select("obs_id", F.expr(HASH).alias("h")).select("obs_id", F.array_join(F.transform(F.array(*[F.expr(b) for b in exprs.geohash_bits("upper(h)", 5)]), lambda b: F.when(b == 1, "t").otherwise("f")), "").alias("bits")),
    WITH + "SELECT obs_id, list_aggregate(list_transform(range(25), lambda i: CASE WHEN (instr('0123456789bcdefghjkmnpqrstuvwxyz', substr(h, (i // 5 + 1)::INT, 1)) - 1) // (16 >> (i % 5)::INT) % 2 = 1 THEN 't' ELSE 'f' END), 'string_agg', '') AS bits" + f" FROM (SELECT obs_id, {HASH} AS h FROM obs)",
)
_LIST = "[" + ", ".join(map(str, TICKS)) + "]"
register(
    "fn09_fn10_fn13_jn1_ticks",
    lambda s, d: observations(s, d).withColumn("value", F.expr("CASE WHEN obs_id % 40 <> 0 THEN value - 3 END")).select("obs_id", *[F.expr(e).alias(c) for c, e in {"floor_tick": exprs.quantize("value", TICKS), "next_tick": exprs.next_tick("value", TICKS), "prev_tick": exprs.prev_tick("value", TICKS), "first_tick": exprs.first_tick(TICKS), "last_tick": exprs.last_tick(TICKS), "num_ticks": exprs.num_ticks(TICKS)}.items()]),
    WITH + f"SELECT obs_id, CASE WHEN v IS NOT NULL THEN coalesce(list_max(list_filter(t, lambda x: x <= v)), t[1]) END AS floor_tick, list_min(list_filter(t, lambda x: x > v)) AS next_tick, list_max(list_filter(t, lambda x: x < v)) AS prev_tick, t[1] AS first_tick, t[-1] AS last_tick, len(t) AS num_ticks FROM (SELECT obs_id, CASE WHEN obs_id % 40 <> 0 THEN value - 3 END AS v, {_LIST}::DOUBLE[] AS t FROM obs)",
)
_projected("fn11_linear_ticks", {"tick": exprs.quantize("k", exprs.linear_ticks(0.0, 100.0, 2.5))})
register(
    "fn14_ss1_ss3_time_bucket",
    lambda s, d: observations(s, d).select("obs_id", F.expr(BUCKET).alias("bucket"), F.expr(exprs.time_bucket("ms", 1)).alias("hour")),
    WITH + "SELECT obs_id, (ms + 21599999) // 21600000 * 21600000 AS bucket, (ms + 3599999) // 3600000 * 3600000 AS hour FROM obs",
)
register(
    "fn15_arithmetic",
    lambda s, d: observations(s, d).withColumn("big", F.expr("9007199254740993 + ms")).select("obs_id", *[F.expr(e).alias(c) for c, e in {"a": exprs.arithmetic("ms", "+", "floor(value)", "bigint"), "b": exprs.arithmetic("big", "/", "k + 3", "bigint"), "c": exprs.arithmetic("value", "*", "k", "double"), "d": exprs.arithmetic("value", "-", "user_id", "double"), "e": exprs.arithmetic("-ms", "/", "7", "bigint")}.items()]),
    WITH + "SELECT obs_id, ms + CAST(floor(value) AS BIGINT) AS a, (9007199254740993 + ms) // CAST(k + 3 AS BIGINT) AS b, value * k AS c, value - CAST(user_id AS DOUBLE) AS d, -(ms // 7) AS e FROM obs",
)
_SOME = "(CASE WHEN k < 20 THEN NULL ELSE k END)"
_projected("fn16_st1_null_lowest_compare", {"lt": exprs.compare(_SOME, "<", "err"), "le": exprs.compare(_SOME, "<=", "err"), "gt": exprs.compare(_SOME, ">", "err"), "eq": exprs.compare(_SOME, "=", _SOME)})
register(
    "fn17_convert",
    lambda s, d: observations(s, d).select("obs_id", *[F.expr(exprs.convert(v, t, n)).alias(c) for c, v, t, n in (("as_long", "value - 30", "BIGINT", True), ("as_int", "value * 100000000", "INT", True), ("as_double", "event_type", "DOUBLE", False), ("from_text", "concat(user_id, '')", "BIGINT", False))]),
    WITH + "SELECT obs_id, CAST(trunc(value - 30) AS BIGINT) AS as_long, TRY_CAST(trunc(value * 100000000) AS INT) AS as_int, TRY_CAST(event_type AS DOUBLE) AS as_double, user_id AS from_text FROM obs",
)
register("fn19_heat_index", lambda s, d: rounded(observations(s, d).select("obs_id", F.expr(exprs.heat_index("(70 + k / 3)", "(40 + k / 2)")).alias("heat"))), WITH + f"SELECT obs_id, round({exprs.heat_index('(70 + k / 3)', '(40 + k / 2)')}, 4) AS heat FROM obs")
register(
    "fn20_bin_midpoint",
    lambda s, d: observations(s, d).select("obs_id", F.expr(exprs.bin_midpoint("value", TICKS)).alias("mid")),
    WITH + f"SELECT obs_id, CASE WHEN k = len(t) THEN t[k] ELSE (t[k] + t[k + 1]) / 2 END AS mid FROM (SELECT obs_id, t, greatest(len(list_filter(t, lambda x: x <= value)), 1) AS k FROM (SELECT obs_id, value, {_LIST}::DOUBLE[] AS t FROM obs))",
)
_PLACE = exprs.array_place(["i", "j"], [2, 3])
register(
    "fn21_array_get_set",
    lambda s, d: observations(s, d).select("obs_id", F.array("value", "k", "err", "lat", "lon", F.lit(0.0)).cast("array<double>").alias("a"), F.expr("CAST(obs_id % 3 AS INT)").alias("i"), F.expr("CAST(obs_id % 4 AS INT)").alias("j")).withColumn("p", F.expr(_PLACE)).select("obs_id", F.expr(exprs.array_get("a", "p")).alias("got"), F.expr(exprs.array_set("a", "p", "7.0D") + "[0]").alias("set"), F.size(F.array_compact(F.expr(exprs.array_set("a", "p", "CAST(NULL AS DOUBLE)")))).cast("bigint").alias("left"), F.lit(2).cast("bigint").alias("rank"), F.size("a").cast("bigint").alias("size")),
    WITH + "SELECT obs_id, CASE WHEN i < 2 AND j < 3 THEN CASE i * 3 + j WHEN 0 THEN value WHEN 1 THEN k WHEN 2 THEN err WHEN 3 THEN CAST(lat AS DOUBLE) WHEN 4 THEN CAST(lon AS DOUBLE) ELSE 0 END END AS got, CASE WHEN i = 0 AND j = 0 THEN 7 ELSE value END AS set, CASE WHEN i < 2 AND j < 3 THEN 5 ELSE 6 END::BIGINT AS left, 2::BIGINT AS rank, 6::BIGINT AS size FROM (SELECT *, obs_id % 3 AS i, obs_id % 4 AS j FROM obs)",
)
_projected("fn23_strings", {"low": "lower(upper(event_type))", "starts": "event_type LIKE 'e%'", "ends": "event_type LIKE '%k'", "same": "event_type = 'error'"})
register("fn24_utc", lambda s, d: observations(s, d).select("obs_id", F.unix_millis(F.timestamp_millis("ms")).alias("ms"), F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd HH").alias("hour")), WITH + "SELECT obs_id, ms, strftime(epoch_ms(ms), '%Y-%m-%d %H') AS hour FROM obs")
_projected("fn25_units", {"kb": "ms / CAST(1024 AS DOUBLE)", "mb": "ms / CAST(1048576 AS DOUBLE)"})
def _planes(s: SparkSession, d: str) -> DataFrame:
    own = sketch.quantized(observations(s, d)).select("obs_id", *[F.col(f"plane_{p}").alias(p) for p in PLANES])
    exprs.check_types(dict(own.dtypes), {"time": "bigint", "location": "string"} | dict.fromkeys(FS, "double"))
    return own.selectExpr("obs_id", *exprs.leading_planes(own.columns, ["time", "missing", *FS, "location", "also_missing"]))


register("fn26_fn27_planes", _planes, WITH + f"SELECT obs_id, {BUCKET} AS time, CAST(NULL AS DOUBLE) AS missing, {', '.join(f'{exprs.quantize(f, CONFIG.ticks[f])} AS {f}' for f in FS)}, {HASH} AS location FROM obs")

# --- the sketch

register("sk1_leaf_table", lambda s, d: rounded(sketch.build(observations(s, d)).select(*PLANES, *sums())), WITH + f"SELECT {LEAF_OUT} FROM leaves")


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = observations(s, d)
    return sketch.build(o.where("obs_id % 2 = 0")), sketch.build(o.where("obs_id % 2 = 1"))


register("sk2_ag5_merge", lambda s, d: rounded(sketch.merge(*_halves(s, d)).select(*PLANES, *sums())), SQL["sk1_leaf_table"])


def _split(s: SparkSession, d: str) -> DataFrame:
    kept, moved = sketch.split(leaves(s, d), "d")
    return moved.withColumn("part", F.lit("moved")).unionByName(kept.withColumn("part", F.lit("kept"))).groupBy("part").agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("n"))


register("sk3_so3_split_and_union", _split, WITH + "SELECT CASE WHEN location LIKE 'd%' THEN 'moved' ELSE 'kept' END AS part, count(*) AS leaves, sum(n)::BIGINT AS n FROM leaves GROUP BY 1")
_DEPTHS = " UNION ALL ".join(f"SELECT {i} AS depth, count(*) AS n FROM (SELECT DISTINCT {', '.join(PLANES[:i])} FROM leaves)" for i in range(1, len(PLANES) + 1))
register("sk4_d17_vertices", lambda s, d: sketch.vertices(leaves(s, d), PLANES), WITH + f"SELECT * FROM ({_DEPTHS})")
register("sk5_snk5_prefix_counts", lambda s, d: sketch.prefix_counts(leaves(s, d), 4), WITH + "SELECT substr(location, 1, 4) AS prefix, count(*) AS leaves, sum(n)::BIGINT AS rows FROM leaves GROUP BY 1")
_COUNTS = f"SELECT sum(n)::BIGINT AS vertices, max(CASE WHEN depth = {len(PLANES)} THEN n END) AS leaves FROM ({_DEPTHS})"
register("sk7_fn22_memory", lambda s, d: sketch.memory(leaves(s, d), PLANES), WITH + f"SELECT vertices, leaves, {exprs.memory_bytes('vertices', 'leaves', len(PLANES))} AS bytes FROM ({_COUNTS})")
register("sk6_qry8_memory_of_prefix", lambda s, d: engine.query(leaves(s, d), "memory", {"prefix": "d"}), WITH + f"SELECT coalesce(vertices, 0) AS vertices, coalesce(leaves, 0) AS leaves, {exprs.memory_bytes('coalesce(vertices, 0)', 'coalesce(leaves, 0)', len(PLANES))} AS bytes FROM ({_COUNTS.replace('FROM leaves)', chr(70) + 'ROM leaves WHERE location LIKE ' + chr(39) + 'd%' + chr(39) + ')')})")
_BY_PREFIX = " UNION ALL ".join(f"SELECT {i} AS depth, prefix, count(*) AS n FROM (SELECT DISTINCT substr(location, 1, 1) AS prefix, {', '.join(PLANES[:i])} FROM leaves) GROUP BY prefix" for i in range(1, len(PLANES) + 1))
register("snk6_sk6_memory_by_prefix", lambda s, d: sketch.memory_by_prefix(leaves(s, d), PLANES, 1), WITH + f"SELECT prefix, vertices, leaves, {exprs.memory_bytes('vertices', 'leaves', len(PLANES))} AS bytes FROM (SELECT prefix, sum(n)::BIGINT AS vertices, max(CASE WHEN depth = {len(PLANES)} THEN n END) AS leaves FROM ({_BY_PREFIX}) GROUP BY prefix)")
register("sk8_structure", lambda s, d: sketch.structure(leaves(s, d), PLANES), WITH + f"SELECT max(CASE WHEN depth = {len(PLANES)} THEN n END) AS leaves, sum(n)::BIGINT AS descendants, (2 * sum(n) - sum(CASE WHEN depth < {len(PLANES)} THEN n ELSE 0 END) - 1)::BIGINT AS descendant_edges FROM ({_DEPTHS})")
_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
register("sk9_hierarchy", lambda s, d: s.createDataFrame([(i, p, _TYPES[t]) for i, p, t in sketch.hierarchy(leaves(s, d))], "plane int, name string, type string"), WITH + " UNION ALL ".join(f"(SELECT CAST({i} AS INT) AS plane, '{p}' AS name, typeof({p}) AS type FROM leaves LIMIT 1)" for i, p in enumerate(PLANES)))
register("sk10_fan_out", lambda s, d: rounded(sketch.fan_out(leaves(s, d), PLANES)), WITH + f"SELECT p.name AS plane, a.n AS vertices, b.n AS edges_out, round(b.n / CAST(a.n AS DOUBLE), 4) AS score FROM ({_DEPTHS}) a JOIN ({_DEPTHS}) b ON b.depth = a.depth + 1 JOIN (SELECT unnest(range({len(PLANES)})) AS plane, unnest({PLANES!r}) AS name) p ON p.plane = a.depth - 1")
register("sk11_vertex_bounds", lambda s, d: s.createDataFrame([sketch.vertex_bounds(list(sketch.plane_sizes(leaves(s, d), PLANES).first()))], "best long, worst long"), WITH + f", z AS (SELECT list_sort([{', '.join(f'count(DISTINCT {p})' for p in PLANES)}]) AS up FROM leaves), w AS (SELECT up, list_reverse(up) AS down FROM z) SELECT " + ", ".join("(" + " + ".join(" * ".join(f"{side}[{j}]" for j in range(1, i + 1)) for i in range(1, len(PLANES) + 1)) + f")::BIGINT AS {name}" for side, name in (("up", "best"), ("down", "worst"))) + " FROM w")
_MID = 1_705_276_800_000
_FOLD = {"time": f"CASE WHEN time <= {_MID} THEN {exprs.time_bucket('time', 24)} ELSE time END", "value": f"CASE WHEN time <= {_MID} THEN {exprs.quantize('value', [0.0, 50.0, 200.0])} ELSE value END", "k": "k", "err": "err", "location": "location"}
register("sk12_sk13_fold", lambda s, d: rounded(sketch.fold(leaves(s, d), _MID, 24, ticks={"value": [0.0, 50.0, 200.0]}).select(*PLANES, *sums())), WITH + f", folded AS (SELECT {', '.join(f'{e} AS {p}' for p, e in _FOLD.items())}, {MERGED} FROM leaves GROUP BY 1, 2, 3, 4, 5) SELECT {LEAF_OUT} FROM folded".replace("WITH , ", ", "))

# --- predicates and queries

PREDICATES = {
    "pr01_equal": [Expr("k", "==", 20.0)],
    "pr02_not_equal": [Expr("k", "!=", 20.0)],
    "pr03_less": [Expr("value", "<", 50.0)],
    "pr04_less_equal": [Expr("value", "<=", 50.0)],
    "pr05_greater": [Expr("value", ">", 50.0)],
    "pr06_greater_equal": [Expr("value", ">=", 50.0)],
    "pr07_closed_range": [Expr("value", "[]", 25.0, 100.0)],
    "pr08_open_range": [Expr("value", "()", 25.0, 100.0)],
    "pr09_range_from": [Expr("value", "[)", 25.0, 100.0)],
    "pr10_range_upto": [Expr("value", "(]", 25.0, 100.0)],
    "pr11_prefix": [Expr("location", "[=", "d")],
    "pr12_suffix": [Expr("location", "=]", "p")],
    "pr13_or_and": [Expr("k", "=", 10.0), Expr("k", "=", 20.0), Expr("value", "<", 100.0)],
    "pr14_so1_no_condition_on_most": [Expr("err", "=", 1.0), Expr("err", "=", 0.0)],
}


def _predicate(name: str, terms: list[Expr]) -> None:
    q = Query(terms)
    register(name, lambda s, d: engine.relational(leaves(s, d), q).select(*PLANES, "n"), WITH + f"SELECT {', '.join(PLANES)}, n FROM leaves WHERE {q.where()}")


for _name, _terms in PREDICATES.items():
    _predicate(_name, _terms)
Q1 = Query([Expr("location", "[=", "d"), Expr("time", ">", 1_704_672_000_000)])
Q2 = Query([Expr("value", "[)", 10.0, 150.0), Expr("err", "=", 0.0)])
register("pr15_null_labels_never_match", lambda s, d: engine.relational(sketch.build(observations(s, d).withColumn("k", F.when(F.col("k") >= 20, F.col("k"))), strict=False), Query([Expr("k", "<", 50.0)])).agg(F.sum("n").alias("n")), WITH + "SELECT count(*) AS n FROM obs WHERE k >= 20 AND k < 50")
register("pr18_unknown_plane_ignored", lambda s, d: engine.meta(leaves(s, d), Query([Expr("other", "=", 1.0), Expr("err", "=", 1.0)]), unknown="ignore").select("n"), WITH + "SELECT sum(n)::BIGINT AS n FROM leaves WHERE err = 1")
register("pr18_unknown_plane_prunes", lambda s, d: leaves(s, d).agg(F.count(F.lit(1)).alias("n")).crossJoin(engine.relational(leaves(s, d), Query([Expr("other", "=", 1.0), Expr("err", "=", 1.0)]), unknown="prune").agg(F.count(F.lit(1)).alias("kept"))), WITH + "SELECT count(*) AS n, count(*) FILTER (WHERE location IS NULL AND location IS NOT NULL) AS kept FROM leaves")
register("qry1_relational", lambda s, d: rounded(engine.relational(leaves(s, d), Q1).select(*PLANES, *sums())), WITH + f"SELECT {LEAF_OUT} FROM leaves WHERE {Q1.where()}")
register("qry1_tree", lambda s, d: rounded(engine.tree(engine.relational(leaves(s, d), Q2), PLANES).select("depth", *PLANES, *sums())).withColumn("depth", F.col("depth").cast("int")), WITH + f"SELECT depth, {', '.join(PLANES)}, {STATS_OUT} FROM (SELECT CAST({' + '.join(f'(1 - grouping({p}))' for p in PLANES)} AS INT) AS depth, {', '.join(PLANES)}, {MERGED} FROM leaves WHERE {Q2.where()} GROUP BY ROLLUP({', '.join(PLANES)}))")
register("qry2_pruned", lambda s, d: engine.pruned(leaves(s, d), Q2), WITH + f"SELECT ((SELECT sum(n) FROM ({_DEPTHS})) - (SELECT sum(n) FROM ({_DEPTHS.replace('FROM leaves)', 'FROM leaves WHERE ' + Q2.where() + ')')})))::BIGINT AS pruned, EXISTS (SELECT 1 FROM leaves WHERE {Q2.where()}) AS has_results")
register("qry3_meta", lambda s, d: rounded(engine.meta(leaves(s, d), Q1).select(*sums())), WITH + f"SELECT {STATS_OUT} FROM (SELECT {MERGED} FROM leaves WHERE {Q1.where()})")
register("qry4_synth", lambda s, d: rounded(engine.query(leaves(s, d), "synthetic", Q2.to_dict()).select(*sums())), WITH + f"SELECT {STATS_OUT} FROM leaves WHERE {Q2.where()}")
register("qry5_count", lambda s, d: engine.count(leaves(s, d), Q2), WITH + f"SELECT (vertices + 1)::BIGINT AS vertices, leaves FROM ({_COUNTS.replace('FROM leaves)', 'FROM leaves WHERE ' + Q2.where() + ')')})")
register("qry6_so2_jn6_partition", lambda s, d: engine.query(leaves(s, d), "partition", Q2.to_dict()).select("part", *PLANES, "n"), WITH + f"SELECT CASE WHEN {Q2.where()} THEN 'in' ELSE 'out' END AS part, {', '.join(PLANES)}, n FROM leaves")


def _by_sql(s: SparkSession, d: str) -> DataFrame:
    leaves(s, d).createOrReplaceTempView("leaves")
    return s.sql(Query(Q2.terms).to_sql("leaves", ", ".join([*PLANES, "n"])))


register("qry9_as_sql", _by_sql, WITH + Q2.to_sql("leaves", ", ".join([*PLANES, "n"])))

# --- statistics

_DERIVED: dict[str, tuple[Callable[[], Column], str]] = {
    "mean": (lambda: stats.mean("value"), "avg(value)"),
    "min": (lambda: F.col("min_value"), "min(value)"),
    "max": (lambda: F.col("max_value"), "max(value)"),
    "var": (lambda: stats.variance("value"), "var_samp(value)"),
    "std": (lambda: stats.std("value"), "stddev_samp(value)"),
    "pop_var": (lambda: stats.variance("value", 0), "var_pop(value)"),
    "ss_xy": (lambda: stats.cross("value", "k"), "regr_sxy(k, value)"),
    "ss_yy": (lambda: stats.m2("k"), "regr_syy(k, value)"),
    "ss_xx": (lambda: stats.m2("value"), "regr_sxx(k, value)"),
    "r": (lambda: stats.correlation("value", "k"), "corr(k, value)"),
    "r2": (lambda: F.pow(stats.correlation("value", "k"), 2), "regr_r2(k, value)"),
    "slope": (lambda: stats.slope("value", "k"), "regr_slope(k, value)"),
    "intercept": (lambda: stats.intercept("value", "k"), "regr_intercept(k, value)"),
    "predict_50": (lambda: stats.intercept("value", "k") + 50 * stats.slope("value", "k"), "regr_intercept(k, value) + 50 * regr_slope(k, value)"),
    "standard_error": (lambda: stats.standard_error("value"), "sqrt(var_pop(value) * count(*)) / count(*)"),
    "density_50": (lambda: stats.density("value", 50.0), "exp(-power(50 - avg(value), 2) / (2 * var_samp(value))) / sqrt(2 * pi() * var_samp(value))"),
}
register("ag01_ag16_from_leaves", lambda s, d: rounded(sketch.regroup(leaves(s, d), ["err"]).select("err", "n", *[c().alias(k) for k, (c, _) in _DERIVED.items()])), WITH + f"SELECT err, count(*) AS n, {', '.join(f'round({e}, 4) AS {k}' for k, (_, e) in _DERIVED.items())} FROM obs GROUP BY err")
register("ag06_retract", lambda s, d: rounded(sketch.regroup(leaves(s, d), ["err"]).withColumns(stats.retract("value", 1.5)).select("err", *stats.sums(["value"])).drop("min_value", "max_value")), WITH + "SELECT err, count(*) - 1 AS n, round(sum(value) - 1.5, 4) AS s_value, round(sum(value * value) - 2.25, 4) AS q_value FROM obs GROUP BY err")


def _welch(s: SparkSession, d: str) -> DataFrame:
    by = {r["err"]: r for r in sketch.regroup(leaves(s, d), ["err"]).select("err", "n", stats.mean("value").alias("m"), stats.variance("value").alias("v")).collect()}
    a, b = by[0.0], by[1.0]
    return s.createDataFrame([tuple(round(x, 6) for x in stats.welch(a["n"], a["m"], a["v"], b["n"], b["m"], b["v"]))], "t double, df double, p double")


register("ag09_welch_t", lambda s, d: _welch(s, d).drop("p"), WITH + ", g AS (SELECT err, count(*) AS n, avg(value) AS m, var_samp(value) / count(*) AS v FROM obs GROUP BY err) SELECT round((a.m - b.m) / sqrt(a.v + b.v), 6) AS t, round(power(a.v + b.v, 2) / (a.v * a.v / (a.n - 1) + b.v * b.v / (b.n - 1)), 6) AS df FROM g a, g b WHERE a.err = 0 AND b.err = 1")
register("ag09_welch_p", _welch)


def _pearson_p(s: SparkSession, d: str) -> DataFrame:
    rows = sketch.regroup(leaves(s, d), ["err"]).select("err", "n", stats.correlation("value", "k").alias("r")).collect()
    return s.createDataFrame([(r["err"], r["n"], round(r["r"], 6), round(stats.correlation_p(r["r"], r["n"]), 6)) for r in rows if r["r"] is not None and r["n"] > 2], "err double, n long, r double, p double")


register("ag12_pearson_p", _pearson_p)
register("ag17_feature_survey", lambda s, d: rounded(observations(s, d).select(F.expr("stack(2, 'value', value, 'k', k) AS (feature, x)")).groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("most"))), WITH + "SELECT feature, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS least, round(max(x), 4) AS most FROM (SELECT 'value' AS feature, value AS x FROM obs UNION ALL SELECT 'k', k FROM obs) GROUP BY feature")
register("ag18_errors", lambda s, d: rounded(quantizer.midpoint_errors(observations(s, d), "value", TICKS), 6), WITH + f"SELECT round(sqrt(avg(power(value - p, 2))), 6) AS rmse, round(sqrt(avg(power(value - p, 2))) / (max(value) - min(value)), 6) AS nrmse, round(sqrt(avg(power(value - p, 2))) / avg(value), 6) AS cvrmse FROM (SELECT value, {exprs.bin_midpoint('value', TICKS)} AS p FROM obs)")
register("ag19_jn4_tick_errors", lambda s, d: rounded(quantizer.tick_errors(observations(s, d).where("obs_id % 5 <> 0"), observations(s, d).where("obs_id % 5 = 0"), "value", TICKS)), WITH + f", m AS (SELECT {exprs.quantize('value', TICKS)} AS tick, avg(value) AS mean FROM obs WHERE obs_id % 5 <> 0 GROUP BY 1) SELECT tick, count(*) AS n, round(mean, 4) AS mean, round(sqrt(avg(power(value - mean, 2))), 4) AS rmse FROM (SELECT value, {exprs.quantize('value', TICKS)} AS tick FROM obs WHERE obs_id % 5 = 0) JOIN m USING (tick) GROUP BY tick, mean")
register(
    "ag20_kde",
    lambda s, d: rounded(s.createDataFrame(quantizer.kde(observations(s, d), "value", [1.0, 10.0, 50.0, 100.0]), "x double, density double"), 8),
    WITH + ", a AS (SELECT count(value) AS n, min(value) AS lo, (max(value) - min(value)) / 200 AS w, 1.06 * stddev_samp(value) * power(count(value), -0.2) AS h FROM obs), b AS (SELECT least(floor((value - lo) / w), 199) AS b, count(*) AS c FROM obs, a GROUP BY 1) SELECT CAST(x AS DOUBLE) AS x, round(sum(c * exp(-power((x - (lo + (b + 0.5) * w)) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density FROM b, a, (VALUES (1.0), (10.0), (50.0), (100.0)) p(x) GROUP BY x",
)
register("ag21_fit_ticks", lambda s, d: s.createDataFrame([(t,) for t in quantizer.fit_ticks(observations(s, d), "value", 10)], "tick double"))
register("ag22_search_ticks", lambda s, d: s.createDataFrame([(t,) for t in quantizer.search_ticks(observations(s, d), "k", 0.04)], "tick double"))
register("ag23_sampling_plan", lambda s, d: quantizer.sampling_plan(observations(s, d), "obs_id").select("obs_id", "value"), WITH + "SELECT obs_id, value FROM (SELECT obs_id, value, row_number() OVER (ORDER BY obs_id) AS r FROM obs) WHERE r <= 1000 OR obs_id % 50 = 0")
register("ag24_so4_distinct_prefixes", lambda s, d: observations(s, d).agg(F.countDistinct(F.expr(exprs.prefix(HASH, 4))).alias("n")), WITH + f"SELECT count(DISTINCT {exprs.prefix(HASH, 4)}) AS n FROM obs")
register("ag25_record_count", lambda s, d: observations(s, d).agg(F.count(F.lit(1)).alias("n")), WITH + "SELECT count(*) AS n FROM obs")
_METRICS = {"instance": "user_id % 16", "backlog": "CASE WHEN err > 0 THEN -1 ELSE value END", "memory": "CASE WHEN k < 10 THEN -1 ELSE k * 1024 END", "prefix_count": "k % 3", "throughput": "CASE WHEN user_id % 7 = 0 THEN -1 ELSE value * 2 END", "query_throughput": "CASE WHEN k > 90 THEN -1 ELSE k END"}
_SUMMED = ["backlog", "memory", "throughput", "query_throughput"]
register("ag26_metric_sums", lambda s, d: rounded(engine.metric_sums(observations(s, d).select(F.expr(BUCKET).alias("time"), *[F.expr(e).alias(c) for c, e in _METRICS.items()]), ["time"], _SUMMED)), WITH + f"SELECT time, {', '.join(f'round(sum({c}) FILTER (WHERE {c} <> -1), 4) AS {c}' for c in _SUMMED)}, count(*) FILTER (WHERE prefix_count >= 1) AS active, count(*) AS instances FROM (SELECT {BUCKET} AS time, {', '.join(f'{e} AS {c}' for c, e in _METRICS.items())} FROM obs) GROUP BY time")
register("ag27_cardinality_exact", lambda s, d: observations(s, d).groupBy(F.expr(BUCKET).alias("time")).agg(F.countDistinct("user_id").alias("n")), WITH + f"SELECT {BUCKET} AS time, count(DISTINCT user_id) AS n FROM obs GROUP BY 1")
register("ag27_cardinality_hll", lambda s, d: approx.merge_cardinality(approx.cardinality(observations(s, d), ["event_type"], "user_id"), ["event_type"]))
register("ag28_membership_exact", lambda s, d: approx.members(observations(s, d).select("obs_id", "user_id"), observations(s, d).where("err > 0"), "user_id").select("obs_id", "user_id"), WITH + "SELECT obs_id, user_id FROM obs WHERE user_id IN (SELECT user_id FROM obs WHERE err > 0)")
register("ag29_frequency_exact", lambda s, d: observations(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), WITH + "SELECT user_id, count(*) AS n FROM obs GROUP BY 1")


def _frequency(s: SparkSession, d: str) -> DataFrame:
    """Exact counts, and whether the sketch's estimates keep their bound; few may miss it, as the confidence says."""
    obs = observations(s, d)
    exact = obs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    got = approx.count_min(obs, "user_id", 0.001, 0.9999).estimate(exact, "user_id")
    return got.select("user_id", "n", ((F.col("estimate") >= F.col("n")) & (F.col("estimate") <= F.col("n") + F.col("bound"))).alias("kept"))


def _member(s: SparkSession, d: str) -> DataFrame:
    """Combinations of user and k among the errors: how many rows have one, whether the filter misses any, and whether
    its false positives keep to twice the rate asked for, with its own estimate of it. The filter is asked once for a
    combination, and a false positive counts once, however many rows it has."""
    obs = observations(s, d).select("user_id", "k", "err")
    own = approx.bloom_of(obs.where("err > 0"), ["user_id", "k"], 0.01)
    every = obs.groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("err") > 0, F.lit(False)).alias("is_in"))
    rows = own.might_contain(every, ["user_id", "k"])
    n = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (F.col("is_in"), F.col("is_in") & ~F.col("might"))]
    out = rows.agg(n[0].alias("members"), n[1].alias("missed"), (F.count_if(~F.col("is_in") & F.col("might")) <= 0.02 * F.count_if(~F.col("is_in")) + 3).alias("within"))
    return out.crossJoin(own.rate().select((F.col("rate") <= 0.02).alias("rate_within")))


register("ag29_frequency_estimate", _frequency, WITH + "SELECT user_id, count(*) AS n, TRUE AS kept FROM obs GROUP BY 1")
register("ag28_membership_bloom", _member, WITH + "SELECT count(*) AS members, CAST(0 AS BIGINT) AS missed, TRUE AS within, TRUE AS rate_within FROM obs WHERE (user_id, k) IN (SELECT (user_id, k) FROM obs WHERE err > 0)")
register("ag30_density", lambda s, d: rounded(quantizer.mass(leaves(s, d), "value", TICKS), 9), WITH + f"SELECT tick, round(n / total, 9) AS p, round(n / total / (CASE tick {' '.join(f'WHEN {a} THEN {b - a}' for a, b in zip(TICKS, TICKS[1:], strict=False))} END), 9) AS density, round((SELECT coalesce(sum(y.n), 0) FROM (SELECT value AS v, sum(n) AS n FROM leaves GROUP BY 1) y WHERE y.v < tick) / total, 9) AS below FROM (SELECT value AS tick, sum(n)::DOUBLE AS n, (SELECT sum(n) FROM leaves)::DOUBLE AS total FROM leaves GROUP BY 1)")
register("ag30_quantiles", lambda s, d: approx.quantiles(observations(s, d), ["err"], "value", [0.25, 0.5, 0.75]).select("err", *[F.get("quantiles", F.lit(i)).alias(f"q{i}") for i in range(3)]))
register("ag30_quantiles_exact", lambda s, d: rounded(observations(s, d).groupBy("err").agg(F.percentile("value", F.lit(0.5)).alias("median"))), WITH + "SELECT err, round(quantile_cont(value, 0.5), 4) AS median FROM obs GROUP BY err")
register("ag31_outliers", lambda s, d: engine.outliers(observations(s, d), "value", 2.5).select("obs_id", "value"), WITH + "SELECT obs_id, value FROM obs, (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM obs) WHERE abs(value - m) > 2.5 * sd")
#: North of the equator, by the second bit of the location.
_NORTH = exprs.geohash_bits("location", 1)[1]


def _regions(s: SparkSession, d: str) -> DataFrame:
    both = engine.contrast(leaves(s, d), ["time"], F.expr(f"{_NORTH} = 1"), F.expr(f"{_NORTH} = 0"), "value", "k")
    return rounded(both.where("n_one >= 20 and n_other >= 20"))


_CORR = "SELECT {by} AS {name}, count(*) AS n, corr(k, value) AS r FROM obs WHERE {where} GROUP BY 1 HAVING count(*) >= {least}"
_BOTH = "SELECT {name}, o.n AS n_one, round(o.r, 4) AS r_one, p.n AS n_other, round(p.r, 4) AS r_other, round(o.r - p.r, 4) AS difference FROM ({one}) o JOIN ({other}) p USING ({name})"
register("ag33_jn7_region_contrast", _regions, WITH + _BOTH.format(name="time", one=_CORR.format(by=BUCKET, name="time", where="lat > 0", least=20), other=_CORR.format(by=BUCKET, name="time", where="lat < 0", least=20)))
register("ag33_time_contrast", lambda s, d: rounded(engine.contrast(leaves(s, d), ["err"], F.col("time") <= _MID, F.col("time") > _MID, "value", "k").where("n_one >= 5 and n_other >= 5")), WITH + _BOTH.format(name="err", one=_CORR.format(by="err", name="err", where=f"{BUCKET} <= {_MID}", least=5), other=_CORR.format(by="err", name="err", where=f"{BUCKET} > {_MID}", least=5)))
register("ag34_regression_forecast", lambda s, d: rounded(sketch.regroup(leaves(s, d), ["time"]).where("n > 20").select("time", (stats.intercept("value", "k") + 10 * stats.slope("value", "k")).alias("forecast"))), WITH + f"SELECT {BUCKET} AS time, round(regr_intercept(k, value) + 10 * regr_slope(k, value), 4) AS forecast FROM obs GROUP BY 1 HAVING count(*) > 20")

# --- synthesis and learning



def _synthesis(s: SparkSession, d: str) -> DataFrame:
    """The size of a synthetic half, whether it keeps the bounds of the data, and whether its mean is near theirs."""
    made = approx.synthesize(leaves(s, d), 0.5).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.count_if(~F.col("err").isin(0.0, 1.0)).alias("odd"))
    real = leaves(s, d).agg(*sketch.merged(CONFIG)).select(F.col("n").alias("rows"), "min_value", "max_value", stats.mean("value").alias("real"), stats.std("value").alias("sd"))
    return made.crossJoin(real).select((F.abs(F.col("n") - F.col("rows") / 2) <= 3 * F.sqrt("rows")).alias("sized"), ((F.col("lo") >= F.col("min_value")) & (F.col("hi") <= F.col("max_value"))).alias("bounded"), (F.abs(F.col("mean") - F.col("real")) <= 5 * F.col("sd") / F.sqrt("n")).alias("near"), "odd", "rows")


register("ml1_ml2_ml3_synthesis", _synthesis, WITH + "SELECT TRUE AS sized, TRUE AS bounded, TRUE AS near, CAST(0 AS BIGINT) AS odd, count(*) AS rows FROM obs")
register("ml4_ml5_forest", lambda s, d: approx.forest(*approx.split(observations(s, d), "obs_id", 0.05), "value", ["k", "err"]))

# --- joins, windows, order

_ROUTES = [("d", "a"), ("d1", "b"), ("7", "c"), ("7z", "d"), ("7zz", "e")]
_ROUTES_SQL = "(VALUES " + ", ".join(f"('{p}', '{t}')" for p, t in _ROUTES) + ") r(prefix, target)"


def _routes(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_ROUTES, "prefix string, target string")


register("jn2_ss7_wn5_longest_prefix", lambda s, d: engine.longest_prefix(observations(s, d).select("obs_id", F.expr(HASH).alias("location")), _routes(s), [1, 2, 3]), WITH + f"SELECT obs_id, location, prefix, target FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY length(prefix) DESC) AS r FROM (SELECT obs_id, {HASH} AS location FROM obs) o LEFT JOIN {_ROUTES_SQL} ON o.location LIKE r.prefix || '%') WHERE r = 1")
_ASKED = ["7z", "7", "d1x", "9q", "7zzz"]
register("jn3_prefix_containment", lambda s, d: reduce(DataFrame.unionByName, [engine.routes_for(_routes(s), p).select(F.lit(p).alias("asked"), "prefix", "target") for p in _ASKED]), " UNION ALL ".join(f"SELECT '{p}' AS asked, prefix, target FROM {_ROUTES_SQL} WHERE prefix LIKE '{p}%' OR (NOT EXISTS (SELECT 1 FROM {_ROUTES_SQL} WHERE prefix LIKE '{p}%') AND prefix = (SELECT max(prefix) FROM {_ROUTES_SQL} WHERE '{p}' LIKE prefix || '%'))" for p in _ASKED))
register("ss12_prefix_registry", lambda s, d: reduce(DataFrame.unionByName, [engine.route_depth(engine.registered(_routes(s), s.createDataFrame([("7zz", "f"), ("9q", "g")], "prefix string, target string")), p).select(F.lit(p).alias("asked"), F.col("depth").cast("bigint").alias("depth")) for p in _ASKED]), " UNION ALL ".join(f"SELECT '{p}' AS asked, coalesce(max(length(prefix)), 0) AS depth FROM (SELECT prefix FROM {_ROUTES_SQL} UNION SELECT '9q') r WHERE '{p}' LIKE prefix || '%'" for p in _ASKED))
register("jn5_positional_zip", lambda s, d: rounded(observations(s, d).select("obs_id", "value").join(observations(s, d).select("obs_id", (F.col("value") + F.col("err")).alias("predicted")), "obs_id").agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col("predicted"), 2))).alias("rmse"))), WITH + "SELECT round(sqrt(avg(power(err, 2))), 4) AS rmse FROM obs")


def _dimension(s: SparkSession, d: str) -> DataFrame:
    """Leaves by region and nation: a nation's key is the value of the location's first character, as a stand-in for a
    gazetteer of places."""
    read = lambda t: s.read.parquet(f"{d}/{t}.parquet")
    places = read("nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", "n_regionkey").join(read("region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = engine.with_dimension(leaves(s, d), places, F.expr(exprs.geohash_digit("location", 1)), "n_nationkey", ["r_name", "n_name"])
    return rounded(out.select("r_name", "n_name", "n", stats.mean("value").alias("mean"), stats.correlation("value", "k").alias("r")).where("n > 20"), 8)


register("jn8_dimension_join", _dimension, WITH + f"SELECT r_name, n_name, count(*) AS n, round(avg(value), 8) AS mean, round(corr(k, value), 8) AS r FROM obs JOIN nation ON n_nationkey = instr('{exprs.ALPHABET}', substr({HASH}, 1, 1)) - 1 JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2 HAVING count(*) > 20")
register("wn1_neighbour_ticks", lambda s, d: engine.as_of_ticks(observations(s, d).select("obs_id", "k"), "k", CONFIG.ticks["k"]).select("obs_id", "floor_tick", "next_tick", "prev_tick"), WITH + f"SELECT obs_id, {exprs.quantize('k', CONFIG.ticks['k'])} AS floor_tick, {exprs.next_tick('k', CONFIG.ticks['k'])} AS next_tick, {exprs.prev_tick('k', CONFIG.ticks['k'])} AS prev_tick FROM obs")
_W = "OVER (PARTITION BY user_id ORDER BY ms, obs_id ROWS 3 PRECEDING)"
register("wn2_wn3_ss11_stable_over", lambda s, d: rounded(engine.stable_over(observations(s, d), ["user_id"], ["ms", "obs_id"], "value", 4, 5.0, 40.0).select("obs_id", "scale_out", "scale_in", "mean")), WITH + f"SELECT obs_id, count(*) {_W} = 4 AND min(value) {_W} >= 40 AS scale_out, count(*) {_W} = 4 AND max(value) {_W} <= 5 AS scale_in, round(avg(value) {_W}, 4) AS mean FROM obs")
register("wn4_rate", lambda s, d: rounded(engine.rate(observations(s, d), ["user_id"], "ms").select("obs_id", "gap_ms", "rate"), 6), WITH + "SELECT obs_id, gap_ms, round(CASE WHEN gap_ms > 0 THEN CAST(1000.0 AS DOUBLE) / gap_ms END, 6) AS rate FROM (SELECT obs_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, obs_id) AS gap_ms FROM obs)")
register("st2_st6_ordered_prefixes", lambda s, d: leaves(s, d).groupBy(F.substring("location", 1, 2).alias("prefix")).agg(F.sum("n").alias("n")).orderBy("prefix"), WITH + "SELECT substr(location, 1, 2) AS prefix, sum(n)::BIGINT AS n FROM leaves GROUP BY 1 ORDER BY 1")
register("st3_top_consumer", lambda s, d: observations(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(1), WITH + "SELECT user_id, count(*) AS n FROM obs GROUP BY 1 ORDER BY n DESC, user_id LIMIT 1")
register("st4_best_fit_host", lambda s, d: rounded(engine.best_fit(observations(s, d).groupBy(F.col("user_id").cast("string").alias("host")).agg(F.max("value").alias("free"), F.count(F.lit(1)).alias("updates")), 10.0, "7")), WITH + "SELECT host, round(free, 4) AS free FROM (SELECT CAST(user_id AS VARCHAR) AS host, max(value) AS free, count(*) AS updates FROM obs GROUP BY 1) WHERE free >= 10 AND host <> '7' AND updates >= 2 ORDER BY free DESC, host DESC LIMIT 1")
register("st5_order_by_start", lambda s, d: observations(s, d).groupBy("event_type").agg(F.min("ms").alias("start")).orderBy("start"), WITH + "SELECT event_type, min(ms) AS start FROM obs GROUP BY 1 ORDER BY 2")
register("st7_cover_excess", lambda s, d: engine.cover(observations(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "n", 300), WITH + "SELECT user_id, n FROM (SELECT user_id, n, coalesce(sum(n) OVER (ORDER BY n DESC, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT user_id, count(*) AS n FROM obs GROUP BY 1)) WHERE b < 300")
register("st8_mad_filter", lambda s, d: engine.mad_filter(observations(s, d).select("obs_id", "value"), "value", 2.0).select("obs_id", "value"), WITH + "SELECT obs_id, value FROM obs WHERE abs(value - (SELECT median(value) FROM obs)) <= 2 * (SELECT median(abs(value - (SELECT median(value) FROM obs))) FROM obs)")
register("ss5_ux7_route_partition", lambda s, d: observations(s, d).select("obs_id", F.expr(HASH).alias("h")).select("obs_id", engine.route_partition("h", 8).alias("part")), WITH + f"SELECT obs_id, ({' + '.join(f'{b} * CAST({2**i} AS BIGINT)' for i, b in enumerate(exprs.geohash_bits('h', 5)))}) % 8 AS part FROM (SELECT obs_id, {HASH} AS h FROM obs)")
register("ss9_deduplicate", lambda s, d: observations(s, d).union(observations(s, d).where("obs_id % 3 = 0")).dropDuplicates(["obs_id"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")), WITH + "SELECT count(*) AS n, round(sum(value), 4) AS total FROM obs")
register("src7_ux4_ingest_filter", lambda s, d: sketch.build(ingest_filter(observations(s, d), F.col("event_type") != "view")).agg(F.sum("n").alias("n")), WITH + "SELECT count(*) AS n FROM obs WHERE event_type <> 'view'")


def _snapshot(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "snapshot")
    sketch.write(leaves(s, d), path, codec="gzip")
    return engine.relational(sketch.read(s, path), Query([Expr("location", "[=", "d1")])).select(*PLANES, "n")


register("src10_snk2_snk7_ss13_snapshot", _snapshot, WITH + f"SELECT {', '.join(PLANES)}, n FROM leaves WHERE location LIKE 'd1%'")


def _json(s: SparkSession, d: str) -> DataFrame:
    """A line in ten is broken."""
    path = shared_folder(s, "json")
    line = F.to_json(F.struct("obs_id", "value"))
    observations(s, d).select(F.when(F.col("obs_id") % 10 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return read_json(s, path, "obs_id long, value double")


register("src8_src9_json", _json, WITH + "SELECT obs_id, value FROM obs WHERE obs_id % 10 <> 0")

from tesserae.plans import more  # noqa: E402, F401  (registers its queries as well)
