"""Hand-computed cases, invariants of the sketch, sources and streams."""

import math

import pytest
from pyspark.sql import functions as F

from tesserae.functions import exprs, stats
from tesserae.operators import approx, engine, quantizer, sketch
from tesserae.operators.sketch import CONFIG, SketchConfig
from tesserae.plans.query import Expr, Query
from tesserae.sources import observations as src
from tesserae.streaming import stream

SF = "/root/testdata/sf0.001"


def one(spark, sql):
    return spark.sql(f"SELECT {sql} AS x").first()["x"]


@pytest.mark.parametrize("lat, lon, want", [(0, 0, "7zzzz"), (-90, -180, "00000"), (90, 180, "zzzzz")])
def test_geohash_corners_and_ties(spark, lat, lon, want):
    assert one(spark, exprs.geohash(f"CAST({lat} AS FLOAT)", f"CAST({lon} AS FLOAT)")) == want


def test_geohash_round_trip(spark):
    box = exprs.geohash_box("'9xj5s'", 5)
    lo, hi, west, east = (one(spark, box[k]) for k in ("lat_lo", "lat_hi", "lon_lo", "lon_hi"))
    assert lo < hi and west < east
    assert one(spark, exprs.geohash_of_box(repr(lo), repr(hi), repr(west), repr(east))) == "9xj5s"


@pytest.mark.parametrize("v, want", [(-5, 0), (0, 0), (9.99, 0), (10, 10), (99, 25)])
def test_quantize(spark, v, want):
    assert one(spark, exprs.quantize(str(v), [0, 10, 25])) == want
    assert one(spark, exprs.quantize(str(want), [0, 10, 25])) == want


def test_ticks(spark):
    assert (one(spark, exprs.next_tick("10", [0, 10, 25])), one(spark, exprs.prev_tick("10", [0, 10, 25]))) == (25, 0)
    assert exprs.linear_ticks(0, 1, 0.25) == [0, 0.25, 0.5, 0.75]
    assert one(spark, exprs.bin_midpoint("99", [0, 10, 25])) == 25


@pytest.mark.parametrize("ms, want", [(0, 0), (1, 6), (6 * exprs.HOUR, 6), (6 * exprs.HOUR + 1, 12)])
def test_time_bucket(spark, ms, want):
    assert one(spark, exprs.time_bucket(str(ms))) == want * exprs.HOUR


def test_memory_and_heat(spark):
    assert one(spark, exprs.memory_bytes("10", "2", 6)) == 800
    assert abs(one(spark, exprs.heat_index("90.0D", "50.0D")) - 94.6) < 0.1


def test_statistics_merge_and_retract(spark):
    df = spark.createDataFrame([(float(x), float(-x)) for x in range(1, 6)], "a double, b double")
    parts = [df.where(c).agg(*stats.leaf_aggregates(["a", "b"], {"a": 3.0})) for c in ("a <= 3", "a > 3")]
    whole = parts[0].unionByName(parts[1]).agg(*stats.merge_aggregates(["a", "b"]))
    r = whole.select("n", stats.mean("a").alias("mean"), stats.m2("a").alias("m2"), "min_a", "max_a", "max_b", stats.correlation("a", "b").alias("r")).first()
    assert tuple(r) == (5, 3.0, 10.0, 1.0, 5.0, -1.0, -1.0)
    for shifts in (None, {}, {"a": 100.0}):
        plain = df.agg(*stats.leaf_aggregates(["a"], shifts))
        gone = plain.withColumns(stats.retract("a", 5.0)).select("n", stats.mean("a").alias("mean"), stats.m2("a").alias("m2")).first()
        assert tuple(gone) == pytest.approx((4, 2.5, 5.0))
    assert df.where("a = 1").agg(*stats.leaf_aggregates(["a"])).select(stats.variance("a").alias("v")).first()["v"] is None


@pytest.mark.parametrize("shifts", [None, {"a": 1e9, "b": -1e9}])
def test_statistics_of_large_values(spark, shifts):
    df = spark.createDataFrame([(1e9 + x, -1e9 + 2 * x + (x == 2)) for x in range(4)], "a double, b double")
    parts = [df.where(c).agg(*stats.leaf_aggregates(["a", "b"], shifts)) for c in ("a < 1e9 + 2", "a >= 1e9 + 2")]
    both = parts[0].unionByName(parts[1])
    if shifts is None:
        with pytest.raises(Exception, match="other origins"):
            both.agg(*stats.merge_aggregates(["a", "b"])).collect()
        both = stats.rebased(both, ["a", "b"], {"a": 1e9, "b": -1e9})
    for whole in (both.agg(*stats.merge_aggregates(["a", "b"])), df.agg(*stats.leaf_aggregates(["a", "b"], shifts))):
        r = whole.select(stats.mean("a").alias("mean"), stats.m2("a").alias("m2"), stats.variance("a").alias("v"), stats.slope("a", "b").alias("slope"), stats.intercept("a", "b").alias("at"), stats.cross("a", "b").alias("xy"), stats.density("a", 1e9).alias("d")).first()
        assert (r["mean"], r["m2"], r["slope"], r["xy"]) == pytest.approx((1e9 + 1.5, 5.0, 2.1, 10.5), abs=1e-6)
        assert r["at"] == pytest.approx(-1e9 + 3.25 - 2.1 * (1e9 + 1.5)) and r["d"] == pytest.approx(math.exp(-2.25 / (2 * 5 / 3)) / math.sqrt(2 * math.pi * 5 / 3))
        left = whole.withColumns(stats.retract("a", 1e9 + 3)).select(stats.mean("a").alias("m"), stats.m2("a").alias("q")).first()
        assert (left["m"], left["q"]) == pytest.approx((1e9 + 1, 2.0), abs=1e-6)


def test_sketch_of_large_values(spark):
    config = SketchConfig({"v": [1e9, 1e9 + 10, 1e9 + 20]})
    obs = spark.createDataFrame([(0, 1.0, 1.0, 1e9 + x) for x in range(20)], "ms long, lat double, lon double, v double")
    r = sketch.regroup(sketch.build(obs, config), ["time"], config).select(stats.variance("v").alias("v"), stats.mean("v").alias("m")).first()
    assert (r["v"], r["m"]) == (35.0, 1e9 + 9.5)


def test_geohash_of_missing_and_odd_coordinates(spark):
    rows = [(None, 10.0), (10.0, None), (None, None), (float("nan"), 10.0), (10.0, float("nan")), (95.0, 200.0), (-95.0, -200.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    assert [r["h"] for r in df.selectExpr(exprs.geohash("lat", "lon") + " as h").collect()] == [None] * 5 + ["zzzzz", "00000"]
    assert [r["h"] for r in df.limit(3).selectExpr(exprs.geohash_of_box("lat", "lat", "lon", "lon") + " as h").collect()] == [None] * 3
    obs = spark.createDataFrame([(0, None, 1.0, 1.0), (0, 1.0, 1.0, 1.0)], "ms long, lat double, lon double, v double")
    config = SketchConfig({"v": [0.0, 10.0]})
    assert sketch.build(obs, config).agg(F.sum("n")).first()[0] == 1
    assert sorted(r["location"] or "" for r in sketch.build(obs, config, strict=False).collect()) == ["", "s00tw"]


def test_quantizer_and_values(spark):
    q = exprs.Quantizer.linear(0, 10, 5).add(2.5).remove(5)
    assert q.ticks == [0.0, 2.5] and one(spark, q.quantize("9")) == 2.5 and one(spark, q.next("0")) == 2.5 and one(spark, q.prev("0")) is None
    with pytest.raises(ValueError):
        exprs.Quantizer().quantize("1")
    assert [exprs.type_of(v) for v in (1, 2**40, 1.5, "x")] == ["int", "bigint", "double", "string"]
    for bad in (b"x", None, True, [1]):
        with pytest.raises(TypeError):
            exprs.type_of(bad)
    with pytest.raises(TypeError):
        exprs.check_types({"a": "string"}, {"a": "double"})
    assert exprs.leading_planes(["a", "c"], ["a", "b", "c", "d"]) == ["a", "CAST(NULL AS DOUBLE) AS b", "c"]
    with pytest.raises(IndexError):
        exprs.array_offset([0, 3], [2, 3])


def test_snapshot_prunes_folders(spark, tmp_path):
    leaves = sketch.build(src.observations(spark, SF))
    for k in (1, 2, 3):
        sketch.write(leaves, str(tmp_path / f"s{k}"), codec="gzip", characters=k)
        stored = sketch.read(spark, str(tmp_path / f"s{k}"))
        for run in (engine.relational, engine.meta, engine.count, lambda x, q: engine.partition(x, q)[0]):
            plan = run(stored, Query([Expr("location", "[=", "d1x"), Expr("value", "<", 50.0)]))._jdf.queryExecution().executedPlan().toString()
            assert f"p{k}#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "DataFilters: [" in plan
        for q in (Query([Expr("location", "[=", "d")]), Query([Expr("location", "==", "d1x4m"), Expr("location", "[=", "7")]), Query([Expr("location", "=]", "p")])):
            assert engine.relational(stored, q).count() == engine.relational(leaves, q).count()
    assert not list((tmp_path / "s2").rglob("*.zstd.parquet")) and list((tmp_path / "s2").rglob("*.gz.parquet"))


def test_shared_folder_is_refused_where_others_cannot_see_it(monkeypatch):
    from types import SimpleNamespace

    from tesserae import session

    conf = SimpleNamespace(get=lambda *a: None)
    on = lambda master, value=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: value), sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    with pytest.raises(ValueError):
        session.shared_dir(on("spark://host:7077"))
    assert session.shared_dir(on("spark://host:7077", "hdfs://x/cp/")) == "hdfs://x/cp"
    assert session.shared_dir(on("local[2]")).startswith("file:///")


def test_dispatch_log_and_answers(spark, tmp_path):
    leaves = sketch.build(src.observations(spark, SF)).cache()
    spec = Query([Expr("value", "[)", 10.0, 150.0)]).to_dict()
    log = engine.file_log(str(tmp_path / "log.sql"))
    for kind in ("relational", "meta", "synthetic", "count", "partition"):
        engine.query(leaves, kind, spec, log)
    assert (tmp_path / "log.sql").read_text().count("SELECT * FROM leaves WHERE (") == 5
    for bad in ("relational", "memory"):
        with pytest.raises(ValueError):
            engine.register_kind(bad, engine.meta)
    with pytest.raises(ValueError):
        engine.query(leaves, "unheard of", spec)
    seen = []
    answers = engine.Answers(2, seen.append)
    assert not answers.add("a", engine.meta(leaves.where("err = 0"), Query())) and not seen
    with pytest.raises(ValueError):
        answers.add("a", engine.meta(leaves, Query()))
    assert answers.add("b", engine.meta(leaves.where("err = 1"), Query())) and len(seen) == 1 and seen[0].count() == 2
    assert answers.merged().first()["n"] == leaves.agg(F.sum("n")).first()[0]
    with pytest.raises(ValueError):
        answers.add("c", engine.meta(leaves, Query()))


def test_surface(spark):
    from tesserae.plans import surface

    leaves = sketch.build(src.observations(spark, SF)).cache()
    text = "select mean(value), count() where value >= 10 and (k) < 2 * 25 - mean(err) group by err"
    spec = {"select": ["MEAN(value)", "COUNT()"], "where": {"value": {">=": 10}, "k": {"<": "2 * 25 - MEAN(err)"}}, "group": ["err"]}
    assert sorted(surface.run(leaves, text).collect()) == sorted(surface.run(leaves, spec).collect()) != []
    assert surface.run(leaves, "SELECT COUNT() WHERE location LIKE 'it''s%'").first()["count"] is None
    assert surface.run(leaves, "SELECT COUNT() WHERE COUNT() > 1e9").count() == 0
    for bad in ("", "SELECT value", "SELECT MEAN(other)", "SELECT MEAN(value) WHERE", "SELECT MEAN(value) WHERE 1 < 2", "SELECT MEAN(value) GROUP BY nothing", "SELECT MEAN(value, k)", "SELECT MEAN(value) ; DROP", "SELECT CORRELATION(value)", "SELECT MEAN(value) WHERE k LIKE 3"):
        with pytest.raises(ValueError):
            surface.parse(bad)


def test_workload(spark):
    from tesserae.plans import workload

    assert len(workload.prefixes(2)) == 1024 and workload.prefixes(2, "d")[:2] == ["d0", "d1"]
    a, b = (workload.generate(30, ["d", "7z", "s00"], seed=3, least=2) for _ in range(2))
    assert [q.to_dict() for q in a] == [q.to_dict() for q in b] and all(len(q.features()) >= 3 for q in a)
    kinds = workload.mix({"meta": 75, "count": 25}, 4000)
    assert 2850 < kinds.count("meta") < 3150
    with pytest.raises(ValueError):
        workload.mix({"meta": 75}, 3)
    leaves = sketch.build(src.observations(spark, SF)).cache()
    wide = workload.generate(6, ["d", "7"], seed=3)
    got = {r["query"]: (r["leaves"], r["rows"]) for r in workload.matches(leaves, wide).collect()}
    for i, q in enumerate(wide):
        n = engine.meta(leaves, q).first()["n"]
        assert (n or 0) == got.get(i, (0, 0))[1]
    figures = workload.run(leaves, ["meta"] * 3, wide[:3], engine.query, warm_up=1)
    assert figures["per_second"] > 0 and figures["p95"] >= figures["mean"] / 2
    with pytest.raises(ValueError):
        workload.run(leaves, ["meta"], wide[:1], engine.query, warm_up=1)


def test_truncated_normal(spark):
    import statistics

    z = [-4.0, -1.5, -0.2, 0.0, 0.7, 2.5]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select("z", approx.normal_cdf(F.col("z")).alias("p"), approx.normal_quantile(approx.normal_cdf(F.col("z"))).alias("back")).collect()
    exact = statistics.NormalDist()
    assert all(abs(r["p"] - exact.cdf(r["z"])) < 2e-7 and abs(r["back"] - r["z"]) < 2e-3 for r in rows)
    config = SketchConfig({"v": [0.0, 1000.0]})
    values = [1.0] * 50 + [2.0] * 30 + [9.0] * 20  # the bounds cut both tails
    obs = spark.createDataFrame([(0, 1.0, 1.0, v) for v in values * 20], "ms long, lat double, lon double, v double")
    leaves = sketch.build(obs, config)
    made = [r["v"] for r in approx.synthesize(leaves, 3.0, (), config=config).collect()]
    assert len(made) == 6000 == len(set(made)) and min(made) >= 1.0 and max(made) <= 9.0
    m, sd = statistics.fmean(values), statistics.stdev(values * 20)
    d = statistics.NormalDist(m, sd)
    lo, hi = d.cdf(1.0), d.cdf(9.0)
    for at in (1.5, 2.5, 4.0, 6.0, 8.0):
        assert abs(sum(x <= at for x in made) / 6000 - (d.cdf(at) - lo) / (hi - lo)) < 0.025
    assert sorted(made) == sorted(r["v"] for r in approx.synthesize(leaves.repartition(5), 3.0, (), config=config).collect())
    train, test = approx.split(src.observations(spark, SF), "obs_id", 0.2)
    n = train.count() + test.count()
    assert n == src.observations(spark, SF).count() and abs(test.count() / n - 0.2) < 0.05


def test_welch_and_correlation_p():
    t, df, p = stats.welch(10, 5.0, 4.0, 12, 3.0, 9.0)
    assert t > 0 and 0 < p < 1 and stats.welch(12, 3.0, 9.0, 10, 5.0, 4.0)[2] == pytest.approx(p)
    assert stats.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-5)
    assert stats.correlation_p(0.0, 20) == pytest.approx(1.0)
    # r = 0.632 is the critical value for ten pairs at five per cent
    assert stats.correlation_p(0.6319, 10) == pytest.approx(0.05, abs=1e-4) == stats.correlation_p(-0.6319, 10)
    assert stats.correlation_p(1.0, 10) == 0.0


def test_query_building():
    q = Query([Expr("f", "==", 1), Expr("f", "==", 2), Expr("g", "<", 5)])
    assert q.where() == "(f = 1 OR f = 2) AND (g < 5)"
    assert Query.from_dict(q.to_dict()).where() == q.where()
    for bad in (("f", "??", 1, None), ("f", "[]", 1, None), ("f", "<", 1, 2), ("f", "[]", 3, 1)):
        with pytest.raises(ValueError):
            Expr(*bad)
    with pytest.raises(ValueError):
        q.check(["f"])


def test_sketch_invariants(spark):
    obs = src.observations(spark, SF)
    leaves = sketch.build(obs).cache()
    assert leaves.agg(F.sum("n")).first()[0] == obs.count()
    assert leaves.select(*CONFIG.planes).distinct().count() == leaves.count()
    kept, moved = sketch.split(leaves, "d")
    assert sketch.merge(kept, moved).count() == leaves.count() == kept.count() + moved.count()
    q = Query([Expr("value", "[)", 10.0, 150.0)])
    inside, outside = engine.partition(leaves, q)
    assert inside.count() + outside.count() == leaves.count()
    exact = obs.where("value >= 10 and value < 150").agg(F.avg("value"), F.var_samp("value")).first()
    got = engine.meta(leaves, q).select(stats.mean("value").alias("m"), stats.variance("value").alias("v")).first()
    assert got["m"] == pytest.approx(exact[0]) and got["v"] == pytest.approx(exact[1])


def test_vertices_by_hand(spark):
    leaves = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "p string, q string")
    assert {r["depth"]: r["n"] for r in sketch.vertices(leaves, ["p", "q"]).collect()} == {1: 2, 2: 3}
    assert tuple(sketch.counts(leaves, ["p", "q"]).first()) == (5, 3)
    assert sketch.compact_order(leaves, ["p", "q"])[-1] == "q"


def test_sparse_and_strict(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 5.0), (0, 1.0, 1.0, None)], "ms long, lat float, lon float, v double")
    config = SketchConfig({"v": [0.0, 10.0]})
    assert sketch.build(df, config).agg(F.sum("n")).first()[0] == 1
    assert sketch.build(df, config, strict=False).agg(F.sum("n")).first()[0] == 2


def test_empty_sketch(spark):
    leaves = sketch.build(src.observations(spark, SF).limit(0))
    assert leaves.count() == 0 and engine.count(leaves, Query()).first()["leaves"] == 0


def test_async_query(spark):
    got = []
    leaves = sketch.build(src.observations(spark, SF))
    engine.query_async(leaves, "count", {"terms": []}, got.extend).result()
    assert got[0]["leaves"] == leaves.count()


def test_text_json_and_blob_sources(spark, tmp_path):
    (tmp_path / "points.txt").write_text("1.5   2.5\nbroken\n3   4\n1 2 3\n")
    assert sorted(map(tuple, src.read_points(spark, str(tmp_path / "points.txt")).collect())) == [(1.5, 2.5), (3.0, 4.0)]
    (tmp_path / "rows.json").write_text('{"a": 1}\n{"a": \n{"a": 2}\n')
    assert sorted(r["a"] for r in src.read_json(spark, str(tmp_path / "rows.json"), "a int").where("a is not null").collect()) == [1, 2]
    rows = [{"name": f"r{i} \0 \U0001f600", "lat": 10.0 + i, "lon": -20.0, "time_start": 1000 + i, "features": {"t": 1.5, "u": float(i), "gap": None}, "texts": {"kind": "é"}, "arrays": {"g": ([2, 2], [1.0, None, 3.0, 4.0])}} for i in range(3)]
    for year, own in ((2014, rows[:2]), (2015, [*rows[2:], {"name": "bare", "lat": 0.0, "lon": 0.0}])):
        (tmp_path / "blobs" / f"year={year}").mkdir(parents=True)
        (tmp_path / "blobs" / f"year={year}" / "x.mblob").write_bytes(src.blob_bytes(own))
    read = src.read_blobs(spark, str(tmp_path / "blobs"), as_long=True)
    got = {r["name"]: r for r in read.collect()}
    for i in range(3):
        r = got[f"r{i} \0 \U0001f600"]
        assert (r["lat"], r["time_start"], r["time_end"], r["features"], r["texts"], r["year"]) == (10.0 + i, 1000 + i, 1000 + i, {"t": 1.5, "u": float(i), "gap": None}, {"kind": "é"}, 2014 + (i == 2))
        assert r["arrays"]["g"]["dims"] == [2, 2] and r["arrays"]["g"]["data"] == [1.0, None, 3.0, 4.0] and len(r["location"]) == 5
    assert got["bare"]["time_start"] is None and got["bare"]["features"] == {} and got["bare"]["location_code"] > 0
    assert read.where("year = 2015").count() == 2
    src.write_blobs(read.drop("location", "location_code", "year"), str(tmp_path / "again"), records=3).collect()
    assert len(list((tmp_path / "again").iterdir())) >= 2
    again = src.read_blobs(spark, str(tmp_path / "again"))
    assert again.count() == 4 and again.where("arrays['g'].data[3] = 4").count() == 3
    (tmp_path / "blobs" / "year=2014" / "x.other").write_bytes(b"junk")
    with pytest.raises(ValueError, match="x.other"):
        src.read_blobs(spark, str(tmp_path / "blobs"))


def test_blob_layout_by_hand(spark, tmp_path):
    """A file spelled out byte by byte: place, range with heights, coordinates, an int, a long, bytes, a typed array."""
    import struct

    name = lambda s: struct.pack(">H", len(s)) + s
    body = name(b"n") + b"\1" + struct.pack(">qq", 5, 9) + b"\1" + b"\1\1" + struct.pack(">4f", 1, 2, 3, 4) + b"\1" + struct.pack(">2f", 0, 9) + struct.pack(">2f", 1, 3)
    body += struct.pack(">i", 3) + name(b"i") + struct.pack(">ii", 1, -7) + name(b"l") + struct.pack(">iq", 2, 2**40) + name(b"b") + struct.pack(">ii", 6, 2) + b"xy"
    body += struct.pack(">i", 1) + b"\1" + name(b"a") + b"\1" + struct.pack(">i", 3) + struct.pack(">ii", 1, 2) + struct.pack(">i", 2) + name(b"") + struct.pack(">if", 3, 0.5) + name(b"") + struct.pack(">i", 0)
    body += struct.pack(">ii", 0, 0)
    (tmp_path / "y.mblob").write_bytes(struct.pack(">iffi", 1, 1.0, 3.0, len(body)) + body)
    r = src.read_blobs(spark, str(tmp_path)).first()
    assert (r["name"], r["time_start"], r["time_end"], r["features"], r["texts"]) == ("n", 5, 9, {"i": -7.0, "l": float(2**40)}, {})
    assert r["arrays"]["a"]["dims"] == [2] and r["arrays"]["a"]["data"] == [0.5, None]


def test_points_and_sine_load(spark, tmp_path):
    (tmp_path / "p.txt").write_text("0.3   0.3\n1 2\n-90   -180\nx   y\n")
    assert sorted(r["location"] for r in src.read_points(spark, str(tmp_path / "p.txt"), 9).collect()) == ["000000000", one(spark, exprs.geohash("CAST(0.3 AS FLOAT)", "CAST(0.3 AS FLOAT)", 9))]
    assert sorted(r["prefix"] for r in src.read_points(spark, str(tmp_path / "p.txt"), prefix_only=2).collect()) == ["00", "s0"]
    at = [one(spark, src.sine_delay(str(ms), 3600)) for ms in (0, 900, 1800, 2700, 3600)]
    assert (at[1], at[3]) == (3, 12) and all(x in (7, 8) for x in at[::2])  # 7.5 at both crossings


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    q = stream.write_deltas(stream.source(spark, str(tmp_path / "events")), str(tmp_path / "deltas"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got, want = stream.restore(spark, str(tmp_path / "deltas")), sketch.build(src.observations(spark, SF))
    assert got.select(*CONFIG.planes, "n").exceptAll(want.select(*CONFIG.planes, "n")).count() == 0
    assert got.count() == want.count()


def test_stream_tumbling(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "events"))
    q = stream.tumbling(stream.source(spark, str(tmp_path / "events"))).writeStream.outputMode("complete").format("memory").queryName("buckets").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {int(r["bucket"].timestamp() * 1000): r["n"] for r in spark.table("buckets").collect()}
    obs = spark.read.parquet(f"{SF}/events.parquet").select(F.expr("CAST(ceil(unix_micros(CAST(ts AS TIMESTAMP)) / 21600000000) AS BIGINT) * 21600000").alias("b"))
    assert got == {r["b"]: r["count"] for r in obs.groupBy("b").count().collect()}


def _ticks_of(spark, folder, rows):
    """A file for each list of (seconds, user_id), in order of their times of change."""
    import os

    for i, part in enumerate(rows):
        spark.createDataFrame([(k, sec, u) for k, (sec, u) in enumerate(part)], "k int, sec long, user_id long").selectExpr("CAST(user_id * 1000 + sec AS BIGINT) AS event_id", "CAST(timestamp_seconds(1704067200 + sec) AS TIMESTAMP_NTZ) AS ts", "user_id", "'view' AS event_type", "CAST(sec AS DOUBLE) AS value", "'{\"k\": 20}' AS props").coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("*.parquet"):
            if f.stat().st_mtime > 1_000_000_000 + len(rows):
                os.utime(f, (1_000_000_000 + i, 1_000_000_000 + i))


def _drain(frame, mode, name):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream_watermark_drops_late_rows_and_without_it_none(spark, tmp_path):
    _ticks_of(spark, tmp_path / "e", [[(10, 1), (20, 2)], [(10 * 86400 + 100, 3)], [(10 * 86400 + 101, 6)], [(15, 4), (10 * 86400 + 105, 5)]])
    s = lambda: stream.source(spark, str(tmp_path / "e"))
    _drain(stream.tumbling(s(), late="1 hour"), "update", "with_watermark")
    _drain(stream.tumbling(s()), "update", "without_watermark")
    most = lambda t: {r["bucket"]: r["n"] for r in spark.table(t).groupBy("bucket").agg(F.max("n").alias("n")).orderBy("bucket").collect()}
    assert list(most("without_watermark").values()) == [3, 3] and list(most("with_watermark").values()) == [2, 3]


def test_stream_state_of_leaves(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(2).write.parquet(str(tmp_path / "e"))
    _drain(stream.leaves(stream.source(spark, str(tmp_path / "e"))), "complete", "leaf_state")
    got, want = spark.table("leaf_state"), sketch.build(src.observations(spark, SF))
    assert got.select(*CONFIG.planes, "n").exceptAll(want.select(*CONFIG.planes, "n")).count() == 0 and got.count() == want.count()


def test_stream_deduplicates_repeated_batches(spark, tmp_path):
    _ticks_of(spark, tmp_path / "e", [[(10, 1), (20, 2)], [(10, 1), (30, 3)], [(20, 2), (30, 3)]])
    _drain(stream.deduplicated(stream.source(spark, str(tmp_path / "e")), ["obs_id"], "1 hour").select("obs_id"), "append", "once")
    assert sorted(r["obs_id"] for r in spark.table("once").collect()) == [1010, 2020, 3030]


def test_stream_replay_replica_and_processor(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "e"))

    class Views(stream.Processor):
        def process(self, batch, batch_id):
            return super().process(batch.where("event_type = 'view'"), batch_id)

    go = lambda cp: stream.write_deltas(stream.source(spark, str(tmp_path / "e")), str(tmp_path / "d"), str(tmp_path / cp), replica=str(tmp_path / "r"), processor=Views()).awaitTermination(120)
    go("cp")
    n = src.observations(spark, SF).where("event_type = 'view'").count()
    own = lambda folder: stream.restore(spark, str(tmp_path / folder)).agg(F.sum("n")).first()[0]
    assert own("d") == own("r") == n
    go("cp")  # nothing new
    go("another checkpoint")  # all is sent again: batches replace their own folders
    assert own("d") == own("r") == n
    assert len([d for d in (tmp_path / "d").iterdir() if d.name.startswith("batch=")]) == 3


def test_stream_continuous_queries(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "e"))
    seen = {}
    asked = {"all": ("meta", {"terms": []}), "errors": ("meta", {"terms": [{"feature": "err", "op": "==", "value": 1.0}]})}
    stream.continuous(stream.source(spark, str(tmp_path / "e")), asked, str(tmp_path / "d"), str(tmp_path / "cp"), lambda name, batch, answer: seen.update({(name, batch): answer.first()["n"]})).awaitTermination(180)
    obs = src.observations(spark, SF)
    assert [seen["all", b] for b in range(3)] == sorted(seen["all", b] for b in range(3)) and seen["all", 2] == obs.count() and seen["errors", 2] == obs.where("err = 1").count()


def test_stream_metrics_write_a_file_each(spark, tmp_path):
    import time

    spark.read.parquet(f"{SF}/events.parquet").repartition(2).write.parquet(str(tmp_path / "e"))
    listener = stream.Metrics(str(tmp_path), {"batches": lambda p: p.batchId + 1})
    spark.streams.addListener(listener)
    try:
        _drain(stream.tumbling(stream.source(spark, str(tmp_path / "e"))), "complete", "measured")
        for _ in range(50):
            if (tmp_path / "batches.csv").exists() and len((tmp_path / "batches.csv").read_text().splitlines()) >= 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    lines = {n: (tmp_path / f"{n}.csv").read_text().splitlines() for n in ("rows", "throughput", "state_rows", "batches")}
    assert len({len(x) for x in lines.values()}) == 1 and sum(int(x.split(",")[2]) for x in lines["rows"]) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert [x.split(",")[2] for x in lines["batches"]][:2] == ["1", "2"]


def test_tick_search(spark):
    obs = src.observations(spark, SF)
    few, many = quantizer.fit_ticks(obs, "k", 4), quantizer.search_ticks(obs, "k", 0.03)
    assert len(few) <= 4 < len(many)
    assert quantizer.midpoint_errors(obs, "k", many).first()["nrmse"] <= 0.03
    exact = quantizer.search_ticks(obs, "value", 0.01)
    assert quantizer.midpoint_errors(obs, "value", exact).first()["nrmse"] == pytest.approx(0.01, abs=0.001)
    with pytest.raises(ValueError):
        quantizer.search_ticks(obs, "value", 1e-9, bins=64)
    assert quantizer.search_ticks(obs.limit(0), "value") == []
    sizes = obs.where("value is not null").groupBy(F.expr(exprs.quantize("value", quantizer.fit_ticks(obs, "value", 10)))).count().collect()
    assert max(r["count"] for r in sizes) <= 1.05 * obs.count() / 10 + 2
    assert all(d >= 0 and math.isfinite(d) for _, d in quantizer.kde(obs, "value", [0.0, 50.0]))
    with pytest.raises(ValueError):
        quantizer.sampling_plan(obs.limit(10), "obs_id")


def test_scale_advice(spark):
    rows = [(t, 50.0, 10.0) for t in range(3)] + [(3, 50.0, 95.0)] + [(t, 1.0, 10.0) for t in range(4, 7)]
    df = spark.createDataFrame([("h", *r) for r in rows], "host string, t int, backlog double, memory double")
    got = [(r["advice"], r["amount"]) for r in engine.scale_advice(df, ["host"], ["t"], 3, 5.0, 40.0, 200.0).orderBy("t").collect()]
    assert got == [("none", None), ("none", None), ("out: backlog", 10.0), ("out: memory", 15.0), ("none", None), ("none", None), ("in", 4.0)]
