"""Every registered query of the engine against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    own = frame[columns].astype(object)
    return sorted(str([None if v is None or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r]) for r in own.where(own.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_hll_is_near_the_exact_count(spark):
    from tesserae.operators import approx
    from tesserae.sources.observations import observations

    obs = observations(spark, SF)
    exact = {r["event_type"]: r["n"] for r in obs.groupBy("event_type").agg({"user_id": "count"}).toDF("event_type", "n").collect()}
    distinct = {t: obs.where(f"event_type = '{t}'").select("user_id").distinct().count() for t in exact}
    for r in approx.merge_cardinality(approx.cardinality(obs, ["event_type"], "user_id"), ["event_type"]).collect():
        assert abs(r["estimate"] - distinct[r["event_type"]]) <= 0.05 * distinct[r["event_type"]]
    known = approx.bloom(obs.where("user_id % 2 = 0"), ["user_id"], 1000)
    rows = known.might_contain(spark.range(10_000).withColumnRenamed("id", "user_id"), ["user_id"]).join(obs.where("user_id % 2 = 0").select("user_id").distinct(), "user_id", "left_anti")
    assert known.might_contain(obs.where("user_id % 2 = 0"), ["user_id"]).where("not might").count() == 0
    assert rows.where("might").count() <= 0.03 * rows.count() and known.rate().first()["rate"] <= 0.015
    with pytest.raises(ValueError):
        approx.bloom(obs, ["user_id"], 10**9)


def _bloom_query(spark, folder, events):
    """The query's row and that of its SQL over events of (event_id, user_id, event_type, props)."""
    events.selectExpr("event_id", "timestamp'2024-01-01 00:00:00' as ts", "user_id", "event_type", "1.0D as value", "props").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    return tuple(catalog.QUERIES["ag28_membership_bloom"](spark, str(folder)).first()), con.execute(catalog.SQL["ag28_membership_bloom"]).fetchone()


def test_bloom_filter_holds_as_many_as_there_are(spark, tmp_path):
    events = spark.range(0, 200_000, 1, 4).selectExpr("id as event_id", "id div 100 as user_id", "if(id % 2 = 0, 'error', 'view') as event_type", """concat('{"k": ', id % 100, '}') as props""")
    got, want = _bloom_query(spark, tmp_path, events)
    assert got == want == (100_000, 0, True, True)


def test_bloom_filter_of_nulls_and_fractions(spark, tmp_path):
    own = [(1, "error", "{}"), (1, "view", "{}"), (2, "error", None), (2, "view", "{}"), (3, "view", "{}"), (None, "error", '{"k": 1}'), (None, "view", '{"k": 1}'), (None, "view", "{}")]
    own += [(4, "error", '{"k": 1.5}'), (4, "view", '{"k": 1.2}'), (4, "view", '{"k": 1.5}'), (5, "error", '{"k": 0.0}'), (5, "view", '{"k": -0.0}'), (6, "error", '{"k": 1e300}'), (6, None, '{"k": 1e300}'), (7, None, '{"k": 1}')]
    got, want = _bloom_query(spark, tmp_path, spark.createDataFrame([(i, *r) for i, r in enumerate(own)], "event_id long, user_id long, event_type string, props string"))
    assert got == want == (12, 0, True, True)


def test_bloom_query_counts_a_false_positive_once(spark, tmp_path):
    """One that has most rows says nothing of the rate."""
    from tesserae.operators import approx

    known = spark.range(0, 20_000).selectExpr("id as user_id", "1.0D as k")
    other = spark.range(20_000, 21_000).selectExpr("id as user_id", "1.0D as k")
    odd = approx.bloom_of(known, ["user_id", "k"]).might_contain(other, ["user_id", "k"]).where("might").first()["user_id"]
    events = spark.range(0, 23_000).selectExpr("id as event_id", f"if(id < 21000, id, {odd}) as user_id", "if(id < 20000, 'error', 'view') as event_type", """'{"k": 1}' as props""")
    got, want = _bloom_query(spark, tmp_path, events)
    assert got == want == (20_000, 0, True, True)


def test_bloom_filter_without_items(spark, tmp_path):
    got, want = _bloom_query(spark, tmp_path, spark.range(50).selectExpr("id as event_id", "id as user_id", "'view' as event_type", """'{"k": 1}' as props"""))
    assert got == want == (0, 0, True, True)


def test_bloom_filter_in_parts(spark, monkeypatch):
    from tesserae.operators import approx

    monkeypatch.setattr(approx, "MOST_BITS", 1 << 17)
    monkeypatch.setattr(approx, "PART_BITS", 1 << 16)
    known = spark.range(0, 40_000).selectExpr("if(id = 7, null, id) as a", "if(id = 8, null, id % 10) as b")
    own = approx.bloom_of(known, ["a", "b"])
    assert own.parts == 6 and own.rows.count() == 6
    asked = known.withColumn("is_in", F.lit(True)).union(spark.range(40_000, 60_000).selectExpr("id", "id % 10", "false"))
    got = {r["is_in"]: r for r in own.might_contain(asked, ["a", "b"]).groupBy("is_in").agg(F.count("*").alias("n"), F.count_if("might").alias("hit")).collect()}
    assert tuple(got[True])[1:] == (40_000, 40_000)
    assert got[False]["n"] == 20_000 and got[False]["hit"] <= 0.015 * 20_000 and own.rate().first()["rate"] <= 0.015
    assert approx.bloom_of(known.limit(1000), ["a", "b"]).parts == 1


def test_count_min_bounds(spark):
    from tesserae.operators import approx

    items = spark.range(20_000).selectExpr("cast(pow(id, 0.6) as bigint) as item")
    exact = items.groupBy("item").count()
    rows = approx.count_min(items, "item", 0.01, 0.99).estimate(exact, "item").collect()
    assert all(r["estimate"] >= r["count"] and r["bound"] == 200 for r in rows)
    assert sum(r["estimate"] > r["count"] + r["bound"] for r in rows) <= 0.01 * len(rows)
    assert approx.count_min(items.limit(0), "item").estimate(exact, "item").where("estimate > 0").count() == 0


def test_forest_has_the_surveyed_size(spark, monkeypatch):
    import inspect

    from tesserae.operators import approx

    given, of = {}, inspect.signature(approx.forest)
    monkeypatch.setattr(approx, "forest", lambda *a, **k: given.update((x := of.bind(*a, **k)).apply_defaults() or x.arguments))
    catalog.QUERIES["ml4_ml5_forest"](spark, SF)
    assert (given["trees"], given["depth"], given["bins"]) == (32, 20, 32)
