import datetime as dt

from pricelens.operators import history as H
from pricelens.operators import offers as O
from pyspark.sql import functions as F

HIST = "match_key string, store_id long, day date, price double, brand string, category string"
D = dt.date


def hist(spark, rows):
    return spark.createDataFrame([(k, 1, d, p, None, None) for k, d, p in rows], HIST)


def test_cheapest_row_keeps_its_nulls(spark):
    rows = [("k", 1, D(2026, 1, 1), 3.99, 1, None), ("k", 1, D(2026, 1, 1), 4.29, 2, "X"), ("k", 1, D(2026, 1, 2), 0.0, 3, "X"), ("k", 1, D(2026, 1, 2), None, 4, "X"), ("k", 1, D(2026, 1, 2), 1e6, 5, "X")]
    d = spark.createDataFrame(rows, "match_key string, store_id long, day date, price double, row_id long, brand string")
    d = d.withColumns({"category": F.lit(None).cast("string"), "base_amount": F.lit(1.0), "base_unit": F.lit("oz")})
    assert [(r.price, r.brand) for r in H.daily_price_history(d).collect()] == [(3.99, None)]


def test_delta_types(spark):
    base = [(k, D(2026, 1, 1), p) for k, p in (("drop", 10.21), ("same", 10.19), ("rise", 9.78))]
    last = [(k, D(2026, 1, 9), p) for k, p in (("drop", 9.79), ("same", 9.81), ("rise", 10.22))]
    old = [("stale", D(2025, 1, 1), 5.0)]
    got = {r.match_key: (r.delta_type, r.baseline_price) for r in H.deal_delta(hist(spark, base + last + old), "2026-01-10").collect()}
    assert got == {"drop": ("drop", 10.0), "same": ("unchanged", 10.0), "rise": ("rise", 10.0), "stale": ("new", None)}


def test_velocity_counts_changes(spark):
    rows = [("k", D(2026, 1, 1 + i), p) for i, p in enumerate((1.0, 1.0, 2.0, 2.0, 1.0))]
    assert H.velocity(hist(spark, rows), "2026-01-10").first().deal_velocity == 2.0


def test_outliers_and_quality(spark):
    d = spark.createDataFrame([(1, 2.0), (1, 3.0), (1, 10.0), (2, 1.0), (2, 9.0)], "g int, price double")
    assert sorted((r.g, r.price) for r in O.trim_outliers(d, ["g"]).collect()) == [(1, 2.0), (1, 3.0), (2, 1.0), (2, 9.0)]
    q = spark.createDataFrame([(-15.0,), (-5.0,), (5.0,), (5.1,)], "p double").select(O.quality(F.col("p")).alias("q"))
    assert [r.q for r in q.collect()] == ["great", "good", "fair", "expensive"]


def test_alias_closure_stops_at_forks_and_cycles(spark):
    e = spark.createDataFrame([("a", "b", True), ("b", "c", True), ("x", "c", True), ("c", "a", False), ("p", "q", True), ("q", "p", True)], "old_match_key string, new_match_key string, is_unique_successor boolean")
    got = {(r.match_key, r.related_key): r["rank"] for r in H.history_keys(spark.createDataFrame([("a",), ("p",)], "match_key string"), e).collect()}
    assert got[("a", "c")] == 0 and got[("a", "b")] == 1 and got[("a", "x")] == 1 and got[("a", "a")] == 2
    assert {k[1] for k in got if k[0] == "p"} == {"p", "q"}
