import datetime as dt

import pytest

from pricelens.operators import notify as N
from pricelens.operators.history import daily_price_history
from pricelens.sources import tables as S
from pricelens.sources import versions as V
from pricelens.streaming import prices as P
from pyspark.sql import functions as F

SCHEMA = "match_key string, store_id long, day date, price double, row_id long, brand string, category string, base_amount double, base_unit string"


def test_later_batch_does_not_raise_the_minimum(spark, tmp_path):
    day = dt.date(2026, 1, 1)
    for i, price in enumerate((4.0, 5.0)):
        spark.createDataFrame([("k", 1, day, price, i, None, None, None, None), (f"only{i}", 1, day, price, i, None, None, None, None)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
        rows = P.read_deal_stream(spark, str(tmp_path / "in/*"), SCHEMA)
        P.price_stream(rows, str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    assert minima(spark, tmp_path / "out") == {"k": 4.0, "only0": 4.0, "only1": 5.0}


def minima(spark, path):
    schema = daily_price_history(spark.createDataFrame([], SCHEMA)).schema
    return {r.match_key: r.price for r in P.stored_minima(spark, str(path), schema).collect()}


def batch(spark, prices, month=1):
    return spark.createDataFrame([(k, 1, dt.date(2026, month, 1), p, i, None, None, None, None) for i, (k, p) in enumerate(prices.items())], SCHEMA)


def test_a_writer_that_stops_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    """Stops before the commit, within the data and after the commit; each batch then comes again."""
    path = str(tmp_path / "t")
    write = P.write_minima(path)
    write(batch(spark, {"a": 3.0, "b": 5.0}), 0)
    before = {"a": 3.0, "b": 5.0}
    assert minima(spark, path) == before
    with monkeypatch.context() as m:
        m.setattr(V, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        for _ in range(2):
            with pytest.raises(RuntimeError, match="stopped"):
                write(batch(spark, {"a": 2.0, "c": 1.0}), 1)
            assert minima(spark, path) == before
    (tmp_path / "t/data/version=2/part=2026-01-01/part-broken.parquet").write_bytes(b"half a file")
    write(batch(spark, {"a": 2.0, "c": 1.0}), 1)
    after = {"a": 2.0, "b": 5.0, "c": 1.0}
    assert minima(spark, path) == after
    write(batch(spark, {"a": 1.0}), 1)  # committed: left out
    assert minima(spark, path) == after
    write(batch(spark, {"d": 9.0}, month=2), 2)
    write(batch(spark, {}, month=2), 3)
    assert minima(spark, path) == after | {"d": 9.0}
    V.compact(spark, path, daily_price_history(spark.createDataFrame([], SCHEMA)).schema)
    assert minima(spark, path) == after | {"d": 9.0}
    versions = {r.version for r in V.commits(spark, path).collect()}
    assert versions == {1, 2, 3, 4, 5}


def test_late_rows_go_aside_and_catch_up(spark, tmp_path):
    t = lambda d, h: dt.datetime(2026, 1, d, h)
    batches = [[("k", 5.0, t(1, 1)), ("k", 4.0, t(1, 9)), ("m", 7.0, t(6, 1))], [("k", 1.0, t(1, 5)), ("k", 8.0, t(5, 5)), ("n", 2.0, None)], [("k", 3.0, t(5, 6)), ("k", 0.5, t(9, 1))]]
    schema = "match_key string, price double, ts timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
        P.window_stream(P.read_deal_stream(spark, str(tmp_path / "in/*"), schema), "ts", str(tmp_path / "w"), str(tmp_path / "o")).awaitTermination()
    late = sorted((r.match_key, r.price) for r in P.late_rows(spark, str(tmp_path / "w")).collect())
    assert late == [("k", 1.0), ("n", 2.0)]
    rows = lambda d: sorted((r.match_key, r.day_start.day, r.low, r.n) for r in d.collect())
    assert rows(P.closed_windows(spark, str(tmp_path / "w"))) == [("k", 1, 4.0, 2), ("k", 5, 3.0, 2), ("m", 6, 7.0, 1)]
    assert rows(P.caught_up(spark, str(tmp_path / "w"))) == [("k", 1, 1.0, 3), ("k", 5, 3.0, 2), ("k", 9, 0.5, 1), ("m", 6, 7.0, 1)]


def test_upsert_is_idempotent_and_patch_keeps_values(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, u string, v string")
    b = spark.createDataFrame([(2, "c", "z"), (3, "d", "w")], "id int, u string, v string")
    once = S.upsert(t, b, ["id"])
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(once) == [(1, "a", "x"), (2, "c", "z"), (3, "d", "w")] == rows(S.upsert(once, b, ["id"]))
    patch = spark.createDataFrame([(1, None), (2, "n")], "id int, u string")
    assert rows(S.coalesce_update(t, patch, ["id"])) == [(1, "a", "x"), (2, "n", "y")]


def test_send_caps(spark):
    now = dt.datetime(2026, 1, 8, 12)
    log = spark.createDataFrame([(1, "p", "r", now - dt.timedelta(days=2))], "user_id long, product string, retailer string, sent_at timestamp")
    c = spark.createDataFrame([(1, "p", "r", "power", 99.0, False), (1, "q", "r", "power", 99.0, False), (1, "q", "s", "power", 99.0, True), (1, "q", "s", "power", 50.0, False), (1, "a", "s", "casual", 60.0, False), (1, "b", "s", "power", 90.0, False), (1, "c", "s", "power", 80.0, False)], "user_id long, product string, retailer string, segment string, score double, is_quiet boolean")
    d = N.decide(c, log, "2026-01-08 12:00:00")
    got = sorted((r["product"], r.retailer, r.blocked_reason) for r in d.collect())
    assert got == [("a", "s", "segment_score"), ("b", "s", "none"), ("c", "s", "none"), ("p", "r", "duplicate"), ("q", "r", "retailer_cap"), ("q", "s", "low_score"), ("q", "s", "quiet_hours")]
    assert [(r["product"], r["rank"]) for r in N.capped(d).collect()] == [("b", 1)]


def test_quiet_hours_wrap_and_unknown_zone(spark):
    d = spark.createDataFrame([("UTC",), ("Asia/Tokyo",), ("nonsense",)], "z string")
    q = N.quiet(F.to_timestamp(F.lit("2026-01-01 23:30:00")), F.col("z"), F.lit(22), F.lit(7))
    assert [r.x for r in d.select(q.alias("x")).collect()] == [True, False, True]


def test_week_starts_on_wednesday(spark):
    d = spark.createDataFrame([("2026-10-20 03:07:00",), ("2026-10-21 08:00:00",)], "t string").select(P.flyer_week_start(F.to_timestamp("t")).alias("x"))
    assert [str(r.x) for r in d.collect()] == ["2026-10-14 07:00:00", "2026-10-21 07:00:00"]


def test_store_catalog_csv_and_json(spark, tmp_path):
    row = "Shop,shop,7,1 Main St,\"1 Main St, Town, CA 90001\",90001,34.0,-118.0,high,src"
    (tmp_path / "c.csv").write_text(S.CATALOG.replace(" string", "").replace(" double", "").replace(", ", ",") + "\n" + row + "\n")
    got = S.read_store_catalog(spark, str(tmp_path / "c.csv")).first()
    assert (got.store_id, got.latitude, got.full_address) == ("7", 34.0, "1 Main St, Town, CA 90001")
    (tmp_path / "c.json").write_text('{"retailer": "Shop", "latitude": 1.5}\n')
    assert S.read_store_catalog(spark, str(tmp_path / "c.json"), "json").first().latitude == 1.5


def test_send_cap_state(spark, tmp_path):
    t = lambda d, h: dt.datetime(2026, 1, d, h)
    rows = [(1, "p", "r", t(1, 1)), (1, "p", "r", t(3, 1)), (1, "p", "r", t(9, 1)), (1, "a", "r", t(1, 2)), (1, "b", "r", t(1, 3)), (1, "c", "r", t(1, 4)), (2, "p", "r", t(1, 1))]
    schema = "user_id long, product string, retailer string, sent_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = P.capped_sends(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.user_id, r["product"], r.sent_at.day) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "a", 1), (1, "b", 1), (1, "p", 1), (1, "p", 9), (2, "p", 1)]


def test_enrichment_and_dedup_streams(spark, tmp_path):
    schema = "user_id long, product string, retailer string, sent_at timestamp"
    now = dt.datetime(2026, 1, 1, 5)
    spark.createDataFrame([(1, "p", "r", now), (1, "p", "r", now), (2, "p", "r", now)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = P.dedup_sends(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema(schema).parquet(str(tmp_path / "out")).count() == 2
    seen = []
    raw = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    P.enrich_stream(raw, lambda b: b.withColumn("x", F.col("user_id") * 2), lambda b, i: seen.append(sorted(r.x for r in b.collect())), str(tmp_path / "e")).awaitTermination()
    assert seen == [[2, 2, 4]]


def test_week_start_of_every_event(spark, tmp_path):
    from zoneinfo import ZoneInfo

    from pricelens.plans import QUERIES

    here, utc = ZoneInfo("America/Los_Angeles"), dt.timezone.utc
    times = [dt.datetime(2023, 12, 25, 7, 59) + dt.timedelta(hours=37 * i) for i in range(300)]
    d = spark.createDataFrame(list(enumerate(times)), "event_id long, ts timestamp_ntz")
    d.write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for i, t in enumerate(times):
        day = t.replace(tzinfo=utc).astimezone(here).date()
        day -= dt.timedelta(days=(day.weekday() - 2) % 7)
        want[i] = dt.datetime(day.year, day.month, day.day, tzinfo=here).astimezone(utc).replace(tzinfo=None)
    assert {x.event_id: x.week_start for x in QUERIES["t4_week_start"](spark, str(tmp_path)).collect()} == want
