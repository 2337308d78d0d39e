"""Queries against their SQL on small tables made for the cases that the supplied ones lack."""

import datetime as dt
import sys

import pytest

sys.path.append("/opt/oracle")
duckdb = pytest.importorskip("duckdb")

from pricelens.plans import QUERIES, SQL  # noqa: E402


@pytest.fixture
def agree(spark, tmp_path):
    """Writes tables (name -> SELECT), runs a query and its SQL over them; both must agree."""

    def run(name, tables):
        con = duckdb.connect()
        for t, select in tables.items():
            con.execute(f"COPY ({select}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        got = QUERIES[name](spark, str(tmp_path))
        cols = got.columns
        plain = lambda v: round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v
        ours = sorted((tuple(plain(v) for v in r) for r in got.collect()), key=str)
        theirs = sorted((tuple(plain(v) for v in r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()), key=str)
        assert ours == theirs
        return [dict(zip(cols, r, strict=True)) for r in ours]

    return run


def suppliers(*keys):
    return " UNION ALL ".join(f"SELECT {k}::BIGINT AS s_suppkey, 7 AS s_nationkey" for k in keys)


def test_numbers_that_begin_alike_are_evidence(agree):
    evidence = lambda *keys: {r["store_id"]: r["evidence"] for r in agree("c6_evidence_kinds", {"supplier": suppliers(*keys)})}
    assert evidence(1511, 15111) == {1511: True, 15111: True}  # four of five characters alike
    assert evidence(311, 3111) == {311: False, 3111: True}  # three of four


def test_every_store_of_a_zip_gets_its_evidence(agree):
    # all of one retailer and zip; an even one is near those of its own latitude or the next
    rows = {r["store_id"]: r["evidence"] for r in agree("c6_external_evidence", {"supplier": suppliers(5, 205, 406, 605)})}
    assert len(rows) == 4 and rows[406]


def test_nearest_store_by_the_exact_distance(agree):
    # both 17.60 miles from the zip's centre, 686 the nearer
    rows = {r["point_id"]: r for r in agree("j9_nearest_per_retailer", {"supplier": suppliers(232, 686)})}
    assert rows["90059"]["store_id"] == 686 and rows["90059"]["distance_miles"] == 17.6


def test_caps_by_day_and_week_to_the_microsecond(agree):
    times = ["2024-01-01 10:00:00.9", "2024-01-01 11:00:00", "2024-01-01 12:00:00", "2024-01-01 23:59:59.7", "2024-01-08 10:00:00.1", "2024-01-08 23:59:59.8", "2024-01-09 00:00:00.1", "2024-01-09 00:00:00.2", "2024-01-09 00:00:00.3"]
    ids = [0, 1, 2, 3, 200, 4, 5, 6, 7]  # 200 repeats 0 within seven days, by less than a second
    events = " UNION ALL ".join(f"SELECT {i}::BIGINT AS event_id, TIMESTAMP '{t}' AS ts, 1::BIGINT AS user_id" for i, t in zip(ids, times, strict=True))
    rows = agree("t7_capped_sends", {"events": events})
    assert [r["product"] for r in sorted(rows, key=lambda r: r["sent_at"])] == [f"product_{i}" for i in (0, 1, 2, 4, 5, 6, 7)]
