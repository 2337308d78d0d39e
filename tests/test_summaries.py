import datetime as dt
import random

import pytest

from pricelens.operators import history as H
from pricelens.plans import QUERIES
from pricelens.sources import versions as V
from pricelens.streaming.summaries import Summaries
from pyspark.sql import functions as F

SCHEMA = "match_key string, store_id long, day date, price double, row_id long, brand string, category string, base_amount double, base_unit string"
NOW = "2026-04-15"


def made(spark, rng, n, first):
    """Deals of few products, stores and days, with the same prices often, two months outside of the look-back and one day after it."""
    days = [dt.date(2026, 4, 16) - dt.timedelta(days=d) for d in (0, 1, 2, 16, 31, 45, 60, 90, 91, 92, 150)]
    rows = [(f"k{rng.randrange(4)}", rng.randrange(3), rng.choice(days), rng.choice([1.0, 1.5, 2.25, 4.0, 9.99, 0.0, None]), first + i, f"b{first + i}", None, None, None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def same(kept, hist):
    assert rows(kept.minima().drop("part")) == rows(hist)
    assert rows(kept.latest_price()) == rows(H.latest_price(hist))
    for days in (90, 0):
        assert rows(kept.baseline(NOW, days)) == rows(H.baseline(hist, NOW, days))
    assert rows(kept.score_deals(NOW)) == rows(H.score_deals(H.deal_delta(hist, NOW), hist, NOW))
    limits = {"retailers": 1, "days": 1, "below_pct": -1000.0}
    assert rows(kept.best_deals(NOW, **limits)) == rows(H.best_deals(hist, NOW, **limits))


@pytest.fixture
def kept(spark, tmp_path):
    return Summaries(spark, str(tmp_path / "t"), H.daily_price_history(spark.createDataFrame([], SCHEMA)).schema)


def test_summaries_equal_recomputation_after_each_batch(spark, kept):
    rng, all_rows, write = random.Random(5), spark.createDataFrame([], SCHEMA), kept.write()
    for i, n in enumerate((40, 0, 60)):
        batch = made(spark, rng, n, 1000 * i)
        write(batch, i)
        all_rows = all_rows.unionByName(batch)
        same(kept, H.daily_price_history(all_rows))


def test_a_stop_between_minima_and_summaries_is_made_up(spark, kept, monkeypatch):
    rng, write = random.Random(6), kept.write()
    first, second = made(spark, rng, 30, 0), made(spark, rng, 30, 1000)
    write(first, 0)
    commit = V._commit
    for table in ("/months", "/counts"):  # stops at either table's commit; the batch then comes again
        with monkeypatch.context() as m:
            m.setattr(V, "_commit", lambda s, path, *a: commit(s, path, *a) if not path.endswith(table) else (_ for _ in ()).throw(RuntimeError("stopped")))
            with pytest.raises(RuntimeError, match="stopped"):
                write(second, 1)
    write(second, 1)
    write(second, 1)
    same(kept, H.daily_price_history(first.unionByName(second)))


def test_look_backs_read_the_months_at_their_edges_alone(spark, kept):
    kept.write()(made(spark, random.Random(7), 60, 0), 0)
    plan = kept.minima(F.date_sub(F.to_date(F.lit(NOW)), 30))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1].split("]")[0]


def test_queries_are_registered():
    assert {"a2_a6_kept_scores", "a12_kept_best_deals"} <= set(QUERIES)
