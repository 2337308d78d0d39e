from pricelens.operators.offers import cart_stores


def test_a_repeated_deal_counts_once_and_deals_carry_no_lists(spark):
    deals = spark.createDataFrame([("corn pops", 1, 10, 2.0, 3.0), ("corn flakes", 1, 10, 2.5, 3.0), ("oat milk", 1, 11, 4.0, 3.0), ("corn pops", 2, 12, 1.0, 1.0)], "canonical string, store_id long, deal_id long, price double, distance_miles double")
    asked = spark.createDataFrame([(1, ["corn", "Milk"]), (2, ["pops"])], "request_id long, items array<string>")
    out = cart_stores(asked, deals)
    got = sorted((r.request_id, r.store_id, r.total, r.n_deals, r.items_found, r.miles) for r in out.collect())
    assert got == [(1, 1, 6.5, 2, 2, 3.0), (1, 2, 1.0, 1, 1, 1.0), (2, 1, 2.0, 1, 1, 3.0), (2, 2, 1.0, 1, 1, 1.0)]
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()  # no lists of items by deal


def test_requests_meet_size_tiers_over_all_cores(spark):
    from pricelens.plans.offers import a10_size_tiers
    from pyspark.sql import functions as F

    out = a10_size_tiers(spark, "/root/testdata/sf0.01")
    loads = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(loads) >= 4 and max(loads) < 0.5 * sum(loads)
