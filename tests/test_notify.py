"""Sends by best_near() against the product of users and deals."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pricelens.operators import notify as N

NOW = "2026-01-08 12:00:00"


def tables(spark, seed):
    r = random.Random(seed)
    zips = spark.createDataFrame([(f"z{i}", 33 + i * 0.1, -118 - i * 0.07) for i in range(12)], "zip_code string, latitude double, longitude double")
    drops = [(f"p{r.randint(0, 30)}", f"r{r.randint(0, 6)}", r.choice(["dairy", "meat", "toys", None]), float(r.randint(1, 25) * 8), f"z{r.randint(0, 13)}") for _ in range(300)]
    drops = spark.createDataFrame(drops, "product string, retailer string, category string, drop_pct double, zip_code string")
    users = [(i, f"z{r.randint(0, 13)}", r.choice(["power", "regular", "casual", None]), r.choice([["dairy"], ["toys", "dairy", "toys"], [], None]), r.choice([None, 0.0, 12.0, 40.0]), r.choice([None, "Asia/Tokyo"])) for i in range(120)]
    users = spark.createDataFrame(users, "user_id long, zip_code string, segment string, category_prefs array<string>, radius_miles double, time_zone string")
    now = dt.datetime(2026, 1, 8, 12)
    log = [(r.randint(0, 60), f"p{r.randint(0, 30)}", f"r{r.randint(0, 6)}", r.choice(["drop", "new_deals", None]), now - dt.timedelta(hours=r.randint(0, 200))) for _ in range(70)]
    log = spark.createDataFrame(log, "user_id long, product string, retailer string, trigger_type string, sent_at timestamp")
    return drops, users, zips, log


def test_send_list_equals_the_product_of_users_and_drops(spark):
    some = 0
    for seed in range(3):
        drops, users, zips, log = tables(spark, seed)
        cols = ["user_id", "product", "retailer", "score", "rank"]
        want = sorted(map(tuple, N.capped(N.trigger_run(drops, users, zips, log, NOW)).select(*cols).collect()))
        got = sorted(map(tuple, N.send_list(drops, users, zips, log, None, NOW).select(*cols).collect()))
        assert got == want
        some += len(got)
    assert some > 30


def test_counts_over_representatives(spark):
    drops, users, zips, log = tables(spark, 5)
    d = N.trigger_run(drops, users, zips, log, NOW).groupBy("blocked_reason").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("score").alias("high"))
    few = N.representatives(users, log, NOW)
    assert few.count() < users.count() and few.agg(F.sum("n_users")).first()[0] == users.count()
    got = N.block_summary(N.trigger_run(drops, few, zips, log, NOW))
    assert sorted(map(tuple, got.select(*d.columns).collect())) == sorted(map(tuple, d.collect()))


def test_digest_equals_the_product_of_users_and_products(spark):
    drops, users, zips, _ = tables(spark, 7)
    products = drops.groupBy("product").agg(F.min_by(F.struct("retailer", "category", "zip_code", "drop_pct"), F.struct("drop_pct", "retailer", "zip_code")).alias("b"))
    products = products.select(F.col("product").alias("canonical"), F.col("b.category").alias("category"), F.col("b.retailer").alias("best_retailer"), F.lit(2.5).alias("best_price"), F.col("b.zip_code").alias("best_zip"), F.col("b.drop_pct").alias("savings_pct"), F.lit(4).alias("n_retailers"))
    u = N.profiles(users)
    near = N.candidate_pairs(products.withColumn("zip_code", F.col("best_zip")), u, zips)
    none = F.array().cast("array<string>")
    liking = N.relevance(F.col("category"), F.col("category_prefs"), F.col("canonical"), none, F.lit(None).cast("string"), none)
    penalty = F.when(F.lower("category").isin("produce", "meat"), 0.7).otherwise(1.0)
    rows = near.withColumn("score", N.blend(N.deal_score(F.col("savings_pct") * penalty, F.lit(0.0), F.col("n_retailers")), liking)).where("score >= 30").collect()
    want = set()
    for i in {x.user_id for x in rows}:
        seen, rank = set(), 0
        for x in sorted((x for x in rows if x.user_id == i), key=lambda x: (-x.score, x.canonical)):
            if x.best_retailer not in seen and rank < 3:
                seen.add(x.best_retailer)
                rank += 1
                want.add((i, rank, x.canonical, x.best_retailer, x.score))
    got = N.digest(products, users, zips)
    assert {(x.user_id, x["rank"], x.canonical, x.best_retailer, x.score) for x in got.collect()} == want and len(want) > 50
    devices = spark.createDataFrame([(i, f"s{i}" if i % 4 else None, i % 5 > 0, i % 3 > 0) for i in range(120)], "user_id long, provider_subscription_id string, active boolean, weekly_summary_enabled boolean")
    sent = N.digest_payloads(got, devices).collect()
    assert {x.user_id for x in sent} == {w[0] for w in want if w[0] % 4 and w[0] % 5 and w[0] % 3}
    assert all(x.subscription_id == f"s{x.user_id}" and x.body.count(" for $2.50 at ") == x.n_deals for x in sent)


def test_reasons(spark):
    rows = [("milk", "shop", 2.5, 20.7, 4, 12.345), ("milk", "shop", 2.5, 20.7, 4, None), ("milk", "shop", 2.5, 9.0, 4, 0.0)]
    d = spark.createDataFrame(rows, "p string, r string, price double, savings double, n int, d double")
    got = [x[0] for x in d.select(N.deal_reason(*[F.col(c) for c in d.columns])).collect()]
    assert got == ["shop cut the price of milk by 12.35%, to $2.50: 20% below the mean of 4 retailers", "shop sells milk for $2.50, 20% below the mean of 4 retailers", "shop sells milk for $2.50, one of 4 retailers near you"]


def test_pairs_are_not_grouped_by_user_and_several_homes_count_once(spark):
    drops, users, zips, log = tables(spark, 9)
    twice = users.where("user_id % 10 = 0").withColumn("zip_code", F.lit("z3"))
    both = users.unionByName(twice)
    d = N.trigger_run(drops, both, zips, log, NOW)
    got = {(r.user_id, r.product, r.retailer, r.segment): r.score for r in d.collect()}
    assert len(got) == d.count()
    want = {}
    for each in (users, twice):
        for r in N.trigger_run(drops, each, zips, log, NOW).collect():
            k = (r.user_id, r.product, r.retailer, r.segment)
            want[k] = max(want.get(k, r.score), r.score)
    assert got == want and len(want) > 500
    grouped = [x for x in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [user_id" in x]
    assert grouped and not any("segment#" in x and "product#" in x for x in grouped)


def test_few_keys_meet_over_all_cores(spark):
    from pricelens.sources.tables import meet

    left = spark.range(6000).selectExpr("id", "if(id % 100 = 0, 'rare', 'often') as k")
    right = spark.range(20).selectExpr("id as r", "if(id < 15, 'often', 'rare') as k").union(spark.sql("select 99L, 'none'"))
    out = meet(left, right, ["k"], ["id"])
    assert sorted(map(tuple, out.select("k", "id", "r").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "id", "r").collect()))
    loads = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(loads) > 3 and max(loads) < 0.6 * sum(loads)
