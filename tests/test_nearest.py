import math
import random

from pricelens.sources.tables import nearest_zip


def test_nearest_zip_equals_brute_force_at_any_distance(spark):
    r = random.Random(1)
    zips = [(f"{i:05d}", r.uniform(33, 36), r.uniform(-119, -116)) for i in range(200)] + [("99901", 48.0, -70.0), ("99902", None, -70.0), ("99903", 26.0, -81.0)]
    rows = [("node", i, r.uniform(24, 50), r.uniform(-125, -66)) for i in range(150)] + [("way", i, r.uniform(33, 36), r.uniform(-119, -116)) for i in range(150)] + [("way", 7000 + i, 34.0, -118.0) for i in range(2)]

    def far(lat, lon, z):
        return (lat - z[1]) ** 2 + ((lon - z[2]) * math.cos(math.radians((lat + z[1]) / 2))) ** 2

    d = nearest_zip(spark.createDataFrame(rows, "type string, id long, latitude double, longitude double"), spark.createDataFrame(zips, "zip_code string, latitude double, longitude double"))
    got = {(x.type, x.id): x.near_zip for x in d.collect()}
    assert got == {(t, i): min((far(lat, lon, z), z[0]) for z in zips if z[1] is not None)[1] for t, i, lat, lon in rows}


def test_sizes_meet_each_size_of_a_term_once(spark):
    from pricelens.operators.offers import nearest_size

    rows = spark.range(0, 3000, 1, 2).selectExpr("'corn' as term", "id as sku", "cast(id % 3 as double) as value", "'weight' as family", "id % 2 = 0 as in_stock")
    items = spark.range(0, 3000, 1, 2).selectExpr("id as item_id", "'corn' as term", "cast(id % 5 as double) as value", "'weight' as family")
    out = nearest_size(items, rows)
    got = {r.item_id: (r.sku, r.in_stock) for r in out.collect()}
    assert len(got) == 3000 and [got[i] for i in range(5)] == [(0, True), (4, True), (2, True), (2, True), (2, True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "min(sku" in plan


def test_nearby_prices_take_the_cheapest_of_each_point(spark):
    from pricelens.functions.geo import haversine
    from pricelens.operators import matching as M
    from pyspark.sql import functions as F

    r = random.Random(4)
    zips = [(f"z{i}", 33 + i * 0.1, -118.0) for i in range(12)]
    stores = [(i, f"r{i % 5}", 33 + (i % 9) * 0.12, -118 + (i % 3) * 0.01) for i in range(300)] + [(300, "r0", None, -118.0)]
    deals = [(f"p{r.randint(0, 3)}", r.randint(0, 300), float(r.randint(0, 6))) for _ in range(2500)]
    asks = [(i, f"p{i % 5}", f"z{i % 13}") for i in range(200)]
    z = spark.createDataFrame(zips, "zip_code string, latitude double, longitude double")
    s = spark.createDataFrame(stores, "store_id long, retailer_key string, latitude double, longitude double")
    d = spark.createDataFrame(deals, "canonical string, store_id long, price double")
    a = spark.createDataFrame(asks, "request_id long, canonical string, zip_code string")
    far = haversine(z.latitude, z.longitude, s.latitude, s.longitude)
    near = {}
    for x in z.crossJoin(s).select("zip_code", "store_id", "retailer_key", far.alias("m")).where("m <= 25").collect():
        near.setdefault(x.zip_code, []).append((math.floor(x.m * 100 + 0.5) / 100, x.store_id, x.retailer_key))
    low = {}
    for p, i, price in deals:
        if price > 0:
            low[p, i] = min(price, low.get((p, i), price))
    want = set()
    for q, p, c in asks:
        found = sorted((low[p, i], m, i, key) for m, i, key in near.get(c, []) if (p, i) in low)[:5]
        want |= {(q, k + 1, i, key, m, price) for k, (price, m, i, key) in enumerate(found)}
    out = M.nearby_prices(a, d, s, z, 25.0, 5)
    assert {tuple(x) for x in out.collect()} == want and len(want) > 500
    joined = M.nearby_prices(a, d, s, z, 25.0, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in joined.splitlines() if "windowspecdefinition" in x and "plat#" in x]
    assert out.groupBy("request_id").agg(F.count("*").alias("n")).where("n > 5").count() == 0
