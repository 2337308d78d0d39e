import pytest
from pyspark.sql import functions as F

from pricelens.functions import geo as G
from pricelens.operators import catalog as C
from pricelens.operators import matching as M

STORE = "id long, retailer_key string, zip_code string, latitude double, longitude double"
DEAL = "id long, retailer_key string, zip_code string, store_lat double, store_lng double"
ZIPS = "zip_code string, latitude double, longitude double"


def match(spark, stores, deal, zips=()):
    out = M.match_store(spark.createDataFrame([deal], DEAL), spark.createDataFrame(stores, STORE), spark.createDataFrame(list(zips) or [("00000", 0.0, 0.0)], ZIPS))
    return out.first()


@pytest.mark.parametrize("lat,lon,ok", [(None, 1.0, 0), (1.0, None, 0), (0.0, 0.0, 0), (91.0, 1.0, 0), (-91.0, 1.0, 0), (1.0, 181.0, 0), (1.0, -181.0, 0), (float("nan"), 1.0, 0), (float("inf"), 1.0, 0), (34.0983, -118.3267, 1)])
def test_valid_coord(spark, lat, lon, ok):
    d = spark.createDataFrame([(lat, lon)], "a double, b double")
    assert d.select(G.valid_coord(F.col("a"), F.col("b")).alias("x")).first().x == bool(ok)


def test_exact_zip_ignores_null_island(spark):
    m = match(spark, [(10, "wholefoods", "90046", 0.0, 0.0), (20, "wholefoods", "90046", 34.0983, -118.3267)], (1, "wholefoodsv2", "90046", None, None), [("90046", 34.098, -118.327)])
    assert (m.store_id, m.match_confidence, m.store_retailer_key) == (20, "zip_single", "wholefoods")


def test_falls_through_to_nearby(spark):
    m = match(spark, [(10, "wholefoods", "90046", 0.0, 0.0), (30, "wholefoods", "90048", 34.0749, -118.3766)], (1, "wholefoods", "90046", None, None), [("90046", 34.098, -118.327)])
    assert m.store_id == 30 and m.match_confidence == "nearest_within_radius" and m.distance_miles < 15


def test_invalid_stores_and_other_catalogs(spark):
    m = match(spark, [(10, "wholefoods", "90046", 0.0, 0.0), (11, "wholefoods", "90046", None, None), (12, "aldi", "90046", 34.09, -118.32)], (1, "wholefoods", "90046", 34.1, -118.3))
    assert m.store_id is None and m.match_confidence == "no_catalog"


def test_radius_by_banner(spark):
    d = spark.createDataFrame([("aldiv2",), ("smiths",), ("costco",), ("krogerbanner",), ("target",)], "k string")
    assert [r.x for r in d.select(M.radius_of(M.banner_key(F.col("k"))).alias("x")).collect()] == [20.0, 20.0, 30.0, 30.0, 15.0]
    far = match(spark, [(5, "target", "1", 34.0, -118.0)], (1, "target", "2", 34.25, -118.0))
    near = match(spark, [(5, "target", "1", 34.0, -118.0)], (1, "target", "2", 34.2, -118.0))
    assert far.match_confidence == "no_store_within_radius" and near.store_id == 5


def test_name_stands_in_for_a_key_without_stores(spark):
    stores = [(1, "own", "90001", 34.0, -118.0, " El Super"), (2, "own", "90001", 34.1, -118.0, "EL SUPER"), (3, "aldi", "90001", 34.0, -118.0, "Aldi")]
    deals = [(1, "elsuper", "90001", None, None, "el super "), (2, "aldi", "90001", None, None, "el super"), (3, "elsuper", "90001", 34.09, -118.0, "el super"), (4, None, None, None, None, None), (5, "elsuper", "90001", None, None, "el super")]
    out = M.match_store(spark.createDataFrame(deals, DEAL + ", retailer string"), spark.createDataFrame(stores, STORE + ", retailer string"), spark.createDataFrame([("90001", 34.0, -118.0)], ZIPS))
    got = {r.id: (r.store_id, r.match_confidence, r.candidate_store_count, r.store_retailer_key) for r in out.collect()}
    assert got == {1: (1, "zip_multi", 2, "own"), 2: (3, "zip_single", 1, "aldi"), 3: (2, "zip_multi", 2, "own"), 4: (None, "no_catalog", 0, None), 5: (1, "zip_multi", 2, "own")}


def test_store_without_a_point_to_measure_from(spark):
    m = match(spark, [(7, "aldi", "90001", 34.0, -118.0), (8, "aldi", "90002", 34.0, -118.0)], (1, "aldi", "90001", None, None))
    assert (m.store_id, m.match_confidence, m.distance_miles) == (7, "zip_single", None)
    assert match(spark, [(7, "aldi", "90001", 34.0, -118.0)], (1, "aldi", "90009", None, None)).match_confidence == "no_point"


def test_unknown_places_are_not_far(spark):
    d = spark.createDataFrame([(None, 1.0, 2.0, 3.0), (1.0, 2.0, 1.0, 2.0), (0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    got = [r.x for r in d.select(G.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).collect()]
    assert got[:2] == [None, 0.0] and abs(got[2] - 12436.937) < 0.01
    s = spark.createDataFrame([("r", "r", "1 A St", "B", "CA", "99999", 34.0, -118.0, None)], "retailer string, retailer_key string, address string, city string, state string, zip_code string, latitude double, longitude double, full_address string")
    assert C.verify(s, spark.createDataFrame([("90001", 34.0, -118.0)], ZIPS)).first().issues == []


def test_geo_join_equals_brute_force(spark):
    import random

    r = random.Random(1)
    pts = [(i, r.uniform(30, 45), r.uniform(-120, -70)) for i in range(300)]
    p = spark.createDataFrame(pts, "point_id long, latitude double, longitude double")
    s = p.select(F.col("point_id").alias("store_id"), F.col("latitude").alias("plat"), F.col("longitude").alias("plon"))
    got = {(x.point_id, x.store_id) for x in M.geo_join(p, s, 120.0).collect()}
    d = G.haversine(F.col("latitude"), F.col("longitude"), F.col("plat"), F.col("plon"))
    assert got == {(x.point_id, x.store_id) for x in p.crossJoin(s).where(d <= 120.0).collect()}


def test_dedup_osm(spark):
    rows = [("k", "node", 1, "5", "Main", "90001", "5 Main, 90001", 34.0, -118.0), ("k", "way", 2, "5", "Main", "90001", "5 Main, 90001", 34.0001, -118.0), ("k", "way", 3, "9", "Oak", "90002", "9 Oak, 90002", 34.0036, -118.0), ("k", "way", 4, "7", "Elm", "90003", "7 Elm, 90003", 34.1, -118.1)]
    d = spark.createDataFrame(rows, "retailer_key string, type string, id long, no string, street string, zip_code string, full_address string, latitude double, longitude double")
    assert sorted(r.id for r in C.dedup_osm(d).collect()) == [2, 4]


def test_dedup_osm_across_cells_equals_greedy(spark):
    import math
    import random

    r = random.Random(3)
    spots = [(34.2, -118.2), (34.0, -118.0), (0.0, 180.0), (70.0, 20.0), (-34.6, -58.4)]
    rows = []
    for i in range(400):
        lat, lon = r.choice(spots)
        lat, lon = lat + r.uniform(-0.012, 0.012), lon + r.uniform(-0.012, 0.012)
        lon -= 360 if lon > 180 else 0
        where = (None, None) if i % 40 == 0 else (lat, lon)
        rows.append((r.choice(["k", "l", None]), r.choice(["way", "node"]), i, str(i), f"Street {i}", f"{i:05}", f"{i}", *where))
    rows += [("k", "way", 1000 + i, str(1000 + i), f"Street {1000 + i}", f"{1000 + i:05}", f"{1000 + i}", 10.0 + 0.004 * i, 10.0) for i in range(6)]  # a chain

    def far(a, b):
        p, q = math.radians(a[7]), math.radians(b[7])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[8] - a[8]) / 2) ** 2
        return 2 * C.geo.METRES * math.asin(math.sqrt(h))

    kept = []
    for x in sorted(rows, key=lambda x: (x[1] != "way", x[2])):
        if x[7] is None or not any(y[0] == x[0] and y[7] is not None and far(x, y) < 500 for y in kept):
            kept.append(x)
    d = spark.createDataFrame(rows, "retailer_key string, type string, id long, no string, street string, zip_code string, full_address string, latitude double, longitude double")
    assert sorted(x.id for x in C.dedup_osm(d).collect()) == sorted(x[2] for x in kept) and {1000, 1002, 1004} <= {x[2] for x in kept}


def test_candidate_pairs_at_any_radius(spark):
    import random

    from pricelens.operators import notify as N

    r = random.Random(4)
    z = [(f"{i:05}", r.uniform(25, 71), r.uniform(-180, -65)) for i in range(150)] + [("99998", 52.0, 179.5), ("99999", 52.0, -179.5)]
    zips = spark.createDataFrame(z, ZIPS)
    users = spark.createDataFrame([(i, x[0], [10.0, 69.0, 70.0, 100.0, 400.0, 1500.0][i % 6]) for i, x in enumerate(z)], "user_id long, zip_code string, radius_miles double")
    deals = zips.select("zip_code", F.lit(1).alias("deal"))
    got = sorted((x.user_id, x.deal_zip) for x in N.candidate_pairs(deals, users, zips).collect())
    o = zips.select(F.col("zip_code").alias("deal_zip"), F.col("latitude").alias("plat"), F.col("longitude").alias("plon"))
    near = G.haversine(F.col("latitude"), F.col("longitude"), F.col("plat"), F.col("plon")) <= F.col("radius_miles")
    assert got == sorted((x.user_id, x.deal_zip) for x in users.join(zips, "zip_code").crossJoin(o).where(near).collect())


def test_addresses(spark):
    d = spark.createDataFrame([("o'brien 7up-x nw",), (None,)], "t string").select(G.title_dir(F.col("t")).alias("x"))
    assert [r.x for r in d.collect()] == ["O'Brien 7Up X NW", None]
    p = spark.createDataFrame([("1 Main St, Suite 2, Springfield, il 62704",)], "t string").select(G.parse_address(F.col("t")).alias("x")).first().x
    assert tuple(p) == ("1 Main St, Suite 2", "Springfield", "IL", "62704")
    s = spark.createDataFrame([("ABC Grocery Store",), ("Fresh Market #789",), ("##",)], "t string").select(G.retailer_slug(F.col("t")).alias("x"))
    assert [r.x for r in s.collect()] == ["abc", "fresh", None]


def test_likeness_of_addresses_equals_plain_python(spark):
    from difflib import SequenceMatcher

    from pricelens.functions import geo as G

    names = [{"n", "north"}, {"s", "south"}, {"sw", "southwest"}, {"st", "street"}, {"trl", "trail"}]

    def like(x, y):
        return x == y or any({x, y} <= s for s in names)

    def plain(a, b):
        split = lambda x: [w for w in "".join(c if c.isalnum() else " " for c in x.lower()).split()]
        x, free, total = split(a), split(b), 0.0
        n = max(len(x), len(free))
        for w in x:
            worth = [1.0 if like(w, y) else min(len(w), len(y)) / max(len(w), len(y)) if min(len(w), len(y)) > 1 and (w.startswith(y) or y.startswith(w)) else 0.0 for y in free]
            if worth and max(worth) > 0:
                total += max(worth)
                free.pop(worth.index(max(worth)))
        return total / n if n else 0.0

    rows = [("12 main", "12 main"), ("12 main x", "main 12"), ("12 maple way", "12 map"), ("a b", ""), ("", ""), ("5 oak 5", "5 5 oaks"), ("one two", "three four"), ("5 n oak st", "5 North Oak Street"), ("9 sw trail", "southwest 9 trl."), ("s 5", "s5 south 5"), ("stone", "st street"), ("7 a", "7 able")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", G.token_prefix_sim(F.col("a"), F.col("b")).alias("p"), G.sequence_ratio()(F.col("a"), F.col("b")).alias("r")).collect()
    for x in got:
        assert abs(x.p - plain(x.a, x.b)) < 1e-9, (x.a, x.b)
        assert abs(x.r - SequenceMatcher(None, x.a, x.b).ratio()) < 1e-9


def test_candidates_in_lists_are_those_in_rows_without_gathering(spark):
    rows = [(1, 7, 0, 2.0), (1, None, 1, None), (1, 8, 0, 3.0), (1, None, 2, 5.0), (2, 5, 0, None), (2, 4, 0, 1.5), (3, None, 3, 1.0), (1, 6, 0, 2.0)]
    r = spark.createDataFrame(rows, "deal_id long, id long, seq int, distance_miles double")
    packed = r.groupBy("deal_id").agg(F.collect_list(F.struct("id", "seq", "distance_miles")).alias("candidates")).localCheckpoint()
    got = C.candidate_buckets(packed)
    want = [(1, [6, 7, 8], [2, 1]), (2, [4, 5], []), (3, [], [3])]
    assert sorted((x.deal_id, x.local, x.external) for x in got.collect()) == want
    assert sorted((x.deal_id, x.local, x.external) for x in C.candidate_buckets(r).collect()) == want
    stores = r.where("id is not null").select("deal_id", F.col("id").alias("store_id"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), "distance_miles", F.lit("zip").alias("stage"))
    lists = stores.groupBy("deal_id").agg(F.collect_list(F.struct("store_id", "latitude", "longitude", "distance_miles", "stage")).alias("candidates"))
    assert sorted(map(tuple, C.resolution_payload(lists).collect())) == sorted(map(tuple, C.resolution_payload(stores).collect()))
    from pricelens.plans import QUERIES

    for name in ("j23_candidate_buckets", "c11_j23_payload"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan
