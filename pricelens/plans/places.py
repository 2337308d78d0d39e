"""Queries of distances and matching (G*, J*, A16, A18, F9-F11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import matching as M
from ..sources import tables as S
from .registry import query


def hav(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = geo.MILES) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * {radius}::DOUBLE * asin(least(1.0::DOUBLE, sqrt({a}))))"


def c2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


_DIST = c2(hav("z.latitude", "z.longitude", "s.latitude", "s.longitude"))
NEAR = f"""near AS (SELECT point_id, store_id, retailer_key, geocode_confidence, slat, slon, miles AS distance_miles, exact FROM (
  SELECT z.zip_code AS point_id, store_id, retailer_key, geocode_confidence, s.latitude AS slat, s.longitude AS slon, {_DIST} AS miles, {hav("z.latitude", "z.longitude", "s.latitude", "s.longitude")} AS exact FROM zips z, stores s) WHERE exact <= 25)"""


def _points(spark: SparkSession) -> DataFrame:
    return S.zips(spark).withColumnRenamed("zip_code", "point_id")


def _sql(adapters: str, ctes: list[str], body: str) -> str:
    return "WITH " + ", ".join([*(S.CTE[a] for a in adapters.split()), *ctes]) + " " + body


@query(_sql("stores zips", [NEAR], "SELECT point_id, rank, store_id, retailer_key, distance_miles FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance_miles, store_id) AS rank FROM near) WHERE rank <= 5"))
def j8_stores_near(spark: SparkSession, sf: str) -> DataFrame:
    return M.stores_near(_points(spark), S.stores(spark, sf), 25.0, 5)


@query(_sql("stores zips", [NEAR], "SELECT point_id, retailer_key, arg_min(store_id, (exact, store_id)) AS store_id, min(distance_miles) AS distance_miles FROM near WHERE geocode_confidence NOT IN ('zip_centroid', 'zip') GROUP BY 1, 2"))
def j9_nearest_per_retailer(spark: SparkSession, sf: str) -> DataFrame:
    return M.nearest_per_retailer(_points(spark), S.stores(spark, sf), 25.0)


_ASKED = """asked AS (SELECT retailer || '/' || zip_code AS request_id, 'retailer_' || replace(retailer, 'retailer_', '') AS retailer_key, zip_code, zip_code::BIGINT % 2 = 0 AS pointed FROM (SELECT DISTINCT retailer, zip_code FROM deals))"""


@query(_sql("deals stores zips", [_ASKED], f"""SELECT request_id, coalesce(a, b) AS store_id, CASE WHEN a IS NOT NULL THEN 'nearest' WHEN b IS NOT NULL THEN 'zip' ELSE 'none' END AS found_by, {c2("miles")} AS distance_miles FROM asked LEFT JOIN (
  SELECT request_id, arg_min(store_id, (m, store_id)) AS a, min(m) AS miles FROM (SELECT request_id, store_id, {hav("z.latitude", "z.longitude", "s.latitude", "s.longitude")} AS m FROM asked JOIN zips z USING (zip_code) JOIN stores s USING (retailer_key) WHERE pointed AND geocode_confidence = 'high') WHERE m <= 25 GROUP BY 1) USING (request_id)
  LEFT JOIN (SELECT request_id, min(store_id) AS b FROM asked JOIN stores USING (retailer_key, zip_code) GROUP BY 1) USING (request_id)"""))  # fmt: skip
def j9_store_of_request(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda c: F.regexp_extract(c, r"(\d+)$", 1)
    by_name = lambda c: n(c).cast("int") % 3 == 0
    p = S.deals(spark, sf).select("retailer", "zip_code").distinct().join(S.zips(spark), "zip_code", "left")
    here = F.col("zip_code").cast("long") % 2 == 0
    asked = p.select(
        F.concat_ws("/", "retailer", "zip_code").alias("request_id"), F.when(by_name("retailer"), F.concat(F.lit(" RETAILER "), n("retailer"))).otherwise(F.concat(F.lit("Retailer-"), n("retailer"))).alias("retailer"), "zip_code",
        F.when(here, F.col("latitude")).alias("latitude"), F.when(here, F.col("longitude")).alias("longitude"),
    )
    k = n("retailer_key")
    s = S.stores(spark, sf).withColumn("retailer", F.concat(F.lit("Retailer "), k)).withColumn("retailer_key", F.concat(F.when(by_name("retailer_key"), "other").otherwise("retailer"), k))
    return M.store_of_request(asked, s, 25.0)


_DN = """dn AS (SELECT point_id, deal_id, d.store_id, canonical, price, distance_miles, slat, slon FROM (SELECT point_id, deals.*, distance_miles, slat, slon, row_number() OVER (PARTITION BY point_id ORDER BY price, deal_id) AS k
  FROM deals JOIN near USING (store_id) WHERE price > 0) d WHERE k <= 50)"""


@query(_sql("deals stores zips", [NEAR, _DN], "SELECT point_id, deal_id, store_id, canonical, price, distance_miles, row_number() OVER (PARTITION BY point_id ORDER BY distance_miles, price, deal_id) AS rank FROM dn"))
def j10_deals_near(spark: SparkSession, sf: str) -> DataFrame:
    return M.deals_near(_points(spark), S.deals(spark, sf), S.stores(spark, sf), 25.0, 50)


@query(_sql("deals stores zips", [NEAR, _DN], "SELECT point_id, slat AS latitude, slon AS longitude, count(*) AS n_deals, min(price) AS best_price, arg_min(canonical, (price, deal_id)) AS best_product, min(distance_miles) AS distance_miles FROM dn GROUP BY 1, 2, 3"))
def a16_map_pins(spark: SparkSession, sf: str) -> DataFrame:
    s = S.stores(spark, sf)
    return M.map_pins(M.deals_near(_points(spark), S.deals(spark, sf), s, 25.0, 50), s)


_PAIRS = "pairs AS (SELECT DISTINCT retailer AS retailer_key, zip_code FROM deals)"
_WATER = f"""m AS (SELECT p.retailer_key, p.zip_code, s1, s2, s3 FROM pairs p
  LEFT JOIN (SELECT retailer_key, zip_code, min(store_id) AS s1 FROM stores GROUP BY 1, 2) a USING (retailer_key, zip_code)
  LEFT JOIN (SELECT retailer_key, substr(zip_code, 1, 3) AS z3, min(store_id) AS s2 FROM stores GROUP BY 1, 2 HAVING count(*) = 1) b ON p.retailer_key = b.retailer_key AND substr(p.zip_code, 1, 3) = z3
  LEFT JOIN (SELECT x.retailer_key, x.zip_code, arg_min(store_id, ({hav("z.latitude", "z.longitude", "s.latitude", "s.longitude")}, store_id)) AS s3 FROM pairs x JOIN zips z USING (zip_code) JOIN stores s ON s.retailer_key = x.retailer_key
    WHERE {hav("z.latitude", "z.longitude", "s.latitude", "s.longitude")} <= 50 GROUP BY 1, 2) c ON p.retailer_key = c.retailer_key AND p.zip_code = c.zip_code),
  matched AS (SELECT deal_id, d.retailer AS retailer_key, d.zip_code, coalesce(s1, s2, s3) AS matched_store, CASE WHEN s1 IS NOT NULL THEN 'zip' WHEN s2 IS NOT NULL THEN 'zip3' WHEN s3 IS NOT NULL THEN 'nearest' ELSE 'none' END AS matched_by
  FROM deals d JOIN m ON d.retailer = m.retailer_key AND d.zip_code = m.zip_code)"""


def matched(spark: SparkSession, sf: str) -> DataFrame:
    d = S.deals(spark, sf).select("deal_id", F.col("retailer").alias("retailer_key"), "zip_code")
    return M.match_waterfall(d, S.stores(spark, sf), S.zips(spark))


@query(_sql("deals stores zips", [_PAIRS, _WATER], "SELECT * FROM matched"))
def j1_j5_match_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf)


@query(_sql("deals stores zips", [_PAIRS, _WATER], f"SELECT matched_by, count(*) AS n, {c2('count(*)::DOUBLE / (SELECT count(*) FROM matched) * 100')} AS pct FROM matched GROUP BY 1"))
def a18_match_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.audit import match_coverage

    return match_coverage(matched(spark, sf))


@query(_sql("deals stores zips", [_PAIRS, _WATER], f"SELECT *, pct < 80 AS low FROM (SELECT retailer_key, count(*) AS n, count(matched_store) AS n_matched, {c2('count(matched_store)::DOUBLE / count(*) * 100')} AS pct FROM matched GROUP BY 1 ORDER BY n DESC, retailer_key LIMIT 20)"))
def a18_retailer_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.audit import retailer_coverage

    return retailer_coverage(matched(spark, sf))


def _match_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = S.deals(spark, sf).select(F.col("retailer").alias("retailer_key"), "zip_code").distinct()
    d = p.select(F.concat_ws("/", "retailer_key", "zip_code").alias("id"), "retailer_key", "zip_code", F.lit(None).cast("double").alias("store_lat"), F.lit(None).cast("double").alias("store_lng"))
    return d, S.stores(spark, sf).withColumnRenamed("store_id", "id"), S.zips(spark)


_J6 = f"""c AS (SELECT p.retailer_key || '/' || p.zip_code AS id, store_id, s.zip_code = p.zip_code AS same, {hav("z.latitude", "z.longitude", "s.latitude", "s.longitude")} AS miles
  FROM pairs p JOIN zips z USING (zip_code) JOIN stores s ON s.retailer_key = p.retailer_key),
  j6 AS (SELECT p.retailer_key || '/' || p.zip_code AS id, coalesce(a, b) AS store_id, CASE WHEN na = 1 THEN 'zip_single' WHEN na > 1 THEN 'zip_multi' WHEN nb > 0 THEN 'nearest_within_radius'
    WHEN p.retailer_key NOT IN (SELECT retailer_key FROM stores) THEN 'no_catalog' ELSE 'no_store_within_radius' END AS match_confidence, coalesce(nullif(na, 0), nb, 0)::INT AS candidate_store_count, {c2("coalesce(da, db)")} AS miles FROM pairs p
  LEFT JOIN (SELECT id, arg_min(store_id, (miles, store_id)) FILTER (same) AS a, count(*) FILTER (same) AS na, min(miles) FILTER (same) AS da,
    arg_min(store_id, (miles, store_id)) FILTER (miles <= 15) AS b, count(*) FILTER (miles <= 15) AS nb, min(miles) FILTER (miles <= 15) AS db FROM c GROUP BY 1) x ON x.id = p.retailer_key || '/' || p.zip_code)"""


@query(_sql("deals stores zips", [_PAIRS, _J6], "SELECT * FROM j6"))
def j6_match_store(spark: SparkSession, sf: str) -> DataFrame:
    m = M.match_store(*_match_input(spark, sf))
    return m.select("id", "store_id", "match_confidence", "candidate_store_count", (F.floor(F.col("distance_miles") * 100 + 0.5) / 100).alias("miles"))


@query(_sql("deals stores zips", [_PAIRS, _J6], "SELECT id, store_id, match_confidence, CASE WHEN store_id IS NOT NULL THEN 'own_' || split_part(id, '/', 1) END AS key FROM j6"))
def j6_match_by_name(spark: SparkSession, sf: str) -> DataFrame:
    d, s, z = _match_input(spark, sf)
    d = d.withColumns({"retailer": F.upper("retailer_key"), "retailer_key": F.concat(F.lit("unknown_"), "retailer_key")})
    s = s.withColumns({"retailer": F.concat(F.lit(" "), "retailer_key"), "retailer_key": F.concat(F.lit("own_"), "retailer_key")})
    return M.match_store(d, s, z).select("id", "store_id", "match_confidence", F.col("store_retailer_key").alias("key"))


@query(_sql("deals stores zips", [_PAIRS, _J6], "SELECT id, store_id, CASE WHEN store_id IS NULL THEN match_confidence ELSE 'remapped' END AS reason FROM j6"))
def j18_repair_store_ids(spark: SparkSession, sf: str) -> DataFrame:
    d, s, z = _match_input(spark, sf)
    return M.repair_store_ids(d.withColumn("store_id", F.lit(-1).cast("long")), s, z)


@query(_sql("deals", [], "SELECT deal_id, CASE WHEN store_id % 10 = 3 THEN NULL ELSE store_id END AS store_id FROM deals"))
def j19_clear_refs(spark: SparkSession, sf: str) -> DataFrame:
    gone = S.stores(spark, sf).where("store_id % 10 = 3").select("store_id")
    return M.clear_refs(S.deals(spark, sf).select("deal_id", "store_id"), gone)


_CANDS = "[store_id, (store_id + 1) % (SELECT count(*) FROM supplier), (store_id + 7) % (SELECT count(*) FROM supplier)]"


@query(_sql("deals stores zips", [], f"""SELECT deal_id, arg_min(c, ({hav("z.latitude", "z.longitude", "s.latitude", "s.longitude")}, c)) AS resolved_store
  FROM (SELECT DISTINCT deal_id, zip_code, unnest({_CANDS}) AS c FROM deals) d JOIN zips z USING (zip_code) JOIN stores s ON s.store_id = c GROUP BY deal_id"""))  # fmt: skip
def j11_resolve_store(spark: SparkSession, sf: str) -> DataFrame:
    n = S.table(spark, sf, "supplier").agg(F.count("*").alias("n_stores"))
    d = S.deals(spark, sf).join(S.zips(spark), "zip_code").crossJoin(F.broadcast(n))  # one row
    k = F.col("store_id")
    d = d.select("deal_id", "store_id", "latitude", "longitude", F.array(k, (k + 1) % F.col("n_stores"), (k + 7) % F.col("n_stores")).alias("candidate_store_ids")).distinct()
    return M.resolve_store(d, S.stores(spark, sf)).groupBy("deal_id").agg(F.min("resolved_store").alias("resolved_store"))


_NEAR10 = NEAR.replace("exact <= 25", "exact <= 10").replace("near AS", "near10 AS")


@query(_sql("stores zips", [_NEAR10], "SELECT zip_code AS point_id, " + ", ".join(f"coalesce(bool_or(retailer_key = 'retailer_{i}'), false) AS near_retailer_{i}" for i in (1, 2, 3)) + " FROM zips LEFT JOIN near10 ON point_id = zip_code GROUP BY 1"))
def j15_retailer_proximity(spark: SparkSession, sf: str) -> DataFrame:
    return M.retailer_proximity(_points(spark), S.stores(spark, sf), ["retailer_1", "retailer_2", "retailer_3"])


@query(_sql("stores", [], "SELECT store_id FROM stores s WHERE EXISTS (SELECT 1 FROM stores t WHERE round(t.latitude, 4) = round(s.latitude, 4) AND round(t.longitude, 4) = round(s.longitude, 4) AND t.retailer_key <> s.retailer_key)"))
def j16_centroid_suspects(spark: SparkSession, sf: str) -> DataFrame:
    return M.centroid_suspects(S.stores(spark, sf)).select("store_id")


_REC = hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")


@query(_sql("stores", [], f"SELECT store_id, EXISTS (SELECT 1 FROM stores b WHERE b.store_id % 3 = 0 AND {_REC} <= 6) AS keep FROM stores a WHERE store_id % 3 > 0"))
def j17_reconcile_keep(spark: SparkSession, sf: str) -> DataFrame:
    s = S.stores(spark, sf)
    return M.reconcile(s.where("store_id % 3 > 0"), s.where("store_id % 3 = 0"), 6.0)[0].select("store_id", "keep")


@query(_sql("stores", [], f"SELECT zip_code, min(store_id) AS store_id FROM stores b WHERE store_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM stores a WHERE a.store_id % 3 > 0 AND {_REC} <= 6) GROUP BY 1"))
def j17_reconcile_missing(spark: SparkSession, sf: str) -> DataFrame:
    s = S.stores(spark, sf)
    return M.reconcile(s.where("store_id % 3 > 0"), s.where("store_id % 3 = 0"), 6.0)[1].select("zip_code", "store_id")


@query(_sql("deals stores", [], "SELECT DISTINCT retailer AS retailer_key, CASE WHEN s.retailer_key IS NULL THEN 'missing' ELSE 'centroid_only' END AS reason FROM deals LEFT JOIN (SELECT retailer_key, count(*) FILTER (geocode_confidence = 'high') AS real FROM stores GROUP BY 1) s ON retailer = s.retailer_key WHERE coalesce(real, 0) = 0"))
def j14_coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return M.coverage_gaps(S.deals(spark, sf), S.stores(spark, sf))


@query(_sql("deals", [], "SELECT DISTINCT retailer FROM deals WHERE store_id % 4 = 0 AND retailer NOT IN ('retailer_1')"))
def j26_unmatched_retailers(spark: SparkSession, sf: str) -> DataFrame:
    return M.unmatched_retailers(S.deals(spark, sf), S.stores(spark, sf).where("store_id % 4 > 0"), ["retailer_1"])


@query(_sql("deals", [], """SELECT retailer, n_name AS map_name, 'key_' || n_nationkey AS retailer_key, CASE WHEN n_name IS NULL THEN 'no_target' ELSE 'import' END AS status FROM (
  SELECT DISTINCT retailer, retailer_id FROM deals WHERE store_id % 4 = 0 AND retailer NOT IN ('retailer_1')) LEFT JOIN nation ON n_nationkey = retailer_id AND n_nationkey % 5 > 0"""))
def j26_import_targets(spark: SparkSession, sf: str) -> DataFrame:
    n = S.table(spark, sf, "nation").where("n_nationkey % 5 > 0")
    targets = n.select(F.concat(F.lit(" Retailer_"), "n_nationkey").alias("retailer"), F.col("n_name").alias("map_name"), F.concat(F.lit("key_"), "n_nationkey").alias("retailer_key"))
    return M.import_targets(M.unmatched_retailers(S.deals(spark, sf), S.stores(spark, sf).where("store_id % 4 > 0"), ["retailer_1"]), targets)


@query(
    _sql(
        "deals stores zips",
        [NEAR],
        """SELECT request_id, rank, store_id, retailer_key, distance_miles, price FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY price, distance_miles, store_id) AS rank FROM (
  SELECT p_partkey AS request_id, n.store_id, n.retailer_key, n.distance_miles, b.price FROM part JOIN near n ON n.point_id = (p_partkey % 200 + 90000)::VARCHAR
  JOIN (SELECT canonical, store_id, min(price) AS price FROM deals WHERE price > 0 GROUP BY 1, 2) b ON b.canonical = p_name AND b.store_id = n.store_id)) WHERE rank <= 5""",
    )
)
def a14_nearby_prices(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    asked = S.table(spark, sf, "part").select(k.alias("request_id"), F.col("p_name").alias("canonical"), (k % 200 + 90000).cast("string").alias("zip_code"))
    return M.nearby_prices(asked, S.deals(spark, sf), S.stores(spark, sf), S.zips(spark), 25.0, 5)


@query(_sql("deals stores", [], """SELECT store_id, CASE WHEN store_id % 2 = 0 THEN 'own' ELSE a END AS address FROM stores LEFT JOIN (SELECT retailer, zip_code, arg_min('street ' || deal_id, deal_id) AS a FROM deals GROUP BY 1, 2) d ON retailer = retailer_key AND d.zip_code = stores.zip_code"""))
def j24_attach_addresses(spark: SparkSession, sf: str) -> DataFrame:
    d = S.deals(spark, sf).select(F.col("retailer").alias("retailer_key"), "zip_code", F.col("deal_id").alias("id"), F.concat(F.lit("street "), "deal_id").alias("address"))
    return M.attach_addresses(S.stores(spark, sf).withColumn("address", F.when(F.col("store_id") % 2 == 0, "own")), d).select("store_id", "address")


@query(_sql("stores zips", [], f"""SELECT store_id, CASE WHEN NOT ok THEN 'outside_us' WHEN km > 50 THEN 'wrong_city' ELSE 'ok' END AS verdict, km AS km_from_zip FROM (SELECT store_id, x BETWEEN -125 AND -66 AS ok,
  floor({hav("s.latitude", "x", "z.latitude", "z.longitude", geo.KILOMETRES)} * 10 + 0.5) / 10 AS km FROM (SELECT *, longitude + (store_id % 4)::DOUBLE * 0.5 - CASE WHEN store_id % 9 = 0 THEN 60 ELSE 0 END AS x FROM stores) s LEFT JOIN zips z USING (zip_code))"""))  # fmt: skip
def g15_classify_geocode(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.catalog import classify_geocode

    k = F.col("store_id")
    s = S.stores(spark, sf).withColumn("longitude", F.col("longitude") + (k % 4).cast("double") * 0.5 - F.when(k % 9 == 0, 60).otherwise(0))
    return classify_geocode(s, S.zips(spark)).select("store_id", "verdict", "km_from_zip")


@query(_sql("stores zips", [], f"""SELECT store_id, arg_min(b, r) AS clat, CASE WHEN count(r) = 0 THEN 'failed' ELSE 'accepted' END AS status FROM (SELECT store_id, r, b FROM stores s LEFT JOIN (
  SELECT store_id AS i, unnest([1, 2]) AS r, unnest([latitude + (store_id % 3)::DOUBLE, latitude + (store_id % 2)::DOUBLE]) AS b FROM stores) c ON i = store_id AND {hav("b", "longitude", "(SELECT latitude FROM zips z WHERE z.zip_code = s.zip_code)", "(SELECT longitude FROM zips z WHERE z.zip_code = s.zip_code)", geo.KILOMETRES)} <= 50) GROUP BY 1""".replace("ON i = store_id AND", "ON i = store_id AND")))  # fmt: skip
def g25_accept_geocode(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.catalog import accept_geocode

    s, k = S.stores(spark, sf), F.col("store_id")
    at = F.array(F.struct(F.lit(1).alias("r"), (F.col("latitude") + (k % 3).cast("double")).alias("b")), F.struct(F.lit(2).alias("r"), (F.col("latitude") + (k % 2).cast("double")).alias("b")))
    c = s.select("store_id", "longitude", F.explode(at).alias("x")).select("store_id", F.col("x.r").alias("provider_rank"), F.col("x.b").alias("clat"), F.col("longitude").alias("clon"))
    return accept_geocode(s, c, S.zips(spark)).select("store_id", "clat", "status")


_FAR = hav("u.latitude", "u.longitude", "z.latitude", "z.longitude")


@query(_sql("users zips", [], f"""SELECT user_id, count(*) AS n_zips FROM (SELECT user_id, coalesce(radius_miles, 25) AS r, latitude, longitude FROM users JOIN zips USING (zip_code)) u, zips z WHERE {_FAR} <= r GROUP BY 1"""))
def j13_f11_candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.notify import candidate_pairs

    u = S.users(spark, sf).withColumn("radius_miles", F.coalesce("radius_miles", F.lit(25.0)))
    z = S.zips(spark)
    return candidate_pairs(z.select("zip_code", F.lit(1).alias("deal")), u, z).groupBy("user_id").agg(F.count("*").alias("n_zips"))
