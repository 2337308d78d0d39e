"""Queries of mapped, nearest and legacy matching, lookups, lists and candidate dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import catalog as C
from ..operators import history as H
from ..operators import matching as M
from ..operators import notify as N
from ..operators import offers as O
from ..sources import tables as S
from .history import BASE, DELTA, HIST, LATEST, history
from .places import hav
from .registry import query


def _sql(adapters: str, ctes: list[str], body: str) -> str:
    return "WITH " + ", ".join([*(S.CTE[a] for a in adapters.split()), *ctes]) + " " + body


def _deals(spark: SparkSession, sf: str) -> DataFrame:
    return S.deals(spark, sf).select("deal_id", F.col("retailer").alias("retailer_key"), "zip_code")


@query(_sql("deals stores", [], "SELECT deal_id, matched_store FROM deals d LEFT JOIN (SELECT retailer_key, zip_code, min(store_id) AS matched_store FROM stores GROUP BY 1, 2) s ON s.retailer_key = d.retailer AND s.zip_code = d.zip_code"))
def j2_match_mapped(spark: SparkSession, sf: str) -> DataFrame:
    s = S.stores(spark, sf)
    mapping = s.select(F.concat(F.upper("retailer_key"), F.lit("-V2")).alias("variant"), F.col("retailer_key").alias("base")).distinct()
    d = _deals(spark, sf).withColumn("retailer_key", F.concat("retailer_key", F.lit("-v2")))
    return M.match_mapped(d, s, mapping).select("deal_id", "matched_store")


_FAR = hav("z.latitude", "z.longitude", "s.latitude", "s.longitude")


@query(_sql("deals stores zips", [], f"""SELECT deal_id, matched_store FROM deals d LEFT JOIN (SELECT p.retailer, p.zip_code, arg_min(s.store_id, ({_FAR}, s.store_id)) AS matched_store FROM (SELECT DISTINCT retailer, zip_code FROM deals) p JOIN zips z USING (zip_code)
  JOIN stores s ON s.retailer_key = p.retailer WHERE {_FAR} <= CASE WHEN p.retailer IN ('retailer_3', 'retailer_4') THEN 60 ELSE 20 END GROUP BY 1, 2) m ON m.retailer = d.retailer AND m.zip_code = d.zip_code"""))  # fmt: skip
def j4_match_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return M.match_nearest(_deals(spark, sf), S.stores(spark, sf), S.zips(spark), 20.0, ["retailer_3", "retailer_4"], 60.0).select("deal_id", "matched_store")


_ONE = "one AS (SELECT retailer_key, s.zip_code, arg_min(store_id, (coalesce(" + _FAR + ", 1e9), store_id)) AS matched_store, count(*) AS n FROM stores s LEFT JOIN zips z ON z.zip_code = s.zip_code GROUP BY 1, 2)"


@query(_sql("deals stores zips", [_ONE], "SELECT deal_id, matched_store, CASE WHEN n = 1 THEN 'single' WHEN n > 1 THEN 'multi_nearest' ELSE 'created' END AS matched_by FROM deals d LEFT JOIN one ON one.retailer_key = d.retailer AND one.zip_code = d.zip_code"))
def j7_match_or_create(spark: SparkSession, sf: str) -> DataFrame:
    return M.match_or_create(_deals(spark, sf), S.stores(spark, sf), S.zips(spark))[0].select("deal_id", "matched_store", "matched_by")


@query(_sql("deals stores zips", [_ONE], "SELECT DISTINCT d.retailer AS retailer_key, d.zip_code FROM deals d LEFT JOIN one ON one.retailer_key = d.retailer AND one.zip_code = d.zip_code WHERE n IS NULL"))
def j7_created_stores(spark: SparkSession, sf: str) -> DataFrame:
    return M.match_or_create(_deals(spark, sf), S.stores(spark, sf), S.zips(spark))[1]


@query(_sql("deals stores", [HIST, BASE, LATEST, DELTA], """SELECT d.match_key, d.store_id, current_price, delta_type, h.brand, h.category, zip_code FROM delta d
  JOIN (SELECT match_key, arg_min(brand, (day, store_id)) AS brand, arg_min(category, (day, store_id)) AS category FROM hist GROUP BY 1) h USING (match_key) LEFT JOIN stores s ON s.store_id = d.store_id WHERE delta_type IN ('drop', 'new')"""))  # fmt: skip
def j12_trigger_deals(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    return M.trigger_deals(H.deal_delta(h, S.AS_OF), h, S.stores(spark, sf), ["drop", "new"])


@query(_sql("deals", [], "SELECT deal_id FROM deals WHERE retailer IN (SELECT 'retailer_' || n_nationkey FROM nation WHERE n_regionkey < 3) AND retailer NOT IN ('retailer_1', 'retailer_2')"))
def f10_allowed(spark: SparkSession, sf: str) -> DataFrame:
    allow = S.table(spark, sf, "nation").where("n_regionkey < 3").select(F.concat(F.lit("retailer_"), "n_nationkey"))
    deny = spark.createDataFrame([("retailer_1",), ("retailer_2",)], "k string")
    return M.allowed(S.deals(spark, sf), "retailer", allow, deny).select("deal_id")


@query(_sql("users", [], "SELECT user_id FROM users WHERE segment IN ('power', 'regular')"))
def f12_segments(spark: SparkSession, sf: str) -> DataFrame:
    return N.in_segments(S.users(spark, sf), ["power", "regular"]).select("user_id")


@query("SELECT event_id AS log_id FROM events WHERE event_type IN ('view', 'click')")
def f12_triggers(spark: SparkSession, sf: str) -> DataFrame:
    return N.of_triggers(S.notification_log(spark, sf), ["view", "click"]).select("log_id")


@query(_sql("deals", [], "SELECT DISTINCT deal_id, min(store_id) AS store_id, 0 AS seq FROM deals GROUP BY deal_id UNION ALL SELECT deal_id, NULL, 2 FROM deals GROUP BY deal_id"))
def u4_u6_candidates(spark: SparkSession, sf: str) -> DataFrame:
    d = S.deals(spark, sf).groupBy("deal_id").agg(F.min("store_id").alias("store_id"), F.min("retailer").alias("retailer_key"), F.min("zip_code").alias("zip_code"))
    local = d.select("deal_id", F.col("store_id").alias("id"), "retailer_key", "zip_code", F.lit("1 Main St").alias("address"))
    rows = S.union_all(
        [
            local.withColumns({"seq": F.lit(0), "distance_miles": F.lit(1.0)}), local.withColumns({"seq": F.lit(1), "distance_miles": F.lit(2.0)}),
            local.withColumns({"id": F.lit(None).cast("long"), "seq": F.lit(2), "distance_miles": F.lit(3.0)}), local.withColumns({"id": F.lit(None).cast("long"), "seq": F.lit(3), "distance_miles": F.lit(None).cast("double"), "address": F.lit("1 main st, unit 5")}),
        ]
    )
    return C.dedup_candidates(rows).select("deal_id", F.col("id").alias("store_id"), "seq")


@query("""SELECT p_partkey, array_to_string(list_filter(a || list_filter(b, lambda x: NOT list_contains(a, x)), lambda x: x IS NOT NULL), ',') AS issues
  FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN [lower(p_brand), split_part(p_name, ' ', 1)] ELSE [] END AS a, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS b FROM part)""")
def u8_merge_issues(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split("p_name", " ")
    big = F.when(F.col("p_size") > 25, F.array(F.lower("p_brand"), w[0]))
    return S.table(spark, sf, "part").select("p_partkey", F.array_join(C.merge_issues(big, F.array(w[0], w[1])), ",").alias("issues"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 5 = 0 THEN 999 ELSE p_size END, p_retailprice DESC, p_partkey) AS place FROM part ORDER BY place LIMIT 50")
def w10_sort_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    p = S.table(spark, sf, "part").withColumn("d", F.when(F.col("p_size") % 5 > 0, F.col("p_size")))
    return A.best_rows(p, [("d", 999, False), ("p_retailprice", None, True)], "p_partkey", 50).select("p_partkey", "place")


@query("SELECT p_brand, arg_max(p_name, (p_size * 10 + n * 0.1::DOUBLE, p_name)) AS best FROM (SELECT p_brand, p_name, max(p_size) AS p_size, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1")
def w11_best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    d = S.table(spark, sf, "part").groupBy("p_brand", "p_name").agg(F.max("p_size").alias("p_size"), F.count("*").alias("n"))
    return O.best_candidate(d, ["p_brand"], "p_name", F.col("p_size"), F.col("n"))


@query(_sql("deals users zips stores", [HIST, BASE, LATEST, DELTA], f"""SELECT user_id, count(*) AS n FROM (SELECT user_id, coalesce(radius_miles, 25) AS r, latitude, longitude FROM users JOIN zips USING (zip_code)) u,
  (SELECT match_key, latitude AS la, longitude AS lo FROM (SELECT d.match_key, zip_code FROM delta d JOIN stores s ON s.store_id = d.store_id WHERE delta_type = 'drop') JOIN zips USING (zip_code)) d WHERE {hav("u.latitude", "u.longitude", "la", "lo")} <= r GROUP BY 1"""))  # fmt: skip
def n8_trigger_pairs(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    drops = M.trigger_deals(H.deal_delta(h, S.AS_OF), h, S.stores(spark, sf), ["drop"]).where("zip_code is not null")
    u = S.users(spark, sf).withColumn("radius_miles", F.coalesce("radius_miles", F.lit(25.0)))
    return N.near_counts(drops, u, S.zips(spark))
