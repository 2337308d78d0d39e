"""Queries of catalog quality and audits (S4, S5, G1-G11, G16-G24, G26, C*, U*, A19, A20, A24-A27, A29, J22, J23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import audit as A
from ..operators import catalog as C
from ..operators import history as H
from ..sources import tables as S
from .registry import query


def _sql(adapters: str, ctes: list[str], body: str) -> str:
    return "WITH " + ", ".join([*(S.CTE[a] for a in adapters.split()), *ctes]) + " " + body


def _stores(spark: SparkSession, sf: str) -> DataFrame:
    """Stores with the text fields of a raw catalog."""
    k = F.col("store_id")
    s = S.stores(spark, sf)
    return s.select(
        "*",
        F.when(k % 6 > 0, F.concat(F.lit("Retailer "), F.col("retailer_id").cast("string"), F.lit(" Store"))).alias("retailer"),
        F.concat(k.cast("string"), F.lit(" nw main st")).alias("address"),
        F.when(k % 4 > 0, F.lit("los angeles")).alias("city"),
        F.when(k % 5 > 0, F.lit("ca")).alias("state"),
        F.concat(k.cast("string"), F.lit(" NW Main St, Los Angeles, CA "), "zip_code").alias("full_address"),
    )


RAW = """raw AS (SELECT *, CASE WHEN store_id % 6 > 0 THEN 'Retailer ' || retailer_id || ' Store' END AS retailer, store_id || ' nw main st' AS address, CASE WHEN store_id % 4 > 0 THEN 'los angeles' END AS city,
  CASE WHEN store_id % 5 > 0 THEN 'ca' END AS state, store_id || ' NW Main St, Los Angeles, CA ' || zip_code AS full_address FROM stores)"""


@query(
    _sql(
        "stores",
        [RAW],
        """SELECT store_id, store_id || ' NW Main St' AS address, 'Los Angeles' AS city, 'CA' AS state, zip_code, store_id || ' NW Main St, Los Angeles, CA ' || zip_code AS full_address,
  CASE WHEN store_id % 6 = 0 THEN 'missing_retailer' ELSE '' END AS issues, array_to_string(list_filter([CASE WHEN city IS NULL THEN 'city_from_address' END, CASE WHEN state IS NULL THEN 'state_from_address' END], lambda x: x IS NOT NULL), ',') AS notes FROM raw""",
    )
)
def g7_g10_normalize_store(spark: SparkSession, sf: str) -> DataFrame:
    d = C.normalize_store(_stores(spark, sf))
    return d.select("store_id", "address", "city", "state", "zip_code", "full_address", F.array_join("issues", ",").alias("issues"), F.array_join("notes", ",").alias("notes"))


ALIAS = {"Retailer 3 Store": "three", "retailer 4 store": "four"}


@query(_sql("stores", [RAW], "SELECT store_id, CASE WHEN retailer = 'Retailer 3 Store' THEN 'three' WHEN lower(retailer) = 'retailer 4 store' THEN 'four' WHEN contains(lower(retailer), 'retailer 1') THEN 'ones' ELSE replace(replace(lower(retailer), ' store', ''), ' ', '_') END AS key FROM raw"))
def g1_g5_retailer_key(spark: SparkSession, sf: str) -> DataFrame:
    return _stores(spark, sf).select("store_id", C.retailer_key(F.col("retailer"), ALIAS, [("retailer 1", "ones")]).alias("key"))


@query(_sql("stores", [RAW], "SELECT store_id, CASE WHEN retailer = 'Retailer 3 Store' THEN 'three' ELSE retailer END AS shown FROM raw"))
def g1_display(spark: SparkSession, sf: str) -> DataFrame:
    return _stores(spark, sf).select("store_id", C.display_retailer(F.col("retailer"), ALIAS).alias("shown"))


_NAME = "p_brand || CASE p_partkey % 3 WHEN 0 THEN '''' || 's & ' WHEN 1 THEN ' - ' ELSE ' ' END || p_name || CASE p_partkey % 4 WHEN 0 THEN ' Supercenter' WHEN 1 THEN '-Pharmacy' WHEN 2 THEN ' Neighborhood  Market!' ELSE '' END"
_TOKEN = f"trim(regexp_replace(replace(replace(replace(lower({_NAME}), '&', ' and '), '''', ''), '-', ' '), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH n AS (SELECT p_partkey, {_TOKEN} AS t FROM part)
  SELECT p_partkey, CASE WHEN ends_with(t, ' supercenter') THEN 'Supercenter' WHEN ends_with(t, ' neighborhood market') THEN 'Neighborhood Market' WHEN ends_with(t, ' pharmacy') THEN 'Pharmacy' END AS store_type,
    regexp_replace(t, ' (supercenter|neighborhood market|pharmacy)$', '') AS token FROM n"""
)
def g6_canonical_retailer(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    between = F.when(k % 3 == 0, "'s & ").when(k % 3 == 1, " - ").otherwise(" ")
    end = F.when(k % 4 == 0, " Supercenter").when(k % 4 == 1, "-Pharmacy").when(k % 4 == 2, " Neighborhood  Market!").otherwise("")
    c = C.canonical_retailer(F.concat("p_brand", between, "p_name", end))
    return S.table(spark, sf, "part").select("p_partkey", c["retailer"].alias("token"), c["store_type"].alias("store_type"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Walmart' WHEN 1 THEN 'Sam''s Club' WHEN 2 THEN p_brand WHEN 3 THEN 'Wal Mart Discount ' || p_size END AS shown,
  CASE WHEN p_partkey % 5 = 0 THEN 'Supercenter' WHEN p_size % 2 = 0 THEN 'Discount' END AS store_type, CASE p_partkey % 5
    WHEN 0 THEN 'retailer canonicalized: WALMART Supercenter -> Walmart; store_type inferred from retailer variant: Supercenter' || CASE WHEN p_size % 2 = 0 THEN '; store_type overridden by retailer variant: Discount -> Supercenter' ELSE '' END
    WHEN 1 THEN 'retailer canonicalized: SAM''S CLUB -> Sam''s Club' WHEN 2 THEN 'retailer normalized: ' || lower(p_brand) || ' -> ' || p_brand
    WHEN 3 THEN 'retailer normalized: wal-mart discount ' || p_size || ' -> Wal Mart Discount ' || p_size ELSE '' END AS notes FROM part"""
)
def g6_normalize_retailer(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size")
    raw = F.when(k == 0, "WALMART Supercenter").when(k == 1, "SAM'S CLUB").when(k == 2, F.lower("p_brand")).when(k == 3, F.concat(F.lit("wal-mart discount "), size))
    c = C.normalize_retailer(raw, F.when(size % 2 == 0, " discount"), {"sams club": "Sam's Club"})
    return S.table(spark, sf, "part").select("p_partkey", c["retailer"].alias("shown"), c["store_type"].alias("store_type"), F.array_join(c["notes"], "; ").alias("notes"))


_ADDRESS = "p_size || '-' || p_size || '   ' || p_name || CASE p_partkey % 4 WHEN 0 THEN ' St., Ste. #' || p_size WHEN 1 THEN ' SR 5, Suite 4B' WHEN 2 THEN ' Blvd, unit ' || p_size ELSE ' US Hwy 9' END"


def _address() -> F.Column:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    end = F.when(k == 0, F.concat(F.lit(" St., Ste. #"), size)).when(k == 1, " SR 5, Suite 4B").when(k == 2, F.concat(F.lit(" Blvd, unit "), size)).otherwise(" US Hwy 9")
    return F.concat(size, F.lit("-"), size, F.lit("   "), "p_name", end)


def _sub(x: str, *rules: tuple[str, str, str]) -> str:
    for pattern, to, how in rules:
        x = f"regexp_replace({x}, '{pattern}', '{to}', '{how}')"
    return x


_KEY = _sub("lower(trim(a))", (r"\s+", " ", "g"), (r"\bste\.?\s*#?\d+\b", "", "g"), (r"\bunit\s*#?\d+\b", "", "g"), (r"\bsuite\s*#?\d+\b", "", "g"), ("^[, ]+|[, ]+$", "", "g"))
_GEO = "lower(trim(" + _sub("a", (r"[, ]*\b(ste|suite|unit)\.?\s*#?\w+", "", "gi"), (r"^(\d+)-[A-Za-z0-9]+\b", r"\1", "g"), (r"\.", "", "g"), (r"\s+", " ", "g")) + "))"
_ROAD = _sub("lower(a)", *[(p, to, "g") for p, to in G.ROADS])


@query(
    f"""SELECT p_partkey, {_KEY} AS address_key, {_GEO} AS geocode_key, p_brand || ' ' || p_type || ' #' || p_partkey AS store_name,
  regexp_matches(lower(p_name || CASE p_partkey % 5 WHEN 0 THEN ' Fuel Center' WHEN 1 THEN ' Delight' WHEN 2 THEN ' car wash' ELSE '' END), '\\b(fuel|gas station|pharmacy|optical|vision|bakery|deli|liquor|tire|photo|clinic|car wash)\\b') AS non_store,
  {_ROAD} AS road, CASE p_partkey % 3 WHEN 0 THEN 'TX' WHEN 1 THEN 'CA' END AS state FROM (SELECT *, {_ADDRESS} AS a FROM part)"""
)
def g11_g26_addresses(spark: SparkSession, sf: str) -> DataFrame:
    a, k = _address(), F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 5 == 0, " Fuel Center").when(k % 5 == 1, " Delight").when(k % 5 == 2, " car wash").otherwise(""))
    state = F.when(k % 3 == 0, " Texas").when(k % 3 == 1, "ca").otherwise(F.col("p_type"))
    return S.table(spark, sf, "part").select(
        "p_partkey", G.address_key(a).alias("address_key"), G.geocode_key(a).alias("geocode_key"), G.store_name(F.col("p_brand"), F.col("p_type"), k.cast("string")).alias("store_name"),
        G.is_non_store(name).alias("non_store"), G.highway_alias(a).alias("road"), G.norm_state_alias(state).alias("state"),
    )


_SET = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))"
_A, _B = _SET.format("p_name"), _SET.format("p_type || ' ' || split_part(p_name, ' ', 2) || ', ' || p_brand")


@query(
    f"""SELECT p_partkey, len(list_intersect({_A}, {_B}))::DOUBLE / len(list_distinct({_A} || {_B})) AS jaccard,
  CASE WHEN z1 = z2 THEN 1.0::DOUBLE WHEN z1[:3] = z2[:3] THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS zip,
  CASE WHEN m <= 25 THEN 1.0::DOUBLE WHEN m <= 75 THEN 0.9::DOUBLE WHEN m <= 150 THEN 0.75::DOUBLE WHEN m <= 300 THEN 0.5::DOUBLE WHEN m <= 1000 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS near
  FROM (SELECT *, (p_partkey % 7 * 100 + 90000 + p_size % 3)::VARCHAR AS z1, (p_size % 7 * 100 + 90000)::VARCHAR AS z2, CASE WHEN p_size % 10 > 0 THEN (p_partkey * 37 % 1200)::DOUBLE END AS m FROM part)"""
)
def g18_g21_scores(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    other = F.concat("p_type", F.lit(" "), F.get(F.split("p_name", " "), F.lit(1)), F.lit(", "), "p_brand")
    z1, z2 = (k % 7 * 100 + 90000 + size % 3).cast("string"), (size % 7 * 100 + 90000).cast("string")
    metres = F.when(size % 10 > 0, (k * 37 % 1200).cast("double"))
    return S.table(spark, sf, "part").select("p_partkey", G.token_jaccard(F.col("p_name"), other).alias("jaccard"), G.zip_score(z1, z2).alias("zip"), G.geo_score(metres).alias("near"))


_LIKE = "{'n': 'n', 'north': 'n', 'sw': 'sw', 'southwest': 'sw', 'st': 'st', 'street': 'st', 'ave': 'ave', 'avenue': 'ave', 'expy': 'expy', 'expressway': 'expy'}"
_WORTH = f"""CASE WHEN x[i] = y OR map_extract(MAP {_LIKE}, x[i]) = map_extract(MAP {_LIKE}, y) AND len(map_extract(MAP {_LIKE}, y)) > 0 THEN 1.0::DOUBLE
  WHEN least(length(x[i]), length(y)) > 1 AND (starts_with(x[i], y) OR starts_with(y, x[i])) THEN least(length(x[i]), length(y))::DOUBLE / greatest(length(x[i]), length(y)) ELSE 0.0::DOUBLE END"""


@query(
    f"""WITH RECURSIVE w AS (SELECT s_suppkey AS store_id,
    regexp_extract_all(s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN ' n maple avenue 5' WHEN 1 THEN ' sw oak st oak' WHEN 2 THEN ' main expressway' ELSE ' st street stone' END, '[a-z0-9]+') AS x,
    regexp_extract_all(s_suppkey + s_suppkey % 2 || CASE s_suppkey % 5 WHEN 0 THEN ' north map ave.' WHEN 1 THEN ' southwest oaks street 5 oak' WHEN 2 THEN ' expy mainly' WHEN 3 THEN ' stones st' ELSE ' ave, n. maple' END, '[a-z0-9]+') AS y FROM supplier),
  s AS (SELECT store_id, x, y AS free, 0.0::DOUBLE AS total, 1 AS i, greatest(len(x), len(y)) AS n FROM w
    UNION ALL SELECT store_id, x, CASE WHEN v > 0 THEN list_filter(free, lambda y, k: k <> j) ELSE free END, total + v, i + 1, n FROM (
      SELECT *, coalesce(list_max(worths), 0.0::DOUBLE) AS v, list_position(worths, list_max(worths)) AS j FROM (
        SELECT *, list_transform(free, lambda y: {_WORTH}) AS worths FROM s WHERE i <= len(x))))
  SELECT store_id, total / n AS prefix FROM s WHERE i = len(x) + 1"""
)
def g18_token_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses with directions, street names, prefixes and repeated words in other orders."""
    k = F.col("store_id")
    pick = lambda n, *texts: F.element_at(F.array(*map(F.lit, texts)), (k % n + 1).cast("int"))
    a = F.concat(k.cast("string"), pick(4, " N Maple Avenue 5", " SW Oak St Oak", " main expressway", " st street stone"))
    b = F.concat((k + k % 2).cast("string"), pick(5, " North Map Ave.", " Southwest Oaks Street 5 Oak", " expy mainly", " Stones St", " ave, n. maple"))
    return S.stores(spark, sf).select("store_id", G.token_prefix_sim(a, b).alias("prefix"))


@query(
    _sql("stores", [RAW], """SELECT store_id, 2.0::DOUBLE * length(address) / (length(address) + length(full_address)) AS ratio FROM raw
  WHERE 2.0::DOUBLE * length(address) / (length(address) + length(full_address)) >= 0.53::DOUBLE""")
)  # the address begins the full address, so it is the longest block and all that is shared
def g20_ratio_at_least(spark: SparkSession, sf: str) -> DataFrame:
    """The stores whose address is alike enough to the full address, found by bounds before the matcher."""
    d = _stores(spark, sf).withColumn("full", F.lower("full_address"))
    return G.ratio_at_least(d, "address", "full", 0.53).select("store_id", "ratio")


@query()
def g18_g20_similarity(spark: SparkSession, sf: str) -> DataFrame:
    d = _stores(spark, sf)
    ratio = G.sequence_ratio()
    return d.select("store_id", G.token_prefix_sim(F.col("address"), F.col("full_address")).alias("prefix"), ratio(F.col("address"), F.lower("full_address")).alias("ratio"))


@query(_sql("stores", [RAW], "SELECT store_id, (store_id + 1)::DOUBLE AS glat FROM raw WHERE store_id % 2 = 0 UNION ALL SELECT store_id, NULL FROM raw WHERE store_id % 2 = 1"))
def g17_attach_geocode(spark: SparkSession, sf: str) -> DataFrame:
    d = _stores(spark, sf)
    cache = d.where("store_id % 2 = 0").select(G.geocode_key(F.col("full_address")).alias("query_key"), (F.col("store_id") + 1).cast("double").alias("glat"), F.lit(0.0).alias("glon"))
    return C.attach_geocode(d, cache).select("store_id", "glat")


def _issues(far: str) -> str:
    return f"""[CASE WHEN retailer IS NULL THEN 'missing_retailer' END, CASE WHEN city IS NULL THEN 'missing_city' END, CASE WHEN state IS NULL THEN 'missing_state' END,
  CASE WHEN store_id % 9 = 0 THEN 'outside_us' END, {far}, CASE WHEN retailer_key <> replace(replace(lower(retailer), ' store', ''), ' ', '_') THEN 'retailer_key_mismatch' END]"""


@query(
    _sql(
        "stores",
        [RAW],
        f"""SELECT store_id, array_to_string(i, ',') AS issues, len(i) = 0 AS verified, greatest(0.1::DOUBLE, 1.0::DOUBLE - len(i) * 0.15::DOUBLE) AS confidence,
  CASE WHEN list_has_any(i, ['outside_us', 'address_far_from_zip']) THEN 'manual' WHEN list_has_any(i, ['missing_retailer', 'missing_city', 'missing_state']) THEN 'llm' WHEN len(i) > 0 THEN 'auto' ELSE 'none' END AS route
  FROM (SELECT *, list_filter({_issues("CASE WHEN store_id % 9 = 0 THEN 'address_far_from_zip' END")}, lambda x: x IS NOT NULL) AS i FROM raw)""",
    )
)
def c3_c8_verify(spark: SparkSession, sf: str) -> DataFrame:
    d = _stores(spark, sf).withColumn("longitude", F.col("longitude") - F.when(F.col("store_id") % 9 == 0, 60).otherwise(0))
    return C.verify(d, S.zips(spark)).select("store_id", F.array_join("issues", ",").alias("issues"), "verified", "confidence", "route")


@query(_sql("stores", [RAW], "SELECT store_id, state IS NOT NULL AND zip_code::BIGINT % 2 = 1 AS mismatch FROM raw"))
def c4_zip_state(spark: SparkSession, sf: str) -> DataFrame:
    z = S.zips(spark).withColumn("state", F.when(F.col("zip_code").cast("long") % 2 == 1, "NV").otherwise("CA"))
    return C.verify(_stores(spark, sf), z).select("store_id", F.array_contains("issues", "zip_state_mismatch").alias("mismatch"))


@query(_sql("stores", [RAW], "SELECT store_id, CASE WHEN retailer IS NULL OR city IS NULL OR state IS NULL THEN 'unresolved' ELSE 'verified' END AS status FROM raw"))
def c9_c10_verify_repair(spark: SparkSession, sf: str) -> DataFrame:
    return C.verify_repair(_stores(spark, sf), S.zips(spark)).select("store_id", "status")


@query("SELECT p_partkey, p_size || ' ' || upper(p_name[1]) || p_name[2:length(p_name) - length(split_part(p_name, ' ', -1))] || upper(split_part(p_name, ' ', -1)[1]) || split_part(p_name, ' ', -1)[2:] || CASE p_partkey % 3 WHEN 0 THEN ' St' WHEN 1 THEN ' SW Pkwy' ELSE ' Ave, Apt 1.5' END AS address FROM part")
def c9_repair_address(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    end = F.when(k == 0, "  STREET.,").when(k == 1, "-sw parkway").otherwise(" avenue, apt. 1.5 , ")
    d = S.table(spark, sf, "part").select("p_partkey", F.concat("p_size", F.lit(" "), "p_name", end).alias("address"), *[F.lit(None).cast("string").alias(c) for c in ("city", "state", "zip_code", "retailer", "retailer_key")])
    return C.repair(d).select("p_partkey", "address")


@query(_sql("stores", [RAW], "SELECT store_id, city IS NOT NULL AND retailer IS NOT NULL AS verified, CASE WHEN city IS NULL THEN 0.85::DOUBLE WHEN retailer IS NULL THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence, array_to_string(list_filter([CASE WHEN city IS NULL THEN 'a' END, CASE WHEN retailer IS NULL THEN 'b' END], lambda x: x IS NOT NULL), ',') AS issues FROM raw"))
def c7_combine(spark: SparkSession, sf: str) -> DataFrame:
    d = _stores(spark, sf)
    one = lambda c, name, conf: d.select("store_id", F.col(c).isNotNull().alias("verified"), F.when(F.col(c).isNull(), conf).otherwise(1.0).alias("confidence"), F.when(F.col(c).isNull(), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")).alias("issues"))
    return C.combine(one("city", "a", 0.85).union(one("retailer", "b", 0.9))).select("store_id", "verified", "confidence", F.array_join("issues", ",").alias("issues"))


@query(_sql("stores", [RAW], "SELECT store_id, CASE WHEN retailer_id >= 20 THEN 'NOT_TARGET' WHEN store_id % 7 = 0 THEN 'ALREADY_PROMOTED' WHEN store_id % 8 = 0 THEN 'REVIEW_PENDING' WHEN store_id % 3 = 0 THEN 'MISSING_ADDRESS' WHEN city IS NULL THEN 'VALIDATION_FAILED' WHEN store_id % 10 = 1 THEN 'GEOCODE_FAILED' ELSE 'SUCCESS' END AS status FROM raw"))
def c2_promote(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf).select("store_id", "status")


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("store_id")
    d = _stores(spark, sf).withColumns(
        {"promoted": k % 7 == 0, "review_status": F.when(k % 8 == 0, "pending"), "address": F.when(k % 3 > 0, F.col("address")), "issues": F.when(F.col("city").isNull(), F.array(F.lit("missing_city"))).otherwise(F.array().cast("array<string>")), "latitude": F.when(k % 10 != 1, F.col("latitude"))}
    )
    return C.promote(d, [f"retailer_{i}" for i in range(20)])


_GATED = "gated AS (SELECT store_id, store_id % 7 = 0 AS promoted, CASE WHEN retailer_id >= 20 THEN 'NOT_TARGET' WHEN store_id % 7 = 0 THEN 'ALREADY_PROMOTED' WHEN store_id % 8 = 0 THEN 'REVIEW_PENDING' WHEN store_id % 3 = 0 THEN 'MISSING_ADDRESS' WHEN city IS NULL THEN 'VALIDATION_FAILED' WHEN store_id % 10 = 1 THEN 'GEOCODE_FAILED' ELSE 'SUCCESS' END AS status FROM raw)"


@query(_sql("stores", [RAW, _GATED], """SELECT store_id, 'write' AS frame, 'SUCCESS' AS value FROM gated WHERE status = 'SUCCESS' UNION ALL SELECT store_id, 'failure', status FROM gated WHERE status IN ('REVIEW_PENDING', 'MISSING_ADDRESS', 'VALIDATION_FAILED', 'GEOCODE_FAILED')
  UNION ALL SELECT store_id, CASE WHEN status = 'SUCCESS' THEN 'promoted' ELSE 'kept' END, CASE WHEN promoted OR status = 'SUCCESS' THEN 'true' ELSE 'false' END FROM gated WHERE status <> 'NOT_TARGET'"""))  # fmt: skip
def c2_promotion_frames(spark: SparkSession, sf: str) -> DataFrame:
    done, failed, updates = C.promotion_frames(_gated(spark, sf))
    return done.select("store_id", F.lit("write").alias("frame"), F.col("status").alias("value")).union(failed.select("store_id", F.lit("failure"), "reason")).union(updates.select("store_id", "action", F.col("promoted").cast("string")))


@query(_sql("stores", [RAW], "SELECT retailer_key AS retailer, min(store_id) AS seq, CASE WHEN arg_min(city, store_id) IS NULL THEN 'missing_city' ELSE '' END AS reasons FROM (SELECT retailer_key, store_id % 4 AS number, store_id, city FROM raw WHERE store_id % 4 <> 2) GROUP BY retailer_key, number"))
def c1_stage(spark: SparkSession, sf: str) -> DataFrame:
    d = _stores(spark, sf).select(F.col("retailer_key").alias("retailer"), (F.col("store_id") % 4).cast("string").alias("store_number"), F.col("store_id").alias("seq"), "address", "city", F.lit("CA").alias("state"), "zip_code")
    staged = d.where("store_number = '2'").select("retailer", "store_number").distinct()
    return C.stage(d, staged).select("retailer", "seq", F.array_join("review_reasons", ",").alias("reasons"))


@query(_sql("stores", [], "SELECT count(*) AS total, count(DISTINCT store_id) AS unique_ids, 0::BIGINT AS missing_ids, 0 AS duplicate_ids, count(*) FILTER (store_id % 13 = 0) AS missing_coordinates, 0::BIGINT AS outside_us FROM stores"))
def a29_validate_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return C.validate_catalog(S.stores(spark, sf).withColumn("latitude", F.when(F.col("store_id") % 13 > 0, F.col("latitude"))))


@query("SELECT s_suppkey AS store_id, least(1.0::DOUBLE, 0.9::DOUBLE, (0.5::DOUBLE * 2 + (s_suppkey % 5)::DOUBLE / 5) / 3) AS confidence FROM supplier")
def a27_repair_confidence(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    r = S.table(spark, sf, "supplier").select(k.alias("store_id"), F.explode(F.array(F.struct(F.lit(2.0).alias("w"), F.lit(0.5).alias("c")), F.struct(F.lit(1.0).alias("w"), ((k % 5).cast("double") / 5).alias("c")))).alias("x"))
    return C.repair_confidence(r.select("store_id", F.col("x.w").alias("weight"), F.col("x.c").alias("confidence"), F.lit(0.9).alias("overall")))


@query(_sql("stores", [RAW], "SELECT 'missing_' || c AS issue, count(*) AS n FROM (SELECT unnest([CASE WHEN retailer IS NULL THEN 'retailer' END, CASE WHEN city IS NULL THEN 'city' END, CASE WHEN state IS NULL THEN 'state' END]) AS c FROM raw) WHERE c IS NOT NULL GROUP BY 1"))
def a29_issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.issue_counts(C.verify(_stores(spark, sf), S.zips(spark)))


@query("SELECT count(*) AS n, count(*) FILTER (p_size > 10) AS n_filled, floor(count(*) FILTER (p_size > 10)::DOUBLE / count(*) * 100 * 100 + 0.5) / 100 AS pct FROM part")
def a18_candidate_fill(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.when(F.col("p_size") > 20, F.array("p_partkey")).when(F.col("p_size") > 10, F.array("p_partkey", "p_partkey")).when(F.col("p_size") > 5, F.array().cast("array<bigint>"))
    return A.candidate_fill(S.table(spark, sf, "part").select(ids.alias("candidate_store_ids")))


@query(_sql("stores", [], "SELECT *, CASE WHEN n_real::DOUBLE / n >= 0.95 THEN 'good' WHEN n_real::DOUBLE / n >= 0.5 THEN 'partial' ELSE 'bad' END AS status FROM (SELECT retailer_key, count(*) AS n, count(*) FILTER (geocode_confidence <> 'zip_centroid') AS n_real, 0 AS null_zips, count(DISTINCT zip_code) AS n_zips, CASE WHEN bool_or(store_id % 5 > 0) THEN 'CA' ELSE '' END AS states, count(*) FILTER (geocode_confidence IS NULL) AS n_none FROM stores GROUP BY 1)"))
def a19_store_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = A.store_audit(_stores(spark, sf)).withColumns({"states": F.array_join("states", ","), "n_none": F.coalesce(F.try_element_at("confidence", F.lit("none")), F.lit(0))})
    return d.drop("confidence")


@query(_sql("stores", [], "SELECT coalesce(geocode_confidence, 'none') AS confidence, retailer_key, count(*) AS n FROM stores GROUP BY 1, 2 UNION ALL SELECT coalesce(geocode_confidence, 'none'), NULL, count(*) FROM stores GROUP BY 1"))
def a20_geocode_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return A.geocode_coverage(S.stores(spark, sf))


@query("SELECT p_brand AS retailer, count(*) AS n, lower(p_brand) AS rewrite FROM part GROUP BY 1")
def a25_case_variants(spark: SparkSession, sf: str) -> DataFrame:
    return A.case_variants(S.table(spark, sf, "part").select(F.col("p_brand").alias("retailer")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a26_run_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.run_stats(S.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


_C2 = "floor(({0}) * 100 + 0.5) / 100"


@query(
    f"""WITH r AS (SELECT p_name AS one, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS two FROM part)
  SELECT {_C2.format("count(one)::DOUBLE / count(*) * 100")} AS hit_one, {_C2.format("count(two)::DOUBLE / count(*) * 100")} AS hit_two, {_C2.format("count(*) FILTER (one = two)::DOUBLE / count(*) * 100")} AS agree,
  (SELECT {_C2.format("sum(n)::DOUBLE / count(*)")} FROM (SELECT count(*) AS n FROM r GROUP BY one HAVING count(*) > 1)) AS group_one,
  (SELECT {_C2.format("sum(n)::DOUBLE / count(*)")} FROM (SELECT count(*) AS n FROM r WHERE two IS NOT NULL GROUP BY two HAVING count(*) > 1)) AS group_two FROM r"""
)
def a24_compare_canonicalizers(spark: SparkSession, sf: str) -> DataFrame:
    p = S.table(spark, sf, "part").select(F.col("p_name").alias("one"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")).alias("two"))
    return A.compare_canonicalizers(p, "one", "two")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def u1_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    p = S.table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return A.set_difference(S.table(spark, sf, "lineitem").where("l_quantity >= 49"), p, "l_partkey")


@query("SELECT p_partkey, p_brand || ',' || p_name || ',' || p_type AS keys FROM part")
def u2_ordered_union(spark: SparkSession, sf: str) -> DataFrame:
    k = H.ordered_union(F.array("p_brand", "p_name"), F.array("p_name", "p_type", "p_brand"))
    return S.table(spark, sf, "part").select("p_partkey", F.array_join(k, ",").alias("keys"))


@query(_sql("stores", [], "SELECT store_id FROM stores WHERE store_id % 7 = 0 OR geocode_confidence = 'zip_centroid'"))
def u3_flag_union(spark: SparkSession, sf: str) -> DataFrame:
    s = S.stores(spark, sf)
    return A.flag_union("store_id", s.where("store_id % 7 = 0"), s.where("geocode_confidence = 'zip_centroid'"))


@query(_sql("stores", [], "SELECT min(store_id) AS id FROM stores GROUP BY retailer_key, zip_code"))
def u5b_dedup_loose(spark: SparkSession, sf: str) -> DataFrame:
    d = S.stores(spark, sf).select(F.col("store_id").alias("id"), "retailer_key", "zip_code", F.concat(F.lit("street "), "store_id").alias("address"))
    return C.dedup_loose(d).select("id")


def _map_stores(spark: SparkSession, sf: str) -> DataFrame:
    s = S.stores(spark, sf)
    one = s.select("retailer_key", F.lit("way").alias("type"), F.col("store_id").alias("id"), F.col("store_id").cast("string").alias("no"), F.lit("Main St").alias("street"), "zip_code", "latitude", "longitude")
    two = one.withColumns({"type": F.lit("node"), "id": F.col("id") + 1_000_000})
    return one.unionByName(two).withColumn("full_address", F.concat_ws(", ", F.concat_ws(" ", "no", "street"), "zip_code"))


@query(_sql("stores", [], "SELECT min(store_id) AS id, 'way' AS type FROM stores GROUP BY retailer_key, zip_code"))
def u5_dedup_osm(spark: SparkSession, sf: str) -> DataFrame:
    return C.dedup_osm(_map_stores(spark, sf)).select("id", "type")


_METRES = f"2 * {G.METRES}::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({{c}} - {{a}}) / 2), 2) + cos(radians({{a}})) * cos(radians({{c}})) * pow(sin(radians({{d}} - {{b}}) / 2), 2))))"


@query(
    _sql("stores", [RAW], f"""SELECT r.store_id, bool_or({_METRES.format(a="r.latitude", b="r.longitude", c="(x.latitude + CASE WHEN x.store_id % 2 = 0 THEN 0.001::DOUBLE ELSE 0.5::DOUBLE END)", d="x.longitude")} <= 300) AS evidence
  FROM raw r JOIN raw x USING (retailer_key, zip_code) GROUP BY 1""")
)
def c6_external_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Outside stores 111 metres off or far away; any one of the retailer and zip is evidence for all stores there that it is near."""
    d, k = _stores(spark, sf), F.col("store_id")
    x = d.select("retailer_key", "zip_code", F.lit("elsewhere").alias("address"), (F.col("latitude") + F.when(k % 2 == 0, 0.001).otherwise(0.5)).alias("latitude"), "longitude")
    return C.external_evidence(d, x)


@query(
    f"""WITH RECURSIVE p AS (SELECT s_suppkey AS id, s_suppkey % 3 AS r, 34.0::DOUBLE + (s_suppkey * 37 % 23)::DOUBLE * 0.003::DOUBLE AS la, -118.0::DOUBLE + (s_suppkey % 5)::DOUBLE * 0.003::DOUBLE AS lo,
    row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey % 2, s_suppkey) AS i FROM supplier),
  s AS (SELECT DISTINCT r, 0::BIGINT AS i, []::STRUCT(la DOUBLE, lo DOUBLE)[] AS kept, NULL::BIGINT AS id, false AS ok FROM p
    UNION ALL SELECT r, i, CASE WHEN ok THEN list_append(kept, {{'la': la, 'lo': lo}}) ELSE kept END, id, ok FROM (
      SELECT s.r, p.i, s.kept, p.id, p.la, p.lo, len(list_filter(s.kept, lambda x: {_METRES.format(a="x.la", b="x.lo", c="p.la", d="p.lo")} < 500)) = 0 AS ok FROM s JOIN p ON p.r = s.r AND p.i = s.i + 1))
  SELECT id, CASE WHEN id % 2 = 0 THEN 'way' ELSE 'node' END AS type FROM s WHERE ok"""
)
def u5_dedup_near(spark: SparkSession, sf: str) -> DataFrame:
    """Stores of three retailers on a lattice of some 300 m, all with zips and addresses of their own: only distance decides, ways first."""
    k = F.col("store_id")
    own = F.concat(k.cast("string"), F.lit(" Main St"))
    d = S.stores(spark, sf).select(
        F.concat(F.lit("retailer_"), k % 3).alias("retailer_key"), F.when(k % 2 == 0, "way").otherwise("node").alias("type"), k.alias("id"), k.cast("string").alias("no"), F.lit("Main St").alias("street"),
        k.cast("string").alias("zip_code"), own.alias("full_address"), (34.0 + (k * 37 % 23).cast("double") * 0.003).alias("latitude"), (-118.0 + (k % 5).cast("double") * 0.003).alias("longitude"),
    )
    return C.dedup_osm(d).select("id", "type")


@query(_sql("stores", ["""a AS (SELECT store_id AS id, retailer_key, CASE WHEN store_id % 7 > 0 THEN 'street ' || store_id % 4 END AS address FROM stores WHERE store_id IN (SELECT min(store_id) FROM stores GROUP BY retailer_key, zip_code))"""],
  "SELECT min(id) AS id FROM a WHERE address IS NOT NULL GROUP BY retailer_key, address UNION ALL SELECT id FROM a WHERE address IS NULL"))
def u5b_dedup_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """As u5b_dedup_loose, with addresses that repeat within a retailer, and some that are missing."""
    k = F.col("store_id")
    d = S.stores(spark, sf).select(k.alias("id"), "retailer_key", "zip_code", F.when(k % 7 > 0, F.concat(F.lit("street "), k % 4)).alias("address"))
    return C.dedup_loose(d).select("id")


_MOVED = "x.latitude + CASE x.store_id % 4 WHEN 0 THEN 0.0026::DOUBLE WHEN 1 THEN 0.0028::DOUBLE ELSE 0.5::DOUBLE END"


#: How alike two stores' numbers are as words: equal, or one of two or more digits begins the other.
_NUMBERS = "CASE WHEN r.store_id = x.store_id THEN 1.0::DOUBLE WHEN least(length(r.no), length(x.no)) > 1 AND (starts_with(r.no, x.no) OR starts_with(x.no, r.no)) THEN least(length(r.no), length(x.no))::DOUBLE / greatest(length(r.no), length(x.no)) ELSE 0.0::DOUBLE END"


@query(
    _sql("stores", [RAW, "numbered AS (SELECT *, store_id::VARCHAR AS no FROM raw)"], f"""SELECT r.store_id, bool_or({_METRES.format(a="r.latitude", b="r.longitude", c=f"({_MOVED})", d="x.longitude")} <= 300 OR x.store_id % 3 = 0 AND ({_NUMBERS} + 2) / 4 >= 0.7::DOUBLE) AS evidence
  FROM numbered r JOIN numbered x USING (retailer_key, zip_code) GROUP BY 1""")
)
def c6_evidence_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Outside stores 289 and 311 metres off or far away; every third has the store's address without its last word, so that three of four words are alike.

    Another store's number counts as far as it begins the other: 1234 and 12345 are alike by four fifths, which makes 2.8 of four words.
    """
    d, k = _stores(spark, sf), F.col("store_id")
    address = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" NW Main"))).otherwise("elsewhere")
    off = F.when(k % 4 == 0, 0.0026).when(k % 4 == 1, 0.0028).otherwise(0.5)
    return C.external_evidence(d, d.select("retailer_key", "zip_code", address.alias("address"), (F.col("latitude") + off).alias("latitude"), "longitude"))


@query(_sql("stores", [], "SELECT store_id, CASE WHEN store_id % 4 = 0 THEN NULL ELSE latitude END AS latitude, CASE WHEN store_id % 4 = 0 THEN 'zip_centroid' ELSE geocode_confidence END AS geocode_confidence FROM stores"))
def u9_neutralize(spark: SparkSession, sf: str) -> DataFrame:
    s = S.stores(spark, sf)
    return C.neutralize(s, s.where("store_id % 4 = 0").select("store_id")).select("store_id", "latitude", "geocode_confidence")


@query(_sql("stores", [], "SELECT store_id AS id, 'internal' AS source FROM stores WHERE store_id % 2 = 0 UNION ALL SELECT store_id + 1000, 'external' FROM stores WHERE store_id % 3 = 0 AND store_id % 2 > 0"))
def j22_resolve_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("id", "source")


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("store_id")
    d = S.stores(spark, sf).select(k.alias("id"), F.col("retailer_key"), F.concat((k * 7919 % 9973).cast("string"), F.lit(" "), F.md5(k.cast("string")), F.lit(" Street")).alias("address"), F.concat(F.lit("shop "), k.cast("string")).alias("name"), F.concat(F.lit("city"), k.cast("string")).alias("city"), F.lit("CA").alias("state"), "zip_code", "latitude", "longitude")
    ext = d.where("id % 3 = 0").withColumns({"id": F.col("id") + 1000, "address": F.replace("address", F.lit("Street"), F.lit("St"))})
    return C.resolve_entities(d.where("id % 2 = 0"), ext)


_HAV = "2 * 3958.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(latitude - 34.0) / 2), 2) + cos(radians(34.0)) * cos(radians(latitude)) * pow(sin(radians(longitude - -118.0) / 2), 2))))"


@query(_sql("stores", [], f"""SELECT id, source, row_number() OVER (PARTITION BY retailer_key ORDER BY floor({_HAV} * 100 + 0.5) / 100, source = 'external', id) AS place FROM (
  SELECT store_id AS id, 'internal' AS source, * FROM stores WHERE store_id % 2 = 0 UNION ALL SELECT store_id + 1000, 'external', * FROM stores WHERE store_id % 3 = 0 AND store_id % 2 > 0)"""))  # fmt: skip
def j22_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return C.in_order(_resolved(spark, sf), F.lit(34.0), F.lit(-118.0)).select("id", "source", "place")


@query(_sql("deals stores", [], "SELECT deal_id, (deal_id % 3 > 0)::INT::VARCHAR AS stage, min(store_id) AS first FROM deals GROUP BY 1"))
def c11_j23_payload(spark: SparkSession, sf: str) -> DataFrame:
    d = S.deals(spark, sf).groupBy("deal_id").agg(F.min("store_id").alias("store_id"))
    stage = (F.col("deal_id") % 3 > 0).cast("int").cast("string").alias("stage")
    one = lambda more, miles: F.struct((F.col("store_id") + more).alias("store_id"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.lit(miles).alias("distance_miles"), stage)
    p = C.resolution_payload(d.select("deal_id", F.array(one(0, 1.0), one(1, 2.5)).alias("candidates")))
    return p.select("deal_id", F.col("payload.stage").alias("stage"), F.col("payload.store_id").alias("first"))


@query(_sql("deals", [], "SELECT deal_id, CASE WHEN deal_id % 2 = 0 THEN store_id + 1 || ',' || store_id ELSE store_id || ',' || store_id + 1 END AS local, CASE WHEN deal_id % 3 = 0 THEN '1,2' ELSE '2,1' END AS external FROM (SELECT deal_id, min(store_id) AS store_id FROM deals GROUP BY 1)"))
def j23_candidate_buckets(spark: SparkSession, sf: str) -> DataFrame:
    d, k, s = S.deals(spark, sf).groupBy("deal_id").agg(F.min("store_id").alias("store_id")), F.col("deal_id"), F.col("store_id")
    one = lambda i, n, miles: F.struct(i.alias("id"), F.lit(n).alias("seq"), miles.cast("double").alias("distance_miles"))
    none = F.lit(None).cast("long")
    c = F.array(one(s, 0, F.when(k % 2 == 0, 9).otherwise(2)), one(none, 1, F.when(k % 3 == 0, 1)), one(s + 1, 0, F.lit(3)), one(none, 2, F.lit(5)))
    b = C.candidate_buckets(d.select("deal_id", c.alias("candidates")))
    return b.select("deal_id", F.array_join("local", ",").alias("local"), F.array_join("external", ",").alias("external"))


@query(_sql("stores", [], "SELECT store_id AS id, zip_code, store_id || ' Main St, Town, CA ' || zip_code AS full_address FROM stores"))
def s5_osm_to_store(spark: SparkSession, sf: str) -> DataFrame:
    s = S.stores(spark, sf).withColumn("longitude", F.col("longitude") + 0.0)
    k = F.col("store_id")
    tags = F.map_filter(
        F.create_map(F.lit("addr:housenumber"), k.cast("string"), F.lit("addr:street"), F.lit("Main St"), F.lit("addr:city"), F.lit("Town"), F.lit("addr:state"), F.lit("CA"), F.lit("addr:postcode"), F.when(k % 2 == 0, F.concat("zip_code", F.lit("-0001")))),
        lambda _, v: v.isNotNull(),
    )
    z = S.zips(spark).join(s.select("zip_code").distinct(), "zip_code", "left_semi")
    at = z.select("zip_code", F.col("latitude").alias("zlat"), F.col("longitude").alias("zlon"))
    e = s.join(at, "zip_code").select(F.lit("node").alias("type"), k.alias("id"), F.col("zlat").alias("lat"), F.col("zlon").alias("lon"), F.struct(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")).alias("center"), tags.alias("tags"))
    return S.osm_to_store(e, z).select("id", "zip_code", "full_address")


@query(_sql("stores", [], "SELECT store_id AS id, zip_code FROM stores WHERE substr(zip_code, 1, 3) = '901'"))
def s5_zip_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    s = S.stores(spark, sf)
    e = s.select(F.lit("way").alias("type"), F.col("store_id").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).alias("center"), F.create_map(F.lit("addr:postcode"), F.col("zip_code")).alias("tags"))
    return S.osm_to_store(e, S.zips(spark), prefixes=["901"]).select("id", "zip_code")


@query(_sql("stores", [], "SELECT f AS format, retailer_key, store_id::VARCHAR AS store_id, zip_code, latitude, longitude, geocode_confidence FROM stores, (SELECT unnest(['csv', 'json']) AS f)"))
def s4_store_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The stores written as CSV and as JSON lines, and read back."""
    path, none = S.scratch_path(spark, "catalog"), F.lit(None).cast("string")
    d = S.stores(spark, sf).select(none.alias("retailer"), "retailer_key", F.col("store_id").cast("string"), F.concat("store_id", F.lit(' "Main" St, 5')).alias("address"), none.alias("full_address"), "zip_code", "latitude", "longitude", "geocode_confidence", none.alias("geocode_source"))
    d.write.option("header", True).option("escape", '"').csv(f"{path}/csv")
    d.write.json(f"{path}/json")
    columns = ["retailer_key", "store_id", "zip_code", "latitude", "longitude", "geocode_confidence"]
    return S.union_all([S.read_store_catalog(spark, f"{path}/{f}", f).select(F.lit(f).alias("format"), *columns) for f in ("csv", "json")])
