"""Queries of product identity (P1-P20) and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables as S
from .registry import query

_BRANDS = "[" + ", ".join("'" + b.replace("'", "''") + "'" for b in sorted({b.lower() for b in T.BRANDS}, key=lambda b: (-len(b), b))) + "]"
#: The oracle's regular expressions have no look-ahead; the names here hold no number of three or four digits.
_FILLER = "(?i)" + "|".join(p for p in T.FILLER if "(?!" not in p)


def _r(s: str, *pairs: tuple[str, str]) -> str:
    for p, to in pairs:
        s = f"regexp_replace({s}, '{p.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return s


def _oz(amount: str, unit: str) -> str:
    cases = " ".join(f"WHEN '{u}' THEN {v}::DOUBLE" for u, v in T.OUNCES.items())
    return f"(floor({amount} * CASE replace(replace(lower({unit}), ' ', ''), '.', '') {cases} END * 100 + 0.5) / 100)"


_N = "replace(replace(product_name, '’', ''''), '‘', '''')"
#: Steps of the identity as CTEs over names.
STEPS = [
    f"""a AS (SELECT *, lower(trim({_N})) AS low FROM names)""",
    f"""b AS (SELECT *, coalesce(list_filter({_BRANDS}, lambda x: starts_with(low, x))[1],
      list_filter(list_transform(string_split(low, ' - ')[2:], lambda s: list_filter({_BRANDS}, lambda x: starts_with(trim({_r("s", ("[™®]+$", ""))}), x))[1]), lambda y: y IS NOT NULL)[1]) AS found_brand FROM a)""",
    r"""c AS (SELECT *, trim(string_split(low, '|')[1]) AS t1 FROM b)""",
    r"""d AS (SELECT *, CASE WHEN contains(t1, ',') AND len(list_filter(regexp_split_to_array(trim(string_split(t1, ',')[1]), '\s+'), lambda w: w <> '')) <= 8
      AND length(trim(regexp_replace(t1, '^[^,]*,', ''))) > 20 THEN trim(string_split(t1, ',')[1]) ELSE t1 END AS t2 FROM c)""",
    r"""e AS (SELECT *, trim(string_split(t2, ' -- ')[1]) AS t3 FROM d)""",
    r"""f AS (SELECT *, CASE WHEN found_brand IS NOT NULL AND starts_with(t3, found_brand) THEN regexp_replace(substr(t3, length(found_brand) + 1), '^[ ,-]+', '') ELSE t3 END AS t4 FROM e)""",
    rf"""g AS (SELECT *, CASE WHEN found_brand IS NOT NULL AND contains(t4, ' - ') THEN {_r("array_to_string(list_filter(string_split(t4, ' - '), lambda p: NOT starts_with(trim(regexp_replace(p, '[™®]+$', '')), found_brand)), ' ')", ("^[ -]+|[ -]+$", ""))} ELSE t4 END AS t5 FROM f)""",
    rf"""h AS (SELECT *, trim({_r("t5", (_FILLER, " "), (r"[®™'\-–/\\|()\[\]{}]", " "), (r"(\d)%", r"\1pct"), (r"[^a-z0-9\s]", ""), (r"(\d)pct", r"\1%"), (r"\s+", " "))}) AS t6 FROM g)""",
    rf"""i AS (SELECT *, trim({_r("trim(" + _r("t6", (rf"\b({T.STOPWORDS})\s*$", "")) + ")", (rf"^({T.STOPWORDS})\b\s*", ""))}) AS t7 FROM h)""",
    f"""j AS (SELECT *, CASE WHEN t7 = '' AND found_brand IS NOT NULL THEN found_brand ELSE t7 END AS t8 FROM i)""",
    f"""k AS (SELECT *, CASE WHEN len(string_split(t8, ' ')) <= 4 AND list_has_any(string_split(t8, ' '), {T.SORTABLE!r}) THEN array_to_string(list_sort(string_split(t8, ' ')), ' ') ELSE t8 END AS canonical_name,
      {_oz("base_amount", "base_unit")} AS own_oz, list_max(list_filter(list_transform(range(1, 1 + len(regexp_extract_all(product_name, '(?i)(\\d+(?:\\.\\d+)?)\\s*(oz|fl\\.?\\s*oz|g|gram|lb|pound|ml|liter)\\b', 1))),
        lambda x: {_oz("regexp_extract_all(product_name, '(?i)(\\d+(?:\\.\\d+)?)\\s*(oz|fl\\.?\\s*oz|g|gram|lb|pound|ml|liter)\\b', 1)[x]::DOUBLE", "regexp_extract_all(product_name, '(?i)(\\d+(?:\\.\\d+)?)\\s*(oz|fl\\.?\\s*oz|g|gram|lb|pound|ml|liter)\\b', 2)[x]")}), lambda y: y >= 1.5)) AS name_oz FROM j)""",
    """ident AS (SELECT product_id, product_name, found_brand, canonical_name, CASE WHEN own_oz >= 1.5 THEN own_oz ELSE coalesce(name_oz, own_oz) END AS size_oz, base_amount, base_unit FROM k)""",
]


def _ident(body: str) -> str:
    return "WITH " + ", ".join([S.CTE["names"], *STEPS]) + " " + body


@query(
    _ident(
        """SELECT product_id, found_brand, canonical_name, size_oz,
  CASE WHEN found_brand IS NOT NULL AND canonical_name <> '' AND size_oz <> 0 THEN found_brand || '|' || canonical_name || '|' || size_oz::VARCHAR
    WHEN found_brand IS NOT NULL AND canonical_name <> '' THEN found_brand || '|' || canonical_name || '|no_size'
    WHEN canonical_name <> '' AND size_oz <> 0 THEN 'unknown_brand|' || canonical_name || '|' || size_oz::VARCHAR END AS match_key,
  CASE WHEN found_brand IS NOT NULL AND canonical_name <> '' AND size_oz <> 0 THEN 'high' WHEN found_brand IS NOT NULL AND canonical_name <> '' THEN 'medium'
    WHEN canonical_name <> '' AND size_oz <> 0 THEN 'low' ELSE 'none' END AS confidence FROM ident"""
    )
)
def p1_p9_match_key(spark: SparkSession, sf: str) -> DataFrame:
    return T.identity(S.product_names(spark, sf)).select("product_id", "found_brand", "canonical_name", "size_oz", "match_key", "confidence")


@query(_ident("SELECT coalesce(found_brand, '') || '|' || canonical_name || '|' || coalesce(base_amount::VARCHAR, 'no_size') AS key, count(*) AS n FROM ident GROUP BY 1"))
def p10_key_v1(spark: SparkSession, sf: str) -> DataFrame:
    d = T.identity(S.product_names(spark, sf))
    return d.groupBy(T.match_key_v1(F.col("found_brand"), F.col("canonical_name"), F.col("base_amount")).alias("key")).agg(F.count("*").alias("n"))


@query(
    _ident(
        """, dict AS (SELECT min(p_type) AS name, p_name AS sig FROM part GROUP BY p_name)
  SELECT product_id, name AS curated FROM ident LEFT JOIN dict ON trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', ' ', 'g')) = sig"""
    ).replace(" ,", ",", 1)
)
def p11_curated_name(spark: SparkSession, sf: str) -> DataFrame:
    d = S.table(spark, sf, "part").select(F.col("p_name").alias("normalized_signature"), F.col("p_type").alias("canonical_name"), F.lit("high").alias("confidence"))
    x = T.identity(S.product_names(spark, sf)).drop("confidence")
    return T.curated_name(x, "product_name", "canonical_name", d).select("product_id", "curated")


_NO_DICT = "normalized_signature string, canonical_name string, confidence string"


@query(
    _ident(
        """SELECT product_id, found_brand AS brand, CASE WHEN length(canonical_name) < 2 THEN substr(lower(product_name), 1, 120) ELSE canonical_name END AS canonical_name,
  coalesce(found_brand, '') || '|' || CASE WHEN length(canonical_name) < 2 THEN substr(lower(product_name), 1, 120) ELSE canonical_name END || '|' || coalesce(base_amount::VARCHAR, 'no_size') AS match_key FROM ident"""
    )
)
def p12_canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    d = S.product_names(spark, sf).withColumns({"brand": F.lit(None).cast("string"), "canonical_name": F.lit(None).cast("string")})
    return T.canonicalize(d, spark.createDataFrame([], _NO_DICT)).select("product_id", "brand", "canonical_name", "match_key")


@query("SELECT p_partkey AS product_id, 'the ' || p_name || ' box' AS canonical_name, p_name AS new_name FROM part WHERE length(p_name) >= 2")
def p13_recanonicalize(spark: SparkSession, sf: str) -> DataFrame:
    d = S.spread(S.table(spark, sf, "part")).select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("the "), "p_name", F.lit(" box")).alias("canonical_name"), F.lit(None).cast("string").alias("brand"))
    return T.recanonicalize(d).select("product_id", "canonical_name", "new_name")


@query(_ident("SELECT product_id, found_brand AS brand, CASE WHEN canonical_name <> '' THEN canonical_name ELSE 'old' END AS canonical_name FROM ident WHERE found_brand IS NOT NULL"))
def p14_backfill_brand(spark: SparkSession, sf: str) -> DataFrame:
    d = S.product_names(spark, sf).withColumns({"brand": F.lit(None).cast("string"), "canonical_name": F.lit("old")})
    return T.backfill_brand(d).select("product_id", "brand", "canonical_name")


@query(
    """WITH x AS (SELECT p_partkey AS product_id, p_brand AS b, p_name AS c, p_size AS s FROM part),
 v AS (SELECT product_id, unnest(list_distinct([b, lower(b)])) AS bb, c, s FROM x), w AS (SELECT product_id, bb, c, unnest([s::VARCHAR, s::VARCHAR || '.0', 'no_size']) AS ss FROM v)
 SELECT product_id, bb || '|' || c || '|' || ss AS variant FROM w"""
)
def p15_key_variants(spark: SparkSession, sf: str) -> DataFrame:
    d = S.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.concat_ws("|", "p_brand", "p_name", F.col("p_size").cast("string")).alias("key"))
    return d.select("product_id", F.explode(T.key_variants(F.col("key"))).alias("variant"))


@query(
    S.with_sql(
        "deals",
        """SELECT CASE WHEN base_unit = 'ct' AND base_amount > 1 AND base_amount <= 5 THEN NULL ELSE (round_even(base_amount * 2, 0) / 2)::VARCHAR || '_' || base_unit END AS size_key,
  count(*) AS n, min(price) AS low FROM deals GROUP BY 1""",
    )
)
def p16_size_key(spark: SparkSession, sf: str) -> DataFrame:
    d = S.deals(spark, sf)
    return d.groupBy(T.size_key(F.col("base_amount"), F.col("base_unit")).alias("size_key")).agg(F.count("*").alias("n"), F.min("price").alias("low"))


@query(
    S.with_sql(
        "deals",
        """SELECT base_unit, base_amount, min(floor(price / (base_amount * CASE base_unit WHEN 'oz' THEN 1.0::DOUBLE WHEN 'lb' THEN 16.0::DOUBLE WHEN 'g' THEN 0.035274::DOUBLE END) * 10000 + 0.5) / 10000) AS best_ppu,
  count(*) AS n FROM deals GROUP BY ALL""",
    )
)
def p17_price_per_oz(spark: SparkSession, sf: str) -> DataFrame:
    ppu = T.price_per_oz(F.col("price"), F.col("base_amount"), F.col("base_unit"))
    return S.deals(spark, sf).groupBy("base_unit", "base_amount").agg(F.min(ppu).alias("best_ppu"), F.count("*").alias("n"))


@query(
    """SELECT p_partkey AS product_id, (CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 128.0::DOUBLE WHEN 2 THEN p_size * 16.0::DOUBLE ELSE p_size END)::DOUBLE AS value,
  CASE p_partkey % 4 WHEN 0 THEN 'vol' WHEN 1 THEN 'vol' WHEN 2 THEN 'weight' ELSE 'count' END AS family FROM part"""
)
def p18_parse_size(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("fl oz", "gal", "lbs", "ct"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    s = T.parse_size(F.concat(F.col("p_size").cast("string"), F.lit(" "), unit))
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), s.alias("s")).select("product_id", "s.value", "s.family")


@query("SELECT array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS words, count(*) AS n FROM part GROUP BY 1")
def p19_word_sort(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "part").groupBy(T.word_sort(F.col("p_name")).alias("words")).agg(F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT DISTINCT p_name AS c FROM part), q AS (SELECT c AS q FROM n UNION SELECT unnest(string_split(c, ' ')) FROM n),
 x AS (SELECT q, c, string_split(q, ' ') AS qw, string_split(c, ' ') AS cw FROM q JOIN n ON list_has_any(string_split(q, ' '), string_split(c, ' ')))
 SELECT q, c, CASE WHEN q = c THEN 1.0::DOUBLE WHEN starts_with(c, q || ' ') OR ends_with(c, ' ' || q) THEN 0.9::DOUBLE
   ELSE floor(len(list_intersect(qw, cw))::DOUBLE / len(list_distinct(qw)) * least(len(qw)::DOUBLE / len(cw), 1.0::DOUBLE) * 1000 + 0.5) / 1000 END AS fit FROM x"""
)
def p20_name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Names and single words against all names that share a word with them."""
    n = S.table(spark, sf, "part").select(F.col("p_name").alias("c")).distinct()
    by_word = n.select("c", F.explode(F.split("c", " ")).alias("w"))
    q = n.select(F.col("c").alias("q")).union(by_word.select("w")).distinct()
    pairs = q.select("q", F.explode(F.split("q", " ")).alias("w")).join(by_word, "w").select("q", "c").distinct()
    return pairs.select("q", "c", T.name_similarity(F.col("q"), F.col("c")).alias("fit"))


# ---- scans and sinks


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= DATE '2001-01-01' AND l_returnflag = 'A'")
def s1_scan(spark: SparkSession, sf: str) -> DataFrame:
    return S.scan(S.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice"], (F.col("l_shipdate") >= "2001-01-01") & (F.col("l_returnflag") == "A"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 5000 AND o_orderkey <= 9000")
def s2_read_since(spark: SparkSession, sf: str) -> DataFrame:
    return S.read_since(S.table(spark, sf, "orders"), "o_orderkey", 5000, 9000).select("o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, count(*) AS n, min(l_quantity) AS low FROM lineitem WHERE l_shipdate >= DATE '2000-01-01' AND l_shipdate < DATE '2001-01-01' GROUP BY 1")
def s3_scan_window(spark: SparkSession, sf: str) -> DataFrame:
    d = S.scan_window(S.table(spark, sf, "lineitem"), "l_shipdate", "2000-01-01", "2001-01-01", inclusive=False)
    return d.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"))


@query("WITH p AS (SELECT o_custkey, max(o_orderkey) AS m FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1) SELECT c_custkey, coalesce(m, c_nationkey)::BIGINT AS v FROM customer LEFT JOIN p ON o_custkey = c_custkey")
def s6_upsert(spark: SparkSession, sf: str) -> DataFrame:
    target = S.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("v"))
    batch = S.table(spark, sf, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("v"))
    return S.upsert(target, batch.join(target.select("c_custkey"), "c_custkey", "left_semi"), ["c_custkey"], [F.desc("v")])


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_name END AS name, p_type FROM part")
def s7_coalesce_update(spark: SparkSession, sf: str) -> DataFrame:
    p = S.table(spark, sf, "part")
    patch = p.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("name"))
    return S.coalesce_update(p.select("p_partkey", F.col("p_name").alias("name"), "p_type"), patch, ["p_partkey"])


@query("SELECT count(*) AS n_rows, count(*) FILTER (p_size > 25) AS n_changed FROM part")
def s8_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    return S.dry_run(S.table(spark, sf, "part"), F.col("p_size") > 25)


@query("SELECT CASE WHEN p_size > 40 THEN 'FAILED' ELSE 'SUCCESS' END AS status, count(*) AS n FROM part GROUP BY 1")
def s9_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = S.table(spark, sf, "part").withColumn("status", F.when(F.col("p_size") > 40, "FAILED").otherwise("SUCCESS"))
    return S.audit_frames(d)[2]


@query(S.with_sql("deals", "SELECT retailer, zip_code, min(deal_id) AS deal_id FROM deals GROUP BY 1, 2"))
def s10_unique_stores(spark: SparkSession, sf: str) -> DataFrame:
    return S.unique_stores(S.deals(spark, sf).select("retailer", "zip_code", "deal_id"), ["retailer", "zip_code"], "deal_id")


@query(S.with_sql("stores zips", "SELECT zip_code, latitude, longitude FROM zips WHERE zip_code IN (SELECT zip_code FROM stores)"))
def s11_zip_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return S.zip_centroids(S.stores(spark, sf), S.zips(spark))[0]
