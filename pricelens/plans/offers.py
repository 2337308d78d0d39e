"""Queries of offers, search and comparison (A7-A11, A13, A14, A17, A23, A28, A30, A31, F*, J25, Q*, W4, W5, W12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import offers as O
from ..sources import tables as S
from .registry import query

_MEAN = "floor((sum(round({0} * 100)::BIGINT)::DOUBLE / count({0}) / 100) * 100 + 0.5) / 100"


def mean(c: str) -> str:
    return _MEAN.format(c)


def c2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


PRODUCT = f"""product AS (SELECT canonical, n_retailers, avg_price, best_price, best_retailer, best_zip, category, CASE WHEN avg_price > 0 THEN {c2("(avg_price - best_price) / avg_price * 100")} ELSE 0 END AS savings_pct FROM (
  SELECT canonical, count(DISTINCT retailer) AS n_retailers, {mean("price")} AS avg_price, min(price) AS best_price, arg_min(retailer, (price, deal_id)) AS best_retailer, arg_min(zip_code, (price, deal_id)) AS best_zip, arg_min(category, deal_id) AS category
  FROM deals WHERE price > 0 GROUP BY 1) WHERE n_retailers >= 2)"""


@query(S.with_sql("deals " + "product", "SELECT * FROM product").replace(", product ", f", {PRODUCT} "))
def a7_product_offers(spark: SparkSession, sf: str) -> DataFrame:
    return O.product_offers(S.deals(spark, sf))


@query(
    S.with_sql(
        "deals",
        f""", t AS (SELECT *, count(*) OVER w AS n, median(price) OVER w AS m FROM deals WHERE price > 0 WINDOW w AS (PARTITION BY canonical)),
  kept AS (SELECT * FROM t WHERE n < 3 OR price <= 3 * m), p AS (SELECT canonical, {mean("price")} AS avg_price, count(DISTINCT retailer) AS n_retailers FROM kept GROUP BY 1),
  o AS (SELECT canonical, retailer, zip_code, min(price) AS best_price, count(*) AS n_offers FROM kept GROUP BY 1, 2, 3)
  SELECT *, {c2("(avg_price - best_price) / avg_price * 100")} AS savings_pct FROM o JOIN p USING (canonical) WHERE n_retailers >= 2""",
    ).replace(" ,", ",", 1)
)
def a8_offer_details(spark: SparkSession, sf: str) -> DataFrame:
    return O.offer_details(S.deals(spark, sf))


_TERMS = "(SELECT p_partkey AS request_id, split_part(p_name, ' ', 1 + p_partkey % 2) AS term FROM part)"


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    term = F.get(F.split("p_name", " "), (F.col("p_partkey") % 2).cast("int"))
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("request_id"), term.alias("term"))


@query(
    S.with_sql(
        "deals",
        f"""SELECT p_partkey AS request_id, x.* EXCLUDE (term) FROM {_TERMS} r JOIN (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n_retailers DESC, canonical, brand) AS rank FROM (
  SELECT term, lower(canonical) AS canonical, lower(brand) AS brand, count(DISTINCT retailer) AS n_retailers, min(price) AS min_price, max(price) AS max_price, {mean("price")} AS avg_price,
    arg_min(brand || '|' || canonical, deal_id) AS match_key FROM deals JOIN (SELECT DISTINCT term FROM {_TERMS}) t ON contains(lower(canonical), term) GROUP BY 1, 2, 3)) x USING (term) WHERE rank <= 20""".replace("SELECT p_partkey AS request_id, x.* EXCLUDE (term)", "SELECT r.request_id, x.* EXCLUDE (term)"),
    )
)
def a9_search(spark: SparkSession, sf: str) -> DataFrame:
    return O.search(_requests(spark, sf), S.deals(spark, sf).withColumn("match_key", F.concat_ws("|", "brand", "canonical")))


_SIZE = "CASE WHEN base_unit = 'ct' AND base_amount > 1 AND base_amount <= 5 THEN NULL ELSE (round_even(base_amount * 2, 0) / 2)::VARCHAR || '_' || base_unit END"
_OZ = "CASE base_unit WHEN 'oz' THEN 1.0::DOUBLE WHEN 'lb' THEN 16.0::DOUBLE WHEN 'g' THEN 0.035274::DOUBLE END"
TIERS = f"""rows AS (SELECT *, {_SIZE} AS size_key, floor(price / (base_amount * {_OZ}) * 10000 + 0.5) / 10000 AS ppu FROM offered WHERE price > 0),
  tiers AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY n_retailers DESC, size_key) = 1 AS selected FROM (
    SELECT canonical, size_key, count(DISTINCT retailer) AS n_retailers, min(price) AS min_price FROM rows WHERE size_key IS NOT NULL GROUP BY 1, 2) WHERE n_retailers >= 2)"""
_PICK = "SELECT p_partkey AS request_id, p_name AS canonical FROM part"


def _picks(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_name").alias("canonical"))


@query(f"WITH {S.CTE['deals']}, offered AS (SELECT * FROM deals), {TIERS} SELECT request_id, size_key, n_retailers, min_price, selected FROM ({_PICK}) JOIN tiers USING (canonical)")
def a10_size_tiers(spark: SparkSession, sf: str) -> DataFrame:
    tiers = O.size_tiers(S.deals(spark, sf).where("price > 0"), ["canonical"])  # once for each product
    return S.meet(_picks(spark, sf), tiers, ["canonical"], ["request_id"]).drop("canonical")


def _compare_sql(size: str, offered: str = "SELECT * FROM deals") -> str:
    """Rows comp of requests for a size (an expression over part)."""
    pct = c2("(value - avg_value) / avg_value * 100")
    return f"""WITH {S.CTE["deals"]}, offered AS ({offered}), {TIERS}, asked AS (SELECT p_partkey AS request_id, p_name AS canonical, {size} AS size FROM part),
  shared AS (SELECT canonical, list(size_key) AS keys, max(CASE WHEN selected THEN size_key END) AS top, bool_or(split_part(size_key, '_', 2) IN ('oz', 'lb', 'g')) AS by_ounce FROM tiers GROUP BY 1),
  facts AS (SELECT canonical, count(DISTINCT retailer) AS n_sized, count(DISTINCT CASE WHEN ppu IS NOT NULL THEN retailer END) AS n_converts, count(DISTINCT CASE WHEN ppu IS NOT NULL THEN base_amount END) AS n_amounts FROM rows GROUP BY 1),
  units AS (SELECT canonical, arg_min(base_unit, (-n, base_unit)) AS best FROM (SELECT canonical, base_unit, count(DISTINCT retailer) AS n FROM rows GROUP BY 1, 2) GROUP BY 1),
  act AS (SELECT canonical, size, CASE WHEN size = 'ppu' AND by_ounce THEN 'ppu' WHEN keys IS NOT NULL THEN 'tier' WHEN n_sized < 2 THEN 'all' WHEN n_amounts > 1 AND n_converts >= 2 THEN 'ppu_all' ELSE 'unit' END AS mode,
    CASE WHEN list_contains(keys, size) THEN size ELSE top END AS wanted, keys, best FROM (SELECT DISTINCT canonical, size FROM asked) LEFT JOIN shared USING (canonical) JOIN facts USING (canonical) JOIN units USING (canonical)),
  one AS (SELECT canonical, size, mode, CASE WHEN mode = 'tier' THEN wanted ELSE mode END AS size_key, retailer, min(CASE WHEN mode IN ('ppu', 'ppu_all') THEN ppu ELSE price END) AS value FROM act JOIN rows USING (canonical)
    WHERE CASE mode WHEN 'tier' THEN rows.size_key = wanted WHEN 'ppu' THEN list_contains(keys, rows.size_key) AND ppu IS NOT NULL WHEN 'ppu_all' THEN ppu IS NOT NULL WHEN 'unit' THEN base_unit = best ELSE true END GROUP BY 1, 2, 3, 4, 5),
  m AS (SELECT *, count(*) OVER w AS n, median(value) OVER w AS med FROM one WINDOW w AS (PARTITION BY canonical, size)), kept AS (SELECT *, CASE WHEN mode IN ('ppu', 'ppu_all') THEN 10000 ELSE 100 END AS scale FROM m WHERE n < 3 OR value <= 2 * med),
  a AS (SELECT *, floor(sum(round(value * scale)::BIGINT) OVER w::DOUBLE / count(*) OVER w + 0.5) / scale AS avg_value, count(*) OVER w AS n_retailers,
    row_number() OVER (PARTITION BY canonical, size ORDER BY value, retailer) AS rank FROM kept WINDOW w AS (PARTITION BY canonical, size)),
  comp AS (SELECT request_id, asked.canonical, mode, size_key, retailer, value, avg_value, {pct} AS vs_avg_pct,
    CASE WHEN {pct} <= -15 THEN 'great' WHEN {pct} <= -5 THEN 'good' WHEN {pct} <= 5 THEN 'fair' ELSE 'expensive' END AS quality, rank, n_retailers
    FROM asked JOIN a ON asked.canonical = a.canonical AND asked.size IS NOT DISTINCT FROM a.size) """


_TIER = _compare_sql("NULL::VARCHAR")


@query(_TIER + "SELECT * FROM comp")
def a11_compare_tier(spark: SparkSession, sf: str) -> DataFrame:
    return O.compare(_picks(spark, sf), S.deals(spark, sf))


@query(_compare_sql("'ppu'") + "SELECT * FROM comp")
def a11_compare_ppu(spark: SparkSession, sf: str) -> DataFrame:
    return O.compare(_picks(spark, sf).withColumn("size", F.lit("ppu")), S.deals(spark, sf))


@query(_compare_sql("p_size || '.0_' || CASE p_partkey % 4 WHEN 0 THEN 'oz' WHEN 1 THEN 'lb' WHEN 2 THEN 'g' ELSE 'ct' END") + "SELECT * FROM comp")
def a11_compare_selected(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("oz", "lb", "g", "ct"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    own = S.table(spark, sf, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_name").alias("canonical"), F.concat(F.col("p_size").cast("string"), F.lit(".0_"), unit).alias("size"))
    return O.compare(own, S.deals(spark, sf))


@query(_compare_sql("NULL::VARCHAR", "SELECT * REPLACE ((retailer_id + 6)::DOUBLE AS base_amount, CASE WHEN contains(canonical, 'ring') THEN 'ct' ELSE base_unit END AS base_unit) FROM deals") + "SELECT * FROM comp")
def a11_compare_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """No two retailers share a size: prices per ounce, or the unit with most retailers where nothing can be converted."""
    d = S.deals(spark, sf).withColumns({"base_amount": (F.col("retailer_id") + 6).cast("double"), "base_unit": F.when(F.contains("canonical", F.lit("ring")), "ct").otherwise(F.col("base_unit"))})
    return O.compare(_picks(spark, sf), d)


@query(
    _TIER
    + f"""SELECT request_id, canonical, size_key, n_retailers, avg_value, offers, sizes, CASE WHEN n_retailers <= 1 THEN printf('Found at %s for $%.2f.', first, low)
  ELSE printf('Comparing %d retailers. Best price is $%.2f at %s, saving $%.2f vs the highest price.', n_retailers, low, first, {c2("high - low")}) END AS summary FROM (
  SELECT request_id, canonical, size_key, n_retailers, avg_value, string_agg(retailer || '=' || quality, ',' ORDER BY rank) AS offers, arg_min(retailer, rank) AS first, min(value) AS low, max(value) AS high FROM comp GROUP BY 1, 2, 3, 4, 5)
  LEFT JOIN (SELECT canonical, array_to_string(list_sort(keys), ',') || CASE WHEN len(keys) > 1 AND by_ounce THEN ',ppu' ELSE '' END AS sizes FROM shared) USING (canonical)"""
)
def q5_compare_document(spark: SparkSession, sf: str) -> DataFrame:
    deals, picks = S.deals(spark, sf), _picks(spark, sf)
    d = O.compare_document(O.compare(picks, deals), O.available_sizes(deals, picks))
    offers = F.array_join(F.transform("retailers", lambda r: F.concat(r["retailer"], F.lit("="), r["quality"])), ",")
    return d.select("request_id", "canonical", "size_key", "n_retailers", "avg_value", offers.alias("offers"), F.array_join("sizes", ",").alias("sizes"), "summary")


@query(
    _TIER
    + f"""SELECT request_id, retailer, CASE WHEN rank = 1 AND n_retailers <= 1 THEN 'Only retailer found for this product'
  WHEN rank = 1 THEN printf('Lowest price — $%.2f below average across %d retailers', {c2("avg_value - value")}, n_retailers)
  WHEN {c2("avg_value - value")} > 0 THEN printf('$%.2f below average', {c2("avg_value - value")}) WHEN {c2("avg_value - value")} = 0 THEN 'At average price' ELSE printf('$%.2f above average', -({c2("avg_value - value")})) END AS reason FROM comp"""
)
def w12_reasons(spark: SparkSession, sf: str) -> DataFrame:
    d = O.compare(_picks(spark, sf), S.deals(spark, sf))
    return d.select("request_id", "retailer", O.reason(F.col("rank"), F.col("n_retailers"), F.col("value"), F.col("avg_value")).alias("reason"))


@query(S.with_sql("deals", "SELECT lower(trim(retailer)) AS retailer, count(*) AS n FROM deals GROUP BY 1"))
def a13_retailer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return O.retailer_counts(S.deals(spark, sf))


@query(
    S.with_sql(
        "deals",
        f"""SELECT *, CASE WHEN min_price < median_price THEN floor((median_price - min_price) / median_price * 100 + 0.5)::BIGINT END AS savings_pct FROM (
  SELECT request_id, canonical, min(price) AS min_price, max(price) AS max_price, median(price) AS median_price, count(DISTINCT retailer) AS n_retailers FROM deals JOIN ({_PICK}) r USING (canonical) WHERE price > 0 GROUP BY 1, 2)""",
    )
)
def a14_deal_details(spark: SparkSession, sf: str) -> DataFrame:
    return O.deal_details(_picks(spark, sf), S.deals(spark, sf))


@query(
    S.with_sql(
        "deals users",
        """SELECT request_id, rank, deal_id, canonical, retailer, price FROM (SELECT user_id AS request_id, deals.*, row_number() OVER (PARTITION BY user_id ORDER BY price, deal_id) AS rank
  FROM deals JOIN users USING (zip_code) WHERE price > 0) WHERE rank <= 20""",
    )
)
def a30_browse(spark: SparkSession, sf: str) -> DataFrame:
    r = S.users(spark, sf).select(F.col("user_id").alias("request_id"), "zip_code")
    return O.browse(r, S.deals(spark, sf), 20)


@query(
    S.with_sql(
        "deals",
        f""", basket AS (SELECT DISTINCT c_nationkey AS basket_id, p_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
  cheap AS (SELECT retailer, zip_code, canonical, min(price) AS price FROM deals GROUP BY 1, 2, 3), size AS (SELECT basket_id, count(*) AS z FROM basket GROUP BY 1)
  SELECT basket_id, retailer, zip_code, {c2("sum(round(price * 100)::BIGINT)::DOUBLE / 100")} AS total_price, count(*) AS items_found, (any_value(z) - count(*))::INT AS items_missing FROM basket JOIN cheap ON canonical = p_name JOIN size USING (basket_id) GROUP BY 1, 2, 3""",
    ).replace(" ,", ",", 1)
)
def a28_cart_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Baskets: what the customers of each nation ordered."""
    line, orders, part, customer = (S.table(spark, sf, n) for n in ("lineitem", "orders", "part", "customer"))
    bought = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    b = bought.select(F.col("c_nationkey").alias("basket_id"), F.col("p_name").alias("canonical"))
    return O.cart_totals(b, S.deals(spark, sf))


@query(
    S.with_sql(
        "deals",
        f""", asked AS (SELECT DISTINCT n_regionkey AS request_id, split_part(p_name, ' ', 1 + n_nationkey % 2) AS item FROM nation JOIN part ON p_partkey % 25 = n_nationkey),
  hits AS (SELECT request_id, store_id, deal_id, max(price) AS price, (store_id % 13)::DOUBLE AS miles, list(DISTINCT item) AS items FROM deals JOIN asked ON contains(canonical, item) GROUP BY 1, 2, 3)
  SELECT *, {c2("total + miles * 0.1::DOUBLE")} AS score FROM (SELECT request_id, store_id, {c2("sum(round(price * 100)::BIGINT)::DOUBLE / 100")} AS total, count(*) AS n_deals, len(list_distinct(flatten(list(items))))::INT AS items_found, max(miles) AS miles FROM hits GROUP BY 1, 2)""",
    ).replace(" ,", ",", 1)
)
def a17_cart_stores(spark: SparkSession, sf: str) -> DataFrame:
    """Carts: words of the products, by region."""
    n, p = S.table(spark, sf, "nation"), S.table(spark, sf, "part")
    item = F.get(F.split("p_name", " "), (F.col("n_nationkey") % 2).cast("int"))
    r = p.join(n, F.col("p_partkey") % 25 == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("request_id")).agg(F.collect_set(item).alias("items"))
    d = S.deals(spark, sf).withColumn("distance_miles", (F.col("store_id") % 13).cast("double"))
    return O.cart_stores(r, d)


@query(
    S.with_sql(
        "deals",
        """, k AS (SELECT brand || '|' || canonical || '|' || base_amount::VARCHAR AS key, count(*) AS n, count(DISTINCT retailer) AS r FROM deals GROUP BY 1),
  s AS (SELECT canonical, count(DISTINCT base_amount) AS z FROM deals GROUP BY 1)
  SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_groups, count(*) FILTER (r >= 2) AS n_shared, sum(CASE WHEN r >= 2 THEN n ELSE 0 END)::BIGINT AS rows_shared, (SELECT count(*) FROM s WHERE z > 1) AS names_with_sizes, 0::BIGINT AS n_low, count_if(false) AS n_medium, sum(n)::BIGINT AS n_high FROM k""",
    ).replace(" ,", ",", 1)
)
def a23_key_match_report(spark: SparkSession, sf: str) -> DataFrame:
    return O.key_match_report(S.deals(spark, sf))


@query(
    S.with_sql(
        "deals",
        f"""SELECT date_added BETWEEN DATE '{S.AS_OF}' - 4 AND DATE '{S.AS_OF}' + 2 AS this_week, date_added BETWEEN DATE '{S.AS_OF}' - 30 AND DATE '{S.AS_OF}' AS last_30, date_added >= DATE '2000-05-01' AS custom,
  brand = 'brand#7' AS brand, contains(canonical, 'ring') AS ring, count(*) AS n FROM deals GROUP BY ALL""",
    )
)
def f1_f3_filters(spark: SparkSession, sf: str) -> DataFrame:
    d, day = S.deals(spark, sf), F.col("date_added")
    return d.groupBy(
        O.in_window(day, "current_week", S.AS_OF).alias("this_week"), O.in_window(day, "last_30", S.AS_OF).alias("last_30"), O.in_window(day, "custom", S.AS_OF, "2000-05-01").alias("custom"),
        O.same_text(F.col("brand"), F.lit(" Brand#7")).alias("brand"), O.has_text(F.col("canonical"), F.lit("RING")).alias("ring"),
    ).agg(F.count("*").alias("n"))


@query(
    S.with_sql(
        "deals",
        """SELECT canonical, retailer, count(*) AS n, max(price) AS high FROM (SELECT *, count(*) OVER w AS c, median(price) OVER w AS m FROM deals WHERE price > 0 AND price <= 999999 AND length(canonical) <= 80
  WINDOW w AS (PARTITION BY canonical, retailer)) WHERE c < 3 OR price <= 2 * m GROUP BY 1, 2""",
    )
)
def f4_f6_price_filters(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.history import valid_price

    d = S.deals(spark, sf).where(valid_price(F.col("price")) & (F.length("canonical") <= 80))
    return O.trim_outliers(d, ["canonical", "retailer"]).groupBy("canonical", "retailer").agg(F.count("*").alias("n"), F.max("price").alias("high"))


@query("SELECT p_partkey FROM part WHERE NOT list_has_any(string_split(lower(CASE p_partkey % 3 WHEN 0 THEN 'Apple ' || p_name ELSE p_name END), ' '), ['apple'])")
def f8_no_produce(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Apple "), "p_name")).otherwise(F.col("p_name"))
    return S.table(spark, sf, "part").where(O.no_produce(name)).select("p_partkey")


_ASK = """CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 2 THEN p_name || ' extra words'
  WHEN 3 THEN 'my favourite ' || p_name ELSE split_part(p_name, ' ', 2) || ' of any kind' END"""


@query(
    S.with_sql(
        "deals",
        f""", r AS (SELECT p_partkey AS request_id, p_partkey % 5 AS k, {_ASK} AS term, p_name, split_part(p_name, ' ', 2) AS noun FROM part),
  n AS (SELECT canonical, count(DISTINCT retailer) AS n FROM deals GROUP BY 1), best AS (SELECT split_part(canonical, ' ', 2) AS noun, arg_max(canonical, (n, canonical)) AS top, max(n) AS top_n FROM n GROUP BY 1)
  SELECT request_id, CASE WHEN k = 4 THEN top ELSE p_name END AS canonical, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 4 END AS step, CASE WHEN k = 4 THEN top_n ELSE n END AS n_retailers
  FROM r JOIN n ON canonical = p_name JOIN best USING (noun)""",
    ).replace(" ,", ",", 1)
)
def q1_q4_resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    k, w, p = F.col("p_partkey") % 5, F.split("p_name", " "), S.table(spark, sf, "part")
    term = (
        F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws(" ", w[1], w[0])).when(k == 2, F.concat("p_name", F.lit(" extra words")))
        .when(k == 3, F.concat(F.lit("My Favourite "), "p_name")).otherwise(F.concat(w[1], F.lit(" of any kind")))
    )
    curated = p.select(F.concat(F.lit("my favourite "), "p_name").alias("term"), F.col("p_name").alias("canonical")).distinct()
    return O.resolve_names(p.select(F.col("p_partkey").alias("request_id"), term.alias("term")), S.deals(spark, sf), curated)


@query(
    """SELECT p_partkey AS item_id, p_name AS term, sku, in_stock FROM (SELECT a.p_partkey, a.p_name, b.p_partkey AS sku, b.p_partkey % 2 = 0 AS in_stock,
  row_number() OVER (PARTITION BY a.p_partkey ORDER BY (b.p_partkey % 2 = 0) DESC, abs(a.p_size - b.p_size), b.p_partkey) AS k FROM part a JOIN part b ON a.p_name = b.p_name) WHERE k = 1"""
)
def j25_nearest_size(spark: SparkSession, sf: str) -> DataFrame:
    p = S.table(spark, sf, "part")
    c = p.select(F.col("p_name").alias("term"), F.col("p_partkey").alias("sku"), F.col("p_size").cast("double").alias("value"), F.lit("weight").alias("family"), (F.col("p_partkey") % 2 == 0).alias("in_stock"))
    return O.nearest_size(p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("term"), F.col("p_size").cast("double").alias("value"), F.lit("weight").alias("family")), c)
