"""Queries of notifications (N*, W6-W8, A21, A22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import notify as N
from ..operators import offers as O
from ..operators.history import deal_delta
from ..sources import tables as S
from .history import BASE, DELTA, HIST, LATEST, history
from .offers import PRODUCT, mean
from .places import hav
from .registry import query

NOW = "2024-01-15 12:00:00"


def c2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def _sql(adapters: str, ctes: list[str], body: str) -> str:
    return "WITH " + ", ".join([*(S.CTE[a] for a in adapters.split()), *ctes]) + " " + body


_DEAL = c2("least(100.0::DOUBLE, savings_pct * 0.5::DOUBLE + drop * 0.3::DOUBLE + least(n_retailers::DOUBLE / 10, 1.0::DOUBLE) * 0.2::DOUBLE * 100)")
_BLEND = c2(f"{_DEAL} * 0.7::DOUBLE + 60.0::DOUBLE * 0.3::DOUBLE")


@query(_sql("deals", [PRODUCT], f"SELECT canonical, {_DEAL.replace('drop', 'savings_pct')} AS deal_score, {_BLEND.replace('drop', 'savings_pct')} AS notification_score FROM product"))
def n1_n3_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = N.deal_score(F.col("savings_pct"), F.col("savings_pct"), F.col("n_retailers"))
    return O.product_offers(S.deals(spark, sf)).select("canonical", s.alias("deal_score"), N.blend(s, F.lit(60.0)).alias("notification_score"))


@query(
    _sql(
        "users",
        [],
        f"""SELECT user_id, p_partkey, {c2("CASE WHEN list_contains(category_prefs, p_type) THEN 100.0::DOUBLE ELSE 0 END * 0.6::DOUBLE + CASE WHEN contains(p_name, 'ring') THEN 100.0::DOUBLE WHEN p_brand = 'Brand#3' THEN 80.0::DOUBLE ELSE 0 END * 0.4::DOUBLE")} AS relevance
  FROM users JOIN part ON p_partkey = user_id""",
    )
)
def n2_relevance(spark: SparkSession, sf: str) -> DataFrame:
    d = S.users(spark, sf).join(S.table(spark, sf, "part"), F.col("user_id") == F.col("p_partkey"))
    r = N.relevance(F.col("p_type"), F.col("category_prefs"), F.col("p_name"), F.array(F.lit("Ring")), F.col("p_brand"), F.array(F.lit("brand#3")))
    return d.select("user_id", "p_partkey", r.alias("relevance"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN extract(hour FROM ts) >= 22 OR extract(hour FROM ts) < 7 WHEN 1 THEN extract(hour FROM ts + INTERVAL 9 HOUR) >= 22 OR extract(hour FROM ts + INTERVAL 9 HOUR) < 7 ELSE extract(hour FROM ts) >= 9 AND extract(hour FROM ts) < 17 END AS quiet FROM events")
def n4_quiet_hours(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    zone = F.when(k == 1, "Asia/Tokyo").when(k == 0, "Mars/Phobos").otherwise("UTC")
    day = k == 2
    return S.table(spark, sf, "events").select("event_id", N.quiet(F.col("ts"), zone, F.when(day, 9).otherwise(22), F.when(day, 17).otherwise(7)).alias("quiet"))


_WEEK = f"week AS (SELECT * FROM log WHERE sent_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND sent_at <= TIMESTAMP '{NOW}')"
_KIND = "CASE trigger_type WHEN 'view' THEN 'new_deals' WHEN 'click' THEN 'drop' ELSE trigger_type END"
_GATES = f"""decision AS (SELECT c.*, CASE WHEN is_quiet THEN 'quiet_hours' WHEN EXISTS (SELECT 1 FROM week w WHERE w.user_id = c.user_id AND w.product = c.product AND w.retailer = c.retailer) THEN 'duplicate'
    WHEN coalesce(dn, 0) >= 3 THEN 'daily_cap' WHEN coalesce(sn, 0) >= 1 THEN 'retailer_cap'
    WHEN c.trigger_type = 'new_deals' AND coalesce(new_n, 0) >= 2 THEN 'new_deals_cap' WHEN c.trigger_type = 'drop' AND coalesce(drop_n, 0) >= 1 THEN 'drop_cap'
    WHEN score < 55 THEN 'low_score' WHEN score < CASE segment WHEN 'power' THEN 45 WHEN 'regular' THEN 55 ELSE 70 END THEN 'segment_score' ELSE 'none' END AS blocked_reason FROM cand c
    LEFT JOIN (SELECT user_id, count(*) AS dn FROM week WHERE sent_at > TIMESTAMP '{NOW}' - INTERVAL 1 DAY GROUP BY 1) d ON d.user_id = c.user_id
    LEFT JOIN (SELECT user_id, retailer, count(*) AS sn FROM week GROUP BY 1, 2) s ON s.user_id = c.user_id AND s.retailer = c.retailer
    LEFT JOIN (SELECT user_id, count(*) FILTER ({_KIND} = 'new_deals') AS new_n, count(*) FILTER ({_KIND} = 'drop') AS drop_n FROM week GROUP BY 1) t ON t.user_id = c.user_id)"""
_DECIDE = f"""cand AS (SELECT user_id, product, retailer, {_KIND} AS trigger_type, CASE user_id % 3 WHEN 0 THEN 'power' WHEN 1 THEN 'regular' ELSE 'casual' END AS segment, max(score) * 3 AS score, user_id % 11 = 0 AS is_quiet FROM log GROUP BY 1, 2, 3, 4), {_GATES}"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("trigger_type")
    return S.notification_log(spark, sf).withColumn("trigger_type", F.when(kind == "view", "new_deals").when(kind == "click", "drop").otherwise(kind))


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    k = F.col("user_id") % 3
    c = log.groupBy("user_id", "product", "retailer", "trigger_type").agg((F.max("score") * 3).alias("score"))
    c = c.withColumns({"segment": F.when(k == 0, "power").when(k == 1, "regular").otherwise("casual"), "is_quiet": F.col("user_id") % 11 == 0})
    return N.decide(c, log, NOW)


@query(_sql("log", [_WEEK, _DECIDE], "SELECT user_id, product, retailer, trigger_type, segment, score, is_quiet, blocked_reason FROM decision"))
def n5_w8_gates(spark: SparkSession, sf: str) -> DataFrame:
    return _decisions(spark, sf).select("user_id", "product", "retailer", "trigger_type", "segment", "score", "is_quiet", "blocked_reason")


@query(_sql("log", [_WEEK, _DECIDE], "SELECT blocked_reason, count(*) AS n FROM decision GROUP BY 1"))
def n8_block_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _decisions(spark, sf).groupBy("blocked_reason").agg(F.count("*").alias("n"))


@query(
    _sql(
        "log",
        [_WEEK, _DECIDE],
        """SELECT user_id, product, retailer, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, retailer, product) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, trigger_type ORDER BY score DESC, retailer, product) AS j FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, retailer ORDER BY score DESC, product, trigger_type) AS k FROM decision WHERE blocked_reason = 'none') WHERE k = 1)
  WHERE j <= CASE trigger_type WHEN 'new_deals' THEN 2 WHEN 'drop' THEN 1 ELSE 3 END) WHERE rank <= 3""",
    )
)
def w6_capped(spark: SparkSession, sf: str) -> DataFrame:
    return N.capped(_decisions(spark, sf)).select("user_id", "product", "retailer", "score", "rank")


@query(_sql("log", [], "SELECT log_id, user_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sent_at, log_id) AS k FROM log WHERE score >= 20) WHERE k <= 3"))
def w7_first_above(spark: SparkSession, sf: str) -> DataFrame:
    return N.first_above(S.notification_log(spark, sf), 20.0, 3, [F.col("sent_at"), F.col("log_id")]).select("log_id", "user_id", "score")


@query(_sql("users", [], "SELECT user_id, coalesce(radius_miles, 25.0) AS radius_miles, segment, 22 AS quiet_start, 7 AS quiet_end, coalesce(len(category_prefs), 9) AS n_prefs FROM users"))
def n7_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return N.profiles(S.users(spark, sf)).select("user_id", "radius_miles", "segment", "quiet_start", "quiet_end", F.size("category_prefs").cast("long").alias("n_prefs"))


_TITLE = "list_aggregate(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"
_BELOW = "printf('%d%% below the mean of %d retailers', floor(savings_pct)::BIGINT, n_retailers)"
_SELLS = "printf('%s sells %s for $%.2f', best_retailer, canonical, best_price)"


@query(
    _sql(
        "deals",
        [PRODUCT],
        f"""SELECT canonical, {_TITLE.format("canonical")} || ' at ' || best_retailer AS title, printf('Now $%.2f, %.0f%% below the usual price', best_price, floor(savings_pct)) AS body,
  CASE WHEN contains(canonical, 'a') THEN printf('%s cut the price of %s by %.2f%%', best_retailer, canonical, {c2("savings_pct / 2")}) || printf(', to $%.2f: ', best_price) || {_BELOW}
    WHEN savings_pct >= 15 THEN {_SELLS} || ', ' || {_BELOW} ELSE {_SELLS} || printf(', one of %d retailers near you', n_retailers) END AS reason FROM product""",
    )
)
def n6_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Title, body and reason; products with an a in their name count as dropped by half their savings."""
    m = N.message(F.col("canonical"), F.col("best_retailer"), F.col("best_price"), F.floor("savings_pct").cast("double"))
    drop = F.when(F.contains("canonical", F.lit("a")), S.cents(F.col("savings_pct") / 2))
    why = N.deal_reason(F.col("canonical"), F.col("best_retailer"), F.col("best_price"), F.col("savings_pct"), F.col("n_retailers"), drop)
    return O.product_offers(S.deals(spark, sf)).select("canonical", m["title"].alias("title"), m["body"].alias("body"), why.alias("reason"))


def _scored(drop: str) -> str:
    """The score of a product (columns of product) for a user (category_prefs)."""
    return c2(f"{_DEAL.replace('drop', drop)} * 0.7::DOUBLE + CASE WHEN list_contains(category_prefs, category) THEN 60.0::DOUBLE ELSE 0.0::DOUBLE END * 0.3::DOUBLE")


_DIGEST = f"""digest AS (SELECT *, {_TITLE.format("canonical")} AS name FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, canonical) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, best_retailer ORDER BY score DESC, canonical) AS k FROM (SELECT user_id, canonical, best_retailer, best_price, savings_pct, avg_price - best_price AS saved, {_scored("0.0::DOUBLE")} AS score
    FROM users JOIN zips u ON u.zip_code = users.zip_code, product JOIN zips p ON p.zip_code = product.best_zip WHERE {hav("u.latitude", "u.longitude", "p.latitude", "p.longitude")} <= coalesce(radius_miles, 25)) WHERE score >= 30) WHERE k = 1) WHERE rank <= 3)"""


@query(
    _sql(
        "deals users zips",
        [PRODUCT, _DIGEST],
        "SELECT user_id, rank, canonical, best_retailer, score, name || ' at ' || best_retailer AS title, printf('Now $%.2f, %.0f%% below the usual price', best_price, floor(savings_pct)) AS body FROM digest",
    )
)
def n9_digest(spark: SparkSession, sf: str) -> DataFrame:
    return N.digest(O.product_offers(S.deals(spark, sf)), S.users(spark, sf), S.zips(spark)).drop("best_price", "savings_pct", "saved")


_DEVICES = """devices AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 7 > 0 THEN 'sub-' || (c_custkey + k) END AS provider_subscription_id, c_custkey % 11 > 0 AS active, (c_custkey + k) % 3 > 0 AS enabled FROM customer, (SELECT unnest([0, 1]) AS k)),
  own AS (SELECT user_id, min(provider_subscription_id) AS subscription_id FROM devices WHERE active AND enabled AND provider_subscription_id IS NOT NULL GROUP BY 1)"""


def _devices(spark: SparkSession, sf: str) -> DataFrame:
    """Two devices a customer, some without subscription, inactive or switched off."""
    k, more = F.col("c_custkey"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    d = S.table(spark, sf, "customer").select("c_custkey", more)
    on = (k + F.col("k")) % 3 > 0
    subscription = F.when(k % 7 > 0, F.concat(F.lit("sub-"), (k + F.col("k")).cast("string")))
    return d.select(k.alias("user_id"), subscription.alias("provider_subscription_id"), (k % 11 > 0).alias("active"), on.alias("weekly_summary_enabled"), on.alias("drop_alerts_enabled"))


@query(
    _sql(
        "deals users zips",
        [PRODUCT, _DIGEST, _DEVICES],
        """SELECT user_id, subscription_id, n_deals, CASE WHEN n_deals = 1 THEN printf('Your best deal this week: %s, %d%% below the mean', items, floor(pct)::BIGINT) ELSE printf('These deals save you up to $%d: %s', floor(saved / 100.0::DOUBLE)::BIGINT, items) END AS body FROM (
  SELECT user_id, subscription_id, count(*) AS n_deals, sum(round(saved * 100)::BIGINT)::BIGINT AS saved, max(savings_pct) AS pct, string_agg(printf('%s for $%.2f at %s', name, best_price, best_retailer), ', ' ORDER BY rank) AS items FROM digest JOIN own USING (user_id) GROUP BY 1, 2)""",
    )
)
def n9_digest_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return N.digest_payloads(N.digest(O.product_offers(S.deals(spark, sf)), S.users(spark, sf), S.zips(spark)), _devices(spark, sf))


_RUN = f"""cand AS (SELECT user_id, product, retailer, segment, 'drop' AS trigger_type, extract(hour FROM TIMESTAMP '{NOW}') >= 22 OR extract(hour FROM TIMESTAMP '{NOW}') < 7 AS is_quiet, max(score) AS score FROM (
  SELECT user_id, match_key AS product, retailer_key AS retailer, segment, {c2(c2("least(100.0::DOUBLE, pct * 0.5::DOUBLE + pct * 0.3::DOUBLE + least(1::DOUBLE / 10, 1.0::DOUBLE) * 0.2::DOUBLE * 100)") + " * 0.7::DOUBLE + CASE WHEN list_contains(category_prefs, category) THEN 60.0::DOUBLE ELSE 0.0::DOUBLE END * 0.3::DOUBLE")} AS score
  FROM users JOIN zips u ON u.zip_code = users.zip_code, (SELECT match_key, category, -price_change_pct AS pct, retailer_key, z.latitude, z.longitude FROM delta JOIN stores s ON s.store_id = delta.store_id JOIN zips z ON z.zip_code = s.zip_code WHERE delta_type = 'drop') d
  WHERE {hav("u.latitude", "u.longitude", "d.latitude", "d.longitude")} <= coalesce(radius_miles, 25)) GROUP BY 1, 2, 3, 4, 5, 6)"""


def _drops(spark: SparkSession, sf: str) -> DataFrame:
    delta = deal_delta(history(spark, sf), S.AS_OF).where("delta_type = 'drop'").select(F.col("match_key").alias("product"), "store_id", "category", (-F.col("price_change_pct")).alias("drop_pct"))
    return delta.join(S.stores(spark, sf).select("store_id", F.col("retailer_key").alias("retailer"), "zip_code"), "store_id").drop("store_id")


@query(_sql("deals stores users zips log", [HIST, BASE, LATEST, DELTA, _WEEK, _RUN, _GATES], "SELECT blocked_reason, count(*) AS n, count(DISTINCT user_id) AS users, max(score) AS high FROM decision GROUP BY 1"))
def n8_trigger_run(spark: SparkSession, sf: str) -> DataFrame:
    """From price drops to decisions: pairs within the radius, scores, gates, and the summary of blocks."""
    users, log = S.users(spark, sf), _log(spark, sf)
    return N.block_summary(N.trigger_run(_drops(spark, sf), N.representatives(users, log, NOW), S.zips(spark), log, NOW))


_SENT = """sends AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, retailer, product) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, trigger_type ORDER BY score DESC, retailer, product) AS j FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, retailer ORDER BY score DESC, product) AS k FROM decision WHERE blocked_reason = 'none') WHERE k = 1) WHERE j <= 1)"""


@query(
    _sql(
        "deals stores users zips log",
        [HIST, BASE, LATEST, DELTA, _WEEK, _RUN, _GATES, _SENT, _DEVICES],
        "SELECT s.user_id, product, retailer, score, rank, subscription_id FROM sends s LEFT JOIN own USING (user_id) WHERE rank <= 3",
    )
)
def n8_send_list(spark: SparkSession, sf: str) -> DataFrame:
    """What each user is sent for price drops, and to which device."""
    out = N.send_list(_drops(spark, sf), S.users(spark, sf), S.zips(spark), _log(spark, sf), _devices(spark, sf), NOW)
    return out.select("user_id", "product", "retailer", "score", "rank", "subscription_id")


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND user_id % 3 > 0 AND event_id % 7 > 0")
def n10_devices(spark: SparkSession, sf: str) -> DataFrame:
    d = S.table(spark, sf, "events").select("event_id", (F.col("event_type") != "error").alias("active"), (F.col("user_id") % 3 > 0).alias("new_deals_alerts_enabled"), F.when(F.col("event_id") % 7 > 0, F.col("event_id").cast("string")).alias("provider_subscription_id"))
    return N.eligible_devices(d, "new_deals_alerts_enabled").select("event_id")


@query(
    _sql(
        "log",
        [],
        f"""SELECT level, value, count(*) AS n, count(DISTINCT user_id) AS users, min(score) AS low, max(score) AS high, {mean("score")} AS mean, median(score) AS median FROM (
  SELECT user_id, score, unnest(['day', 'product', 'retailer', 'trigger_type', 'user_id', 'all']) AS level, unnest([sent_at::DATE::VARCHAR, product, retailer, trigger_type, user_id::VARCHAR, '']) AS value FROM log) GROUP BY 1, 2""",
    )
)
def a21_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return N.statistics(S.notification_log(spark, sf))


@query(_sql("log", [], "SELECT (floor(score / 10) * 10)::BIGINT AS bucket, count(*) AS n FROM log GROUP BY 1"))
def a21_score_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return N.score_buckets(S.notification_log(spark, sf))


_BACK = f"""back AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drop_pct, user_id ORDER BY score DESC, canonical) AS k FROM (
  SELECT user_id, canonical, drop_pct, {_scored("drop_pct")} AS score FROM users, (SELECT *, unnest([10.0::DOUBLE, 20.0::DOUBLE, 40.0::DOUBLE]) AS drop_pct FROM product)) WHERE score >= 55) WHERE k <= 3)"""


@query(_sql("deals users", [PRODUCT, _BACK], "SELECT drop_pct, count(*) AS n_sent, count(DISTINCT user_id) AS n_users, median(score) AS median_score FROM back GROUP BY 1"))
def a22_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return N.backtest(O.product_offers(S.deals(spark, sf)), S.users(spark, sf), [10.0, 20.0, 40.0])


@query(_sql("deals users", [PRODUCT, _BACK], "SELECT drop_pct, bucket, sum(n)::BIGINT AS n_sent, array_to_string(list(canonical ORDER BY n DESC, canonical DESC)[1:5], '; ') AS top_products FROM (SELECT drop_pct, (floor(score / 10) * 10)::BIGINT AS bucket, canonical, count(*) AS n FROM back GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def a22_backtest_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return N.backtest_buckets(O.product_offers(S.deals(spark, sf)), S.users(spark, sf), [10.0, 20.0, 40.0])
