"""Queries of price history, deltas and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..sources import tables as S
from .registry import query


def history_rows(spark: SparkSession, sf: str, line: DataFrame | None = None) -> DataFrame:
    """Deals as rows of the history job: product by retailer and day."""
    d = S.deals(spark, sf, line)
    return d.select(F.col("canonical").alias("match_key"), F.col("retailer_id").alias("store_id"), F.col("date_added").alias("day"), "price", F.col("deal_id").alias("row_id"), "brand", "category", "base_amount", "base_unit")


def history(spark: SparkSession, sf: str) -> DataFrame:
    return H.daily_price_history(history_rows(spark, sf))


HIST = """hist AS (SELECT canonical AS match_key, retailer_id AS store_id, date_added AS day, min(price) AS price,
  arg_min(brand, (price, deal_id)) AS brand, arg_min(category, (price, deal_id)) AS category, arg_min(base_amount, (price, deal_id)) AS base_amount, arg_min(base_unit, (price, deal_id)) AS base_unit
  FROM deals WHERE price > 0 AND price <= 999999 GROUP BY 1, 2, 3)"""
_NOW = f"DATE '{S.AS_OF}'"
BASE = f"""base AS (SELECT match_key, store_id, floor((sum(round(price * 100)::BIGINT)::DOUBLE / count(*) / 100) * 100 + 0.5) / 100 AS baseline_price, count(*) AS n_days
  FROM hist WHERE day >= {_NOW} - 90 AND day <= {_NOW} GROUP BY 1, 2)"""
LATEST = """latest AS (SELECT match_key, store_id, arg_max(price, day) AS current_price, arg_max(brand, day) AS brand, arg_max(category, day) AS category, max(day) AS last_day FROM hist GROUP BY 1, 2)"""
DELTA = """delta AS (SELECT match_key, store_id, brand, category, current_price, baseline_price, last_day,
  floor(CASE WHEN baseline_price > 0 THEN (current_price - baseline_price) / baseline_price * 100 END * 100 + 0.5) / 100 AS price_change_pct,
  floor((baseline_price - current_price) * 100 + 0.5) / 100 AS absolute_savings,
  CASE WHEN baseline_price IS NULL THEN 'new' WHEN baseline_price = 0 THEN 'unchanged' WHEN (current_price - baseline_price) / baseline_price * 100 < -2 THEN 'drop'
    WHEN (current_price - baseline_price) / baseline_price * 100 > 2 THEN 'rise' ELSE 'unchanged' END AS delta_type FROM latest LEFT JOIN base USING (match_key, store_id))"""
VEL = f"""vel AS (SELECT match_key, store_id, coalesce(sum(changed), 0)::DOUBLE / 1.0::DOUBLE AS deal_velocity FROM (
  SELECT match_key, store_id, (price <> lag(price) OVER (PARTITION BY match_key, store_id ORDER BY day))::INT AS changed FROM hist WHERE day >= {_NOW} - 30 AND day <= {_NOW}) GROUP BY 1, 2)"""
_U = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"
SCORE = f"""score AS (SELECT match_key, store_id, brand, category, current_price, p AS pct_savings, a AS absolute_savings, v AS deal_velocity,
  floor((({_U("p / 50")} * 0.5::DOUBLE + {_U("a / 10")} * 0.25::DOUBLE + {_U("1.0::DOUBLE - v / 10")} * 0.15::DOUBLE + {_U("0.0::DOUBLE / 100")} * 0.1::DOUBLE) * 100) * 100 + 0.5) / 100 AS composite_score
  FROM (SELECT *, greatest(coalesce(-price_change_pct, 0.0::DOUBLE), 0.0::DOUBLE) AS p, coalesce(absolute_savings, 0.0::DOUBLE) AS a, coalesce(deal_velocity, 0.0::DOUBLE) AS v
  FROM delta LEFT JOIN vel USING (match_key, store_id) WHERE delta_type IN ('drop', 'new')))"""


def _sql(upto: list[str], body: str) -> str:
    return "WITH " + ", ".join([S.CTE["deals"], *upto]) + " " + body


@query(_sql([HIST], "SELECT * FROM hist"))
def a1_daily_price_history(spark: SparkSession, sf: str) -> DataFrame:
    return history(spark, sf)


@query(_sql([HIST, BASE], "SELECT * FROM base"))
def a2_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return H.baseline(history(spark, sf), S.AS_OF)


@query(_sql([HIST, LATEST], "SELECT * FROM latest"))
def a3_latest_price(spark: SparkSession, sf: str) -> DataFrame:
    return H.latest_price(history(spark, sf))


@query(_sql([HIST, BASE, LATEST, DELTA], "SELECT * FROM delta"))
def a4_deal_delta(spark: SparkSession, sf: str) -> DataFrame:
    return H.deal_delta(history(spark, sf), S.AS_OF)


@query(_sql([HIST, VEL], "SELECT * FROM vel"))
def a5_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return H.velocity(history(spark, sf), S.AS_OF)


@query(_sql([HIST, BASE, LATEST, DELTA, VEL, SCORE], "SELECT * FROM score"))
def a6_score_deals(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    return H.score_deals(H.deal_delta(h, S.AS_OF), h, S.AS_OF)


@query(_sql([HIST, BASE, LATEST, DELTA, VEL, SCORE], "SELECT match_key, store_id, composite_score FROM score ORDER BY composite_score DESC, match_key, store_id LIMIT 10"))
def w9_top_deals(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    return H.top_deals(H.score_deals(H.deal_delta(h, S.AS_OF), h, S.AS_OF)).select("match_key", "store_id", "composite_score")


BEST = _sql(
    [HIST],
    f"""SELECT *, CASE WHEN best_current_price <= all_time_low THEN 'all_time_low' WHEN pct_below_median >= 25 THEN 'great' ELSE 'good' END AS price_status FROM (
  SELECT *, floor((median_price - best_current_price) / median_price * 100 * 100 + 0.5) / 100 AS pct_below_median FROM (
    SELECT match_key, min(price) FILTER (day >= {_NOW} - 30) AS best_current_price, min(price) AS all_time_low, max(price) AS all_time_high, median(price) AS median_price,
      count(DISTINCT day) AS days_tracked, count(DISTINCT store_id) AS retailer_count, max(day) AS last_seen FROM hist WHERE length(match_key) <= 80 GROUP BY 1))
  WHERE retailer_count >= 2 AND days_tracked >= 3 AND pct_below_median >= 10""",
)


@query(BEST)
def a12_best_deals(spark: SparkSession, sf: str) -> DataFrame:
    return H.best_deals(history(spark, sf), S.AS_OF)


def _products(spark: SparkSession, sf: str) -> DataFrame:
    """Every product name once: a request for each."""
    return S.table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))


@query(
    _sql(
        [HIST],
        """SELECT *, min(low) OVER (PARTITION BY request_id) AS all_time_low, max(high) OVER (PARTITION BY request_id) AS all_time_high FROM (
  SELECT p_partkey AS request_id, match_key, day, min(price) AS low, max(price) AS high, arg_min(store_id, (price, store_id)) AS low_store
  FROM hist JOIN (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1) ON match_key = p_name WHERE day BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' GROUP BY 1, 2, 3)""",
    )
)
def a15_price_chart(spark: SparkSession, sf: str) -> DataFrame:
    r = _products(spark, sf).select(F.col("p_partkey").alias("request_id"), F.col("p_name").alias("match_key"), F.lit("2000-01-01").cast("date").alias("start"), F.lit("2001-12-31").cast("date").alias("end"))
    return H.price_chart(r, history(spark, sf))


@query(
    _sql(
        [HIST],
        """, r AS (SELECT match_key, store_id, day, category, (category IS DISTINCT FROM lag(category) OVER w OR row_number() OVER w = 1)::INT AS new FROM hist WINDOW w AS (PARTITION BY match_key, store_id ORDER BY day)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY match_key, store_id ORDER BY day) AS run FROM r)
  SELECT match_key, store_id, min(day) AS first, max(day) AS last, count(*) AS n, any_value(category) AS category FROM s GROUP BY match_key, store_id, run""",
    ).replace(" ,", ",", 1)
)
def w13_runs(spark: SparkSession, sf: str) -> DataFrame:
    return H.change_runs(history(spark, sf), ["match_key", "store_id"], "day", "category")


@query(
    _sql(
        [HIST],
        """, k AS (SELECT p_partkey AS request_id, unnest([0, 1]) AS rank, unnest([p_name || '|v3', p_name]) AS match_key FROM (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1))
  SELECT request_id, rank, match_key, store_id, day, price FROM k JOIN hist USING (match_key)""",
    ).replace(" ,", ",", 1)
)
def j21_history_for(spark: SparkSession, sf: str) -> DataFrame:
    k = _products(spark, sf).select(F.col("p_partkey").alias("request_id"), F.posexplode(F.array(F.concat("p_name", F.lit("|v3")), F.col("p_name"))).alias("rank", "match_key"))
    return H.history_for(k, history(spark, sf)).select("request_id", "rank", "match_key", "store_id", "day", "price")


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS o, p_partkey - 1 AS n FROM part WHERE p_partkey % 25 > 0),
 f AS (SELECT p_partkey AS k, p_partkey AS pos, 0 AS d FROM part UNION ALL SELECT k, n, d + 1 FROM f JOIN e ON pos = o),
 t AS (SELECT k, arg_max(pos, d) AS pos FROM f GROUP BY k), b AS (SELECT k, pos, 0 AS d FROM t UNION ALL SELECT k, o, d + 1 FROM b JOIN e ON pos = n)
 SELECT 'k' || k AS match_key, 'k' || pos AS related_key, min(d)::INT AS rank FROM b GROUP BY ALL"""
)
def j20_history_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Products follow each other in chains of 25."""
    p, key = S.table(spark, sf, "part"), lambda c: F.concat(F.lit("k"), c)
    e = p.select(key(F.col("p_partkey")).alias("old_match_key"), key(F.col("p_partkey") - 1).alias("new_match_key"), (F.col("p_partkey") % 25 > 0).alias("is_unique_successor"))
    return H.history_keys(p.select(key(F.col("p_partkey")).alias("match_key")), e)
