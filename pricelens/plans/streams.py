"""Queries that run a stream over a table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators.history import daily_price_history
from ..sources import tables as S
from ..streaming import prices as P
from ..streaming.summaries import Summaries
from . import history as HP
from . import places as PP
from .registry import query


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = S.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name[:-1]}?.parquet*")  # a pattern: the file source wants folders or patterns


def _rows(lines: DataFrame) -> DataFrame:
    price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5) / 100
    none = F.lit(None).cast("string")
    return lines.select(
        F.concat(F.lit("part_"), F.col("l_partkey")).alias("match_key"), F.col("l_suppkey").alias("store_id"), F.to_date("l_shipdate").alias("day"), price.alias("price"),
        F.col("l_orderkey").alias("row_id"), F.col("l_returnflag").alias("brand"), none.alias("category"), F.lit(None).cast("double").alias("base_amount"), none.alias("base_unit"),
    )


_MINIMA = "SELECT 'part_' || l_partkey AS match_key, l_suppkey AS store_id, l_shipdate::DATE AS day, min(floor(l_extendedprice * 100 / l_quantity + 0.5) / 100) AS price FROM lineitem"


@query(f"{_MINIMA} GROUP BY 1, 2, 3")
def t1_t2_price_stream(spark: SparkSession, sf: str) -> DataFrame:
    path = S.scratch_path(spark, "prices")
    P.price_stream(_rows(_stream(spark, sf, "lineitem")), f"{path}/table", f"{path}/offsets").awaitTermination()
    schema = daily_price_history(_rows(S.table(spark, sf, "lineitem"))).schema
    return P.stored_minima(spark, f"{path}/table", schema).select("match_key", "store_id", "day", "price")


def _summaries(spark: SparkSession, sf: str) -> Summaries:
    """The deals as two streams, one after the other, into one history with its summaries."""
    path = S.scratch_path(spark, "summaries")
    kept = Summaries(spark, f"{path}/table", HP.history(spark, sf).schema)
    for k in range(2):
        half = _stream(spark, sf, "lineitem").where(F.col("l_orderkey") % 2 == k)
        kept.stream(HP.history_rows(spark, sf, half), f"{path}/offsets{k}", f"deals {k}").awaitTermination()
    return kept


_SCORES = ["match_key", "store_id", "current_price", "pct_savings", "absolute_savings", "deal_velocity", "composite_score"]


@query(HP._sql([HP.HIST, HP.BASE, HP.LATEST, HP.DELTA, HP.VEL, HP.SCORE], f"SELECT {', '.join(_SCORES)} FROM score"))
def a2_a6_kept_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores from the summaries that two streams kept."""
    return _summaries(spark, sf).score_deals(S.AS_OF).select(*_SCORES)


@query(HP.BEST)
def a12_kept_best_deals(spark: SparkSession, sf: str) -> DataFrame:
    """Best deals from the summaries that two streams kept."""
    return _summaries(spark, sf).best_deals(S.AS_OF)


_DAYS = "e AS (SELECT date_trunc('day', ts) AS day_start, event_type AS match_key, value FROM events)"


@query(f"WITH {_DAYS} SELECT day_start, match_key, min(value) AS low, count(*) AS n FROM e WHERE day_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2")
def t3_daily_windows(spark: SparkSession, sf: str) -> DataFrame:
    path = S.scratch_path(spark, "windows")
    w = P.daily_windows(_prices(spark, sf), "ts").writeStream.outputMode("append").option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True)
    w.format("parquet").option("path", f"{path}/table").start().awaitTermination()
    return spark.read.schema("day_start timestamp, match_key string, low double, n long").parquet(f"{path}/table")


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    return _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("match_key"), F.col("value").alias("price"))


@query(f"WITH {_DAYS} SELECT day_start, match_key, min(value) AS low, count(*) AS n FROM e GROUP BY 1, 2")
def t3_t6_caught_up(spark: SparkSession, sf: str) -> DataFrame:
    """The events as two streams, the later half of the hours first, so that all of the others come late; stream and late rows give the batch's windows."""
    path = S.scratch_path(spark, "late")
    rows = _prices(spark, sf)
    for k, late in enumerate((False, True)):
        half = rows.where((F.hour("ts") < 12) == F.lit(late))
        P.window_stream(half, "ts", f"{path}/table", f"{path}/offsets{k}", stream="events" if k == 0 else "events again").awaitTermination()
    return P.caught_up(spark, f"{path}/table").select("day_start", "match_key", "low", "n")


@query(f"{_MINIMA} WHERE l_shipdate::DATE BETWEEN DATE '2000-01-01' AND DATE '2000-06-30' GROUP BY 1, 2, 3")
def t6_catch_up(spark: SparkSession, sf: str) -> DataFrame:
    return P.catch_up(_rows(S.table(spark, sf, "lineitem")), "2000-01-01", "2000-06-30").select("match_key", "store_id", "day", "price")


@query("SELECT event_id, date_trunc('day', ts - INTERVAL 8 HOUR) - INTERVAL 1 DAY * ((isodow(date_trunc('day', ts - INTERVAL 8 HOUR)) - 3 + 7) % 7) + INTERVAL 8 HOUR AS week_start FROM events")
def t4_week_start(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "events").select("event_id", P.flyer_week_start(F.col("ts")).alias("week_start"))


_LINES = """SELECT l_orderkey * 8 + l_linenumber AS line_id, 'retailer_' || s_nationkey AS retailer_key, (l_suppkey * 3 % 200 + 90000)::VARCHAR AS zip_code, l_shipdate::DATE AS day, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""
_OWN = "(SELECT retailer_key, zip_code, min(store_id) AS matched_store FROM stores GROUP BY 1, 2)"


def _lines(lines: DataFrame, supplier: DataFrame) -> DataFrame:
    d = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    zip_code = (F.col("l_suppkey") * 3 % 200 + 90000).cast("string")
    return d.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"), F.concat(F.lit("retailer_"), "s_nationkey").alias("retailer_key"), zip_code.alias("zip_code"), F.to_date("l_shipdate").alias("day"), "l_partkey")


@query(f"WITH {S.CTE['stores']} SELECT line_id, matched_store FROM ({_LINES}) LEFT JOIN {_OWN} USING (retailer_key, zip_code)")
def t4_enrich_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of deals, each micro-batch matched to stores and appended by its number, so that a repeated batch changes nothing."""
    path = S.scratch_path(spark, "enriched")
    stores, supplier = S.stores(spark, sf), S.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    match = lambda b: M.match_exact(_lines(b, supplier), stores, ["retailer_key", "zip_code"]).select("line_id", "matched_store")
    sink = lambda b, i: b.write.mode("overwrite").parquet(f"{path}/table/batch={i}")
    P.enrich_stream(_stream(spark, sf, "lineitem"), match, sink, f"{path}/offsets").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("line_id", "matched_store")


_WEEK_START = "TIMESTAMP '2001-10-31 08:00:00'"  # Wednesday 00:00 in Los Angeles before S.AS_OF
_OPEN = f"""open AS (SELECT deal_id, retailer || '/' || zip_code AS pair FROM deals
  WHERE deal_id % 3 > 0 AND date_added::TIMESTAMP + INTERVAL 1 HOUR * (deal_id % 24) >= {_WEEK_START})"""
_DECIDED = f"WITH {', '.join(S.CTE[n] for n in ('deals', 'stores', 'zips'))}, {PP._PAIRS}, {PP._J6}, {_OPEN}, decided AS (SELECT deal_id AS id, store_id, match_confidence FROM open LEFT JOIN j6 ON j6.id = pair)"


def _cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions over the stream of deals, of which a third have a store already."""
    path, k = S.scratch_path(spark, "cycle"), F.col("deal_id")
    created = F.col("date_added").cast("timestamp") + F.make_dt_interval(hours=(k % 24).cast("int"))
    none = F.lit(None).cast("double")
    rows = S.deals(spark, sf, _stream(spark, sf, "lineitem")).select(
        k.alias("id"), F.col("retailer").alias("retailer_key"), "zip_code", none.alias("store_lat"), none.alias("store_lng"), F.when(k % 3 == 0, F.col("store_id")).alias("store_id"), created.alias("created_at")
    )
    stores = S.stores(spark, sf).withColumnRenamed("store_id", "id")
    P.weekly_cycle(rows, F.lit(S.AS_OF).cast("timestamp"), stores, S.zips(spark), f"{path}/table", f"{path}/offsets").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("id", "store_id", "match_confidence")


@query(f"{_DECIDED} SELECT * FROM decided")
def t4_weekly_cycle(spark: SparkSession, sf: str) -> DataFrame:
    return _cycle(spark, sf)


@query(f"{_DECIDED} SELECT count(*) AS processed, count(store_id) AS matched, count(*) - count(store_id) AS no_match, max(id) AS last_id FROM decided")
def t4_cycle_totals(spark: SparkSession, sf: str) -> DataFrame:
    return P.cycle_totals(_cycle(spark, sf))


@query(
    f"""WITH {S.CTE['stores']}, m AS (SELECT l.*, CASE l_partkey % 3 WHEN 1 THEN own.matched_store + 1 WHEN 2 THEN own.matched_store END AS before, own.matched_store AS own FROM ({_LINES}) l LEFT JOIN {_OWN} own USING (retailer_key, zip_code))
  SELECT line_id, CASE WHEN NOT EXISTS (SELECT 1 FROM stores s WHERE s.store_id = before AND s.retailer_key = m.retailer_key) AND day >= DATE '{S.AS_OF}' - 120 AND day < DATE '{S.AS_OF}' THEN own ELSE before END AS matched_store FROM m"""
)
def t5_repair(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the deals have lost their store, a third have the next store, most often another retailer's; those of the last 120 days are mended."""
    stores, supplier = S.stores(spark, sf), S.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    match = lambda d: M.match_exact(d, stores, ["retailer_key", "zip_code"])
    matched = match(_lines(S.table(spark, sf, "lineitem"), supplier))
    k, store = F.col("l_partkey") % 3, F.col("matched_store")
    matched = matched.withColumn("matched_store", F.when(k == 1, store + 1).when(k == 2, store))
    return P.repair_recent(matched, match, "day", S.AS_OF, 120, stores).select("line_id", "matched_store")


_WEEK = f"list_filter(sent, lambda x: epoch_us(r.sent_at) - x.t < {P.WEEK * P.SECOND})"


@query(
    f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sent_at, product, retailer) AS i FROM (
  SELECT user_id, 'product_' || (event_id % 40) AS product, 'retailer_' || (event_id % 25) AS retailer, ts AS sent_at FROM events)),
  s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, []::STRUCT(p VARCHAR, q VARCHAR, t BIGINT)[] AS sent, NULL::VARCHAR AS product, NULL::VARCHAR AS retailer, NULL::TIMESTAMP AS sent_at, false AS ok FROM r
    UNION ALL SELECT user_id, i, CASE WHEN ok THEN list_append(held, {{'p': product, 'q': retailer, 't': epoch_us(sent_at)}}) ELSE held END, product, retailer, sent_at, ok FROM (
      SELECT *, len(list_filter(held, lambda x: x.p = product AND x.q = retailer)) = 0 AND len(list_filter(held, lambda x: x.t // {86_400 * P.SECOND} = epoch_us(sent_at) // {86_400 * P.SECOND})) < {P.PER_DAY} AS ok FROM (
        SELECT r.user_id, r.i, r.product, r.retailer, r.sent_at, {_WEEK} AS held FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)))
  SELECT user_id, product, retailer, sent_at FROM s WHERE ok"""
)
def t7_capped_sends(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a stream of sends under the caps; each depends on those before it."""
    path = S.scratch_path(spark, "sends")
    k = F.col("event_id")
    rows = _stream(spark, sf, "events").select("user_id", F.concat(F.lit("product_"), k % 40).alias("product"), F.concat(F.lit("retailer_"), k % 25).alias("retailer"), F.col("ts").cast("timestamp").alias("sent_at"))
    out = P.capped_sends(rows).writeStream.outputMode("append").option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True)
    out.format("parquet").option("path", f"{path}/table").start().awaitTermination()
    return spark.read.schema("user_id long, product string, retailer string, sent_at timestamp").parquet(f"{path}/table")
