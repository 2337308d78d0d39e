"""Streams of deals: daily minima kept in a table, day windows, enrichment, repair, and caps per user."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.history import daily_price_history
from ..operators.matching import match_store
from ..sources import versions

KEY = ["match_key", "store_id", "day"]


def merge_minima(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """stored and batch as one history: the cheaper row of each (match_key, store_id, day) stays, on equal prices the stored one."""
    cols = [c for c in stored.columns if c not in KEY]
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.select(stored.columns).withColumn("_new", F.lit(1)))
    best = both.groupBy(*KEY).agg(F.min_by(F.struct(*cols), F.struct("price", "_new")).alias("b"))
    return best.select(*[F.col(k) if k in KEY else F.col(f"b.{k}").alias(k) for k in stored.columns])


def _by_month(history: DataFrame) -> DataFrame:
    return history.withColumn("part", F.trunc("day", "month"))


def changed_days(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(match_key, store_id, day, part, before, price, brand, category): the days that new makes cheaper, before null where they are new."""
    old = stored.select(*KEY, F.col("price").alias("before"))
    cheaper = F.col("before").isNull() | (F.col("price") < F.col("before"))
    return new.join(old, KEY, "left").where(cheaper).select(*KEY, "part", "before", "price", "brand", "category")


def write_minima(path: str, stream: str = "prices", changes: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: merges a micro-batch's daily minima into the table of versions at path, by months.

    Only the batch's months are read and written. A batch that stopped at any point, or comes again, loses and repeats nothing (sources/versions.py).
    changes: also puts changed_days() into the side table changes, from which streaming/summaries.py follows.
    """
    aside = (lambda stored, rows: {"changes": changed_days(stored, rows)}) if changes else None

    def run(batch: DataFrame, batch_id: int) -> None:
        new = _by_month(daily_price_history(batch)).persist()
        try:
            versions.write(path, stream, batch_id, new, lambda stored, rows: merge_minima(stored.select(rows.columns), rows), aside=aside)
        finally:
            new.unpersist()

    return run


def stored_minima(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The history that write_minima() keeps at path. schema: that of daily_price_history()."""
    return versions.current(spark, path, schema).drop("part")


def price_stream(rows: DataFrame, path: str, checkpoint: str, stream: str = "prices") -> StreamingQuery:
    """Runs a stream of deal rows into the history at path and ends when it has read all there is."""
    return rows.writeStream.foreachBatch(write_minima(path, stream)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catch_up(deals: DataFrame, start: str, end: str) -> DataFrame:
    """The same minima for a range of days, as a batch."""
    return daily_price_history(deals.where(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))))


def daily_windows(rows: DataFrame, time: str, delay: str = "2 days") -> DataFrame:
    """Day windows on event time with a watermark: low and number of rows by product."""
    w = rows.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w"), "match_key")
    return w.agg(F.min("price").alias("low"), F.count("*").alias("n")).select(F.col("w.start").alias("day_start"), "match_key", "low", "n")


WINDOWS = "match_key string, day_start timestamp, low double, n long"


def _merge_windows(stored: DataFrame, new: DataFrame) -> DataFrame:
    both = stored.select(new.columns).unionByName(new)
    return both.groupBy("match_key", "day_start", "part").agg(F.min("low").alias("low"), F.sum("n").alias("n"))


def _windows(rows: DataFrame, time: str) -> DataFrame:
    return rows.groupBy("match_key", F.date_trunc("day", time).alias("day_start")).agg(F.min("price").alias("low"), F.count("*").alias("n"))


def window_stream(rows: DataFrame, time: str, path: str, checkpoint: str, delay: str = "2 days", stream: str = "windows") -> StreamingQuery:
    """Day windows of a stream of rows (match_key, price, time) in a table of versions, and aside (late_rows) the rows that come after their window has closed.

    A window closes when the latest time seen in earlier batches lies delay after its end, as with a watermark; closed_windows() reads such ones.
    Rows without a time are late rows, too.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.select("match_key", "price", F.col(time).cast("timestamp").alias("time")).persist()
        try:
            before = versions.commits(spark, path).where(F.col("stream") == stream).agg(F.max("seen")).first()[0]
            closed = F.date_trunc("day", "time") + F.expr("INTERVAL 1 DAY") <= F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}")
            late = F.col("time").isNull() | (F.coalesce(closed, F.lit(False)) if before else F.lit(False))
            new = _windows(batch.where(~late), "time").withColumn("part", F.to_date("day_start"))
            seen = batch.agg(F.max("time")).first()[0]
            versions.write(path, stream, batch_id, new, _merge_windows, seen, {"late": batch.where(late)})
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _all_windows(spark: SparkSession, path: str) -> DataFrame:
    return versions.current(spark, path, StructType.fromDDL(WINDOWS)).drop("part")


def closed_windows(spark: SparkSession, path: str, delay: str = "2 days") -> DataFrame:
    """(match_key, day_start, low, n) of the windows of window_stream() that no row on time can change."""
    seen = versions.commits(spark, path).agg(F.max("seen")).first()[0]
    return _all_windows(spark, path).where(F.col("day_start") + F.expr("INTERVAL 1 DAY") <= F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {delay}"))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """(match_key, price, time) of the rows that window_stream() put aside."""
    return versions.appended(spark, path, StructType.fromDDL("match_key string, price double, time timestamp"), "late")


def caught_up(spark: SparkSession, path: str) -> DataFrame:
    """All windows of window_stream(), the late rows' shares merged in: what a batch over all rows with a time would give."""
    late = _windows(late_rows(spark, path).where("time is not null"), "time")
    return _merge_windows(_all_windows(spark, path).withColumn("part", F.to_date("day_start")), late.withColumn("part", F.to_date("day_start"))).drop("part")


def flyer_week_start(as_of, zone: str = "America/Los_Angeles"):
    """Wednesday 00:00 of the flyer week in a time zone, as a UTC timestamp column."""
    day = F.to_date(F.from_utc_timestamp(as_of, zone))
    return F.to_utc_timestamp(F.date_sub(day, F.pmod(F.weekday(day) - 2, F.lit(7))).cast("timestamp"), zone)


def enrich_stream(rows: DataFrame, match: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs match (a batch matcher) on each micro-batch and hands the result to sink."""
    return rows.writeStream.foreachBatch(lambda b, i: sink(match(b), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_cycle(rows: DataFrame, as_of: Column, stores: DataFrame, zips: DataFrame, path: str, checkpoint: str, zone: str = "America/Los_Angeles") -> StreamingQuery:
    """Finds stores, by match_store(), for the deals of a stream that have none and were created since the flyer week of as_of began.

    rows (id, retailer_key, zip_code, store_lat, store_lng, store_id, created_at). Each micro-batch's decisions are a folder of its number at path, so that
    a batch that comes again replaces its own. Older deals and those that have a store are left to repair_recent().
    """
    todo = rows.where(F.col("store_id").isNull() & (F.col("created_at") >= flyer_week_start(as_of, zone))).drop("store_id", "created_at")
    sink = lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch={i}")
    return enrich_stream(todo, lambda b: match_store(b, stores, zips), sink, checkpoint)


def cycle_totals(decisions: DataFrame) -> DataFrame:
    """One row: deals processed, matched and without a match, and the last id of a weekly_cycle()."""
    found = F.col("store_id").isNotNull()
    return decisions.agg(F.count("*").alias("processed"), F.count_if(found).alias("matched"), F.count_if(~found).alias("no_match"), F.max("id").alias("last_id"))


def repair_recent(matched: DataFrame, match: Callable[[DataFrame], DataFrame], day: str, as_of: str, days: int = 7, stores: DataFrame | None = None) -> DataFrame:
    """matched with the deals of the days before as_of that have no store (matched_store) given to match again; others are left alone.

    stores (retailer_key, store_id): a deal of those days whose store isn't one of its retailer's is matched again, too, and loses the store if none is found.
    match takes the columns of matched but matched_store, and adds it.
    """
    now = F.to_date(F.lit(as_of))
    cols, lost = matched.columns, F.col("matched_store").isNull()
    if stores is not None:
        own = stores.select("retailer_key", F.col("store_id").alias("matched_store")).distinct().withColumn("_own", F.lit(True))
        matched = matched.join(own, ["retailer_key", "matched_store"], "left")
        lost = F.col("_own").isNull()
    again = F.coalesce(lost & (F.col(day) >= F.date_sub(now, days)) & (F.col(day) < now), F.lit(False))
    fine, todo = matched.where(~again).select(*cols), matched.where(again).select(*[c for c in cols if c != "matched_store"])
    return fine.unionByName(match(todo).select(*cols))


WEEK, PER_DAY, SECOND = 7 * 86_400, 3, 1_000_000  # seconds, sends, microseconds


def _cap(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of one user's sends, the first of a product and retailer in seven days and at most three a day; the state holds what is younger."""
    if state.hasTimedOut:  # nothing sent for longer than any cap looks back
        state.remove()
        return
    sent = json.loads(state.get[0]) if state.exists else []  # (product, retailer, microseconds) of passed sends
    out = []
    for r in pd.concat(list(batches)).sort_values(["sent_at", "product", "retailer"]).itertuples():
        at = r.sent_at.value // 1000  # value: nanoseconds
        sent = [x for x in sent if at - x[2] < WEEK * SECOND]
        again = any(x[0] == r.product and x[1] == r.retailer for x in sent)
        if not again and sum(x[2] // (86_400 * SECOND) == at // (86_400 * SECOND) for x in sent) < PER_DAY:
            sent.append([r.product, r.retailer, at])
            out.append((key[0], r.product, r.retailer, r.sent_at))
    state.update((json.dumps(sent),))
    state.setTimeoutTimestamp(max([state.getCurrentWatermarkMs(), *(x[2] * 1000 // SECOND for x in sent)]) + 1000 * WEEK)
    yield pd.DataFrame(out, columns=["user_id", "product", "retailer", "sent_at"])


def capped_sends(rows: DataFrame) -> DataFrame:
    """A stream of sends (user_id, product, retailer, sent_at) under weekly and daily caps, kept as state of each user for a week after the last."""
    schema = "user_id long, product string, retailer string, sent_at timestamp"
    late = rows.withWatermark("sent_at", "7 days")  # rows that come later than that are dropped
    return late.groupBy("user_id").applyInPandasWithState(_cap, schema, "sent string", "append", GroupStateTimeout.EventTimeTimeout)


def dedup_sends(rows: DataFrame, days: int = 7) -> DataFrame:
    """A stream of sends without repeats of (user_id, product, retailer) within days."""
    return rows.withWatermark("sent_at", f"{days} days").dropDuplicatesWithinWatermark(["user_id", "product", "retailer"])


def read_deal_stream(spark: SparkSession, path: str, schema: str, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
