"""Summaries that follow the price history of a stream: baselines, latest prices, scores and best deals without a scan of the history.

Each write of daily minima puts the days it made cheaper, with their prices before, aside in its own commit (prices.py). ``summarize`` merges the
changes that it hasn't merged yet into two tables of versions, of which it touches only the months concerned:

- months: by (match_key, store_id, month) the number of days, the sum of their minima in cents, the days as bits, and the last day's row;
- counts: by (match_key, price, month) how many minima have the price.

The first grows with pairs and months instead of days, the second doesn't know stores. A look-back takes its whole months from the first and reads
minima of the months at its edges alone. A stop at any moment is mended by the next call: changes are merged once, by the version they came with.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import history as H
from ..sources import versions
from ..sources.tables import cents
from . import prices

PAIR = H.PAIR


def _cents(price: str) -> Column:
    return F.round(F.col(price) * 100).cast("long")


def _months(changes: DataFrame) -> DataFrame:
    last = F.struct("day", "price", "brand", "category")
    return changes.groupBy(*PAIR, "part").agg(
        F.count_if(F.col("before").isNull()).alias("n_days"),
        F.sum(_cents("price") - F.coalesce(_cents("before"), F.lit(0))).alias("cents"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.dayofmonth("day") - 1)).alias("days"),
        F.max_by(last, F.struct("day", -F.col("price"))).alias("last"),
    )


def _merge_months(stored: DataFrame, new: DataFrame) -> DataFrame:
    both = stored.select(new.columns).unionByName(new)
    return both.groupBy(*PAIR, "part").agg(
        F.sum("n_days").alias("n_days"), F.sum("cents").alias("cents"), F.bit_or("days").alias("days"), F.max_by("last", F.struct("last.day", -F.col("last.price"))).alias("last")
    )


def _counts(changes: DataFrame) -> DataFrame:
    one = lambda c, n: F.struct(F.col(c).alias("price"), F.lit(n).cast("long").alias("n"))
    steps = changes.select("match_key", "part", F.explode(F.array(one("price", 1), one("before", -1))).alias("s")).where("s.price is not null")
    return steps.groupBy("match_key", F.col("s.price").alias("price"), "part").agg(F.sum("s.n").alias("n"))


def _merge_counts(stored: DataFrame, new: DataFrame) -> DataFrame:
    both = stored.select(new.columns).unionByName(new)
    return both.groupBy("match_key", "price", "part").agg(F.sum("n").alias("n")).where("n <> 0")


TABLES: dict[str, tuple[Callable, Callable]] = {"months": (_months, _merge_months), "counts": (_counts, _merge_counts)}


@dataclass(frozen=True)
class Summaries:
    """The history at path with its summaries. schema: that of daily_price_history()."""

    spark: SparkSession
    path: str
    schema: StructType

    def _changes(self, after: int = 0) -> DataFrame:
        kept = {f.name: f for f in self.schema.fields}
        fields = [kept["match_key"], kept["store_id"], kept["day"]]
        schema = StructType(fields).add("part", "date").add("before", "double").add("price", "double").add(kept["brand"]).add(kept["category"])
        return versions.appended(self.spark, self.path, schema, "changes", after)

    def summarize(self) -> None:
        """Merges the changes of all versions not merged yet."""
        top = versions.commits(self.spark, self.path).agg(F.max("version")).first()[0]
        for name, (fold, merge) in TABLES.items():
            done = versions.commits(self.spark, f"{self.path}/{name}").agg(F.max("batch")).first()[0] or 0
            if top is not None and top > done:
                new = fold(self._changes(done)).persist()
                try:
                    versions.write(f"{self.path}/{name}", "changes", top, new, merge)
                finally:
                    new.unpersist()

    def write(self, stream: str = "prices") -> Callable[[DataFrame, int], None]:
        """A foreachBatch function: minima of a micro-batch, then the summaries."""
        minima = prices.write_minima(self.path, stream, changes=True)

        def run(batch: DataFrame, batch_id: int) -> None:
            minima(batch, batch_id)
            self.summarize()

        return run

    def stream(self, rows: DataFrame, checkpoint: str, stream: str = "prices") -> StreamingQuery:
        """Runs a stream of deal rows into the history and its summaries and ends when it has read all there is."""
        return rows.writeStream.foreachBatch(self.write(stream)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def table(self, name: str) -> DataFrame:
        empty = TABLES[name][0](self.spark.createDataFrame([], self._changes().schema))
        return versions.current(self.spark, f"{self.path}/{name}", StructType([f for f in empty.schema.fields if f.name != "part"]))

    def minima(self, since: Column | None = None) -> DataFrame:
        """The history, of the months from since on (whole months; the caller cuts days)."""
        rows = versions.current(self.spark, self.path, self.schema)
        return rows if since is None else rows.where(F.col("part") >= F.trunc(since, "month"))

    def latest_price(self) -> DataFrame:
        """history.latest_price() of all minima."""
        last = self.table("months").groupBy(*PAIR).agg(F.max_by("last", "last.day").alias("l"))
        return last.select(*PAIR, F.col("l.price").alias("current_price"), "l.brand", "l.category", F.col("l.day").alias("last_day"))

    def baseline(self, as_of: str, days: int = 90) -> DataFrame:
        """history.baseline() of all minima."""
        end = F.to_date(F.lit(as_of))
        start = F.date_sub(end, days)
        whole = (F.col("part") >= start) & (F.last_day("part") <= end)
        months = self.table("months").where(whole).select(*PAIR, "cents", "n_days")
        edges = H.look_back(self.minima(start).where((F.col("part") <= end) & ~whole), as_of, days)
        both = months.unionByName(edges.select(*PAIR, _cents("price").alias("cents"), F.lit(1).cast("long").alias("n_days")))
        n = F.sum("n_days")
        return both.groupBy(*PAIR).agg(cents(F.sum("cents") / n / 100).alias("baseline_price"), n.alias("n_days"))

    def deal_delta(self, as_of: str, days: int = 90) -> DataFrame:
        return H.compared(self.latest_price(), self.baseline(as_of, days))

    def score_deals(self, as_of: str, days: int = 30) -> DataFrame:
        """history.score_deals() of all pairs; only the months of the look-back are read as minima."""
        return H.score_deals(self.deal_delta(as_of), self.minima(F.date_sub(F.to_date(F.lit(as_of)), days)), as_of, days)

    def best_deals(self, as_of: str, **limits) -> DataFrame:
        """history.best_deals() of all minima: medians and extremes from the counts, days and stores from the months."""
        fits = F.length("match_key") <= 80
        c = self.table("counts").where(fits).groupBy("match_key").agg(
            F.min("price").alias("all_time_low"), F.max("price").alias("all_time_high"), F.percentile("price", 0.5, F.col("n")).alias("median_price")
        )
        m = self.table("months").where(fits).groupBy("match_key", "part").agg(F.bit_or("days").alias("days"), F.collect_set("store_id").alias("stores"), F.max("last.day").alias("last"))
        m = m.groupBy("match_key").agg(
            F.sum(F.bit_count("days")).alias("days_tracked"), F.size(F.array_distinct(F.flatten(F.collect_list("stores")))).cast("long").alias("retailer_count"), F.max("last").alias("last_seen")
        )
        since = F.date_sub(F.to_date(F.lit(as_of)), 30)
        recent = self.minima(since).where((F.col("day") >= since) & fits).groupBy("match_key").agg(F.min("price").alias("best_current_price"))
        return H.judged(c.join(m, "match_key").join(recent, "match_key", "left"), **limits)
