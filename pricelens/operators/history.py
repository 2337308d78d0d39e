"""Price history, baselines, deltas, scores and best deals. "Now" is always the argument as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cents, written

PAIR = ["match_key", "store_id"]


def valid_price(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c <= 999_999)


def daily_price_history(rows: DataFrame) -> DataFrame:
    """The cheapest row of each (match_key, store_id, day): rows with price, day, row_id, brand, size and name.

    Attributes are those of the cheapest row, nulls included; equal prices go to the smallest row_id.
    """
    best = F.min_by(F.struct("price", "brand", "category", "base_amount", "base_unit"), F.struct("price", "row_id"))
    out = rows.where(valid_price(F.col("price"))).groupBy(*PAIR, "day").agg(best.alias("b"))
    return out.select(*PAIR, "day", "b.*")


def look_back(hist: DataFrame, as_of: str, days: int) -> DataFrame:
    now = F.to_date(F.lit(as_of))
    return hist.where((F.col("day") >= F.date_sub(now, days)) & (F.col("day") <= now))


def baseline(hist: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Mean of the daily minima of the last days, two places."""
    daily = look_back(hist, as_of, days).groupBy(*PAIR, "day").agg(F.min("price").alias("low"))
    # whole cents, so that the sum doesn't depend on the order of rows
    total = F.sum(F.round(F.col("low") * 100).cast("long"))
    return daily.groupBy(*PAIR).agg(cents(total / F.count("*") / 100).alias("baseline_price"), F.count("*").alias("n_days"))


def latest_price(hist: DataFrame) -> DataFrame:
    return hist.groupBy(*PAIR).agg(F.max_by(F.struct("price", "brand", "category"), F.struct("day", -F.col("price"))).alias("l"), F.max("day").alias("last_day")).select(
        *PAIR, F.col("l.price").alias("current_price"), "l.brand", "l.category", "last_day"
    )


def deal_delta(hist: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Change of the latest price against the baseline: drop, rise, unchanged, or new where there is no baseline."""
    return compared(latest_price(hist), baseline(hist, as_of, days))


def compared(latest: DataFrame, base: DataFrame) -> DataFrame:
    """deal_delta() of latest_price() and baseline(), wherever they come from."""
    d = latest.join(base, PAIR, "left")
    base, now = F.col("baseline_price"), F.col("current_price")
    change = (now - base) / base * 100
    return d.select(
        *PAIR, "brand", "category", "current_price", "baseline_price", "last_day",
        cents(F.when(base > 0, change)).alias("price_change_pct"),
        cents(base - now).alias("absolute_savings"),
        F.when(base.isNull(), "new").when(base == 0, "unchanged").when(change < -2, "drop").when(change > 2, "rise").otherwise("unchanged").alias("delta_type"),
    )


def velocity(hist: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Price changes from one day to the next seen, per days/30."""
    before = F.lag("price").over(Window.partitionBy(*PAIR).orderBy("day"))
    d = look_back(hist, as_of, days).withColumn("changed", (before != F.col("price")).cast("int"))
    return d.groupBy(*PAIR).agg((F.coalesce(F.sum("changed"), F.lit(0)) / F.lit(days / 30)).alias("deal_velocity"))


def composite_score(pct: Column, savings: Column, speed: Column, popularity: Column) -> Column:
    """Weighted sum of clamped parts, 0 to 100."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return cents((unit(pct / 50) * 0.5 + unit(savings / 10) * 0.25 + unit(F.lit(1.0) - speed / 10) * 0.15 + unit(popularity / 100) * 0.1) * 100)


def score_deals(deltas: DataFrame, hist: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Scores of the deltas of type drop and new."""
    d = deltas.where(F.col("delta_type").isin("drop", "new")).join(velocity(hist, as_of, days), PAIR, "left")
    pct = F.greatest(F.coalesce(-F.col("price_change_pct"), F.lit(0.0)), F.lit(0.0))
    saved = F.coalesce("absolute_savings", F.lit(0.0))
    speed = F.coalesce("deal_velocity", F.lit(0.0))
    return d.select(*PAIR, "brand", "category", "current_price", pct.alias("pct_savings"), saved.alias("absolute_savings"), speed.alias("deal_velocity"), composite_score(pct, saved, speed, F.lit(0.0)).alias("composite_score"))


def top_deals(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("composite_score"), *PAIR).limit(k)


def best_deals(hist: DataFrame, as_of: str, retailers: int = 2, days: int = 3, below_pct: float = 10.0, max_price: float = 1e9) -> DataFrame:
    """By match_key: current best price against its own past; those well below their median and lately seen.

    One pass without a row for each distinct count: a key's days and stores are sets that combine before the shuffle and are bounded by the calendar and the catalog.
    """
    now = F.to_date(F.lit(as_of))
    recent = F.when(F.col("day") >= F.date_sub(now, 30), F.col("price"))
    g = hist.where(F.length("match_key") <= 80).groupBy("match_key").agg(
        F.min(recent).alias("best_current_price"),
        F.min("price").alias("all_time_low"),
        F.max("price").alias("all_time_high"),
        F.median("price").alias("median_price"),
        F.size(F.collect_set("day")).cast("long").alias("days_tracked"),
        F.size(F.collect_set("store_id")).cast("long").alias("retailer_count"),
        F.max("day").alias("last_seen"),
    )
    return judged(g, retailers, days, below_pct, max_price)


def judged(g: DataFrame, retailers: int = 2, days: int = 3, below_pct: float = 10.0, max_price: float = 1e9) -> DataFrame:
    """The rows of best_deals() from each key's figures."""
    below = cents((F.col("median_price") - F.col("best_current_price")) / F.col("median_price") * 100)
    g = g.withColumn("pct_below_median", below).withColumn(
        "price_status", F.when(F.col("best_current_price") <= F.col("all_time_low"), "all_time_low").when(below >= 25, "great").otherwise("good")
    )
    return g.where((F.col("retailer_count") >= retailers) & (F.col("days_tracked") >= days) & (below >= below_pct) & (F.col("best_current_price") <= max_price))


def ordered_union(*lists: Column) -> Column:
    """Keys of several lists, each once, in order of first sight."""
    return F.array_distinct(F.flatten(F.array(*lists)))


def price_chart(requests: DataFrame, hist: DataFrame) -> DataFrame:
    """By request (request_id, match_key, start, end) and day: low, high and the store of the low; and the low and high of the whole."""
    d = hist.join(requests, "match_key").where(F.col("day").between(F.col("start"), F.col("end")))
    g = d.groupBy("request_id", "match_key", "day").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.min_by("store_id", F.struct("price", "store_id")).alias("low_store"))
    w = Window.partitionBy("request_id")
    return g.withColumn("all_time_low", F.min("low").over(w)).withColumn("all_time_high", F.max("high").over(w))


def history_for(keys: DataFrame, hist: DataFrame) -> DataFrame:
    """By request_id: the history rows of the first key (rank order) that has any; keys (request_id, rank, match_key)."""
    found = keys.join(hist, "match_key")
    first = F.min("rank").over(Window.partitionBy("request_id"))
    return found.withColumn("_first", first).where("rank = _first").drop("_first")


def _ends(edges: DataFrame) -> DataFrame:
    """(o, end, steps, open) of edges (o, n), at most one an o: where each path ends, by pointer doubling; open: it doesn't, it comes to a cycle.

    After k rounds 2^k steps are made. Rounds end when no path moves on, or when there were as many steps as edges.
    """
    at = written(edges.select("o", F.col("n").alias("end"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open")), "ends")
    left = at.count()
    for _ in range(left.bit_length()):
        on = at.select(F.col("o").alias("end"), F.col("end").alias("_end"), F.col("steps").alias("_steps"))
        moved = at.join(on, "end", "left")
        step = F.col("_end").isNotNull()
        at = written(moved.select("o", F.coalesce("_end", "end").alias("end"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), step.alias("open")), "ends")
        if not at.where("open").limit(1).count():
            break
    return at


def _cycles(edges: DataFrame) -> DataFrame:
    """(x, leader, place, size) of edges (o, n) that are cycles: the least key of each, the steps to it, and the number of keys."""
    low = edges.select("o", F.col("n").alias("to"), F.least("o", "n").alias("low"))
    for _ in range(edges.count().bit_length()):
        on = low.select(F.col("o").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        low = written(low.join(on, "to").select("o", F.col("_to").alias("to"), F.least("low", "_low").alias("low")), "cycles")
    leaders = low.select(F.col("o").alias("x"), F.col("low").alias("leader"))
    cut = edges.join(leaders.where("x = leader").select(F.col("x").alias("o")), "o", "left_anti")
    steps = _ends(cut).select(F.col("o").alias("x"), F.col("steps").alias("place"))
    placed = leaders.join(steps, "x", "left").select("x", "leader", F.coalesce("place", F.lit(0)).cast("long").alias("place"))
    return placed.join(placed.groupBy("leader").agg(F.count("*").alias("size")), "leader")


def history_keys(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """(match_key, related_key, rank): each key's terminal successor, then all that lead to it, nearest first.

    edges (old_match_key, new_match_key, is_unique_successor); only unique successors are followed, and no key that has several such. On a
    cycle a key's terminal is the last before one comes again. Paths may have any length: rounds grow with its logarithm.
    """
    unique = edges.where("is_unique_successor and old_match_key <> new_match_key").select(F.col("old_match_key").alias("o"), F.col("new_match_key").alias("n")).distinct()
    forward = unique.groupBy("o").agg(F.min("n").alias("n"), F.count("*").alias("c")).where("c = 1").select("o", "n")
    asked = keys.select("match_key").distinct()
    ends = _ends(forward)
    tree = ends.where("not open")
    own = tree.select(F.col("end").alias("o")).distinct().select("o", F.col("o").alias("end"), F.lit(0).cast("long").alias("steps"))
    members = tree.select("o", "end", "steps").unionByName(own)
    alone = asked.join(ends.select(F.col("o").alias("match_key")), "match_key", "left_anti").join(own.select(F.col("o").alias("match_key")), "match_key", "left_anti")
    found = alone.select("match_key", F.col("match_key").alias("related_key"), F.lit(0).cast("long").alias("rank"))
    mine = asked.join(members.select(F.col("o").alias("match_key"), "end"), "match_key")
    found = found.unionByName(mine.join(members, "end").select("match_key", F.col("o").alias("related_key"), F.col("steps").alias("rank")))
    looping = ends.where("open")
    if looping.limit(1).count():
        round_ = looping.select(F.col("end").alias("o")).distinct()  # as many steps as edges were made: these keys are on cycles
        ring = _cycles(forward.join(round_, "o"))
        # tails end where they meet a cycle
        tails = _ends(forward.join(looping.select("o"), "o").join(round_, "o", "left_anti")).select("o", F.col("end").alias("x"), "steps")
        there = tails.unionByName(ring.select(F.col("x").alias("o"), "x", F.lit(0).cast("long").alias("steps"))).join(ring, "x")
        goal = asked.join(there.select(F.col("o").alias("match_key"), "leader", F.pmod(F.col("place") + 1, F.col("size")).alias("goal")), "match_key")
        rank = F.col("steps") + F.pmod(F.col("place") - F.col("goal"), F.col("size"))
        found = found.unionByName(goal.join(there, "leader").select("match_key", F.col("o").alias("related_key"), rank.alias("rank")))
    return found.select("match_key", "related_key", F.col("rank").cast("int").alias("rank"))


def change_runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Islands of equal neighbouring values: (keys, first, last, n, value)."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    d = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return d.groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.first(value).alias(value)).drop("_run")
