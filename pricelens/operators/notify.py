"""Notification decisions: scores, quiet hours, gates, caps, digests, statistics and backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import cell, cells_around, haversine
from ..sources.tables import cents, meet, union_all

MIN_SCORE = 55.0
#: Sends a week and user by kind of trigger.
WEEKLY = {"new_deals": 2, "drop": 1}
SEGMENT_SCORE = {"power": 45.0, "regular": 55.0, "casual": 70.0}
CATEGORIES = ["produce", "dairy", "meat", "bakery", "frozen", "snacks", "beverages", "pantry", "household"]


def deal_score(savings_pct: Column, drop_pct: Column, n_retailers: Column) -> Column:
    return cents(F.least(F.lit(100.0), savings_pct * 0.5 + drop_pct * 0.3 + F.least(n_retailers / 10, F.lit(1.0)) * 0.2 * 100))


def relevance(category: Column, prefs: Column, product: Column, history: Column, brand: Column, brands: Column) -> Column:
    """Category match and what was bought before (in either direction of containment), else a preferred brand."""
    cat = F.when(F.array_contains(prefs, category), 100.0).otherwise(0.0)
    p = F.lower(product)
    seen = F.coalesce(F.exists(history, lambda h: F.contains(p, F.lower(h)) | F.contains(F.lower(h), p)), F.lit(False))
    liked = F.coalesce(F.exists(brands, lambda b: F.lower(b) == F.lower(brand)), F.lit(False))
    return cents(F.coalesce(cat, F.lit(0.0)) * 0.6 + F.when(seen, 100.0).when(liked, 80.0).otherwise(0.0) * 0.4)


def blend(deal: Column, relevant: Column) -> Column:
    return cents(deal * 0.7 + relevant * 0.3)


def quiet(as_of: Column, zone: Column, start: Column, end: Column) -> Column:
    """Whether the user's hour lies in [start, end), past midnight where start is larger; unknown zones count as UTC."""
    # a time of day in a zone that doesn't exist can't be read
    good = zone.rlike(r"^([A-Z][A-Za-z_]+/[A-Za-z_/]+|UTC)$") & F.try_to_timestamp(F.concat(F.lit("2024-01-01 12:00:00 "), zone)).isNotNull()
    hour = F.hour(F.from_utc_timestamp(as_of, F.when(good, zone).otherwise(F.lit("UTC"))))
    return F.when(start == end, F.lit(False)).when(start < end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))


def profiles(users: DataFrame) -> DataFrame:
    """Users with defaults for what they haven't set."""
    d = {"radius_miles": 25.0, "segment": "casual", "quiet_start": 22, "quiet_end": 7}
    have = set(users.columns)
    out = users.select("*", *[F.lit(None).cast("string" if isinstance(v, str) else "double" if isinstance(v, float) else "int").alias(k) for k, v in d.items() if k not in have])
    out = out.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in d.items()})
    return out.withColumn("category_prefs", F.coalesce("category_prefs", F.array(*map(F.lit, CATEGORIES))))


def _near_zips(users: DataFrame, deal_zips: DataFrame, zips: DataFrame) -> DataFrame:
    """(zip_code, deal_zip, miles): zips of users and of deals that lie within the largest radius of the users' zip.

    A zip without a centre is near itself only.
    """
    z = zips.select("zip_code", "latitude", "longitude")
    uz = users.groupBy("zip_code").agg(F.max("radius_miles").alias("reach")).join(z, "zip_code", "left")
    dz = deal_zips.select("zip_code").distinct().join(z, "zip_code", "left").select(F.col("zip_code").alias("deal_zip"), F.col("latitude").alias("plat"), F.col("longitude").alias("plon"))
    far = haversine(F.col("latitude"), F.col("longitude"), F.col("plat"), F.col("plon"))
    # whole-degree cells, as many around a zip as the largest radius there asks for
    cells = cells_around(F.col("latitude"), F.col("longitude"), F.col("reach"), 1.0)
    spread = uz.where("latitude is not null").select("*", F.explode(cells).alias("c"))
    near = spread.join(dz.where("plat is not null").withColumn("c", cell(F.col("plat"), F.col("plon"), 1.0)), "c")
    near = near.select("zip_code", "deal_zip", far.alias("miles"), "reach").where("miles <= reach").drop("reach")
    same = uz.where("latitude is null").select("zip_code", F.col("zip_code").alias("deal_zip"), F.lit(0.0).alias("miles"))
    return near.union(same)


def candidate_pairs(deals: DataFrame, users: DataFrame, zips: DataFrame) -> DataFrame:
    """Deal and user pairs whose zip centres are within the user's radius.

    Distances are worked out between distinct zips. The result is users times the deals near them: where only each user's best deals are
    wanted, take best_near(). Deals or users whose zip has no centre pass only in the same zip.
    """
    u = users.join(_near_zips(users, deals, zips), "zip_code").where(F.col("miles") <= F.col("radius_miles")).withColumnRenamed("zip_code", "user_zip")
    return u.join(deals.withColumnRenamed("zip_code", "deal_zip"), "deal_zip")


def near_counts(deals: DataFrame, users: DataFrame, zips: DataFrame) -> DataFrame:
    """(user_id, n): how many deals are near each user that has any. Deals are counted by zip before they meet the zips around."""
    by_zip = deals.groupBy(F.col("zip_code").alias("deal_zip")).agg(F.count("*").alias("k"))
    rings = users.select("zip_code", "radius_miles").distinct().join(_near_zips(users, deals, zips), "zip_code").where("miles <= radius_miles")
    n = rings.join(by_zip, "deal_zip").groupBy("zip_code", "radius_miles").agg(F.sum("k").alias("n"))
    return users.join(n, ["zip_code", "radius_miles"]).select("user_id", "n")


_CLASS = ["zip_code", "radius_miles", "likes"]


def with_class(users: DataFrame) -> DataFrame:
    """users with likes, their categories in order: who shares zip, radius and likes has the same best deals."""
    return users.withColumn("likes", F.array_sort(F.array_distinct("category_prefs")))


def best_near(deals: DataFrame, users: DataFrame, zips: DataFrame, k: int, order: list[str], least: float = 0.0) -> DataFrame:
    """By class of users (zip_code, radius_miles, likes) the best k deals near it, the best one of each retailer: (..., retailer, name, score, about, rank).

    deals (zip_code, retailer, category, name, liked, other, about): the score for users who like the category and for others, and any struct to keep.
    Deals are cut to the best of each zip, retailer and category before they meet the zips around, to the best of each retailer there, and to k of a class, so that what is
    joined follows zips, retailers and classes, not users and deals. Equal scores go by name within a retailer, by the columns order between retailers.
    """
    best = lambda way: F.min_by(F.struct("name", F.col(way).alias("score"), "about"), F.struct(-F.col(way), F.col("name"), F.col("about"))).alias(way)
    better = lambda way: F.min_by(way, F.struct(-F.col(f"{way}.score"), F.col(f"{way}.name"), F.col(f"{way}.about"))).alias(way)
    zone = deals.groupBy(F.col("zip_code").alias("deal_zip"), "retailer", "category").agg(best("liked"), best("other"))
    rings = users.select("zip_code", "radius_miles").distinct().join(_near_zips(users, deals, zips), "zip_code").where("miles <= radius_miles")
    around = rings.join(zone, "deal_zip").groupBy("zip_code", "radius_miles", "retailer", "category").agg(better("liked"), better("other"))
    each = users.select(*_CLASS).distinct().join(around, ["zip_code", "radius_miles"])
    each = each.withColumn("b", F.when(F.array_contains("likes", F.col("category")), F.col("liked")).otherwise(F.col("other"))).where(F.col("b.score") >= least)
    shops = each.groupBy(*_CLASS, "retailer").agg(better("b")).select(*_CLASS, "retailer", "b.*")
    n = F.row_number().over(Window.partitionBy(*_CLASS).orderBy(F.desc("score"), *order))
    return shops.withColumn("rank", n).where(F.col("rank") <= k)


def _with_kind(df: DataFrame) -> DataFrame:
    return df if "trigger_type" in df.columns else df.withColumn("trigger_type", F.lit(None).cast("string"))


def decide(pairs: DataFrame, sent: DataFrame, as_of: str) -> DataFrame:
    """Rows (user_id, product, retailer, trigger_type, segment, score, is_quiet) with blocked_reason, the first gate that stops them, or none.

    Gates: quiet hours; the same (user, product, retailer) in seven days; the daily cap; the retailer's weekly cap; the weekly caps of the
    kinds of triggers (WEEKLY); the score; the segment's score.
    """
    now, pairs = F.to_timestamp(F.lit(as_of)), _with_kind(pairs)
    week = _with_kind(sent).where((F.col("sent_at") > now - F.expr("INTERVAL 7 DAYS")) & (F.col("sent_at") <= now))
    seen = week.select("user_id", "product", "retailer").distinct().withColumn("_seen", F.lit(True))
    shop = week.groupBy("user_id", "retailer").agg(F.count("*").alias("_shop"))
    day = week.where(F.col("sent_at") > now - F.expr("INTERVAL 1 DAY")).groupBy("user_id").agg(F.count("*").alias("_day"))
    kinds = [week.where(F.col("trigger_type") == k).groupBy("user_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= most).select("user_id", F.lit(k).alias("trigger_type")) for k, most in WEEKLY.items()]
    full = union_all(kinds).withColumn("_full", F.lit(True))
    pairs = pairs.join(full, ["user_id", "trigger_type"], "left")
    d = pairs.join(seen, ["user_id", "product", "retailer"], "left").join(shop, ["user_id", "retailer"], "left").join(day, "user_id", "left")
    need = F.create_map(*[F.lit(x) for kv in SEGMENT_SCORE.items() for x in kv])
    why = (
        F.when(F.col("is_quiet"), "quiet_hours").when(F.col("_seen"), "duplicate").when(F.col("_day") >= 3, "daily_cap").when(F.col("_shop") >= 1, "retailer_cap")
        .when(F.col("_full"), F.concat("trigger_type", F.lit("_cap"))).when(F.col("score") < MIN_SCORE, "low_score").when(F.col("score") < F.try_element_at(need, F.col("segment")), "segment_score").otherwise("none")
    )
    return d.withColumn("blocked_reason", why).drop("_seen", "_shop", "_day", "_full")


def capped(decisions: DataFrame, per_day: int = 3) -> DataFrame:
    """Of what passes all gates: one for each user and retailer, the weekly caps by kind, then the best few of each user."""
    d = _with_kind(decisions.where("blocked_reason = 'none'"))
    n = F.row_number().over(Window.partitionBy("user_id", "retailer").orderBy(F.desc("score"), "product", "trigger_type"))
    d = d.withColumn("_n", n).where("_n = 1")
    most = F.create_map(*[F.lit(x) for kv in WEEKLY.items() for x in kv])
    n = F.row_number().over(Window.partitionBy("user_id", "trigger_type").orderBy(F.desc("score"), "retailer", "product"))
    d = d.withColumn("_n", n).where(F.col("_n") <= F.coalesce(F.try_element_at(most, F.col("trigger_type")), F.lit(per_day)))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "retailer", "product"))
    return d.withColumn("rank", n).where(F.col("rank") <= per_day).drop("_n")


def _drop_score(drop_pct: Column, liking: Column) -> Column:
    return blend(deal_score(drop_pct, drop_pct, F.lit(1)), liking)


def _still(users: DataFrame, as_of: str) -> Column:
    zone = F.col("time_zone") if "time_zone" in users.columns else F.lit("UTC")
    return quiet(F.to_timestamp(F.lit(as_of)), zone, F.col("quiet_start"), F.col("quiet_end"))


def trigger_run(drops: DataFrame, users: DataFrame, zips: DataFrame, sent: DataFrame, as_of: str) -> DataFrame:
    """Decisions of all pairs of price drops (product, retailer, category, drop_pct, zip_code) and users near them; n_users stays.

    Scores are worked out once for each class of users (with_class), so that a pair of a user is neither scored nor grouped, and users meet their class's drops over all cores.
    For the sends alone, send_list() needs no such product; for counts of decisions, run it over representatives().
    """
    keep = [c for c in users.columns if c == "n_users"]
    u = with_class(profiles(users)).withColumn("is_quiet", _still(users, as_of))
    # a user that comes with several zips or likings has the best score of all of them
    who = u.groupBy("user_id", "segment", *keep, "is_quiet").agg(F.sort_array(F.collect_set(F.struct(*_CLASS))).alias("classes"))
    who = who.withColumn("homes", F.to_json("classes"))
    largest = drops.groupBy("zip_code", "product", "retailer", "category").agg(F.max("drop_pct").alias("drop_pct"))
    near = candidate_pairs(largest, u.select(*_CLASS).distinct(), zips).withColumnRenamed("user_zip", "zip_code")
    none = F.array().cast("array<string>")
    liking = relevance(F.col("category"), F.col("likes"), F.col("product"), none, F.lit(None).cast("string"), none)
    near = near.groupBy(*_CLASS, "product", "retailer").agg(F.max(_drop_score(F.col("drop_pct"), liking)).alias("score"))
    alike = who.select("homes", "classes").distinct().select("homes", F.explode("classes").alias("h")).select("homes", "h.*").join(near, _CLASS)
    alike = alike.groupBy("homes", "product", "retailer").agg(F.max("score").alias("score"))
    best = meet(who, alike, ["homes"], ["user_id"]).select("user_id", "product", "retailer", "segment", *keep, F.lit("drop").alias("trigger_type"), "is_quiet", "score")
    return decide(best, sent, as_of)


def representatives(users: DataFrame, sent: DataFrame, as_of: str) -> DataFrame:
    """users with n_users, so that counts over them are counts over all: one user stands for all who have the same profile and had nothing sent in the week.

    Such users' decisions are alike. Users with sends in the week stand for themselves.
    """
    now = F.to_timestamp(F.lit(as_of))
    busy = sent.where((F.col("sent_at") > now - F.expr("INTERVAL 7 DAYS")) & (F.col("sent_at") <= now)).select("user_id").distinct()
    facts = [c for c in users.columns if c != "user_id"]
    calm = users.join(busy, "user_id", "left_anti").groupBy(*facts).agg(F.min("user_id").alias("user_id"), F.count("*").alias("n_users"))
    return calm.unionByName(users.join(busy, "user_id", "left_semi").withColumn("n_users", F.lit(1).cast("long")))


def block_summary(decisions: DataFrame) -> DataFrame:
    """By blocked_reason: decisions, users and the highest score, of decisions over representatives()."""
    each = decisions.groupBy("blocked_reason", "user_id", "n_users").agg(F.count("*").alias("k"), F.max("score").alias("high"))
    return each.groupBy("blocked_reason").agg(F.sum(F.col("k") * F.col("n_users")).alias("n"), F.sum("n_users").alias("users"), F.max("high").alias("high"))


def send_list(drops: DataFrame, users: DataFrame, zips: DataFrame, sent: DataFrame, devices: DataFrame | None, as_of: str, per_day: int = 3) -> DataFrame:
    """What is sent to each user for price drops: capped(trigger_run(...)) without the product of users and drops, with reason and, given devices, subscription.

    What stops a retailer's best deal stops all its deals: a send of the week stops its retailer, other gates the user, or all scores up to a bound. So a user needs the best
    deal of a retailer alone, of as many retailers as may be taken or were sent to any one user in the week.
    devices (user_id, provider_subscription_id, active, drop_alerts_enabled): the first eligible one of a user by subscription; null where there is none.
    """
    u = with_class(profiles(users))
    now = F.to_timestamp(F.lit(as_of))
    week = sent.where((F.col("sent_at") > now - F.expr("INTERVAL 7 DAYS")) & (F.col("sent_at") <= now))
    stopped = week.groupBy("user_id").agg(F.count_distinct("retailer").alias("n")).agg(F.max("n")).first()[0] or 0
    about = F.struct("drop_pct")
    deals = drops.select("zip_code", "retailer", "category", F.col("product").alias("name"), _drop_score(F.col("drop_pct"), F.lit(60.0)).alias("liked"), _drop_score(F.col("drop_pct"), F.lit(0.0)).alias("other"), about.alias("about"))
    top = best_near(deals, u, zips, per_day + stopped, ["retailer", "name"]).drop("rank")
    rows = u.join(top, _CLASS).select("user_id", F.col("name").alias("product"), "retailer", "segment", F.lit("drop").alias("trigger_type"), "score", _still(users, as_of).alias("is_quiet"), "about.drop_pct")
    out = capped(decide(rows, sent, as_of), per_day).withColumn("reason", drop_reason(F.col("product"), F.col("retailer"), F.col("drop_pct")))
    if devices is not None:
        own = eligible_devices(devices, "drop_alerts_enabled").groupBy("user_id").agg(F.min("provider_subscription_id").alias("subscription_id"))
        out = out.join(own, "user_id", "left")
    return out


def drop_reason(product: Column, retailer: Column, drop_pct: Column) -> Column:
    return F.format_string("%s cut the price of %s by %.2f%%", retailer, product, drop_pct)


def deal_reason(product: Column, retailer: Column, price: Column, savings_pct: Column, n_retailers: Column, drop_pct: Column) -> Column:
    """Why a deal is sent: its drop where it has one (drop_pct), else its savings from 15 % on, else how many offer it."""
    of_all = F.format_string("%d%% below the mean of %d retailers", F.floor(savings_pct), n_retailers)
    sells = F.format_string("%s sells %s for $%.2f", retailer, product, price)
    return (
        F.when(drop_pct > 0, F.concat(drop_reason(product, retailer, drop_pct), F.format_string(", to $%.2f: ", price), of_all))
        .when(savings_pct >= 15, F.concat(sells, F.lit(", "), of_all))
        .otherwise(F.concat(sells, F.format_string(", one of %d retailers near you", n_retailers)))
    )


def in_segments(users: DataFrame, segments: list[str]) -> DataFrame:
    return users.where(F.col("segment").isin(segments))


def of_triggers(rows: DataFrame, kinds: list[str]) -> DataFrame:
    return rows.where(F.col("trigger_type").isin(kinds))


def first_above(rows: DataFrame, threshold: float, cap: int, order: list[Column]) -> DataFrame:
    """By user: the first cap rows at or above the threshold, in processing order."""
    n = F.sum((F.col("score") >= threshold).cast("int")).over(Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_n", n).where((F.col("score") >= threshold) & (F.col("_n") <= cap)).drop("_n")


def message(product: Column, retailer: Column, price: Column, savings_pct: Column) -> Column:
    """(title, body)."""
    title = F.format_string("%s at %s", F.initcap(product), retailer)
    return F.struct(title.alias("title"), F.format_string("Now $%.2f, %.0f%% below the usual price", price, savings_pct).alias("body"))


def digest(products: DataFrame, users: DataFrame, zips: DataFrame, k: int = 3, threshold: float = 30.0) -> DataFrame:
    """By user: up to k products (canonical, category, best_retailer, best_price, best_zip, savings_pct, n_retailers) near them, one per retailer, best score first.

    Savings on produce and meat count less. A score is the deal's blended with the user's liking. Users who share zip, radius and likes share their list, which is worked
    out once (best_near).
    """
    penalty = F.when(F.lower("category").isin("produce", "meat"), 0.7).otherwise(1.0)
    deal = deal_score(F.col("savings_pct") * penalty, F.lit(0.0), F.col("n_retailers"))
    about = F.struct("best_price", "savings_pct", (F.col("avg_price") - F.col("best_price") if "avg_price" in products.columns else F.lit(None).cast("double")).alias("saved"))
    deals = products.select(F.col("best_zip").alias("zip_code"), F.col("best_retailer").alias("retailer"), "category", F.col("canonical").alias("name"), blend(deal, F.lit(60.0)).alias("liked"), blend(deal, F.lit(0.0)).alias("other"), about.alias("about"))
    u = with_class(profiles(users))
    top = u.join(best_near(deals, u, zips, k, ["name", "retailer"], threshold), _CLASS)
    text = message(F.col("name"), F.col("retailer"), F.col("about.best_price"), F.floor("about.savings_pct").cast("double"))
    return top.select("user_id", "rank", F.col("name").alias("canonical"), F.col("retailer").alias("best_retailer"), "score", text["title"].alias("title"), text["body"].alias("body"), "about.best_price", "about.savings_pct", "about.saved")


def digest_payloads(digests: DataFrame, devices: DataFrame) -> DataFrame:
    """(user_id, subscription_id, n_deals, body) of the users of a digest() who have an eligible device: one text of all their products.

    devices (user_id, provider_subscription_id, active, weekly_summary_enabled); a user's first subscription is taken.
    """
    own = eligible_devices(devices, "weekly_summary_enabled").groupBy("user_id").agg(F.min("provider_subscription_id").alias("subscription_id"))
    item = F.format_string("%s for $%.2f at %s", F.initcap("canonical"), F.col("best_price"), F.col("best_retailer"))
    cents_saved = F.sum(F.round(F.coalesce("saved", F.lit(0.0)) * 100).cast("long"))
    g = digests.join(own, "user_id").groupBy("user_id", "subscription_id").agg(
        F.count("*").alias("n_deals"), F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))).alias("items"), cents_saved.alias("saved"), F.max("savings_pct").alias("pct")
    )
    items = F.array_join(F.transform("items", lambda x: x["item"]), ", ")
    one = F.format_string("Your best deal this week: %s, %d%% below the mean", items, F.floor("pct"))
    more = F.format_string("These deals save you up to $%d: %s", F.floor(F.col("saved") / 100), items)
    return g.select("user_id", "subscription_id", "n_deals", F.when(F.col("n_deals") == 1, one).otherwise(more).alias("body"))


def eligible_devices(devices: DataFrame, flag: str) -> DataFrame:
    return devices.where(F.coalesce("active", F.lit(False)) & F.coalesce(F.col(flag), F.lit(False)) & F.col("provider_subscription_id").isNotNull() & (F.col("provider_subscription_id") != ""))


def statistics(log: DataFrame) -> DataFrame:
    """Totals by day, product, retailer, trigger, user and overall, in one pass: (level, value, n, users, low, high, mean, median).

    Rows are counted by value and score first, which bounds what a level's median and distinct users need.
    """
    d = log.select(F.to_date("sent_at").cast("string").alias("day"), "product", "retailer", "trigger_type", "user_id", "score")
    dims = F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).cast("string").alias("value")) for n in ("day", "product", "retailer", "trigger_type", "user_id")], F.struct(F.lit("all").alias("level"), F.lit("").alias("value")))
    x = d.select("user_id", "score", F.explode(dims).alias("d")).select("d.level", "d.value", "user_id", "score")
    by_score = x.groupBy("level", "value", "score").agg(F.count("*").alias("k"))
    mean = cents(F.sum(F.round(F.col("score") * 100).cast("long") * F.col("k")) / F.sum("k") / 100)
    g = by_score.groupBy("level", "value").agg(F.sum("k").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), mean.alias("mean"), F.expr("percentile(score, 0.5, k)").alias("median"))
    users = x.select("level", "value", "user_id").distinct().groupBy("level", "value").agg(F.count("user_id").alias("users"))
    return g.join(users, ["level", "value"]).select("level", "value", "n", "users", "low", "high", "mean", "median")


def score_buckets(log: DataFrame, width: int = 10) -> DataFrame:
    return log.groupBy((F.floor(F.col("score") / width) * width).alias("bucket")).agg(F.count("*").alias("n"))


def _backtest_rows(products: DataFrame, users: DataFrame, drops: list[float], cap: int, threshold: float) -> DataFrame:
    """(drop_pct, n_alike, canonical, score) of what users with the same likings would get; n_alike is how many they are."""
    alike = profiles(users).groupBy(F.array_sort(F.array_distinct("category_prefs")).alias("prefs")).agg(F.count("*").alias("n_alike"))
    none, no = F.array().cast("array<string>"), F.lit(None).cast("string")
    each = products.select("canonical", "category", "savings_pct", "n_retailers", F.explode(F.array(*map(F.lit, drops))).alias("drop_pct"))
    scored = lambda liking: blend(deal_score(F.col("savings_pct"), F.col("drop_pct"), F.col("n_retailers")), F.lit(liking))
    # of the products of a category the best cap, for those who like it and for others: no more of them can be taken
    ways = each.select("canonical", "category", "drop_pct", F.explode(F.array(F.struct(F.lit(True).alias("liked"), scored(60.0).alias("score")), F.struct(F.lit(False).alias("liked"), scored(0.0).alias("score")))).alias("w"))
    ways = ways.select("canonical", "category", "drop_pct", "w.liked", "w.score").where(F.col("score") >= threshold)
    of_kind = F.row_number().over(Window.partitionBy("drop_pct", "category", "liked").orderBy(F.desc("score"), "canonical"))
    ways = ways.withColumn("_k", of_kind).where(F.col("_k") <= cap).drop("_k")
    likes = alike.select("prefs", "n_alike", F.explode("prefs").alias("category"))
    d_liked = likes.join(ways.where("liked"), "category").select("prefs", "n_alike", "drop_pct", "canonical", "score")
    # others: the best of all categories, of which as many more are needed as a user likes categories
    most = alike.agg(F.max(F.size("prefs"))).first()[0] or 0
    rest = ways.where("not liked").groupBy("drop_pct", "category").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "canonical"))).alias("items"))
    first = F.row_number().over(Window.partitionBy("drop_pct").orderBy(F.col("items")[0]["low"], F.col("items")[0]["canonical"]))
    rest = rest.withColumn("_k", first).where(F.col("_k") <= cap + most).drop("_k")
    d_rest = alike.join(F.broadcast(rest), ~F.coalesce(F.array_contains("prefs", F.col("category")), F.lit(False)))  # len(drops) * (cap + most) rows at most
    d_rest = d_rest.select("prefs", "n_alike", "drop_pct", F.explode("items").alias("i")).select("prefs", "n_alike", "drop_pct", "i.canonical", (-F.col("i.low")).alias("score"))
    d = d_liked.unionByName(d_rest)
    n = F.row_number().over(Window.partitionBy("drop_pct", "prefs").orderBy(F.desc("score"), "canonical"))
    return d.withColumn("_n", n).where(F.col("_n") <= cap)


def backtest(products: DataFrame, users: DataFrame, drops: list[float], cap: int = 3, threshold: float = MIN_SCORE) -> DataFrame:
    """By assumed price drop: notifications and users they would reach, with a daily cap, and the median score.

    Users with the same likings get the same, so products meet distinct likings, not users.
    """
    d = _backtest_rows(products, users, drops, cap, threshold)
    sent = d.groupBy("drop_pct").agg(F.sum("n_alike").alias("n_sent"), F.expr("percentile(score, 0.5, n_alike)").alias("median_score"))
    return sent.join(d.where("_n = 1").groupBy("drop_pct").agg(F.sum("n_alike").alias("n_users")), "drop_pct")


def backtest_buckets(products: DataFrame, users: DataFrame, drops: list[float], cap: int = 3, threshold: float = MIN_SCORE, width: int = 10) -> DataFrame:
    """By assumed price drop and bucket of scores: notifications, and the products that are sent most, the five first by number, then the last by name."""
    d = _backtest_rows(products, users, drops, cap, threshold).groupBy("drop_pct", (F.floor(F.col("score") / width) * width).alias("bucket"), "canonical").agg(F.sum("n_alike").alias("n"))
    first = F.row_number().over(Window.partitionBy("drop_pct", "bucket").orderBy(F.desc("n"), F.desc("canonical")))
    top = d.withColumn("k", first).where("k <= 5").groupBy("drop_pct", "bucket").agg(F.sort_array(F.collect_list(F.struct("k", "canonical"))).alias("top"))
    total = d.groupBy("drop_pct", "bucket").agg(F.sum("n").alias("n_sent"))
    return total.join(top, ["drop_pct", "bucket"]).select("drop_pct", "bucket", "n_sent", F.array_join(F.transform("top", lambda x: x["canonical"]), "; ").alias("top_products"))
