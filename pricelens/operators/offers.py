"""Offers across retailers: search, size tiers, comparison, best stores for a cart."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import name_similarity, price_per_oz, size_key, word_sort
from ..sources.tables import cents, meet
from .containment import contained

PRODUCE = "apple banana orange lettuce tomato potato onion carrot pepper grape berry melon peach plum corn".split()


def mean_cents(c: Column) -> Column:
    """Mean of prices as whole cents: the same in any row order."""
    return cents(F.sum(F.round(c * 100).cast("long")) / F.count(c) / 100)


def week_start(day: Column) -> Column:
    """The Wednesday on or before a day."""
    return F.date_sub(day, F.pmod(F.weekday(day) - 2, F.lit(7)))


def in_window(day: Column, window: str, as_of: str, start: str | None = None, end: str | None = None) -> Column:
    """all, current_week (Wednesday to Tuesday), last_7, last_30 or custom; rows without a day only pass where no bound is set."""
    now = F.to_date(F.lit(as_of))
    if window == "all":
        return F.lit(True)
    if window == "current_week":
        return F.coalesce(day.between(week_start(now), F.date_add(week_start(now), 6)), F.lit(False))
    if window in ("last_7", "last_30"):
        return F.coalesce(day.between(F.date_sub(now, int(window[5:])), now), F.lit(False))
    out = F.lit(True)
    if start:
        out = out & F.coalesce(day >= F.to_date(F.lit(start)), F.lit(False))
    if end:
        out = out & F.coalesce(day <= F.to_date(F.lit(end)), F.lit(False))
    return out


def same_text(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def has_text(c: Column, part: Column) -> Column:
    """Case-insensitive containment; the part's characters stand for themselves."""
    return F.contains(F.lower(c), F.lower(part))


def no_produce(c: Column) -> Column:
    return ~F.arrays_overlap(F.split(F.lower(c), r"\s+"), F.array(*map(F.lit, PRODUCE)))


def trim_outliers(df: DataFrame, keys: list[str], price: str = "price", factor: float = 2.0) -> DataFrame:
    """Groups of three or more lose prices above factor times their median, unless that would empty them.

    Medians come from the counts of each price, so that a group with many rows is not one task's. Rows with a null in a key are a group as well.
    """
    by_price = df.groupBy(*keys, F.col(price).alias("_p")).agg(F.count("*").alias("_c"))
    bound = by_price.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("_c").alias("_n"), F.expr("percentile(_p, 0.5, _c)").alias("_m"), F.min("_p").alias("_low"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    kept = (F.col("_n") < 3) | (F.col(price) <= factor * F.col("_m")) | ~F.coalesce(F.col("_low") <= factor * F.col("_m"), F.lit(False))
    return df.join(bound, same).where(kept).select(*df.columns)


def product_offers(deals: DataFrame, min_retailers: int = 2) -> DataFrame:
    """By product: retailers, mean, the cheapest row, savings in percent and the first known category."""
    g = deals.where("price > 0").groupBy("canonical").agg(
        F.count_distinct("retailer").alias("n_retailers"),
        mean_cents(F.col("price")).alias("avg_price"),
        F.min_by(F.struct("price", "retailer", "zip_code"), F.struct("price", "deal_id")).alias("b"),
        F.min_by("category", F.when(F.col("category").isNotNull(), F.col("deal_id"))).alias("category"),
    )
    g = g.where(F.col("n_retailers") >= min_retailers)
    saved = F.when(F.col("avg_price") > 0, cents((F.col("avg_price") - F.col("b.price")) / F.col("avg_price") * 100)).otherwise(0.0)
    return g.select("canonical", "n_retailers", "avg_price", F.col("b.price").alias("best_price"), F.col("b.retailer").alias("best_retailer"), F.col("b.zip_code").alias("best_zip"), "category", saved.alias("savings_pct"))


def offer_details(deals: DataFrame) -> DataFrame:
    """By (product, retailer, zip): best price after the 3x-median trim of the product, and savings against the product's mean."""
    d = deals.where("price > 0")
    by_price = d.groupBy("canonical", "price").agg(F.count("*").alias("n"))
    bound = by_price.groupBy("canonical").agg(F.sum("n").alias("_n"), F.expr("percentile(price, 0.5, n)").alias("_m"), F.min("price").alias("_low"))
    # fewer than three prices all stay, and where none would stay
    kept = d.join(bound, "canonical").where("_n < 3 or price <= 3 * _m or _low > 3 * _m").drop("_n", "_m", "_low")
    product = kept.groupBy("canonical").agg(mean_cents(F.col("price")).alias("avg_price"), F.count_distinct("retailer").alias("n_retailers")).where("n_retailers >= 2")
    own = kept.groupBy("canonical", "retailer", "zip_code").agg(F.min("price").alias("best_price"), F.count("*").alias("n_offers"))
    out = own.join(product, "canonical")
    return out.withColumn("savings_pct", cents((F.col("avg_price") - F.col("best_price")) / F.col("avg_price") * 100))


def candidate_score(likeness: Column, n_retailers: Column) -> Column:
    return likeness * 10 + n_retailers * 0.1


def best_candidate(rows: DataFrame, keys: list[str], name: str, likeness: Column, n_retailers: Column) -> DataFrame:
    """By keys: the candidate (name) with the best score, on equal scores the last by name."""
    return rows.groupBy(*keys).agg(F.max_by(name, F.struct(candidate_score(likeness, n_retailers), F.col(name))).alias("best"))


def search(requests: DataFrame, deals: DataFrame, k: int = 20) -> DataFrame:
    """By request (request_id, term): products whose name holds the term, those with most retailers first, with their first key.

    Distinct terms meet distinct names by the index of containment.py. Names are compared and grouped as normalised again; deals may have a match_key.
    """
    r = requests.select("request_id", F.lower("term").alias("term"))
    renamed = deals.select("canonical").distinct().withColumn("name", F.lower(F.trim(F.regexp_replace("canonical", r"\s+", " "))))
    hits = renamed.join(contained(renamed, "name", r, "term"), "name").select("term", "canonical", "name")
    key = F.col("match_key") if "match_key" in deals.columns else F.lit(None).cast("string")
    d = deals.select("canonical", "brand", "retailer", "price", "deal_id", key.alias("match_key"))
    # by name and brand once, however many terms ask for it
    asked = d.join(hits.select("canonical", "name").distinct(), "canonical")
    g = asked.groupBy("name", F.lower("brand").alias("brand")).agg(
        F.count_distinct("retailer").alias("n_retailers"),
        F.min(F.when(F.col("price") > 0, F.col("price"))).alias("min_price"),
        F.max("price").alias("max_price"),
        mean_cents(F.when(F.col("price") > 0, F.col("price"))).alias("avg_price"),
        F.min_by("match_key", F.when(F.col("match_key").isNotNull(), F.col("deal_id"))).alias("match_key"),
    )
    by_term = hits.select("term", "name").distinct().join(g, "name")
    n = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n_retailers"), "name", "brand"))
    top = by_term.withColumn("rank", n).where(F.col("rank") <= k)
    return meet(r, top, ["term"], ["request_id"]).withColumnRenamed("name", "canonical").drop("term")


def size_tiers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Size tiers of each request that two or more retailers offer; selected is the one with most retailers."""
    g = rows.withColumn("size_key", size_key(F.col("base_amount"), F.col("base_unit"))).where("size_key is not null")
    g = g.groupBy(*keys, "size_key").agg(F.count_distinct("retailer").alias("n_retailers"), F.min("price").alias("min_price")).where("n_retailers >= 2")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_retailers"), "size_key"))
    return g.withColumn("selected", n == 1)


def resolve_names(requests: DataFrame, deals: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """(request_id, canonical): the product each request means, by ranked fallbacks.

    A curated name (term, canonical) replaces the term. Then the exact name; with at most one retailer, the name with its words sorted if that
    has more; with still at most one, the most similar product among those that hold the term; with none, the product with most
    retailers among those that hold the longest leading part of the term that any holds. Equal terms are resolved once.
    """
    names = deals.select("canonical", "retailer").distinct().groupBy("canonical").agg(F.count("*").alias("n"))
    asked = requests.select("request_id", F.lower(F.trim("term")).alias("said"))
    if curated is not None:
        better = curated.groupBy(F.lower(F.trim("term")).alias("said")).agg(F.min(F.lower("canonical")).alias("better"))
        asked = asked.join(better, "said", "left").select("request_id", F.coalesce("better", "said").alias("said"))
    r = asked.select(F.col("said").alias("request_id"), F.col("said").alias("term")).distinct()
    exact = r.join(names, r.term == names.canonical).select("request_id", "term", "canonical", "n", F.lit(1).alias("step"), F.lit(0.0).alias("fit"))
    by_words = names.withColumn("w", word_sort(F.col("canonical")))
    turned = r.join(by_words, word_sort(r.term) == by_words.w).select("request_id", "term", "canonical", "n", F.lit(2).alias("step"), F.lit(0.0).alias("fit"))
    short = names.where(F.length("canonical") <= 80)
    like = short.join(contained(short, "canonical", r, "term"), "canonical").select(
        F.col("term").alias("request_id"), "term", "canonical", "n", F.lit(3).alias("step"), candidate_score(name_similarity(F.col("term"), F.col("canonical")), F.col("n")).alias("fit")
    )
    words = F.split("term", " ")
    parts = r.select("request_id", "term", F.explode(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1)))).alias("k"))
    parts = parts.withColumn("lead", F.array_join(F.slice(F.split("term", " "), 1, F.col("k")), " "))
    held = names.join(contained(names, "canonical", parts, "lead"), "canonical")
    held = held.groupBy("lead").agg(F.max_by(F.struct("canonical", "n"), F.struct("n", "canonical")).alias("h")).select("lead", "h.canonical", "h.n")
    lead = parts.join(held, "lead")
    lead = lead.select("request_id", "term", "canonical", "n", F.lit(4).alias("step"), F.col("k").cast("double").alias("fit"))
    every = exact.union(turned).union(like).union(lead)
    # a later step only wins with more retailers than an earlier one found (four: where there is nothing else)
    order = F.struct(F.when(F.col("step") == 4, 0).when(F.col("n") > 1, 2).otherwise(1), F.when(F.col("n") > 1, -F.col("step")).otherwise(F.col("n")), F.col("fit"), F.col("n"), F.col("canonical"))
    found = every.groupBy(F.col("request_id").alias("said")).agg(F.max_by(F.struct("canonical", "step", "n"), order).alias("m"))
    return asked.join(found, "said").select("request_id", "m.canonical", "m.step", F.col("m.n").alias("n_retailers"))


def _active(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """asked (canonical, size) with mode and, by mode, the rows to compare.

    A size that is asked for and that two retailers offer; the size with most retailers; ppu, where it is asked for and a shared size can be
    converted: all shared sizes by price per ounce. Where no size is shared: all convertible rows by price per ounce if they differ in size,
    else the unit with most retailers, or all rows with a size, or all rows.
    """
    tiers = size_tiers(rows, ["canonical"])
    ounce = lambda u: price_per_oz(F.lit(1.0), F.lit(1.0), u).isNotNull()
    shared = tiers.groupBy("canonical").agg(
        F.sort_array(F.collect_list("size_key")).alias("keys"), F.max(F.when(F.col("selected"), F.col("size_key"))).alias("top"), F.max(ounce(F.substring_index("size_key", "_", -1))).alias("by_ounce")
    )
    sized, converts = F.coalesce(F.col("base_amount") > 0, F.lit(False)), F.col("ppu").isNotNull()
    facts = rows.groupBy("canonical").agg(
        F.count_distinct(F.when(sized, F.col("retailer"))).alias("n_sized"), F.count_distinct(F.when(converts, F.col("retailer"))).alias("n_converts"), F.count_distinct(F.when(converts, F.col("base_amount"))).alias("n_amounts")
    )
    units = rows.where(sized).groupBy("canonical", "base_unit").agg(F.count_distinct("retailer").alias("n"))
    units = units.groupBy("canonical").agg(F.min_by(F.struct("base_unit", "n"), F.struct(-F.col("n"), F.col("base_unit"))).alias("unit"))
    a = asked.join(shared, "canonical", "left").join(facts, "canonical").join(units, "canonical", "left")
    mode = (
        F.when((F.col("size") == "ppu") & F.col("by_ounce"), "ppu").when(F.col("keys").isNotNull(), "tier").when(F.col("n_sized") < 2, "all")
        .when((F.col("n_amounts") > 1) & (F.col("n_converts") >= 2), "ppu_all").when(F.col("unit.n") >= 2, "unit").otherwise("sized")
    )
    wanted = F.when(F.array_contains("keys", F.col("size")), F.col("size")).otherwise(F.col("top"))
    a = a.select("canonical", "size", mode.alias("mode"), wanted.alias("wanted"), "keys", F.col("unit.base_unit").alias("best_unit"))
    both = a.join(rows, "canonical")
    takes = (
        F.when(F.col("mode") == "tier", F.col("size_key") == F.col("wanted")).when(F.col("mode") == "ppu", F.array_contains("keys", F.col("size_key")) & converts)
        .when(F.col("mode") == "ppu_all", converts).when(F.col("mode") == "unit", sized & (F.col("base_unit") == F.col("best_unit"))).when(F.col("mode") == "sized", sized).otherwise(F.lit(True))
    )
    return both.where(takes).withColumn("size_key", F.when(F.col("mode") == "tier", F.col("wanted")).otherwise(F.col("mode")))


def compare(requests: DataFrame, deals: DataFrame) -> DataFrame:
    """By request (request_id, canonical and, optionally, size) and retailer: its best offer against the mean of all.

    Each pair of product and size is compared once, for all its requests. Each retailer counts once; prices above twice the
    median go before the mean is taken.
    """
    r = requests if "size" in requests.columns else requests.withColumn("size", F.lit(None).cast("string"))
    asked = r.select("canonical", "size").distinct()
    rows = deals.where("price > 0").join(asked.select("canonical").distinct(), "canonical", "left_semi")
    rows = rows.withColumns({"size_key": size_key(F.col("base_amount"), F.col("base_unit")), "ppu": price_per_oz(F.col("price"), F.col("base_amount"), F.col("base_unit"))})
    by_ounce = F.col("mode").startswith("ppu")
    rows = _active(asked, rows).withColumn("size", F.coalesce("size", F.lit(""))).withColumn("value", F.when(by_ounce, F.col("ppu")).otherwise(F.col("price")))
    best = rows.groupBy("canonical", "size", "mode", "size_key", "retailer").agg(F.min("value").alias("value"))
    own = Window.partitionBy("canonical", "size")  # a row a retailer
    one = best.withColumns({"_n": F.count("*").over(own), "_m": F.median("value").over(own)}).where("_n < 3 or value <= 2 * _m")
    scale = F.when(by_ounce, 10000).otherwise(100)
    mean = F.floor(F.sum(F.round(F.col("value") * scale).cast("long")).over(own) / F.count("*").over(own) + 0.5) / scale
    one = one.withColumn("avg_value", mean).withColumn("n_retailers", F.count("*").over(own))
    pct = cents((F.col("value") - F.col("avg_value")) / F.col("avg_value") * 100)
    one = one.withColumn("vs_avg_pct", pct).withColumn("quality", quality(pct))
    one = one.withColumn("rank", F.row_number().over(own.orderBy("value", "retailer")))
    out = meet(r.select("request_id", "canonical", F.coalesce("size", F.lit("")).alias("size")), one, ["canonical", "size"], ["request_id"])
    return out.select("request_id", "canonical", "mode", "size_key", "retailer", "value", "avg_value", "vs_avg_pct", "quality", "rank", "n_retailers")


def quality(pct: Column) -> Column:
    return F.when(pct <= -15, "great").when(pct <= -5, "good").when(pct <= 5, "fair").otherwise("expensive")


def reason(rank: Column, n: Column, value: Column, mean: Column) -> Column:
    """A line of text for an offer; rank 1 is the best."""
    diff = cents(mean - value)
    return (
        F.when((rank == 1) & (n <= 1), "Only retailer found for this product")
        .when(rank == 1, F.format_string("Lowest price — $%.2f below average across %d retailers", diff, n))
        .when(diff > 0, F.format_string("$%.2f below average", diff))
        .when(diff == 0, "At average price")
        .otherwise(F.format_string("$%.2f above average", -diff))
    )


def available_sizes(deals: DataFrame, products: DataFrame) -> DataFrame:
    """By product (canonical): the sizes that two or more retailers offer, in order, and ppu where there are several and one can be converted."""
    rows = deals.where("price > 0").join(products.select("canonical").distinct(), "canonical", "left_semi")
    tiers = size_tiers(rows, ["canonical"])
    ounce = F.max(price_per_oz(F.lit(1.0), F.lit(1.0), F.substring_index("size_key", "_", -1)).isNotNull())
    g = tiers.groupBy("canonical").agg(F.sort_array(F.collect_list("size_key")).alias("keys"), ounce.alias("by_ounce"))
    tab = F.when(F.col("by_ounce") & (F.size("keys") > 1), F.array(F.lit("ppu"))).otherwise(F.array().cast("array<string>"))
    return g.select("canonical", F.concat("keys", tab).alias("sizes"))


def compare_document(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One nested row for each request: its retailers in rank order with their reasons, a summary, and the sizes (available_sizes) to choose from."""
    r = rows.withColumn("reason", reason(F.col("rank"), F.col("n_retailers"), F.col("value"), F.col("avg_value")))
    items = F.array_sort(F.collect_list(F.struct("rank", "retailer", "value", "vs_avg_pct", "quality", "reason")))
    g = r.groupBy("request_id", "canonical", "mode", "size_key").agg(items.alias("retailers"), F.max("n_retailers").alias("n_retailers"), F.max("avg_value").alias("avg_value"), F.max("value").alias("_high"))
    first, high = F.get("retailers", F.lit(0)), F.col("_high")
    summary = (
        F.when(F.col("mode").startswith("ppu") & (F.col("n_retailers") > 1), F.format_string("Comparing %d retailers by $/oz. Best value is $%.4f/oz at %s.", "n_retailers", first["value"], first["retailer"]))
        .when(F.col("n_retailers") <= 1, F.format_string("Found at %s for $%.2f.", first["retailer"], first["value"]))
        .otherwise(F.format_string("Comparing %d retailers. Best price is $%.2f at %s, saving $%.2f vs the highest price.", "n_retailers", first["value"], first["retailer"], cents(high - first["value"])))
    )
    g = g.withColumn("summary", summary).drop("_high")
    return g if sizes is None else g.join(sizes, "canonical", "left")


def retailer_counts(deals: DataFrame) -> DataFrame:
    return deals.groupBy(F.lower(F.trim("retailer")).alias("retailer")).agg(F.count("*").alias("n"))


def deal_details(requests: DataFrame, deals: DataFrame) -> DataFrame:
    """By request (request_id, canonical): low, high, median and number of retailers, and the savings of the low against the median.

    The median comes from the counts of each price, so that a product with many deals is no single large group.
    """
    d = deals.where("price > 0").join(requests.select("canonical").distinct(), "canonical", "left_semi")
    by_price = d.groupBy("canonical", "price").agg(F.count("*").alias("n"))
    g = by_price.groupBy("canonical").agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.expr("percentile(price, 0.5, n)").alias("median_price"))
    n = d.select("canonical", "retailer").distinct().groupBy("canonical").agg(F.count("*").alias("n_retailers"))
    pct = F.floor((F.col("median_price") - F.col("min_price")) / F.col("median_price") * 100 + 0.5)
    g = g.join(n, "canonical").withColumn("savings_pct", F.when(F.col("min_price") < F.col("median_price"), pct))
    return requests.select("request_id", "canonical").join(g, "canonical")


def browse(requests: DataFrame, deals: DataFrame, k: int = 2000) -> DataFrame:
    """By request (request_id, zip_code): the cheapest named deals of its zip."""
    d = deals.where("price > 0 and canonical is not null and canonical <> ''").join(requests.select("zip_code").distinct(), "zip_code", "left_semi")
    n = F.row_number().over(Window.partitionBy("zip_code").orderBy("price", "deal_id"))  # once for each zip
    top = d.withColumn("rank", n).where(F.col("rank") <= k)
    return requests.select("request_id", "zip_code").join(top, "zip_code").select("request_id", "rank", "deal_id", "canonical", "retailer", "price")


def cart_stores(requests: DataFrame, deals: DataFrame) -> DataFrame:
    """By request (request_id, items) and store of deals (with distance_miles): what matches, its total and a score with a cost per mile."""
    asked = requests.select("request_id", F.explode("items").alias("item")).withColumn("_low", F.lower("item"))
    lower = deals.select("canonical").distinct().withColumn("_name", F.lower("canonical"))
    names = lower.join(contained(lower, "_name", asked, "_low"), "_name").join(asked, "_low").select("canonical", "request_id", "item")
    keys = ["canonical", "request_id"] if "request_id" in deals.columns else ["canonical"]  # distances may be those of a request
    # one row a deal and request, whatever items it has
    d = deals.select(*keys, "store_id", "deal_id", "price", "distance_miles").join(names.select("canonical").distinct(), "canonical", "left_semi").repartition("store_id", "deal_id")
    hits = d.join(names.select("canonical", "request_id").distinct(), keys).groupBy("request_id", "store_id", "deal_id").agg(F.max("price").alias("price"), F.max("distance_miles").alias("miles"))
    g = hits.groupBy("request_id", "store_id").agg(cents(F.sum(F.round(F.col("price") * 100).cast("long")) / 100).alias("total"), F.count("*").alias("n_deals"), F.max("miles").alias("miles"))
    # which items a store has follows from its products
    has = deals.select(*keys, "store_id").distinct().join(names, keys).select("request_id", "store_id", "item").distinct()
    found = has.groupBy(F.col("request_id").alias("_request"), F.col("store_id").alias("_store")).agg(F.count("*").cast("int").alias("items_found"))
    g = g.join(found, F.col("request_id").eqNullSafe(F.col("_request")) & F.col("store_id").eqNullSafe(F.col("_store")))
    g = g.select("request_id", "store_id", "total", "n_deals", "items_found", "miles")
    return g.withColumn("score", cents(F.col("total") + F.col("miles") * 0.1))


def cart_totals(basket: DataFrame, deals: DataFrame) -> DataFrame:
    """By (basket_id, retailer, zip): the cheapest of each item, total, items found and missing; basket (basket_id, canonical), an item a row.

    Items that several baskets ask for are priced once; repeated items count once, null items never.
    """
    asked = basket.select("basket_id", "canonical").where("canonical is not null").distinct()
    priced = deals.join(asked.select("canonical").distinct(), "canonical", "left_semi")
    cheapest = priced.groupBy("retailer", "zip_code", "canonical").agg(F.min("price").alias("price"))
    total = cents(F.sum(F.round(F.col("price") * 100).cast("long")) / 100)
    found = cheapest.join(asked, "canonical").groupBy("basket_id", "retailer", "zip_code").agg(total.alias("total_price"), F.count("*").alias("items_found"))
    sizes = asked.groupBy("basket_id").agg(F.count("*").alias("z"))
    return found.join(sizes, "basket_id").select("basket_id", "retailer", "zip_code", "total_price", "items_found", (F.col("z") - F.col("items_found")).cast("int").alias("items_missing"))


def nearest_size(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """By item (item_id, term, value, family): the catalog row (term, sku, value, family, in_stock) of the same family and nearest size.

    In stock first; without a size the first in stock by sku.
    """
    # of rows alike in all that is compared only the first can be nearest
    c = catalog.groupBy("term", F.col("value").alias("v"), F.col("family").alias("f"), "in_stock").agg(F.min("sku").alias("sku"))
    d = items.select("term", "value", "family").distinct().join(c, "term")  # items that ask alike are answered once
    same = F.coalesce(F.col("family") == F.col("f"), F.lit(False))
    off = F.when(same, F.abs(F.col("value") - F.col("v")))
    best = F.min_by(F.struct("sku", "in_stock"), F.struct((~F.col("in_stock")).cast("int"), (~same).cast("int"), F.coalesce(off, F.lit(float("inf"))), "sku"))
    g = d.groupBy("term", F.col("value").alias("gv"), F.col("family").alias("gf")).agg(best.alias("b")).withColumnRenamed("term", "gt")
    out = items.join(g, (F.col("term") == F.col("gt")) & F.col("value").eqNullSafe(F.col("gv")) & F.col("family").eqNullSafe(F.col("gf")))
    return out.select("item_id", "term", "b.sku", "b.in_stock")


def key_match_report(deals: DataFrame) -> DataFrame:
    """One row: keyed rows, groups, groups of two or more retailers, rows in those, names with several sizes, and how sure the keys are.

    A key with brand and size is of high confidence, with one of them of medium, with none of low.
    """
    parts = F.col("brand").isNotNull().cast("int") + F.col("base_amount").isNotNull().cast("int")
    d = deals.withColumn("key", F.concat_ws("|", "brand", "canonical", F.coalesce(F.col("base_amount").cast("string"), F.lit("no_size"))))
    by_key = d.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("retailer").alias("r"))
    by_name = d.groupBy("canonical").agg(F.count_distinct("base_amount").alias("sizes"))
    sure = d.agg(*[F.count_if(parts == k).alias(f"n_{name}") for k, name in enumerate(("low", "medium", "high"))])
    a = by_key.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("r") >= 2).alias("n_shared"), F.sum(F.when(F.col("r") >= 2, F.col("n")).otherwise(0)).alias("rows_shared"))
    return a.crossJoin(by_name.agg(F.count_if(F.col("sizes") > 1).alias("names_with_sizes"))).crossJoin(sure)  # one row each
