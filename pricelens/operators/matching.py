"""Matching deals to stores, and joins by distance.

Distance joins put every store into grid cells at least as wide as the radius and probe the nine cells around a point, so that they are
equi-joins on a cell (and a retailer, where there is one); exact distances filter the rest. Distances are computed for
distinct (retailer, zip) pairs first, then joined back to the deals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine, valid_coord
from ..sources.tables import first_by, meet

MILES_PER_DEGREE = 69.0
#: The radius by retailer where it isn't the default.
DEFAULT_RADIUS = 15.0
RADII = {"aldi": 20.0, "smiths": 20.0, "wholefoods": 20.0} | dict.fromkeys(("costco", "heb", "bjs", "foodlion", "samsclub", "dollartree", "kroger"), 30.0)


def geo_join(points: DataFrame, places: DataFrame, miles: float, keys: list[str] = [], within: Column | None = None) -> DataFrame:
    """points (latitude, longitude, ...) with every place (plat, plon, ...) within miles, and distance_miles.

    keys: columns of both sides that must be equal. within: a radius per pair, at most miles. Longitude cells widen with the largest latitude
    that is supported, 66 degrees.
    """
    lat_step, lon_step = miles / MILES_PER_DEGREE, miles / (MILES_PER_DEGREE * 0.4)
    cell = lambda lat, lon: (F.floor(lat / lat_step), F.floor(lon / lon_step))
    i, j = cell(F.col("plat"), F.col("plon"))
    around = F.array(*[F.struct((i + a).alias("ci"), (j + b).alias("cj")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = places.where(valid_coord(F.col("plat"), F.col("plon"))).select("*", F.explode(around).alias("c")).select("*", "c.ci", "c.cj").drop("c")
    i, j = cell(F.col("latitude"), F.col("longitude"))
    probe = points.where(valid_coord(F.col("latitude"), F.col("longitude"))).withColumns({"ci": i, "cj": j})
    near = probe.join(spread, [*keys, "ci", "cj"]).withColumn("distance_miles", haversine(F.col("latitude"), F.col("longitude"), F.col("plat"), F.col("plon")))
    return near.where(F.col("distance_miles") <= (F.lit(miles) if within is None else within)).drop("ci", "cj")


def as_places(stores: DataFrame, *columns: str) -> DataFrame:
    return stores.select(*columns, F.col("latitude").alias("plat"), F.col("longitude").alias("plon"))


def stores_near(points: DataFrame, stores: DataFrame, miles: float, k: int) -> DataFrame:
    """By point (point_id): the nearest stores within miles, distances to two places."""
    d = geo_join(points, as_places(stores, "store_id", "retailer_key"), miles)
    d = d.withColumn("distance_miles", F.floor(F.col("distance_miles") * 100 + 0.5) / 100)
    n = F.row_number().over(Window.partitionBy("point_id").orderBy("distance_miles", "store_id"))
    return d.withColumn("rank", n).where(F.col("rank") <= k).select("point_id", "rank", "store_id", "retailer_key", "distance_miles")


def match_exact(deals: DataFrame, stores: DataFrame, keys: list[str]) -> DataFrame:
    """deals with matched_store: the smallest store id of equal keys."""
    one = stores.groupBy(*keys).agg(F.min("store_id").alias("matched_store"))
    return deals.join(one, keys, "left")


def match_zip3(deals: DataFrame, stores: DataFrame) -> DataFrame:
    """deals with matched_store where the retailer has exactly one store in the zip's first three digits."""
    s = stores.groupBy("retailer_key", F.substring("zip_code", 1, 3).alias("zip3")).agg(F.min("store_id").alias("matched_store"), F.count("*").alias("n")).where("n = 1").drop("n")
    return deals.withColumn("zip3", F.substring("zip_code", 1, 3)).join(s, ["retailer_key", "zip3"], "left").drop("zip3")


def nearest(points: DataFrame, stores: DataFrame, miles: float) -> DataFrame:
    """By (retailer_key, zip_code): the nearest store of the retailer within miles."""
    d = geo_join(points, as_places(stores, "store_id", "retailer_key"), miles, ["retailer_key"])
    best = F.min_by(F.struct("store_id", "distance_miles"), F.struct("distance_miles", "store_id"))
    return d.groupBy("retailer_key", "zip_code").agg(best.alias("b")).select("retailer_key", "zip_code", "b.store_id", "b.distance_miles")


def match_waterfall(deals: DataFrame, stores: DataFrame, zips: DataFrame, cap: float = 50.0) -> DataFrame:
    """deals (deal_id, retailer_key, zip_code) with matched_store and matched_by, each by the first pass that finds one.

    Passes: equal zip; the only store of the zip's first three digits; nearest to the zip's centre within cap. All passes
    are worked out once for the distinct (retailer, zip) pairs.
    """
    pairs = deals.select("retailer_key", "zip_code").distinct()
    one = match_exact(pairs, stores, ["retailer_key", "zip_code"]).withColumnRenamed("matched_store", "s1")
    two = match_zip3(one, stores).withColumnRenamed("matched_store", "s2")
    far = nearest(pairs.join(zips, "zip_code"), stores, cap).select("retailer_key", "zip_code", F.col("store_id").alias("s3"))
    m = two.join(far, ["retailer_key", "zip_code"], "left")
    by = F.when(F.col("s1").isNotNull(), "zip").when(F.col("s2").isNotNull(), "zip3").when(F.col("s3").isNotNull(), "nearest").otherwise("none")
    m = m.select("retailer_key", "zip_code", F.coalesce("s1", "s2", "s3").alias("matched_store"), by.alias("matched_by"))
    return deals.join(m, ["retailer_key", "zip_code"], "left")


def banner_key(key: Column, override: dict[str, str] = {"wholefoodsv2": "wholefoods", "aldiv2": "aldi", "krogerbanner": "kroger"}) -> Column:
    table = F.create_map(*[F.lit(x) for kv in override.items() for x in kv])
    k = F.lower(F.trim(key))
    return F.coalesce(F.try_element_at(table, k), k)


def radius_of(key: Column, radii: dict[str, float] = RADII) -> Column:
    table = F.create_map(*[F.lit(x) for kv in radii.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(DEFAULT_RADIUS))


def match_store(deals: DataFrame, stores: DataFrame, zips: DataFrame, radii: dict[str, float] = RADII) -> DataFrame:
    """By deal (id, retailer_key, zip_code, store_lat, store_lng): the store by banner key, exact zip first, else nearest within the retailer's radius.

    Only stores with valid coordinates count. A key without any takes the stores whose retailer is named like the deal's (retailer, in both
    tables or not at all; case and outer spaces don't count). match_confidence: zip_single, zip_multi, nearest_within_radius,
    no_store_within_radius, no_point or no_catalog; candidate_store_ids by distance. Deals that ask alike are matched once, so that
    stores meet distinct keys, zips and points.
    """
    named = "retailer" in deals.columns and "retailer" in stores.columns
    own = valid_coord(F.col("store_lat"), F.col("store_lng"))
    name = F.lower(F.trim("retailer")) if named else F.lit(None).cast("string")
    d = deals.select("id", banner_key(F.col("retailer_key")).alias("key"), name.alias("name"), "zip_code", F.when(own, F.col("store_lat")).alias("own_lat"), F.when(own, F.col("store_lng")).alias("own_lng"))
    ask = ["key", "name", "zip_code", "own_lat", "own_lng"]
    s = stores.where(valid_coord(F.col("latitude"), F.col("longitude"))).withColumn("key", banner_key(F.col("retailer_key")))
    shelf = s.select("*", F.concat(F.lit("key "), "key").alias("shelf"))
    if named:
        shelf = shelf.unionByName(s.withColumn("shelf", F.concat(F.lit("name "), F.lower(F.trim("retailer")))))
    has = lambda c, flag: shelf.select(F.col("shelf").alias(c)).distinct().withColumn(flag, F.lit(True))
    a = d.select(ask).distinct().join(zips.select("zip_code", F.col("latitude").alias("zlat"), F.col("longitude").alias("zlon")), "zip_code", "left")
    a = a.withColumns({"by_key": F.concat(F.lit("key "), "key"), "by_name": F.concat(F.lit("name "), "name")}).join(has("by_key", "_k"), "by_key", "left").join(has("by_name", "_n"), "by_name", "left")
    a = a.withColumn("shelf", F.when(F.col("_k"), F.col("by_key")).when(F.col("_n"), F.col("by_name")))
    a = a.withColumns({"latitude": F.coalesce("own_lat", "zlat"), "longitude": F.coalesce("own_lng", "zlon")})
    pointed = valid_coord(F.col("latitude"), F.col("longitude"))
    a = a.select(*ask, "shelf", F.when(pointed, F.col("latitude")).alias("latitude"), F.when(pointed, F.col("longitude")).alias("longitude"))
    places = shelf.select("shelf", "zip_code", F.col("id").alias("cand"), F.col("key").alias("cand_key"), F.col("latitude").alias("plat"), F.col("longitude").alias("plon"))
    dist = haversine(F.col("latitude"), F.col("longitude"), F.col("plat"), F.col("plon"))
    same = a.join(places, ["shelf", "zip_code"]).withColumn("distance_miles", dist)
    near = geo_join(a, places.drop("zip_code"), max([DEFAULT_RADIUS, *radii.values()]), ["shelf"], radius_of(F.col("key"), radii))
    hit = F.struct(F.col("distance_miles").alias("miles"), "cand", "cand_key")
    pick = lambda x, name: x.groupBy(*ask).agg(F.array_sort(F.collect_list(hit)).alias(name))
    for found in (pick(same, "zip_c"), pick(near, "near_c")):
        a = _join_null_safe(a, found, ask)
    cands = F.coalesce("zip_c", "near_c")
    how = (
        F.when(F.size("zip_c") == 1, "zip_single").when(F.size("zip_c") > 1, "zip_multi").when(F.size("near_c") > 0, "nearest_within_radius")
        .when(F.col("shelf").isNull(), "no_catalog").when(F.col("latitude").isNull(), "no_point").otherwise("no_store_within_radius")
    )
    a = a.select(
        *ask, cands[0]["cand"].alias("store_id"), how.alias("match_confidence"), F.coalesce(F.size(cands), F.lit(0)).alias("candidate_store_count"),
        F.transform(cands, lambda c: c["cand"]).alias("candidate_store_ids"), cands[0]["miles"].alias("distance_miles"), cands[0]["cand_key"].alias("store_retailer_key"),
    )
    return _join_null_safe(d, a, ask).drop(*ask)


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's further columns, by keys that are equal or both null."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(r, on, "left").drop(*[f"_r_{k}" for k in keys])


def repair_store_ids(deals: DataFrame, stores: DataFrame, zips: DataFrame) -> DataFrame:
    """Changes for deals whose store isn't one of their retailer's: the rematched store, or null with the reason."""
    valid = stores.select(F.col("id").alias("store_id"), banner_key(F.col("retailer_key")).alias("key")).distinct()
    bad = deals.withColumn("key", banner_key(F.col("retailer_key"))).join(valid, ["store_id", "key"], "left_anti")
    new = match_store(bad.drop("key", "store_id"), stores, zips)
    return new.select("id", "store_id", F.when(F.col("store_id").isNull(), F.col("match_confidence")).otherwise("remapped").alias("reason"))


def clear_refs(deals: DataFrame, removed: DataFrame) -> DataFrame:
    """deals with store_id null where the store is in removed (store_id)."""
    gone = removed.select(F.col("store_id").alias("_gone")).distinct()
    return deals.join(gone, F.col("store_id") == F.col("_gone"), "left").withColumn("store_id", F.when(F.col("_gone").isNull(), F.col("store_id"))).drop("_gone")


def resolve_store(deals: DataFrame, stores: DataFrame) -> DataFrame:
    """By deal (deal_id, store_id, candidate_store_ids, latitude, longitude of the user): nearest candidate, else the assigned store."""
    c = deals.where("latitude is not null").select("deal_id", "latitude", "longitude", F.explode("candidate_store_ids").alias("cand"))
    s = as_places(stores, "store_id").withColumnRenamed("store_id", "cand")
    near = c.join(s, "cand").where(valid_coord(F.col("plat"), F.col("plon"))).withColumn("m", haversine(F.col("latitude"), F.col("longitude"), F.col("plat"), F.col("plon")))
    near = near.groupBy("deal_id").agg(F.min_by("cand", F.struct("m", "cand")).alias("near_store"))
    return deals.join(near, "deal_id", "left").withColumn("resolved_store", F.coalesce("near_store", "store_id")).where("resolved_store is not null").drop("near_store")


def deals_near(requests: DataFrame, deals: DataFrame, stores: DataFrame, miles: float, k: int) -> DataFrame:
    """By request (point_id, latitude, longitude): the k cheapest deals of stores within miles, then nearest first."""
    near = geo_join(requests, as_places(stores, "store_id"), miles).select("point_id", "store_id", (F.floor(F.col("distance_miles") * 100 + 0.5) / 100).alias("distance_miles"))
    # a point's k cheapest are among the k cheapest of each of its stores
    own = F.row_number().over(Window.partitionBy("store_id").orderBy("price", "deal_id"))
    d = deals.where("price > 0").select("deal_id", "store_id", "canonical", "price").withColumn("_n", own).where(F.col("_n") <= k).drop("_n").join(near, "store_id")
    n = F.row_number().over(Window.partitionBy("point_id").orderBy("price", "deal_id"))
    d = d.withColumn("_n", n).where(F.col("_n") <= k)
    order = F.row_number().over(Window.partitionBy("point_id").orderBy(F.coalesce("distance_miles", F.lit(999.0)), "price", "deal_id"))
    return d.select("point_id", "deal_id", "store_id", "canonical", "price", "distance_miles", order.alias("rank"))


def map_pins(near: DataFrame, stores: DataFrame) -> DataFrame:
    """By request and place: number of deals, the best price and its product."""
    d = near.join(stores.select("store_id", "latitude", "longitude"), "store_id")
    g = d.groupBy("point_id", "latitude", "longitude").agg(F.count("*").alias("n_deals"), F.min_by(F.struct("price", "canonical"), F.struct("price", "deal_id")).alias("b"), F.min("distance_miles").alias("distance_miles"))
    return g.select("point_id", "latitude", "longitude", "n_deals", F.col("b.price").alias("best_price"), F.col("b.canonical").alias("best_product"), "distance_miles")


def nearest_per_retailer(points: DataFrame, stores: DataFrame, miles: float) -> DataFrame:
    """By point and retailer: its nearest store with a real position."""
    real = stores.where("geocode_confidence not in ('zip_centroid', 'zip')")
    d = geo_join(points, as_places(real, "store_id", "retailer_key"), miles)
    g = d.groupBy("point_id", "retailer_key").agg(F.min_by(F.struct("store_id", "distance_miles"), F.struct("distance_miles", "store_id")).alias("b"))
    return g.select("point_id", "retailer_key", "b.store_id", (F.floor(F.col("b.distance_miles") * 100 + 0.5) / 100).alias("distance_miles"))


def store_of_request(requests: DataFrame, stores: DataFrame, miles: float) -> DataFrame:
    """By request (request_id, retailer, zip_code and the user's latitude and longitude): one store of the retailer, found_by and distance_miles.

    A retailer is known by its key (letters and digits only) or by its name (stores.retailer). The store is the one nearest to the user within
    miles that has a real position; without any, or without a user's point, that of the request's zip, by key first. Requests that ask
    alike are answered once.
    """
    said = F.lower(F.trim("retailer"))
    bare = F.regexp_replace(said, "[^a-z0-9]", "")
    ask = ["retailer", "zip_code", "latitude", "longitude"]
    a = requests.select(ask).distinct().select("*", F.explode(F.array(F.struct(F.concat(F.lit("key "), bare).alias("shelf"), F.lit(0).alias("way")), F.struct(F.concat(F.lit("name "), said).alias("shelf"), F.lit(1).alias("way")))).alias("s"))
    a = a.select(*ask, "s.shelf", "s.way")
    shelves = F.explode(F.array_distinct(F.array(F.concat(F.lit("key "), "retailer_key"), F.concat(F.lit("name "), said)))).alias("shelf")
    s = stores.where(valid_coord(F.col("latitude"), F.col("longitude"))).select("store_id", F.trim("zip_code").alias("store_zip"), "geocode_confidence", F.col("latitude").alias("plat"), F.col("longitude").alias("plon"), shelves)
    real = s.where(~F.coalesce("geocode_confidence", F.lit("zip")).isin("zip_centroid", "zip"))
    near = geo_join(a, real, miles, ["shelf"]).groupBy(*ask).agg(F.min_by(F.struct("store_id", "distance_miles"), F.struct("distance_miles", "store_id")).alias("near"))
    there = a.join(s, [a.shelf == s.shelf, F.trim("zip_code") == F.col("store_zip")]).groupBy(*ask).agg(F.min_by("store_id", F.struct("way", "store_id")).alias("there"))
    d = _join_null_safe(_join_null_safe(requests.select("request_id", *ask), near, ask), there, ask)
    by = F.when(F.col("near").isNotNull(), "nearest").when(F.col("there").isNotNull(), "zip").otherwise("none")
    return d.select("request_id", F.coalesce("near.store_id", "there").alias("store_id"), by.alias("found_by"), (F.floor(F.col("near.distance_miles") * 100 + 0.5) / 100).alias("distance_miles"))


def retailer_proximity(points: DataFrame, stores: DataFrame, retailers: list[str], miles: float = 10.0) -> DataFrame:
    """By point: whether each retailer has a store within miles."""
    near = geo_join(points, as_places(stores.where(F.col("retailer_key").isin(retailers)), "retailer_key"), miles)
    has = near.groupBy("point_id").agg(F.collect_set("retailer_key").alias("have"))
    out = points.select("point_id").join(has, "point_id", "left")
    return out.select("point_id", *[F.coalesce(F.array_contains("have", r), F.lit(False)).alias(f"near_{r}") for r in retailers])


def reconcile(catalog: DataFrame, authority: DataFrame, miles: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(catalog with keep: whether an authoritative store is near; authoritative stores that no catalog store is near, first per zip)."""
    a = as_places(authority, F.col("store_id").alias("auth_id"))
    pairs = geo_join(catalog.select("store_id", "latitude", "longitude"), a, miles).select("store_id", "auth_id")
    kept = catalog.join(pairs.select("store_id").distinct().withColumn("keep", F.lit(True)), "store_id", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    missing = authority.join(pairs.select(F.col("auth_id").alias("store_id")).distinct(), "store_id", "left_anti")
    return kept, first_by(missing, ["zip_code"], [F.col("store_id")])


def coverage_gaps(deals: DataFrame, stores: DataFrame) -> DataFrame:
    """Retailers of deals without a store of real position, and why: only centroids, or none."""
    r = deals.select(F.col("retailer").alias("retailer_key")).distinct()
    s = stores.groupBy("retailer_key").agg(F.count_if(F.col("geocode_confidence") == "high").alias("real"))
    return r.join(s, "retailer_key", "left").where("coalesce(real, 0) = 0").select("retailer_key", F.when(F.col("real").isNull(), "missing").otherwise("centroid_only").alias("reason"))


def centroid_suspects(stores: DataFrame) -> DataFrame:
    """Stores that share a position, to four places, with another retailer's."""
    p = [F.round("latitude", 4).alias("rlat"), F.round("longitude", 4).alias("rlon")]
    s = stores.select("*", *p)
    shared = s.groupBy("rlat", "rlon").agg(F.count_distinct("retailer_key").alias("n")).where("n >= 2").drop("n")
    return s.join(shared, ["rlat", "rlon"], "left_semi").drop("rlat", "rlon")


def unmatched_retailers(deals: DataFrame, stores: DataFrame, skip: list[str]) -> DataFrame:
    """Retailers of deals without a store id that exists, minus skip."""
    d = deals.join(stores.select("store_id"), "store_id", "left_anti").select("retailer").distinct()
    return d.where(~F.col("retailer").isin(skip)) if skip else d


def import_targets(unmatched: DataFrame, targets: DataFrame) -> DataFrame:
    """(retailer, map_name, retailer_key, status) of unmatched retailers: what to look for on the map and the key to store it by (targets: retailer, map_name, retailer_key).

    status: import, or no_target where targets has none; of several targets of a retailer all are looked for. Names are compared without case and outer spaces.
    """
    named = lambda d: d.withColumn("_name", F.lower(F.trim("retailer")))
    out = named(unmatched.select("retailer").distinct()).join(named(targets.select("retailer", "map_name", "retailer_key").distinct()).drop("retailer"), "_name", "left")
    return out.select("retailer", "map_name", "retailer_key", F.when(F.col("map_name").isNull(), "no_target").otherwise("import").alias("status"))


def nearby_prices(requests: DataFrame, deals: DataFrame, stores: DataFrame, zips: DataFrame, miles: float, k: int) -> DataFrame:
    """By request (request_id, canonical, zip_code): the k cheapest stores within miles of the zip's centre that offer the product, on equal prices the nearer one.

    A store's best price of a product and the points near a zip are worked out once, and the k cheapest once for each distinct (product, zip). Stores at one point are as far
    from any zip, so the k cheapest of a product there are all that can count: what meets the zips follows points and products, not stores.
    """
    asked = requests.select("canonical", "zip_code").distinct()
    points = asked.select("zip_code").distinct().join(zips.select("zip_code", "latitude", "longitude"), "zip_code")
    near = geo_join(points, as_places(stores).distinct(), miles)
    near = near.select("zip_code", "plat", "plon", (F.floor(F.col("distance_miles") * 100 + 0.5) / 100).alias("distance_miles"))
    wanted = deals.where("price > 0").join(asked.select("canonical").distinct(), "canonical", "left_semi")
    best = wanted.groupBy("canonical", "store_id").agg(F.min("price").alias("price"))
    best = best.join(as_places(stores, "store_id", "retailer_key"), "store_id")
    n = F.row_number().over(Window.partitionBy("canonical", "plat", "plon").orderBy("price", "store_id"))
    best = best.withColumn("rank", n).where(F.col("rank") <= k).drop("rank")
    found = meet(asked, near, ["zip_code"], ["canonical"]).join(best, ["canonical", "plat", "plon"])
    n = F.row_number().over(Window.partitionBy("canonical", "zip_code").orderBy("price", "distance_miles", "store_id"))
    top = found.withColumn("rank", n).where(F.col("rank") <= k)
    return meet(requests.select("request_id", "canonical", "zip_code"), top, ["canonical", "zip_code"], ["request_id"]).select("request_id", "rank", "store_id", "retailer_key", "distance_miles", "price")


def attach_addresses(stores: DataFrame, deals: DataFrame) -> DataFrame:
    """Stores known by zip only get the address of their earliest deal that has one."""
    a = deals.where("address is not null").groupBy("retailer_key", "zip_code").agg(F.min_by("address", "id").alias("deal_address"))
    need = F.col("address").isNull()
    return stores.join(a, ["retailer_key", "zip_code"], "left").withColumn("address", F.when(need, F.col("deal_address")).otherwise(F.col("address"))).drop("deal_address")


def match_mapped(deals: DataFrame, stores: DataFrame, mapping: DataFrame) -> DataFrame:
    """deals with matched_store by the base key of their retailer variant (mapping: variant, base) and equal zip, for all variants at once."""
    base = mapping.groupBy("variant").agg(F.min("base").alias("_base"))
    s = stores.groupBy(F.col("retailer_key").alias("_base"), "zip_code").agg(F.min("store_id").alias("matched_store"))
    return deals.join(base, F.lower("retailer_key") == F.lower("variant"), "left").join(s, ["_base", "zip_code"], "left").drop("_base", "variant")


def match_nearest(deals: DataFrame, stores: DataFrame, zips: DataFrame, cap: float, sparse: list[str] = [], sparse_cap: float | None = None) -> DataFrame:
    """deals with the nearest store of their retailer within cap miles of the zip's centre; sparse retailers have a wider cap."""
    pairs = deals.select("retailer_key", "zip_code").distinct().join(zips, "zip_code")
    limit = F.when(F.col("retailer_key").isin(sparse), sparse_cap or cap).otherwise(cap)
    best = nearest(pairs, stores, max(cap, sparse_cap or cap)).where(F.col("distance_miles") <= limit)
    return deals.join(best.select("retailer_key", "zip_code", F.col("store_id").alias("matched_store"), "distance_miles"), ["retailer_key", "zip_code"], "left")


def match_or_create(deals: DataFrame, stores: DataFrame, zips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deals with their retailer's store in the zip, nearest to the zip's centre if several; one new store for each pair without any)."""
    z = zips.select("zip_code", F.col("latitude").alias("zlat"), F.col("longitude").alias("zlon"))
    s = stores.join(z, "zip_code", "left")
    far = F.coalesce(haversine(F.col("latitude"), F.col("longitude"), F.col("zlat"), F.col("zlon")), F.lit(1e9))
    one = s.groupBy("retailer_key", "zip_code").agg(F.min_by("store_id", F.struct(far, "store_id")).alias("matched_store"), F.count("*").alias("_n"))
    out = deals.join(one, ["retailer_key", "zip_code"], "left")
    out = out.withColumn("matched_by", F.when(F.col("_n") == 1, "single").when(F.col("_n") > 1, "multi_nearest").otherwise("created")).drop("_n")
    return out, out.where("matched_store is null").select("retailer_key", "zip_code").distinct()


def trigger_deals(deltas: DataFrame, hist: DataFrame, stores: DataFrame, types: list[str]) -> DataFrame:
    """Deltas of some types with the earliest history row of their key and, where known, their store's zip."""
    first = hist.groupBy("match_key").agg(F.min_by(F.struct("brand", "category"), F.struct("day", "store_id")).alias("h"))
    d = deltas.where(F.col("delta_type").isin(types)).select("match_key", "store_id", "current_price", "delta_type").join(first, "match_key")
    return d.join(stores.select("store_id", "zip_code"), "store_id", "left").select("match_key", "store_id", "current_price", "delta_type", "h.brand", "h.category", "zip_code")


def allowed(df: DataFrame, column: str, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
    """Rows whose column is in allow and not in deny (one-column frames)."""
    if allow is not None:
        df = df.join(allow.select(F.col(allow.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df if deny is None else df.join(deny.select(F.col(deny.columns[0]).alias(column)).distinct(), column, "left_anti")
