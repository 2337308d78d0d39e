"""Store catalog: normalisation, deduplication, entity resolution, verification, repair and promotion."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.geo import haversine, is_us, valid_coord
from ..sources.tables import first_by, scratch_path

REQUIRED = ["retailer", "address", "city", "state", "zip_code", "latitude", "longitude"]
#: issue -> (category, route, fields to repair)
ISSUES = {
    **{f"missing_{c}": ("completeness", "llm", [c]) for c in REQUIRED[:5]},
    "missing_coordinates": ("coordinates", "auto", ["latitude", "longitude"]),
    "invalid_coordinates": ("coordinates", "auto", ["latitude", "longitude"]),
    "outside_us": ("coordinates", "manual", ["latitude", "longitude"]),
    "city_not_in_address": ("consistency", "llm", ["full_address"]),
    "zip_state_mismatch": ("consistency", "manual", ["state", "zip_code"]),
    "address_far_from_zip": ("consistency", "manual", ["latitude", "longitude"]),
    "retailer_key_mismatch": ("identity", "auto", ["retailer_key"]),
    "no_external_evidence": ("evidence", "manual", ["address"]),
}


def _named(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def empty(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def normalize_store(df: DataFrame) -> DataFrame:
    """Store records with parts filled from the full address, normalised fields, notes on what was filled and missing-field issues."""
    parsed = geo.parse_address(F.col("full_address"))
    d = df.withColumn("_p", parsed)
    notes = _named({f"{c}_from_address": empty(c) & F.col(f"_p.{p}").isNotNull() for c, p in (("address", "street"), ("city", "city"), ("state", "state"), ("zip_code", "zip"))})
    fill = lambda c, p: F.when(empty(c), F.col(f"_p.{p}")).otherwise(F.col(c))
    d = d.withColumn("notes", notes).withColumns(
        {"address": geo.title_dir(fill("address", "street")), "city": geo.norm_city(fill("city", "city")), "state": geo.norm_state(fill("state", "state")), "zip_code": geo.norm_zip(fill("zip_code", "zip"))}
    )
    d = d.withColumn("full_address", geo.compose_address(F.col("address"), F.col("city"), F.col("state"), F.col("zip_code")))
    d = d.withColumn("retailer_key", F.coalesce("retailer_key", geo.retailer_slug(F.col("retailer"))))
    return d.withColumn("issues", _named({f"missing_{c}": empty(c) for c in REQUIRED})).drop("_p")


def retailer_key(c: Column, alias: dict[str, str], contains: list[tuple[str, str]], suffixes: tuple[str, ...] = (" delivery", " express", " marketplace")) -> Column:
    """Alias as written, alias without case, the same without a delivery suffix, the first declared part that is contained, else the slug."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    lower = {k.lower(): v for k, v in alias.items()}
    low = F.lower(F.trim(c))
    bare = low
    for s in reversed(suffixes):
        bare = F.when(F.endswith(low, F.lit(s)), F.regexp_replace(low, f"{s}$", "")).otherwise(bare)
    part = F.lit(None).cast("string")
    for p, k in reversed(contains):
        part = F.when(F.contains(low, F.lit(p)), F.lit(k)).otherwise(part)
    return F.coalesce(F.try_element_at(table(alias), c), F.try_element_at(table(lower), low), F.try_element_at(table(lower), bare), part, geo.retailer_slug(c))


def display_retailer(c: Column, alias: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in alias.items() for x in kv]), c), c)


def retailer_token(c: Column) -> Column:
    s = F.replace(F.replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit("")), F.lit("-"), F.lit(" "))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def canonical_retailer(c: Column, types: dict[str, str] = {"supercenter": "Supercenter", "neighborhood market": "Neighborhood Market", "fuel": "Fuel Station", "pharmacy": "Pharmacy"}) -> Column:
    """(retailer token without its store type, store type)."""
    token = retailer_token(c)
    kind, bare = F.lit(None).cast("string"), token
    for word, name in types.items():
        has = F.endswith(token, F.lit(f" {word}"))
        kind, bare = F.when(has, F.lit(name)).otherwise(kind), F.when(has, F.regexp_replace(token, f" {word}$", "")).otherwise(bare)
    return F.struct(bare.alias("retailer"), kind.alias("store_type"))


#: What follows the retailer's name, and the type of store it means.
VARIANTS = {
    "walmart": {
        "supercenter": "Supercenter", "super center": "Supercenter", "neighborhood market": "Neighborhood Market", "neighborhood": "Neighborhood Market",
        "business center": "Business Center", "fuel center": "Fuel Center", "discount": "Discount",
    }
}


def normalize_retailer(raw: Column, raw_type: Column, names: dict[str, str], variants: dict[str, dict[str, str]] = VARIANTS) -> Column:
    """(retailer, store_type, notes): a name by its token from names, else a retailer's variant, else title case; a variant's type goes before raw_type.

    notes say what was changed. Null names stay null and keep their type.
    """
    raw, raw_type = F.nullif(F.trim(raw), F.lit("")), geo.title_dir(F.nullif(F.trim(raw_type), F.lit("")))
    token = retailer_token(raw)
    pairs = {**{t: (n, None) for t, n in names.items()}, **{f"{r} {end}": (r.title(), kind) for r, ends in variants.items() for end, kind in ends.items()}}
    table = F.create_map(*[x for t, (n, kind) in pairs.items() for x in (F.lit(t), F.struct(F.lit(n).alias("n"), F.lit(kind).cast("string").alias("k")))])
    known = F.try_element_at(table, token)
    shown = F.coalesce(known["n"], geo.title_dir(raw))
    notes = _when_notes(
        (known.isNotNull(), F.concat(F.lit("retailer canonicalized: "), raw, F.lit(" -> "), known["n"])),
        (known.isNull() & (shown != raw), F.concat(F.lit("retailer normalized: "), raw, F.lit(" -> "), shown)),
        (known["k"].isNotNull(), F.concat(F.lit("store_type inferred from retailer variant: "), known["k"])),
        (known["k"] != raw_type, F.concat(F.lit("store_type overridden by retailer variant: "), raw_type, F.lit(" -> "), known["k"])),
    )
    return F.struct(shown.alias("retailer"), F.coalesce(known["k"], raw_type).alias("store_type"), notes.alias("notes"))


def _when_notes(*notes: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(holds, text) for holds, text in notes]))


def classify_geocode(stores: DataFrame, zips: DataFrame, km: float = 50.0) -> DataFrame:
    """stores with verdict outside_us, wrong_city or ok, and km_from_zip."""
    z = zips.select("zip_code", F.col("latitude").alias("zlat"), F.col("longitude").alias("zlon"))
    d = stores.join(z, "zip_code", "left").withColumn("km_from_zip", F.floor(haversine(F.col("latitude"), F.col("longitude"), F.col("zlat"), F.col("zlon"), geo.KILOMETRES) * 10 + 0.5) / 10)
    verdict = F.when(~is_us(F.col("latitude"), F.col("longitude")), "outside_us").when(F.col("km_from_zip") > km, "wrong_city").otherwise("ok")
    return d.withColumn("verdict", verdict).drop("zlat", "zlon")


def attach_geocode(stores: DataFrame, cache: DataFrame) -> DataFrame:
    """stores with the cached point (query_key, glat, glon) of their address, as written or cleaned."""
    one = cache.groupBy("query_key").agg(F.min(F.struct("glat", "glon")).alias("g"))
    a, b = (one.select(F.col("query_key").alias(f"_k{i}"), F.col("g").alias(f"_g{i}")) for i in (1, 2))
    d = stores.join(a, F.lower("full_address") == F.col("_k1"), "left").join(b, geo.geocode_key(F.col("full_address")) == F.col("_k2"), "left")
    g = F.coalesce("_g1", "_g2")
    return d.withColumns({"glat": g["glat"], "glon": g["glon"]}).drop("_k1", "_g1", "_k2", "_g2")


def accept_geocode(stores: DataFrame, candidates: DataFrame, zips: DataFrame, km: float = 50.0) -> DataFrame:
    """By store: the first candidate (store_id, provider_rank, clat, clon) within km of the zip's centre, else status failed."""
    z = zips.select("zip_code", F.col("latitude").alias("zlat"), F.col("longitude").alias("zlon"))
    ok = candidates.join(stores.select("store_id", "zip_code"), "store_id").join(z, "zip_code")
    ok = ok.where(haversine(F.col("clat"), F.col("clon"), F.col("zlat"), F.col("zlon"), geo.KILOMETRES) <= km)
    best = ok.groupBy("store_id").agg(F.min_by(F.struct("clat", "clon"), "provider_rank").alias("b"))
    d = stores.select("store_id").join(best, "store_id", "left")
    return d.select("store_id", "b.clat", "b.clon", F.when(F.col("b").isNull(), "failed").otherwise("accepted").alias("status"))


def _apart(d: DataFrame, metres: float) -> DataFrame:
    """d without the rows of a retailer that lie within metres of a kept one, in the order of (_rank, id); rows without a point stay.

    Pairs meet by cells; those that no undecided or kept row precedes are kept, their later neighbours go, until no pair is left.
    """
    spark, path = d.sparkSession, scratch_path(d.sparkSession, "apart")
    d.write.parquet(f"{path}/rows")  # once, so that all rounds see the same
    d = spark.read.parquet(f"{path}/rows")
    pointed = F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False))
    # of rows at one point only the first can stay
    p = first_by(d.where(pointed), ["retailer_key", "latitude", "longitude"], [F.col("_rank"), F.col("id")])
    key, step = F.struct("retailer_key", "_rank", "id", "latitude", "longitude"), geo.cell_size(math.degrees(2 * metres / geo.METRES))
    k = p.select(key.alias("k"))
    around = geo.cells_around(F.col("k.latitude"), F.col("k.longitude"), F.lit(float(metres)), step, geo.METRES)
    x = k.select(F.col("k").alias("a"), F.explode(around).alias("c"))
    y = k.select(F.col("k").alias("b"), geo.cell(F.col("k.latitude"), F.col("k.longitude"), step).alias("c"))
    far = haversine(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"), geo.METRES)
    pairs = x.join(y, (x.c == y.c) & F.col("a.retailer_key").eqNullSafe(F.col("b.retailer_key"))).where((F.col("a") < F.col("b")) & (far < metres)).select("a", "b")
    gone, i = None, 0
    while True:
        pairs.write.parquet(f"{path}/pairs{i}")
        pairs = spark.read.parquet(f"{path}/pairs{i}")
        if pairs.isEmpty():
            break
        kept = pairs.select("a").distinct().join(pairs.select(F.col("b").alias("later")).distinct(), F.col("a").eqNullSafe(F.col("later")), "left_anti")
        pairs.join(kept.select(F.col("a").alias("first")), F.col("a").eqNullSafe(F.col("first"))).select(F.col("b").alias("out")).distinct().write.parquet(f"{path}/out{i}")
        out = spark.read.parquet(f"{path}/out{i}")
        gone = out if gone is None else gone.union(out)
        pairs = pairs.join(out, F.col("a").eqNullSafe(F.col("out")), "left_anti").join(out, F.col("b").eqNullSafe(F.col("out")), "left_anti")
        i += 1
    if gone is not None:
        p = p.join(gone, key.eqNullSafe(F.col("out")), "left_anti")
    return p.unionByName(d.where(~pointed))


def dedup_osm(rows: DataFrame, metres: float = 500.0) -> DataFrame:
    """Map stores without doubles: node under a way of the same address; same full address; same street number elsewhere; within metres of one kept; one per zip.

    Input (retailer_key, type, id, no, street, zip_code, full_address, latitude, longitude). The distance pass takes ways first, then
    ids, over all stores of a retailer that have a point; stores without one stay.
    """
    rank = F.when(F.col("type") == "way", 0).when(F.col("type") == "node", 1).otherwise(2)
    d = rows.withColumn("_rank", rank)
    addressed = F.col("no").isNotNull() & F.col("street").isNotNull()
    for keys in (["retailer_key", "zip_code", "no", "street"], ["retailer_key", "full_address"], ["retailer_key", "no", "street"]):
        d = first_by(d.where(addressed), keys, [F.col("_rank"), F.col("id")]).unionByName(d.where(~addressed))
    d = _apart(d, metres)
    d = d.withColumn("_has", F.max(addressed.cast("int")).over(Window.partitionBy("retailer_key", "zip_code"))).where(addressed | (F.col("_has") == 0))
    return first_by(d, ["retailer_key", "zip_code"], [(~addressed).cast("int"), F.col("_rank"), F.col("id")]).drop("_rank", "_has")


def dedup_loose(rows: DataFrame) -> DataFrame:
    """One row per (retailer, zip), then one per (retailer, address), smallest id first."""
    d = first_by(rows, ["retailer_key", "zip_code"], [F.col("id")])
    return first_by(d.where("address is not null"), ["retailer_key", "address"], [F.col("id")]).unionByName(d.where("address is null"))


def neutralize(stores: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Stores listed in ids (store_id), without a retailer key or outside the US lose their point."""
    listed = stores.withColumn("_l", F.lit(False))
    if ids is not None:
        listed = stores.join(ids.select("store_id").distinct().withColumn("_l", F.lit(True)), "store_id", "left")
    bad = F.coalesce("_l", F.lit(False)) | F.col("retailer_key").isNull() | (valid_coord(F.col("latitude"), F.col("longitude")) & ~is_us(F.col("latitude"), F.col("longitude")))
    clear = lambda c: F.when(~bad, F.col(c))
    return listed.withColumns({"geocode_confidence": F.when(bad, "zip_centroid").otherwise(F.col("geocode_confidence")), "latitude": clear("latitude"), "longitude": clear("longitude")}).drop("_l")


def match_score(a: str = "", b: str = "x_") -> Column:
    """Weighted likeness of two store records whose columns differ by a prefix."""
    x, y = (lambda c: F.col(a + c)), (lambda c: F.col(b + c))
    near = geo.geo_score(haversine(x("latitude"), x("longitude"), y("latitude"), y("longitude"), geo.METRES))
    return (
        geo.token_prefix_sim(x("address"), y("address")) * 0.35 + geo.token_jaccard(x("name"), y("name")) * 0.2 + (F.lower(x("city")) == F.lower(y("city"))).cast("double") * 0.15
        + (F.upper(x("state")) == F.upper(y("state"))).cast("double") * 0.15 + geo.zip_score(x("zip_code"), y("zip_code")) * 0.1 + near * 0.05
    )


def entity_pairs(internal: DataFrame, external: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Pairs (external's columns, internal's with x_) that may reach a match_score() of threshold: within retailer and three digits of the zip, addresses with a rare word alike.

    A score of threshold asks for a likeness of addresses of (threshold - .65) / .35 at least, since all else gives .65; so of the n words of an internal address that many
    times n have a partner, and of any n + 1 without as many, one has. The internal side goes by its rarest words, as many as that, the external side by all of its words.
    Below a threshold of .65 addresses decide nothing, and all pairs of a retailer and three digits are made; rows without an address can't reach more.
    """
    block = ["retailer_key", "_zip3"]
    external = external.withColumn("_zip3", F.substring("zip_code", 1, 3))
    x = internal.select(*[F.col(c).alias(f"x_{c}") for c in internal.columns], F.col("retailer_key"), F.substring("zip_code", 1, 3).alias("_zip3"))
    least = (threshold - 0.65) / 0.35
    if least <= 0:
        return external.join(x, block).drop("_zip3")
    keys = F.array_distinct(F.flatten(F.transform(geo.address_words(F.col("address")), geo.word_keys)))
    external = external.withColumn("_keys", keys)
    seen = external.select(*block, F.explode("_keys").alias("_key")).groupBy(*block, "_key").agg(F.count("*").alias("_n"))
    words = x.select("x_id", *block, F.posexplode(geo.address_words(F.col("x_address"))).alias("_at", "_word"))
    words = words.select("x_id", *block, "_at", F.explode(geo.word_keys(F.col("_word"))).alias("_key")).join(seen, [*block, "_key"], "left")
    words = words.groupBy("x_id", *block, "_at").agg(F.collect_set("_key").alias("_k"), F.sum(F.coalesce("_n", F.lit(0))).alias("_n"))
    rare = words.groupBy("x_id").agg(F.array_sort(F.collect_list(F.struct("_n", "_at", "_k"))).alias("_w"))  # one address's words
    n = F.size("_w")
    take = F.greatest(n - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1, F.lit(0))
    rare = rare.select("x_id", F.array_distinct(F.flatten(F.transform(F.slice("_w", F.lit(1), take), lambda w: w["_k"]))).alias("x_keys"))
    left = x.join(rare, "x_id").withColumn("_key", F.explode("x_keys"))
    pairs = external.withColumn("_key", F.explode("_keys")).join(left, [*block, "_key"])
    first = F.element_at(F.array_intersect("x_keys", "_keys"), 1)  # each pair once
    return pairs.where(F.col("_key") == first).drop("_key", "_keys", "x_keys", "_zip3")


def resolve_entities(internal: DataFrame, external: DataFrame, threshold: float = 0.82) -> DataFrame:
    """internal with the external stores that are not the same as one of them, blocked by retailer and first three digits of the zip."""
    internal = first_by(internal, ["id"], [F.col("address")])
    external = first_by(external, ["retailer_key", "address", "zip_code"], [F.col("id")])
    same = entity_pairs(internal, external, threshold).where(match_score() >= threshold).select("id").distinct()
    return internal.withColumn("source", F.lit("internal")).unionByName(external.join(same, "id", "left_anti").withColumn("source", F.lit("external")))


def in_order(resolved: DataFrame, lat: Column, lon: Column, locator_rank: Column | None = None) -> DataFrame:
    """By retailer: resolved stores with their miles from a point and their place by (miles, rank of the locator, id); without a point last."""
    miles = F.floor(haversine(lat, lon, F.col("latitude"), F.col("longitude")) * 100 + 0.5) / 100
    rank = F.when(F.col("source") == "internal", 0).otherwise(1) if locator_rank is None else locator_rank
    d = resolved.withColumn("miles", F.when(valid_coord(F.col("latitude"), F.col("longitude")), miles)).withColumn("_r", rank)
    order = Window.partitionBy("retailer_key").orderBy(F.coalesce("miles", F.lit(999_999.0)), "_r", "id")
    return d.withColumn("place", F.row_number().over(order)).drop("_r")


def promotion_frames(gated: DataFrame, key: str = "store_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows with a status (promote): (those to write, failures with their reason, updates of the staging rows)."""
    done = gated.where("status = 'SUCCESS'")
    failed = gated.where("status not in ('SUCCESS', 'NOT_TARGET', 'ALREADY_PROMOTED')").select(key, F.col("status").alias("reason"))
    updates = gated.where("status <> 'NOT_TARGET'").select(key, (F.col("promoted") | (F.col("status") == "SUCCESS")).alias("promoted"), F.when(F.col("status") == "SUCCESS", "promoted").otherwise("kept").alias("action"))
    return done, failed, updates


def stage(batch: DataFrame, staged: DataFrame) -> DataFrame:
    """New records of a batch (retailer, store_number not staged yet, first by seq) with the reasons for a manual review."""
    new = first_by(batch, ["retailer", "store_number"], [F.col("seq")]).join(staged.select("retailer", "store_number"), ["retailer", "store_number"], "left_anti")
    return new.withColumn("review_reasons", _named({f"missing_{c}": empty(c) for c in ("retailer", "store_number", "address", "city", "state", "zip_code")}))


def promote(rows: DataFrame, targets: list[str]) -> DataFrame:
    """rows (retailer_key, promoted, review_status, address, issues, latitude, longitude) with status, the first gate that applies."""
    gate = (
        F.when(~F.col("retailer_key").isin(targets), "NOT_TARGET").when(F.col("promoted"), "ALREADY_PROMOTED").when(F.col("review_status").isin("pending", "deleted"), "REVIEW_PENDING")
        .when(empty("address"), "MISSING_ADDRESS").when(F.size("issues") > 0, "VALIDATION_FAILED").when(~valid_coord(F.col("latitude"), F.col("longitude")), "GEOCODE_FAILED").otherwise("SUCCESS")
    )
    return rows.withColumn("status", gate)


def verify(stores: DataFrame, zips: DataFrame, far_km: float = 50.0) -> DataFrame:
    """stores with issues, verified, confidence and where the issues go (route auto, llm, manual or none); zips may have a state."""
    zip_state = F.col("state") if "state" in zips.columns else F.lit(None).cast("string")
    z = zips.select("zip_code", F.col("latitude").alias("zlat"), F.col("longitude").alias("zlon"), F.upper(zip_state).alias("zstate"))
    d = stores.join(z, "zip_code", "left")
    lat, lon = F.col("latitude"), F.col("longitude")
    there = lat.isNotNull() & lon.isNotNull()
    km = haversine(lat, lon, F.col("zlat"), F.col("zlon"), geo.KILOMETRES)
    found = _named(
        {
            **{f"missing_{c}": empty(c) for c in REQUIRED[:5]},
            "missing_coordinates": ~there,
            "invalid_coordinates": there & ~valid_coord(lat, lon),
            "outside_us": valid_coord(lat, lon) & ~is_us(lat, lon),
            "city_not_in_address": ~empty("city") & ~empty("full_address") & ~F.contains(F.lower("full_address"), F.lower("city")),
            "zip_state_mismatch": ~empty("state") & (F.upper(F.trim("state")) != F.col("zstate")),
            "address_far_from_zip": valid_coord(lat, lon) & (km > far_km),
            "retailer_key_mismatch": ~empty("retailer") & (F.col("retailer_key") != geo.retailer_slug(F.col("retailer"))),
        }
    )
    d = d.withColumn("issues", found).drop("zlat", "zlon", "zstate")
    return routed(d.withColumns({"verified": F.size("issues") == 0, "confidence": F.greatest(F.lit(0.1), F.lit(1.0) - F.size("issues") * 0.15)}))


def routed(df: DataFrame) -> DataFrame:
    """df with route: manual if any issue asks for it, else llm, else auto, else none."""
    route = F.create_map(*[F.lit(x) for k, v in ISSUES.items() for x in (k, v[1])])
    ways = F.transform("issues", lambda i: F.try_element_at(route, i))
    has = lambda w: F.array_contains(ways, w)
    return df.withColumn("route", F.when(has("manual"), "manual").when(has("llm"), "llm").when(has("auto"), "auto").otherwise("none"))


def external_evidence(stores: DataFrame, external: DataFrame, metres: float = 300.0, likeness: float = 0.7) -> DataFrame:
    """By store: whether an external store of the retailer and zip lies within metres or has a like address."""
    keys = F.transform(geo.address_words(F.col("address")), geo.word_keys)
    x = external.select("retailer_key", "zip_code", F.col("address").alias("xa"), F.col("latitude").alias("xlat"), F.col("longitude").alias("xlon"), F.array_distinct(F.flatten(keys)).alias("_xk"), F.size(keys).alias("_xn"))
    d = stores.withColumn("_k", keys).join(x, ["retailer_key", "zip_code"], "left")
    near = haversine(F.col("latitude"), F.col("longitude"), F.col("xlat"), F.col("xlon"), geo.METRES) <= metres
    # words without a key in common are worth nothing: only addresses with enough such words are compared in full
    some = F.size(F.filter("_k", lambda k: F.arrays_overlap(k, F.col("_xk"))))
    few = some < F.greatest(F.size("_k"), F.col("_xn")) * likeness - 1e-9
    like = F.coalesce(geo.token_prefix_sim(F.col("address"), F.col("xa")) >= likeness, F.lit(False))
    ok = F.when(F.coalesce(near, F.lit(False)), F.lit(True)).when(few, F.lit(False)).otherwise(like)
    return d.groupBy("store_id").agg(F.max(ok).alias("evidence"))


def combine(checks: DataFrame) -> DataFrame:
    """By store: verified in all checks, least confidence, distinct issues."""
    return checks.groupBy("store_id").agg(F.bool_and("verified").alias("verified"), F.min("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))).alias("issues"))


def repair(stores: DataFrame) -> DataFrame:
    """The automatic repairs: case, spaces, directions, kinds of streets written short, dots and commas that end a word, retailer key."""
    fix = {"address": geo.short_streets(geo.title_dir(F.regexp_replace(F.regexp_replace("address", r"\.(?!\d)|(?<!\d)\.", ""), r"[,\s]*,[,\s]*$|,(?=\s*,)", ""))), "city": geo.norm_city(F.col("city")), "state": geo.norm_state(F.col("state")), "zip_code": geo.norm_zip(F.col("zip_code"))}
    d = stores.withColumns(fix).withColumn("full_address", geo.compose_address(F.col("address"), F.col("city"), F.col("state"), F.col("zip_code")))
    return d.withColumn("retailer_key", F.coalesce(geo.retailer_slug(F.col("retailer")), "retailer_key"))


def verify_repair(stores: DataFrame, zips: DataFrame) -> DataFrame:
    """Stores verified, repaired and verified again: status verified or unresolved."""
    drop = ["issues", "verified", "confidence", "route"]
    again = verify(repair(stores), zips)
    return again.withColumn("status", F.when(F.col("verified"), "verified").otherwise("unresolved")).drop(*[c for c in drop if c not in again.columns])


def repair_confidence(repairs: DataFrame) -> DataFrame:
    """By store: weighted mean of the repairs' confidence, at most the overall one, within 0 and 1; repairs (store_id, weight, confidence, overall)."""
    g = repairs.groupBy("store_id").agg((F.sum(F.col("weight") * F.col("confidence")) / F.sum("weight")).alias("mean"), F.min("overall").alias("overall"))
    return g.select("store_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "mean", "overall")).alias("confidence"))


def validate_catalog(stores: DataFrame) -> DataFrame:
    """One row of totals of a catalog: ids, duplicates, missing coordinates, rows outside the US."""
    by_id = stores.groupBy("store_id").agg(F.count("*").alias("n"), F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("no_point"), F.count_if(valid_coord(F.col("latitude"), F.col("longitude")) & ~is_us(F.col("latitude"), F.col("longitude"))).alias("abroad"))
    return by_id.agg(
        F.sum("n").alias("total"), F.count_if(F.col("store_id").isNotNull()).alias("unique_ids"), F.coalesce(F.sum(F.when(F.col("store_id").isNull(), F.col("n"))), F.lit(0)).alias("missing_ids"),
        F.count_if((F.col("n") > 1) & F.col("store_id").isNotNull()).alias("duplicate_ids"), F.sum("no_point").alias("missing_coordinates"), F.sum("abroad").alias("outside_us"),
    )


def _of_deals(candidates: DataFrame, place: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """(deal_id, c): each deal's candidates as place makes them of their fields, in order.

    candidates has a row a candidate, or a row a deal with a list of candidates: such lists are put in order where they are, not dealt out and gathered again.
    """
    if "candidates" in candidates.columns:
        return candidates.select("deal_id", F.array_sort(F.transform("candidates", lambda x: place(lambda f: x[f]))).alias("c"))
    return candidates.groupBy("deal_id").agg(F.array_sort(F.collect_list(place(F.col))).alias("c"))


def resolution_payload(candidates: DataFrame) -> DataFrame:
    """By deal: the payload of its nearest candidate with all candidate ids by distance; candidates (deal_id, store_id, latitude, longitude, distance_miles, stage) or (deal_id, candidates)."""
    g = _of_deals(candidates, lambda f: F.struct(*[f(n).alias(n) for n in ("distance_miles", "store_id", "latitude", "longitude", "stage")]))
    return g.select("deal_id", F.struct(F.col("c")[0]["store_id"].alias("store_id"), F.col("c")[0]["latitude"].alias("latitude"), F.col("c")[0]["longitude"].alias("longitude"), F.transform("c", lambda x: x["store_id"]).alias("candidate_store_ids"), F.col("c")[0]["stage"].alias("stage")).alias("payload"))


def candidate_buckets(candidates: DataFrame) -> DataFrame:
    """By deal: its own stores (id not null) and external ones (seq), each nearest first; candidates (deal_id, id, seq, distance_miles) or (deal_id, candidates)."""
    g = _of_deals(candidates, lambda f: F.struct(F.coalesce(f("distance_miles"), F.lit(999_999.0)).alias("m"), f("id").alias("i"), f("seq").alias("s")))
    of = lambda keep, field: F.transform(F.filter("c", keep), lambda x: x[field])
    return g.select("deal_id", of(lambda x: x["i"].isNotNull(), "i").alias("local"), of(lambda x: x["i"].isNull(), "s").alias("external"))


def merge_issues(*lists: Column) -> Column:
    """Issue names of several lists, each once, in order of first sight."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))


def dedup_candidates(rows: DataFrame) -> DataFrame:
    """Candidates of one deal: external ones (id null) once per composite key, local ones once per id, nearest first."""
    key = F.coalesce(F.col("id").cast("string"), F.concat_ws("|", "retailer_key", geo.address_key(F.col("address")), "zip_code"))
    return first_by(rows.withColumn("_key", key), ["deal_id", "_key"], [F.coalesce("distance_miles", F.lit(999_999.0)), F.col("seq")]).drop("_key")
