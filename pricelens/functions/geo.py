"""Column functions of places: distances, validity, addresses and store names."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MILES, METRES, KILOMETRES = 3958.8, 6_371_000.0, 6371.0
#: Boxes (south, north, west, east) of the 48 states, Hawaii, Alaska and Puerto Rico.
US_BOXES = [(24.0, 50.0, -125.0, -66.0), (18.5, 22.5, -161.0, -154.0), (51.0, 72.0, -180.0, -129.0), (17.5, 18.6, -67.5, -65.0)]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MILES) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # null where a point is: least() would skip it


def cell_size(degrees: float) -> float:
    """The least size of cells from degrees up that divides the circle."""
    return 360.0 / max(1, int(360 / degrees))


def cell(lat: Column, lon: Column, step: float) -> Column:
    """(ci, cj) of the cell that a point lies in; step is a cell_size."""
    return F.struct(F.floor(lat / step).alias("ci"), F.pmod(F.floor(lon / step), F.lit(round(360 / step))).alias("cj"))


def cells_around(lat: Column, lon: Column, reach: Column, step: float, radius: float = MILES) -> Column:
    """The cells that hold every point within reach (in radius' unit) of a point, over poles and the date line too."""
    up = F.degrees(F.least(F.greatest(reach, F.lit(0.0)), F.lit(math.pi * radius)) / radius) + 1e-6
    beside = F.when(F.abs(lat) + up >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(up)) / F.cos(F.radians(lat))))) + 1e-6)
    i = F.sequence(F.floor(F.greatest(lat - up, F.lit(-90.0)) / step), F.floor(F.least(lat + up, F.lit(90.0)) / step))
    j = F.sequence(F.floor((lon - beside) / step), F.floor((lon + beside) / step))
    j = F.array_distinct(F.transform(j, lambda x: F.pmod(x, F.lit(round(360 / step)))))
    return F.flatten(F.transform(i, lambda a: F.transform(j, lambda b: F.struct(a.alias("ci"), b.alias("cj")))))


def valid_coord(lat: Column, lon: Column) -> Column:
    """Finite, in range and not the null island."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(ok & ~((lat == 0) & (lon == 0)), F.lit(False))


def is_us(lat: Column, lon: Column, boxes: list[tuple[float, float, float, float]] = US_BOXES) -> Column:
    out = F.lit(False)
    for s, n, w, e in boxes:
        out = out | (lat.between(s, n) & lon.between(w, e))
    return F.coalesce(out, F.lit(False))


def zip_score(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when(F.substring(a, 1, 3) == F.substring(b, 1, 3), 0.5).otherwise(0.0)


def geo_score(metres: Column) -> Column:
    """Bands of nearness; null distances score zero."""
    return F.when(metres <= 25, 1.0).when(metres <= 75, 0.9).when(metres <= 150, 0.75).when(metres <= 300, 0.5).when(metres <= 1000, 0.2).otherwise(0.0)


def retailer_slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), r"#\s*\d+", "")
    # fixed values: what store names end in
    for suffix in (" store", " supermarket", " super market", " market", " grocery", " foods", " food", " pharmacy", " drug"):
        s = F.replace(s, F.lit(suffix), F.lit(""))
    return F.nullif(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(""))


def address_key(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    for p in (r"\bste\.?\s*#?\d+\b", r"\bunit\s*#?\d+\b", r"\bsuite\s*#?\d+\b"):
        s = F.regexp_replace(s, p, "")
    return F.regexp_replace(s, "^[, ]+|[, ]+$", "")


def title_dir(c: Column) -> Column:
    """Title case by runs of letters; two-letter directions in capitals; hyphens become spaces."""
    s = F.regexp_replace(F.trim(F.regexp_replace(c, "-", " ")), r"\s+", " ")
    runs = F.regexp_extract_all(s, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    s = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")
    for d in ("Nw", "Ne", "Sw", "Se"):
        s = F.regexp_replace(s, rf"\b{d}\b", d.upper())
    return s


def norm_state(c: Column) -> Column:
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def norm_zip(c: Column) -> Column:
    z = F.substring(F.regexp_replace(c, r"\D", ""), 1, 5)
    return F.when(F.length(z) == 5, z)


def norm_city(c: Column) -> Column:
    return F.nullif(title_dir(c), F.lit(""))


def parse_address(c: Column) -> Column:
    """(street, city, state, zip) of "street, city, ST 12345"."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    tail = F.try_element_at(parts, F.lit(-1))
    full = F.size(parts) >= 3
    return F.struct(
        F.when(full, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(1))), ", ")).otherwise(F.get(parts, F.lit(0))).alias("street"),
        F.when(full, F.try_element_at(parts, F.lit(-2))).alias("city"),
        F.nullif(F.upper(F.regexp_extract(tail, r"\b([A-Za-z]{2})\b(?:\s+\d{5}|$)", 1)), F.lit("")).alias("state"),
        F.nullif(F.regexp_extract(tail, r"(\d{5})(?:-\d{4})?\s*$", 1), F.lit("")).alias("zip"),
    )


def compose_address(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    e = lambda x: F.nullif(x, F.lit(""))
    return F.concat_ws(", ", e(street), e(city), e(F.concat_ws(" ", e(state), e(zip_code))))


def geocode_query(c: Column) -> Column:
    """An address as it is asked for: no suite, first of a house-number range, no dots."""
    s = F.regexp_replace(c, r"(?i)[, ]*\b(ste|suite|unit)\.?\s*#?\w+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^(\d+)-[A-Za-z0-9]+\b", "$1"), r"\.", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def geocode_key(c: Column) -> Column:
    return F.lower(geocode_query(c))


def store_name(retailer: Column, kind: Column, number: Column) -> Column:
    return F.concat_ws(" ", retailer, kind, F.concat(F.lit("#"), number))


def is_non_store(c: Column) -> Column:
    """Departments and services that are listed like stores."""
    # fixed values: departments
    words = "fuel|gas station|pharmacy|optical|vision|bakery|deli|liquor|tire|photo|clinic|car wash"
    return F.coalesce(F.lower(c).rlike(rf"\b({words})\b"), F.lit(False))


#: Road names as they are compared.
ROADS = [
    (r"\bus hwy\b|\bu\.?s\.? highway\b", "us highway"), (r"\bstate rd\b|\bsr\b", "state road"), (r"\bhwy\b", "highway"), (r"\bpkwy\b", "parkway"), (r"\bblvd\b", "boulevard"),
    (r"\bave\b", "avenue"), (r"\bst\b", "street"), (r"\brd\b", "road"), (r"\bdr\b", "drive"), (r"\bln\b", "lane"),
]


def highway_alias(c: Column) -> Column:
    s = F.lower(c)
    for p, to in ROADS:
        s = F.regexp_replace(s, p, to)
    return s


def token_jaccard(a: Column, b: Column) -> Column:
    words = lambda x: F.array_distinct(F.array_remove(F.split(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), " "), ""))
    union = F.size(F.array_union(words(a), words(b)))
    return F.when(union > 0, F.size(F.array_intersect(words(a), words(b))) / union).otherwise(0.0)


#: The states and the capital's district.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "district of columbia": "DC",
    "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME",
    "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR",
    "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}


def norm_state_alias(c: Column, names: dict[str, str] = STATES) -> Column:
    """Two-letter state for a name or code; names is the full map of names."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    s = F.lower(F.trim(c))
    return F.coalesce(F.try_element_at(table, s), F.when(F.length(s) == 2, F.upper(s)))


#: Directions and kinds of streets that count as the same word.
DIRECTIONS = {
    "n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w",
    "ne": "ne", "northeast": "ne", "nw": "nw", "northwest": "nw", "se": "se", "southeast": "se", "sw": "sw", "southwest": "sw",
}
STREETS = {
    "st": "st", "street": "st", "ave": "ave", "avenue": "ave", "blvd": "blvd", "boulevard": "blvd", "rd": "rd", "road": "rd", "dr": "dr", "drive": "dr", "ln": "ln", "lane": "ln",
    "pkwy": "pkwy", "parkway": "pkwy", "hwy": "hwy", "highway": "hwy", "pl": "pl", "place": "pl", "ct": "ct", "court": "ct", "cir": "cir", "circle": "cir", "ter": "ter", "terrace": "ter",
    "way": "way", "loop": "loop", "trail": "trl", "trl": "trl", "expy": "expy", "expressway": "expy",
}


def short_streets(c: Column) -> Column:
    """An address in title case whose last word, before a comma or the end, is written short if it is a kind of street."""
    for word, short in STREETS.items():
        if word != short:
            c = F.regexp_replace(c, rf"(?i)(?<=\S )\b{word}(?=$|,)", short.capitalize())
    return c


def address_words(c: Column) -> Column:
    """The words that token_prefix_sim() compares, in order."""
    return F.array_remove(F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " "), "")


def _alias() -> Column:
    return F.create_map(*[F.lit(x) for kv in (DIRECTIONS | STREETS).items() for x in kv])


def word_keys(word: Column) -> Column:
    """One or two keys of a word: words that token_prefix_sim() counts as alike share one, their first two characters or those of their short form."""
    return F.array_distinct(F.array(F.substring(word, 1, 2), F.substring(F.coalesce(F.try_element_at(_alias(), word), word), 1, 2)))


def token_prefix_sim(a: Column, b: Column) -> Column:
    """Share of a's words that find a word of b, each at most once: equal words count 1, prefixes the ratio of their lengths.

    Names of one direction or of one kind of street are equal; words of one character are no prefixes. Words are matched in order,
    each with the best free partner, the first of equally good ones.
    """
    wa, wb = address_words(a), address_words(b)
    alias = _alias()

    def worth(x: Column, y: Column) -> Column:
        short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
        same = (x == y) | F.coalesce(F.try_element_at(alias, x) == F.try_element_at(alias, y), F.lit(False))
        return F.when(same, 1.0).when((short > 1) & (F.startswith(x, y) | F.startswith(y, x)), short / long).otherwise(0.0)

    def step(acc: Column, x: Column) -> Column:
        options = F.transform(acc["free"], lambda y, i: F.struct(worth(x, y).alias("w"), (-i).alias("i"), y.alias("y")))
        best = F.array_max(options)
        used = F.coalesce(best["w"], F.lit(0.0)) > 0
        free = F.when(used, F.filter(acc["free"], lambda y, i: i != -best["i"])).otherwise(acc["free"])
        return F.struct((acc["sum"] + F.when(used, best["w"]).otherwise(0.0)).alias("sum"), free.alias("free"))

    total = F.aggregate(wa, F.struct(F.lit(0.0).alias("sum"), wb.alias("free")), step, lambda acc: acc["sum"])
    return F.when(F.greatest(F.size(wa), F.size(wb)) > 0, total / F.greatest(F.size(wa), F.size(wb))).otherwise(0.0)


def sequence_ratio():
    """An Arrow UDF: matched share of two strings by longest common blocks (no built-in function has it); null counts as empty."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        pairs, seen = list(zip(a.fillna(""), b.fillna(""), strict=True)), {}
        # the matcher keeps an index of its second text: pairs are taken by it, equal pairs once
        matcher, of = SequenceMatcher(None), None
        for x, y in sorted(set(pairs), key=lambda p: p[1]):
            if y != of:
                matcher.set_seq2(y)
                of = y
            matcher.set_seq1(x)
            seen[x, y] = matcher.ratio()
        return pd.Series([seen[p] for p in pairs], dtype="float64")

    return ratio


def _letters_shared(a: Column, b: Column) -> Column:
    """How many letters two texts have in common, whatever their order: as many of each as the text with fewer has."""
    chars = lambda c: F.array_sort(F.array_remove(F.split(c, ""), ""))
    numbered = lambda x: F.transform(x, lambda y, i: F.concat(y, (i - F.array_position(x, y)).cast("string")))
    return F.size(F.array_intersect(numbered(chars(a)), numbered(chars(b))))


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of sequence_ratio() without Python: by the letters that the texts share in any order; null counts as empty."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    both = F.length(a) + F.length(b)
    by_length = 2.0 * F.least(F.length(a), F.length(b)) / both
    return F.when(both == 0, 1.0).otherwise(F.least(by_length, 2.0 * _letters_shared(a, b) / both))


def ratio_at_least(df: DataFrame, a: str, b: str, least: float, name: str = "ratio") -> DataFrame:
    """The rows of df whose sequence_ratio() of columns a and b is at least least, with it as name.

    Equal texts have 1, rows whose bound by length, then by letters, lies below least are gone before the matcher, and each distinct pair of texts is matched once.
    """
    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    by_length = 2 * F.least(F.length(x), F.length(y)) >= F.lit(least) * (F.length(x) + F.length(y)) - 1e-9
    left = df.where(by_length).where(ratio_bound(x, y) >= least - 1e-9).withColumns({"_x": x, "_y": y})
    pairs = left.where("_x <> _y").select("_x", "_y").distinct().withColumn(name, sequence_ratio()(F.col("_x"), F.col("_y"))).where(F.col(name) >= least)
    unlike = left.where("_x <> _y").join(pairs, ["_x", "_y"])
    alike = left.where("_x = _y").withColumn(name, F.lit(1.0))
    return alike.select(*df.columns, name).unionByName(unlike.select(*df.columns, name))
