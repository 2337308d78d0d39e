"""Column functions of product identity: names, brands, sizes and match keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A small default brand list; a full one is a parameter.
BRANDS = """Kellogg's|Quaker|Cheerios|Oreo|Coca-Cola|Pepsi|Lay's|Doritos|Pringles|Nabisco|Ritz|Goldfish|Hershey's|Reese's|Snickers|Nestle|Gatorade|Red Bull|
Monster|Tropicana|Minute Maid|Heinz|Kraft|Campbell's|Barilla|Chobani|Yoplait|Dannon|Tide|Dove|V8|C4|All""".replace("\n", "").split("|")

#: What a name loses, as alternatives of one pattern.
FILLER = [
    r"\bfamily size\b", r"\bjumbo size\b", r"\bvalue size\b", r"\bking size\b", r"\bsnack size\b", r"\bparty size\b", r"\bsuper size\b", r"\bbulk size\b",
    r"\(\d+\s*(?:box|boxes|pack|pk)\)", r"\bpack of \d+\b", r"\b\d+\s*(?:count|ct|pk|pack)\b", r"\bbreakfast cereal\b", r"\bkids cereal\b", r"\bfamily breakfast\b",
    r"\bcereal\b", r"\bgood source of fiber\b", r"\bhigh protein\b", r"\bhigh fiber\b", r"\bfat free\b", r"\blow fat\b", r"\bsugar free\b",
    r"\bwhole grain[s]?\b", r"\bwhole grains[^,]*", r"\bgluten.?free\b", r"\bnatural\b", r"\boriginal\b", r"\bclassic\b", r"\breduced fat\b", r"\breduced sodium\b",
    r"\blow sodium\b", r"\bready to eat\b", r"\bpure\b", r"\brefrigerated\b", r"\d+(?:\.\d+)?\s*fluid\s*ounce[s]?\b", r"\bhypoallergenic\b", r"\bsensitive skin\b",
    r"\bno sugar added\b", r"\blow calorie\b", r"\blow-calorie\b", r"\bvegan\b", r"\borganic\b", r"\bshelf stable\b", r"\bextended shelf life\b",
    r"\b\d{3,4}\b(?!\s*(?:oz|lb|g|ml|fl|count|ct|pk|pack|liter|gram))", r"\bbox\b", r"\bbag\b", r"\bcan\b", r"\bjar\b", r"\bbottle\b", r"\bpouch\b", r"\bcarton\b",
    r"\bcontainer\b", r"\bcanister\b", r"\btub\b", r"\bwrap\b", r"\btin\b", r"[-–]\s*\d+(?:\.\d+)?\s*(?:oz|lb|g|ml|fl\.?\s*oz)\b",
    r"\d+(?:\.\d+)?\s*(?:oz|lb|g|ml|fl\.?\s*oz|ounce|pound|gram|liter)\b",
]
#: Words that no name ends in; brands whose words may come in any order.
STOPWORDS = "with|and|or|in|of|for|the|a|an"
SORTABLE = ["cheerios", "eggo", "oreo", "wheaties", "trix", "kix", "chex", "clif", "rxbar"]
#: Ounces in a unit, singular forms only.
OUNCES = {"oz": 1.0, "floz": 1.0, "g": 0.035274, "gram": 0.035274, "lb": 16.0, "pound": 16.0, "ml": 0.033814, "l": 33.814, "liter": 33.814}
MIN_OUNCES = 1.5


def _lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def norm_apos(c: Column) -> Column:
    return F.translate(c, "‘’", "''")


def strip_tm(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[™®]+$", ""))


def truncate_bulk(c: Column) -> Column:
    """Cuts at a bar, at the first comma if few words stand before and a long text after it, and at a double dash."""

    def comma(s: Column) -> Column:
        first = F.trim(F.get(F.split(s, ","), F.lit(0)))
        rest = F.trim(F.regexp_replace(s, "^[^,]*,", ""))
        words = F.size(F.array_remove(F.split(first, r"\s+"), ""))
        return F.when(s.contains(",") & (words <= 8) & (F.length(rest) > 20), first).otherwise(s)

    return F.trim(F.get(F.split(_let(F.trim(F.get(F.split(c, r"\|"), F.lit(0))), comma), " -- "), F.lit(0)))


def extract_brand(name: Column, brands: list[str] = BRANDS) -> Column:
    """The longest brand that starts the name, else one that starts a later " - " segment; lower case, null if none.

    Brands are found through a map from their first two letters, so a long list costs a lookup and a few comparisons.
    """
    by_two: dict[str, list[str]] = {}
    for b in sorted({b.lower() for b in brands}, key=lambda b: (-len(b), b)):
        by_two.setdefault(b[:2], []).append(b)
    table = F.create_map(*[x for k, v in by_two.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    lower = F.lower(F.trim(norm_apos(name)))
    starting = lambda s: F.get(F.filter(F.coalesce(F.try_element_at(table, F.substring(s, 1, 2)), F.array()), lambda b: F.startswith(s, b)), F.lit(0))
    later = F.transform(F.slice(F.split(lower, " - "), 2, 1000), lambda s: starting(strip_tm(s)))
    return F.coalesce(starting(lower), F.get(F.filter(later, lambda b: b.isNotNull()), F.lit(0)))


def strip_filler(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)" + "|".join(FILLER), " ")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical_name(name: Column, brand: Column) -> Column:
    """The comparable form of a product name: no brand, sizes, packaging or punctuation; brand if nothing is left."""

    def start(s: Column) -> Column:
        own = brand.isNotNull() & F.startswith(s, brand)
        return F.when(own, F.regexp_replace(F.substr(s, F.length(brand) + 1), "^[ ,-]+", "")).otherwise(s)

    def segments(s: Column) -> Column:
        parts = F.filter(F.split(s, " - "), lambda p: ~F.startswith(strip_tm(p), brand))
        return F.when(brand.isNotNull() & s.contains(" - "), F.regexp_replace(F.array_join(parts, " "), "^[ -]+|[ -]+$", "")).otherwise(s)

    def plain(s: Column) -> Column:
        s = F.regexp_replace(strip_filler(s), r"[®™'\-–/\\|()\[\]{}]", " ")
        s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(\d)%", "$1pct"), r"[^a-z0-9\s]", ""), r"(\d)pct", "$1%")
        s = F.trim(F.regexp_replace(s, r"\s+", " "))
        s = F.trim(F.regexp_replace(s, rf"\b({STOPWORDS})\s*$", ""))
        return F.trim(F.regexp_replace(s, rf"^({STOPWORDS})\b\s*", ""))

    def ordered(s: Column) -> Column:
        words = F.split(s, " ")
        return F.when((F.size(words) <= 4) & F.arrays_overlap(words, F.array(*map(F.lit, SORTABLE))), F.array_join(F.array_sort(words), " ")).otherwise(s)

    s = _let(truncate_bulk(F.trim(F.lower(norm_apos(name)))), start)
    s = _let(plain(_let(s, segments)), lambda x: F.when((x == "") & brand.isNotNull(), brand).otherwise(x))
    return _let(s, ordered)


def to_oz(amount: Column, unit: Column) -> Column:
    """Ounces, two places; null for an unknown unit."""
    u = F.regexp_replace(F.lower(unit), r"[ .]", "")
    return F.floor(amount * F.try_element_at(_lit_map(OUNCES), u) * 100 + 0.5) / 100


def size_oz(amount: Column, unit: Column, name: Column) -> Column:
    """The size column's ounces if large enough, else the largest size in the name, else the column's."""
    own = to_oz(amount, unit)
    pattern = F.lit(r"(?i)(\d+(?:\.\d+)?)\s*(oz|fl\.?\s*oz|g|gram|lb|pound|ml|liter)\b")
    pairs = F.arrays_zip(F.regexp_extract_all(name, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(name, pattern, F.lit(2)).alias("u"))
    sizes = F.filter(F.transform(pairs, lambda p: to_oz(p["a"].cast("double"), p["u"])), lambda x: x >= MIN_OUNCES)
    return F.when(own >= MIN_OUNCES, own).otherwise(F.coalesce(F.array_max(sizes), own))


def match_key(brand: Column, canonical: Column, oz: Column) -> tuple[Column, Column]:
    """(key, confidence)."""
    has = lambda c: c.isNotNull() & (c != "")
    size = oz.isNotNull() & (oz != 0)
    key = (
        F.when(has(brand) & has(canonical) & size, F.concat_ws("|", brand, canonical, oz.cast("string")))
        .when(has(brand) & has(canonical), F.concat_ws("|", brand, canonical, F.lit("no_size")))
        .when(has(canonical) & size, F.concat_ws("|", F.lit("unknown_brand"), canonical, oz.cast("string")))
    )
    sure = F.when(has(brand) & has(canonical) & size, "high").when(has(brand) & has(canonical), "medium").when(has(canonical) & size, "low").otherwise("none")
    return key, sure


def match_key_v1(brand: Column, canonical: Column, amount: Column, null_token: str = "no_size") -> Column:
    return F.concat_ws("|", F.coalesce(brand, F.lit("")), F.coalesce(canonical, F.lit("")), F.coalesce(amount.cast("string"), F.lit(null_token)))


def signature(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), r"\s+", " "))


def curated_name(df: DataFrame, raw: str, canonical: str, dictionary: DataFrame) -> DataFrame:
    """df with column curated: the dictionary's name for the raw name, else for the canonical one; high confidence only."""
    d = dictionary.where("confidence = 'high'").groupBy("normalized_signature").agg(F.min("canonical_name").alias("_name"))
    one, two = (d.select(F.col("normalized_signature").alias(f"_s{i}"), F.col("_name").alias(f"_n{i}")) for i in (1, 2))
    out = df.join(one, signature(F.col(raw)) == F.col("_s1"), "left").join(two, signature(F.col(canonical)) == F.col("_s2"), "left")
    return out.withColumn("curated", F.coalesce("_n1", "_n2")).drop("_s1", "_n1", "_s2", "_n2")


def key_variants(key: Column) -> Column:
    """The forms of a legacy key in order: size as written, with and without decimals, no_size; each with brand as written and lower."""
    brand, canonical, size = (F.regexp_extract(key, r"^([^|]*)\|(.*)\|([^|]*)$", i) for i in (1, 2, 3))
    n = size.try_cast("double")
    whole = n == F.floor(n)
    sizes = F.array(size, F.when(whole, F.format_string("%.1f", n)), F.when(whole, F.floor(n).cast("string")).otherwise(F.when(n.isNotNull(), n.cast("string"))), F.when(size != "no_size", "no_size"))
    sizes = F.array_distinct(F.array_compact(sizes))
    brands = F.array_distinct(F.array(brand, F.lower(brand)))
    forms = F.flatten(F.transform(sizes, lambda s: F.transform(brands, lambda b: F.concat_ws("|", b, canonical, s))))
    return F.when(F.regexp_like(key, F.lit(r"^v[23]\|")) | ~F.regexp_like(key, F.lit(r"^[^|]*\|.*\|[^|]*$")), F.array(key)).otherwise(forms)


def size_key(amount: Column, unit: Column) -> Column:
    """Half-unit size with its unit; null without amount or unit, and for counts of two to five."""
    u = F.lower(F.trim(unit))
    small = u.isin("ct", "count", "pk", "pack") & (amount > 1) & (amount <= 5)
    return F.when(amount.isNotNull() & (amount != 0) & (u != "") & ~small, F.concat((F.bround(amount * 2) / 2).cast("string"), F.lit("_"), u))


def price_per_oz(price: Column, amount: Column, unit: Column) -> Column:
    u = F.regexp_replace(F.lower(unit), r"[ .-]", "")
    oz = amount * F.try_element_at(_lit_map(OUNCES), u)
    return F.when((price > 0) & (oz > 0), F.floor(price / oz * 10000 + 0.5) / 10000)


def parse_size(c: Column) -> Column:
    """(value, family) of a size text: fluid ounces, other volume, weight in ounces, count."""
    s = F.lower(c)
    part = lambda p, i: F.nullif(F.regexp_extract(s, p, i), F.lit(""))
    fl, vol, wt, ct = r"(\d+(?:\.\d+)?)\s*fl\.?\s*oz", r"(\d+(?:\.\d+)?)\s*(gallon|gal|qt|pt|ml|l)\b", r"(\d+(?:\.\d+)?)\s*(lbs?|oz)\b", r"(\d+(?:\.\d+)?)\s*(ct|count|pk|pack|ea)\b"
    floz = _lit_map({"gallon": 128.0, "gal": 128.0, "qt": 32.0, "pt": 16.0, "l": 33.814, "ml": 0.033814})
    n = lambda p: part(p, 1).cast("double")
    pair = lambda v, f: F.struct(v.alias("value"), F.lit(f).alias("family"))
    return (
        F.when(n(fl).isNotNull(), pair(n(fl), "vol"))
        .when(n(vol).isNotNull(), pair(n(vol) * F.try_element_at(floz, part(vol, 2)), "vol"))
        .when(n(wt).isNotNull(), pair(n(wt) * F.when(part(wt, 2).startswith("lb"), 16.0).otherwise(1.0), "weight"))
        .when(n(ct).isNotNull(), pair(n(ct), "count"))
    )


def word_sort(c: Column) -> Column:
    words = F.split(F.trim(c), r"\s+")
    return F.when(F.size(words) <= 4, F.array_join(F.array_sort(words), " ")).otherwise(c)


def name_similarity(q: Column, c: Column) -> Column:
    """1 if equal, .9 if the name starts or ends with the query as whole words, else the shared part of its words."""
    qw, cw = F.split(q, r"\s+"), F.split(c, r"\s+")
    shared = F.size(F.array_intersect(qw, cw)) / F.size(F.array_distinct(qw))
    ratio = F.least(F.size(qw) / F.size(cw), F.lit(1.0))
    return (
        F.when(q == c, 1.0)
        .when(F.startswith(c, F.concat(q, F.lit(" "))) | F.endswith(c, F.concat(F.lit(" "), q)), 0.9)
        .otherwise(F.floor(shared * ratio * 1000 + 0.5) / 1000)
    )


def identity(df: DataFrame, brands: list[str] = BRANDS) -> DataFrame:
    """df (product_name, base_amount, base_unit) with found_brand, canonical_name, size_oz, match_key and confidence."""
    d = df.withColumn("found_brand", extract_brand(F.col("product_name"), brands))
    d = d.withColumn("canonical_name", canonical_name(F.col("product_name"), F.col("found_brand")))
    d = d.withColumn("size_oz", size_oz(F.col("base_amount"), F.col("base_unit"), F.col("product_name")))
    key, sure = match_key(F.col("found_brand"), F.col("canonical_name"), F.col("size_oz"))
    return d.withColumns({"match_key": key, "confidence": sure})


def canonicalize(df: DataFrame, dictionary: DataFrame, brands: list[str] = BRANDS) -> DataFrame:
    """Rows without canonical_name get brand, canonical_name and key: existing brand or found; curated name or built; else the name, cut."""
    todo = df.where("canonical_name is null").drop("canonical_name")
    todo = todo.withColumn("brand", F.coalesce("brand", extract_brand(F.col("product_name"), brands)))
    todo = todo.withColumn("_built", canonical_name(F.col("product_name"), F.col("brand")))
    todo = curated_name(todo, "product_name", "_built", dictionary)
    name = F.coalesce("curated", "_built")
    name = F.when(F.length(name) < 2, F.substring(F.lower("product_name"), 1, 120)).otherwise(name)
    todo = todo.withColumn("canonical_name", name)
    return todo.withColumn("match_key", match_key_v1(F.col("brand"), F.col("canonical_name"), F.col("base_amount"))).drop("_built", "curated")


def recanonicalize(df: DataFrame) -> DataFrame:
    """Rows whose stored canonical_name changes when canonicalized again; names of three or four digits are left alone."""
    new = canonical_name(F.col("canonical_name"), F.col("brand"))
    d = df.where(~F.col("canonical_name").rlike(r"^\d{3,4}$")).withColumn("new_name", new)
    return d.where((F.length("new_name") >= 2) & (F.col("new_name") != F.col("canonical_name")))


def backfill_brand(df: DataFrame, brands: list[str] = BRANDS) -> DataFrame:
    """Rows without a brand for which one is found, with the canonical name rebuilt (the old one if that is empty)."""
    d = df.where("brand is null").withColumn("brand", extract_brand(F.col("product_name"), brands)).where("brand is not null")
    new = canonical_name(F.col("product_name"), F.col("brand"))
    return d.withColumn("canonical_name", _let(new, lambda n: F.when(n != "", n).otherwise(F.col("canonical_name"))))
