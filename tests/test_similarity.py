import random
from difflib import SequenceMatcher

from pricelens.functions import geo as G
from pricelens.operators import catalog as C
from pyspark.sql import functions as F

COLS = "id long, retailer_key string, address string, name string, city string, state string, zip_code string, latitude double, longitude double"
WORDS = ["n", "north", "sw", "southwest", "main", "maine", "oak", "oaks", "st", "street", "pkwy", "parkway", "park", "5", "a", "maple"]


def side(spark, rng, n, first):
    rows = []
    for i in range(n):
        address = " ".join([str(rng.randrange(1, 60)), *rng.choices(WORDS, k=rng.randrange(0, 4))])
        rows.append((first + i, rng.choice(["r", "q"]), rng.choice([address] * 30 + [None, "", "."]), rng.choice(["shop one", "shop two"]), "town", rng.choice(["CA"] * 9 + [None]), rng.choice(["90001", "90002", None]), 34.0, -118.0))
    return spark.createDataFrame(rows, COLS)


def test_entity_pairs_lose_no_match_and_are_few(spark):
    rng = random.Random(3)
    internal, external = side(spark, rng, 300, 0), side(spark, rng, 300, 1000)
    zip3 = F.substring("zip_code", 1, 3)
    x = internal.select(*[F.col(c).alias(f"x_{c}") for c in internal.columns])
    every = external.join(x, (F.col("retailer_key") == F.col("x_retailer_key")) & (zip3 == F.substring("x_zip_code", 1, 3)))
    for threshold in (0.82, 0.7, 0.5):
        found = C.entity_pairs(internal, external, threshold)
        pick = lambda d: sorted((r.id, r.x_id) for r in d.where(C.match_score() >= threshold).select("id", "x_id").collect())  # noqa: B023, E731
        got = pick(found)
        assert got == pick(every) and len(got) == len(set(got)) and got
        if threshold == 0.82:
            made, all_pairs = found.count(), every.count()
            assert len(got) <= made < all_pairs / 5, (made, all_pairs)


def test_ratios_by_bounds_equal_the_matcher(spark):
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", "12 main st", "12 Main St", "ünï 🙂 x", *["".join(rng.choices("abcde 12", k=rng.randrange(1, 30))) for _ in range(12)]])
    rows = [(i, text(), text()) for i in range(400)] + [(400, "x" * 500 + "y", "x" * 400)]
    d = spark.createDataFrame(rows, "id int, a string, b string")
    truth = {i: SequenceMatcher(None, a or "", b or "").ratio() for i, a, b in rows}
    for least in (0.0, 0.6, 1.0):
        got = {r.id: r.ratio for r in G.ratio_at_least(d, "a", "b", least).collect()}
        assert got == {i: v for i, v in truth.items() if v >= least}
    bounds = {r.id: r.u for r in d.select("id", G.ratio_bound(F.col("a"), F.col("b")).alias("u")).collect()}
    assert all(bounds[i] >= v - 1e-12 for i, v in truth.items())
    assert sum(u >= 0.6 for u in bounds.values()) < len(rows) / 2
