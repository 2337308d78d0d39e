import random

import pytest
from pyspark.sql import functions as F

from pricelens.operators import offers as O
from pricelens.operators.containment import contained


def pairs(spark, texts, parts):
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    p = spark.createDataFrame([(x,) for x in parts], "p string")
    return contained(t, "t", p, "p")


@pytest.mark.parametrize("seed", range(4))
def test_pairs_equal_a_nested_loop(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(0, 7)))
    texts = [word() + r.choice(["", " ", "  "]) + word() for _ in range(60)] + [None, "", "a", "100% off_", "ab ab ab"]
    parts = [word() for _ in range(40)] + [r.choice(texts[:60])[r.randint(0, 4) :] for _ in range(40)] + [None, "a", "é", " ", "%", "_", "b ab ", "not there"] + ["", "ab"] * (seed % 2)
    got = sorted(tuple(x) for x in pairs(spark, texts, parts).collect())
    assert got == sorted({(t, p) for t in texts for p in parts if t is not None and p is not None and p in t})


def test_no_nested_loop(spark):
    plan = pairs(spark, ["some text"], ["text", "e"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairs(spark, [], ["x"]).count() == 0 and pairs(spark, ["x"], []).count() == 0


def test_meeting_rows_follow_the_rarest_gram(spark):
    """A common gram doesn't bring texts and parts together where a rarer one tells."""
    texts = [f"common thing {i}" for i in range(300)] + ["common thing rare zebra"]
    d = pairs(spark, texts, ["common thing rare", "thing 7", "mon thing 29"])
    got = sorted((x.p, x.t) for x in d.collect())
    assert [p for p, _ in got].count("common thing rare") == 1 and ("thing 7", "common thing 7") in got and len(got) == 1 + 11 + 11


def test_outliers_by_price_counts(spark):
    rows = [("a", "x", p) for p in (2.0, 3.0, 10.0)] + [("b", "x", p) for p in (1.0, 9.0)] + [(None, "x", p) for p in (1.0, 1.0, 1.0, 5.0)] + [("c", None, p) for p in (None, 4.0, 4.0, 9.0)]
    d = O.trim_outliers(spark.createDataFrame(rows, "k string, l string, price double"), ["k", "l"])
    got = sorted((str(x.k), x.price) for x in d.where(F.col("price").isNotNull()).collect())
    assert got == sorted([("a", 2.0), ("a", 3.0), ("b", 1.0), ("b", 9.0), ("None", 1.0), ("None", 1.0), ("None", 1.0), ("c", 4.0), ("c", 4.0)])
