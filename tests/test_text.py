from pyspark.sql import functions as F

from pricelens.functions import text as T


def one(spark, col, schema, *row):
    return spark.createDataFrame([row], schema).select(col.alias("x")).first().x


def test_match_keys(spark):
    rows = [
        ("Kellogg’s Corn Pops Family Size, 12 oz", None, None, "kellogg's|corn pops|12.0", "high"),
        ("Corn Pops - Quaker™", 2.0, "lb", "quaker|corn pops|32.0", "high"),
        ("Quaker Oats | bulk box of 40", None, None, "quaker|oats|no_size", "medium"),
        ("Plain Yogurt 0% with", 5.0, "oz", "unknown_brand|plain yogurt 0%|5.0", "low"),
        ("Oreo 100 box", None, None, "oreo|oreo|no_size", "medium"),
        ("Mint Oreo Cookies", None, None, None, "none"),
        ("", None, None, None, "none"),
        (None, None, None, None, "none"),
    ]
    d = spark.createDataFrame([r[:3] for r in rows], "product_name string, base_amount double, base_unit string")
    got = [(r.match_key, r.confidence) for r in T.identity(d).collect()]
    assert got == [r[3:] for r in rows]


def test_sortable_words_and_prefix_without_boundary(spark):
    assert one(spark, T.canonical_name(F.col("n"), F.col("b")), "n string, b string", "oreo mint cookies", None) == "cookies mint oreo"
    assert one(spark, T.extract_brand(F.col("n")), "n string", "Allspice ground") == "all"


def test_size_key(spark):
    d = spark.createDataFrame([(10.3, "oz"), (4.0, "ct"), (6.0, "ct"), (None, "oz"), (10.25, "oz")], "a double, u string")
    assert [r.x for r in d.select(T.size_key(F.col("a"), F.col("u")).alias("x")).collect()] == ["10.5_oz", None, "6.0_ct", None, "10.0_oz"]


def test_key_variants(spark):
    d = spark.createDataFrame([("Acme|corn|16.0",), ("v2|x|y",), ("plain",), ("acme|corn|no_size",)], "k string")
    got = [r.x for r in d.select(T.key_variants(F.col("k")).alias("x")).collect()]
    assert got[0] == ["Acme|corn|16.0", "acme|corn|16.0", "Acme|corn|16", "acme|corn|16", "Acme|corn|no_size", "acme|corn|no_size"]
    assert got[1:] == [["v2|x|y"], ["plain"], ["acme|corn|no_size"]]


def test_parse_size(spark):
    d = spark.createDataFrame([("12 fl oz",), ("1 gal",), ("2 lbs",), ("6 ct",), ("none",), (None,)], "s string")
    got = [tuple(r.x) if r.x else None for r in d.select(T.parse_size(F.col("s")).alias("x")).collect()]
    assert got == [(12.0, "vol"), (128.0, "vol"), (32.0, "weight"), (6.0, "count"), None, None]


def test_similarity_and_price_per_oz(spark):
    assert one(spark, T.name_similarity(F.col("q"), F.col("c")), "q string, c string", "corn", "sweet corn") == 0.9
    assert one(spark, T.price_per_oz(F.col("p"), F.col("a"), F.col("u")), "p double, a double, u string", 4.0, 1.0, "lb") == 0.25
    assert one(spark, T.price_per_oz(F.col("p"), F.col("a"), F.col("u")), "p double, a double, u string", 4.0, 1.0, "ct") is None


def test_names_are_read_once_and_by_several_tasks(spark, tmp_path):
    from pricelens.sources.tables import product_names

    spark.range(0, 8, 1, 1).selectExpr("id as p_partkey", "'corn' as p_name", "5 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    d = product_names(spark, str(tmp_path))
    assert d.rdd.getNumPartitions() > 1
    for x in (T.identity(d), T.backfill_brand(d.selectExpr("*", "cast(null as string) as brand", "'old' as canonical_name"))):
        assert x._jdf.queryExecution().optimizedPlan().toString().count("family size") == 1
