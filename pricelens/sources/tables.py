"""Sources and sinks: scans, catalogs, upserts, and the adapters that derive the engine's tables from the supplied ones.

Each adapter has the same definition as SQL (``CTE``), for checks by another engine. Prices are rounded half up to cents by ``cents``, which
is exact in any engine with IEEE doubles.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The last ship date of the supplied tables: "now" for every look-back.
AS_OF = "2001-11-04"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: for rows that cost far more than they weigh, of which many fit in a file that one task reads."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def meet(left: DataFrame, right: DataFrame, keys: list[str], row: list[str], most: int = 1000) -> DataFrame:
    """left and right joined on keys, over all cores however few the keys are: for joins whose result is far larger than their input.

    The rows of left that share a key are dealt by their columns row into parts of about most rows; those of right are repeated for each part. Keys must hold no doubles: a
    join compares these in another form than they are dealt by, and deals again, over as few tasks as the input fills.
    """
    n = max(2 * left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = left.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    dealt = left.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64(*row), F.col("_parts")).cast("int")).drop("_parts")
    again = right.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.repartition(n, *keys, "_part").join(again.repartition(n, *keys, "_part"), [*keys, "_part"]).drop("_part")


def cents(x: Column) -> Column:
    """x rounded half up to two places."""
    return F.floor(x * 100 + 0.5) / 100


# ---- adapters


def deals(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    """One deal for each line item (those of line, if given): product, price, retailer, store and the postal code of the ordering customer."""
    part, supplier, orders = (table(spark, sf_dir, n) for n in ("part", "supplier", "orders"))
    line = table(spark, sf_dir, "lineitem") if line is None else line
    unit = F.element_at(F.array(*map(F.lit, ("oz", "lb", "g", "ct"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    joined = (
        line.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("deal_id"),
        F.col("p_name").alias("canonical"),
        F.lower("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_size").cast("double").alias("base_amount"),
        unit.alias("base_unit"),
        (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5) / 100).alias("price"),
        F.to_date("l_shipdate").alias("date_added"),
        F.concat(F.lit("retailer_"), "s_nationkey").alias("retailer"),
        F.col("s_nationkey").cast("long").alias("retailer_id"),
        F.col("l_suppkey").alias("store_id"),
        (F.col("o_custkey") % 200 + 90000).cast("string").alias("zip_code"),
    )


def _lat(k: Column) -> Column:
    return F.lit(33.0) + (k * 37 % 200).cast("double") / 100


def _lon(k: Column) -> Column:
    return F.lit(-119.0) + (k * 53 % 200).cast("double") / 100


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 200
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("store_id"),
        F.concat(F.lit("retailer_"), "s_nationkey").alias("retailer_key"),
        F.col("s_nationkey").cast("long").alias("retailer_id"),
        (k + 90000).cast("string").alias("zip_code"),
        (_lat(k) + (F.col("s_suppkey") % 7).cast("double") * 0.002).alias("latitude"),
        _lon(k).alias("longitude"),
        F.when(F.col("s_suppkey") % 5 == 0, "zip_centroid").when(F.col("s_suppkey") % 11 == 0, None).otherwise("high").alias("geocode_confidence"),
    )


def zips(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    return spark.range(200).select((k + 90000).cast("string").alias("zip_code"), _lat(k).alias("latitude"), _lon(k).alias("longitude"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("SMALL", "ECONOMY", "LARGE", "STANDARD", "PROMO"))), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("user_id"),
        (k % 200 + 90000).cast("string").alias("zip_code"),
        F.when(F.col("c_mktsegment") == "BUILDING", "power").when(F.col("c_mktsegment") == "MACHINERY", "regular").otherwise("casual").alias("segment"),
        F.when(k % 3 > 0, F.array(kind, F.lit("ECONOMY"))).alias("category_prefs"),
        F.when(k % 4 > 0, (k % 30 + 10).cast("double")).alias("radius_miles"),
    )


def notification_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        "user_id",
        F.col("ts").alias("sent_at"),
        F.col("event_type").alias("trigger_type"),
        F.col("value").alias("score"),
        F.concat(F.lit("retailer_"), F.col("event_id") % 25).alias("retailer"),
        F.concat(F.lit("product_"), F.col("event_id") % 40).alias("product"),
    )


def product_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw product names in the forms that scraped flyers use, over all cores."""
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    raw = (
        F.when(k % 8 == 0, F.concat(F.lit("Kellogg’s "), name, F.lit(" Family Size, "), size, F.lit(" oz")))
        .when(k % 8 == 1, F.concat(F.lit("Organic "), name, F.lit(" - Oreo™")))
        .when(k % 8 == 2, F.concat(F.lit("Oreo "), name, F.lit(" Cookies | bulk box")))
        .when(k % 8 == 3, F.concat(name, F.lit(" "), size, F.lit("% Fat Free Jar with")))
        .when(k % 8 == 4, F.concat(F.lit("Quaker "), name, F.lit(", a very long description of the goods")))
        .when(k % 8 == 5, F.concat(F.lit("Cheerios "), name))
        .when(k % 8 == 6, F.concat(name, F.lit(" -- imported, "), size, F.lit(" lb bag")))
        .otherwise(F.concat(F.lit("Coca-Cola "), name, F.lit(" 12 pack "), size, F.lit(" fl oz")))
    )
    unit = F.element_at(F.array(*map(F.lit, ("oz", "lb", "g", "ct"))), (k % 4 + 1).cast("int"))
    return spread(table(spark, sf_dir, "part")).select(
        k.alias("product_id"), raw.alias("product_name"), F.when(k % 3 > 0, F.col("p_size").cast("double")).alias("base_amount"), unit.alias("base_unit")
    )


_K = "(s_suppkey % 200)"
CTE = {
    "deals": """deals AS (SELECT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS deal_id, p_name AS canonical, lower(p_brand) AS brand,
      p_type AS category, p_size::DOUBLE AS base_amount, CASE l_partkey % 4 WHEN 0 THEN 'oz' WHEN 1 THEN 'lb' WHEN 2 THEN 'g' ELSE 'ct' END AS base_unit,
      floor(l_extendedprice * 100 / l_quantity + 0.5) / 100 AS price, l_shipdate::DATE AS date_added, 'retailer_' || s_nationkey AS retailer,
      s_nationkey::BIGINT AS retailer_id, l_suppkey AS store_id, (o_custkey % 200 + 90000)::VARCHAR AS zip_code
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)""",
    "stores": f"""stores AS (SELECT s_suppkey AS store_id, 'retailer_' || s_nationkey AS retailer_key, s_nationkey::BIGINT AS retailer_id,
      ({_K} + 90000)::VARCHAR AS zip_code, 33.0::DOUBLE + ({_K} * 37 % 200)::DOUBLE / 100 + (s_suppkey % 7)::DOUBLE * 0.002::DOUBLE AS latitude,
      -119.0::DOUBLE + ({_K} * 53 % 200)::DOUBLE / 100 AS longitude,
      CASE WHEN s_suppkey % 5 = 0 THEN 'zip_centroid' WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'high' END AS geocode_confidence FROM supplier)""",
    "zips": """zips AS (SELECT (k + 90000)::VARCHAR AS zip_code, 33.0::DOUBLE + (k * 37 % 200)::DOUBLE / 100 AS latitude,
      -119.0::DOUBLE + (k * 53 % 200)::DOUBLE / 100 AS longitude FROM (SELECT unnest(range(0, 200)) AS k))""",
    "users": """users AS (SELECT c_custkey AS user_id, (c_custkey % 200 + 90000)::VARCHAR AS zip_code,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'power' WHEN 'MACHINERY' THEN 'regular' ELSE 'casual' END AS segment,
      CASE WHEN c_custkey % 3 > 0 THEN [CASE c_custkey % 5 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'ECONOMY' WHEN 2 THEN 'LARGE' WHEN 3 THEN 'STANDARD' ELSE 'PROMO' END, 'ECONOMY'] END AS category_prefs,
      CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 30 + 10)::DOUBLE END AS radius_miles FROM customer)""",
    "log": """log AS (SELECT event_id AS log_id, user_id, ts AS sent_at, event_type AS trigger_type, value AS score,
      'retailer_' || (event_id % 25) AS retailer, 'product_' || (event_id % 40) AS product FROM events)""",
    "names": """names AS (SELECT p_partkey AS product_id, CASE p_partkey % 8 WHEN 0 THEN 'Kellogg’s ' || p_name || ' Family Size, ' || p_size || ' oz'
      WHEN 1 THEN 'Organic ' || p_name || ' - Oreo™' WHEN 2 THEN 'Oreo ' || p_name || ' Cookies | bulk box'
      WHEN 3 THEN p_name || ' ' || p_size || '% Fat Free Jar with' WHEN 4 THEN 'Quaker ' || p_name || ', a very long description of the goods'
      WHEN 5 THEN 'Cheerios ' || p_name WHEN 6 THEN p_name || ' -- imported, ' || p_size || ' lb bag'
      ELSE 'Coca-Cola ' || p_name || ' 12 pack ' || p_size || ' fl oz' END AS product_name,
      CASE WHEN p_partkey % 3 > 0 THEN p_size::DOUBLE END AS base_amount,
      CASE p_partkey % 4 WHEN 0 THEN 'oz' WHEN 1 THEN 'lb' WHEN 2 THEN 'g' ELSE 'ct' END AS base_unit FROM part)""",
}


def with_sql(names: str, body: str) -> str:
    """SQL text of a query over adapters and further CTEs ("name AS (...)")."""
    return "WITH " + ", ".join(CTE.get(n, n) for n in names.split(" ")) + " " + body if names else body


# ---- scans


def scan(df: DataFrame, columns: list[str], where: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Columns of the rows that pass, filters first so that they and the column list reach the files."""
    out = df.where(where) if where is not None else df
    out = out.select(*columns) if order is None else out.orderBy(*order).select(*columns)
    return out if limit is None else out.limit(limit)


def read_since(df: DataFrame, key: str, last: int, end: int | None = None) -> DataFrame:
    """Rows whose key lies above last and, where given, not above end."""
    out = df.where(F.col(key) > last)
    return out if end is None else out.where(F.col(key) <= end)


def scan_window(df: DataFrame, field: str, start: str | None, end: str | None, inclusive: bool = True) -> DataFrame:
    """Rows whose field lies between two dates; the end is part of it if inclusive."""
    out = df if start is None else df.where(F.col(field) >= F.lit(start).cast("date"))
    if end is None:
        return out
    return out.where(F.col(field) <= F.lit(end).cast("date") if inclusive else F.col(field) < F.lit(end).cast("date"))


CATALOG = "retailer string, retailer_key string, store_id string, address string, full_address string, zip_code string, latitude double, longitude double, geocode_confidence string, geocode_source string"


def read_store_catalog(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A retailer's store catalog as CSV with a header, or JSON lines."""
    reader = spark.read.schema(CATALOG)
    return reader.csv(path, header=True, escape='"') if fmt == "csv" else reader.json(path)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def unique_stores(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The earliest row of each store key."""
    return first_by(rows, keys, [F.col(order)])


def zip_centroids(store_rows: DataFrame, gazetteer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(zips of the stores with their points, zips that the gazetteer lacks)."""
    own = store_rows.select("zip_code").where("zip_code is not null").distinct()
    return own.join(gazetteer, "zip_code"), own.join(gazetteer, "zip_code", "left_anti")


# ---- sinks


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """target with batch's rows in place of those of equal keys; within batch the first by order wins."""
    new = first_by(batch, keys, order or [F.col(c).desc() for c in batch.columns if c not in keys])
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new)


def coalesce_update(target: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """target with patch's non-null fields; rows only in patch are added."""
    new = patch.select(*keys, *[F.col(c).alias(f"_{c}") for c in patch.columns if c not in keys])
    both = target.join(new, keys, "full")
    fields = [c for c in target.columns if c not in keys]
    return both.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) if c in patch.columns else F.col(c) for c in fields])


def dry_run(rows: DataFrame, changed: Column) -> DataFrame:
    """Counts of what a job would write, without writing."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(changed).alias("n_changed"))


def audit_frames(results: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results as JSON rows, failures, counts by status)."""
    as_json = results.select(status, F.to_json(F.struct(*results.columns)).alias("row"))
    return as_json, as_json.where(F.col(status) != "SUCCESS"), results.groupBy(status).agg(F.count("*").alias("n"))


def nearest_zip(rows: DataFrame, zip_points: DataFrame) -> DataFrame:
    """(type, id, near_zip) of rows (type, id, latitude, longitude): the zip of the nearest point, by degrees with those of longitude as short as they are there.

    Rows meet the points of their cell and of those around it. Where the nearest of these is nearer than any point beyond can be, it is the answer; the others, fewer each
    time, go on to cells four times as wide, and at last to all of a hemisphere's.
    """
    z = zip_points.select(F.col("zip_code").alias("near_zip"), F.col("latitude").alias("zlat"), F.col("longitude").alias("zlon")).where("zlat is not null and zlon is not null")
    left, found = rows.select("type", "id", "latitude", "longitude").distinct(), []
    turn = F.cos(F.radians((F.col("latitude") + F.col("zlat")) / 2))  # degrees of longitude are shorter than those of latitude
    far = F.pow(F.col("latitude") - F.col("zlat"), 2) + F.pow((F.col("longitude") - F.col("zlon")) * turn, 2)
    for step in (0.5, 2.0, 8.0, 32.0, 360.0):
        cell = lambda c, i=0: (F.floor(F.col(c) / step) + i).cast("long")  # noqa: B023, E731
        around = z.select("*", F.explode(F.array(*[F.struct(cell("zlat", i).alias("i"), cell("zlon", j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c"))
        met = left.join(around, (cell("latitude") == F.col("c.i")) & (cell("longitude") == F.col("c.j")))
        best = met.groupBy("type", "id", "latitude", "longitude").agg(F.min(F.struct(far.alias("far"), "near_zip")).alias("m"))
        # what isn't met lies a cell away at least, in longitude counted where degrees are shortest
        beyond = step * F.cos(F.radians(F.least(F.abs("latitude") + step / 2, F.lit(90.0))))
        sure = best.where(F.sqrt("m.far") <= beyond) if step < 360 else best
        sure = written(sure.select("type", "id", "m.near_zip"), "nearest")
        found.append(sure)
        left = written(left.join(sure.select("type", "id"), ["type", "id"], "left_anti"), "left")
        if not left.limit(1).count():
            break
    return union_all(found)


def osm_to_store(elements: DataFrame, zip_points: DataFrame, box: tuple[float, float, float, float] = (24.0, 50.0, -125.0, -66.0), prefixes: list[str] | None = None) -> DataFrame:
    """Store rows from map elements (type, id, lat, lon, center, tags): country and box guards, zip from tags or nearest zip point.

    Elements without a zip get the nearest zip point's, however far it is. prefixes: the first three digits of the
    zips that stay, all if None.
    """
    t = lambda k: F.try_element_at("tags", F.lit(k))
    lat, lon = F.coalesce("lat", "center.lat"), F.coalesce("lon", "center.lon")
    rows = elements.select(
        "type", "id", lat.alias("latitude"), lon.alias("longitude"), t("name").alias("name"), t("addr:housenumber").alias("no"), t("addr:street").alias("street"),
        t("addr:city").alias("city"), t("addr:state").alias("state"), t("addr:country").alias("country"),
        F.regexp_extract(F.coalesce(t("addr:postcode"), F.lit("")), r"^(\d{5})", 1).alias("tag_zip"),
    )
    rows = rows.where((F.col("country").isNull() | (F.upper("country") == "US")) & F.col("latitude").between(*box[:2]) & F.col("longitude").between(*box[2:]))
    near = nearest_zip(rows.where("tag_zip = ''").select("type", "id", "latitude", "longitude"), zip_points)
    out = rows.join(near, ["type", "id"], "left")
    zip_code = F.when(F.col("tag_zip") != "", F.col("tag_zip")).otherwise(F.col("near_zip"))
    if prefixes is not None:
        out = out.where(F.substring(zip_code, 1, 3).isin(prefixes))
    street = F.nullif(F.concat_ws(" ", "no", "street"), F.lit(""))
    return out.select("type", "id", "name", "no", "street", "city", "state", zip_code.alias("zip_code"), "latitude", "longitude", F.concat_ws(", ", street, "city", F.concat_ws(" ", "state", zip_code)).alias("full_address"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a local one only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pricelens-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: iterations don't depend on what executors hold of earlier rounds."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
