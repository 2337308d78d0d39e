"""Audits: coverage of matches, positions and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import valid_coord
from ..sources.tables import cents, union_all


def match_coverage(matched: DataFrame) -> DataFrame:
    """By way of matching: deals and their share."""
    g = matched.groupBy(F.coalesce("matched_by", F.lit("null")).alias("matched_by")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("all"))
    return g.crossJoin(total).select("matched_by", "n", cents(F.col("n") / F.col("all") * 100).alias("pct"))  # total is one row


def retailer_coverage(matched: DataFrame, k: int = 20) -> DataFrame:
    """The largest retailers with the share of their deals that have a store, and whether it is below 80 %."""
    g = matched.groupBy("retailer_key").agg(F.count("*").alias("n"), F.count_if(F.col("matched_store").isNotNull()).alias("n_matched"))
    g = g.withColumn("pct", cents(F.col("n_matched") / F.col("n") * 100)).withColumn("low", F.col("pct") < 80)
    return g.orderBy(F.desc("n"), "retailer_key").limit(k)


def candidate_fill(matched: DataFrame) -> DataFrame:
    """One row: deals, those with a list of candidate stores, and their share in percent."""
    filled = F.count_if(F.size(F.coalesce("candidate_store_ids", F.array().cast("array<long>"))) > 0)
    return matched.agg(F.count("*").alias("n"), filled.alias("n_filled")).withColumn("pct", cents(F.col("n_filled") / F.col("n") * 100))


def store_audit(stores: DataFrame) -> DataFrame:
    """By retailer: stores, those with a real position, missing zips, number of zips, states, stores by confidence, and a status."""
    real = valid_coord(F.col("latitude"), F.col("longitude")) & F.coalesce(F.col("geocode_confidence") != "zip_centroid", F.lit(False))
    g = stores.groupBy("retailer_key").agg(F.count("*").alias("n"), F.count_if(real).alias("n_real"), F.count_if(F.col("zip_code").isNull()).alias("null_zips"), F.count_distinct("zip_code").alias("n_zips"))
    if "state" in stores.columns:
        g = g.join(stores.groupBy("retailer_key").agg(F.sort_array(F.collect_set(F.upper("state"))).alias("states")), "retailer_key")
    by = stores.groupBy("retailer_key", F.coalesce("geocode_confidence", F.lit("none")).alias("c")).agg(F.count("*").alias("k"))
    g = g.join(by.groupBy("retailer_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("c", "k")))).alias("confidence")), "retailer_key")
    share = F.col("n_real") / F.col("n")
    return g.withColumn("status", F.when(share >= 0.95, "good").when(share >= 0.5, "partial").otherwise("bad"))


def geocode_coverage(stores: DataFrame) -> DataFrame:
    """Stores by geocode confidence, overall (retailer null) and by retailer, from one rollup."""
    s = stores.withColumn("confidence", F.coalesce("geocode_confidence", F.lit("none")))
    g = s.rollup("confidence", "retailer_key").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return g.where("level < 3").select("confidence", "retailer_key", "n")


def case_variants(df: DataFrame) -> DataFrame:
    """Retailers not written in lower case, with the form to write."""
    return df.where(F.col("retailer") != F.lower("retailer")).groupBy("retailer").agg(F.count("*").alias("n")).withColumn("rewrite", F.lower("retailer"))


def run_stats(results: DataFrame, columns: list[str]) -> DataFrame:
    return results.groupBy(*columns).agg(F.count("*").alias("n"))


def compare_canonicalizers(rows: DataFrame, one: str, two: str) -> DataFrame:
    """One row: hit rates of two name columns, their agreement, and the mean size of groups above one."""
    a = rows.agg(
        cents(F.count(one) / F.count("*") * 100).alias("hit_one"), cents(F.count(two) / F.count("*") * 100).alias("hit_two"), cents(F.count_if(F.col(one) == F.col(two)) / F.count("*") * 100).alias("agree")
    )
    for c, name in ((one, "group_one"), (two, "group_two")):
        g = rows.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").agg(cents(F.sum("count") / F.count("*")).alias(name))
        a = a.crossJoin(g)  # one row each
    return a


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def flag_union(key: str, *flagged: DataFrame) -> DataFrame:
    """The keys that any of several frames lists, each once."""
    return union_all([f.select(key) for f in flagged]).distinct()


def best_rows(df: DataFrame, order: list[tuple[str, float | None, bool]], tie: str, k: int) -> DataFrame:
    """A report of the first k rows with their place; order: (column, what stands for null, descending). tie makes the order total."""
    by = []
    for name, missing, down in order:
        c = F.col(name) if missing is None else F.coalesce(name, F.lit(missing))
        by.append(c.desc() if down else c.asc())
    top = df.orderBy(*by, tie).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*by, tie)))  # k rows, one task


def issue_counts(checked: DataFrame) -> DataFrame:
    """Rows by issue; checked has a list of issues."""
    return checked.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
