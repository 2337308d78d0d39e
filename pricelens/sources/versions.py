"""A table that is written by parts (days, months) and survives a stop of its writer at any moment.

Every write makes a new version: the rows of the parts it touches go to ``data/version=N``, and once all of them are there one
row a part goes to ``commits/version=N``, in one file, which is there as a whole or not at all. Readers take each part from its last committed version, so
rows of a write that stopped are never seen, and the rows that they replace never go before. A commit also names the stream and batch it is of: a
batch that comes again is left out if it is committed, and written anew if it isn't. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_COMMITS = "stream string, batch long, part date, seen timestamp, version int"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(stream, batch, part, seen, version) of all writes; part is null for a write without rows, seen is the latest time that a batch had."""
    try:
        return spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _COMMITS)


def current(spark: SparkSession, path: str, schema: StructType, name: str = "data") -> DataFrame:
    """The rows of the last committed version of each part, with column part. schema: that of the rows without part."""
    last = commits(spark, path).where("part is not null").groupBy("part").agg(F.max("version").alias("version"))
    try:
        rows = spark.read.schema(StructType(list(schema.fields)).add("version", "integer").add("part", "date")).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], StructType(list(schema.fields)).add("part", "date"))
    return rows.join(F.broadcast(last), ["version", "part"]).drop("version")  # a row a part


def appended(spark: SparkSession, path: str, schema: StructType, name: str, after: int = 0) -> DataFrame:
    """All rows that committed writes, those of versions above after, have put into the side table name."""
    done = commits(spark, path).where(F.col("version") > after).select("version").distinct()
    try:
        rows = spark.read.schema(StructType(list(schema.fields)).add("version", "integer")).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return rows.where(F.col("version") > after).join(done, "version").drop("version")


def _commit(spark: SparkSession, path: str, rows: list[tuple], version: int) -> None:
    made = spark.createDataFrame(rows, "stream string, batch long, part date, seen timestamp")
    made.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/version={version}")


def write(path: str, stream: str, batch: int, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], seen=None, aside: dict[str, DataFrame] | Callable[[DataFrame, DataFrame], dict[str, DataFrame]] | None = None) -> bool:
    """Merges new (with column part) into the table's parts that it touches; merge takes their stored rows and the new ones. False if the batch was committed before.

    aside: rows to append to side tables in the same commit, or a function that makes them of the stored rows and the new ones.
    """
    spark = new.sparkSession
    log = commits(spark, path)
    facts = log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v"), F.count_if((F.col("stream") == stream) & (F.col("batch") == batch)).alias("n")).first()
    if facts.n:
        return False
    version = facts.v + 1
    rows = StructType([f for f in new.schema.fields if f.name != "part"])
    parts = [r.part for r in new.select("part").distinct().collect()]  # days or months of one batch
    stored = current(spark, path, rows).where(F.col("part").isin(parts) if parts else F.lit(False))
    if parts:
        merged = merge(stored, new).repartition("part")
        merged.write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/version={version}")
    for name, more in ((aside(stored, new) if callable(aside) else aside) or {}).items():
        more.write.mode("overwrite").parquet(f"{path}/{name}/version={version}")
    _commit(spark, path, [(stream, batch, p, seen) for p in parts or [None]], version)
    return True


def compact(spark: SparkSession, path: str, schema: StructType) -> None:
    """All parts as one version; the folders of earlier versions under data can go once no reader uses them."""
    batch = commits(spark, path).agg(F.max("version")).first()[0] or 0
    write(path, "compaction", batch, current(spark, path, schema), lambda stored, new: new)
