"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine only where none is set and all tasks run here (tests).

    What is written there isn't removed, as results are read from it later: empty the folder when a job's results are stored.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pricelens-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes df to the shared folder and reads it again, so that what follows doesn't depend on executors that made it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches(columns: dict[str, list], schema: pa.Schema):
    """Arrow batches of at most ROWS_PER_BATCH rows, so that wide rows never make one large buffer."""
    n = len(next(iter(columns.values())))
    for at in range(0, n, ROWS_PER_BATCH):
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name][at : at + ROWS_PER_BATCH], f.type) for f in schema], schema=schema
        )


#: Rows of an Arrow batch where rows hold whole texts: batches of the default size take tens of MB in each task, on both sides.
WIDE_ROWS = 1000


def _release() -> None:
    """Gives memory that this worker no longer uses back to the system; an idle worker would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) for rows that hold whole texts: smaller batches (a setting of the session), memory returned at a task's end."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= WIDE_ROWS:
        conf.set(name, WIDE_ROWS)

    def task(it):
        yield from run(it)
        _release()

    return df.mapInArrow(task, schema)


def slices(batch: pa.RecordBatch, column: str, size: int):
    """Slices of a batch that hold at most size bytes of a column, or one row."""
    at, held = 0, 0
    for i, x in enumerate(batch.column(column)):
        n = len(x.as_buffer()) if x.is_valid else 0
        if held and held + n > size:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is the smallest node that can be reached.

    Alternates large-star and small-star rounds, which reach a fixed point in a number of rounds that is logarithmic in the
    longest path. A hub's edges meet the single row that holds the hub's least neighbour: a partition that a hub makes large is split by
    the adaptive handling of skewed joins. Each round's edges go to the shared folder. Rows with a null end and self-loops are ignored.
    """
    edges = cut(edges.where("a is not null and b is not null and a <> b").distinct(), "cc")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.where("b < a")
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        if large:
            out = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = near.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            out = out.union(low.where("a <> m").select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    state = None
    for _ in range(max_rounds):
        edges = cut(star(star(edges, True), False), "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
