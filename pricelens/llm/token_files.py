"""Token counts by a separator scan over flat token files.

Files hold 16-bit big-endian token ids one after the other, an end-of-document id after each document and no index.
A task writes its documents in table order, in rows of at most ROW tokens; the text writer puts PAD between rows, two
bytes that no token id has. Counting reads each file in blocks, finds separators in a block with one vectorised comparison, and
carries what lies across blocks by a prefix scan: tokens since the last separator and documents before, by running sums over
the blocks of one task's files. A document's place among a task's documents leads back to its doc_id.

A null or empty text has no tokens and counts zero. Repeated rows are counted each, rows without an id too. Texts are encoded
whole. If the files' documents and the table's rows don't agree in number in any part, the count fails. An empty
table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, scratch_path

END = 50256
ROW, ROWS_PER_FILE, BLOCK = 1 << 19, 16, 1 << 18
#: U+07FF in UTF-8 is DF BF: as a token id above the vocabulary.
PAD_TEXT, PAD = "߿", 0xDFBF
#: Fixed value: the public pattern that splits text before byte-level pair encoding.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_BLOCKS = pa.schema([("part", pa.int64()), ("file", pa.string()), ("block", pa.int64()), ("n_tokens", pa.int64()), ("ends", pa.list_(pa.int32()))])
_encoders: dict[int, object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(ranks: dict[bytes, int]):
    if id(ranks) not in _encoders:
        import tiktoken

        _encoders[id(ranks)] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[id(ranks)]


def write(docs: DataFrame, ranks: dict[bytes, int], path: str) -> None:
    """Writes the flat token files of docs, in the order of the table's splits."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(it):
        encode = _encoder(shared.value).encode_ordinary
        held, size = [], 0

        def out():
            flat = np.concatenate(held).astype(">u2").tobytes()
            for at in range(0, len(flat), 2 * ROW):
                yield pa.RecordBatch.from_arrays([pa.array([flat[at : at + 2 * ROW]], pa.binary())], names=["flat"])

        for batch in it:
            for t in batch.column(0):
                ids = encode(t.as_py()) if t.is_valid else []
                held.append(np.array([*ids, END], np.uint16))
                size += len(ids) + 1
                if size >= ROW:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    flat = docs.select("text").mapInArrow(run, "flat binary").select(F.col("flat").cast("string").alias("value"))
    flat.write.option("lineSep", PAD_TEXT).option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


def separators(tokens: np.ndarray) -> np.ndarray:
    """Places of the end-of-document ids."""
    return np.flatnonzero(tokens == END)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(part, file, block, n_tokens, ends) of every block of the files: the writing task, and where separators stand."""

    def run(it):
        for batch in it:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(content.as_buffer(), ">u2")
                rows = []
                for k, at in enumerate(range(0, len(tokens), BLOCK)):
                    t = tokens[at : at + BLOCK]
                    t = t[t != PAD]
                    rows.append((int(name.split("-")[1]), name, k, len(t), separators(t).tolist()))
                yield from batches({f.name: [r[i] for r in rows] for i, f in enumerate(_BLOCKS)}, _BLOCKS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return named.mapInArrow(run, "part long, file string, block long, n_tokens long, ends array<int>")


def document_lengths(found: DataFrame) -> DataFrame:
    """(part, place, n_tokens) of every document: its place among the documents of its part."""
    order = Window.partitionBy("part").orderBy(F.regexp_extract("file", r"-c(\d+)\.", 1).cast("int"), "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    count = F.size("ends")
    # documents before a block, and tokens from the last separator before it up to the block
    tokens_to = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    last_end = F.when(count > 0, F.element_at("ends", -1) + 1 + F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    scanned = found.select(
        "part", "ends", "file", "block", "n_tokens", F.coalesce(F.sum(count).over(before), F.lit(0)).alias("docs_before"), tokens_to.alias("from"), last_end.alias("last_end")
    )
    scanned = scanned.withColumn("open", F.coalesce(F.last("last_end", ignorenulls=True).over(before), F.lit(0)))
    each = scanned.select("part", "docs_before", "from", "open", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") > 0, F.get("ends", F.col("k") - 1) + 1 + F.col("from")).otherwise(F.col("open"))
    return each.select("part", (F.col("docs_before") + F.col("k")).alias("place"), (F.col("from") + F.col("end") - start).alias("n_tokens"))


def count(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs, which must be a plain scan (its splits give the order)."""
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, ranks, path)
    lengths = document_lengths(blocks(docs.sparkSession, path))
    n = F.monotonically_increasing_id()
    places = docs.select(F.col("doc_id").cast("long"), F.shiftright(n, 33).alias("part"), n.bitwiseAND((1 << 33) - 1).alias("place"))
    both = places.withColumn("known", F.lit(True)).join(lengths, ["part", "place"], "full")
    agrees = F.col("known").isNotNull() & F.col("n_tokens").isNotNull()
    return both.select("doc_id", F.when(agrees, F.col("n_tokens")).otherwise(F.raise_error(F.lit("token files and table differ")).cast("long")).alias("n_tokens"))
