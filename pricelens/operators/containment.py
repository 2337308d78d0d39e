"""Which texts hold which parts: an index of grams in place of a nested loop.

A part is looked up by the rarest of its grams: its runs of three letters, and its inner words (which any text that holds it has
as whole words). Texts and parts meet by that gram alone, and what meets is compared. So the work follows the texts that share a part's
rarest gram, not texts times parts. Parts of one or two letters are looked up by themselves, among runs of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = 3


def _runs(c: str, n: int) -> Column:
    """The runs of n letters of a column."""
    starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(F.col(c), i, F.lit(n)))


def _words(words: Column) -> Column:
    """Words as grams: with a space on both sides, so that none equals a run."""
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def _text_grams(c: str) -> Column:
    return F.array_distinct(F.concat(_runs(c, LETTERS), _words(F.split(c, " "))))


def _part_grams(c: str) -> Column:
    words = F.split(c, " ")
    inner = F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(_runs(c, LETTERS), _words(inner)))


def contained(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """(text, part) of every distinct text and every distinct part that it holds; nulls hold nothing and are held by nothing.

    Letters are compared as they are. An empty part is held by every text.
    """
    t = texts.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    p = parts.select(F.col(part).alias("_part")).where("_part is not null").distinct()
    index = t.select("_text", F.explode(_text_grams("_text")).alias("_gram"))
    often = index.groupBy("_gram").agg(F.count("*").alias("_n"))
    asked = p.where(F.length("_part") >= LETTERS).select("_part", F.explode(_part_grams("_part")).alias("_gram")).join(often, "_gram", "left")
    # a gram that no text has is the rarest: such a part is held by none
    rarest = asked.groupBy("_part").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    found = index.join(rarest, "_gram").where(F.contains("_text", "_part")).select("_text", "_part")
    short = p.where(F.length("_part") < LETTERS)
    lengths = {r[0] for r in short.select(F.length("_part")).distinct().collect()}  # of 0, 1 and 2
    for n in sorted(lengths):
        if n:
            runs = t.select("_text", F.explode(F.array_distinct(_runs("_text", n))).alias("_part"))
            found = found.union(runs.join(short.where(F.length("_part") == n), "_part").select("_text", "_part"))
        else:
            found = found.union(t.select("_text", F.lit("").alias("_part")))
    return found.select(F.col("_text").alias(text), F.col("_part").alias(part))
