"""Queries of the training-data operators, over the whole tables of a data folder."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, html_text, imatch, langid, licenses, phrases, pieces, repeats, simhash, token_files, vectors, warc
from .common import scratch_path, table

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("PRICELENS_TOKENIZERS", "/opt/tokenizers")


def piece_vocabulary() -> pieces.Vocabulary:
    return pieces.load(f"{TOKENIZERS}/piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.summary(warc.read_chunks(spark, path, data=False))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), piece_vocabulary()).drop("text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = token_files.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return token_files.count(table(spark, sf_dir, "documents"), ranks)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(table(spark, sf_dir, "embeddings"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summary(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_html_text,
        op3_suffix_dedup,
        op4_sentencepiece,
        op5_license_scan,
        op6_token_counts,
        op7_simhash,
        op8_embedding_dedup,
        op9_decontaminate,
        op10_language,
        op11_conversation_repair,
        op12_collocations,
        op13_imatch,
    )
}

SQL: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op8_embedding_dedup": vectors.SQL,
    "op11_conversation_repair": conversations.SQL,
    "op12_collocations": phrases.SQL,
    "op13_imatch": imatch.SQL,
}
