"""The queries of this folder's operators over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, merkle, neighbours, packing, pieces, private, quality, repair, resample, secrets, simhash, sql, warc, wordpiece
from .shared import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECE_BPE)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), PIECE_BPE)


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's turns are plain talk: `with_tools` puts a call and its result into every exchange, which are then linked."""
    return chat.link(chat.with_tools(table(spark, sf_dir, "conversations")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.scan(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_secrets, op2_packing, op3_quality, op4_pieces, op5_token_files, op6_simhash, op7_token_counts, op8_neighbours, op9_warc, op10_tool_calls, op11_merkle, op12_private, op13_resample)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Of those that SQL can express; the others' results (spans, packings, fingerprints, files) tests hold against brute force."""
    return {"op11_merkle": sql.MERKLE, "op13_resample": sql.RESAMPLE}
