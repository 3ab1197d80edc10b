"""A corpus from documents: quality rules, near-duplicates, secrets, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import packing, quality, secrets, simhash, similar
from tidemill.llm.shared import discard, stash, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def fingerprint_links(docs: DataFrame, key: str) -> DataFrame:
    """(a, b): the rows that the SimHash operator puts into one component, each with the component's smallest key."""
    near = simhash.near_duplicates(docs, key)
    return stash(near.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("a"), F.col("component_id").alias("b")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id.

    Texts are near-duplicates by the SimHash operator (three or fewer differing bits, met at covering anchors); texts of a
    five-word similarity of 0.8 or more whose fingerprints lie further apart are linked as well. Groups are what both reach.

    Where doc_ids repeat or are null, rows are told apart by a number of their own: rows without an id come after those
    with one, of rows with equal ids the one whose text has the smallest hash stays, of identical rows one stays.
    """
    ids = docs.groupBy(F.col("doc_id").alias("k")).count().where("count > 1 or k is null")
    if ids.isEmpty():
        links = fingerprint_links(docs, "doc_id")
        kept = stash(similar.representatives(docs, links=links))
        discard(links)
        # the ids that stay grow with the documents, so they are never broadcast; one plan at every size
        return docs.join(kept.hint("merge"), docs["doc_id"] == kept["doc_id"], "left_semi")
    row = "row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    # written once, so that the numbers stay what they are
    rows = stash(docs.withColumn(row, F.monotonically_increasing_id()))
    links = fingerprint_links(rows, row)
    near = similar.near_copies(rows, row, links).select(F.col(row).alias("n"), "component_id")
    keys = rows.select(F.col(row).alias("r"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("k"), F.xxhash64("text").alias("tie"))
    first = keys.join(near, F.col("r") == F.col("n")).groupBy("component_id").agg(F.min(F.struct("last", "k", "tie", "r")).alias("m"))
    kept = stash(first.select("m.r"))
    discard(links)
    return rows.join(kept.hint("merge"), rows[row] == kept["r"], "left_semi").drop(row)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark; no document goes."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality rules", keep_good), ("near-duplicates", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each one's rows written as a table that the next reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
