"""Importance resampling towards a target: documents whose hashed words and word pairs are likelier in the target are drawn.

Features are all runs of one and two consecutive words; each falls into a bucket by crc32. A first pass writes the buckets
of every document, packed as unsigned 16-bit numbers, one stream for a batch of documents with their offsets in it, to a
table in the shared folder. Each stream is then sorted and run-length encoded, and the runs are added up by bucket: these
are the corpus's counts, at most one number for each bucket and task. The target's texts are counted alike. A bucket's gain
is the logarithm of its target share over its corpus share, in floored thousandths. A second pass over the streams gathers
the gains and sums them between offsets: a document's weight is their floored mean. Weights and noise that depends on the
document's id alone give scores; the highest are drawn, by a range sort and counts by partition.

Nulls: a null text has no words. A null doc_id has noise of its own (that of the text `null`), and counts as the largest
in ties. Ties go to the smaller doc_id; of rows with equal ids and scores each has a rank, in any order. Repeated rows count
as often as they are there. Texts are hashed whole, a very long one in parts, as one stream. Empty tables give empty
results, or counts of nothing. Columns besides doc_id and text play no part, however they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, map_arrow, range_partitions, ranged, stash

BUCKETS = 10_000
#: Documents with fewer words can't be drawn, and the share of the others that is, in hundredths.
LEAST_WORDS, SHARE = 20, 25
SEED = 7
#: Bytes of text from which a stream ends, and of a long text hashed at a time.
STREAM_BYTES = 4 << 20
_STREAM = "ids array<bigint>, words array<bigint>, ends array<bigint>, stream binary"

# Bytes that words are made of, after A-Z have become a-z; all others are spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def buckets(text: str, n: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Words of a text, and the buckets of its features as unsigned 16-bit numbers, in any order."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    words, before, parts = 0, [], []
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STREAM_BYTES)
        end = len(data) if end < 0 else end
        some = before + data[at:end].split()
        sums = list(map(crc32, some))
        pairs = map(crc32, [b" " + w for w in some[1:]], sums)
        parts.append(np.fromiter([*sums[len(before) :], *pairs], np.uint32) % n)
        words += len(some) - len(before)
        before, at = some[-1:], end
    return words, np.concatenate(parts).astype(np.uint16) if parts else np.empty(0, np.uint16)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    words: list[int] = []
    streams: list[np.ndarray] = []
    held = 0

    def row() -> pa.RecordBatch:
        ends = np.cumsum([len(s) for s in streams])
        whole = np.concatenate(streams).astype("<u2").tobytes()
        long = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([ids], long), pa.array([words], long), pa.array([ends.tolist()], long), pa.array([whole], pa.binary())], names=["ids", "words", "ends", "stream"])

    for b in batches:
        # text by text: of a batch's texts, only one is a Python string at a time
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            n, s = buckets(t.as_py())
            ids.append(i)
            words.append(n)
            streams.append(s)
            held += len(s) * 2
            if held >= STREAM_BYTES:
                yield row()
                ids, words, streams, held = [], [], [], 0
    if ids:
        yield row()


def streams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed buckets of the documents, as a table in the shared folder."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return stash(map_arrow(rows, _packed, _STREAM))


def counts(packed: DataFrame) -> np.ndarray:
    """How often each bucket is in the streams: each one sorted and run-length encoded, the runs added up by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0):
                stream = np.sort(np.frombuffer(s.as_buffer(), "<u2"))
                first = np.flatnonzero(np.concatenate([[True], stream[1:] != stream[:-1]])) if len(stream) else np.empty(0, np.int64)
                lengths = np.diff(np.append(first, len(stream)))
                yield pa.RecordBatch.from_arrays([pa.array(stream[first].astype(np.int32)), pa.array(lengths.astype(np.int64))], names=["bucket", "n"])

    runs = map_arrow(packed.select("stream"), run, "bucket int, n bigint", rows=8)
    out = np.zeros(BUCKETS, np.int64)
    # a row for each bucket at most
    for r in runs.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the logarithm of each bucket's share in the target over that in the corpus, both smoothed by one."""
    n, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_corpus + n) / ((s + 1) * (all_target + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Floored thousandths of a Gumbel value that depends on the id and the seed alone."""
    name = "null" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(packed: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document in the streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, words, ends, s in zip(*b.columns, strict=True):
                ends = np.asarray(ends.values, np.int64)
                sizes = np.diff(ends, prepend=0)
                weight = np.zeros(len(ends), np.int64)
                some = np.flatnonzero(sizes)
                if len(some):
                    got = gain[np.frombuffer(s.as_buffer(), "<u2")]
                    # starts of documents with features follow each other, so each sum ends where the next document begins
                    weight[some] = np.add.reduceat(got, ends[some] - sizes[some]) // sizes[some]
                score = weight + np.array([noise(i, seed) for i in ids.as_py()], np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(sizes), pa.array(weight), pa.array(score)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return map_arrow(packed, run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint", rows=8)


def ranked(rows: DataFrame, share: int = SHARE, partitions: int | None = None) -> DataFrame:
    """rows with rank: 1, 2, 3... for the share of them (in hundredths) with the highest scores, else null."""
    order = rows.withColumns({"falling_": -F.col("score"), "none_": F.col("doc_id").isNull()})
    sorted_ = ranged(order, ["falling_", "none_", "doc_id"], partitions or range_partitions(rows, STREAM_BYTES * 16))
    found = sorted(sorted_.groupBy("part_").agg(F.count("*").alias("n")).collect())
    # a number for each partition
    before, total = [], 0
    for r in found:
        before.append((r.part_, total))
        total += r.n
    starts = rows.sparkSession.createDataFrame(before, "at_ int, before_ long")
    place = F.col("before_") + F.col("pos_") + 1
    # one row for each partition
    met = sorted_.join(F.broadcast(starts), F.col("part_") == F.col("at_"))
    return met.withColumn("rank", F.when(place <= share * total // 100, place)).select(*rows.columns, "rank")


def draw(docs: DataFrame, target: DataFrame, target_key: str = "item_id", share: int = SHARE, least: int = LEAST_WORDS, seed: int = SEED, partitions: int | None = None) -> DataFrame:
    """Every document with its features, weight, score and, if it is drawn, its rank."""
    packed, wanted = streams(docs), streams(target, target_key)
    scored = stash(weights(packed, gains(counts(packed), counts(wanted)), seed))
    discard(packed, wanted)
    long = F.col("n_words") >= least
    chosen = ranked(scored.where(long), share, partitions)
    rest = scored.where(~long).withColumn("rank", F.lit(None).cast("long"))
    return chosen.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
