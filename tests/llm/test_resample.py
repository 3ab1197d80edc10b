"""Importance resampling against plain loops over words."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import queries, resample

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, stream string, rank string, score string"


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def want(docs, target):
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([d for _, d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, d in docs:
        words, some = features(d)
        w = sum(gain(bucket(f)) for f in some) // len(some) if some else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(some), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    can = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(can[: 25 * len(can) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def same(got, docs, target):
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want(docs, target), key=str)


def test_query_equals_plain_loops(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    same(queries.op13_resample(spark, SF), docs, target)


def test_odd_documents(spark, monkeypatch):
    """Null, empty and very long texts, repeated rows, null ids, clashing names, several partitions; long texts in parts."""
    long = "Été 42 x" + " abc-DEF é中文 q" * 3000
    docs = [(i, f"word{i % 7} " * (i % 41) + "The End") for i in range(300)] + [(7, None), (8, ""), (9, " .,!\x00\n"), (None, "no id " * 20), (None, None), (1000, long), (1001, long), (1002, "A"), *[(5, "many the same " * 12)] * 60]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], SCHEMA).repartition(4)
    target = ["the end word3", None, "", "abc def é中文"]
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    same(resample.draw(df, wanted, partitions=7), docs, target)
    whole = resample.buckets(long)
    monkeypatch.setattr(resample, "STREAM_BYTES", 50)
    parts = resample.buckets(long)
    assert parts[0] == whole[0] and np.array_equal(np.sort(parts[1]), np.sort(whole[1]))


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resample.draw(none, target).collect() == []
    docs = [(1, "a b c " * 9), (2, "d e f " * 9), (3, "a a"), (4, "g " * 30), (5, "h " * 30)]
    same(resample.draw(spark.createDataFrame(docs, "doc_id long, text string"), target.where("false")), docs, [])


def test_counts_are_those_of_all_streams(spark):
    docs = spark.createDataFrame([(i, f"w{i % 5} x") for i in range(1000)], "doc_id long, text string").repartition(6)
    n = resample.counts(resample.streams(docs))
    assert n.sum() == 3000 and n[bucket("x")] == 1000 and n[bucket("w1 x")] == 200


def test_likelier_documents_are_drawn(spark):
    """A third of the documents is like the target: these have the higher weights."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("alpha beta gamma "), 10)).otherwise(F.repeat(F.lit("red green blue "), 10)).alias("text"))
    target = spark.createDataFrame([(1, "alpha beta gamma alpha beta")], "item_id long, text string")
    got = resample.draw(docs, target)
    drawn = got.where("rank is not null")
    assert drawn.count() == 150 and drawn.where("doc_id % 3 = 0").count() > 90  # by chance 50
