"""Merkle proofs against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemill.llm import merkle, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, group_ string, leaf string"
LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, text):
    return h(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(leaves):
    """The root, and for each leaf (before, after) of its runs, upwards."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
            at[i] = k // 16
        level = [h(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def want(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, tops = tree([built[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, _, first, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), built[s][1], strict=True):
            path = path + top
            node = leaf(r, r.text and r.text.translate(LOWER)) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else first
            for before, after in path:
                node = h(before, node, after)
            out.append((r.doc_id, first, built[s][0], root, h(*(b + a for b, a in path)), node, node == root))
    return out


def same(got, rows):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want(rows), key=str)


def test_query_equals_plain_trees(spark):
    same(queries.op11_merkle(spark, SF), spark.read.parquet(f"{SF}/documents.parquet").collect())


@pytest.mark.parametrize("partitions", [1, 3, 23])
def test_shapes_of_groups(spark, partitions):
    """A group over all partitions and several levels, groups of one and of whole runs, many small groups, null groups and ids, repeated rows."""
    rng = random.Random(partitions)
    rows = [(i, f"Text {i}", "en", "hot", i, "x", "y") for i in range(900)]
    rows += [(i, "T", None, f"s{i % 37}", None, "x", "y") for i in range(300)]
    rows += [(5, "same ROW", "en", "repeated", 1, None, None)] * 70 + [(None, None, None, None, None, None, None)] * 20 + [(1, "", "", "", 0, "", "")]
    rows += [(i, "é" * 50_000, "en", "run16", 1, "", "") for i in range(16)] + [(i, "é", "en", "run17", 1, "", "") for i in range(17)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    same(merkle.audit(df, partitions), df.collect())


def test_empty_and_single(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.audit(df).collect() == [] and merkle.manifest(df)[0] is None
    one = spark.createDataFrame([(5, "A", "en", "s", 1, "", "")], SCHEMA)
    same(merkle.audit(one), one.collect())


def test_proofs_fold_to_the_root_and_changes_do_not(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    root, proofs = merkle.manifest(df, "g", "k", ("k", "v"))
    ok = merkle.fold(F.col("leaf"), F.col("proof")) == root
    moved = merkle.fold(F.sha2("leaf", 256), F.col("proof")) == root
    assert [tuple(r) for r in proofs.groupBy(ok.alias("ok"), moved.alias("moved")).count().collect()] == [(True, False, 1000)]
    other, _ = merkle.manifest(df.withColumn("v", F.when(F.col("k") == 500, "x").otherwise(F.col("v"))), "g", "k", ("k", "v"))
    assert other != root
