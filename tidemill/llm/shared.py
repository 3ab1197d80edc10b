"""What the operators of this folder share: reading tables, the shared scratch folder, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse
from urllib.request import url2pathname

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a map is given at once. Texts can be long; Spark also limits a batch's bytes (arrow.maxBytesPerBatch, 64 MB).
ARROW_ROWS = 1000
#: The same for maps that do once what rows have in common.
GROUP_ROWS = 4000
#: Ids up to which a side of a join is broadcast (16 MB at most); larger ones are merged.
BROADCAST_IDS = 1_000_000
#: Parquet bytes of input for which one task is planned when an operator has to choose a partition count.
TASK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; one of our own only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/tidemill-{uuid.uuid4().hex}"


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemill-")


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for a while; afterwards they are what they were."""
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    try:
        for k, v in values.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def stash(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts the lineage and survives lost executors.

    What the write has shuffled is given back with its end, since nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch(spark)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that `stash` wrote and that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._stashed)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared store, by Spark's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder partition by partition: unlike `stash`, every partition stays what it is."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def ranged(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """df in ascending order of keys (nulls first) over n partitions, checkpointed: with part_ and the place in it, pos_.

    Rows that are equal in all keys are told apart by a number, so any share of such rows spreads over partitions.
    """
    rows = df.withColumn("tie_", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, *keys, "tie_").sortWithinPartitions(*keys, "tie_").drop("tie_")
    at = F.col("at_")
    rows = checkpointed(rows.withColumn("at_", F.monotonically_increasing_id()))
    return rows.withColumns({"part_": F.shiftright(at, 33).cast("int"), "pos_": at.bitwiseAND(F.lit((1 << 33) - 1))}).drop("at_")


def only(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose key is among ids, a table from `stash` with one column of distinct numbers.

    Few ids go to the rows by broadcast, after they have been counted; otherwise rows and ids are shuffled and merged.
    """
    ids = ids.select(F.col(ids.columns[0]).alias("only_"))
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), F.col(key) == F.col("only_"), "left_semi")


def meet(rows: DataFrame, side: DataFrame, key: str, by: str) -> DataFrame:
    """rows with the other columns of side, which has one row for each key (not null); rows without one go.

    A key may hold any share of rows: these are dealt to salts by column by, and side's row goes to each salt its key has
    rows in. Keys and salts combine before they are shuffled, so a hot key stays a few rows there.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # even a key with a third of all rows then gives no task more than about three times its share
    dealt = rows.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(n // 8 + 1)))
    copies = dealt.select(key, "salt_").distinct().join(side, key)
    return dealt.join(copies, [key, "salt_"]).drop("salt_")


def partitions_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Partitions by the optimizer's estimate of df's bytes, at least the session's parallelism."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # an estimate over a derived frame can be absurd; a million tasks is a bound for the planner, not for the data
    return max(df.sparkSession.sparkContext.defaultParallelism, min(size // task_bytes + 1, 1_000_000))


def range_partitions(df: DataFrame, task_bytes: int) -> int:
    """Partitions for a range sort of df: by its estimated bytes, or as the session shuffles where Spark can't estimate them."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a frame made of an RDD is taken for the largest number there is
    return max(spark.sparkContext.defaultParallelism, size // task_bytes + 1 if size < 1 << 50 else usual)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = ARROW_ROWS) -> DataFrame:
    """mapInArrow with batches of at most so many rows, since a row can hold a whole book.

    Spark keeps its Python workers: what Arrow has taken goes back at a task's end, so that a later stage doesn't add to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def groups(places: np.ndarray, sizes: np.ndarray, bound: int) -> list[np.ndarray]:
    """places, cut into runs whose sizes, none above bound, come to less than twice bound each."""
    before = (np.cumsum(sizes, dtype=np.int64) - sizes) // bound
    return np.split(places, np.flatnonzero(np.diff(before)) + 1) if len(places) else []


def runs(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of values, each given by where it begins and its length, one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1])]


def give_back() -> None:
    """Memory that this process has freed goes back to the system: C libraries and Arrow keep much of it for later.

    A driver that has worked on large arrays for a while otherwise stays as large until its session ends.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # glibc's alone
        ctypes.CDLL(None).malloc_trim(0)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and whole text, null text as empty; other columns, however they are called, are left behind."""
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return url2pathname(parsed.path)
    return None


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file under a temporary name and rename it: readers see all of it or nothing, a repeated attempt replaces it."""
    temporary = f".{name}.{uuid.uuid4().hex}.tmp"
    path = _local(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{temporary}", "wb") as f:
            f.write(data)
        os.replace(f"{path}/{temporary}", f"{path}/{name}")
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{temporary}") as f:
        f.write(data)
    store.move(f"{base}/{temporary}", f"{base}/{name}")


def fingerprint(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def put_manifest(folder: str, files: DataFrame, content: dict) -> DataFrame:
    """The commit of a set of files: they count as written once this one is there. Returns the table of files.

    files (name, bytes, sha256, and more) can be many, so they are a table beside the manifest, which names that table.
    Writing that table runs the task that writes the files, and holds the names of the attempts that counted only.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    files.write.parquet(f"{folder}/files")
    put(folder, "manifest.json", json.dumps(content | {"files": "files", "schema": schema}, sort_keys=True).encode())
    return listed(files.sparkSession, folder)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The table of files that the folder's manifest names; a folder without one isn't complete and can't be read."""
    found = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first().value)
    return spark.read.schema(found["schema"]).parquet(f"{folder}/{found['files']}")


def contents(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(content, and the columns of `listed`) of the files that the manifest lists, and of no others.

    The reader must hold each content against its digest with `intact`.
    """
    files = listed(spark, folder)
    stored = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    stored = stored.select(F.element_at(F.split("path", "/"), -1).alias("stored_"), "content")
    # the names go to the files by broadcast when they are few, so that no content is shuffled
    n = files.count()
    met = stored.join(F.broadcast(files) if n <= BROADCAST_IDS // 8 else files, F.col("stored_") == F.col("name")).drop("stored_")
    if met.select("name").distinct().count() < n:
        raise ValueError(f"files that the manifest lists are missing in {folder}")
    return met


def intact(name: str, content: bytes, size: int, digest: str) -> bytes:
    if len(content) != size or fingerprint(content) != digest:
        raise ValueError(f"a damaged file: {name}")
    return content
