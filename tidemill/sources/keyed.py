"""Dimension tables by key: upserts write small delta files, reads merge them, lookups read what their keys need.

A row's key has a bucket, by hash. A version of the table is a manifest: the layers that make it up, oldest first, and the
last batch of each writer. A layer is a folder of Parquet files, one for each bucket it touches, sorted by key, the first
with Bloom filters of the keys. An upsert of n keys writes one layer of n rows, whatever the table's size; a batch that the manifest
knows writes nothing. Once the layers above the first hold a given share of its rows, or are too many, they are merged into
a new first layer. A manifest is written whole and once: of two writers that want the same version, the second takes the
next one. Manifests and layers that only versions older than KEPT use are removed.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dimensions import last_rows
from .store import Folder

#: Layers above the first, and their share of its rows, from which all are merged.
LAYERS, SHARE = 20, 0.5
#: Versions that stay readable.
KEPT = 3
#: Rows of upper layers up to which their keys are broadcast when a table is read.
BROADCAST_ROWS = 1_000_000
#: Distinct keys up to which a lookup names them to the scan; with more, it reads whole buckets.
NAMED_KEYS = 10_000


def dimension_schema(columns: str, key: str | None = None) -> str:
    """DDL of a dimension table from its comma-separated columns: all strings, the key (id by default) not null."""
    names = columns.split(",")
    if any(not re.fullmatch(r"\w+", n) for n in names):
        raise ValueError(f"not column names: {columns!r}")
    return ", ".join(f"{n} string" + " not null" * (n == (key or "id")) for n in names)


class Layer(NamedTuple):
    folder: str
    rows: int
    buckets: list[int]


class KeyedTable:
    """A dimension of string columns with one row for each key."""

    def __init__(self, spark: SparkSession, path: str, columns: str, key: str | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.columns, self.key, self.buckets = spark, path.rstrip("/"), columns.split(","), key or "id", buckets
        self.schema = dimension_schema(columns, key).replace(" not null", "")
        self._stored = f"{self.schema}, deleted_ boolean, bucket_ int"
        self.manifests, self.layers = Folder(spark, f"{self.path}/versions"), Folder(spark, f"{self.path}/layers")

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    # Versions

    def version(self) -> tuple[int, dict]:
        """The newest whole manifest and its number."""
        for name in reversed(self.manifests.names()):
            if (found := self.manifests.get(name)) is not None:
                return int(name.split(".")[0]), found
        return 0, {"layers": [], "batches": {}, "buckets": self.buckets}

    def _open(self) -> tuple[int, dict]:
        number, found = self.version()
        self.buckets = found["buckets"]  # a table keeps the number it began with
        return number, found

    def _commit(self, number: int, manifest: dict) -> bool:
        return self.manifests.put_new(f"{number:012d}.json", manifest)

    def _scan(self, layers: list[Layer], only: list[int] | None = None) -> DataFrame:
        """Rows of layers, with layer_ as their number; only: the buckets to read."""
        parts = []
        for n, layer in enumerate(layers):
            rows = self.spark.read.schema(self._stored).parquet(f"{self.path}/layers/{layer.folder}")
            if only is not None:
                rows = rows.where(F.col("bucket_").isin(only))
            parts.append(rows.withColumn("layer_", F.lit(n)))
        empty = self.spark.createDataFrame([], f"{self._stored}, layer_ int")
        return reduce(DataFrame.unionByName, parts, empty) if parts else empty

    def _merged(self, layers: list[Layer], only: list[int] | None = None, keys: list[str] | None = None) -> DataFrame:
        """The last row of each key, deleted ones too. The first layer isn't shuffled while the others' keys are few."""
        named = (lambda df: df.where(F.col(self.key).isin(keys))) if keys is not None else lambda df: df
        below, above = named(self._scan(layers[:1], only)), named(self._scan(layers[1:], only))
        newest = last_rows(above, [self.key], ["layer_"])
        few = sum(x.rows for x in layers[1:]) <= BROADCAST_ROWS
        changed = above.select(F.col(self.key).alias("changed_")).distinct()
        stays = below.join(F.broadcast(changed) if few else changed, F.col(self.key) == F.col("changed_"), "left_anti")
        return stays.unionByName(newest).drop("layer_")

    def _layers(self, manifest: dict) -> list[Layer]:
        return [Layer(*x) for x in manifest["layers"]]

    def read(self) -> DataFrame:
        """The table as it is now, with every row that isn't deleted."""
        _, manifest = self._open()
        return self._merged(self._layers(manifest)).where("not deleted_").select(*self.columns)

    # Writing

    def _write(self, rows: DataFrame, first: bool = False) -> Layer:
        """A layer of rows (the columns and deleted_), one file for each bucket among them; a first one with Bloom filters."""
        folder = uuid.uuid4().hex
        dealt = rows.withColumn("bucket_", self.bucket(F.col(self.key))).repartition("bucket_").sortWithinPartitions("bucket_", self.key)
        out = dealt.write.partitionBy("bucket_").option("parquet.page.row.count.limit", "2000")
        if first:  # tens of kilobytes a file, which small layers don't need
            out = out.option(f"parquet.bloom.filter.enabled#{self.key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        out.parquet(f"{self.path}/layers/{folder}")
        written = self.spark.read.schema(self._stored).parquet(f"{self.path}/layers/{folder}")
        # from the files' footers and folders; a row for each bucket
        counts = written.groupBy("bucket_").count().collect()
        return Layer(folder, sum(r["count"] for r in counts), sorted(r.bucket_ for r in counts))

    def upsert(self, changed: DataFrame, order: list[str], data: str = "data", kind: str = "type", honour_deletes: bool = False, batch: tuple[str, int] | None = None) -> bool:
        """Put the last change of each key, by the columns of order, over what is there; False if that batch was written before.

        Deletes are upserts unless honoured. batch: the writer and its number, which grows from batch to batch.
        """
        _, manifest = self._open()
        if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return False
        variant = "variant" in changed.select(data).schema[0].dataType.simpleString()
        value = lambda c: F.try_variant_get(F.col(data)[c], "$", "string") if variant else F.col(data)[c]
        deleted = (F.col(kind) == "delete") if honour_deletes else F.lit(False)
        rows = changed.select(*(value(c).alias(c) for c in self.columns), F.coalesce(deleted, F.lit(False)).alias("deleted_"), *(F.col(o).alias(f"order_{i}_") for i, o in enumerate(order)))
        rows = last_rows(rows.where(F.col(self.key).isNotNull()), [self.key], [f"order_{i}_" for i in range(len(order))])
        layer = self._write(rows.select(*self.columns, "deleted_"), first=not manifest["layers"])
        self._append(layer if layer.rows else None, batch)
        if not layer.rows:
            self.layers.delete(layer.folder)
        self.compact()
        return True

    def _append(self, layer: Layer | None, batch: tuple[str, int] | None) -> None:
        while True:
            number, manifest = self._open()
            if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
                return  # another attempt of the same batch was faster
            layers = [*manifest["layers"], *([layer] if layer else [])]
            batches = manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
            if self._commit(self._next(number), {"layers": layers, "batches": batches, "buckets": self.buckets}):
                return

    def _next(self, number: int) -> int:
        """The number after the newest manifest, whole or not."""
        names = self.manifests.names()
        return max(number, int(names[-1].split(".")[0]) if names else 0) + 1

    def compact(self, always: bool = False) -> bool:
        """Merge all layers into one if those above the first have grown enough."""
        number, manifest = self._open()
        layers = self._layers(manifest)
        due = len(layers) > LAYERS or sum(x.rows for x in layers[1:]) > SHARE * layers[0].rows if len(layers) > 1 else False
        if due or always and len(layers) > 1:
            whole = self._write(self._merged(layers).where("not deleted_").select(*self.columns, "deleted_"), first=True)
            # a batch that came meanwhile stays above; if its manifest took the number, this merge is given up
            if not self._commit(number + 1, manifest | {"layers": [whole] if whole.rows else []}):
                self.layers.delete(whole.folder)
                return False
        self.expire()
        return bool(due or always)

    def expire(self) -> None:
        """Remove manifests older than the last KEPT, and layers that only they used."""
        names = self.manifests.names()
        kept = [m for n in names[-KEPT:] if (m := self.manifests.get(n))]
        used = {x[0] for m in kept for x in m["layers"]}
        for n in names[:-KEPT]:
            old = self.manifests.get(n) or {"layers": []}
            for x in old["layers"]:
                if x[0] not in used:
                    self.layers.delete(x[0])
            self.manifests.delete(n)

    # Lookups

    def rows_of(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows of this table whose keys are in a column of rows, for operators.dimensions.look_up: only their buckets are read, and of few keys only the
        pages that can hold them, by Bloom filters and page statistics."""
        _, manifest = self._open()
        layers = self._layers(manifest)
        asked = rows.select(F.col(column).cast("string").alias("k")).where("k is not null").distinct()
        some = asked.limit(NAMED_KEYS + 1).collect()
        if len(some) <= NAMED_KEYS:
            keys = sorted(r.k for r in some)
            frame = self.spark.createDataFrame([(k,) for k in keys], "k string").select(self.bucket(F.col("k")).alias("b")).distinct()
            wanted = sorted(r.b for r in frame.collect())
        else:  # as many numbers as there are buckets
            keys, wanted = None, sorted(r.b for r in asked.select(self.bucket(F.col("k")).alias("b")).distinct().collect())
        present = [x for x in layers if set(x.buckets) & set(wanted)]
        found = self._merged(present, wanted, keys) if present and present[0] is layers[0] else last_rows(self._scan(present, wanted), [self.key], ["layer_"]).drop("layer_")
        if present and present[0] is not layers[0] and keys is not None:
            found = found.where(F.col(self.key).isin(keys))
        return found.where("not deleted_").select(*self.columns)
