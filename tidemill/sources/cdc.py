"""A table and its change log as one stream of changes: first a snapshot in parallel splits, then the log.

The table is a folder of Parquet files, the log a folder of JSON lines in files whose names are in the order of their
changes; a change has op (c, u, d), before, after, and position, a number that grows. The first batch's end is the log's
end when it was planned. It reads the table, a split (a row group) a task, as changes of op r; a row whose key the log names
after that end is left out, since its changes come with the log. Later batches read the log from there on. So every key
comes either from the snapshot or from its changes, and every change once, wherever the query is stopped and started again:
a batch's end is in its checkpoint before it is read, and a first batch that is read again is held against the same end.

The table must hold what the log says up to a file's name, once that file has it; a log file isn't written to afterwards.
Splits and log files are read by tasks. For batches, `snapshot_and_log` gives the same from two frames.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import records
from . import inputs

CHANGES = "tidemill_changes"
SCHEMA = "op string, position bigint, row string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str, suffix: str) -> list[str]:
    store, base = _store(path)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith((".", "_")))


@dataclass
class Split(InputPartition):
    """A row group of a file, for a log noted at a file's name."""

    file: str
    group: int
    low: str


@dataclass
class LogFile(InputPartition):
    file: str


class ChangeStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.table, self.log, self.key = options["table"], options["log"], options["key"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"log": "", "read": False}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"log": max(map(_name, _files(self.log, ".json")), default=""), "read": True}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if not start["read"]:
            return self._splits(end["log"]) if end["read"] else []
        return [LogFile(f) for f in _files(self.log, ".json") if start["log"] < _name(f) <= end["log"]]

    def _splits(self, low: str) -> list[InputPartition]:
        store, _ = _store(self.table)
        out: list[InputPartition] = []
        for f in _files(self.table, ".parquet"):
            with store.open_input_file(f) as data:
                out += [Split(f, g, low) for g in range(pq.ParquetFile(data).num_row_groups)]
        return out

    def _lines(self, file: str) -> Iterator[dict]:
        store, _ = _store(self.log)
        with store.open_input_stream(file) as data:
            for line in data.read().splitlines():
                if line.strip():
                    yield json.loads(line)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, LogFile):
            for c in self._lines(partition.file):
                yield c["op"], c.get("position"), json.dumps(_row(c), ensure_ascii=False)
            return
        store, _ = _store(self.table)
        with store.open_input_file(partition.file) as data:
            rows = pq.ParquetFile(data).read_row_group(partition.group).to_pylist()
        # after the rows were read: what the log names by now comes from the log
        named = {str(_row(c)[self.key]) for f in _files(self.log, ".json") if _name(f) > partition.low for c in self._lines(f)}
        for row in rows:
            if str(row[self.key]) not in named:
                yield "r", None, json.dumps(row, ensure_ascii=False, default=str)


def _name(file: str) -> str:
    return file.rsplit("/", 1)[-1]


def _row(change: dict) -> dict:
    return change["after"] if change.get("after") is not None else change["before"]


class ChangeSource(DataSource):
    """A stream; options: table, log, key."""

    @classmethod
    def name(cls) -> str:
        return CHANGES

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return ChangeStream(self.options)


def table_changes(spark: SparkSession, table: str, log: str, key: str) -> DataFrame:
    """A stream of op, position (null in the snapshot) and row (JSON, the row before a delete) of a table and its log."""
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format(CHANGES).options(table=table, log=log, key=key).load()


LOG = "op string, position bigint, before map<string,variant>, after map<string,variant>"


def snapshot_and_log(snapshot: DataFrame, log: DataFrame, key: str, value: str = "value") -> DataFrame:
    """The same of a table and all of its log so far (JSON lines), as op, position, key_ and row (an open record)."""
    changes = inputs.parsed(log, LOG, value).withColumn("row", F.coalesce("after", "before")).select("op", "position", records.field(F.col("row"), key, "string").alias("key_"), "row")
    named = changes.select(F.col("key_").alias("named_")).distinct()
    whole = F.from_json(F.to_json(F.struct("*")), records.RECORD)
    rows = snapshot.select(F.lit("r").alias("op"), F.lit(None).cast("bigint").alias("position"), F.col(key).cast("string").alias("key_"), whole.alias("row"))
    return rows.join(named, F.col("key_") == F.col("named_"), "left_anti").unionByName(changes)
