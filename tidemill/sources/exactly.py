"""Sinks that leave one copy of a batch, however often it is tried: by staged files or rows, and a ledger of batches.

Topics: each record goes to a file of the topic that it names. Tasks write files under names of their own, which nobody
reads yet; the commit lists those of the tasks that counted in one ledger entry for the batch, and readers read what ledgers
list. A batch that has an entry is dropped, its files removed; an aborted one leaves none of those it knows, and `tidy`
removes what lost tasks have left. JDBC: a batch is staged in a table of its own; one transaction moves its rows and puts its
number into a ledger table.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .outputs import Batch

TOPICS = "tidemill_topics"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    """Files of a task: (topic, name, records)."""

    files: list[tuple[str, str, int]]


class TopicWriter(DataSourceStreamWriter, DataSourceWriter):
    """Writes rows (topic, value) as lines; a null topic or value is left out."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.batch, self.ledger = options["path"].rstrip("/"), options.get("batch"), options.get("ledger", "ledger")

    def write(self, iterator: Iterator) -> Staged:
        store, base = _store(self.path)
        open_, counts = {}, {}
        try:
            for row in iterator:
                topic, value = row[0], row[1]
                if topic is None or value is None:
                    continue
                if topic not in open_:
                    name = f"{uuid.uuid4().hex}.jsonl"
                    folder = f"{base}/topics/topic={quote(topic, safe='')}"
                    store.create_dir(folder, recursive=True)
                    open_[topic] = (name, store.open_output_stream(f"{folder}/{name}"))
                    counts[topic] = 0
                open_[topic][1].write(value.encode().replace(b"\n", b" ") + b"\n")
                counts[topic] += 1
        finally:
            for _, out in open_.values():
                out.close()
        return Staged([(t, name, counts[t]) for t, (name, _) in open_.items()])

    def _drop(self, messages: Iterable[Staged | None]) -> None:
        store, base = _store(self.path)
        for m in messages:
            for topic, name, _ in m.files if m else ():
                at = f"{base}/topics/topic={quote(topic, safe='')}/{name}"
                if store.get_file_info(at).type != fs.FileType.NotFound:
                    store.delete_file(at)

    def commit(self, messages: list[Staged | None], batchId: int | None = None) -> None:  # noqa: N803
        batch = int(self.batch if batchId is None else batchId)
        store, base = _store(self.path)
        entry = f"{base}/{self.ledger}/{batch:012d}.json"
        if store.get_file_info(entry).type != fs.FileType.NotFound:
            self._drop(messages)  # written before
            return
        files = [{"topic": t, "name": n, "records": k, "batch": batch} for m in messages if m for t, n, k in m.files]
        store.create_dir(f"{base}/{self.ledger}", recursive=True)
        temporary = f"{base}/{self.ledger}/.{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            out.write("".join(json.dumps(x) + "\n" for x in files).encode())
        store.move(temporary, entry)

    def abort(self, messages: list[Staged | None], batchId: int | None = None) -> None:  # noqa: N803
        self._drop(messages)


class TopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return TOPICS

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TopicWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return TopicWriter(self.options)


def topic_rows(df: DataFrame, route: str = "sink_table", payload: str = "data") -> DataFrame:
    """topic and value, each record's payload as JSON."""
    return df.select(F.col(route).alias("topic"), F.to_json(payload).alias("value"))


def topics_sink(path: str, route: str = "sink_table", payload: str = "data", ledger: str = "ledger") -> Batch:
    """For batches of a stream; `topic_rows` of a stream can also be written by format(TOPICS). One ledger for each job."""

    def write(df: DataFrame, batch: int) -> None:
        df.sparkSession.dataSource.register(TopicSource)
        topic_rows(df, route, payload).write.format(TOPICS).option("path", path).option("batch", str(batch)).option("ledger", ledger).mode("append").save()

    return write


def read_topics(spark: SparkSession, path: str, ledger: str = "ledger") -> DataFrame:
    """topic, value and batch of all records in files that the ledger lists."""
    listed = spark.read.schema("topic string, name string, records bigint, batch bigint").json(f"{path}/{ledger}")
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{path}/topics").select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_"))
    return lines.join(listed, F.col("file_") == F.col("name")).select("topic", "value", "batch")


def tidy(spark: SparkSession, path: str, ledgers: Iterable[str] = ("ledger",), older_s: float = 3600) -> int:
    """Remove files of topics that no ledger lists and that are older than any running batch; their number."""
    store, base = _store(path)
    listed = {r["name"] for n in ledgers for r in spark.read.schema("name string").json(f"{path}/{n}").toLocalIterator()}
    stale = [x.path for x in store.get_file_info(fs.FileSelector(f"{base}/topics", recursive=True)) if x.type == fs.FileType.File and x.base_name not in listed and (x.mtime_ns or 0) / 1e9 < time.time() - older_s]
    for at in stale:
        store.delete_file(at)
    return len(stale)


_NAME = re.compile(r"\w+")


def exact_jdbc_sink(url: str, table: str, columns: Iterable[str], job: str = "job", size: int = 5000, **options: str) -> Batch:
    """Rows into a table once: staged by Spark, then moved in one transaction that also enters the batch into a ledger table.

    A batch that the ledger knows is dropped; a stage that a failed attempt left is replaced. job: one name for each query.
    """
    names = list(columns)
    stage, ledger = f"{table}_stage_{job}", f"{table}_ledger"
    if any(not _NAME.fullmatch(n) for n in (table, job, *names)):
        raise ValueError("table, job and columns are to be plain names")

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        connect = lambda: _connect(spark, url, options)
        c = connect()
        try:
            _ensure(c, ledger, "job varchar(200) not null, batch bigint not null, primary key (job, batch)")
            if _known(c, ledger, job, batch):
                return
        finally:
            c.close()
        rows = df.select(*names)
        writer = lambda to, mode: rows.write.format("jdbc").options(url=url, dbtable=to, batchsize=str(size), **options).mode(mode).save()
        writer(stage, "overwrite")
        c = connect()
        try:
            if not _exists(c, table):
                rows.limit(0).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
            c.setAutoCommit(False)
            quoted = ", ".join(f'"{n}"' for n in names)
            with_ = c.createStatement()
            try:
                enter = c.prepareStatement(f"insert into {ledger} (job, batch) values (?, ?)")
                enter.setString(1, job)
                enter.setLong(2, batch)
                enter.executeUpdate()  # a batch that came meanwhile fails here, by the key
                with_.executeUpdate(f"insert into {table} ({quoted}) select {quoted} from {stage}")
                c.commit()
            except Exception:
                c.rollback()
                raise
            with_.executeUpdate(f"drop table {stage}")
            c.commit()
        finally:
            c.close()

    return write


def _connect(spark: SparkSession, url: str, options: dict[str, str]):  # noqa: ANN202
    """A connection of the driver's JVM."""
    if "driver" in options:
        spark._jvm.java.lang.Class.forName(options["driver"], True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    properties = spark._jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    return spark._jvm.java.sql.DriverManager.getConnection(url, properties)


def _exists(c, table: str) -> bool:  # noqa: ANN001
    found = c.getMetaData().getTables(None, None, None, None)
    while found.next():
        if found.getString("TABLE_NAME").lower() == table.lower():
            return True
    return False


def _ensure(c, table: str, columns: str) -> None:  # noqa: ANN001
    if not _exists(c, table):
        c.createStatement().executeUpdate(f"create table {table} ({columns})")


def _known(c, ledger: str, job: str, batch: int) -> bool:  # noqa: ANN001
    ask = c.prepareStatement(f"select 1 from {ledger} where job = ? and batch = ?")
    ask.setString(1, job)
    ask.setLong(2, batch)
    return ask.executeQuery().next()
