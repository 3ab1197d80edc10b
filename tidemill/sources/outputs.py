"""Outputs: tables and topics, one topic for each record, dimension upserts, JDBC, console. All for batches of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import KeyedTable as DimensionTable
from .keyed import dimension_schema

__all__ = ["Batch", "DimensionTable", "console_sink", "dimension_schema", "jdbc_sink", "json_lines", "kafka_sink", "record_sink", "routed_sink", "table_sink"]

Batch = Callable[[DataFrame, int], None]


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def table_sink(path: str) -> Batch:
    """Append to Parquet, a folder for each batch: a repeated batch replaces its own folder only."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def record_sink(path: str, record: str = "record") -> Batch:
    """Open records as JSON lines, a folder for each batch."""
    return lambda df, batch: df.select(F.to_json(record).alias("value")).where("value is not null").write.mode("overwrite").text(f"{path}/batch={batch}")


def routed_sink(path: str, route: str = "sink_table", payload: str = "data") -> Batch:
    """Each record's payload below the folder of its own route."""

    def write(df: DataFrame, batch: int) -> None:
        rows = df.where(F.col(route).isNotNull()).select(F.lit(batch).alias("batch"), route, F.to_json(payload).alias("value"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", route).parquet(path)

    return write


def kafka_sink(servers: str, topic: str | None = None, route: str = "sink_table", payload: str = "data") -> Batch:
    """To one topic, or to the topic each record names. At least once; needs Spark's Kafka package."""

    def write(df: DataFrame, _: int) -> None:
        rows = json_lines(df).withColumn("topic", F.lit(topic)) if topic else df.select(F.col(route).alias("topic"), F.to_json(payload).alias("value"))
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()

    return write


def jdbc_sink(url: str, table: str, columns: Iterable[str], size: int = 5000, **options: str) -> Batch:
    """Rows into a table by the columns named, in that order; others (transient ones) stay out."""
    return lambda df, _: df.select(*columns).write.format("jdbc").options(url=url, dbtable=table, batchsize=str(size), **options).mode("append").save()


def console_sink(tag: str, rows: int = 20) -> Batch:
    def write(df: DataFrame, batch: int) -> None:
        print(f"{tag}, batch {batch}")
        df.show(rows, truncate=False)

    return write
