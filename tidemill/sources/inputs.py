"""Inputs: JSON lines from files or Kafka, change records, dimensions, literals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..functions.scalars import operation, topic_parts
from ..schemas import CONFIG_CHANGE, DEBEZIUM, LOG


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of text lines, column value."""
    return spark.readStream.text(path)


def kafka(spark: SparkSession, servers: str, topics: str, stream: bool = True, latest: bool = False, **options: str) -> DataFrame:
    """Column value of the topics' records; needs Spark's Kafka package on the class path."""
    reader = spark.readStream if stream else spark.read
    reader = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    if latest:
        reader = reader.option("startingOffsets", "latest")
    return reader.options(**options).load().select(F.col("value").cast("string").alias("value"))


def parsed(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON lines as columns of schema; lines that aren't such objects are dropped."""
    return _objects(df, value).select(F.from_json(value, schema).alias("r")).select("r.*")


def _objects(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is a JSON object; from_json alone makes a row of nulls of anything else."""
    return df.where(F.json_object_keys(value).isNotNull())


def open_records(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines as open records (functions.records), column record; lines that aren't objects are dropped."""
    return df.select(records.record(F.col(value)).alias("record")).where("record is not null")


def open_logs(df: DataFrame, value: str = "value") -> DataFrame:
    """Click logs with the columns of schemas.LOG, and the whole record with every field it came with, column record."""
    both = df.select(F.from_json(value, LOG).alias("log"), records.record(F.col(value)).alias("record"))
    return both.where("record is not null").select("log.*", "record")


def as_view(df: DataFrame, name: str, time: str | None = None, delay: str = "3 seconds") -> DataFrame:
    """A named view for SQL, with a watermark on its time column on streams."""
    if time and df.isStreaming:
        df = df.withWatermark(time, delay)
    df.createOrReplaceTempView(name)
    return df


def changes(df: DataFrame, value: str = "value", values: str = "string") -> DataFrame:
    """Debezium change records as database, table, type, data; data holds the row after the change and is empty on deletes.

    values: the type of data's values; with variant they are what they were.
    """
    r = _objects(df, value).select(F.from_json(value, DEBEZIUM.replace("map<string,string>", f"map<string,{values}>")).alias("r")).select("r.*")
    return r.select(F.col("source.db").alias("database"), F.col("source.table").alias("table"), operation(F.col("op")).alias("type"), F.coalesce("after", F.create_map().cast(f"map<string,{values}>")).alias("data"))


def changes_of_topics(df: DataFrame, topic: str = "topic", op: str = "op", after: str = "after") -> DataFrame:
    """The same from columns topic `server.database.table`, op and after."""
    database, table = topic_parts(F.col(topic))
    return df.select(database.alias("database"), table.alias("table"), operation(F.col(op)).alias("type"), F.coalesce(after, F.create_map().cast("map<string,string>")).alias("data"))


def config_changes(df: DataFrame, value: str = "value") -> DataFrame:
    return parsed(df, CONFIG_CHANGE, value)


def dimension(spark: SparkSession, path: str, where: dict[str, str] | None = None) -> DataFrame:
    """A dimension table, by equality conditions if any; values are compared as columns, never put into SQL text."""
    df = spark.read.parquet(path)
    for name, value in (where or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def literals(spark: SparkSession, rows: Sequence[str]) -> DataFrame:
    """Given JSON lines, column value."""
    return spark.createDataFrame([(x,) for x in rows], "value string")
