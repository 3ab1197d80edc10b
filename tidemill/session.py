"""One place for session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str = "local[*]", partitions: int = 8, **settings: str) -> SparkSession:
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false"} | settings
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()
