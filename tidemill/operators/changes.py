"""Business change records: sanity filter and routing by a configuration table. Works on streams as well."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import operation, whitelisted
from ..schemas import CONFIG, TO_DIMENSION, TO_TOPIC

#: Rows up to which a routing table is broadcast; larger ones are joined as Spark plans it.
CONFIG_ROWS = 10_000


class Routed(NamedTuple):
    dimension: DataFrame
    fact: DataFrame


def sane(rows: DataFrame) -> DataFrame:
    """Rows with a table name and data (more than an empty object), with repaired kinds."""
    kept = rows.where((F.coalesce("table", F.lit("")) != "") & F.col("data").isNotNull() & (F.length(F.to_json("data")) > 3))
    return kept.withColumn("type", operation(F.col("type")))


def current_config(changes: DataFrame, order: list[str]) -> DataFrame:
    """The routing table after config changes: the last one of each table and operation by order; a delete removes it."""
    names = [x.split()[0] for x in CONFIG.split(", ")]
    flat = changes.select("type", *(F.col(f"data.{n}").alias(n) for n in names), *order)
    last = Window.partitionBy("source_table", "operate_type").orderBy(*(F.desc(o) for o in order))
    return flat.withColumn("row_", F.row_number().over(last)).where("row_ = 1 and type <> 'delete'").select(*names)


def route(rows: DataFrame, config: DataFrame) -> Routed:
    """Rows whose table and operation the config sends somewhere, with sink_table and only the listed columns of data.

    config has one row for each source_table and operate_type.
    """
    config = config.select("source_table", "operate_type", "sink_type", "sink_table", "sink_columns", "sink_pk", "sink_extend")
    if config.limit(CONFIG_ROWS + 1).count() <= CONFIG_ROWS:
        config = F.broadcast(config)
    met = rows.join(config, (rows["table"] == config["source_table"]) & (rows["type"] == config["operate_type"]))
    met = met.withColumn("data", whitelisted(F.col("data"), F.col("sink_columns"))).drop("source_table", "operate_type", "sink_columns")
    return Routed(met.where(F.col("sink_type") == TO_DIMENSION), met.where(F.col("sink_type") == TO_TOPIC))


def new_dimensions(config: DataFrame) -> DataFrame:
    """The dimension tables that a config asks to have: name, columns, key, extension with their defaults."""
    rows = config.where((F.col("sink_type") == TO_DIMENSION) & (F.col("operate_type") == "insert"))
    filled = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
    return rows.select("sink_table", "sink_columns", filled("sink_pk", "id"), filled("sink_extend", "")).distinct()
