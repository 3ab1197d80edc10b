"""Routing by a config that changes while events arrive: each event meets the config as it was when the event came.

Events and config changes carry arrival, one order over both (a change before the events of the same place). An event goes
where the last config change of its table and operation before it says; if there is none, or that was a delete, the event is
dropped, and counted. Later changes don't reach back.

Batch form: config changes become versions with a first and a next arrival. Where a table and operation has few, they are
broadcast, and an event looks through those of its own. Else events and versions are sorted together, and each event takes the
version last seen: work grows with rows, however many versions there are. Arrivals are cut into ranges of like numbers of rows,
and a version stands in every range that it reaches into, so ranges of one busy table are sorted apart. Stream form:
streaming.stateful.routed_by_arrival, where each part of a key keeps its current config as state.

Events whose table, operation or arrival is null are dropped. Of changes of one key and arrival one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import whitelisted
from ..schemas import TO_DIMENSION, TO_TOPIC
from .changes import Routed

ROUTE = ("sink_type", "sink_table", "sink_columns", "sink_pk", "sink_extend")
#: Versions of configs up to which they are broadcast, and of one table and operation, since an event looks through them all.
VERSIONS = 100_000
OF_ONE = 100
#: Ranges of arrival (on streams, parts) that the events of one table and operation are dealt to, so that a busy table isn't one task's.
PARTS = 16


def versions(changes: DataFrame, order: str = "arrival") -> DataFrame:
    """Config changes (type, data, order) with from_ and next_: the arrivals between which each held; null: to this day."""
    named = [F.col(f"data.{c}").alias(c) for c in ("source_table", "operate_type", *ROUTE)]
    flat = changes.select(F.lower("type").alias("change_"), *named, F.col(order).alias("from_"))
    # configs are few; the changes of one table and operation fewer still
    later = F.lead("from_").over(Window.partitionBy("source_table", "operate_type").orderBy("from_"))
    return flat.withColumn("next_", later)


def routed_by_arrival(events: DataFrame, changes: DataFrame, order: str = "arrival") -> DataFrame:
    """Events (table, type, data, order) with their sink and listed data, and fate: dimension, topic or dropped."""
    c = F.col
    n = changes.groupBy("data.source_table", "data.operate_type").count().agg(F.sum("count").alias("all"), F.max("count").alias("of_one")).first()
    if (n["all"] or 0) > VERSIONS or (n["of_one"] or 0) > OF_ONE:
        return judged(last_seen(events, changes, order), c("change_"))
    held = F.broadcast(versions(changes, order))
    inside = (c("from_") <= c(order)) & (c("next_").isNull() | (c("next_") > c(order)))
    met = events.join(held, (c("table") == c("source_table")) & (events["type"] == c("operate_type")) & inside, "left")
    return judged(met, c("change_"))


def last_seen(events: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Events with the version that held, by sorting both together within ranges of arrival."""
    c = F.col
    # a version that the next one of the same arrival replaces never holds
    held = versions(changes, order).where(c("source_table").isNotNull() & c("operate_type").isNotNull() & c("from_").isNotNull() & (c("next_").isNull() | (c("next_") > c("from_"))))
    cuts = cut(events.select(c(order).alias("at_")).union(changes.select(order)))
    last = F.when(c("next_").isNotNull(), range_of(c("next_"), cuts)).otherwise(len(cuts))
    reaches = F.sequence(range_of(c("from_"), cuts), last)
    told = held.select(
        c("source_table").alias("table"), c("operate_type").alias("type"), F.explode(reaches).alias("part_"), c("from_").alias("at_"),
        F.lit(False).alias("event_"), F.struct("change_", *ROUTE).alias("held_"),
    )
    # events without an arrival have a range that holds no version
    came = events.select("*", F.when(c(order).isNotNull(), range_of(c(order), cuts)).alias("part_"), c(order).alias("at_"), F.lit(True).alias("event_"))
    so_far = Window.partitionBy("table", "type", "part_").orderBy("at_", "event_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = came.unionByName(told, allowMissingColumns=True).withColumn("held_", F.last("held_", True).over(so_far)).where("event_")
    return met.select("*", "held_.*").drop("part_", "at_", "event_")


def cut(arrived: DataFrame) -> list:
    """Arrivals at which ranges of like numbers of rows begin. None (so one range) where they are neither numbers nor times."""
    kind, steps = arrived.schema["at_"].dataType, [k / PARTS for k in range(1, PARTS)]
    if not isinstance(kind, T.NumericType | T.TimestampType):
        return []
    found = arrived.agg(F.percentile_approx("at_", steps).alias("at_"))
    # times as Spark's literals, since Python's know hours that come twice
    if isinstance(kind, T.TimestampType):
        micros = found.select(F.transform("at_", F.unix_micros)).first()[0]
        return [F.timestamp_micros(F.lit(m)) for m in sorted(set(micros or []))]
    return sorted({x for x in found.first()[0] or [] if x == x})


def range_of(at: Column, cuts: list, first: int = 0) -> Column:
    """How many cuts lie at or before an arrival, by halving."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(at < cuts[half], range_of(at, cuts[:half], first)).otherwise(range_of(at, cuts[half + 1 :], first + half + 1))


def judged(met: DataFrame, change: Column) -> DataFrame:
    """Rows with the config they met: data as it lists, and their fate."""
    c = F.col
    holds = change.isNotNull() & (change != "delete")
    fate = F.when(holds & (c("sink_type") == TO_DIMENSION), "dimension").when(holds & (c("sink_type") == TO_TOPIC), "topic").otherwise("dropped")
    return met.withColumn("fate", fate).withColumn("data", F.when(c("fate") != "dropped", whitelisted(c("data"), c("sink_columns"))).otherwise(c("data"))).drop("source_table", "operate_type", "sink_columns", "from_", "next_", "held_", "change_")


def split(routed: DataFrame) -> Routed:
    return Routed(routed.where("fate = 'dimension'"), routed.where("fate = 'topic'"))


def dropped(routed: DataFrame) -> DataFrame:
    """How many events of each table and operation met no config."""
    return routed.where("fate = 'dropped'").groupBy("table", "type").agg(F.count("*").alias("n"))
