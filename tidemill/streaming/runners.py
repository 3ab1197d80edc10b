"""The layered jobs as streaming queries: each reads a layer's files and writes the next one's, with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keywords import Tokenizer
from ..functions.scalars import seconds_of
from ..operators import stats, wide
from ..operators.changes import current_config, new_dimensions, route, sane
from ..operators.logs import split_log
from ..schemas import KEYWORD_STATS, PRODUCT_STATS, PROVINCE_STATS, VISITOR_STATS
from ..sources.outputs import Batch, DimensionTable, routed_sink, table_sink
from . import stateful

#: Dimension tables by name, as frames or as keyed tables: each batch calls it anew, so that it sees what has changed.
Dimensions = Callable[[], dict[str, "DataFrame | DimensionTable"]]


def _enriched(sink: Batch, join: Callable[[DataFrame], DataFrame]) -> Batch:
    """A sink for rows with dimensions; the batch is kept, since keyed tables ask for its keys."""

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            sink(join(df), batch)
        finally:
            df.unpersist()

    return write


def start(df: DataFrame, sink: Batch, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Every batch through sink; finished input ends the query with availableNow=True (the default)."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def log_layer(logs: DataFrame, out: str, checkpoint: str, sink: Callable[[str], Batch] = table_sink, **trigger: object) -> StreamingQuery:
    """Repaired logs into start, page and display tables, all in one pass over a batch; open logs into such, or by record_sink."""
    sinks = {n: sink(f"{out}/{n}") for n in ("start", "page", "display")}

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for name, part in split_log(df)._asdict().items():
                sinks[name](part, batch)
        finally:
            df.unpersist()

    return start(stateful.repair_is_new(stateful.with_event_time(logs)), write, checkpoint, **trigger)


def change_layer(changes: DataFrame, config: Callable[[], DataFrame], out: str, checkpoint: str, dims: Callable[[str], DimensionTable], order: list[str], facts: Batch | None = None, name: str = "changes", **trigger: object) -> StreamingQuery:
    """Changes to dimension tables and per-record topics; config is read anew for each batch.

    A repeated batch changes nothing: dimensions know the last batch of each job by its name, topics replace or know theirs.
    """
    facts = facts or routed_sink(f"{out}/facts")

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            routed = route(sane(df), config())
            facts(routed.fact, batch)
            # as many names as the routing table has
            for row in routed.dimension.select("sink_table").distinct().collect():
                dims(row.sink_table).upsert(routed.dimension.where(routed.dimension.sink_table == row.sink_table), order, batch=(name, batch))
        finally:
            df.unpersist()

    return start(changes, write, checkpoint, **trigger)


def visit_layer(page: DataFrame, out: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    return start(stateful.unique_visits(stateful.with_event_time(page)), table_sink(f"{out}/unique_visit"), checkpoint, **trigger)


def bounce_layer(page: DataFrame, out: str, checkpoint: str, gap_ms: int = 10_000, **trigger: object) -> StreamingQuery:
    return start(stateful.bounces(stateful.with_event_time(page), gap_ms), table_sink(f"{out}/user_jump"), checkpoint, **trigger)


def config_dimensions(spark: SparkSession, changes: DataFrame, order: list[str], path: str) -> tuple[DataFrame, dict[str, DimensionTable]]:
    """The current routing table of config changes, and the dimension tables it asks for, by name."""
    config = current_config(changes, order)
    # a row for each dimension table
    wanted = new_dimensions(config).collect()
    return config, {r.sink_table: DimensionTable(spark, f"{path}/{r.sink_table}", r.sink_columns, r.sink_pk) for r in wanted}


def order_wide_layer(orders: DataFrame, details: DataFrame, dims: Dimensions, as_of: Column, out: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Orders and details that come within five seconds of each other, with their six dimensions. Both have create_time."""
    rows = wide.order_wide(wide.timed(orders, "order_time"), wide.timed(details, "detail_time"))
    return start(rows, _enriched(table_sink(out), lambda df: wide.with_dimensions(df, **dims(), as_of=as_of)), checkpoint, **trigger)


def payment_wide_layer(payments: DataFrame, orders: DataFrame, out: str, checkpoint: str, delay: str = "3 seconds", **trigger: object) -> StreamingQuery:
    """Payments with the order-wide rows (with order_time) of the half hour before."""
    return start(wide.payment_wide(wide.timed(payments, "pay_time"), orders.withWatermark("order_time", delay)), table_sink(out), checkpoint, **trigger)


def visitor_layer(page: DataFrame, visits: DataFrame, jumps: DataFrame, out: str, checkpoint: str, delay: str = "3 seconds", **trigger: object) -> StreamingQuery:
    """Visitor statistics of page views, unique visits and bounces, watermarked after their union."""
    measures = stats.visitor_measures(page, visits, jumps).withColumn("time", F.timestamp_millis("ts")).withWatermark("time", delay)
    return start(stats.stamped(stats.visitor_stats(measures, "time")).select(*VISITOR_STATS), table_sink(out), checkpoint, **trigger)


def product_layer(dims: Dimensions, out: str, checkpoint: str, delay: str = "3 seconds", **sources: DataFrame) -> StreamingQuery:
    """Product statistics of any of the seven sources (each with time), with their four dimensions joined after the aggregation."""
    rows = stats.product_stats(stats.product_measures(**sources).withWatermark("time", delay))
    return start(rows, _enriched(table_sink(out), lambda df: stats.stamped(stats.with_product_dimensions(df, **dims())).select(*PRODUCT_STATS)), checkpoint)


def province_layer(orders: DataFrame, out: str, checkpoint: str, delay: str = "3 seconds", **trigger: object) -> StreamingQuery:
    """Statistics by province of order-wide rows."""
    keys = {"province_id": "province_id", "province_name": "province_name", "area_code": "province_area_code", "iso_code": "province_iso_code", "iso_3166_2": "province_3166_2_code"}
    rows = orders.select(*(F.col(c).alias(k) for k, c in keys.items()), "order_id", "split_total_amount", "order_time").withWatermark("order_time", delay)
    return start(stats.stamped(stats.province_stats(rows, list(keys), "order_time")).select(*PROVINCE_STATS), table_sink(out), checkpoint, **trigger)


def keyword_layer(page: DataFrame, out: str, checkpoint: str, delay: str = "3 seconds", tokenize: Tokenizer | None = None, **trigger: object) -> StreamingQuery:
    """Statistics of searched keywords; times are cut to seconds."""
    rows = stats.searched(page.withColumn("time", seconds_of(F.col("ts"))).withWatermark("time", delay))
    return start(stats.stamped(stats.keyword_stats(rows, "fullword", "time", tokenize=tokenize)).select(*KEYWORD_STATS), table_sink(out), checkpoint, **trigger)
