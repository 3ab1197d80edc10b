"""Click logs: split, displays, repaired visitor flags, unique visits, bounces. Rows have the columns of schemas.LOG.

Rows may have a column record beside these, the log as it came (inputs.open_logs): it goes along, is repaired alike, and
displays are then whole records as well.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import records
from ..functions.scalars import day, is_entry


class Split(NamedTuple):
    start: DataFrame
    page: DataFrame
    display: DataFrame


def split_log(logs: DataFrame) -> Split:
    """Start records (a start object that isn't empty), page records (all others), and the displays of page records."""
    started = F.coalesce(F.size("start") > 0, F.lit(False))
    page = logs.where(~started)
    return Split(logs.where(started), page, explode_displays(page))


def split_rows(logs: DataFrame) -> DataFrame:
    """The same as one frame and in one pass: kind (start, page or display), and mid, item, page_id and ts, null where the kind has none."""
    started = F.coalesce(F.size("start") > 0, F.lit(False))
    row = lambda kind, mid, item: F.struct(F.lit(kind).alias("kind"), mid.cast("string").alias("mid"), item.cast("string").alias("item"), F.col("page.page_id").alias("page_id"), F.col("ts"))
    none, mid = F.lit(None), F.col("common.mid")
    shown = F.transform(F.coalesce("displays", F.array()), lambda d: row("display", none, d["item"]))
    own = F.when(started, F.array(row("start", mid, none))).otherwise(F.concat(F.array(row("page", mid, F.col("page.item"))), shown))
    return logs.select(F.explode(own).alias("r")).select("r.*")


def explode_displays(page: DataFrame) -> DataFrame:
    """A row for each display, with its page's id and time; of open logs the whole display, these two put into its record."""
    if "record" in page.columns:
        shown = page.select(F.explode(records.field(F.col("record"), "displays", "array<variant>")).alias("v"), F.col("page.page_id").alias("page_id"), "ts")
        shown = shown.select(F.try_variant_get("v", "$", records.RECORD).alias("d"), "page_id", "ts").where("d is not null")
        whole = records.put(F.col("d"), ts=F.col("ts"), page_id=F.col("page_id"))
        return shown.select(*(records.field(F.col("d"), c, "string").alias(c) for c in ("item_type", "item")), "page_id", "ts", whole.alias("record"))
    rows = page.select(F.explode("displays").alias("d"), F.col("page.page_id").alias("page_id"), "ts")
    return rows.select("d.*", "page_id", "ts")


def repair_is_new(logs: DataFrame) -> DataFrame:
    """Batch form: a visitor claimed new on another day than the visitor's first such day isn't new.

    The first days are aggregated before they are shuffled, and a small table beside the logs.
    """
    mid, new = F.col("common.mid"), F.col("common.is_new") == "1"
    first = logs.where(new & mid.isNotNull()).groupBy(mid.alias("mid_")).agg(day(F.min("ts")).alias("first_"))
    rows = logs.join(first, mid == F.col("mid_"), "left")
    return not_new(rows, F.coalesce(new & (day(F.col("ts")) != F.col("first_")), F.lit(False))).select(*logs.columns)


def not_new(logs: DataFrame, where: Column) -> DataFrame:
    """logs whose flag is taken back where it is wrong, in their record too."""
    out = {"common": F.when(where, F.col("common").withField("is_new", F.lit("0"))).otherwise(F.col("common"))}
    if "record" in logs.columns:
        out["record"] = F.when(where, records.put_in(F.col("record"), "common", "is_new", F.lit("0"))).otherwise(F.col("record"))
    return logs.withColumns(out)


def unique_visits(page: DataFrame, order: list[str]) -> DataFrame:
    """Batch form: the first entry page of each visitor and day, by ts and then the columns of order.

    The whole row goes along with the least (ts, order), so a busy visitor is combined before the shuffle.
    """
    entries = page.where(is_entry(F.col("page.last_page_id")) & F.col("common.mid").isNotNull())
    first = entries.groupBy(F.col("common.mid").alias("mid_"), day(F.col("ts")).alias("day_")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in page.columns)), F.struct("ts", *order)).alias("row_"))
    return first.select("row_.*")


def bounces(page: DataFrame, order: list[str], gap_ms: int = 10_000) -> DataFrame:
    """Batch form: entry pages whose visitor's next record comes gap_ms later or more, or never.

    Only the record right after counts. One within the gap ends the wait, whether it continues the visit (a page id) or
    not; it may itself be an entry page that waits anew.
    """
    following = Window.partitionBy("common.mid").orderBy("ts", *order)
    rows = page.where(F.col("common.mid").isNotNull()).withColumn("next_", F.lead("ts").over(following))
    late = F.col("next_").isNull() | (F.col("next_") - F.col("ts") >= gap_ms)
    return rows.where(is_entry(F.col("page.last_page_id")) & late).drop("next_")
