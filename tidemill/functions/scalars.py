"""Column functions; all built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "yyyy-MM-dd HH:mm:ss"


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def day(ms: Column) -> Column:
    """Epoch milliseconds as yyyyMMdd in the session's zone."""
    return F.date_format(from_millis(ms), "yyyyMMdd")


def seconds_of(ms: Column) -> Column:
    """The timestamp of epoch milliseconds cut to seconds, by integer division."""
    return F.timestamp_seconds(F.floor(ms / 1000))


def text_time(t: Column) -> Column:
    return F.date_format(t, FORMAT)


def time_of(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(FORMAT))


def millis_of(text: Column) -> Column:
    return F.unix_millis(time_of(text))


def is_entry(last_page_id: Column) -> Column:
    """A page without a page before it: null or empty."""
    return F.coalesce(last_page_id, F.lit("")) == ""


def age(birthday: Column, as_of: Column) -> Column:
    """Whole years of 365 days."""
    return F.floor(F.datediff(as_of, F.try_to_date(birthday)) / 365).cast("int")


def route_key(table: Column, kind: Column) -> Column:
    return F.concat_ws(":", table, kind)


def operation(op: Column) -> Column:
    """Change kinds in lower case, create as insert, a bootstrapped insert as insert."""
    op = F.lower(op)
    return F.when(op.isin("create", "c", "r", "bootstrap-insert"), "insert").when(op == "u", "update").when(op == "d", "delete").otherwise(op)


def whitelisted(data: Column, columns: Column) -> Column:
    """The entries of data whose keys are among the comma-separated columns (not trimmed)."""
    names = F.split(columns, ",")
    return F.map_filter(data, lambda k, _: F.array_contains(names, k))


def topic_parts(topic: Column) -> tuple[Column, Column]:
    """Database and table of a change topic `server.database.table`."""
    return F.split_part(topic, F.lit("."), F.lit(2)), F.split_part(topic, F.lit("."), F.lit(3))


def window_text(window: str = "window") -> tuple[Column, Column]:
    """stt and edt of a window column."""
    return text_time(F.col(f"{window}.start")).alias("stt"), text_time(F.col(f"{window}.end")).alias("edt")
