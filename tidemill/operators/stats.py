"""Tumbling-window statistics by visitor, product, province and keyword. Works on streams with a watermark on the time.

Sums ignore nulls; rows without a product are left out. Distinct orders are exact, without sets: a first aggregation has a
row for each window, key and order, a second one counts these, on streams with a state for each that ends with the window.
Dimensions are joined after the aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from ..functions.keywords import Tokenizer, exploded
from ..functions.scalars import day, is_entry, window_text
from ..schemas import APPRAISE_GOOD, KEYWORD_SEARCH
from .dimensions import look_up

VISITOR_KEYS = ["vc", "ch", "ar", "is_new"]
VISITOR_MEASURES = ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]
PRODUCT_SUMS = ["display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num", "order_amount", "payment_amount", "refund_amount", "comment_ct", "good_comment_ct"]
PRODUCT_ORDERS = {"order_ct": "order_id", "paid_order_ct": "paid_order_id", "refund_order_ct": "refund_order_id"}


def visitor_measures(page: DataFrame, visits: DataFrame, jumps: DataFrame) -> DataFrame:
    """Page views, unique visits and bounces as rows of equal columns, with ts."""

    def shaped(rows: DataFrame, **measures: Column) -> DataFrame:
        return rows.select(*(F.col(f"common.{k}").alias(k) for k in VISITOR_KEYS), *(measures.get(m, F.lit(0)).cast("long").alias(m) for m in VISITOR_MEASURES), "ts")

    one = F.lit(1)
    viewed = shaped(page, pv_ct=one, sv_ct=F.when(is_entry(F.col("page.last_page_id")), 1).otherwise(0), dur_sum=F.col("page.during_time"))
    return viewed.unionByName(shaped(visits, uv_ct=one)).unionByName(shaped(jumps, uj_ct=one))


def page_measures(page: DataFrame, order: list[str], gap_ms: int = 10_000) -> DataFrame:
    """Batch form: the same sums in one pass over page, a row for each view that also counts as a visit and a bounce where it is one.

    Both are found in one order of each visitor's rows, where logs.unique_visits and logs.bounces go over page by themselves.
    """
    mid, entry = F.col("common.mid"), is_entry(F.col("page.last_page_id"))
    following = Window.partitionBy("mid_").orderBy("ts", *order)
    # a day's first entry: by the same exchange, since its visitor's rows are together
    of_day = Window.partitionBy("mid_", "day_", "entry_").orderBy("ts", *order)
    rows = page.withColumns({"mid_": mid, "day_": day(F.col("ts")), "entry_": entry})
    rows = rows.withColumns({"next_": F.lead("ts").over(following), "place_": F.row_number().over(of_day)})
    known = F.col("entry_") & F.col("mid_").isNotNull()
    late = F.col("next_").isNull() | (F.col("next_") - F.col("ts") >= gap_ms)
    flag = lambda c: F.when(c, 1).otherwise(0).cast("long")
    return rows.select(*(F.col(f"common.{k}").alias(k) for k in VISITOR_KEYS), flag(known & (F.col("place_") == 1)).alias("uv_ct"), F.lit(1).cast("long").alias("pv_ct"), flag(F.col("entry_")).alias("sv_ct"), flag(known & late).alias("uj_ct"), F.col("page.during_time").cast("long").alias("dur_sum"), "ts")


def visitor_stats(measures: DataFrame, time: str, width: str = "10 seconds") -> DataFrame:
    rows = measures.groupBy(F.window(time, width), *VISITOR_KEYS).agg(*(F.sum(m).alias(m) for m in VISITOR_MEASURES))
    return rows.select(*window_text(), *VISITOR_KEYS, *VISITOR_MEASURES)


MEASURE_TYPES = {m: "decimal(16,2)" if m.endswith("_amount") else "long" for m in PRODUCT_SUMS}


def measure(sku: Column, **measures: Column) -> Column:
    """The measures of one product as a struct: those named, and zeros and nulls for the others."""
    sums = (measures.get(m, F.lit(0)).cast(t).alias(m) for m, t in MEASURE_TYPES.items())
    return F.struct(sku.try_cast("long").alias("sku_id"), *sums, *(measures.get(i, F.lit(None)).cast("long").alias(i) for i in PRODUCT_ORDERS.values()))


def measures_of(rows: DataFrame, *entries: Column, time: str = "time") -> DataFrame:
    """Rows of equal columns, as product_measures has them, of rows that each give several: structs by `measure`, or arrays of such.

    For tables that serve as several sources: one scan. An entry that is null, or has no product, is left out.
    """
    one = [F.array(e) if not isinstance(rows.select(e.alias("e")).schema["e"].dataType, ArrayType) else F.coalesce(e, F.array()) for e in entries]
    shown = rows.select(F.col(time).alias("time"), F.explode(F.concat(*one) if len(one) > 1 else one[0]).alias("m")).where("m.sku_id is not null")
    return shown.select("m.sku_id", "time", *(f"m.{c}" for c in (*MEASURE_TYPES, *PRODUCT_ORDERS.values())))


def product_measures(**sources: DataFrame) -> DataFrame:
    """Rows of equal columns from any of page, favor, cart, order, payment, refund and comment.

    page has the columns of a log, and time; the others sku_id, time, and order: order_id, sku_num, amount; payment: order_id,
    amount; refund: order_id, refund_amount; comment: appraise.
    """
    def shaped(rows: DataFrame, sku: str = "sku_id", **measures: Column) -> DataFrame:
        sums = (measures.get(m, F.lit(0)).cast(MEASURE_TYPES[m]).alias(m) for m in PRODUCT_SUMS)
        ids = (measures.get(i, F.lit(None)).cast("long").alias(i) for i in PRODUCT_ORDERS.values())
        return rows.select(F.col(sku).try_cast("long").alias("sku_id"), "time", *sums, *ids)

    one, c, parts = F.lit(1), F.col, []
    if page := sources.get("page"):
        clicks = page.where("page.page_id = 'good_detail' and page.item is not null").withColumn("sku_id", c("page.item"))
        shown = page.select("time", F.explode("displays").alias("d")).where("d.item_type = 'sku_id'").select("time", c("d.item").alias("sku_id"))
        parts += [shaped(clicks, click_ct=one), shaped(shown, display_ct=one)]
    simple = {"favor": {"favor_ct": one}, "cart": {"cart_ct": one}}
    simple["order"] = {"order_sku_num": c("sku_num"), "order_amount": c("amount"), "order_id": c("order_id")}
    simple["payment"] = {"payment_amount": c("amount"), "paid_order_id": c("order_id")}
    simple["refund"] = {"refund_amount": c("refund_amount"), "refund_order_id": c("order_id")}
    simple["comment"] = {"comment_ct": one, "good_comment_ct": F.when(c("appraise") == APPRAISE_GOOD, 1).otherwise(0)}
    parts += [shaped(sources[n], **m) for n, m in simple.items() if n in sources]
    return reduce(DataFrame.unionByName, parts).where("sku_id is not null")


def _again(rows: DataFrame, width: str) -> Column:
    """The window of rows that have one already; a stream's watermark follows the window's time into a second aggregation."""
    return F.window(F.window_time("window"), width).alias("window") if rows.isStreaming else F.col("window")


def product_stats(measures: DataFrame, width: str = "10 seconds", time: str = "time") -> DataFrame:
    """Sums and distinct orders by product. The order ids of one row are those of one order, or null."""
    sums = [F.sum(m).alias(m) for m in PRODUCT_SUMS]
    each = measures.groupBy(F.window(time, width), "sku_id", F.coalesce(*PRODUCT_ORDERS.values()).alias("order_"))
    each = each.agg(*sums, *(F.max(F.when(F.col(i).isNotNull(), 1).otherwise(0)).alias(n) for n, i in PRODUCT_ORDERS.items()))
    rows = each.groupBy(_again(each, width), "sku_id").agg(*sums, *(F.sum(n).cast("long").alias(n) for n in PRODUCT_ORDERS))
    return rows.select(*window_text(), "sku_id", *PRODUCT_SUMS, *PRODUCT_ORDERS)


def with_product_dimensions(rows: DataFrame, sku: DataFrame, spu: DataFrame, category3: DataFrame, trademark: DataFrame, unique: bool = False) -> DataFrame:
    """Product statistics with their four dimensions; the later three join on keys that sku brings. unique: keys don't repeat."""
    c, long = F.col, lambda n: F.col(n).try_cast("long")
    rows = look_up(rows, sku, {"sku_id": "id"}, {"sku_name": c("sku_name"), "sku_price": c("price").try_cast("decimal(16,2)"), "category3_id": long("category3_id"), "spu_id": long("spu_id"), "tm_id": long("tm_id")}, unique)
    rows = look_up(rows, spu, {"spu_id": "id"}, {"spu_name": c("spu_name")}, unique)
    rows = look_up(rows, category3, {"category3_id": "id"}, {"category3_name": c("name")}, unique)
    return look_up(rows, trademark, {"tm_id": "id"}, {"tm_name": c("tm_name")}, unique)


def province_stats(wide: DataFrame, keys: list[str], time: str, width: str = "10 seconds", amount: str = "split_total_amount", order: str = "order_id") -> DataFrame:
    """Amount and distinct orders by window and keys; rows without an order count with their amount only."""
    each = wide.groupBy(F.window(time, width), *keys, F.col(order).alias("order_")).agg(F.sum(amount).alias("order_amount"))
    rows = each.groupBy(_again(each, width), *keys).agg(F.count("order_").alias("order_count"), F.sum("order_amount").alias("order_amount"))
    return rows.select(*window_text(), *keys, "order_amount", "order_count")


def searched(page: DataFrame) -> DataFrame:
    """Search texts of result pages: fullword and the columns of page."""
    return page.where("page.page_id = 'good_list' and page.item is not null").withColumn("fullword", F.col("page.item"))


def keyword_stats(rows: DataFrame, text: str, time: str, width: str = "10 seconds", source: str = KEYWORD_SEARCH, tokenize: Tokenizer | None = None) -> DataFrame:
    counted = exploded(rows, text, tokenize=tokenize).groupBy(F.window(time, width), "keyword").agg(F.count("*").alias("ct"))
    return counted.select("keyword", "ct", F.lit(source).alias("source"), *window_text())


def stamped(rows: DataFrame) -> DataFrame:
    """rows with ts, the processing time in milliseconds."""
    return rows.withColumn("ts", F.unix_millis(F.current_timestamp()))
