"""Wide order and payment tables by event-time interval joins. Works on streams whose times have watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import age, time_of
from ..schemas import ORDER_WIDE, PAYMENT_WIDE
from .dimensions import look_up


def interval_join(left: DataFrame, right: DataFrame, on: Column, left_time: str, right_time: str, low: str, high: str) -> DataFrame:
    """Inner equi-join with right_time within [left_time + low, left_time + high], both ends included.

    For streams, and keys with few rows each; batches whose keys have many rows by `band_join`.
    """
    bounds = F.expr(f"{right_time} >= {left_time} + interval {low}") & F.expr(f"{right_time} <= {left_time} + interval {high}")
    return left.join(right, on & bounds)


def band_join(left: DataFrame, right: DataFrame, keys: dict[str, str], left_time: str, right_time: str, low_s: int, high_s: int, salts: int = 1) -> DataFrame:
    """The same for batches, with keys (left column -> right column) and the interval in seconds: only times near each other are compared.

    Times fall into bins as wide as the interval. A right row is in its own bin; a left row goes to the two bins that its
    interval can touch, so a key's rows meet those of two bins, not all of the key's. Rows without a time meet nothing. salts:
    over how many parts the right rows of one key and bin are dealt; left rows go to all of them.
    """
    width = max(high_s - low_s, 1)
    bin_of = lambda t, shift: F.floor((F.unix_micros(F.col(t).cast("timestamp")) + shift * 1_000_000) / (width * 1_000_000))
    bins = F.array_distinct(F.array(bin_of(left_time, low_s), bin_of(left_time, high_s)))
    l = left.where(F.col(left_time).isNotNull()).withColumn("bin_", F.explode(bins)).withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    r = right.where(F.col(right_time).isNotNull()).withColumns({"bin_r_": bin_of(right_time, 0), "salt_r_": F.pmod(F.xxhash64(right_time, *keys.values()), F.lit(salts)).cast("int")})
    # a condition on both, so that Spark plans it by the keys and the bin
    on = (F.col("bin_") == F.col("bin_r_")) & (F.col("salt_") == F.col("salt_r_"))
    for a, b in keys.items():
        on = on & (F.col(a) == F.col(b))
    near = F.expr(f"{right_time} >= {left_time} + interval {low_s} seconds") & F.expr(f"{right_time} <= {left_time} + interval {high_s} seconds")
    return l.join(r, on & near).drop("bin_", "bin_r_", "salt_", "salt_r_")


def timed(rows: DataFrame, name: str, text: str = "create_time", delay: str = "3 seconds") -> DataFrame:
    """rows with their time from text, watermarked on streams."""
    rows = rows.withColumn(name, time_of(F.col(text)))
    return rows.withWatermark(name, delay) if rows.isStreaming else rows


def order_wide(orders: DataFrame, details: DataFrame, low: str = "-5 seconds", high: str = "5 seconds") -> DataFrame:
    """Orders with their details: the columns of ORDER_WIDE up to the dimensions, and order_time.

    orders and details have order_time and detail_time. Fields that no side fills are null.
    """
    o = orders.select(*(F.col(c).alias(f"o_{c}") for c in orders.columns if c != "order_time"), "order_time")
    d = details.select(*(F.col(c).alias(f"d_{c}") for c in details.columns if c != "detail_time"), "detail_time")
    rows = interval_join(o, d, F.col("o_id") == F.col("d_order_id"), "order_time", "detail_time", low, high)
    from_detail = {"detail_id": "id", **{c: c for c in ("order_id", "sku_id", "order_price", "sku_num", "sku_name", "split_activity_amount", "split_coupon_amount", "split_total_amount")}}
    from_order = ("province_id", "order_status", "user_id", "total_amount", "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee", "create_time", "create_date")

    def filled(name: str) -> Column:
        if name in from_detail:
            return F.col(f"d_{from_detail[name]}").alias(name)
        if name in from_order:
            return F.col(f"o_{name}").alias(name)
        return F.lit(None).cast("decimal(16,2)" if name == "split_feight_fee" else "string").alias(name)

    return rows.select(*map(filled, ORDER_WIDE[: ORDER_WIDE.index("province_name")]), "order_time")


def with_dimensions(rows: DataFrame, user: DataFrame, province: DataFrame, sku: DataFrame, spu: DataFrame, category3: DataFrame, trademark: DataFrame, as_of: Column, unique: bool = False) -> DataFrame:
    """Order-wide rows with their six dimensions; the later three join on keys that sku brings. unique: keys don't repeat."""
    c = F.col
    rows = look_up(rows, user, {"user_id": "id"}, {"user_age": age(c("birthday"), as_of), "user_gender": c("gender")}, unique)
    rows = look_up(rows, province, {"province_id": "id"}, {"province_name": c("name"), "province_area_code": c("area_code"), "province_iso_code": c("iso_code"), "province_3166_2_code": c("iso_3166_2")}, unique)
    rows = look_up(rows, sku, {"sku_id": "id"}, {"sku_name": c("sku_name"), "category3_id": c("category3_id").try_cast("long"), "spu_id": c("spu_id").try_cast("long"), "tm_id": c("tm_id").try_cast("long")}, unique)
    rows = look_up(rows, spu, {"spu_id": "id"}, {"spu_name": c("spu_name")}, unique)
    rows = look_up(rows, category3, {"category3_id": "id"}, {"category3_name": c("name")}, unique)
    rows = look_up(rows, trademark, {"tm_id": "id"}, {"tm_name": c("tm_name")}, unique)
    return rows.select(*ORDER_WIDE, "order_time")


def payment_wide(payments: DataFrame, wide: DataFrame, low: str = "-1800 seconds", high: str = "0 seconds") -> DataFrame:
    """Payments (pay_time) with the order-wide rows (order_time) of their order that came up to half an hour before.

    Where both sides have a field, the payment's counts, null or not.
    """
    p = payments.select(*(F.col(c).alias(f"p_{c}") for c in payments.columns if c != "pay_time"), "pay_time")
    rows = interval_join(p, wide, F.col("p_order_id") == F.col("order_id"), "pay_time", "order_time", low, high)
    names = {"payment_id": "p_id", "subject": "p_subject", "payment_type": "p_payment_type", "payment_create_time": "p_create_time", "callback_time": "p_callback_time", "order_id": "p_order_id", "user_id": "p_user_id", "total_amount": "p_total_amount", "order_create_time": "create_time"}
    return rows.select(*(F.col(names.get(c, c)).alias(c) for c in PAYMENT_WIDE), "pay_time")
