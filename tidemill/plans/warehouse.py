"""The warehouse's operators as queries over the provided tables, each with SQL that DuckDB runs for the same rows.

The tables stand in for the warehouse's: events for page logs, orders and lineitem for order facts, customer, nation and
part for dimensions. They are sparse, so widths are wider than the operators' defaults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records, segment
from ..functions.keywords import exploded, register
from ..functions.scalars import FORMAT
from ..functions.segment import Segmenter
from ..operators import arrivals, changes, dimensions, logs, patterns, stats, wide
from ..schemas import CONFIG, CONFIG_CHANGE, OPEN_CHANGE
from ..sources import cdc, inputs

Query = Callable[[SparkSession, str], DataFrame]
MONEY = "decimal(16,2)"
HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as logs (schemas.LOG and event_id): signup is an entry page, error a start record, a view shows its item."""
    e = table(spark, sf_dir, "events")
    mid, kind = F.col("user_id"), F.col("event_type")
    item = F.get_json_object("props", "$.k")
    return e.select(
        F.struct(
            mid.cast("string").alias("mid"),
            F.concat(F.lit("v"), (mid % 3).cast("string")).alias("vc"),
            F.concat(F.lit("c"), (mid % 2).cast("string")).alias("ch"),
            (mid % 5).cast("string").alias("ar"),
            F.lit("1").alias("is_new"),
        ).alias("common"),
        F.struct(
            F.when(kind == "purchase", "good_detail").when(kind == "click", "good_list").otherwise(kind).alias("page_id"),
            F.when(kind != "signup", "home").alias("last_page_id"),
            item.alias("item"),
            F.floor(F.col("value")).cast("long").alias("during_time"),
        ).alias("page"),
        F.when(kind == "error", F.create_map(F.lit("entry"), F.lit("icon"))).alias("start"),
        F.when(kind == "view", F.array(F.struct(F.lit("sku_id").alias("item_type"), item.alias("item")))).alias("displays"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        "event_id",
    )


def amount(c: str) -> Column:
    return F.col(c).cast(MONEY)


def number(c: str) -> Column:
    """A decimal sum as double, for comparing."""
    return F.col(c).cast("double").alias(c)


def day_text(c: str) -> Column:
    return F.date_format(c, FORMAT).alias(c)


def q01_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select(F.from_json("props", "k string").alias("p")).select(F.col("p.k").try_cast("int").alias("k"))
    return parsed.groupBy("k").agg(F.count("*").alias("n"))


def q02_log_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.split_rows(page_log(spark, sf_dir))
    return rows.groupBy("kind", F.when(F.col("kind") == "display", F.col("item")).otherwise(F.col("mid")).alias("mid")).agg(F.count("*").alias("n"), F.sum("ts").alias("ts_sum"))


def q02b_is_new_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.repair_is_new(page_log(spark, sf_dir)).select("event_id", F.col("common.is_new").alias("is_new"))


def q03_explode_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    item = F.transform(F.split("p_name", " "), lambda x: F.struct(F.lit("word").alias("item_type"), x.alias("item")))
    page = parts.select(F.struct(F.col("p_brand").alias("page_id")).alias("page"), item.alias("displays"), F.col("p_partkey").alias("ts"))
    return logs.explode_displays(page)


def _nation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    kind = F.element_at(F.array(*map(F.lit, ("insert", "update", "bootstrap-insert", "delete"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    data = F.create_map(F.lit("n_nationkey"), F.col("n_nationkey").cast("string"), F.lit("n_name"), F.col("n_name"), F.lit("n_regionkey"), F.col("n_regionkey").cast("string"))
    empty = F.create_map().cast("map<string,string>")
    nations = n.select(F.lit("nation").alias("table"), kind.alias("type"), F.when(kind == "delete", empty).otherwise(data).alias("data"))
    regions = r.select(F.when(F.col("r_regionkey") == 0, "").otherwise("region").alias("table"), F.lit("insert").alias("type"), F.create_map(F.lit("r_regionkey"), F.col("r_regionkey").cast("string"), F.lit("r_name"), F.col("r_name")).alias("data"))
    return nations.unionByName(regions)


def q04_cdc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.sane(_nation_changes(spark, sf_dir)).select("table", "type", F.coalesce(F.col("data")["n_name"], F.col("data")["r_name"]).alias("name"))


def q05_config_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("nation", "insert", "hbase", "dim_nation", "n_nationkey,n_name", "n_nationkey", ""),
        ("nation", "update", "kafka", "dwd_nation", "n_name, n_regionkey", "", ""),
        ("region", "insert", "kafka", "dwd_region", "r_name", "", ""),
        ("region", "update", "clickhouse", "none", "r_name", "", ""),
    ]
    routed = changes.route(changes.sane(_nation_changes(spark, sf_dir)), spark.createDataFrame(rows, CONFIG))
    data = F.col("data")
    return routed.dimension.unionByName(routed.fact).select("sink_type", "sink_table", data["n_nationkey"].alias("key"), F.coalesce(data["n_name"], data["r_name"]).alias("name"), F.size(data).alias("n_columns"))


def q06_dim_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("none").alias("status"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit("update").alias("kind_"), "o_orderdate", "o_orderkey")
    return dimensions.upserted(old, dimensions.latest(o, ["id"], ["o_orderdate", "o_orderkey"]), "id")


def _orders_and_details(spark: SparkSession, sf_dir: str, low: str = "-30 days", high: str = "30 days") -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", amount("o_totalprice").alias("o_totalprice"), "o_orderdate")
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", amount("l_extendedprice").alias("l_extendedprice"), "l_shipdate")
    return wide.interval_join(o, d, F.col("o_orderkey") == F.col("l_orderkey"), "o_orderdate", "l_shipdate", low, high)


def q07_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_and_details(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", day_text("o_orderdate"), day_text("l_shipdate"), number("l_extendedprice"))


def _order_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders_and_details(spark, sf_dir)
    c = F.col
    birthday = F.date_format(F.date_sub(F.lit("1990-01-01"), (c("c_custkey") % 9000).cast("int")), "yyyy-MM-dd")
    user = table(spark, sf_dir, "customer").select("*", birthday.alias("birthday"))
    rows = dimensions.look_up(rows, user, {"o_custkey": "c_custkey"}, {"user_segment": c("c_mktsegment"), "province_id": c("c_nationkey"), "user_age": wide.age(c("birthday"), F.lit("2020-01-01").cast("date"))}, unique=True)
    rows = dimensions.look_up(rows, table(spark, sf_dir, "nation"), {"province_id": "n_nationkey"}, {"province_name": c("n_name")}, unique=True)
    return dimensions.look_up(rows, table(spark, sf_dir, "part"), {"l_partkey": "p_partkey"}, {"sku_name": c("p_name"), "tm_name": c("p_brand"), "category3_name": c("p_type")}, unique=True)


def q08_order_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_orderkey", "l_linenumber", "l_partkey", "sku_name", "tm_name", "category3_name", "o_custkey", "user_segment", "user_age", "province_id", "province_name"]
    return _order_wide(spark, sf_dir).select(*names, number("l_extendedprice"), number("o_totalprice"))


def q09_unique_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.unique_visits(page_log(spark, sf_dir), ["event_id"]).select("event_id", F.col("common.mid").alias("mid"), "ts")


def q10_payment_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    paid = e.where("event_type = 'purchase'").select(F.col("event_id").alias("payment_id"), F.col("user_id").alias("p_user"), F.col("ts").alias("pay_time"), F.col("value").alias("amount"))
    seen = e.where("event_type = 'view'").select(F.col("event_id").alias("order_id"), "user_id", F.col("ts").alias("order_time"))
    return wide.band_join(paid, seen, {"p_user": "user_id"}, "pay_time", "order_time", -86_400, 0).select("payment_id", "order_id", "user_id", "amount")


def _visitor_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = logs.split_log(page_log(spark, sf_dir)).page
    return stats.visitor_measures(page, logs.unique_visits(page, ["event_id"]), logs.bounces(page, ["event_id"], HOUR_MS))


def q11_visitor_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visitor_measures(spark, sf_dir)


def q12_visitor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = stats.page_measures(logs.split_log(page_log(spark, sf_dir)).page, ["event_id"], HOUR_MS)
    return stats.visitor_stats(measures.withColumn("time", F.timestamp_millis("ts")), "time", "1 hour")


def q13_user_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.bounces(page_log(spark, sf_dir), ["event_id"], HOUR_MS).select("event_id", F.col("common.mid").alias("mid"), "ts")


def _product_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven sources: events for page logs, favorites (sign-ups) and carts (clicks), line items for the others; each table is read once."""
    c, one = F.col, F.lit(1)
    page = logs.split_log(page_log(spark, sf_dir)).page.withColumn("time", F.timestamp_millis("ts"))
    item, kind = c("page.item"), c("page.page_id")
    click = F.when((kind == "good_detail") & item.isNotNull(), stats.measure(item, click_ct=one))
    shown = F.transform(F.filter("displays", lambda d: d["item_type"] == "sku_id"), lambda d: stats.measure(d["item"], display_ct=one))
    chosen = F.when(kind.isin("signup", "good_list"), stats.measure(item, favor_ct=F.when(kind == "signup", 1).otherwise(0), cart_ct=F.when(kind == "good_list", 1).otherwise(0)))
    seen = stats.measures_of(page, click, chosen, shown)
    paid, back, told = c("l_linestatus") == "O", c("l_returnflag") == "R", c("l_linestatus") == "F"
    sold = amount("l_extendedprice")
    order = stats.measure(
        c("l_partkey"), order_sku_num=c("l_quantity"), order_amount=sold, order_id=c("l_orderkey"), payment_amount=F.when(paid, sold).otherwise(0), paid_order_id=F.when(paid, c("l_orderkey")), refund_amount=F.when(back, sold).otherwise(0),
        refund_order_id=F.when(back, c("l_orderkey")), comment_ct=F.when(told, 1).otherwise(0), good_comment_ct=F.when(told & (c("l_quantity") > 25), 1).otherwise(0),
    )
    l = table(spark, sf_dir, "lineitem").withColumn("time", c("l_shipdate").cast("timestamp"))
    bought = l.select("time", order.alias("m")).where("m.sku_id is not null").select("m.*", "time")
    return stats.product_stats(seen.unionByName(bought), "30 days")


_PRODUCT = ["stt", "edt", "sku_id", "display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num", "order_ct", "paid_order_ct", "refund_order_ct", "comment_ct", "good_comment_ct"]


def q14_product_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product_stats(spark, sf_dir).select(*_PRODUCT, number("order_amount"), number("payment_amount"), number("refund_amount"))


def _product_dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """part as products, its sizes as their groups (named by the part of that number), its types as categories, its brands as trademarks; ids are text, keys unique."""
    p = table(spark, sf_dir, "part")
    text = lambda c: F.col(c).cast("string")
    number_of = lambda c: F.regexp_replace(c, "[^0-9]", "")
    kinds = p.groupBy("p_type").agg(F.count("*")).select(F.crc32("p_type").cast("string").alias("id"), F.col("p_type").alias("name"))
    brands = p.groupBy("p_brand").agg(F.count("*")).select(number_of("p_brand").alias("id"), F.col("p_brand").alias("tm_name"))
    sku = p.select(text("p_partkey").alias("id"), F.col("p_name").alias("sku_name"), text("p_retailprice").alias("price"), text("p_size").alias("spu_id"), F.crc32("p_type").cast("string").alias("category3_id"), number_of("p_brand").alias("tm_id"))
    return {"sku": sku, "spu": p.select(text("p_partkey").alias("id"), F.col("p_name").alias("spu_name")), "category3": kinds, "trademark": brands}


def q15_product_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.with_product_dimensions(_product_stats(spark, sf_dir), **_product_dimensions(spark, sf_dir), unique=True)
    return rows.select("stt", "sku_id", "sku_name", number("sku_price"), "spu_id", "spu_name", "tm_id", "tm_name", "category3_name", "order_ct", number("order_amount"))


def q16_province_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", amount("o_totalprice").alias("o_totalprice"), "o_orderdate")
    c = F.col
    rows = dimensions.look_up(o, table(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"}, {"province_id": c("c_nationkey")}, unique=True)
    rows = dimensions.look_up(rows, table(spark, sf_dir, "nation"), {"province_id": "n_nationkey"}, {"province_name": c("n_name"), "area_code": c("n_regionkey")}, unique=True)
    out = stats.province_stats(rows, ["province_id", "province_name", "area_code"], "o_orderdate", "30 days", "o_totalprice", "o_orderkey")
    return out.select("stt", "edt", "province_id", "province_name", "area_code", "order_count", number("order_amount"))


def q17_keyword_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "keyword")


def q18_keyword_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = stats.searched(logs.split_log(page_log(spark, sf_dir)).page).withColumn("time", F.timestamp_seconds(F.floor(F.col("ts") / 1000)))
    return stats.keyword_stats(page, "fullword", "time", "1 day")


def _order_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders and lineitem as order and detail records; a detail's time is its order's."""
    c, none = F.col, F.lit(None).cast(MONEY)
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    province = (c("o_custkey") % 30).cast("long")  # five of which no nation has
    orders = o.select(c("o_orderkey").alias("id"), province.alias("province_id"), c("o_orderstatus").alias("order_status"), c("o_custkey").alias("user_id"), amount("o_totalprice").alias("total_amount"), *(none.alias(n) for n in ("activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee")), day_text("o_orderdate").alias("create_time"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("create_date"))
    when = o.select(c("o_orderkey").alias("k"), c("o_orderdate").alias("at"))
    late = F.timestamp_seconds(F.unix_timestamp("at") + c("l_linenumber"))  # up to seven seconds, of which five count
    details = l.join(when, c("l_orderkey") == c("k")).select((10 * c("l_orderkey") + c("l_linenumber")).alias("id"), c("l_orderkey").alias("order_id"), c("l_partkey").alias("sku_id"), amount("l_extendedprice").alias("order_price"), c("l_quantity").cast("long").alias("sku_num"), F.lit("ordered").alias("sku_name"), F.date_format(late, FORMAT).alias("create_time"), amount("l_extendedprice").alias("split_total_amount"), none.alias("split_activity_amount"), none.alias("split_coupon_amount"))
    return orders, details


def _whole_order_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, details = _order_sources(spark, sf_dir)
    rows = wide.order_wide(wide.timed(orders, "order_time"), wide.timed(details, "detail_time"))
    c = F.col
    birthday = F.date_format(F.date_sub(F.lit("1990-01-01"), (c("c_custkey") % 9000).cast("int")), "yyyy-MM-dd")
    user = table(spark, sf_dir, "customer").select(c("c_custkey").cast("string").alias("id"), F.when(c("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"), birthday.alias("birthday"))
    n = c("n_nationkey").cast("string")
    province = table(spark, sf_dir, "nation").select(n.alias("id"), c("n_name").alias("name"), c("n_regionkey").cast("string").alias("area_code"), F.concat(F.lit("I"), n).alias("iso_code"), F.concat(F.lit("P"), n).alias("iso_3166_2"))
    return wide.with_dimensions(rows, user, province, **_product_dimensions(spark, sf_dir), as_of=F.lit("2020-01-01").cast("date"), unique=True)


def q19_order_wide_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole order-wide records with their six dimensions; money that is always null is left out."""
    names = ["detail_id", "order_id", "sku_id", "sku_num", "sku_name", "province_id", "order_status", "user_id", "create_time", "create_date", "province_name", "province_area_code", "province_iso_code", "province_3166_2_code", "user_age", "user_gender", "spu_id", "tm_id", "spu_name", "tm_name", "category3_name"]
    return _whole_order_wide(spark, sf_dir).select(*names, number("order_price"), number("total_amount"), number("split_total_amount"))


def q20_payment_wide_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of orders, half of them too late, over the order-wide records; the payment's user is unknown where the order's is even."""
    c = F.col
    later = F.when(c("o_orderkey") % 2 == 0, 1800).otherwise(1801)
    paid = F.date_format(F.timestamp_seconds(F.unix_timestamp("o_orderdate") + later), FORMAT)
    pay = table(spark, sf_dir, "orders").select((c("o_orderkey") + 7).alias("id"), c("o_orderkey").alias("order_id"), F.when(c("o_custkey") % 2 == 1, c("o_custkey")).alias("user_id"), amount("o_totalprice").alias("total_amount"), c("o_orderpriority").alias("subject"), F.lit("card").alias("payment_type"), paid.alias("create_time"), paid.alias("callback_time"))
    rows = wide.payment_wide(wide.timed(pay, "pay_time"), _whole_order_wide(spark, sf_dir))
    names = ["payment_id", "subject", "payment_type", "payment_create_time", "callback_time", "detail_id", "order_id", "sku_id", "sku_name", "user_id", "order_create_time", "province_name", "user_age", "tm_name"]
    return rows.select(*names, number("total_amount"), number("split_total_amount"))


def q21_config_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Config changes as JSON lines, made from part: the routing table after them, and the dimension tables that it asks for."""
    c = F.col
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("insert", "update", "delete"))), (c("p_partkey") % 3 + 1).cast("int"))
    data = F.struct(F.concat(F.lit("t"), c("p_size")).alias("source_table"), F.when(c("p_partkey") % 2 == 0, "insert").otherwise("update").alias("operate_type"), F.when(c("p_size") % 2 == 0, "hbase").otherwise("kafka").alias("sink_type"), F.concat(F.lit("dim_"), c("p_size")).alias("sink_table"), F.lit("id,name").alias("sink_columns"), F.when(c("p_size") % 3 == 0, "name").otherwise("").alias("sink_pk"), F.lit(None).cast("string").alias("sink_extend"))
    lines = p.select(F.to_json(F.struct(F.lit("d").alias("database"), F.lit("table_process").alias("table"), kind.alias("type"), data.alias("data"), c("p_partkey").alias("seq"))).alias("value"))
    config = changes.current_config(inputs.parsed(lines, CONFIG_CHANGE + ", seq bigint"), ["seq"])
    asked = changes.new_dimensions(config).select(F.lit("dimension").alias("what"), "sink_table", "sink_pk", F.lit(None).cast("string").alias("operate_type"))
    return config.select(F.lit("route").alias("what"), "sink_table", "sink_pk", "operate_type").unionByName(asked)


def q22_keyword_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords by a Python table function in a lateral join, where q17 has Spark's own functions."""
    register(spark, str.split)
    inputs.as_view(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "named_parts")
    return spark.sql("SELECT p_partkey, word FROM named_parts, LATERAL analyze_words(p_name)")


def _open_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of part as JSON lines, with fields that no schema lists: nested ones, numbers, truth values."""
    c = F.col
    row = F.struct(c("p_name").alias("tm_name"), F.concat(F.lit("logo/"), c("p_size")).alias("logo_url"), c("p_partkey").alias("id"), F.split("p_type", " ").alias("tags"), F.struct((c("p_size") > 25).alias("large"), c("p_brand").alias("brand")).alias("more"), F.lit(None).cast("string").alias("none"))
    kind = F.when(c("p_partkey") % 2 == 0, "bootstrap-insert").otherwise("update")
    return table(spark, sf_dir, "part").select(F.to_json(F.struct(F.lit("part").alias("table"), kind.alias("type"), row.alias("data")), {"ignoreNullFields": "false"}).alias("value"))


def q23_open_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with rows of any fields, routed by config: the listed fields come out as they went in, and typed."""
    rows = [("part", "insert", "hbase", "dim_part", "id,tm_name", "id", ""), ("part", "update", "kafka", "dwd_part", "tags,more,id,none", "", "")]
    changed = inputs.parsed(_open_changes(spark, sf_dir), OPEN_CHANGE)
    routed = changes.route(changes.sane(changed), spark.createDataFrame(rows, CONFIG))
    d = F.col("data")
    out = [records.field(d, "id", "bigint").alias("id"), records.field(d, "more.large", "boolean").alias("large"), F.size(records.field(d, "tags", "array<variant>")).alias("n_tags"), records.text(d).alias("value")]
    return routed.dimension.unionByName(routed.fact).select("sink_table", *out)


def q24_open_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with unlisted fields from events: the displays of pages as whole records, after the split."""
    e, c = table(spark, sf_dir, "events"), F.col
    display = "struct<item_type:string,item:bigint,pos:struct<x:bigint>,paid:boolean>"  # nulls don't become fields
    none = F.lit(None)
    one = F.struct(F.lit("sku_id").alias("item_type"), F.get_json_object("props", "$.k").cast("long").alias("item"), F.struct(c("user_id").alias("x")).alias("pos"), none.alias("paid")).cast(display)
    shown = F.array(one, F.struct(F.lit("ad").alias("item_type"), none.alias("item"), none.alias("pos"), F.lit(True).alias("paid")).cast(display))
    log = F.struct(F.struct(c("user_id").cast("string").alias("mid"), F.lit("1").alias("is_new"), F.lit("x").alias("os")).alias("common"), F.struct(c("event_type").alias("page_id")).alias("page"), F.when(c("event_type") == "error", F.struct(F.lit(5).alias("ms"))).alias("start"), F.when(c("event_type").isin("view", "error"), shown).alias("displays"), F.unix_millis(c("ts").cast("timestamp")).alias("ts"))
    logs_ = inputs.open_logs(e.select(F.to_json(log).alias("value")))
    return logs.split_log(logs_).display.select("item_type", "item", records.text(c("record")).alias("value"))


def q25_cdc_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a table with a change log (every third order updated, every fifth deleted, twins created): its rows after all changes."""
    o, c = table(spark, sf_dir, "orders"), F.col
    base = o.select("o_orderkey", "o_orderstatus", "o_custkey")
    key = c("o_orderkey")

    def change(rows: DataFrame, op: str, position: Column, status: Column, new_key: Column = key) -> DataFrame:
        row = F.struct(new_key.alias("o_orderkey"), status.alias("o_orderstatus"), c("o_custkey"))
        none = F.lit(None).cast(rows.select(row.alias("r")).schema["r"].dataType)
        return rows.select(F.to_json(F.struct(F.lit(op).alias("op"), position.alias("position"), (row if op == "d" else none).alias("before"), (none if op == "d" else row).alias("after"))).alias("value"))

    log = change(base.where(key % 3 == 0), "u", key * 10 + 1, F.lit("u")).unionByName(change(base.where(key % 5 == 0), "d", key * 10 + 2, c("o_orderstatus"))).unionByName(change(base.where(key % 7 == 0), "c", key * 10 + 3, F.lit("c"), -key))
    rows = cdc.snapshot_and_log(base, log, "o_orderkey").withColumn("position", F.coalesce("position", F.lit(0)))
    last = dimensions.last_rows(rows, ["key_"], ["position"]).where("op <> 'd'")
    r = c("row")
    return last.select(records.field(r, "o_orderkey", "bigint").alias("o_orderkey"), records.field(r, "o_orderstatus", "string").alias("o_orderstatus"), records.field(r, "o_custkey", "bigint").alias("o_custkey"), "op")


def q26_config_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events routed by config changes that come among them (made from part, spread over the same arrivals)."""
    c = F.col
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("t"), c("user_id") % 20).alias("table"), F.when(c("event_id") % 2 == 0, "insert").otherwise("update").alias("type"), F.create_map(F.lit("id"), c("event_id").cast("string"), F.lit("kind"), c("event_type")).alias("data"), (c("event_id") * 2).alias("arrival"))
    data = F.struct(F.concat(F.lit("t"), c("p_size") % 20).alias("source_table"), F.when(c("p_partkey") % 2 == 0, "insert").otherwise("update").alias("operate_type"), F.when(c("p_size") % 3 == 0, "hbase").when(c("p_size") % 3 == 1, "kafka").otherwise("none").alias("sink_type"), F.concat(F.lit("s"), c("p_partkey")).alias("sink_table"), F.lit("id").alias("sink_columns"), F.lit("").alias("sink_pk"), F.lit("").alias("sink_extend"))
    told = table(spark, sf_dir, "part").select(F.when(c("p_partkey") % 4 == 3, "delete").otherwise("update").alias("type"), data.alias("data"), (c("p_partkey") * 8 + 1).alias("arrival"))
    routed = arrivals.routed_by_arrival(e, told)
    return routed.select("arrival", "fate", F.when(c("fate") != "dropped", c("sink_table")).alias("sink_table"), F.size("data").alias("n_columns"))


def q27_visit_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups that a click and then a purchase follow within 90 days, other events between them passed over; others as time-outs."""
    e, kind = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).select("event_id", "user_id", "event_type", "ms"), F.col("event_type")
    steps = patterns.begin("signup", kind == "signup").followed_by("click", kind == "click").followed_by("purchase", kind == "purchase").within(90 * 24 * HOUR_MS)
    found = patterns.matched(e, steps, "user_id", "ms", ["event_id"])
    return found.select("outcome", F.col("steps").cast("int").alias("steps"), *(F.col(f"{s}.event_id").alias(s) for s in ("signup", "click", "purchase")))


def q28_segmented_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of part written without spaces, cut into words again by the frequencies of the words in all names."""
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").count()
    # the vocabulary of names, which is bounded as a dictionary is
    cut = Segmenter({r.w: r["count"] for r in words.orderBy(F.desc("count"), "w").limit(segment.WORDS).collect()}, script="a-z")
    return exploded(p.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("joined")), "joined", "word", cut).select("p_partkey", "word")


def order_to_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: orders and details by interval join, with dimensions, as statistics by province and 30 days."""
    out = stats.province_stats(_order_wide(spark, sf_dir), ["province_id", "province_name"], "o_orderdate", "30 days", "l_extendedprice", "o_orderkey")
    return out.select("stt", "edt", "province_id", "province_name", "order_count", number("order_amount"))


_QUERIES = (
    q01_json_parse, q02_log_split, q02b_is_new_repair, q03_explode_display, q04_cdc_filter, q05_config_route, q06_dim_upsert, q07_interval_join, q08_order_wide,
    q09_unique_visit, q10_payment_wide, q11_visitor_measures, q12_visitor_stats, q13_user_jump, q14_product_stats, q15_product_dims, q16_province_stats,
    q17_keyword_lateral, q18_keyword_stats, q19_order_wide_records, q20_payment_wide_records, q21_config_changes, q22_keyword_udtf, q23_open_records,
    q24_open_displays, q25_cdc_orders, q26_config_by_arrival, q27_visit_pattern, q28_segmented_keywords, order_to_province,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _QUERIES}


# The SQL of the same queries. Common parts are common table expressions.
_LOG = """log AS (SELECT event_id, user_id, user_id::VARCHAR AS mid, 'v' || (user_id % 3) AS vc, 'c' || (user_id % 2) AS ch, (user_id % 5)::VARCHAR AS ar,
  CASE event_type WHEN 'purchase' THEN 'good_detail' WHEN 'click' THEN 'good_list' ELSE event_type END AS page_id, event_type,
  json_extract_string(props, '$.k') AS item, floor(value)::BIGINT AS during_time, epoch_us(ts) // 1000 AS ms, ts FROM events)"""
_MEASURES = f"""{_LOG}, page AS (SELECT * FROM log WHERE event_type <> 'error'),
visit AS (SELECT * FROM page WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY mid, ts::DATE ORDER BY ms, event_id) = 1),
jump AS (SELECT * FROM (SELECT *, lead(ms) OVER (PARTITION BY mid ORDER BY ms, event_id) AS nx FROM page) WHERE event_type = 'signup' AND (nx IS NULL OR nx - ms >= 3600000)),
measure AS (
  SELECT vc, ch, ar, '1' AS is_new, 0::BIGINT AS uv_ct, 1::BIGINT AS pv_ct, (event_type = 'signup')::BIGINT AS sv_ct, 0::BIGINT AS uj_ct, during_time AS dur_sum, ms AS ts FROM page
  UNION ALL SELECT vc, ch, ar, '1', 1, 0, 0, 0, 0, ms FROM visit
  UNION ALL SELECT vc, ch, ar, '1', 0, 0, 0, 1, 0, ms FROM jump)"""
_BUCKET = "time_bucket(INTERVAL '{w}', {t}, TIMESTAMP '1970-01-01')"
_TEXT = "strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _window(t: str, w: str) -> str:
    b = _BUCKET.format(w=w, t=t)
    return f"{_TEXT.format(x=b)} AS stt, {_TEXT.format(x=f'{b} + INTERVAL {chr(39)}{w}{chr(39)}')} AS edt"


_CHANGES = """change AS (SELECT 'nation' AS tab, (['insert', 'update', 'insert', 'delete'])[n_nationkey % 4 + 1] AS kind, n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey % 4 <> 3
  UNION ALL SELECT 'region', 'insert', NULL, r_name FROM region WHERE r_regionkey <> 0)"""
_JOINED = """joined AS (SELECT o_orderkey, o_custkey, o_totalprice::DECIMAL(16,2) AS o_totalprice, o_orderdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice::DECIMAL(16,2) AS l_extendedprice, l_shipdate
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate - INTERVAL 30 DAY AND o_orderdate + INTERVAL 30 DAY)"""
_WIDE = f"""{_JOINED}, wide AS (SELECT j.*, p_name AS sku_name, p_brand AS tm_name, p_type AS category3_name, c_mktsegment AS user_segment, c_nationkey AS province_id, n_name AS province_name,
  (date_diff('day', DATE '1990-01-01' - (c_custkey % 9000)::INTEGER, DATE '2020-01-01') // 365)::INTEGER AS user_age
  FROM joined j LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey)"""
_PRODUCTS = f"""{_LOG}, measure AS (
  SELECT l_shipdate AS t, l_partkey AS sku_id, 0 AS display_ct, 0 AS click_ct, 0 AS favor_ct, 0 AS cart_ct, l_quantity, l_extendedprice::DECIMAL(16,2) AS amount, l_orderkey, l_linestatus, l_returnflag FROM lineitem
  UNION ALL SELECT epoch_ms(ms), item::BIGINT, (event_type = 'view')::INT, (event_type = 'purchase')::INT, (event_type = 'signup')::INT, (event_type = 'click')::INT, 0, 0, NULL, NULL, NULL
    FROM log WHERE event_type <> 'error' AND item IS NOT NULL),
product AS (SELECT {_window('t', '30 days')}, sku_id, sum(display_ct)::BIGINT AS display_ct, sum(click_ct)::BIGINT AS click_ct, sum(favor_ct)::BIGINT AS favor_ct, sum(cart_ct)::BIGINT AS cart_ct,
  sum(l_quantity)::BIGINT AS order_sku_num, count(DISTINCT l_orderkey) AS order_ct,
  count(DISTINCT l_orderkey) FILTER (WHERE l_linestatus = 'O') AS paid_order_ct, count(DISTINCT l_orderkey) FILTER (WHERE l_returnflag = 'R') AS refund_order_ct,
  count(*) FILTER (WHERE l_linestatus = 'F') AS comment_ct, count(*) FILTER (WHERE l_linestatus = 'F' AND l_quantity > 25) AS good_comment_ct,
  sum(amount)::DOUBLE AS order_amount, coalesce(sum(amount) FILTER (WHERE l_linestatus = 'O'), 0)::DOUBLE AS payment_amount,
  coalesce(sum(amount) FILTER (WHERE l_returnflag = 'R'), 0)::DOUBLE AS refund_amount FROM measure GROUP BY 1, 2, 3)"""
_GOODS = """sku AS (SELECT p_partkey AS sku, p_name AS sku_name, p_retailprice::DECIMAL(16,2)::DOUBLE AS sku_price, p_size::BIGINT AS spu_id, regexp_replace(p_brand, '[^0-9]', '', 'g')::BIGINT AS tm_id, p_brand AS tm_name,
  p_type AS category3_name FROM part), goods AS (SELECT sku.*, spu.p_name AS spu_name FROM sku LEFT JOIN part AS spu ON spu_id = spu.p_partkey)"""
_RECORDS = f"""{_GOODS}, record AS (SELECT 10 * l_orderkey + l_linenumber AS detail_id, o_orderkey AS order_id, l_partkey AS sku_id, l_quantity::BIGINT AS sku_num, coalesce(sku_name, 'ordered') AS sku_name,
  o_custkey % 30 AS province_id, o_orderstatus AS order_status, o_custkey AS user_id, {_TEXT.format(x='o_orderdate')} AS create_time, strftime(o_orderdate, '%Y-%m-%d') AS create_date, n_name AS province_name,
  n_regionkey::VARCHAR AS province_area_code, 'I' || n_nationkey AS province_iso_code, 'P' || n_nationkey AS province_3166_2_code,
  (date_diff('day', DATE '1990-01-01' - (c_custkey % 9000)::INTEGER, DATE '2020-01-01') // 365)::INTEGER AS user_age, CASE WHEN c_custkey % 2 = 0 THEN 'F' WHEN c_custkey % 2 = 1 THEN 'M' END AS user_gender, spu_id, tm_id,
  spu_name, tm_name, category3_name, l_extendedprice::DECIMAL(16,2)::DOUBLE AS order_price, o_totalprice::DECIMAL(16,2)::DOUBLE AS total_amount, l_extendedprice::DECIMAL(16,2)::DOUBLE AS split_total_amount, o_orderdate
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber <= 5 LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON o_custkey % 30 = n_nationkey LEFT JOIN goods ON l_partkey = sku)"""


def oracle_sql() -> dict[str, str]:
    return {
        "q01_json_parse": "SELECT TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
        "q02_log_split": f"""WITH {_LOG}, part AS (SELECT CASE WHEN event_type = 'error' THEN 'start' ELSE 'page' END AS kind, mid, ms FROM log
            UNION ALL SELECT 'display', item, ms FROM log WHERE event_type = 'view') SELECT kind, mid, count(*) AS n, sum(ms)::BIGINT AS ts_sum FROM part GROUP BY 1, 2""",
        "q02b_is_new_repair": "SELECT event_id, CASE WHEN ts::DATE = min(ts::DATE) OVER (PARTITION BY user_id) THEN '1' ELSE '0' END AS is_new FROM events",
        "q03_explode_display": "SELECT 'word' AS item_type, unnest(string_split(p_name, ' ')) AS item, p_brand AS page_id, p_partkey AS ts FROM part",
        "q04_cdc_filter": f'WITH {_CHANGES} SELECT tab AS "table", kind AS "type", name FROM change',
        "q05_config_route": f"""WITH {_CHANGES} SELECT CASE WHEN tab = 'nation' AND kind = 'insert' THEN 'hbase' ELSE 'kafka' END AS sink_type,
            CASE WHEN tab = 'region' THEN 'dwd_region' WHEN kind = 'insert' THEN 'dim_nation' ELSE 'dwd_nation' END AS sink_table,
            CASE WHEN tab = 'nation' AND kind = 'insert' THEN key::VARCHAR END AS key, name, CASE WHEN tab = 'nation' AND kind = 'insert' THEN 2 ELSE 1 END::INTEGER AS n_columns FROM change""",
        "q06_dim_upsert": """WITH new AS (SELECT o_custkey AS id, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
            SELECT id, status FROM new UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT id FROM new)""",
        "q07_interval_join": f"WITH {_JOINED} SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, {_TEXT.format(x='o_orderdate')} AS o_orderdate, {_TEXT.format(x='l_shipdate')} AS l_shipdate, l_extendedprice::DOUBLE AS l_extendedprice FROM joined",
        "q08_order_wide": f"WITH {_WIDE} SELECT l_orderkey, l_linenumber, l_partkey, sku_name, tm_name, category3_name, o_custkey, user_segment, user_age, province_id, province_name, l_extendedprice::DOUBLE AS l_extendedprice, o_totalprice::DOUBLE AS o_totalprice FROM wide",
        "q09_unique_visit": f"WITH {_LOG} SELECT event_id, mid, ms AS ts FROM log WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY mid, ts::DATE ORDER BY ms, event_id) = 1",
        "q10_payment_wide": """SELECT p.event_id AS payment_id, v.event_id AS order_id, v.user_id, p.value AS amount FROM events p JOIN events v ON p.user_id = v.user_id
            AND v.ts BETWEEN p.ts - INTERVAL 1 DAY AND p.ts WHERE p.event_type = 'purchase' AND v.event_type = 'view'""",
        "q11_visitor_measures": f"WITH {_MEASURES} SELECT * FROM measure",
        "q12_visitor_stats": f"WITH {_MEASURES} SELECT {_window('make_timestamp(ts * 1000)', '1 hour')}, vc, ch, ar, is_new, sum(uv_ct)::BIGINT AS uv_ct, sum(pv_ct)::BIGINT AS pv_ct, sum(sv_ct)::BIGINT AS sv_ct, sum(uj_ct)::BIGINT AS uj_ct, sum(dur_sum)::BIGINT AS dur_sum FROM measure GROUP BY ALL",
        "q13_user_jump": f"WITH {_LOG}, nxt AS (SELECT *, lead(ms) OVER (PARTITION BY mid ORDER BY ms, event_id) AS nx FROM log) SELECT event_id, mid, ms AS ts FROM nxt WHERE event_type = 'signup' AND (nx IS NULL OR nx - ms >= 3600000)",
        "q14_product_stats": f"WITH {_PRODUCTS} SELECT * FROM product",
        "q15_product_dims": f"WITH {_PRODUCTS}, {_GOODS} SELECT stt, sku_id, sku_name, sku_price, spu_id, spu_name, tm_id, tm_name, category3_name, order_ct, order_amount FROM product LEFT JOIN goods ON sku_id = sku",
        "q16_province_stats": f"SELECT {_window('o_orderdate', '30 days')}, c_nationkey AS province_id, n_name AS province_name, n_regionkey AS area_code, count(DISTINCT o_orderkey) AS order_count, sum(o_totalprice::DECIMAL(16,2))::DOUBLE AS order_amount FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
        "q17_keyword_lateral": "SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS keyword FROM part",
        "q18_keyword_stats": f"WITH {_LOG} SELECT item AS keyword, count(*) AS ct, 'SEARCH' AS source, {_window('date_trunc(' + chr(39) + 'second' + chr(39) + ', ts)', '1 day')} FROM log WHERE page_id = 'good_list' AND item IS NOT NULL GROUP BY ALL",
        "q19_order_wide_records": f"WITH {_RECORDS} SELECT * EXCLUDE (o_orderdate) FROM record",
        "q20_payment_wide_records": f"""WITH {_RECORDS} SELECT order_id + 7 AS payment_id, o_orderpriority AS subject, 'card' AS payment_type, {_TEXT.format(x="r.o_orderdate + INTERVAL 1800 SECOND")} AS payment_create_time,
            {_TEXT.format(x="r.o_orderdate + INTERVAL 1800 SECOND")} AS callback_time, detail_id, order_id, sku_id, sku_name, CASE WHEN user_id % 2 = 1 THEN user_id END AS user_id, create_time AS order_create_time,
            province_name, user_age, tm_name, total_amount, split_total_amount FROM record r JOIN orders ON order_id = o_orderkey WHERE order_id % 2 = 0""",
        "q21_config_changes": """WITH config AS (SELECT * FROM (SELECT p_partkey % 3 AS kind, p_size, CASE WHEN p_partkey % 2 = 0 THEN 'insert' ELSE 'update' END AS operate_type, CASE WHEN p_size % 3 = 0 THEN 'name' ELSE '' END AS pk
            FROM part QUALIFY row_number() OVER (PARTITION BY p_size, p_partkey % 2 ORDER BY p_partkey DESC) = 1) WHERE kind <> 2)
            SELECT 'route' AS what, 'dim_' || p_size AS sink_table, pk AS sink_pk, operate_type FROM config
            UNION ALL SELECT 'dimension', 'dim_' || p_size, CASE WHEN pk = '' THEN 'id' ELSE pk END, NULL FROM config WHERE p_size % 2 = 0 AND operate_type = 'insert'""",
        "q22_keyword_udtf": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
        "q23_open_records": """SELECT 'dim_part' AS sink_table, p_partkey AS id, NULL::BOOLEAN AS large, NULL::INTEGER AS n_tags, '{"tm_name":"' || p_name || '","id":' || p_partkey || '}' AS value FROM part WHERE p_partkey % 2 = 0
            UNION ALL SELECT 'dwd_part', p_partkey, p_size > 25, len(string_split(p_type, ' '))::INTEGER,
            '{"id":' || p_partkey || ',"tags":["' || replace(p_type, ' ', '","') || '"],"more":{"brand":"' || p_brand || '","large":' || (p_size > 25)::VARCHAR || '},"none":null}' FROM part WHERE p_partkey % 2 = 1""",
        "q24_open_displays": """WITH shown AS (SELECT json_extract_string(props, '$.k') AS item, user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'view')
            SELECT 'sku_id' AS item_type, item, '{' || coalesce('"item":' || item || ',', '') || '"item_type":"sku_id","pos":{"x":' || user_id || '},"ts":' || ms || ',"page_id":"view"}' AS value FROM shown
            UNION ALL SELECT 'ad', NULL, '{"item_type":"ad","paid":true,"ts":' || ms || ',"page_id":"view"}' FROM shown""",
        "q25_cdc_orders": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'u' ELSE o_orderstatus END AS o_orderstatus, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'u' ELSE 'r' END AS op FROM orders WHERE o_orderkey % 5 <> 0
            UNION ALL SELECT -o_orderkey, 'c', o_custkey, 'c' FROM orders WHERE o_orderkey % 7 = 0""",
        "q26_config_by_arrival": """WITH e AS (SELECT 't' || (user_id % 20) AS tab, event_id % 2 AS odd, event_id * 2 AS arrival FROM events),
            k AS (SELECT 't' || (p_size % 20) AS tab, p_partkey % 2 AS odd, p_partkey * 8 + 1 AS at, p_partkey % 4 = 3 AS gone, p_size % 3 AS sink, 's' || p_partkey AS sink_table FROM part),
            met AS (SELECT arrival, gone, sink, sink_table FROM e ASOF LEFT JOIN k ON e.tab = k.tab AND e.odd = k.odd AND e.arrival >= k.at),
            fates AS (SELECT arrival, CASE WHEN gone OR gone IS NULL OR sink = 2 THEN 'dropped' WHEN sink = 0 THEN 'dimension' ELSE 'topic' END AS fate, sink_table FROM met)
            SELECT arrival, fate, CASE WHEN fate <> 'dropped' THEN sink_table END AS sink_table, CASE WHEN fate = 'dropped' THEN 2 ELSE 1 END AS n_columns FROM fates""",
        "q27_visit_pattern": """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
            s AS (SELECT * FROM e WHERE event_type = 'signup'), c AS (SELECT s.event_id AS signup, s.user_id, s.ms, min(c.n) AS n FROM s LEFT JOIN e c ON c.user_id = s.user_id AND c.event_type = 'click' AND c.n > s.n AND c.ms - s.ms < 7776000000 GROUP BY ALL),
            p AS (SELECT c.signup, c.user_id, c.n, min(p.n) AS m FROM c LEFT JOIN e p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND p.n > c.n AND p.ms - c.ms < 7776000000 GROUP BY ALL)
            SELECT CASE WHEN m IS NULL THEN 'timeout' ELSE 'match' END AS outcome, (1 + (p.n IS NOT NULL)::INTEGER + (m IS NOT NULL)::INTEGER)::INTEGER AS steps, signup, c.event_id AS click, b.event_id AS purchase
            FROM p LEFT JOIN e c ON c.user_id = p.user_id AND c.n = p.n LEFT JOIN e b ON b.user_id = p.user_id AND b.n = m""",
        "q28_segmented_keywords": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
        "order_to_province": f"WITH {_WIDE} SELECT {_window('o_orderdate', '30 days')}, province_id, province_name, count(DISTINCT o_orderkey) AS order_count, sum(l_extendedprice)::DOUBLE AS order_amount FROM wide GROUP BY ALL",
    }
