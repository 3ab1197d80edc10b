"""Fixtures with known results, and streams against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions.keywords import keywords, register
from tidemill.operators import changes, dimensions, logs, stats, wide
from tidemill.schemas import CONFIG, LOG, ORDER_WIDE, PAYMENT_WIDE
from tidemill.sources import inputs
from tidemill.sources.outputs import DimensionTable, dimension_schema, table_sink
from tidemill.streaming import runners, stateful

#: A visit of one page, one that goes on after 4 s and later still, and a page that follows nothing of its own.
VISITS = [
    '{"common":{"mid":"ann"},"page":{"page_id":"start"},"ts":2000}',
    '{"common":{"mid":"bob"},"page":{"page_id":"offers","last_page_id":""},"ts":7000}',
    '{"common":{"mid":"bob"},"page":{"page_id":"shoes","last_page_id":"offers"},"ts":11000}',
    '{"common":{"mid":"bob"},"page":{"page_id":"basket","last_page_id":"shoes"},"ts":90000}',
    '{"common":{"mid":"cyd"},"page":{"page_id":"shoes","last_page_id":"offers"},"ts":5000}',
]


def at(rows):
    return sorted((r.common.mid, r.ts) for r in rows.collect())


def log(spark, rows):
    """(mid, page_id, last_page_id, ts, is_new)"""
    df = spark.createDataFrame([((m, None, None, None, n), (p, l, None, 1), None, None, t) for m, p, l, t, n in rows], LOG)
    return (df,)


def test_visits(spark):
    page = logs.split_log(inputs.parsed(inputs.literals(spark, VISITS), LOG)).page
    assert at(logs.bounces(page, [])) == [("ann", 2000)]  # nothing follows; bob's entry is followed within ten seconds
    assert at(logs.unique_visits(page, [])) == [("ann", 2000), ("bob", 7000)]  # cyd never entered
    m = stats.visitor_measures(page, logs.unique_visits(page, []), logs.bounces(page, [])).agg(F.sum("pv_ct"), F.sum("sv_ct"), F.sum("uj_ct")).first()
    assert tuple(m) == (5, 2, 1)


def test_jump_rules(spark):
    rows = [("a", "home", None, 0, "0"), ("a", "x", "home", 9999, "0"), ("b", "home", None, 0, "0"), ("b", "x", "home", 10000, "0"), ("c", "home", None, 0, "0"), ("c", "home", "", 3000, "0"), ("d", "home", None, 0, "0"), ("d", None, "home", 5000, "0")]
    assert at(logs.bounces(log(spark, rows)[0], [])) == [("b", 0), ("c", 3000)]


def test_is_new(spark):
    day = 86_400_000
    rows = [("m", "p", None, 0, "0"), ("m", "p", None, day, "1"), ("m", "p", None, 2 * day, "1"), ("m", "p", None, day + 5, "1")]
    out = {r.ts: r.common.is_new for r in logs.repair_is_new(log(spark, rows)[0]).collect()}
    assert out == {0: "0", day: "1", 2 * day: "0", day + 5: "1"}


def test_changes(spark):
    rows = spark.createDataFrame([("t", "bootstrap-insert", {"tm_name": "qq", "logo_url": "ww", "id": "15"}), ("t", "insert", {}), ("", "insert", {"id": "1"}), ("u", "insert", {"id": "1"}), ("t", "insert", None)], "`table` string, type string, data map<string,string>")
    config = spark.createDataFrame([("t", "insert", "hbase", "dim_t", "id,tm_name", "id", "")], CONFIG)
    routed = changes.route(changes.sane(rows), config)
    assert [(r.sink_table, r.data) for r in routed.dimension.collect()] == [("dim_t", {"tm_name": "qq", "id": "15"})] and routed.fact.isEmpty()
    lines = inputs.literals(spark, ['{"op":"c","source":{"db":"d","table":"t"},"after":{"id":"1"}}', '{"op":"d","source":{"db":"d","table":"t"},"after":null}'])
    assert [(r.table, r.type, r.data) for r in inputs.changes(lines).collect()] == [("t", "insert", {"id": "1"}), ("t", "delete", {})]


def test_dimension_table(spark, tmp_path):
    dim = DimensionTable(spark, str(tmp_path / "d"), "id,name")
    change = lambda *r: spark.createDataFrame(r, "data map<string,string>, type string, seq long")
    dim.upsert(change(({"id": "1", "name": "a"}, "insert", 1), ({"id": "1", "name": "it's"}, "update", 2), ({"id": "2", "name": "b"}, "insert", 3)), ["seq"])
    dim.upsert(change(({"id": "2", "name": "b"}, "delete", 4), ({"id": "3"}, "insert", 5)), ["seq"], honour_deletes=True)
    assert sorted(map(tuple, dim.read().collect())) == [("1", "it's"), ("3", None)]
    with pytest.raises(ValueError):
        dimension_schema("id,a b")


def test_interval_bounds_and_wide(spark):
    order = spark.createDataFrame([(1, 7, "1001", 5, 10.0, "2024-01-01 00:00:10")], "id long, province_id long, order_status string, user_id long, total_amount double, create_time string")
    for c in ("activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee", "create_date"):
        order = order.withColumn(c, F.lit(None).cast("string"))
    detail = spark.createDataFrame([(k, 1, 3, "s", t) for k, t in enumerate(("2024-01-01 00:00:05", "2024-01-01 00:00:15", "2024-01-01 00:00:16", "2024-01-01 00:00:04"))], "id long, order_id long, sku_id long, sku_name string, create_time string")
    for c in ("order_price", "sku_num", "split_total_amount", "split_activity_amount", "split_coupon_amount"):
        detail = detail.withColumn(c, F.lit(1))
    rows = wide.order_wide(wide.timed(order, "order_time"), wide.timed(detail, "detail_time"))
    assert sorted(r.detail_id for r in rows.collect()) == [0, 1]
    none = lambda *c: spark.createDataFrame([], ", ".join(f"{x} string" for x in ("id", *c)))
    sku = spark.createDataFrame([("3", "new", "8", "9", "4")], "id string, sku_name string, category3_id string, spu_id string, tm_id string")
    user = spark.createDataFrame([("5", "F", "2000-01-01")], "id string, gender string, birthday string")
    full = wide.with_dimensions(rows, user, none("name", "area_code", "iso_code", "iso_3166_2"), sku, none("spu_name"), none("name"), none("tm_name"), F.lit("2020-01-01").cast("date"))
    r = full.first()
    assert full.columns[:-1] == ORDER_WIDE and (r.sku_name, r.spu_id, r.user_age, r.user_gender, r.province_name) == ("new", 9, 20, "F", None)
    pay = spark.createDataFrame([(i, 1, None, 2.0, "s", "x", t, t) for i, t in enumerate(("2024-01-01 00:00:10", "2024-01-01 00:30:10", "2024-01-01 00:30:11"))], "id long, order_id long, user_id long, total_amount double, subject string, payment_type string, create_time string, callback_time string")
    paid = wide.payment_wide(wide.timed(pay, "pay_time"), full)
    assert paid.columns[:-1] == PAYMENT_WIDE and sorted((r.payment_id, r.user_id) for r in paid.collect()) == [(0, None), (0, None), (1, None), (1, None)]


def test_single_event_counts_orders(spark):
    order = spark.sql("select 1L sku_id, timestamp'2024-01-01' time, 5L order_id, 2L sku_num, 3.5 amount")
    r = stats.product_stats(stats.product_measures(order=order)).first()
    assert (r.order_ct, r.paid_order_ct, r.order_sku_num, float(r.order_amount)) == (1, 0, 2, 3.5)


def test_keywords(spark):
    assert spark.range(1).select(keywords(F.lit("Phone 12, ÉTÉ!"))).first()[0] == ["phone", "12", "été"]
    register(spark, str.split)
    spark.createDataFrame([("a b",), (None,)], "t string").createOrReplaceTempView("texts")
    assert sorted(r.word for r in spark.sql("select word from texts, lateral analyze_words(t)").collect()) == ["a", "b"]


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(3)
    times = sorted(rng.sample(range(0, 240_000), 260))
    rows = [(f"m{rng.randint(0, 2)}", rng.choice(["home", "list"]), rng.choice([None, "", "home"]), t, "1") for t in times]
    arrival = sorted(rows, key=lambda r: r[3] + rng.randint(0, 2800))
    end = [("z", "home", "x", 10_000_000, "0")]
    for k in range(4):
        part = arrival[k * 65 : (k + 1) * 65] + (end if k == 3 else [])
        log(spark, part)[0].coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(LOG).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    batch = log(spark, rows + end)[0]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for q in (runners.visit_layer(stream, out, f"{ck}/v"), runners.bounce_layer(stream, out, f"{ck}/b", 2000)):
        q.awaitTermination()
    by_day = lambda r: sorted((x.common.mid, x.ts // 86_400_000) for x in r.collect())
    assert by_day(spark.read.parquet(f"{out}/unique_visit")) == by_day(logs.unique_visits(batch, []))
    assert at(spark.read.parquet(f"{out}/user_jump")) == at(logs.bounces(batch, [], 2000))
    q = runners.log_layer(stream, f"{out}/log", f"{ck}/l")
    q.awaitTermination()
    claims = lambda r: sorted((x.common.mid, x.ts, x.common.is_new, x.page.page_id) for x in r.collect())
    assert claims(spark.read.parquet(f"{out}/log/page")) == claims(logs.repair_is_new(batch))
    windowed = stats.keyword_stats(stateful.with_event_time(stream).withColumn("w", F.col("page.page_id")), "w", "event_time")
    q = runners.start(windowed, table_sink(f"{out}/kw"), f"{ck}/k")
    q.awaitTermination()
    assert spark.read.parquet(f"{out}/kw").agg(F.sum("ct")).first()[0] == 260
