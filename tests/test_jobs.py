"""The layered jobs as streams against their batch forms, row by row; config changes, sources and sinks run once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemill.functions.scalars import millis_of, route_key
from tidemill.operators import changes, dimensions, logs, stats, wide
from tidemill.schemas import CHANGE, KEYWORD_STATS, LOG, ORDER_DETAIL, ORDER_INFO, ORDER_WIDE, PAYMENT_INFO, PAYMENT_WIDE, PRODUCT_STATS, PROVINCE_STATS, SKU_EVENT, VISITOR_STATS
from tidemill.sources import inputs, outputs
from tidemill.streaming import runners

as_of = lambda: F.lit("2020-01-01").cast("date")


def clock(s):
    return f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


def stream_of(spark, folder, rows, schema, files=3):
    """The rows as JSON files, read one by one, and as a batch."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    rows = [dict(zip(names, r, strict=True)) if isinstance(r, tuple) else r for r in rows]
    folder.mkdir(parents=True)
    size = -(-len(rows) // files)
    for k in range(files):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k * size : (k + 1) * size]))
        os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # the order in which a stream reads them
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), spark.read.schema(schema).json(str(folder))


def rows_of(df, leave=("ts",)):
    return sorted((tuple(r) for r in df.select(*(c for c in df.columns if c not in (*leave, "batch"))).collect()), key=str)


def money(n=None):
    return None if n is None else float(n)


@pytest.fixture(scope="module")
def dims(spark):
    table = lambda names, rows: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    return {
        "user": table("id gender birthday", [("1", "F", "2000-01-01"), ("2", "M", "1990-06-01")]),
        "province": table("id name area_code iso_code iso_3166_2", [("1", "North", "11", "N", "P-N"), ("2", "South", "12", "S", "P-S")]),
        "sku": table("id sku_name price spu_id category3_id tm_id", [("1", "shoe", "9.50", "5", "7", "3"), ("2", "coat", "80", "6", "9", "4")]),
        "spu": table("id spu_name", [("5", "shoes")]),
        "category3": table("id name", [("7", "feet"), ("9", "body")]),
        "trademark": table("id tm_name", [("3", "acme"), ("4", "zeta")]),
    }


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("facts")
    order = [(i, i % 3, "1001", i % 4, money(10 * i), None, None, money(11 * i), None, None, clock(20 * i), None, "2024-01-01", None) for i in range(1, 31)]
    detail = [(100 * i + k, i, k, money(i), 2, "old name", clock(20 * i + k * 3), money(i + k), None, None) for i in range(1, 31) for k in range(1, 4)]  # the third is too late
    pay = [(900 + i, i, i % 2 or None, money(10 * i), "s", "card", clock(20 * i + 1500 + (i % 2) * 600), clock(20 * i)) for i in range(1, 31)]
    return {n: stream_of(spark, at / n, r, s) for n, r, s in (("order", order, ORDER_INFO), ("detail", detail, ORDER_DETAIL), ("pay", pay, PAYMENT_INFO))}


def test_wide_jobs(spark, tmp_path, dims, facts):
    (order, orders), (detail, details), (pay, pays) = facts["order"], facts["detail"], facts["pay"]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    runners.order_wide_layer(order, detail, lambda: dims, as_of(), f"{out}/order_wide", f"{ck}/o").awaitTermination()
    want = wide.with_dimensions(wide.order_wide(wide.timed(orders, "order_time"), wide.timed(details, "detail_time")), **dims, as_of=as_of())
    got = spark.read.parquet(f"{out}/order_wide")
    assert [c for c in got.columns if c not in ("batch", "order_time")] == ORDER_WIDE
    assert rows_of(got) == rows_of(want) and len(rows_of(got)) == 30
    first = got.where("order_id = 4 and sku_id = 1").first()
    assert (first.sku_name, first.spu_name, first.category3_name, first.tm_name, first.province_name, first.user_age) == ("shoe", "shoes", "feet", "acme", "North", None)
    wide_stream = spark.readStream.schema(got.drop("batch").schema).option("recursiveFileLookup", "true").parquet(f"{out}/order_wide")
    runners.payment_wide_layer(pay, wide_stream, f"{out}/payment_wide", f"{ck}/p").awaitTermination()
    paid = wide.payment_wide(wide.timed(pays, "pay_time"), want)
    back = spark.read.parquet(f"{out}/payment_wide")
    assert [c for c in back.columns if c not in ("batch", "pay_time")] == PAYMENT_WIDE and rows_of(back) == rows_of(paid) and 0 < len(rows_of(back)) < 30


def closed(rows, before):
    """Rows of windows that end before a time."""
    return rows.where(F.col("edt") <= before)


def test_province_job(spark, tmp_path, dims, facts):
    want = wide.with_dimensions(wide.order_wide(wide.timed(facts["order"][1], "order_time"), wide.timed(facts["detail"][1], "detail_time")), **dims, as_of=as_of())
    folder = tmp_path / "wide"
    for k in range(2):
        want.where(F.col("order_id") % 2 == k).coalesce(1).write.parquet(str(folder / str(k)))
    late = want.limit(1).withColumn("order_time", F.lit(clock(50_000)).cast("timestamp"))
    late.write.parquet(str(folder / "9"))
    stream = spark.readStream.schema(want.schema).option("recursiveFileLookup", "true").parquet(str(folder))
    runners.province_layer(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    keys = ["province_id", "province_name", "area_code", "iso_code", "iso_3166_2"]
    batch = stats.province_stats(want.select("*", F.col("province_area_code").alias("area_code"), F.col("province_iso_code").alias("iso_code"), F.col("province_3166_2_code").alias("iso_3166_2")), keys, "order_time")
    assert [c for c in got.columns if c != "batch"] == PROVINCE_STATS
    assert rows_of(got) == rows_of(batch.select(*PROVINCE_STATS[:-1])) and got.where("ts is null").isEmpty()


def page_rows(seconds, mids=3):
    rows = []
    for s in range(0, seconds, 2):
        page = {"page_id": ["home", "good_list", "good_detail"][s // 2 % 3], "last_page_id": None if s % 6 == 0 else "home", "item": ["red shoe", "1", "2"][s // 2 % 3], "during_time": s}
        shown = [{"item_type": "sku_id", "item": "2"}, {"item_type": "activity", "item": "1"}] if s % 5 == 0 else None
        rows.append({"common": {"mid": f"m{s % mids}", "vc": "v1", "ch": f"c{s % 2}", "ar": "1", "is_new": "1"}, "page": page, "displays": shown, "ts": 1_704_067_200_000 + 1000 * s})
    return rows


END = 100_000


def test_visitor_and_keyword_jobs(spark, tmp_path):
    rows = [*page_rows(120), {"common": {"mid": "z"}, "page": {"page_id": "good_list", "last_page_id": "x", "item": "end"}, "ts": 1_704_067_200_000 + 1000 * END}]
    page, pages = stream_of(spark, tmp_path / "page", rows, LOG)
    visits, jumps = logs.unique_visits(pages, []), logs.bounces(pages, [], 3000)
    parts = {}
    for name, part in (("visit", visits), ("jump", jumps.where("common.mid <> 'z'"))):
        part.coalesce(1).write.json(str(tmp_path / name))
        parts[name] = spark.readStream.schema(LOG).json(str(tmp_path / name))
    runners.visitor_layer(page, parts["visit"], parts["jump"], str(tmp_path / "v"), str(tmp_path / "ckv"), "600 seconds").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "v"))
    want = stats.visitor_stats(stats.visitor_measures(pages, visits, jumps.where("common.mid <> 'z'")).withColumn("time", F.timestamp_millis("ts")), "time")
    assert [c for c in got.columns if c != "batch"] == VISITOR_STATS
    assert rows_of(got) == rows_of(closed(want, clock(1000))) and got.agg(F.sum("uj_ct")).first()[0] > 0
    runners.keyword_layer(page, str(tmp_path / "k"), str(tmp_path / "ckk")).awaitTermination()
    words = spark.read.parquet(str(tmp_path / "k"))
    assert [c for c in words.columns if c != "batch"] == KEYWORD_STATS
    want = stats.keyword_stats(stats.searched(pages).withColumn("time", F.timestamp_millis("ts")), "fullword", "time")
    assert rows_of(words) == rows_of(closed(want, clock(1000)).select(*KEYWORD_STATS[:-1])) and not words.isEmpty()


def test_product_job(spark, tmp_path, dims):
    time = lambda df: df.withColumn("time", F.to_timestamp("create_time"))
    event = lambda n, k: [(s % 3, s // 2, money(s), "1201" if s % 2 else "1202", clock(s)) for s in range(n, 100, k)] + [(1, 1, None, None, clock(END // 2))]
    page, pages = stream_of(spark, tmp_path / "page", page_rows(120), LOG)
    made = {n: stream_of(spark, tmp_path / n, event(i, 3 + i), SKU_EVENT) for i, n in enumerate(("favor", "cart", "order", "payment", "refund", "comment"))}
    more = lambda n, df: df.withColumns({"order": {"sku_num": F.lit(2), "amount": F.col("refund_amount")}, "payment": {"amount": F.col("refund_amount")}}.get(n, {})) if n in ("order", "payment") else df
    sources = [{n: more(n, time(v[k])) for n, v in made.items()} | {"page": (page, pages)[k].withColumn("time", F.timestamp_millis("ts"))} for k in (0, 1)]
    goods = {k: v for k, v in dims.items() if k in ("sku", "spu", "category3", "trademark")}
    runners.product_layer(lambda: goods, str(tmp_path / "out"), str(tmp_path / "ck"), "600 seconds", **sources[0]).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = stats.with_product_dimensions(stats.product_stats(stats.product_measures(**sources[1])), **goods)
    assert [c for c in got.columns if c != "batch"] == PRODUCT_STATS
    assert rows_of(got) == rows_of(closed(want, clock(1000)).select(*PRODUCT_STATS[:-1]))
    sums = got.agg(*(F.sum(c).alias(c) for c in (*stats.PRODUCT_SUMS, *stats.PRODUCT_ORDERS))).first()
    assert all(x > 0 for x in sums)
    shoe = got.where("sku_id = 1").first()
    assert (shoe.sku_name, float(shoe.sku_price), shoe.spu_name, shoe.tm_name, shoe.category3_name) == ("shoe", 9.5, "shoes", "acme", "feet")


def test_changes_by_config(spark, tmp_path):
    """Config changes make the routing table and the dimension tables; changes go there, and to a folder for each topic."""
    of = lambda *r: dict(zip(("source_table", "operate_type", "sink_type", "sink_table", "sink_columns", "sink_pk", "sink_extend"), r, strict=True))
    lines = [
        ("insert", of("goods", "insert", "hbase", "dim_goods", "id,name", "", None), 1), ("insert", of("goods", "update", "hbase", "dim_old", "id", "", None), 2), ("update", of("goods", "update", "hbase", "dim_goods", "id,name", "", None), 3),
        ("insert", of("bill", "insert", "kafka", "dwd_bill", "id,sum", "", None), 4), ("insert", of("gone", "insert", "kafka", "dwd_gone", "id", "", None), 5), ("delete", of("gone", "insert", "kafka", "dwd_gone", "id", "", None), 6),
    ]
    folder = tmp_path / "config"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"database": "d", "table": "table_process", "type": t, "data": d, "seq": n}) for t, d, n in lines) + "\nnot json")
    raw = spark.read.text(str(folder))
    found = inputs.config_changes(raw).withColumn("seq", F.monotonically_increasing_id())
    config, tables = runners.config_dimensions(spark, found, ["seq"], str(tmp_path / "dims"))
    assert sorted((r.source_table, r.operate_type, r.sink_table) for r in config.collect()) == [("bill", "insert", "dwd_bill"), ("goods", "insert", "dim_goods"), ("goods", "update", "dim_goods")]
    assert list(tables) == ["dim_goods"] and tables["dim_goods"].read().columns == ["id", "name"]
    assert [r.k for r in config.where("source_table = 'bill'").select(route_key(F.col("source_table"), F.col("operate_type")).alias("k")).collect()] == ["bill:insert"]
    rows = [("goods", "bootstrap-insert", {"id": "1", "name": "shoe", "x": "y"}, 1), ("bill", "insert", {"id": "9", "sum": "3"}, 2), ("goods", "update", {"id": "1", "name": "boot"}, 3), ("gone", "insert", {"id": "1"}, 4), ("bill", "update", {"id": "9"}, 5)]
    stream, _ = stream_of(spark, tmp_path / "changes", rows, CHANGE + ", seq bigint")
    runners.change_layer(stream, lambda: config, str(tmp_path / "out"), str(tmp_path / "ck"), tables.__getitem__, ["seq"]).awaitTermination()
    assert [tuple(r) for r in tables["dim_goods"].read().collect()] == [("1", "boot")]
    facts = spark.read.parquet(str(tmp_path / "out/facts"))
    assert [(r.sink_table, json.loads(r.value)) for r in facts.collect()] == [("dwd_bill", {"id": "9", "sum": "3"})]
    topics = spark.createDataFrame([("s.db.goods", "c", {"id": "1"}), ("s.db.goods", "d", None)], "topic string, op string, after map<string,string>")
    assert [tuple(r) for r in inputs.changes_of_topics(topics).collect()] == [("db", "goods", "insert", {"id": "1"}), ("db", "goods", "delete", {})]


def test_sources_and_sinks(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"mid": "a", "ts": 5}\nnot json\n')
    read = inputs.parsed(inputs.lines(spark, str(tmp_path / "in")), "mid string, ts bigint")
    runners.start(read, outputs.table_sink(str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.mid, r.ts) for r in rows.collect()] == [("a", 5)]
    assert json.loads(outputs.json_lines(rows.drop("batch")).first().value) == {"mid": "a", "ts": 5}
    outputs.console_sink("tag", 5)(rows, 3)
    assert "tag, batch 3" in capsys.readouterr().out
    inputs.as_view(rows, "seen", "ts")
    assert spark.sql("select count(*) n from seen").first().n == 1
    dim = spark.createDataFrame([("1", "it's"), ("2", "b")], "id string, name string")
    dim.write.parquet(str(tmp_path / "dim"))
    assert inputs.dimension(spark, str(tmp_path / "dim"), {"name": "it's"}).first().id == "1"
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    write = outputs.jdbc_sink(url, "stat", ["id", "name"], driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    for batch in (0, 1):
        write(dim.withColumn("transient", F.lit(1)), batch)
    assert inputs.jdbc(spark, url, "stat", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").count() == 4
    assert spark.range(1).select(millis_of(F.lit("2024-01-01 00:00:01"))).first()[0] == 1_704_067_201_000


def test_lookups(spark):
    """Two keys, keys of other types, missing rows, repeated keys: the smallest row, in every run."""
    rows = spark.createDataFrame([(1, "a", "old"), (2, "b", "old"), (None, "a", "old")], "k long, l string, name string")
    dim = spark.createDataFrame([("1", "a", "y", 2), ("1", "a", "x", 5), ("2", "z", "z", 1), ("no number", "a", "w", 1)], "id string, l string, name string, n int")
    got = dimensions.look_up(rows, dim, {"k": "id", "l": "l"}, {"name": F.col("name"), "n": F.col("n")})
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", "x", 5), (2, "b", "old", None), (None, "a", "old", None)], key=str)
    bare = changes.new_dimensions(spark.createDataFrame([], "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, sink_extend string"))
    assert bare.isEmpty()
