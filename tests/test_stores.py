"""Keyed dimension tables and exact sinks: merged reads, batches tried again, failures at every step, bytes that lookups read."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemill.operators import dimensions
from tidemill.schemas import ORDER_DETAIL, ORDER_INFO
from tidemill.sources import exactly, inputs, keyed
from tidemill.sources.keyed import KeyedTable
from tidemill.streaming import runners

DIMENSIONS = {
    "user": ("id gender birthday", [("1", "F", "2000-01-01"), ("2", "M", "1990-06-01")]), "province": ("id name area_code iso_code iso_3166_2", [("1", "North", "11", "N", "P-N")]),
    "sku": ("id sku_name price spu_id category3_id tm_id", [("1", "shoe", "9.50", "5", "7", "3"), ("2", "coat", "80", "6", "9", "4")]), "spu": ("id spu_name", [("5", "shoes")]), "category3": ("id name", [("7", "feet"), ("9", "body")]), "trademark": ("id tm_name", [("3", "acme"), ("4", "zeta")]),
}
DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def changes(spark, rows):
    """(id, name, kind, seq)"""
    return spark.createDataFrame([({"id": i, "name": n} if i is not None else {}, k, s) for i, n, k, s in rows], "data map<string,string>, type string, seq long")


def rows_of(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_upserts_deletes_and_replays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "LAYERS", 4)
    monkeypatch.setattr(keyed, "SHARE", 10.0)
    table = KeyedTable(spark, str(tmp_path / "d"), "id,name", buckets=8)
    assert rows_of(table) == []
    want = {}
    for batch in range(9):
        some = [(str(k), f"n{batch}.{k}", "delete" if (k + batch) % 5 == 0 else "update", batch * 100 + k) for k in range(batch, batch + 12)]
        some += [("1", "stale", "update", -1), (None, None, "update", 5)]
        df = changes(spark, some)
        assert table.upsert(df, ["seq"], honour_deletes=True, batch=("job", batch))
        for k, n, kind, _ in some[:-2]:
            want.pop(k, None)
            if kind != "delete":
                want[k] = n
        if batch > 1:
            want["1"] = "stale"
        assert not table.upsert(changes(spark, [("99", "again", "update", 1)]), ["seq"], batch=("job", batch))  # tried again
        assert rows_of(table) == sorted(want.items(), key=str), batch
    # pointers and layers are bounded
    assert len(table.manifests.names()) <= keyed.KEPT + 1 and len(table.layers.names()) <= 2 * (keyed.LAYERS + 2)
    assert table.upsert(changes(spark, [("99", "other", "update", 1)]), ["seq"], batch=("second job", 0))
    assert ("99", "other") in rows_of(table)


def test_a_batch_writes_what_it_holds(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "d"), "id,name", buckets=16)
    table.upsert(spark.range(50_000).select(F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("name"), F.sha2(F.col("id").cast("string"), 256)).alias("data"), F.lit("insert").alias("type"), F.col("id").alias("seq")), ["seq"])
    size = lambda folder: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))
    before = size(tmp_path / "d")
    table.upsert(changes(spark, [("17", "seventeen", "update", 1), ("new", "n", "insert", 2)]), ["seq"], batch=("job", 1))
    assert size(tmp_path / "d") - before < before / 100
    number = table.version()[0]
    table.upsert(changes(spark, [("17", "seventeen", "update", 1)]), ["seq"], batch=("job", 1))
    assert table.version()[0] == number and size(tmp_path / "d") - before < before / 100
    asked = spark.createDataFrame([("17", 1), ("4711", 2), ("none", 3), (None, 4)], "k string, n int")
    found = dimensions.look_up(asked, table, {"k": "id"}, {"name": F.col("name")}).select("n", F.col("name").substr(1, 9).alias("name"))
    sha = spark.range(1).select(F.sha2(F.lit("4711"), 256)).first()[0][:9]
    assert sorted(map(tuple, found.collect())) == [(1, "seventeen"), (2, sha), (3, None), (4, None)]
    # four keys read at most four of sixteen buckets of the first layer, and of those only pages that can hold them
    rows = table.rows_of(asked, "k")
    files = {f for f in rows.inputFiles()} if hasattr(rows, "inputFiles") else set()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "bucket_" in plan and "In(id" in plan and len([f for f in files if "bucket_" in f]) <= 2 * 4 * 3
    assert table.rows_of(asked, "k").count() == 2


def test_lookups_with_many_keys_and_newer_layers_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "NAMED_KEYS", 3)
    table = KeyedTable(spark, str(tmp_path / "d"), "id,name", buckets=4)
    table.upsert(changes(spark, [(str(k), "old", "insert", k) for k in range(40)]), ["seq"])
    table.upsert(changes(spark, [("7", None, "delete", 1), ("8", "new", "update", 1)]), ["seq"], honour_deletes=True)
    asked = spark.createDataFrame([(str(k),) for k in range(0, 60, 2)] + [("7",)], "k string")
    got = {r.id: r.name for r in table.rows_of(asked, "k").collect()}
    assert {k: v for k, v in got.items() if k in {str(x) for x in range(0, 60, 2)}} == {str(k): "new" if k == 8 else "old" for k in range(0, 40, 2)} and "7" not in got


def test_bytes_read_grow_with_the_keys(spark, tmp_path):
    """Of 200,000 rows, lookups of few keys read few files' bytes, as Spark's own metrics have them."""
    table = KeyedTable(spark, str(tmp_path / "d"), "id,name", buckets=32)
    table.upsert(spark.range(200_000).select(F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("name"), F.sha2(F.col("id").cast("string"), 256)).alias("data"), F.lit("insert").alias("type"), F.col("id").alias("seq")), ["seq"])

    def scanned(n):
        rows = table.rows_of(spark.range(n).select((F.col("id") * 1009).cast("string").alias("k")), "k")
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan()
        files = 0
        for k in range(plan.collectLeaves().size()):
            m = plan.collectLeaves().apply(k).metrics()
            if m.contains("filesSize"):
                files += m.apply("filesSize").value()
        return rows.count(), files

    whole = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "d") for f in fs if f.endswith(".parquet"))
    one, few = scanned(1), scanned(6)
    assert one[0] == 1 and few[0] == 6
    if one[1]:  # Spark gives the sizes of the files that a scan chose
        assert one[1] < whole / 16 and few[1] < 6 * whole / 16


def test_wide_job_by_keyed_dimensions(spark, tmp_path):
    """The order job with its dimensions as keyed tables gives what it gives with frames."""
    clock = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    order = [{"id": i, "province_id": i % 3, "user_id": i % 4, "create_time": clock(20 * i)} for i in range(1, 21)]
    detail = [{"id": 100 + i, "order_id": i, "sku_id": i % 3, "sku_name": "old", "create_time": clock(20 * i + 2)} for i in range(1, 21)]
    for n, rows in (("order", order), ("detail", detail)):
        (tmp_path / n).mkdir()
        for k in range(2):
            (tmp_path / n / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[10 * k : 10 * k + 10]))
    orders, details = (spark.readStream.schema(s).option("maxFilesPerTrigger", 1).json(str(tmp_path / n)) for n, s in (("order", ORDER_INFO), ("detail", ORDER_DETAIL)))
    frames = {n: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names.split())) for n, (names, rows) in DIMENSIONS.items()}
    stores = {}
    for n, (names, rows) in DIMENSIONS.items():
        stores[n] = KeyedTable(spark, str(tmp_path / "dims" / n), names.replace(" ", ","), buckets=4)
        stores[n].upsert(spark.createDataFrame([(dict(zip(names.split(), r, strict=True)), "insert", 1) for r in rows], "data map<string,string>, type string, seq long"), ["seq"])
    as_of = F.lit("2020-01-01").cast("date")
    for n, dims in (("a", frames), ("b", stores)):
        runners.order_wide_layer(orders, details, lambda dims=dims: dims, as_of, str(tmp_path / n), str(tmp_path / f"ck-{n}")).awaitTermination()
    got = [sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / n)).drop("batch").collect()), key=str) for n in ("a", "b")]
    assert got[0] == got[1] and len(got[0]) == 20


def test_a_cut_off_manifest_and_a_second_writer(spark, tmp_path):
    path = str(tmp_path / "d")
    one, two = KeyedTable(spark, path, "id,name", buckets=4), KeyedTable(spark, path, "id,name", buckets=4)
    one.upsert(changes(spark, [("1", "a", "insert", 1)]), ["seq"])
    (tmp_path / "d/versions/000000000002.json").write_text('{"layers": [')  # a writer died here
    two.upsert(changes(spark, [("2", "b", "insert", 1)]), ["seq"])
    assert rows_of(one) == [("1", "a"), ("2", "b")]
    # both want the same number: the second takes the next one
    taken = one._next

    def late(number):
        one._next = taken
        two.upsert(changes(spark, [("3", "c", "insert", 1)]), ["seq"])
        return taken(number) - 1

    one._next = late
    one.upsert(changes(spark, [("4", "d", "insert", 1)]), ["seq"])
    assert rows_of(two) == [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")]


def records(spark, rows):
    return spark.createDataFrame(rows, "sink_table string, data map<string,string>")


def test_topics_are_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    some = records(spark, [("a", {"n": "1"}), ("b/c", {"n": "2\n"}), ("a", {"n": "3"}), (None, {"n": "4"}), ("a", None)]).repartition(3)
    write = exactly.topics_sink(path)
    write(some, 0)
    write(some, 0)  # tried again after all was done
    lost = exactly.TopicWriter({"path": path, "batch": "1"})
    staged = lost.write(iter([("a", "{}"), ("c", "{}")]))  # the driver was lost before the ledger had this
    aborted = exactly.TopicWriter({"path": path, "batch": "1"})
    aborted.abort([aborted.write(iter([("a", "{}")])), None])
    write(records(spark, [("a", {"n": "5"})]), 1)
    got = sorted((r.topic, json.loads(r.value)["n"], r.batch) for r in exactly.read_topics(spark, path).collect())
    assert got == [("a", "1", 0), ("a", "3", 0), ("a", "5", 1), ("b/c", "2\n", 0)]
    listed = sum(len(p.read_text().splitlines()) for p in (tmp_path / "t/ledger").glob("*.json"))
    files = [f for d, _, fs in os.walk(f"{path}/topics") for f in fs if f.endswith(".jsonl")]
    assert len(files) == listed + len(staged.files)  # nothing of the repeated and the aborted batch
    broken = some.withColumn("data", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("data")))
    with pytest.raises(Exception, match="lost"):
        write(broken, 2)
    (tmp_path / "t/topics/topic=a/orphan.jsonl").write_text('{"n":"9"}\n')  # of a lost task
    assert exactly.tidy(spark, path, older_s=-5) >= 3
    assert exactly.read_topics(spark, path).count() == 4


def test_topics_of_a_stream(spark, tmp_path):
    """A stream writer with task messages: restarted without its last commit, it leaves one copy."""
    spark.dataSource.register(exactly.TopicSource)
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.json").write_text(json.dumps({"sink_table": f"t{k % 2}", "data": {"k": str(k)}}) + "\n")

    def run():
        df = spark.readStream.schema("sink_table string, data map<string,string>").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = exactly.topic_rows(df).writeStream.format(exactly.TOPICS).option("path", str(tmp_path / "t")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    for f in (tmp_path / "ck/commits").iterdir():
        if f.name.lstrip(".").startswith("2"):
            f.unlink()
    run()  # batch 2 is tried again
    assert sorted(json.loads(r.value)["k"] for r in exactly.read_topics(spark, str(tmp_path / "t")).collect()) == ["0", "1", "2"]


def test_jdbc_rows_are_written_once(spark, tmp_path, monkeypatch):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    some = spark.createDataFrame([(1, "it's"), (2, "b")], "id int, name string")
    write = exactly.exact_jdbc_sink(url, "stat", ["id", "name"], job="j", **DERBY)
    write(some.withColumn("transient", F.lit(1)), 0)
    write(some, 0)
    read = lambda: sorted(map(tuple, inputs.jdbc(spark, url, "stat", **DERBY).collect()))
    assert read() == [(1, "it's"), (2, "b")]
    connect = exactly._connect

    class Lost:
        """A connection that is lost at its commit."""

        def __init__(self, c):
            self.c = c

        def __getattr__(self, name):
            return getattr(self.c, name)

        def commit(self):
            self.c.rollback()
            raise OSError("lost")

    monkeypatch.setattr(exactly, "_connect", lambda *a: Lost(connect(*a)))
    with pytest.raises(OSError, match="lost"):
        write(some.withColumn("id", F.col("id") + 10), 1)
    monkeypatch.undo()
    assert len(read()) == 2
    write(some.withColumn("id", F.col("id") + 10), 1)
    write(some.withColumn("id", F.col("id") + 10), 1)
    assert read() == [(1, "it's"), (2, "b"), (11, "it's"), (12, "b")]
    with pytest.raises(ValueError):
        exactly.exact_jdbc_sink(url, "stat; drop", ["id"])


def test_change_job_with_exact_topics(spark, tmp_path):
    """The job of changes by config, its topics by ledger: open rows keep their types."""
    lines = ['{"table":"brand","type":"insert","data":{"tm_name":"qq","logo_url":"ww","id":15}}', '{"table":"bill","type":"insert","data":{"id":9,"sum":1.25,"tags":["a",{"b":null}],"x":true}}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(lines))
    from tidemill.schemas import CONFIG, OPEN_CHANGE

    config = spark.createDataFrame([("brand", "insert", "hbase", "dim_brand", "id,tm_name", "id", ""), ("bill", "insert", "kafka", "dwd_bill", "id,sum,tags", "", "")], CONFIG)
    stream = inputs.parsed(inputs.lines(spark, str(tmp_path / "in")), OPEN_CHANGE + ", seq bigint")
    dim = KeyedTable(spark, str(tmp_path / "dim"), "id,tm_name", "id")
    runners.change_layer(stream, lambda: config, str(tmp_path / "out"), str(tmp_path / "ck"), lambda _: dim, ["seq"], facts=exactly.topics_sink(str(tmp_path / "out/facts"))).awaitTermination()
    assert [(r.topic, r.value) for r in exactly.read_topics(spark, str(tmp_path / "out/facts")).collect()] == [("dwd_bill", '{"id":9,"sum":1.25,"tags":["a",{"b":null}]}')]
    assert rows_of(dim) == [("15", "qq")]
