"""Open records: what nobody listed comes out as it went in, in batches and streams."""

import json
import os

from pyspark.sql import functions as F

from tidemill.functions import records
from tidemill.operators import changes, logs
from tidemill.schemas import CONFIG, OPEN_CHANGE
from tidemill.sources import inputs, outputs
from tidemill.streaming import runners

DAY = 86_400_000


def lines(spark, *rows):
    return inputs.literals(spark, [r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows])


def test_whitelisted_change_keeps_order_and_types(spark):
    """The listed fields in the record's order, numbers as numbers; nested values whole."""
    raw = lines(spark, '{"table":"t","type":"bootstrap-insert","data":{"tm_name":"qq","logo_url":"ww","id":15}}', '{"table":"t","type":"insert","data":{"id":16,"tags":[1,"2",{"a":null}],"price":1.50,"big":12345678901234567890123,"tm_name":{"de":"ä"}}}', '{"table":"t","type":"insert","data":{}}')
    config = spark.createDataFrame([("t", "insert", "kafka", "dwd_t", "id,tm_name,tags,price,big", "", "")], CONFIG)
    fact = changes.route(changes.sane(inputs.parsed(raw, OPEN_CHANGE)), config).fact
    assert sorted(r.v for r in fact.select(records.text(F.col("data")).alias("v")).collect()) == ['{"id":16,"tags":[1,"2",{"a":null}],"price":1.5,"big":12345678901234567890123,"tm_name":{"de":"ä"}}', '{"tm_name":"qq","id":15}']
    kinds = fact.select(records.field(F.col("data"), "id", "bigint").alias("id"), records.field(F.col("data"), "tags", "array<variant>").alias("t"), records.field(F.col("data"), "tm_name.de", "string").alias("n"))
    assert sorted((r.id, r.n) for r in kinds.collect()) == [(15, None), (16, "ä")]
    bin_log = lines(spark, '{"op":"u","source":{"db":"d","table":"t"},"after":{"id":1,"x":[true]}}', '{"op":"d","source":{"db":"d","table":"t"},"after":null}')
    assert [(r.type, r.v) for r in inputs.changes(bin_log, values="variant").select("type", records.text(F.col("data")).alias("v")).collect()] == [("update", '{"id":1,"x":[true]}'), ("delete", "{}")]


def test_what_is_a_record(spark):
    got = inputs.open_records(lines(spark, '{"b":1,"a":{"z":1,"y":[{}]}}', "[1]", "5", "no json", '{"a":1,"a":2}', "{}", '{"n":null}', ""))
    assert [r.v for r in got.select(records.text(F.col("record")).alias("v")).collect()] == ['{"b":1,"a":{"y":[{}],"z":1}}', "{}", '{"n":null}']
    r = F.col("record")
    changed = got.select(records.text(records.put(r, a=F.lit(7), c=F.lit("x"))).alias("p"), records.text(records.put_in(r, "a", "z", F.lit("0"))).alias("q"), records.text(records.keep(r, F.lit("b,n"))).alias("k")).collect()
    assert [tuple(x) for x in changed] == [('{"b":1,"a":7,"c":"x"}', '{"b":1,"a":{"y":[{}],"z":"0"}}', '{"b":1}'), ('{"a":7,"c":"x"}', "{}", "{}"), ('{"n":null,"a":7,"c":"x"}', '{"n":null}', '{"n":null}')]


LOGS = [
    {"common": {"mid": "a", "is_new": "1", "os": "x", "uid": 7}, "page": {"page_id": "home", "last_page_id": None, "during_time": 5, "source": {"t": [1]}}, "displays": [{"item_type": "sku_id", "item": "3", "order": 2, "pos": {"x": 1.5}}, {"item": 9, "ts": 1}, 5], "ts": DAY, "trace": [1, 2], "err": {"code": 4}},
    {"common": {"mid": "a", "is_new": "1", "os": "y"}, "page": {"page_id": "list", "last_page_id": "home"}, "ts": 2 * DAY, "event_id": 4},
    {"common": {"mid": "b", "is_new": "1"}, "start": {"entry": "icon", "ms": 12}, "ts": 3 * DAY, "extra": True},
    {"common": {"mid": "b", "is_new": "0"}, "start": {}, "page": {"page_id": "x"}, "ts": 3 * DAY + 1},
]


def parts(split):
    return {n: sorted(json.dumps(json.loads(r.v), sort_keys=True) for r in p.select(records.text(F.col("record")).alias("v")).collect()) for n, p in split._asdict().items()}


def want():
    repaired = json.loads(json.dumps(LOGS))
    repaired[1]["common"]["is_new"] = "0"
    shown = [{"item_type": "sku_id", "item": "3", "order": 2, "pos": {"x": 1.5}, "ts": DAY, "page_id": "home"}, {"item": 9, "ts": DAY, "page_id": "home"}]
    of = {"start": [repaired[2]], "page": [repaired[k] for k in (0, 1, 3)], "display": shown}
    return {n: sorted(json.dumps(x, sort_keys=True) for x in v) for n, v in of.items()}


def test_logs_go_through_whole(spark):
    open_ = inputs.open_logs(lines(spark, *LOGS, "[]", "no"))
    assert parts(logs.split_log(logs.repair_is_new(open_))) == want()
    assert [r.record for r in logs.bounces(open_, []).select(records.text(F.col("record")).alias("record")).collect()]


def test_streams_carry_whole_logs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, r in enumerate(LOGS):
        (tmp_path / f"in/{k}.json").write_text(json.dumps(r))
        os.utime(tmp_path / f"in/{k}.json", (1_700_000_000 + k,) * 2)
    stream = inputs.open_logs(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")))
    runners.log_layer(stream, str(tmp_path / "out"), str(tmp_path / "ck"), outputs.record_sink).awaitTermination()
    got = {n: sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out" / n)).collect()) for n in ("start", "page", "display")}
    assert got == want()
    runners.log_layer(stream, str(tmp_path / "table"), str(tmp_path / "ck2")).awaitTermination()
    back = spark.read.parquet(str(tmp_path / "table/page"))
    assert back.select("record").schema[0].dataType.simpleString() == "map<string,variant>"
    assert sorted(json.dumps(json.loads(r.v), sort_keys=True) for r in back.select(records.text(F.col("record")).alias("v")).collect()) == want()["page"]
