"""A snapshot, then its log: restarts, changes while the snapshot is read, each change once."""

import json
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemill.operators import dimensions
from tidemill.sources import cdc


def put_log(folder, name, *changes):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(json.dumps(c) for c in changes))
    (folder / f".{name}").rename(folder / f"{name}.json")


def change(position, op, i, v=None):
    row = {"id": i, "v": v}
    return {"op": op, "position": position, "before": row if op == "d" else None, "after": None if op == "d" else row}


def put_table(folder, rows):
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table({"id": [i for i, _ in rows], "v": [v for _, v in rows]}), folder / "part.parquet", row_group_size=10)


def run(spark, tmp_path, out="out"):
    q = cdc.table_changes(spark, str(tmp_path / "table"), str(tmp_path / "log"), "id").writeStream.format("json").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema("op string, position long, row string").json(str(tmp_path / out)).collect()
    return sorted((r.op, r.position, json.loads(r.row)["id"], json.loads(r.row)["v"]) for r in rows if r.op != "r"), sorted((json.loads(r.row)["id"], json.loads(r.row)["v"]) for r in rows if r.op == "r")


def test_snapshot_then_log_over_restarts(spark, tmp_path):
    put_table(tmp_path / "table", [(i, "old") for i in range(35)])
    put_log(tmp_path / "log", "001", change(1, "u", 3, "old"))  # the table holds this already
    log, snapshot = run(spark, tmp_path)
    assert log == [] and snapshot == [(i, "old") for i in range(35)]  # four splits
    put_log(tmp_path / "log", "002", change(2, "u", 3, "new"), change(3, "d", 4, "old"))
    assert run(spark, tmp_path) == ([("d", 3, 4, "old"), ("u", 2, 3, "new")], snapshot)
    put_log(tmp_path / "log", "003", change(4, "c", 99, "x"))
    assert run(spark, tmp_path)[0] == [("c", 4, 99, "x"), ("d", 3, 4, "old"), ("u", 2, 3, "new")]
    assert run(spark, tmp_path)[0] == [("c", 4, 99, "x"), ("d", 3, 4, "old"), ("u", 2, 3, "new")]  # nothing is read again


def test_a_first_batch_that_failed(spark, tmp_path):
    """Planned at one end of the log, read again after a restart, when table and log have moved on: still each change once."""
    put_table(tmp_path / "table", [(i, "old") for i in range(12)])
    put_log(tmp_path / "log", "001", change(1, "u", 3, "old"))
    run(spark, tmp_path, "lost")
    for f in (tmp_path / "ck/commits").iterdir():  # the batch has its offsets, but wasn't committed
        f.unlink()
    shutil.rmtree(tmp_path / "lost")
    put_table(tmp_path / "table", [(i, "new" if i == 5 else "old") for i in range(13) if i != 7])
    put_log(tmp_path / "log", "002", change(2, "u", 5, "new"), change(3, "d", 7, "old"), change(4, "c", 12, "old"))
    log, snapshot = run(spark, tmp_path)
    assert snapshot == [(i, "old") for i in range(12) if i not in (5, 7)]
    if not log:  # a restart may end with the batch it had to repeat
        log, again = run(spark, tmp_path)
        assert again == snapshot
    assert log == [("c", 4, 12, "old"), ("d", 3, 7, "old"), ("u", 2, 5, "new")]
    state = dict(snapshot)
    for op, _, i, v in sorted(log, key=lambda c: c[1]):
        state.pop(i, None) if op == "d" else state.update({i: v})
    assert state == {i: "new" if i == 5 else "old" for i in range(13) if i != 7}


def test_while_the_snapshot_is_read(tmp_path):
    """A change that comes between the plan and the reading of a split is left to the log, also if the split doesn't hold it yet."""
    put_table(tmp_path / "table", [(i, "old") for i in range(20)])
    reader = cdc.ChangeStream({"table": str(tmp_path / "table"), "log": str(tmp_path / "log"), "key": "id"})
    start, end = reader.initialOffset(), reader.latestOffset()
    splits = reader.partitions(start, end)
    first = list(reader.read(splits[0]))
    put_log(tmp_path / "log", "001", change(1, "u", 2, "a"), change(2, "u", 15, "b"))
    second = list(reader.read(splits[1]))
    assert [json.loads(r[2])["id"] for r in first + second] == [i for i in range(20) if i != 15]
    later = reader.latestOffset()
    assert [(r[0], json.loads(r[2])["v"]) for p in reader.partitions(end, later) for r in reader.read(p)] == [("u", "a"), ("u", "b")]
    assert reader.partitions(later, later) == []


def test_batch_form(spark):
    table = spark.createDataFrame([(i, "old") for i in range(6)], "id int, v string")
    log = spark.createDataFrame([(json.dumps(c),) for c in (change(1, "u", 2, "x"), change(2, "d", 3, "old"), change(3, "c", 9, "y"), change(4, "u", 2, "z"))], "value string")
    rows = cdc.snapshot_and_log(table, log, "id")
    assert rows.count() == 8 and rows.where("op = 'r'").count() == 4
    last = dimensions.last_rows(rows.withColumn("position", F.coalesce("position", F.lit(0))), ["key_"], ["position"]).where("op <> 'd'")
    assert sorted((r.key_, json.loads(r.v)["v"]) for r in last.select("key_", F.to_json("row").alias("v")).collect()) == [("0", "old"), ("1", "old"), ("2", "z"), ("4", "old"), ("5", "old"), ("9", "y")]
