"""Config by arrival where one table and operation has many versions: sorted with the events, not joined by key."""

import bisect
import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import arrivals
from tidemill.schemas import CONFIG_CHANGE

EVENT = "`table` string, type string, data map<string,string>, arrival long"
CONFIG = CONFIG_CHANGE + ", arrival long"
AS = {
    "bigint": lambda a: a,
    "double": lambda a: a.cast("double"),
    "timestamp": F.timestamp_seconds,
    "string": lambda a: F.lpad(a.cast("string"), 6, "0"),
}


def told(at, key=("t", "insert"), kind="update"):
    data = {"source_table": key[0], "operate_type": key[1], "sink_type": "kafka", "sink_table": f"s{at}", "sink_columns": "id", "sink_pk": "", "sink_extend": ""}
    return {"database": "d", "table": "table_process", "type": kind, "data": data, "arrival": at}


@pytest.mark.parametrize("kind", sorted(AS))
def test_many_versions_of_one_key(spark, kind):
    rng = random.Random(5)
    at = rng.sample(range(1000, 9000), 400)
    gone = set(at[:80])
    configs = [told(a, kind="delete" if a in gone else "update") for a in at] + [told(50, ("rare", "insert")), told(60, ("t", None)), told(70, (None, "insert")), told(None)]
    # places of changes, before the first, after the last, the same twice
    places = sorted(at)[::3] + [rng.randrange(12_000) for _ in range(1500)] + [3, 3, 11_999]
    keys = [("t", "insert", p) for p in places] + [("rare", "insert", p) for p in (49, 50, 51, 8000, 11_000)] + [("t", "update", 5000), ("t", None, 5000), (None, "insert", 5000), ("t", "insert", None)]
    events = [{"table": t, "type": o, "data": {"id": str(n), "x": "1"}, "arrival": p} for n, (t, o, p) in enumerate(keys)]

    ordered, want = sorted(at), []
    for n, (t, o, p) in enumerate(keys):
        found = None
        if p is not None and (t, o) == ("t", "insert"):
            k = bisect.bisect_right(ordered, p)
            found = ordered[k - 1] if k else None
        elif (t, o) == ("rare", "insert"):
            found = 50 if p >= 50 else None
        ok = found is not None and found not in gone
        want.append((n, "topic" if ok else "dropped", f"s{found}" if ok else None, 1 if ok else 2))

    e, c = (spark.createDataFrame(rows, schema).withColumn("arrival", AS[kind](F.col("arrival"))) for rows, schema in ((events, EVENT), (configs, CONFIG)))
    e = e.withColumn("n", F.col("data.id").cast("int"))
    routed = arrivals.routed_by_arrival(e, c)
    assert routed.columns == [*e.columns, "sink_type", "sink_table", "sink_pk", "sink_extend", "fate"]
    assert dict(routed.dtypes)["arrival"] == kind
    assert "Join" not in routed._jdf.queryExecution().executedPlan().toString()  # a join by key looks at every version for every event
    got = routed.select("n", "fate", F.when(F.col("fate") != "dropped", F.col("sink_table")), F.size("data"))
    assert sorted(map(tuple, got.collect())) == want


def test_versions_of_one_arrival(spark, monkeypatch):
    """Changes of one key and arrival: one of them counts, in every range and for every event alike."""
    monkeypatch.setattr(arrivals, "OF_ONE", 1)
    twins = [told(10), told(10) | {"data": told(10)["data"] | {"sink_table": "twin"}}, told(900)]
    events = [{"table": "t", "type": "insert", "data": {"id": str(p)}, "arrival": p} for p in range(1000)]
    rows = arrivals.routed_by_arrival(spark.createDataFrame(events, EVENT), spark.createDataFrame(twins, CONFIG)).collect()
    assert len(rows) == 1000
    assert sum(r.fate == "dropped" for r in rows) == 10
    assert len({r.sink_table for r in rows if 10 <= r.arrival < 900}) == 1
    assert {r.sink_table for r in rows if r.arrival >= 900} == {"s900"}


def test_ranges_of_arrival(spark):
    """Ranges hold like numbers of rows; a time that a clock shows twice is cut at the right place."""
    rows = spark.range(16_000).select(F.pow("id", F.lit(2)).cast("bigint").alias("at_"))
    cuts = arrivals.cut(rows)
    sizes = [r["count"] for r in rows.groupBy(arrivals.range_of(F.col("at_"), cuts)).count().collect()]
    assert len(sizes) == arrivals.PARTS
    assert max(sizes) < 1100
    began = int(datetime.datetime(2024, 10, 27, 0, 0, tzinfo=datetime.timezone.utc).timestamp())
    hours = spark.range(3 * 3600).select("id", F.timestamp_seconds(F.col("id") + began).alias("at_"))
    parts = [r.p for r in hours.select("id", arrivals.range_of(F.col("at_"), arrivals.cut(hours.select("at_"))).alias("p")).orderBy("id").collect()]
    assert parts == sorted(parts)
    assert len(set(parts)) == arrivals.PARTS
    assert arrivals.cut(hours.select(F.col("at_").cast("string").alias("at_"))) == []
