"""Operators with memory of each key: config by arrival, patterns, distinct counts, band joins, restarts; batches, streams and brute force."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemill.functions.scalars import is_entry
from tidemill.operators import arrivals, logs, patterns, stats, wide
from tidemill.schemas import CONFIG_CHANGE, LOG
from tidemill.sources import outputs
from tidemill.streaming import runners, stateful, supervise

EVENT = "`table` string, type string, data map<string,string>, arrival long"
CONFIG = CONFIG_CHANGE + ", arrival long"


def files(folder, rows, n):
    """JSON files in the order in which a stream reads them; empty ones too."""
    folder.mkdir(parents=True)
    size = -(-len(rows) // n) or 1
    for k in range(n):
        (folder / f"{k:02d}.json").write_text("\n".join(json.dumps(r) for r in rows[k * size : (k + 1) * size]))
        os.utime(folder / f"{k:02d}.json", (1_700_000_000 + k,) * 2)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def interleaving(seed):
    rng = random.Random(seed)
    events, configs, fates, now = [], [], [], {}
    for at in range(240):
        key = (f"t{rng.randint(0, 3)}", rng.choice(["insert", "update"]))
        if rng.random() < 0.3:
            kind = rng.choice(["insert", "update", "update", "delete"])
            data = {"source_table": key[0], "operate_type": key[1], "sink_type": rng.choice(["hbase", "kafka", "other"]), "sink_table": f"s{at}", "sink_columns": rng.choice(["id", "id,x", "none"]), "sink_pk": "", "sink_extend": ""}
            configs.append({"database": "d", "table": "table_process", "type": kind, "data": data, "arrival": at})
            now[key] = None if kind == "delete" else data
        else:
            row = {"table": key[0], "type": key[1], "data": {"id": str(at), "x": "1", "y": "2"}, "arrival": at}
            events.append(row)
            c = now.get(key)
            fate = {"hbase": "dimension", "kafka": "topic"}.get(c and c["sink_type"], "dropped")
            data = row["data"] if fate == "dropped" else {k: v for k, v in row["data"].items() if k in c["sink_columns"].split(",")}
            fates.append((at, fate, None if fate == "dropped" else c["sink_table"], tuple(sorted(data.items()))))
    return events, configs, sorted(fates)


def seen(rows):
    return sorted((r.arrival, r.fate, None if r.fate == "dropped" else r.sink_table, tuple(sorted(r.data.items()))) for r in rows.collect())


@pytest.mark.parametrize("few", [True, False])
def test_config_by_arrival(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(arrivals, "VERSIONS", 3)
    for seed in (1, 2):
        events, configs, want = interleaving(seed)
        routed = arrivals.routed_by_arrival(spark.createDataFrame(events, EVENT), spark.createDataFrame(configs, CONFIG))
        assert seen(routed) == want
        assert sum(r.n for r in arrivals.dropped(routed).collect()) == sum(f[1] == "dropped" for f in want) > 0
        parts = arrivals.split(routed)
        assert parts.dimension.count() + parts.fact.count() == sum(f[1] != "dropped" for f in want)


def test_config_by_arrival_on_streams(spark, tmp_path):
    """Both streams come file by file in the order of arrival: events of a batch meet the config before them in it."""
    events, configs, want = interleaving(3)
    cuts = [0, 60, 61, 150, 240]
    for name, rows in (("e", events), ("c", configs)):
        (tmp_path / name).mkdir()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            (tmp_path / name / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows if a <= r["arrival"] < b))
            os.utime(tmp_path / name / f"{k}.json", (1_700_000_000 + k,) * 2)
    routed = stateful.routed_by_arrival(stream(spark, tmp_path / "e", EVENT), stream(spark, tmp_path / "c", CONFIG))
    runners.start(routed, outputs.table_sink(str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination()
    assert seen(spark.read.parquet(str(tmp_path / "out"))) == want


def brute(events, strict, within):
    """(outcome, ids) of each start, looking ahead from it."""
    out = []
    by = {}
    for e in sorted(events, key=lambda e: (e["ts"], e["n"])):
        by.setdefault(e["k"], []).append(e)
    for rows in by.values():
        for i, first in enumerate(rows):
            if "a" not in first["kind"]:
                continue
            got, result = [first["n"]], "timeout"
            for e in rows[i + 1 :]:
                if e["ts"] - first["ts"] >= within:
                    break
                if "abc"[len(got)] in e["kind"]:
                    got.append(e["n"])
                    if len(got) == 3:
                        result = "match"
                        break
                elif strict[len(got)]:
                    result = None
                    break
            if result:
                out.append((result, tuple(got)))
    return sorted(out)


def found(rows):
    return sorted((r.outcome, tuple(r[s].n for s in ("one", "two", "three") if r[s] is not None)) for r in rows.collect())


def three(strict):
    has = lambda c: F.col("kind").contains(c)
    p = patterns.begin("one", has("a"))
    for name, c, s in (("two", "b", strict[1]), ("three", "c", strict[2])):
        p = p.next(name, has(c)) if s else p.followed_by(name, has(c))
    return p.within(50)


@pytest.mark.parametrize("strict", [(False, False, False), (False, True, False), (False, False, True), (False, True, True)])
def test_patterns_equal_brute_force(spark, strict):
    rng = random.Random(sum(x << i for i, x in enumerate(strict)))
    events = [{"k": f"k{rng.randint(0, 3)}", "ts": rng.randint(0, 400), "n": n, "kind": rng.choice(["a", "b", "c", "x", "ab", "bc", "abc", ""])} for n in range(500)]
    df = spark.createDataFrame([*events, {"k": None, "ts": 5, "n": 9999, "kind": "a"}], "k string, ts long, n long, kind string").repartition(5)
    assert found(patterns.matched(df, three(strict), "k", "ts", ["n"])) == brute(events, strict, 50)
    assert patterns.matched(df.where("false"), three(strict), "k").collect() == []


def test_patterns_on_streams(spark, tmp_path):
    rng = random.Random(8)
    events = [{"k": f"k{rng.randint(0, 2)}", "ts": 1_000_000 + rng.randint(0, 4000), "n": n, "kind": rng.choice(["a", "b", "c", "x", "ab", "bc"])} for n in range(240)]
    arrival = sorted(events, key=lambda e: e["ts"] + rng.randint(0, 900))
    end = {"k": "z", "ts": 9_000_000, "n": 10_000, "kind": "x"}
    files(tmp_path / "in", [*arrival, end], 5)
    schema, strict = "k string, ts long, n long, kind string", (False, False, True)
    df = stateful.with_event_time(stream(spark, tmp_path / "in", schema), "1 second")
    runners.start(stateful.matched(df, three(strict), "k", "ts", ["n"]), outputs.table_sink(str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination()
    assert found(spark.read.parquet(str(tmp_path / "out"))) == brute(events, strict, 50)


def test_a_bounce_is_a_pattern(spark):
    rng = random.Random(4)
    rows = [((f"m{rng.randint(0, 4)}", None, None, None, "1"), (rng.choice(["home", None]), rng.choice([None, "", "x"]), None, 1), None, None, t) for t in rng.sample(range(0, 400_000), 400)]
    df = spark.createDataFrame(rows, LOG)
    p = patterns.begin("entry", is_entry(F.col("page.last_page_id"))).next("second", F.col("page.page_id").isNotNull()).within(10_000)
    late = patterns.matched(df, p, "common.mid").where("outcome = 'timeout'").select("entry.*")
    at = lambda d: sorted((r.common.mid, r.ts) for r in d.collect())
    assert at(late) == at(logs.bounces(df, [])) and at(late)


def test_distinct_orders_on_a_stream_keep_small_rows(spark, tmp_path):
    """A hot product with many orders: equal to the batch form, and no state row holds more than one order."""
    rows = [{"sku_id": 1 if n % 3 else n % 5, "order_id": n % 700, "sku_num": 1, "amount": 1.0, "at": 1_700_000_000_000 + n * 20} for n in range(3000)]
    files(tmp_path / "in", [*rows, {"sku_id": 9, "order_id": 1, "sku_num": 1, "amount": 1.0, "at": 1_800_000_000_000}, {"sku_id": 9, "order_id": 1, "sku_num": 1, "amount": 1.0, "at": 1_900_000_000_000}], 4)
    schema = "sku_id long, order_id long, sku_num long, amount double, at long"
    timed = lambda d: d.withColumn("time", F.timestamp_millis("at"))
    measures = stats.product_measures(order=timed(stream(spark, tmp_path / "in", schema))).withWatermark("time", "1 second")
    q = runners.start(stats.product_stats(measures), outputs.table_sink(str(tmp_path / "out")), str(tmp_path / "ck"))
    q.awaitTermination()
    want = stats.product_stats(stats.product_measures(order=timed(spark.read.schema(schema).json(str(tmp_path / "in"))))).where("sku_id <> 9")
    key = lambda d: sorted((r.stt, r.sku_id, r.order_ct, r.order_sku_num) for r in d.collect())
    got = spark.read.parquet(str(tmp_path / "out"))
    assert key(got.where("sku_id <> 9")) == key(want) and max(r[2] for r in key(want)) > 200
    text = json.dumps([json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in q.recentProgress], default=str)
    assert "numRowsTotal" in text
    plan = stats.product_stats(measures)._jdf.queryExecution().analyzed().toString()
    assert "collect_set" not in plan


@pytest.mark.parametrize("salts", [1, 4])
def test_band_join(spark, salts):
    rng = random.Random(6)
    make = lambda n, t: spark.createDataFrame([(i, rng.randint(0, 2), rng.choice([None, rng.randint(-300, 300)])) for i in range(n)], f"{t}_id int, {t}_k int, s int").select(f"{t}_id", f"{t}_k", F.timestamp_seconds("s").alias(f"{t}_t"))
    left, right = make(150, "l").cache(), make(170, "r").cache()
    for low, high in ((-20, 0), (-5, 5), (0, 0), (3, 9)):
        got = wide.band_join(left, right, {"l_k": "r_k"}, "l_t", "r_t", low, high, salts)
        want = wide.interval_join(left, right, F.col("l_k") == F.col("r_k"), "l_t", "r_t", f"{low} seconds", f"{high} seconds")
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_band_join_compares_what_is_near(spark):
    """Rows that meet on key and bin, before the times are compared: in proportion to the matches, not to a key's square."""
    left = spark.range(4000).select(F.lit(1).alias("a"), F.timestamp_seconds(F.col("id") * 60).alias("l_t"))
    right = spark.range(4000).select(F.lit(1).alias("b"), F.timestamp_seconds(F.col("id") * 60).alias("r_t"))
    joined = wide.band_join(left, right, {"a": "b"}, "l_t", "r_t", -600, 0)
    matches = joined.count()
    bins = lambda d, t: d.groupBy(F.floor(F.unix_seconds(t) / 600).alias("bin")).count()
    compared = sum(2 * r["count"] * 10 for r in bins(left, "l_t").collect())
    assert 40_000 < matches <= compared < 4000 * 4000 / 100
    assert "bin_" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_restarts(spark, tmp_path):
    files(tmp_path / "in", [{"a": n} for n in range(6)], 3)
    failures = {"left": 0, "seen": 0}

    def job(name):
        sink = outputs.table_sink(str(tmp_path / name))

        def write(df, batch):
            if batch == 1 and failures["left"]:
                failures["left"] -= 1
                raise OSError("lost for a while")
            sink(df, batch)

        return lambda: runners.start(stream(spark, tmp_path / "in", "a int"), write, str(tmp_path / f"ck-{name}"))

    failures["left"], record = 2, supervise.Record()
    assert supervise.supervised(spark, job("out"), pause_s=0.1, record=record) == 2
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(6))
    for _ in range(50):
        if sum(e[0] == "failed" for e in record.events) == 2 and any(e[0] == "ended" for e in record.events):
            break
        time.sleep(0.1)
    assert sum(e[0] == "failed" for e in record.events) == 2 and {e[1] for e in record.events if e[0] == "batch"} >= {0, 1, 2}
    failures["left"] = 4
    began = time.time()
    with pytest.raises(supervise.GaveUp):
        supervise.supervised(spark, job("never"), pause_s=0.3)
    assert failures["left"] == 0 and time.time() - began > 0.9
