"""Operators that need memory of each key on a stream; their batch forms are in operators.logs and operators.arrivals.

Logs must have a watermarked timestamp column event_time besides the columns of schemas.LOG.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import day, is_entry
from ..operators import arrivals, patterns
from ..operators.logs import not_new

DAY_MS = 24 * 3600 * 1000


def with_event_time(logs: DataFrame, delay: str = "3 seconds") -> DataFrame:
    return logs.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", delay)


def _flat(logs: DataFrame) -> DataFrame:
    """Key, time and the whole row as JSON: what state has to hold."""
    names = [F.col(f"`{c}`") for c in logs.columns if c != "event_time"]
    return logs.select(F.col("common.mid").alias("mid"), F.col("common.is_new").alias("is_new"), day(F.col("ts")).alias("day"), is_entry(F.col("page.last_page_id")).alias("entry"), "ts", F.to_json(F.struct(*names)).alias("row"), "event_time").where("mid is not null")


class RepairNew(StatefulProcessor):
    """A visitor's first day as new, for good; records that claim to be new on another day are repaired."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "day string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.first.get()[0] if self.first.exists() else None
        for r in sorted(rows, key=lambda r: r.ts):
            if r.is_new == "1" and known is None:
                known = r.day
                self.first.update((known,))
            yield Row(row=r.row, wrong=r.is_new == "1" and known != r.day)

    def close(self) -> None:
        pass


class DailyUnique(StatefulProcessor):
    """The first entry page of each visitor and day. Days are kept until a later day's watermark passes them by a day."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day string", "ts long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted((r for r in rows if r.entry), key=lambda r: r.ts):
            if not self.days.containsKey((r.day,)):
                self.days.updateValue((r.day,), (r.ts,))
                self.handle.registerTimer(r.ts + 2 * DAY_MS)
                yield Row(row=r.row, wrong=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        for d in [k for k, v in self.days.iterator() if v[0] + 2 * DAY_MS <= at]:
            self.days.removeKey(d)
        return iter(())

    def close(self) -> None:
        pass


class Bounce(StatefulProcessor):
    """Entry pages that nothing follows within the gap.

    Records wait, in any order of arrival, until the watermark has passed their time plus the gap: by then every record
    that could follow is there. Each is judged by the one right after it; that one stays.
    """

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, entry boolean, row string")
        self.due = handle.getValueState("due", "at long")

    def _wait(self, at: int) -> None:
        """One timer for each visitor, at the time the earliest record is due."""
        known = self.due.get()[0] if self.due.exists() else None
        if known is not None and known <= at:
            return
        if known is not None:
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(r.ts, r.entry, r.row) for r in rows]
        self.waiting.appendList(new)
        self._wait(min(new)[0] + self.gap)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # all that the watermark has passed by now is judged at once, so a record is sorted few times
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = sorted(tuple(r) for r in self.waiting.get())
        due = sum(r[0] + self.gap <= at for r in rows)
        self.due.clear()
        for i in range(due):
            if rows[i][1] and (i + 1 == len(rows) or rows[i + 1][0] - rows[i][0] >= self.gap):
                yield Row(row=rows[i][2], wrong=False)
        if rows[due:]:
            self.waiting.put(rows[due:])
            self._wait(rows[due][0] + self.gap)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def _run(logs: DataFrame, processor: StatefulProcessor) -> DataFrame:
    """The rows that the processor lets pass, with all their columns but event_time; wrong: the flag that a visitor is new is."""
    out = _flat(logs).groupBy("mid").transformWithState(statefulProcessor=processor, outputStructType="row string, wrong boolean", outputMode="Append", timeMode="EventTime")
    kind = logs.drop("event_time").schema
    return out.select(F.from_json("row", kind).alias("r"), "wrong").select("r.*", "wrong")


def repair_is_new(logs: DataFrame) -> DataFrame:
    return not_new(_run(logs, RepairNew()), F.col("wrong")).drop("wrong")


def unique_visits(page: DataFrame) -> DataFrame:
    return _run(page, DailyUnique()).drop("wrong")


def bounces(page: DataFrame, gap_ms: int = 10_000) -> DataFrame:
    """Rows carry the time of the page that bounced, which lies behind the watermark: write them before windowing them."""
    return _run(page, Bounce(gap_ms)).drop("wrong")


class Matching(StatefulProcessor):
    """A pattern's automaton: events wait until the watermark has passed them, then go through it in order."""

    def __init__(self, automaton: patterns.Automaton, places: int) -> None:
        self.automaton, self.places = automaton, places

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, place string, mask int, row string")
        self.partials = handle.getValueState("partials", "partials string")
        self.due = handle.getValueState("due", "at long")

    def _wait(self, at: int) -> None:
        known = self.due.get()[0] if self.due.exists() else None
        if known is not None and known <= at:
            return
        if known is not None:
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(r.ts_, json.dumps([r[f"order_{i}_"] for i in range(self.places)], default=str), r.mask_, r.row_) for r in rows]
        self.waiting.appendList(new)
        self._wait(min(x[0] for x in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # every event before the watermark is there; one at it may still have others beside it
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], json.loads(r[1])))
        due = sum(r[0] < now for r in held)
        partials = json.loads(self.partials.get()[0]) if self.partials.exists() else []
        out = []
        for ts, _, mask, row in held[:due]:
            partials, ended = self.automaton.feed(partials, ts, mask, row)
            out += ended
        partials, ended = self.automaton.expired(partials, now)
        out += ended
        self.due.clear()
        self.waiting.put(held[due:]) if held[due:] else self.waiting.clear()
        self.partials.update((json.dumps(partials),)) if partials else self.partials.clear()
        later = [r[0] + 1 for r in held[due : due + 1]] + [p[0] + self.automaton.within for p in partials[:1] if self.automaton.within is not None]
        if later:
            self._wait(max(min(later), now + 1))
        for outcome, rows in out:
            yield Row(outcome=outcome, rows=rows)

    def close(self) -> None:
        pass


def matched(events: DataFrame, pattern: patterns.Pattern, key: str, ts: str = "ts", order: Iterable[str] = ()) -> DataFrame:
    """The stream form of operators.patterns.matched, for events with a watermarked event_time; the order is by values that JSON has."""
    order = list(order)
    rows = patterns.flat(events, pattern, key, ts, order)
    found = rows.groupBy("key_").transformWithState(statefulProcessor=Matching(pattern.automaton(), len(order)), outputStructType=patterns.OUT, outputMode="Append", timeMode="EventTime")
    return patterns.shaped(found, events, pattern)


class RouteByArrival(StatefulProcessor):
    """The current config of a table and operation, in each of its parts; events get it as it is when they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.config = handle.getValueState("config", "config string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = config = self.config.get()[0] if self.config.exists() else None
        # of one arrival, the config first
        for r in sorted(rows, key=lambda r: (r.arrival, not r.is_config)):
            if r.is_config:
                config = r.row
            else:
                yield Row(row=r.row, config=config)
        if config is not None and config != before:
            self.config.update((config,))

    def close(self) -> None:
        pass


def routed_by_arrival(events: DataFrame, changes: DataFrame, order: str = "arrival", parts: int = arrivals.PARTS) -> DataFrame:
    """The stream form of operators.arrivals: both streams through one state. A batch's rows count in their order of arrival.

    Events of a key are dealt to parts; every part keeps the config, so changes go to all of them.
    """
    c = F.col
    names = ["source_table", "operate_type", *arrivals.ROUTE]
    config = F.to_json(F.struct(F.lower("type").alias("change_"), *(c(f"data.{n}").alias(n) for n in names)))
    told = changes.select(F.concat_ws("\u0001", c("data.source_table"), c("data.operate_type")).alias("key"), c(order).alias("arrival"), F.lit(True).alias("is_config"), config.alias("row"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    own = [c(f"`{n}`") for n in events.columns]
    come = events.select(F.concat_ws("\u0001", "table", "type").alias("key"), c(order).alias("arrival"), F.lit(False).alias("is_config"), F.to_json(F.struct(*own)).alias("row"), F.pmod(F.xxhash64(order), F.lit(parts)).cast("int").alias("part"))
    met = told.unionByName(come).groupBy("key", "part").transformWithState(statefulProcessor=RouteByArrival(), outputStructType="row string, config string", outputMode="Append", timeMode="None")
    shape = f"change_ string, {', '.join(f'{n} string' for n in names)}"
    rows = met.select(F.from_json("row", events.schema).alias("e"), F.from_json("config", shape).alias("k")).select("e.*", "k.*")
    return arrivals.judged(rows, c("change_"))
