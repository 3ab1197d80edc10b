"""Patterns over the events of a key: steps that follow each other within a time, on batches and streams alike.

A pattern is declared as steps, each with a condition over the columns of an event:

    begin("entry", is_entry(F.col("page.last_page_id"))).next("second", F.col("page.page_id").isNotNull()).within(10_000)

Events of a key count in order of ts and then of the columns of order. Every event that meets the first step begins a
partial match of its own, whatever others there are. A step by `next` must be met by the very next event of the key, or the
partial ends without result; one by `followed_by` by the first event that meets it, others in between are passed over. An
event that comes `within` milliseconds after the first, or later, ends the partial as a time-out, as does the end of the
key's events (on streams: the watermark). So a partial has one way only, and a key as many partials as began within the
time.

Conditions are columns, evaluated by Spark; what remains is an automaton over numbers, which the batch form runs over
partitions sorted by key, and the stream form (streaming.stateful.matched) in each key's state. A key's events pass through
one task one after the other; the task holds its open partials, not its events. Rows without key or ts are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, TIMEOUT = "match", "timeout"


@dataclass(frozen=True)
class Step:
    name: str
    when: Column
    strict: bool = False


@dataclass(frozen=True)
class Pattern:
    steps: tuple[Step, ...]
    within_ms: int | None = None

    def next(self, name: str, when: Column) -> Pattern:
        return replace(self, steps=(*self.steps, Step(name, when, True)))

    def followed_by(self, name: str, when: Column) -> Pattern:
        return replace(self, steps=(*self.steps, Step(name, when)))

    def within(self, ms: int) -> Pattern:
        return replace(self, within_ms=ms)

    def mask(self) -> Column:
        """The steps that an event meets, as bits."""
        bits = [F.when(F.coalesce(s.when, F.lit(False)), 1 << k).otherwise(0) for k, s in enumerate(self.steps)]
        out = bits[0]
        for b in bits[1:]:
            out = out + b
        return out.cast("int")

    def automaton(self) -> Automaton:
        return Automaton(tuple(s.strict for s in self.steps), self.within_ms)


def begin(name: str, when: Column) -> Pattern:
    return Pattern((Step(name, when),))


@dataclass(frozen=True)
class Automaton:
    """strict: of each step. A partial is [ts of its first event, rows so far]."""

    strict: tuple[bool, ...]
    within: int | None

    def feed(self, partials: list[list], ts: int, mask: int, row: str) -> tuple[list[list], list[tuple[str, list[str]]]]:
        """The partials after an event, and what it ends: (MATCH or TIMEOUT, rows)."""
        alive, ended = [], []
        for p in partials:
            start, rows = p
            k = len(rows)
            if self.within is not None and ts - start >= self.within:
                ended.append((TIMEOUT, rows))
            elif mask >> k & 1:
                if k + 1 == len(self.strict):
                    ended.append((MATCH, [*rows, row]))
                else:
                    alive.append([start, [*rows, row]])
            elif not self.strict[k]:
                alive.append(p)
        if mask & 1:
            if len(self.strict) == 1:
                ended.append((MATCH, [row]))
            else:
                alive.append([ts, [row]])
        return alive, ended

    def expired(self, partials: list[list], now: int | None) -> tuple[list[list], list[tuple[str, list[str]]]]:
        """Time-outs of partials by a time that no event will come before; None: no event comes any more."""
        late = [p for p in partials if now is None or self.within is not None and p[0] + self.within <= now]
        return [p for p in partials if p not in late], [(TIMEOUT, rows) for _, rows in late]


def flat(events: DataFrame, pattern: Pattern, key: str, ts: str, order: Iterable[str]) -> DataFrame:
    """key_, ts_, order_0_ and so on, mask_, and row_: the event as JSON if it meets any step, which is all that can come out."""
    own = F.struct(*(F.col(f"`{c}`") for c in events.columns if c != "event_time"))
    mask = pattern.mask()
    places = [F.col(f"`{c}`").alias(f"order_{i}_") for i, c in enumerate(order)]
    time = ["event_time"] if "event_time" in events.columns else []
    rows = events.select(F.col(key).cast("string").alias("key_"), F.col(ts).cast("long").alias("ts_"), *places, mask.alias("mask_"), F.when(mask > 0, F.to_json(own)).alias("row_"), *time)
    return rows.where("key_ is not null and ts_ is not null")


OUT = "outcome string, rows array<string>"


def shaped(found: DataFrame, events: DataFrame, pattern: Pattern) -> DataFrame:
    """outcome, steps (how many were met), and a column for each step: its event as a struct, null where it wasn't met."""
    kind = events.drop("event_time").schema
    steps = [F.from_json(F.try_element_at("rows", F.lit(k + 1)), kind).alias(s.name) for k, s in enumerate(pattern.steps)]
    return found.select("outcome", F.size("rows").alias("steps"), *steps)


def matched(events: DataFrame, pattern: Pattern, key: str, ts: str = "ts", order: Iterable[str] = ()) -> DataFrame:
    """Batch form: matches and time-outs, as `shaped` has them."""
    order = list(order)
    automaton = pattern.automaton()
    rows = flat(events, pattern, key, ts, order)
    by = ["key_", "ts_", *(f"order_{i}_" for i in range(len(order)))]
    dealt = rows.repartition("key_").sortWithinPartitions(*by).select("key_", "ts_", "mask_", "row_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, partials = None, []
        for b in batches:
            out: list[tuple[str, list[str]]] = []
            for k, t, m, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != at:
                    out += automaton.expired(partials, None)[1]
                    at, partials = k, []
                if partials or m & 1:
                    partials, ended = automaton.feed(partials, t, m, r)
                    out += ended
            yield _batch(out)
        yield _batch(automaton.expired(partials, None)[1])

    return shaped(dealt.mapInArrow(run, OUT), events, pattern)


def _batch(out: list[tuple[str, list[str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.string()), pa.array([r for _, r in out], pa.list_(pa.string()))], names=["outcome", "rows"])
