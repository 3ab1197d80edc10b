"""Packing documents into training sequences by minimum bin slack.

Every input partition is a stream of documents. A document's ids are cut only where it is longer than a sequence: its
full sequences leave at once and the remainder joins a pool of bounded size. When the pool is full, sequences are
filled from it: the longest remainder goes in first and a subset-sum dynamic programme over the multiset of remaining
lengths, held as one big integer whose bit s says that s tokens can be reached, picks those that fill the rest as
closely as possible; the counts of each length are read off by walking the saved bitsets backwards. What is still
short of capacity (rare, the pool reaches nearly every sum) is topped up with the head of another remainder. At the end
of a partition fewer tokens than one sequence are left; they are cut at powers of two, at which sequences need no
padding. So there is no shuffle, no group, no limit on equal lengths, and no padding.

Nulls: a null text is empty and yields the end id alone; a null doc_id stays null. Repeated rows are separate documents.
An empty table yields no rows. A very long text is cut into full sequences as it comes, in time that grows with its length.
Columns besides doc_id and text play no part, however they are called.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import map_arrow, texts
from .words import word_ids

CAPACITY = 4096
#: Remainders at hand when sequences are filled, and left over when filling pauses.
POOL, LOW = 768, 384
END = 2
#: Rows after which a batch is given away; a row holds at most a sequence.
ROWS_OUT = 5000
#: Words whose ids a Python worker keeps: fewer than elsewhere, since pools stand beside them and other stages follow.
CACHE_WORDS = 200_000
#: Sequence ids: the partition above this many bits, a counter below.
COUNTER_BITS = 36


@dataclass
class Piece:
    """A run of one document's tokens, a view of its ids (little-endian unsigned 16-bit): cutting copies nothing."""

    doc_id: int | None
    start: int
    ids: memoryview
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 2

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: 2 * n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[2 * n :], self.doc_tokens)

    def alone(self) -> Piece:
        """The piece with ids of its own, so that a short rest doesn't keep a whole book."""
        return Piece(self.doc_id, self.start, memoryview(bytes(self.ids)), self.doc_tokens)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset drawn from counts (length -> how many) whose sum comes closest to room from below."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length], room // length)
        times = 1
        while left:  # counts in powers of two: as many steps as the count has bits
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << length * times) & mask
            left -= times
            times *= 2
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            taken[length] += times
            at -= length * times
    return dict(taken)


@dataclass
class Packer:
    capacity: int = CAPACITY
    pool: dict[int, list[Piece]] = field(default_factory=dict)
    held: int = 0
    tokens: int = 0

    def put(self, piece: Piece) -> None:
        self.pool.setdefault(len(piece), []).append(piece)
        self.held += 1
        self.tokens += len(piece)

    def take(self, length: int) -> Piece:
        pieces = self.pool[length]
        piece = pieces.pop()
        if not pieces:
            del self.pool[length]
        self.held -= 1
        self.tokens -= length
        return piece

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        if len(piece) >= self.capacity:
            while len(piece) >= self.capacity:
                head, piece = piece.split(self.capacity)
                yield [head]
            piece = piece.alone()
        if len(piece):
            self.put(piece)
        if self.held >= POOL:
            while self.held > LOW and self.tokens >= self.capacity:
                yield self.window(self.capacity)

    def window(self, size: int) -> list[Piece]:
        """One sequence of exactly size tokens; the pool holds at least that many."""
        first = max((x for x in self.pool if x <= size), default=None)
        out = [self.take(first)] if first else []
        room = size - (first or 0)
        for length, n in fill({k: len(v) for k, v in self.pool.items()}, room).items():
            out += [self.take(length) for _ in range(n)]
            room -= length * n
        while room:
            longest = self.take(max(self.pool))
            if len(longest) <= room:
                out.append(longest)
                room -= len(longest)
            else:
                head, tail = longest.split(room)
                out.append(head)
                self.put(tail)
                room = 0
        return out

    def finish(self) -> Iterator[list[Piece]]:
        while self.tokens:
            yield self.window(self.capacity if self.tokens >= self.capacity else 1 << self.tokens.bit_length() - 1)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, vocabulary: str, kind: str = "word_bpe", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids themselves.

    Ids are those of the tokenizers library for the vocabulary file, then the end id. Each id lies in one piece.
    """
    schema = _ARROW.append(pa.field("ids", pa.binary())) if with_ids else _ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = word_ids(vocabulary, kind, CACHE_WORDS).ids, Packer(capacity)
        tail = end.to_bytes(2, "little")
        sequence = TaskContext.get().partitionId() << COUNTER_BITS
        rows: list[tuple] = []

        def rows_of(windows: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for pieces in windows:
                offset = 0
                for p in pieces:
                    crc = zlib.crc32(np.frombuffer(p.ids, "<u2").astype("<u4").tobytes())
                    rows.append((p.doc_id, p.start, len(p), crc, p.doc_tokens, sequence, offset, bytes(p.ids))[: len(schema)])
                    offset += len(p)
                sequence += 1

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema)
            rows.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + tail
                rows_of(packer.add(Piece(doc_id, 0, memoryview(ids), len(ids) // 2)))
                if len(rows) >= ROWS_OUT:
                    yield out()
            if rows:
                yield out()
        rows_of(packer.finish())
        if rows:
            yield out()

    return map_arrow(texts(docs), run, SCHEMA + ", ids binary" * with_ids)
