"""Token ids in shard files, compressed by a Re-Pair grammar with random access.

Documents are range-sorted by doc_id; every task encodes its range and rolls shards by number of ids. In a shard,
frequent pairs of neighbouring symbols are replaced by nonterminals again and again, until no pair is seen often enough
to pay for its rule; if the last rounds only made symbols wider, they are taken back. Each round takes the most frequent pairs together; where occurrences overlap the more frequent pair
goes first, then the left one. Pairs never reach across documents, so a document is a run of symbols, found by its offset.
The length of every rule's expansion is stored with it: from these any slice of a document is decoded by going down only
into the symbols that it touches. The manifest lists every shard with its bytes and digest; readers read these and no others.

File: magic, seven little-endian 64-bit counts (documents, ids, symbols, rules, vocabulary size, ids before it in its
range, bits of a symbol), rules (two symbols each), expansion lengths (uint32), doc ids (int64), null flags (uint8), symbol
offsets (uint32, one more than documents), token counts (uint32), symbols. Symbols are as wide as the largest needs: their
low 16 bits one after the other (uint16), then a plane of single bits, eight a byte, for each higher bit.

Nulls: a null text is empty and yields the end id alone; null doc_ids come first. Rows of equal doc_id follow each other
in the order of their texts' hashes; repeated rows are documents of their own, and many of them spread over several
ranges. A very long text makes a longer shard. Columns besides doc_id and text play no part, however they are called. An
empty table writes no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import GROUP_ROWS, contents, fingerprint, intact, map_arrow, partitions_for, put, put_manifest, runs, scratch, texts
from .words import word_ids

MAGIC = b"TMRP0002"
END = 2
#: Ids after which a shard is closed; a longer document makes a longer shard.
SHARD_IDS = 2_000_000
#: Pairs that a round replaces at most (the next one takes the others), and the least count of a pair: a rule costs as much
#: as four symbols.
RULES_A_ROUND, LEAST = 4096, 8
_BUCKET_BITS = 18


def _apart(at: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which of the sorted positions to take so that no two are neighbours: the higher score first, then the left one."""
    taken, left = np.zeros(len(at), bool), np.arange(len(at))
    for _ in range(3):
        near = np.diff(at[left]) == 1
        s = score[left]
        over_left = np.concatenate([[True], ~near | (s[1:] > s[:-1])])
        over_right = np.concatenate([~near | (s[:-1] >= s[1:]), [True]])
        best = over_left & over_right
        taken[left[best]] = True
        beside = np.concatenate([best[1:] & near, [False]]) | np.concatenate([[False], best[:-1] & near])
        left = left[~best & ~beside]
        if not len(left):
            return taken
    # long runs of equal scores: every second one from the left
    head = np.ones(len(left), bool)
    head[1:] = np.diff(at[left]) > 1
    first = np.maximum.accumulate(np.where(head, np.arange(len(left)), 0))
    taken[left[(np.arange(len(left)) - first) % 2 == 0]] = True
    return taken


def _grouped(keys: np.ndarray, buckets: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys seen least times, ascending, the place of each key in them or -1, their counts); equal keys have equal buckets below n.

    A bucket's last key is told apart without sorting; in full buckets that is mostly the frequent one. Of the others those
    are sorted that can be seen least times.
    """
    last = np.zeros(n, np.uint64)
    last[buckets] = keys
    same = last[buckets] == keys
    counts = np.bincount(buckets[same], minlength=n)
    full = np.flatnonzero(counts >= least)
    rest = np.flatnonzero(~same)
    rest = rest[(np.bincount(buckets[rest], minlength=n) >= least)[buckets[rest]]]
    others, of, more = np.unique(keys[rest], return_inverse=True, return_counts=True)
    some = more >= least
    found = np.concatenate([last[full], others[some]])
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_bucket, by_other = np.full(n, -1), np.full(len(others), -1)
    by_bucket[full] = place[: len(full)]
    by_other[some] = place[len(full) :]
    which = np.where(same, by_bucket[buckets], -1)
    which[rest] = by_other[of]
    return found[order].astype(np.int64), which, np.concatenate([counts[full], more[some]])[order]


def compress(ids: np.ndarray, starts: np.ndarray, vocabulary: int, a_round: int = RULES_A_ROUND, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts of documents in them, rules): rule r is nonterminal vocabulary + r and stands for two symbols.

    ids and starts (of documents in ids) as arrays. Ends when no pair is seen least times apart, or when a round has made
    symbols and rules take more bytes than before, since all symbols became a bit wider: that round is taken back, or left out
    where the buckets' counts already say so.
    """
    symbols = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    n_rules = 0
    best_bytes, best_of = 2 * len(symbols), (symbols, starts, 0)
    while len(symbols) > 1:
        n = len(symbols) - 1
        # products wrap around
        buckets = symbols[:-1] * np.uint32(0x9E3779B1) ^ symbols[1:] * np.uint32(0x85EBCA6B)
        buckets = (buckets >> np.uint32(32 - _BUCKET_BITS)).astype(np.intp)  # once, for all that index by them
        inner = starts[(starts > 0) & (starts <= n)] - 1
        buckets[inner] = 1 << _BUCKET_BITS  # pairs over two documents are nobody's
        counts = np.bincount(buckets, minlength=(1 << _BUCKET_BITS) + 1)
        counts[-1] = 0
        # a bucket counts at least as much as each of its pairs: exact counts are needed in the fullest buckets only
        fullest = np.partition(counts, -a_round)[-a_round:]
        bar = max(least, int(fullest[0]))
        bits = width(vocabulary + n_rules + 1)
        if n_rules and bits > width(vocabulary + n_rules) and _least_bytes(len(symbols), n_rules, bits, fullest) >= best_bytes:
            break
        at = np.flatnonzero((counts >= bar)[buckets])
        keys = symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1]
        pairs, which, exact = _grouped(keys, buckets[at], 1 << _BUCKET_BITS, least)
        # a round ends where symbols would become wider
        room = (1 << width(vocabulary + n_rules)) - vocabulary - n_rules
        best = np.argsort(-exact, kind="stable")[: min(a_round, room or a_round)]
        place = np.full(len(pairs) + 1, -1)  # the last one stands for pairs that are too rare
        place[best] = np.arange(len(best))
        which = place[which]
        at, which = at[which >= 0], which[which >= 0]
        take = _apart(at, exact[best][which]) if len(at) else np.zeros(0, bool)
        at, which = at[take], which[take]
        # what overlapping pairs have left of a pair must pay for the rule, too
        pays = np.bincount(which, minlength=len(best)) > 4
        if not pays.any():
            break
        at, which = at[pays[which]], (np.cumsum(pays) - 1)[which[pays[which]]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, starts = symbols[keep], starts - np.searchsorted(at + 1, starts)
        symbols[at - np.arange(len(at))] = vocabulary + n_rules + which
        chosen = pairs[best[pays]]
        rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], axis=1))
        n_rules += len(chosen)
        bits = width(vocabulary + n_rules)
        size = packed_size(len(symbols), bits) + packed_size(2 * n_rules, bits) + 4 * n_rules
        if size >= best_bytes:
            break
        best_bytes, best_of = size, (symbols, starts, n_rules)
    symbols, starts, n_rules = best_of
    return symbols.astype(np.int64), starts, np.concatenate(rules)[:n_rules] if n_rules else np.zeros((0, 2), np.int64)


def _least_bytes(n: int, rules: int, bits: int, fullest: np.ndarray) -> float:
    """What n symbols and the rules take at least after a round whose pairs fill these buckets at most: each place saves a symbol."""
    pays = np.maximum(fullest * (bits / 8) - 2 * bits / 8 - 4, 0).sum()
    return (n + 2 * rules) * bits / 8 + 4 * rules - pays


def width(symbols: int) -> int:
    """Bits of one of so many symbols."""
    return max(16, (symbols - 1).bit_length())


def expansion_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Of each rule, how many ids it stands for; a rule's symbols come before it."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - vocabulary] if a >= vocabulary else 1) + (out[b - vocabulary] if b >= vocabulary else 1))
    return np.array(out, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocabulary: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, int]:
    """(ids first to last of the symbols' expansion, symbols that were looked into).

    Every symbol has its place by the lengths of those before it. Level by level, nonterminals that the slice touches give way
    to their two symbols, and others are left alone.
    """
    size = lambda s: np.where(s < vocabulary, 1, lengths[np.maximum(s - vocabulary, 0)] if len(lengths) else 1)
    s = symbols.astype(np.int64)
    n = size(s)
    place = np.cumsum(n) - n
    total = int(n.sum())
    last = total if last is None else min(last, total)
    whole = first <= 0 and last == total
    out = np.empty(max(last - first, 0), np.int64)
    seen = 0
    while True:
        if not whole:
            touched = (place < last) & (place + n > first)
            s, place = s[touched], place[touched]
        seen += len(s)
        ends = s < vocabulary
        out[place[ends] - first] = s[ends]
        s, place = s[~ends], place[~ends]
        if not len(s):
            return out, seen
        left, right = rules[s - vocabulary].T
        s, place = np.concatenate([left, right]), np.concatenate([place, place + size(left)])
        n = None if whole else size(s)


def packed(symbols: np.ndarray, bits: int) -> bytes:
    """Their low 16 bits, then a plane for each higher bit."""
    planes = [np.packbits((symbols >> b & 1).astype(np.uint8)) for b in range(16, bits)]
    return b"".join([(symbols & 0xFFFF).astype("<u2").tobytes(), *(p.tobytes() for p in planes)])


def unpacked(data: bytes, at: int, n: int, bits: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Symbols first to last of n packed ones at a place in data; no others are read."""
    last = n if last is None else last
    out = np.frombuffer(data, "<u2", last - first, at + 2 * first).astype(np.int64)
    plane = -(-n // 8)
    for k, b in enumerate(range(16, bits)):
        low = first // 8
        some = np.frombuffer(data, np.uint8, -(-last // 8) - low, at + 2 * n + k * plane + low)
        out |= np.unpackbits(some)[first - 8 * low : last - 8 * low].astype(np.int64) << b
    return out


def packed_size(n: int, bits: int) -> int:
    return 2 * n + max(bits - 16, 0) * -(-n // 8)


def written(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, before: int, vocabulary: int) -> bytes:
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    symbols, offsets, rules = compress(ids, starts, vocabulary)
    bits = width(vocabulary + len(rules))
    head = struct.pack("<7q", len(doc_ids), len(ids), len(symbols), len(rules), vocabulary, before, bits)
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], "u1")
    return b"".join([MAGIC, head, packed(rules.ravel(), bits), expansion_lengths(rules, vocabulary).astype("<u4").tobytes(), keys.tobytes(), nulls.tobytes(), offsets.astype("<u4").tobytes(), np.array(counts, "<u4").tobytes(), packed(symbols, bits)])


@dataclass
class Shard:
    """A shard file's parts, each read only when it is asked for."""

    data: bytes

    def __post_init__(self) -> None:
        if self.data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard file")
        self.docs, self.n_ids, self.n_symbols, n_rules, self.vocabulary, self.before, self.bits = struct.unpack_from("<7q", self.data, len(MAGIC))
        at = len(MAGIC) + 56
        self.rules = unpacked(self.data, at, 2 * n_rules, self.bits).reshape(-1, 2)
        at += packed_size(2 * n_rules, self.bits)
        parts = []
        for kind, n in (("<u4", n_rules), ("<i8", self.docs), ("u1", self.docs), ("<u4", self.docs + 1), ("<u4", self.docs)):
            parts.append(np.frombuffer(self.data, kind, n, at))
            at += parts[-1].nbytes
        self._symbols_at = at
        if at + packed_size(self.n_symbols, self.bits) != len(self.data):
            raise ValueError("a shard file of a wrong length")
        lengths, self.keys, self.nulls, self.offsets, self.counts = parts
        self.lengths = lengths.astype(np.int64)

    def symbols(self, first: int = 0, last: int | None = None) -> np.ndarray:
        return unpacked(self.data, self._symbols_at, self.n_symbols, self.bits, first, last)

    def slice(self, k: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, int]:
        """(ids first to last of the shard's document k, symbols that were looked into)."""
        own = self.symbols(int(self.offsets[k]), int(self.offsets[k + 1]))
        return expand(own, self.rules, self.lengths, self.vocabulary, first, last)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the shard's document k alone."""
        return self.slice(k)[0]

    def all_ids(self) -> np.ndarray:
        """Every rule is expanded once and symbols take their ids from there, unless the rules' expansions are longer than the ids."""
        symbols, v = self.symbols(), self.vocabulary
        if not len(symbols) or self.lengths.sum() > self.n_ids:
            return expand(symbols, self.rules, self.lengths, v)[0]
        ids = np.concatenate([np.arange(v), expand(np.arange(v, v + len(self.rules)), self.rules, self.lengths, v)[0]])
        lengths = np.concatenate([np.ones(v, np.int64), self.lengths])
        begins = np.cumsum(lengths) - lengths
        return runs(ids, begins[symbols], lengths[symbols])


FILES = "name string, bytes long, sha256 string, part long, before long, n_ids long, n_docs long"


def write(docs: DataFrame, folder: str, vocabulary_file: str, kind: str = "byte_bpe", end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards of docs below folder; their table, which the manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(vocabulary_file, kind)
        size, tail, part = coder.tokenizer.get_vocab_size(), end.to_bytes(2, "little"), TaskContext.get().partitionId()
        keys: list[int | None] = []
        parts: list[bytes] = []
        held = total = shards = 0

        def close() -> pa.RecordBatch:
            nonlocal held, total, shards
            counts = [len(p) // 2 for p in parts]
            name, data = f"range-{part:07d}-{shards:06d}.rp", written(keys, counts, np.frombuffer(b"".join(parts), "<u2"), total, size)
            put(folder, name, data)
            row = pa.RecordBatch.from_pylist([{"name": name, "bytes": len(data), "sha256": fingerprint(data), "part": part, "before": total, "n_ids": held, "n_docs": len(keys)}])
            total, shards, held = total + held, shards + 1, 0
            keys.clear()
            parts.clear()
            return row

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), coder.many(batch.column(1)), strict=True):
                ids += tail
                keys.append(key)
                parts.append(ids)
                held += len(ids) // 2
                if held >= shard_ids:
                    yield close()
        if keys:
            yield close()

    # the row's number spreads identical rows, whose order doesn't matter
    rows = texts(docs).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(partitions_for(docs), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    return put_manifest(folder, map_arrow(ranged, run, FILES, GROUP_ROWS), {"vocabulary": kind, "end": end})


#: Of a shard's documents every so many-th is also read by its offset alone and must agree.
PROBE = 64


def read(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of the shards that the manifest lists: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; with_ids its ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = contents(spark, folder, ".rp")
    starts, total = {}, 0
    # one small row for each range comes here, never one for each document
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        starts[r.part], total = total, total + r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, name, size, digest, part in zip(batch.column(0), *(batch.column(c).to_pylist() for c in range(1, 5)), strict=True):
                shard = Shard(intact(name, content.as_py(), size, digest))
                ids = shard.all_ids().astype("<u4")
                ends = np.cumsum(shard.counts.astype(np.int64))
                begins = ends - shard.counts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                if any(zlib.crc32(shard.ids(k).astype("<u4")) != crc[k] for k in range(0, shard.docs, PROBE)):
                    raise ValueError(f"a document doesn't decode alone: {name}")
                columns = [pa.array(shard.keys, pa.int64(), mask=shard.nulls.astype(bool)), pa.array(begins + shard.before + starts[part]), pa.array(shard.counts.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids.astype(np.int32)))
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return map_arrow(files.select("content", "name", "bytes", "sha256", "part"), run, schema, 8)


def round_trip(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    write(docs, folder, vocabulary_file)
    return read(spark, folder)
