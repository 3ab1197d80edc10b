"""SimHash near-duplicates by covering anchor points.

Anchors are the words of a covering code: two blocks of 23 bits each carry the perfect Golay code (every block is within
3 bits of exactly one code word), the other 18 bits are free. Fingerprints at 3 or fewer differing bits have a point
between them within 1 bit of one and 2 of the other, and the anchor of that point is within the covering radius plus 2
of both. So a fingerprint goes to every pair of code words whose distance beyond the radius is at most 2 over both
blocks (about 60), and fingerprints of one anchor are compared on all 64 bits. That finds every link. The 2^24 anchors
get crowded with many distinct fingerprints; then 15 of the free bits carry a Hamming code as a third block, which makes
2^35 anchors. The argument holds for any number of blocks, so the links are the same.

Only distinct fingerprints take part, so copies cost nothing. Within an anchor the links found are a spanning forest, not
all pairs: an anchor with many close fingerprints is searched breadth first, and what has been reached is not compared
again. Links then become components by alternating star contractions, distributed and cut by tables in the shared
folder.

Nulls: a null text is empty (fingerprint zero); a null doc_id stays null and counts for no component's smallest id, a
component with null ids only has a null id. Repeated rows are kept. An empty table yields no rows. Very long texts count
whole. Columns besides doc_id and text play no part, however they are called.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, map_arrow, meet, stash, texts

WORDS_A_SHINGLE = 3
SEED = 42
LINK_BITS = 3
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LANES = np.uint64(0x0101010101010101)


def shingles(text: str, width: int = WORDS_A_SHINGLE) -> list[bytes]:
    words = text.encode().translate(_LOWER).split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def fingerprints(texts_: list[str], width: int = WORDS_A_SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is 1 if set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    hashes, ends = [], []
    for text in texts_:
        hashes += [xxh64_intdigest(s, SEED) for s in shingles(text, width)]
        ends.append(len(hashes))
    ends_ = np.array(ends, np.int64)
    counts = np.diff(ends_, prepend=0)
    some = np.flatnonzero(counts)
    out = np.zeros(len(texts_), np.uint64)
    if not len(some):
        return out
    out[some] = _majority(np.array(hashes, np.uint64), (ends_ - counts)[some], counts[some])
    return out


def _majority(h: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, whose hashes h holds from begin on, the bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    # runs of at most 255 hashes of one text: eight 8-bit counters fit a word
    runs = (counts + 254) // 255
    first = np.repeat(begin, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    text_runs = np.cumsum(runs) - runs
    for k in range(8):
        lanes = np.add.reduceat(h >> np.uint64(k) & _LANES, first)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), text_runs, axis=0)
        over = 2 * ones > counts[:, None]
        for byte in range(8):
            out |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


# Generator polynomial, length and covering radius of two perfect binary codes, Golay's and Hamming's.
GOLAY, HAMMING = (0b101011100011, 23, 3), (0b10011, 15, 1)
Code = tuple[int, int, int]
#: Distinct fingerprints up to which anchors of two blocks are roomy; above, a third block parts them. Links are the same.
TWO_BLOCKS = 30_000_000


def _remainder(x: int, code: Code) -> int:
    generator, length, _ = code
    check = generator.bit_length() - 1
    for bit in range(length - 1, check - 1, -1):
        if x >> bit & 1:
            x ^= generator << (bit - check)
    return x


@functools.cache
def _tables(code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(remainders of single bits' bytes, error of each remainder, and by remainder the code words near its error and how far beyond the radius)."""
    generator, length, radius = code
    check = generator.bit_length() - 1
    bytes_ = np.array([[_remainder(v << 8 * b, code) if v << 8 * b < 1 << length else 0 for v in range(256)] for b in range(-(-length // 8))], np.int64)
    words = np.array([(m << check) ^ _remainder(m << check, code) for m in range(1 << length - check)], np.int64)
    error = np.zeros(1 << check, np.int64)
    for weight in range(1, radius + 1):
        for bits in itertools.combinations(range(length), weight):
            p = sum(1 << b for b in bits)
            error[_remainder(p, code)] = p
    near, beyond = [], []
    for e in error:
        distance = np.bitwise_count(words ^ e).astype(np.int64)
        at = np.flatnonzero(distance < radius + LINK_BITS)
        near.append(words[at])
        beyond.append(np.maximum(distance[at] - radius, 0))
    width = max(map(len, near))
    fill = lambda rows, v: np.array([np.pad(r, (0, width - len(r)), constant_values=v) for r in rows])
    return bytes_, error, fill(near, 0), fill(beyond, 9)


def _near(block: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the code words near each block, and how far beyond the radius; 9 for none."""
    bytes_, error, near, beyond = _tables(code)
    s = np.zeros_like(block)
    for b, remainders in enumerate(bytes_):
        s ^= remainders[block >> 8 * b & 255]
    home = block ^ error[s]
    # block = home + error, so a code word w near the error gives home + w near the block
    return (home[:, None] ^ near[s]) >> code[0].bit_length() - 1, beyond[s]


def anchors(fingerprint: np.ndarray, codes: tuple[Code, ...] = (GOLAY, GOLAY)) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor of every fingerprint: a code word for each block, together less than LINK_BITS beyond the radius."""
    f, at = fingerprint.astype(np.uint64), 0
    row = np.arange(len(f))
    anchor, over = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
    for code in codes:
        generator, length, _ = code
        word, beyond = _near((f >> np.uint64(at) & np.uint64((1 << length) - 1)).astype(np.int64), code)
        i, j = np.nonzero(over[:, None] + beyond[row] < LINK_BITS)
        anchor = anchor[i] << length - (generator.bit_length() - 1) | word[row[i], j]
        over = over[i] + beyond[row[i], j]
        row, at = row[i], at + length
    return row, anchor


def forest(anchor: np.ndarray, fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of equal anchors (sorted by anchor) that connect what LINK_BITS connects."""
    cuts = np.flatnonzero(np.diff(anchor)) + 1
    first = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([first, [len(anchor)]]))
    out_a, out_b = [], []
    member = np.repeat(sizes, sizes)
    small = np.flatnonzero((member > 1) & (member <= 24))
    ga, gf = anchor[small], fingerprint[small]
    for shift in range(1, 24):
        if len(ga) <= shift:
            break
        same = np.flatnonzero(ga[:-shift] == ga[shift:])
        if not len(same):
            break
        close = same[np.bitwise_count(gf[same] ^ gf[same + shift]) <= LINK_BITS]
        out_a.append(gf[close])
        out_b.append(gf[close + shift])
    for k in np.flatnonzero(sizes > 24):
        left = fingerprint[first[k] : first[k] + sizes[k]]
        queue: list[np.ndarray] = []
        while len(left):
            if not queue:
                queue, left = [left[:1]], left[1:]
            seeds = queue.pop()
            for at, seed in enumerate(seeds):
                close = np.bitwise_count(left ^ seed) <= LINK_BITS
                if close.any():
                    out_a.append(np.full(close.sum(), seed))
                    out_b.append(left[close])
                    queue.append(left[close])
                    left = left[~close]
                if not len(left):
                    break
            del at
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out_a), np.concatenate(out_b)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a > b as signed numbers: links between the distinct fingerprints fp that connect all there is to connect."""
    codes = (GOLAY, GOLAY) if distinct.count() <= TWO_BLOCKS else (GOLAY, GOLAY, HAMMING)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy()
            row, anchor = anchors(f.view(np.uint64), codes)
            yield pa.record_batch([pa.array(anchor), pa.array(f[row])], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(anchor: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = (x.view(np.int64) for x in forest(anchor, f.view(np.uint64)))
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            anchor, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(anchor):
                continue
            cut = np.searchsorted(anchor, anchor[-1])  # the last anchor may go on in the next batch
            if cut:
                held.append((anchor[:cut], f[:cut]))
                yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append((anchor[cut:], f[cut:]))
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    spark = distinct.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = map_arrow(distinct.select("fp"), replicate, "anchor long, fp long", 2000).repartition(n, "anchor").sortWithinPartitions("anchor", "fp")
    return map_arrow(dealt, compare, "a long, b long", 10_000).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is a centre, or has one edge and that to a centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 and n > 1").isEmpty()


def components(links_: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links; root is its component's smallest node.

    Alternates two contractions until only stars are left: each node's larger neighbours go to its smallest neighbour, then
    each node and its smaller neighbours go to the smallest of these. Rounds grow with the logarithm of the nodes.
    """
    edges = stash(links_.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stash(meet(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = meet(large, least, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stash(down.union(least).distinct())
        discard(edges, large)
        edges = small
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def fingerprinted(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fp) for every row; fp is the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist()).view(np.int64))], names=[key, "fp"])

    return map_arrow(texts(docs, key), run, f"{key} long, fp long")


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint in hexadecimal, component_id: the smallest key that links reach) for every row."""
    rows = stash(fingerprinted(docs, key))
    distinct = stash(rows.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(distinct))
    linked = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = stash(linked)
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = linked.join(smallest.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("fp", "component_id")
    return meet(rows, of, "fp", key).select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
