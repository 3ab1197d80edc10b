"""Near-duplicates by similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from a prefix filter, links from an exact check. No pair at 0.8 is lost on the way.

* All shingles have one order: those common in a sample of the texts last, the others by their hash. Of n shingles a text's
  prefix are its first n - ceil(0.8 n) + 1. Two texts at 0.8 have at least ceil(0.8 n) shingles in common for either's n, so
  the first common one lies in both prefixes: every pair meets at a shingle. The sample moves work only, no results.
* A first round pairs, among the texts of a shingle, those with fingerprints FAR_BITS or fewer apart; of a crowded shingle
  each text with one leader. It refuses nothing for good: it links close copies, so that few pairs are left to the next.
* A second round takes every pair of texts of a shingle that the first left in different components, and drops only what
  can't reach 0.8: by the numbers of shingles, and by sketches. A sketch has a bit for each bucket of hashes, set where an
  odd number of shingles falls in. A shingle in one text only flips one bit, so the bits that differ are at most the shingles
  that the texts don't share, which at 0.8 are at most a ninth of both numbers together. A text has about as many bits as
  shingles, 1,024 at least; of unequal sketches the longer is folded, which leaves it a sketch of the same shingles.
* Candidates are held against the exact similarity of their shingle sets. What passes links texts into components.
* Links of another method can be given: they join what they link from the start, and the second round looks for what is
  still apart. The components are then those of both.

Pairs of a group are not all emitted: a large group of close copies gives a few pairs for each text. Copies (equal words,
letters' case aside) are one node from the start.

Words are as for the other operator of this kind: A-Z lowered, split at ASCII white space. A text of fewer than five words
is one shingle; texts without words are copies of each other. A null text is empty. Keys must be distinct and not null.
An empty table yields no rows; columns besides key and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, map_arrow, meet, only, stash, texts
from .simhash import SEED, _LOWER, _majority, components

WORDS_A_SHINGLE = 5
#: The least similarity of a link as a fraction.
SIMILARITY = (4, 5)
#: Bits that fingerprints of the first round's pairs are apart at most.
FAR_BITS = 17
#: Words of the shortest sketch, and how often one is doubled at most.
WIDE, DOUBLINGS = 16, 10
#: Texts of the sample that common shingles are counted in, the least count, and how many of them are put last.
SAMPLE, COMMON_COUNT, COMMON = 20_000, 8, 20_000
#: Anchors (shingles of prefixes) with more texts than this are thinned to leaders in the first round.
CROWDED = 8
#: Rows of an Arrow batch where a row can hold two shingle sets, and where it holds fingerprints only.
PAIR_ROWS, MARK_ROWS = 100, 10_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of h (a bijection by multiplications and shifts)."""
    for factor in (0xD6E8FEB86659FD93, 0xA3B195354A39B70D):
        h = (h ^ h >> np.uint64(32)) * np.uint64(factor)
    return h ^ h >> np.uint64(32)


def word_hashes(text: str) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w, SEED) for w in text.encode().translate(_LOWER).split()], np.uint64)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """One hash for each window of WORDS_A_SHINGLE word hashes; of fewer words one for all."""
    width = min(WORDS_A_SHINGLE, len(words))
    if not width:
        return words
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = out * _STEP + words[i : i + len(out)]
    return _mixed(out)


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of sorted distinct shingles, as many as a text of SIMILARITY must share one of; common (sorted) ones come last, by rank."""
    n = len(shingles)
    length = n - -(-SIMILARITY[0] * n // SIMILARITY[1]) + 1 if n else 0
    if not len(common):
        return shingles[:length]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    last = common[at] == shingles
    first = shingles[~last]
    if len(first) >= length:
        return first[:length]
    return np.concatenate([first, shingles[last][np.argsort(rank[at[last]])]])[:length]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """WIDE words, doubled until there is a bit for each shingle: of each bucket of hashes whether an odd number of shingles is in it."""
    bits = 64 * WIDE << min(max(len(shingles) - 1, 0) // (64 * WIDE), (1 << DOUBLINGS) - 1).bit_length()
    odd = np.bincount((shingles >> np.uint64(44)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def marks(text_list: list[str], common: np.ndarray, rank: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """(digest of the words, number of distinct shingles, their fingerprint, their sketch, their prefix) of each text."""
    from xxhash import xxh3_128_digest

    words = [word_hashes(t) for t in text_list]
    digests = [xxh3_128_digest(w.tobytes()) for w in words]
    sets = [np.unique(shingle_hashes(w)) for w in words]
    size, far = np.array([len(x) for x in sets], np.int32), np.zeros(len(sets), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        counts = size[some].astype(np.int64)
        far[some] = _majority(np.concatenate([sets[i] for i in some]), np.cumsum(counts) - counts, counts)
    return digests, size, far, [sketch(x).tobytes() for x in sets], [prefix(x, common, rank).tobytes() for x in sets]


def _close(far: np.ndarray, size: np.ndarray, i: np.ndarray | int, j: np.ndarray | slice) -> np.ndarray:
    small, large = np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
    return (np.bitwise_count(far[j] ^ far[i]) <= FAR_BITS) & (SIMILARITY[1] * small >= SIMILARITY[0] * large)


class Sketches:
    """The sketches of many texts, by length: texts that have longer ones are there in every shorter length as well."""

    PAIRS = 1 << 22

    def __init__(self, sketches: list[bytes]) -> None:
        level = np.array([(len(x) // (8 * WIDE)).bit_length() - 1 for x in sketches])
        self.level, self.rows, self.place = level, [], []
        for n in range(int(level.max(initial=0)) + 1):
            has = np.flatnonzero(level >= n)
            folded = [np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64).reshape(-1, WIDE << n), axis=0) for i in has]
            self.rows.append(np.array(folded, np.uint64).reshape(-1, WIDE << n))
            place = np.zeros(len(level), np.int64)
            place[has] = np.arange(len(has))
            self.place.append(place)

    def allowed(self, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of each pair False only if more shingles differ than SIMILARITY allows; sketches differ in no more bits than that."""
        i, j = np.broadcast_arrays(i, j)
        ok = np.ones(len(i), bool)
        for n, (rows, place) in enumerate(zip(self.rows, self.place, strict=True)):
            at = np.flatnonzero(ok & (np.minimum(self.level[i], self.level[j]) >= n))
            for part in np.array_split(at, -(-len(at) * (WIDE << n) // self.PAIRS) or 1):
                a, b = i[part], j[part]
                apart = np.bitwise_count(rows[place[a]] ^ rows[place[b]]).sum(axis=1, dtype=np.int64)
                ok[part] = (SIMILARITY[1] + SIMILARITY[0]) * apart <= (SIMILARITY[1] - SIMILARITY[0]) * (size[a] + size[b])
        return ok


def _thinned(far: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every text close to another one is in a pair: with the leader that took it, or as a leader with its nearest."""
    free = np.ones(len(far), bool)
    for i in range(len(far)):
        if free[i]:
            close = _close(far, size, i, slice(None))
            close[i] = False
            if (taken := np.flatnonzero(close & ~free)).size:
                yield i, taken[[np.bitwise_count(far[taken] ^ far[i]).argmin()]]
            yield i, np.flatnonzero(close & free)
            free &= ~close
            free[i] = False


def _crossing(far: np.ndarray, size: np.ndarray, label: np.ndarray, wide: Sketches, first: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every close pair of different labels that the sketches, of which these texts' begin at first, allow."""
    _, of, counts = np.unique(label, return_inverse=True, return_counts=True)
    main, all_sizes = counts.argmax(), np.zeros(len(wide.level), size.dtype)
    all_sizes[first : first + len(size)] = size
    for i in np.flatnonzero(of != main):
        other = (of == main) | (np.arange(len(of)) > i) & (of != of[i])
        j = np.flatnonzero(other & _close(far, size, i, slice(None)))
        yield i, j[wide.allowed(all_sizes, first + i, first + j)]


def candidates(anchor: np.ndarray, node: np.ndarray, far: np.ndarray, size: np.ndarray, label: np.ndarray | None = None, wide: Sketches | None = None) -> np.ndarray:
    """Distinct (smaller, larger) node pairs of all anchors (sorted by anchor, then node); with labels and sketches, what they allow."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    sizes = np.diff(np.concatenate([first, [len(anchor)]]))
    found = [np.zeros((0, 2), np.int64)]
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= CROWDED), sizes))  # most groups, without a loop
    for shift in range(1, CROWDED):
        i, j = at[:-shift], at[shift:]
        same = anchor[i] == anchor[j]
        i, j = i[same], j[same]
        close = _close(far, size, i, j)
        if label is not None:
            close[close] = label[i[close]] != label[j[close]]
            close[close] = wide.allowed(size, i[close], j[close])
        found.append(np.stack([node[i[close]], node[j[close]]], axis=1))
    for k in np.flatnonzero(sizes > CROWDED):
        of = slice(first[k], first[k] + sizes[k])
        some = node[of]
        for i, others in _thinned(far[of], size[of]) if label is None else _crossing(far[of], size[of], label[of], wide, first[k]):
            found.append(np.stack([np.full(len(others), some[i]), some[others]], axis=1))
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def common_shingles(docs: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles most common in a sample, a bounded number at every size, and their ranks from rare to common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(word_hashes(t))) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["shingle"])

    some = texts(docs, key).sample(min(1.0, SAMPLE / max(docs.count(), 1)), seed=SEED)
    counts = map_arrow(some, run, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON_COUNT)
    rows = counts.orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    hashes = np.array([r.shingle for r in reversed(rows)], np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    return hashes[by_hash], by_hash


def _marked(docs: DataFrame, key: str) -> DataFrame:
    """(key, digest, size, far, wide: the sketch, prefix) for every row."""
    common, rank = common_shingles(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, size, far, wide, prefixes = marks(batch.column(1).to_pylist(), common, rank)
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(size), pa.array(far.view(np.int64)), pa.array(wide, pa.binary()), pa.array(prefixes, pa.binary())]
            yield pa.record_batch(columns, names=["key", "digest", "size", "far", "wide", "prefix"])

    return map_arrow(texts(docs, key), run, "key long, digest binary, size int, far long, wide binary, prefix binary")


def _compared(places: DataFrame) -> DataFrame:
    """Candidates of places, (anchor, node, far, size) in the first round and (anchor, node, far, size, label, wide) in the second: (a, b, False).

    In the first round also the places of anchors with several nodes: (anchor, node, True).
    """
    second = "wide" in places.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            anchor, node, far, size, *more = (np.concatenate(x) for x in zip(*held, strict=True))
            if second:
                more[1] = Sketches(more[1].tolist())
            pairs = candidates(anchor, node, far.view(np.uint64), size.astype(np.int64), *more)
            a, b, n = pairs[:, 0], pairs[:, 1], len(pairs)
            if not second:
                same = np.concatenate([[False], anchor[1:] == anchor[:-1], [False]])
                shared = same[1:] | same[:-1]
                a, b = np.concatenate([a, anchor[shared]]), np.concatenate([b, node[shared]])
            return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) >= n)], names=["a", "b", "place"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [c.to_numpy() for c in batch.columns[:5]]
            if second:
                parts.append(np.array(batch.column("wide").to_pylist(), object))
            cut = np.searchsorted(parts[0], parts[0][-1])  # the last anchor may go on in the next batch
            if cut:
                yield found([*held, [p[:cut] for p in parts]])
                held = []
            held.append([p[cut:] for p in parts])
        if held:
            yield found(held)

    spark = places.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = places.repartition(n, "anchor").sortWithinPartitions("anchor", "node")
    return map_arrow(dealt, compare, "a long, b long, place boolean", MARK_ROWS)


def first_round(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b: distinct close pairs among nodes (node, far, size, prefix); and (anchor, node) of the anchors with several nodes."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(x, np.int64) for x in batch.column("prefix").to_pylist()]
            row = np.repeat(np.arange(len(prefixes)), [len(x) for x in prefixes])
            rest = batch.select(["node", "far", "size"]).take(pa.array(row))
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])), *rest.columns], names=["anchor", "node", "far", "size"])

    places = map_arrow(nodes.select("node", "far", "size", "prefix"), replicate, "anchor long, node long, far long, size int")
    out = stash(_compared(places))
    pairs = stash(out.where("not place").select("a", "b").distinct())
    shared = stash(out.where("place").select(F.col("a").alias("anchor"), F.col("b").alias("node")))
    discard(out)
    return pairs, shared


def second_round(places: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of places (anchor, node) of one anchor and different components that can reach SIMILARITY.

    Fingerprints are estimates and refuse nothing here: all are 0.
    """
    labels = nodes.join(roots.select(F.col("node").alias("r"), "root").hint("merge"), F.col("node") == F.col("r"), "left")
    labels = stash(labels.select(F.col("node").alias("at"), "size", F.coalesce("root", "node").alias("label"), "wide"))
    of = Window.partitionBy("anchor")
    mixed = places.join(labels.select("at", "label").hint("merge"), F.col("node") == F.col("at")).select("anchor", "node", F.min("label").over(of).alias("least"), F.max("label").over(of).alias("most"))
    full = mixed.where("least < most").join(labels.hint("merge"), F.col("node") == F.col("at"))
    out = stash(_compared(full.select("anchor", "node", F.lit(0).cast("long").alias("far"), "size", "label", "wide")).select("a", "b").distinct())
    discard(labels)
    return out


def shingled(pairs: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(node, shingles: sorted distinct hashes) of the texts in pairs. The other texts don't move, nor do these while they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(word_hashes(t))).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    wanted = stash(pairs.select(F.col("a").alias("wanted")).union(pairs.select("b")).distinct())
    out = stash(map_arrow(only(texts(docs, key), key, wanted), run, "node long, shingles binary", PAIR_ROWS))
    discard(wanted)
    return out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose texts reach SIMILARITY; uses sets up. A node of many pairs is spread: its shingle set goes to each salt it has pairs in."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(SIMILARITY[1] * common >= SIMILARITY[0] * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    spark = pairs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # even a node with a third of all pairs then gives no task more than about three times its share, and a set is copied little
    salts = n // 8 + 1
    salted = pairs.withColumns({"i": F.pmod(F.xxhash64("b"), F.lit(salts)), "j": F.pmod(F.xxhash64("a"), F.lit(salts))})
    places = salted.select(F.col("a").alias("at"), F.col("i").alias("salt")).union(salted.select("b", "j")).distinct()
    spread = stash(places.join(sets.hint("merge"), F.col("at") == F.col("node")).select("at", "salt", "shingles"))
    one = spread.select(F.col("at").alias("a"), F.col("salt").alias("i"), F.col("shingles").alias("x"))
    two = spread.select(F.col("at").alias("b"), F.col("salt").alias("j"), F.col("shingles").alias("y"))
    both = salted.join(one.hint("merge"), ["a", "i"]).join(two.hint("merge"), ["b", "j"]).select("a", "b", "x", "y")
    out = stash(map_arrow(both, check, "a long, b long", PAIR_ROWS))
    discard(sets, spread)
    return out


def _classes(docs: DataFrame, key: str, links: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, digest) of all rows, (digest, node) of every distinct text with its smallest key as node, and (node, root) of linked nodes.

    links are between keys of any rows; those of rows that are nobody's node count for their texts' nodes.
    """
    marked = stash(_marked(docs, key))
    nodes = stash(marked.groupBy("digest").agg(F.min("key").alias("node"), *(F.first(c).alias(c) for c in ("size", "far", "wide", "prefix"))))
    rows, texts_ = stash(marked.select("key", "digest")), stash(nodes.select("digest", "node"))
    discard(marked)
    pairs, places = first_round(nodes)
    linked = verified(pairs, shingled(pairs, docs, key))
    if links is not None:
        linked = linked.union(_between_nodes(links, rows, texts_))
    roots = components(linked)
    # what the first round refused isn't checked again
    met = second_round(places, nodes, roots)
    more = stash(met.join(pairs.hint("merge"), ["a", "b"], "left_anti"))
    discard(met, places, nodes, pairs)
    if not more.isEmpty():
        # from the stars on, not from all links again: rounds are saved, and the smallest nodes stay the smallest
        stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(stars.union(verified(more, shingled(more, docs, key))))
    return rows, texts_, roots


def _between_nodes(links: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """links (a, b) of keys of rows (key, digest) as links of nodes (digest, node); those within one node go."""
    of = stash(meet(rows, nodes, "digest", "key").select("key", "node"))
    one = links.join(of.select(F.col("key").alias("a"), F.col("node").alias("x")).hint("merge"), "a")
    # an end of many links is looked up once for each salt of them
    both = meet(one, of.select(F.col("key").alias("b"), F.col("node").alias("y")), "b", "a")
    out = stash(both.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    discard(of)
    return out


def near_copies(docs: DataFrame, key: str = "doc_id", links: DataFrame | None = None) -> DataFrame:
    """(key, component_id: the smallest key that links reach) for every row; links (a, b) between keys count beside those found."""
    rows, nodes, roots = _classes(docs, key, links)
    of = nodes.join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    return meet(rows, of, "digest", "key").select(F.col("key").alias(key), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", links: DataFrame | None = None) -> DataFrame:
    """The smallest key of each component, as column key; rows needn't meet their groups for it. links as for `near_copies`."""
    _, nodes, roots = _classes(docs, key, links)
    others = roots.where("node <> root").select(F.col("node").alias("r"))
    return nodes.join(others.hint("merge"), F.col("node") == F.col("r"), "left_anti").select(F.col("node").alias(key))
