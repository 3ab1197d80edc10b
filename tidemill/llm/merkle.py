"""A Merkle manifest of a dataset: a hash tree over each group's rows, one over the groups' roots, and a proof for each row.

Leaves are range-sorted by group and order over checkpointed partitions. Counts by partition and group give each
partition the place of its rows in their groups. A partition then builds every aligned subtree that lies wholly in it;
the ragged nodes at its two ends are shuffled by their coordinate (group, level, run), level by level, until each group
that spans partitions has its root. The groups' roots are the leaves of a tree of their own, built alike. At last each
partition gets the few runs that its ends lack, and the way from its groups to the root, and returns every row's proof:
the siblings on its way up.

FAN consecutive nodes of a level, the last run perhaps fewer, become the hash of their digests; a lone node that is all
of its level is the root. Digests are lower-case hex and are hashed as such.

Rows of any group spread over partitions, and rows equal in everything too: a partition sends at most 2 (FAN - 1) nodes of
a level for each of the at most two groups that it shares with others. Only counts go to the driver, two numbers for each
such group and partition, and the root.

Nulls: a null field hashes as `-`; a null group is a group of its own and the first; a null order value comes first.
Empty texts are values like any other. Ties in group and order go by leaf; repeated rows are leaves of their own. Long
texts are hashed whole, before anything is shuffled; texts aren't shuffled. An empty table gives an empty result. Columns
that aren't named as fields play no part, however they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import ARROW_ROWS, range_partitions, ranged, stash

#: Nodes that share a parent; a power of two.
FAN = 16
_BITS = FAN.bit_length() - 1
#: Bytes of input for one partition of leaves (of some 200 bytes each).
LEAF_BYTES = 64 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before: string, after: string>>"


def digest(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf(fields: Sequence[str | Column]) -> Column:
    """The hash of a row: each field `-` if null, else its length in UTF-8 bytes, a colon and its text."""
    written = []
    for f in fields:
        text = (F.col(f) if isinstance(f, str) else f).cast("string")
        written.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*written), 256)


def width(total: int, level: int) -> int:
    """Nodes of a level above so many leaves."""
    return -(-total >> (level * _BITS)) if level else total


def climb(leaves: list[str], start: int, total: int) -> list[tuple[int, list[str]]]:
    """By level, the first place and the digests of the nodes whose leaves all are among these, at start of total."""
    levels = [(start, leaves)]
    while levels[-1][1] and (size := width(total, len(levels) - 1)) > 1:
        first, nodes = levels[-1]
        low, end = -(-first // FAN), first + len(nodes)
        high = -(-end // FAN) if end == size else end // FAN
        levels.append((low, [digest(nodes[j * FAN - first : j * FAN + FAN - first]) for j in range(low, high)]))
    return levels


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


class _Places:
    """Where the rows of a partition stand in their groups: only the first and the last group can be shared with others."""

    def __init__(self, shared: list[tuple[int, int, int]]) -> None:
        self.first = {p: (offset, total) for p, offset, total in shared if offset}
        self.last = {p: total for p, offset, total in shared if not offset}

    def of(self, part: int, is_first: bool, is_last: bool, n: int) -> tuple[int, int]:
        """(place of the first row, rows of the group) of a partition's group with n rows there."""
        if is_first and part in self.first:
            return self.first[part]
        return 0, self.last.get(part, n) if is_last else n


class Forest:
    """Trees over leaves (group_, leaf, the columns of order, and any others), one for each group.

    roots: (group_, root, total). spans: rows of each partition and group, with the group's rows before them and in all.
    """

    def __init__(self, leaves: DataFrame, order: list[str], partitions: int | None = None) -> None:
        self.n = partitions or range_partitions(leaves, LEAF_BYTES)
        self.order = order
        self.rows = ranged(leaves, ["group_", *order, "leaf"], self.n)
        counts = self.rows.groupBy("part_", "group_").agg(F.count("*").alias("n"))
        by = Window.partitionBy("group_")
        before = F.sum("n").over(by.orderBy("part_")) - F.col("n")
        self.spans = stash(counts.withColumns({"offset": before, "total": F.sum("n").over(by)}))
        # two rows for each partition at most
        shared = [(r.part_, r.offset, r.total) for r in self.spans.where("total > n").select("part_", "offset", "total").collect()]
        self.places = _Places(shared)
        self.levels = 0
        while width(max((t for _, _, t in shared), default=1), self.levels) > 1:
            self.levels += 1
        made = stash(self._local())
        self.roots, self.runs = self._upper(made)

    def _local(self) -> DataFrame:
        """Roots of groups that lie in one partition (level -1), and of others the nodes whose run isn't all here."""
        places = self.places

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, held, part, first = None, [], None, True
            out: list[tuple] = []

            def done(is_last: bool) -> None:
                start, total = places.of(part, first, is_last, len(held))
                levels = climb(held, start, total)
                if len(held) == total:
                    out.append((group, -1, 0, levels[-1][1][0], total))
                    return
                for level, (at, nodes) in enumerate(levels):
                    low, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
                    inside = range(low * FAN, (low + len(above)) * FAN)
                    out.extend((group, level, at + k, d, total) for k, d in enumerate(nodes) if at + k not in inside)

            for b in batches:
                for g, d, p in zip(_column(b, "group_"), _column(b, "leaf"), _column(b, "part_"), strict=True):
                    if g != group and held:
                        done(False)
                        held, first = [], False
                    group, part = g, p
                    held.append(d)
                if len(out) > ARROW_ROWS:
                    yield _batch(out)
                    out.clear()
            if held:
                done(True)
            yield _batch(out)

        return self.rows.select("group_", "leaf", "part_").mapInArrow(run, "group_ string, level int, idx long, digest string, total long")

    def _upper(self, made: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Roots, and the runs (group_, level, run, digests) of nodes that partitions share, by a shuffle for each level."""
        roots = made.where("level = -1").select("group_", F.col("digest").alias("root"), "total")
        nodes, runs = made.where("level = 0").drop("level"), None
        for level in range(self.levels):
            run = F.shiftright("idx", _BITS).alias("run")
            # FAN nodes at most
            met = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
            here = stash(nodes.groupBy("group_", run, "total").agg(met.alias("digests")))
            parents = here.select("group_", F.col("run").alias("idx"), F.sha2(F.array_join("digests", ""), 256).alias("digest"), "total")
            last = F.col("total") <= FAN ** (level + 1)
            roots = roots.unionByName(parents.where(last).select("group_", F.col("digest").alias("root"), "total"))
            nodes = parents.where(~last).unionByName(made.where(F.col("level") == level + 1).drop("level"))
            here = here.select("group_", F.lit(level).alias("level"), "run", "digests")
            runs = here if runs is None else runs.unionByName(here)
        return roots, runs

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """The columns of leaves but group_, with subroot and proof; above: (group_, proof) from the groups' roots on."""
        none = F.array().cast(PROOF)
        ways = self.roots.select("group_", "root", none.alias("proof")) if above is None else self.roots.select("group_", "root").join(above.select("group_", "proof"), "group_")
        told = [self.spans.select("part_", "group_").join(ways, "group_").select("part_", F.lit(1).alias("kind_"), "group_", F.col("root").alias("leaf"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("array<string>").alias("digests"), "proof")]
        if self.runs is not None:
            ends = F.array_distinct(F.array(*(F.expr(f"shiftright({x}, {_BITS} * (level + 1))") for x in ("offset", "offset + n - 1"))))
            asked = self.spans.where("total > n").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(self.levels - 1)))).select("part_", "group_", "level", F.explode(ends).alias("run"))
            met = asked.join(self.runs, ["group_", "level", "run"])
            told.append(met.select("part_", F.lit(0).alias("kind_"), "group_", F.lit(None).cast("string").alias("leaf"), "level", F.col("run").alias("place"), "digests", none.alias("proof")))
        rest = [c for c in self.rows.columns if c not in ("group_", "leaf", "part_", "pos_")]
        carried = F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("none_"))
        rows = self.rows.select("part_", F.lit(2).alias("kind_"), "group_", "leaf", F.lit(0).alias("level"), F.col("pos_").alias("place"), F.lit(None).cast("array<string>").alias("digests"), none.alias("proof"), carried.alias("rest"))
        for t in told:
            rows = rows.unionByName(t, allowMissingColumns=True)
        dealt = rows.repartitionById(self.n, "part_").sortWithinPartitions("part_", "kind_", "group_", "place")
        kind = self.rows.select(carried.alias("rest")).schema["rest"].dataType.simpleString()
        places = self.places
        got = dealt.mapInArrow(lambda batches: _proved(batches, places), f"group_ string, leaf string, subroot string, proof {PROOF}, rest {kind}")
        return got.select("leaf", "subroot", "proof", *(F.col("rest").getField(c).alias(c) for c in rest))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [("group_", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("total", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])


def _proved(batches: Iterator[pa.RecordBatch], places: _Places) -> Iterator[pa.RecordBatch]:
    """Rows of a partition with their proofs. What is told of a partition (kinds 0 and 1) comes before its rows."""
    runs: dict[tuple[str, int, int], list[str]] = {}
    ways: dict[str, tuple[str, list[tuple[str, str]]]] = {}
    part, group, first = None, None, True
    leaves: list[str] = []
    rests: list[pa.Array] = []

    def done(is_last: bool) -> Iterator[pa.RecordBatch]:
        subroot, top = ways[group]
        start, total = places.of(part, first, is_last, len(leaves))
        levels = climb(leaves, start, total)
        known: dict[tuple[int, int], list[tuple[str, str]]] = {}

        def way(level: int, i: int) -> list[tuple[str, str]]:
            """What lies before and after the node in its run, and so on up."""
            if width(total, level) <= 1:
                return top
            r = i // FAN
            at, nodes = levels[level] if level < len(levels) else (0, [])
            low, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
            met = nodes[r * FAN - at : r * FAN + FAN - at] if low <= r < low + len(above) else runs[group, level, r]
            if (level + 1, r) not in known:
                known[level + 1, r] = way(level + 1, r)
            k = i - r * FAN
            return [("".join(met[:k]), "".join(met[k + 1 :])), *known[level + 1, r]]

        rest = pa.concat_arrays(rests)
        for a in range(0, len(leaves), ARROW_ROWS):
            some = leaves[a : a + ARROW_ROWS]
            paths = [way(0, start + a + k) for k in range(len(some))]
            flat = [x for p in paths for x in p]
            offsets = [0]
            for p in paths:
                offsets.append(offsets[-1] + len(p))
            steps = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string())], names=["before", "after"])
            proof = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(some), pa.string()), pa.array(some, pa.string()), pa.array([subroot] * len(some), pa.string()), proof, rest.slice(a, len(some))], names=["group_", "leaf", "subroot", "proof", "rest"])

    for b in batches:
        kinds, groups, parts, digests = (_column(b, c) for c in ("kind_", "group_", "part_", "leaf"))
        rest = b.column(b.schema.get_field_index("rest"))
        told = [i for i, k in enumerate(kinds) if k < 2]
        if told:
            levels_, place, met, proof = (_column(b.take(pa.array(told)), c) for c in ("level", "place", "digests", "proof"))
        seen, i = 0, 0
        while i < b.num_rows:
            if (parts[i], groups[i] if kinds[i] == 2 else None) != (part, group) and leaves:
                yield from done(parts[i] != part)
                leaves, rests, first = [], [], False
            if parts[i] != part:
                runs, ways, first = {}, {}, True
            part, group = parts[i], groups[i]
            if kinds[i] < 2:
                if kinds[i]:
                    ways[group] = (digests[i], [(x["before"], x["after"]) for x in proof[seen]])
                else:
                    runs[group, levels_[seen], place[seen]] = met[seen]
                seen, i = seen + 1, i + 1
                continue
            j = i
            while j < b.num_rows and kinds[j] == 2 and groups[j] == group and parts[j] == part:
                j += 1
            leaves += digests[i:j]
            rests.append(rest.slice(i, j - i))
            i = j
    if leaves:
        yield from done(True)


def manifest(rows: DataFrame, group: str = "source", order: str = "doc_id", fields: Sequence[str] = FIELDS, keep: dict[str, Column] | None = None, partitions: int | None = None) -> tuple[str | None, DataFrame]:
    """The root of all rows (None of none), and for each its order value, leaf, the root of its group, its proof, and keep.

    keep: name -> expression over rows that goes along with each row.
    """
    text = F.col(group).cast("string")
    # a null comes before every text, and Spark orders text by its UTF-8 bytes
    key = F.coalesce(F.concat(F.lit("1"), text), F.lit("0"))
    leaves = rows.select(key.alias("group_"), F.col(order).alias("order_"), leaf(fields).alias("leaf"), *(v.alias(k) for k, v in (keep or {}).items()))
    trees = Forest(leaves, ["order_"], partitions)
    tops = Forest(trees.roots.select(F.lit("").alias("group_"), F.col("group_").alias("name"), F.col("root").alias("leaf")), ["name"], partitions)
    root = tops.roots.first()
    above = stash(tops.proofs().select(F.col("name").alias("group_"), "proof"))
    return root and root.root, trees.proofs(above).withColumnRenamed("order_", order)


def fold(leaf_: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf_, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings(proof: Column) -> Column:
    """The hash of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def audit(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Proofs of all documents held against the root, some of them after tampering: every fifth by crc32 has lower-cased text."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = leaf([*FIELDS[:-1], F.translate("text", UPPER, LOWER)])
    # null where nothing is claimed but the row as it is
    root, rows = manifest(docs, keep={"claimed": F.when(chosen, changed)}, partitions=partitions)
    folded = fold(F.coalesce("claimed", "leaf"), F.col("proof"))
    out = rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), siblings(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
