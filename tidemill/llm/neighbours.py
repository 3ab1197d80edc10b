"""Approximate nearest neighbours by cosine: stable projections in a kd-tree, with a chi-square stopping test.

Unit vectors are projected onto DIRECTIONS Gaussian directions; over a distance d the squared projected distance divided by
d^2 is chi-square distributed. A kd-tree over the projections of a bounded sample (SAMPLE rows for each cell, CELLS cells at
most) divides the space into cells; every vector goes to its own, and large cells are dealt into shards of SHARD_ROWS, each
with a kd-tree of its own over all its projections (leaves of LEAF rows at most).

A query first asks one shard of its home cell, which gives it a k-th distance. Then it goes to those cells alone that the test
leaves open: a vector nearer than the k-th found would, with probability SURE, have a projection nearer than the cell's
border. In a shard, the tree gives projected neighbours one after the other, nearest first, opening no node before its box is
next; they are verified exactly, in steps, until the test holds for the next one. The k best of all shards are the result.
A shard is copied once for every QUERY_ROWS queries that have come to it, and not at all where none has.

Vectors that are null, empty, zero or hold a null or a non-finite component take no part, nor do rows without a vec_id.
Only vectors of equal length are compared. Equal scores go to the smaller vec_id. Of equal vectors only the k + 1 smallest
ids can be among anyone's k nearest; the others stay behind before anything is dealt. Repeated rows are one candidate, no
vector is its own neighbour; a vec_id with several vectors counts with its best. An empty table gives an empty result, and
columns besides vec_id and embedding play no part, however they are called.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, stash

DIRECTIONS, SEED = 32, 11
SURE = 0.92
SHARD_ROWS, QUERY_ROWS = 8192, 4096
CELLS, SAMPLE = 4096, 32
#: Vectors verified before the test is asked again, and rows of a tree's leaf at most.
STEP, LEAF = 64, 64


@cache
def chi_square_quantile(p: float, degrees: int) -> float:
    """x with P(chi-square <= x) = p, for an even number of degrees."""
    if degrees % 2:
        raise ValueError("even degrees of freedom only")
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        term = total = math.exp(-x / 2)
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - total < p else (low, x)
    return high


@cache
def directions(dim: int, n: int = DIRECTIONS) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, n))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which change no digit, so that squares neither overflow nor vanish."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def units(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row with exact sums, so that equal vectors have equal scores everywhere."""
    rows, query = scaled(rows), scaled(query[None, :])[0]
    dot = np.array([math.fsum(r) for r in rows * query])
    return dot / (np.sqrt([math.fsum(r) for r in rows * rows]) * math.sqrt(math.fsum(query * query)))


class Cells:
    """A kd-tree of 2^depth cells: each inner node splits a direction, each cell is a box."""

    def __init__(self, projected: np.ndarray, cells: int) -> None:
        self.depth = max(0, math.ceil(math.log2(cells))) if len(projected) else 0
        inner = (1 << self.depth) - 1
        self.axis, self.at = np.zeros(inner, np.int64), np.zeros(inner)
        self.low = np.full((1 << self.depth, DIRECTIONS), -np.inf)
        self.high = -self.low
        parts = {0: projected}
        for node in range(inner):
            part = parts.pop(node)
            if len(part):
                self.axis[node] = np.argmax(part.max(axis=0) - part.min(axis=0))
                self.at[node] = np.median(part[:, self.axis[node]])
            left = part[:, self.axis[node]] < self.at[node]
            parts[2 * node + 1], parts[2 * node + 2] = part[left], part[~left]
            level = (node + 1).bit_length() - 1
            width = 1 << self.depth - level
            first = (node + 1 - (1 << level)) * width
            a, b, axis = slice(first, first + width // 2), slice(first + width // 2, first + width), self.axis[node]
            self.high[a, axis] = np.minimum(self.high[a, axis], self.at[node])
            self.low[b, axis] = np.maximum(self.low[b, axis], self.at[node])

    def of(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (projected[np.arange(len(node)), self.axis[node]] >= self.at[node])
        return node - (1 << self.depth) + 1

    def open(self, projected: np.ndarray, reach: float) -> np.ndarray:
        """The cells that come within a squared distance of reach of the point."""
        gap = np.maximum(np.maximum(self.low - projected, projected - self.high), 0.0)
        return np.flatnonzero((gap * gap).sum(axis=1) <= reach)


class Tree:
    """A kd-tree over all projections of a shard: nodes halve their rows along their widest direction and keep their rows' box.

    Node i has the nodes 2i + 1 and 2i + 2 below it; the last level are leaves. Rows of equal projections part like others.
    """

    def __init__(self, projected: np.ndarray) -> None:
        self.depth = max(0, math.ceil(math.log2(max(len(projected), 1) / LEAF)))
        nodes = (1 << self.depth + 1) - 1
        rows, ends = np.arange(len(projected)), {0: (0, len(projected))}
        self.low, self.high = np.full((nodes, projected.shape[1]), np.inf), np.full((nodes, projected.shape[1]), -np.inf)
        for node in range(nodes):
            first, last = ends.pop(node)
            part = projected[rows[first:last]]
            if len(part):
                self.low[node], self.high[node] = part.min(axis=0), part.max(axis=0)
            if node < nodes >> 1:
                half = len(part) // 2
                if len(part) > 1:
                    axis = int(np.argmax(self.high[node] - self.low[node]))
                    rows[first:last] = rows[first:last][np.argpartition(part[:, axis], half)]
                ends |= {2 * node + 1: (first, first + half), 2 * node + 2: (first + half, last)}
            else:
                ends[node] = (first, last)
        # a leaf's rows lie beside each other
        self.rows, self.projected = rows, projected[rows]
        self.leaves = [ends[node] for node in range(nodes >> 1, nodes)]

    def near(self, point: np.ndarray, within: Callable[[], float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, squared projected distances) within a reach of the point, in rising order, a few at first and STEP later.

        The reach is asked for again after every step and may shrink. Nodes wait in a heap by the distance of their boxes; rows are given once no waiting box is nearer than they are. Rows of
        opened leaves are sorted in with the others when they are a quarter as many.
        """
        inner, heap = len(self.low) >> 1, [(0.0, 0)]
        at, far = np.zeros(0, np.int64), np.zeros(0)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        n_fresh, step = 0, STEP >> 3
        while True:
            reach, bound = within(), heap[0][0] if heap else math.inf
            if n_fresh and (not heap or bound > reach or 4 * n_fresh >= len(at)):
                at, far = (np.concatenate([old, *new]) for old, new in zip((at, far), zip(*fresh, strict=True), strict=True))
                order = np.argsort(far, kind="stable")
                at, far, fresh, n_fresh = at[order], far[order], [], 0
            if not n_fresh:
                sure = int(np.searchsorted(far, min(bound, reach), "right"))
                if sure >= step or bound > reach or not heap:
                    if sure:
                        yield at[:sure], far[:sure]
                    if bound > reach or not heap:
                        return
                    at, far, step = at[sure:], far[sure:], min(2 * step, STEP)
                    continue
            _, node = heapq.heappop(heap)
            if node < inner:
                two = slice(2 * node + 1, 2 * node + 3)
                gap = np.maximum(np.maximum(self.low[two] - point, point - self.high[two]), 0.0)
                for child, d in enumerate(np.einsum("ij,ij->i", gap, gap).tolist()):
                    if d <= reach:
                        heapq.heappush(heap, (d, 2 * node + 1 + child))
            else:
                first, last = self.leaves[node - inner]
                apart = self.projected[first:last] - point
                fresh.append((self.rows[first:last], np.einsum("ij,ij->i", apart, apart)))
                n_fresh += last - first


def nearest(data: tuple[np.ndarray, np.ndarray, np.ndarray, Tree], query: np.ndarray, own: int, k: int, bound: float = math.inf, sure: float = SURE) -> tuple[list[tuple[float, int]], int]:
    """(score, id) of the k nearest by cosine that lie within the squared distance bound, other than the id own; and how many were verified.

    data: ids, vectors, their units and the tree over their projections.
    """
    ids, vectors, unit, tree = data
    q = units(query[None, :])[0]
    stop = chi_square_quantile(sure, DIRECTIONS)
    taken, near, best, done, kth = [], [], np.zeros(0), 0, bound
    for some, reach in tree.near(q @ directions(len(q)), lambda: stop * kth):
        others = ids[some] != own
        some, reach = some[others], reach[others]
        for at in range(0, len(some), STEP):
            if reach[at] > stop * kth:
                break
            taken.append(some[at : at + STEP])
            near.append(unit[taken[-1]] @ q)
            done += len(near[-1])
            best = np.concatenate([best, near[-1]])
            if len(best) >= k:
                best = np.partition(best, -k)[-k:]
                kth = min(bound, max(0.0, 2 - 2 * best[0]))
        else:
            continue
        break
    # rounding may part equal scores here: take all within a margin, then measure exactly
    rows = np.concatenate([np.zeros(0, np.int64), *taken])[np.concatenate([np.zeros(0), *near]) >= 1 - kth / 2 - 1e-9]
    found = zip(cosine(vectors[rows], query).tolist(), ids[rows].tolist(), strict=True) if len(rows) else ()
    scores: dict[int, float] = {}
    for score, i in found:
        scores[i] = max(score, scores.get(i, -2.0))
    return sorted(((s, i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k], done


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & sound)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def _projected(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for dim, at in part.groupby("dim").indices.items():
            yield pd.DataFrame({"dim": np.int32(dim), "projected": list(units(_matrix(part.embedding.iloc[at])) @ directions(dim))})


def _celled(rows: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """rows with their cell."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cell = np.zeros(len(part), np.int32)
            for dim, at in part.groupby("dim").indices.items():
                if dim in trees:
                    cell[at] = trees[dim].of(units(_matrix(part.embedding.iloc[at])) @ directions(dim))
            yield part.assign(cell=cell)

    return rows.mapInPandas(run, "vec_id long, embedding array<double>, dim int, cell int")


def _asked(shards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, verified) of queries (dim, cell, shard, query_id, asked: vector, bound); vec_id is null in the rows that count the verified."""

    def meet(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int | None, float, int]] = []
        if len(data) and len(asked):
            vectors = _matrix(data.embedding)
            unit = units(vectors)
            held = data.vec_id.to_numpy(), vectors, unit, Tree(unit @ directions(vectors.shape[1]))
            for own, query, bound in zip(asked.query_id.tolist(), asked.asked, asked.bound.tolist(), strict=True):
                found, verified = nearest(held, np.asarray(query), own, k, bound)
                out += [(own, i, score, 0) for score, i in found]
                out.append((own, None, 0.0, verified))
        out = pd.DataFrame(out, columns=["query_id", "vec_id", "score", "verified"])
        return out.astype({"query_id": "int64", "vec_id": "Int64", "score": "float64", "verified": "int64"})

    at, keys = ["dim", "cell", "shard"], ["dim", "cell", "shard", "block"]
    # a query goes to one block of its shard, so that many queries of one shard are many tasks; blocks are as many as the
    # shard's own queries need
    blocks = queries.groupBy(*at).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    left = shards.join(blocks, at).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    some = queries.join(blocks, at).withColumn("block", F.pmod(F.xxhash64("query_id", "asked"), F.col("blocks")).cast("int")).drop("blocks")
    return left.groupBy(*keys).cogroup(some.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double, verified long")


def found(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """All that shards give for the queries, and how many vectors they verified for it: see `_asked`."""
    spark = vectors.sparkSession
    rows = usable(vectors).withColumn("dim", F.size("embedding")).distinct()
    of_equal = Window.partitionBy("embedding").orderBy("vec_id")
    queries = rows.where(is_query)
    rows = rows.withColumn("n", F.row_number().over(of_equal)).where(F.col("n") <= k + 1).drop("n")
    rows = stash(rows)
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    wanted = {d: min(CELLS, 1 << max(0, math.ceil(math.log2(n / SHARD_ROWS)))) for d, n in sizes.items()}
    total, several = sum(sizes.values()), {d: c for d, c in wanted.items() if c > 1}
    trees = {}
    if several:
        share = min(1.0, SAMPLE * sum(several.values()) / total)
        # a hash of the vector chooses the sample; it is bounded by SAMPLE rows for each of CELLS cells of a length
        some = rows.where(F.col("dim").isin(*several) & (F.pmod(F.xxhash64("embedding", "vec_id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * share) + 1)))
        # DIRECTIONS numbers of each sampled vector come to the driver, not the vector
        drawn = some.mapInPandas(_projected, "dim int, projected array<double>").toPandas()
        trees = {d: Cells(_matrix(part.projected), several[d]) for d, part in drawn.groupby("dim")}
    celled = stash(_celled(rows, trees))
    counts = celled.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()  # a row for each cell
    shards = {(r.dim, r.cell): -(-r.n // SHARD_ROWS) for r in counts}

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = np.array([shards[d, c] for d, c in zip(part.dim, part.cell, strict=True)], np.int64)
            yield part.assign(shard=(part.vec_id.to_numpy() * 0x9E3779B1 % (1 << 31) % n).astype(np.int32))

    held = celled.mapInPandas(dealt, "vec_id long, embedding array<double>, dim int, cell int, shard int")
    queries = _celled(queries, trees).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), "dim", "cell")
    home = queries.where(F.col("dim").isin(*sizes)).select("query_id", "asked", "dim", "cell", F.lit(0).alias("shard"), F.lit(math.inf).alias("bound"))
    first = stash(_asked(held.where("shard = 0"), home, k))
    kth = first.where("vec_id is not null").groupBy("query_id").agg(F.count("*").alias("met"), F.max(2 - 2 * F.col("score")).alias("worst"))
    bounds = kth.select(F.col("query_id").alias("b"), F.when(F.col("met") >= k, F.col("worst")).alias("bound"))

    def opened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stop, names = chi_square_quantile(SURE, DIRECTIONS), ["query_id", "asked", "dim", "cell", "shard", "bound"]
        for part in parts:
            out = []
            for query, asked, dim, cell, bound in part[["query_id", "asked", "dim", "cell", "bound"]].itertuples(index=False):
                at, reach = np.asarray(asked), math.inf if bound is None or math.isnan(bound) else max(bound, 0.0) + 1e-9
                there = trees[dim].open(units(at[None, :])[0] @ directions(dim), stop * reach).tolist() if dim in trees else [0]
                out += [(query, asked, dim, c, s, reach) for c in there for s in range(shards.get((dim, c), 0)) if (c, s) != (cell, 0)]
            yield pd.DataFrame(out, columns=names).astype({"query_id": "int64", "dim": "int32", "cell": "int32", "shard": "int32", "bound": "float64"})

    again = home.drop("bound", "shard").join(bounds, F.col("query_id") == F.col("b"), "left").drop("b")
    rest = again.mapInPandas(opened, "query_id long, asked array<double>, dim int, cell int, shard int, bound double")
    second = stash(_asked(held, rest, k)) if sum(shards.values()) > len(sizes) else spark.createDataFrame([], first.schema)
    out = stash(first.union(second))
    discard(rows, celled, first)
    return out


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row that is_query (a condition on vec_id) selects."""
    near = found(vectors, is_query, k).where("vec_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
