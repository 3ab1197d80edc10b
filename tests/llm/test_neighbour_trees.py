"""Projected neighbours from trees, against sorting all; searches over several cells and shards; what a search costs as tables grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import neighbours


def clustered(n: int, dim: int = 48, seed: int = 2) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = 3 * rng.standard_normal((max(n // 50, 1), dim))
    return centres[rng.integers(0, len(centres), n)] + 0.5 * rng.standard_normal((n, dim))


def brute(unit: np.ndarray, i: int, k: int = 5) -> set[int]:
    s = unit @ unit[i]
    s[i] = -9
    return set(np.argpartition(-s, k)[:k].tolist())


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 129, 1000])
def test_projected_neighbours_come_in_order(n):
    points = np.random.default_rng(n).standard_normal((n, neighbours.DIRECTIONS))
    points[n // 2 :: 3] = points[0]  # ties
    tree = neighbours.Tree(points)
    for point, reach in ((points[0], np.inf), (points[-1], 40.0), (np.zeros(neighbours.DIRECTIONS), 25.0)):
        want = np.sort(((points - point) ** 2).sum(axis=1))
        parts = list(tree.near(point, lambda: reach))  # noqa: B023
        rows, far = (np.concatenate([np.zeros(0), *x]) for x in (zip(*parts, strict=True) if parts else ((), ())))
        assert np.allclose(far, want[want <= reach]) and len(set(rows.tolist())) == len(rows)
        assert np.allclose(((points[rows.astype(int)] - point) ** 2).sum(axis=1), far)


def test_a_tree_is_opened_as_far_as_it_is_asked():
    """The first neighbours of a point in a cluster leave most leaves shut; verified vectors grow far slower than N^1.5 over all queries."""
    opened, verified = {}, {}
    for n in (1000, 8000):
        v = clustered(n)
        unit = neighbours.units(v)
        tree = neighbours.Tree(unit @ neighbours.directions(v.shape[1]))
        touched = []

        class Counted(np.ndarray):
            def __getitem__(self, key):
                if isinstance(key, slice):
                    touched.append((key.stop or 0) - (key.start or 0))
                return np.asarray(super().__getitem__(key))

        tree.projected = tree.projected.view(Counted)
        asked, hit, done = range(0, n, 50), 0, 0
        for i in asked:
            found, d = neighbours.nearest((np.arange(n), v, unit, tree), v[i], i, 5)
            hit, done = hit + len({x for _, x in found} & brute(unit, i)), done + d
        opened[n], verified[n] = sum(touched) / len(asked), done
        assert hit >= 0.95 * 5 * len(asked)
    assert opened[8000] < 0.5 * 8000 and verified[8000] < verified[1000] * 8**1.5 / 1.5


def test_many_cells_and_shards(spark, monkeypatch):
    """Cells by the sampled tree, several shards in a cell, several blocks of queries, equal vectors in different shards."""
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 256)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 16)
    v = clustered(3000)
    v[1::300] = v[0]  # ten equal ones, dealt by id
    v[1000:1700] = v[1000] + 0.01 * v[1000:1700]  # a crowd that no cell border parts evenly
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = neighbours.search(rows, F.col("vec_id") % 50 == 0).collect()
    by, unit = {}, neighbours.units(v)
    for r in found:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 50)) and all(sorted(x)[0][0] == 1 and len(x) == 5 for x in by.values())
    assert [i for _, i, _ in sorted(by[0])] == [1, 301, 601, 901, 1801]
    hit = sum(len({i for _, i, _ in by[q]} & brute(unit, q)) for q in by if q)
    assert hit >= 0.9 * 5 * (len(by) - 1)
    for q, found in by.items():
        for _, i, score in found:
            assert score == pytest.approx(float(unit[q] @ unit[i]), abs=1e-12)
