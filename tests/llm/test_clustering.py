"""Lloyd rounds over two trees against all distances, and against SQL."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pytest

from strataline.llm import clustering, queries
from tests.compare import SF, same


def plain(rows, k, rounds, dim=4, scale=256):
    vectors = [(i, np.floor(np.array(v, np.float64) * scale).astype(int)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    own = sorted(((sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v in vectors if i is not None))[:k]
    c = np.array([v for _, v in own])
    x = np.array([v for _, v in vectors])
    assign = lambda: ((x[:, None] - c[None]) ** 2).sum(2)
    for _ in range(rounds):
        a = assign().argmin(1)
        c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    d = assign()
    return sorted(zip([i for i, _ in vectors], d.argmin(1).tolist(), d.min(1).tolist()), key=repr), c.tolist()


@pytest.mark.parametrize("seed", range(30))
def test_nearest_by_two_trees(seed):
    rng = np.random.default_rng(seed)
    wide = int(rng.choice([2, 10, 1000, 1 << 27]))
    points = np.unique(rng.integers(-wide, wide, (rng.integers(1, 300), rng.integers(1, 6))), axis=0)
    if seed % 3 == 0:  # clusters
        points = np.unique(points[rng.integers(0, min(5, len(points)), 300)] + rng.integers(-2, 3, (300, points.shape[1])), axis=0)
    centroids = points[rng.integers(0, len(points), rng.integers(1, 40))] + rng.integers(-1, 2, (1, points.shape[1]))  # with equal ones
    d = ((points[:, None] - centroids[None]) ** 2).sum(2)
    cluster, distance = clustering.nearest(points, clustering.CoverTree(points), centroids, clustering.CoverTree(centroids))
    assert cluster.tolist() == d.argmin(1).tolist() and distance.tolist() == d.min(1).tolist()


def test_tree_covers_and_separates():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 9, (200, 3)), 1000 + rng.integers(0, 9, (100, 3))])
    x = np.unique(x, axis=0)
    t = clustering.CoverTree(x)

    def below(n):
        return [t.center[n]] if not t.count[n] else [i for c in range(t.first[n], t.first[n] + t.count[n]) for i in below(c)]

    assert sorted(below(0)) == list(range(len(x)))
    for n in range(len(t.center)):
        assert np.sqrt(((x[below(n)] - x[t.center[n]]) ** 2).sum(1)).max() <= t.radius[n]
        kids = t.center[t.first[n] : t.first[n] + t.count[n]]
        apart = np.sqrt(((x[kids][:, None] - x[kids][None]) ** 2).sum(2))
        assert (apart[~np.eye(len(kids), dtype=bool)] > t.radius[n] / 2 - 1e-6).all()


def test_pairs_are_pruned(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.unique((rng.integers(0, 10, (2000, 1)) * 1000 + rng.integers(0, 20, (2000, 8))), axis=0)
    c = np.arange(10)[:, None] * 1000 + np.full((10, 8), 10)
    looked, sqrt = [], np.sqrt
    t, over = clustering.CoverTree(x), clustering.CoverTree(c)
    monkeypatch.setattr(clustering.np, "sqrt", lambda v: looked.append(v.size) or sqrt(v))
    got, _ = clustering.nearest(x, t, c, over)
    assert (got == x[:, 0] // 1000).all() and sum(looked) / 2 < len(x) * len(c) / 3


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)


def test_edge_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, [1.0, 1, 1, 1]) for i in range(30)] + [(3, [0.0, 0, 0, 0]), (3, [0.0, 0, 0, 0]), (None, [1.0, 2, 3, 4])]
    rows += [(200, None), (201, []), (202, [1.0, 2, 3]), (203, [1.0, None, 3, 4]), (204, [1.0, float("nan"), 3, 4]), (205, [1.0, float("inf"), 3, 4]), (206, [1e300, -1e300, 0, 0])]
    got, c = clustering.lloyd(table(spark, rows), 7, 5, dim=4, chunk=16)
    held = [(i, [2.0**19, -(2.0**19), 0, 0] if i == 206 else v) for i, v in rows]
    want, centroids = plain(held, 7, 5)
    assert sorted(map(tuple, got.collect()), key=repr) == want and c == centroids


def test_fewer_vectors_than_centroids_and_none(spark):
    got, c = clustering.lloyd(table(spark, [(1, [0.1, 0, 0, 0]), (2, [0.5, 0, 0, 0]), (9, None)]), 40, 5, dim=4)
    assert {r["vec_id"]: r["distance"] for r in got.collect()} == {1: 0, 2: 0} and len(c) == 2
    got, c = clustering.lloyd(table(spark, [(9, None)]), 40, 5, dim=4)
    assert clustering.with_inertia(got, c).collect() == [] and c == []


def test_query_and_sql(spark, duck):
    same(queries.QUERIES["op13_centroids"](spark, SF), duck, queries.ORACLE_SQL["op13_centroids"])
