"""Planes, corners and samples against plain versions."""

import random

import numpy as np
import pytest

from strataline.operators import planes


def test_a_planted_vignette_is_removed(spark):
    rng = np.random.default_rng(1)
    dark = 1 - 0.4 * np.hypot(*(np.mgrid[:12, :15] - np.array([6, 7])[:, None, None])) / 10
    tiles = rng.integers(90, 111, (41, 12, 15)) * dark
    rows = [(t, y, x, float(tiles[t, y, x])) for t in range(41) for y in range(12) for x in range(15)] + [(50, 99, 0, 5.0), (51, 0, 0, None), (52, 0, 0, float("nan"))]
    df = spark.createDataFrame(rows, "tile int, y int, x int, value double")
    field = planes.flat_field(df.where("tile < 50"))
    got = {(r["tile"], r["y"], r["x"]): r["value"] for r in planes.corrected(df, field).collect()}
    median = np.median(tiles, axis=0)
    want = tiles * (median.mean() / median)
    assert all(abs(got[t, y, x] - want[t, y, x]) < 1e-9 for t in range(41) for y in range(12) for x in range(15)) and got[50, 99, 0] == 5.0 and len(got) == len(rows)
    # what is left is the noise of a mean of 41 tiles
    assert want.mean(0).std() < 1.2 * (tiles / dark).std() / np.sqrt(41) < 0.2 * tiles.mean(0).std()


def flood(mask, corners):
    left, out = set(zip(*map(list, np.nonzero(mask)))), []
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        own = []
        while todo:
            y, x = todo.pop()
            own.append((int(y), int(x)))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if corners or a * b == 0} & left
            left -= near
            todo += near
        out.append((*min(own), len(own), len({y for y, _ in own}), min(x for _, x in own), max(x for _, x in own)))
    return sorted(out, key=lambda r: (-r[2], r[0], r[1]))


@pytest.mark.parametrize("corners", [False, True])
def test_components_like_flood_fill(spark, corners):
    rng = np.random.default_rng(2)
    masks = {"a": rng.random((60, 200)) < 0.55, "b": np.ones((3, 300), bool), "c": rng.random((20, 20)) < 0.2}
    spiral = np.zeros((41, 41), bool)  # one thin component through all rows
    for k in range(0, 20, 2):
        spiral[k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = spiral[k + 2 : 41 - k, k] = True
        spiral[k + 2, k : k + 2] = True
    masks["d"] = spiral
    rows = [(p, int(y) - 5, int(x) - 70) for p, m in masks.items() for y, x in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows + rows[:40] + [(None, 1, 1), ("a", None, 1)], "plane string, y int, x int").repartition(7)
    got = [tuple(r) for r in planes.mask_components(df, "plane", corners=corners).orderBy("plane", "place").collect()]
    want = [(p, y - 5, x - 70, n, h, a - 70, b - 70, k + 1) for p in sorted(masks) for k, (y, x, n, h, a, b) in enumerate(flood(masks[p], corners))]
    assert got == want


def test_union_of_many_polygons(spark):
    rng = random.Random(3)
    shapes = {i: [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.choice([1, 2, 3, 4, 7]))] for i in range(1000)}
    shapes = {i: [(cx * 0.1 + i % 90, cy * 0.1 + i % 83) for cx, cy in c] for i, c in shapes.items()}
    points = [(k, rng.uniform(-5, 110), rng.uniform(-5, 110)) for k in range(300)] + [(300, None, 1.0), (301, 1.0, None)]
    corners = spark.createDataFrame([(i, k, x, y) for i, c in shapes.items() for k, (x, y) in enumerate(c)], "p int, k int, x double, y double")
    got = {r["id"]: (r["n_polygons"], r["inside"]) for r in planes.in_polygons(spark.createDataFrame(points, "id int, x double, y double"), "id", "x", "y", planes.edges_of(corners, "p", "k", "x", "y"), 3.0).collect()}

    def holds(c, x, y):
        odd = False
        for (x0, y0), (x1, y1) in zip(c, c[1:] + c[:1]):
            if y0 != y1 and (y0 > y) != (y1 > y) and x < x0 + (y - y0) * ((x1 - x0) / (y1 - y0)):
                odd = not odd
        return odd

    want = {k: sum(len(c) > 2 and holds(c, x, y) for c in shapes.values()) if x is not None and y is not None else 0 for k, x, y in points}
    assert got == {k: (n, n > 0) for k, n in want.items()} and max(want.values()) > 1


def test_other_grids_like_interp(spark):
    rng = np.random.default_rng(4)
    samples, grid, want = [], [], {}
    for g in range(5):
        at = np.unique(rng.integers(0, 50, 12)).astype(float)
        v = [None if rng.random() < 0.3 else float(rng.normal()) for _ in at]
        samples += [(g, a, b) for a, b in zip(at.tolist(), v)]
        has = [(a, b) for a, b in zip(at, v) if b is not None]
        for p in np.arange(-5, 60, 2.5):
            grid.append((g, float(p)))
            want[g, float(p)] = float(np.interp(p, *zip(*has))) if has and has[0][0] <= p <= has[-1][0] else None
    samples += [(9, 1.0, 1.0), (9, 1.0, 3.0), (9, 2.0, 5.0)]
    grid += [(9, 1.0), (9, 1.5), (8, 1.0)]
    want |= {(9, 1.0): 2.0, (9, 1.5): 3.5, (8, 1.0): None}
    got = planes.resampled(spark.createDataFrame(samples, "g int, at double, v double"), spark.createDataFrame(grid, "g int, at double"), ["g"], "at", ["v"]).collect()
    assert len(got) == len(grid)
    for r in got:
        w = want[r["g"], r["at"]]
        assert (r["v"] is None) == (w is None) and (w is None or abs(r["v"] - w) < 1e-9), r
