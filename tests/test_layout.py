"""Layouts as tables against plain versions."""

import math
import random

from strataline.operators import layout

JOIN = "i long, j long, quality double, dx double, dy double"


def find(root, v):
    while root[v] != v:
        v = root[v]
    return v


def kruskal(joins):
    """Forest, and places summed along it, of (i, j, quality, dx, dy) with i < j, each once."""
    root, kept = {v: v for e in joins for v in e[:2]}, []
    for e in sorted(joins, key=lambda e: (-e[2], e[0], e[1])):
        a, b = find(root, e[0]), find(root, e[1])
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(e)
    near = {v: [] for v in root}
    for i, j, _, dx, dy in kept:
        near[i].append((j, dx, dy))
        near[j].append((i, -dx, -dy))
    at = {}
    for v in sorted(root):
        todo = [] if v in at else [(v, v, 0.0, 0.0)]
        while todo:
            t, island, x, y = todo.pop()
            if t not in at:
                at[t] = (island, x, y)
                todo += [(w, island, x + dx, y + dy) for w, dx, dy in near[t] if w not in at]
    return {(e[0], e[1], e[2]) for e in kept}, at


def places(df):
    return {r["tile"]: (r["island"], r["x"], r["y"]) for r in df.collect()}


def test_forest_and_places_equal_kruskal(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(k, k + 30), 2))) for k in (0, 30, 60) for _ in range(90)} | {(i, i + 1) for i in range(200, 260)}  # with a chain
    joins = [(i, j, float(rng.randrange(8)), float(rng.randrange(-50, 50)), float(rng.randrange(-50, 50))) for i, j in sorted(pairs)]  # ties, and shifts that contradict each other
    turned = [(j, i, q, -dx, -dy) if rng.random() < 0.5 else (i, j, q, dx, dy) for i, j, q, dx, dy in joins]
    worse = [(i, j, q - 1, 7.0, 7.0) for i, j, q, _, _ in joins[:40]]
    nothing = [(5, 5, 9.0, 1.0, 1.0), (None, 3, 9.0, 1.0, 1.0), (3, 800, None, 1.0, 1.0), (3, 801, 9.0, None, 1.0)]
    df = spark.createDataFrame(turned + worse + nothing, JOIN)
    forest, at = layout.best_forest(df)
    want, where = kruskal(joins)
    assert sorted(tuple(r) for r in forest.collect()) == sorted(want)
    assert places(at) == where
    off = {(r["i"], r["j"]) for r in layout.disagreements(spark.createDataFrame(joins, JOIN), at, 0.5).collect()}
    assert off == {(i, j) for i, j, _, dx, dy in joins if math.hypot(where[j][1] - where[i][1] - dx, where[j][2] - where[i][2] - dy) > 0.5} and off
    none, nowhere = layout.best_forest(spark.createDataFrame(nothing, JOIN))
    assert none.count() == 0 and nowhere.count() == 0


def test_planted_islands_merge_and_a_conflicting_one_stays(spark):
    rng = random.Random(6)
    true = {k: (float(k % 10 * 100), float(k // 10 * 80)) for k in range(50)}
    frames = {k: k // 10 * 10 for k in true}  # five islands of a row each, all in frames of their own
    at = [(k, frames[k], true[k][0] - true[frames[k]][0], true[k][1] - true[frames[k]][1]) for k in true]
    step = lambda i, j, off=0.0: (i, j, rng.random(), true[j][0] - true[i][0] + rng.uniform(-1, 1) + off, true[j][1] - true[i][1] + rng.uniform(-1, 1))
    joins = [step(k, k + 10) for k in (0, 3, 7, 10, 12, 15, 19)] + [step(21, 11), step(25, 35, 60.0), step(26, 36), step(28, 38, 300.0)]  # 2-3: three opinions
    joins += [step(40, 30)]  # one vote only
    df = spark.createDataFrame(joins + [(3, 13, None, 1.0, 1.0), (900, 3, 1.0, 1.0, 1.0)], JOIN)
    found = places(layout.merge_islands(spark.createDataFrame(at, "tile long, island long, x double, y double"), df, 5.0))
    assert {k: v[0] for k, v in found.items()} == {k: 0 if k < 30 else frames[k] for k in true}
    assert all(abs(found[k][1] - true[k][0]) < 3 and abs(found[k][2] - true[k][1]) < 3 for k in range(30))
    one = places(layout.merge_islands(spark.createDataFrame(at, "tile long, island long, x double, y double"), df, 5.0, least=1))
    assert one[40][0] == 30 and one[30][0] == 30 and one[0][0] == 0
    # what may disagree is a parameter
    some = places(layout.merge_islands(spark.createDataFrame(at, "tile long, island long, x double, y double"), df, 5.0, least=1, conflicts=0.7))
    assert {v[0] for v in some.values()} == {0}


def test_slivers_are_found_and_small_islands_left(spark):
    at = [(k, 0 if k < 9 else 9, 0.0, 0.0) for k in range(13)] + [(50, 50, 0.0, 0.0)]
    shared = [(k, k + 1, 100.0) for k in range(12) if k != 8] + [(0, 2, 100.0), (5, 7, 90.0)]
    shared = [(i, j, 10.0 if (i, j) in ((4, 5), (10, 11)) else s) for i, j, s in shared]
    groups, cuts = layout.sliver_groups(spark.createDataFrame(at, "tile long, island long, x double, y double"), spark.createDataFrame(shared, "i long, j long, shared double"))
    assert {r["tile"]: (r["part"], r["size"], r["main"]) for r in groups.collect()} == {k: (0, 5, True) if k < 5 else (5, 4, False) for k in range(9)}
    assert [(r["i"], r["j"], r["part_i"], r["part_j"], round(r["ratio"], 3)) for r in cuts.collect()] == [(4, 5, 0, 5, 0.1)]


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(8)
    curve = [(k, rng.gauss(0, 40), rng.gauss(0, 40)) for k in range(500)] + [(1000 + k, 3.0, 4.0) for k in range(5)]  # crowded, with ties
    points = [(k, rng.uniform(-200, 200), rng.uniform(-200, 200)) for k in range(300)] + [(700, 3.0, 4.0), (701, 3.0, 5e5), (702, None, 1.0), (703, float("nan"), 1.0)]
    got = layout.nearest_in_plane(spark.createDataFrame(points, "point long, x double, y double"), spark.createDataFrame([*curve, (2000, None, 0.0)], "arc long, x double, y double"), 50.0)
    want = {}
    for p, x, y in points:
        if x is not None and x == x:
            d, arc = min((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), k) for k, a, b in curve)
            if d <= 50.0:
                want[p] = (arc, d)
    assert {r["point"]: (r["arc"], r["distance"]) for r in got.collect()} == want and 700 in want and 20 < len(want) < 300


def test_nearest_in_plane_takes_smaller_cells_where_places_are_many(spark, monkeypatch):
    made = []
    monkeypatch.setattr(layout, "saved", lambda df, name, real=layout.saved: made.append(real(df, name)) or made[-1])
    rng = random.Random(9)
    curve = [(k, rng.uniform(0, 10), rng.uniform(0, 10)) for k in range(6000)] * 2  # 6000 places within one first cell
    points = [(k, rng.uniform(0, 10), rng.uniform(0, 10)) for k in range(40)]
    got = layout.nearest_in_plane(spark.createDataFrame(points, "point long, x double, y double"), spark.createDataFrame(curve, "arc long, x double, y double"), 1000.0)
    want = {p: min((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), k) for k, a, b in curve) for p, x, y in points}
    assert {r["point"]: (r["distance"], r["arc"]) for r in got.collect()} == want
    assert made[1].count() == 6000 and len([m for m in made if "distance" in m.columns]) > 10


def all_pairs(points, curve, most):
    made = {p: min((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), k) for k, a, b in curve) for p, x, y in points}
    return {p: m for p, m in made.items() if m[0] <= most}


def test_points_far_from_crowded_places_see_their_rim(spark, monkeypatch):
    """Pairs are neither sorted nor as many as the places of a crowd; with and without slices."""
    given, made = [], []
    monkeypatch.setattr(layout, "saved", lambda df, name, real=layout.saved: given.append((name, df)) or made.append((name, real(df, name))) or made[-1][1])
    rng = random.Random(10)
    curve = [(k, rng.uniform(0, 20), rng.choice((0, 30)) + rng.uniform(0, 10)) for k in range(8000)] + [(9000, 60.0, 10.0), (9001, 70.0, 0.0)]
    points = [(k, rng.uniform(-60, 80), rng.uniform(-60, 80)) for k in range(400)] + [(500, 60.0, 0.0)]  # the last one has two at 10
    want = all_pairs(points, curve, 64.0)
    for rows in (layout.SLICE_ROWS, 3000):
        monkeypatch.setattr(layout, "SLICE_ROWS", rows)
        got = layout.nearest_in_plane(spark.createDataFrame(points, "point long, x double, y double"), spark.createDataFrame(curve, "arc long, x double, y double"), 64.0)
        assert {r["point"]: (r["distance"], r["arc"]) for r in got.collect()} == want and want[500] == (10.0, 9000) and len(want) < 401
    assert not [df for name, df in given if "SortAggregate" in df._jdf.queryExecution().executedPlan().toString()]
    assert 0 < min(df.count() for name, df in made if name == "rim") < 4000


def test_a_place_just_within_reach_is_found(spark):
    """The distance rounds to the most there may be, two cells off."""
    points, curve = [(1, -1e-20, 0.0), (2, 1e5, 3.0), (3, float("inf"), 0.0)], [(7, 60.0, 0.0), (8, 1e5 + 60, 3.0), (9, float("inf"), 0.0)]
    got = layout.nearest_in_plane(spark.createDataFrame(points, "point long, x double, y double"), spark.createDataFrame(curve, "arc long, x double, y double"), 60.0)
    assert {(r["point"], r["arc"], r["distance"]) for r in got.collect()} == {(1, 7, 60.0), (2, 8, 60.0)}
