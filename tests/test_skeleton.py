"""Paths on skeletons against plain walks."""

import heapq
import math
import random

from strataline.operators import skeleton
from strataline.plans import skeleton_queries
from tests.compare import SF

PIXELS = "graph long, row long, col long"


def near(edges):
    """{graph: {u: {v: w}}} of edge rows."""
    out = {}
    for g, u, v, w in edges:
        out.setdefault(g, {}).setdefault(u, {})[v] = w
    return out


def pixel_graph(pixels):
    out = {}
    for g, r, c in pixels:
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                if (a or b) and (g, r + a, c + b) in pixels:
                    out.setdefault(g, {}).setdefault(r * skeleton.ROW + c, {})[(r + a) * skeleton.ROW + c + b] = math.hypot(a, b)
    return out


def dijkstra(n, start):
    dist, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if d == dist[u]:
            for v, w in n[u].items():
                if d + w < dist.get(v, math.inf):
                    dist[v] = d + w
                    heapq.heappush(heap, (d + w, v))
    return dist


def without_spurs(n, least, keep=8):
    while True:
        gone = set()
        for e in [u for u in n if len(n[u]) == 1]:
            path, last = [e], None
            while len(path) <= least and len(on := [v for v in n[path[-1]] if v != last]) == 1:
                last = path[-1]
                path.append(on[0])
            if len(path) <= least and len(n[path[-1]]) > 2:
                gone.update(path[:-1])
        if not gone or len(n) - len(gone) < keep:
            return n
        n = {u: {v: w for v, w in vs.items() if v not in gone} for u, vs in n.items() if u not in gone}


def length(n):
    """Of the path from the first end to the farthest node and from there to the farthest again."""
    first = min(n, key=lambda u: (len(n[u]) != 1, u))
    far = lambda d: min(d, key=lambda u: (-round(d[u], 9), u))
    start = far(dijkstra(n, first))
    d = dijkstra(n, start)
    return start, far(d), d


def drawn():
    """Walks with spurs, a ring without any junction, a chain, and scattered pixels with many junctions."""
    rng, px = random.Random(11), set()
    for g in range(3):
        r = 40
        for c in range(70):
            r += rng.choice((-1, 0, 1))
            px.add((g, r, c))
            if c % 17 == 0:
                px |= {(g, r + k, c) for k in range(1, rng.randrange(2, 12))}
    px |= {(3, *p) for k in range(20) for p in ((0, k), (20, k + 1), (k + 1, 0), (k, 20))} - {(3, 0, 0), (3, 20, 20), (3, 0, 20), (3, 20, 0)}
    px |= {(4, k, k) for k in range(90)} | {(5, r, c) for r in range(14) for c in range(14) if rng.random() < 0.42} | {(6, 5, 5)}
    return px


def test_pixels_distances_branches_and_paths(spark):
    px = drawn()
    n = pixel_graph(px)
    df = spark.createDataFrame([*px, *list(px)[:50], (None, 1, 1), (1, None, 1)], PIXELS).repartition(7)
    edges = skeleton.pixel_edges(df)
    assert near(tuple(r) for r in edges.collect()) == n
    starts = {g: min(v) for g, v in n.items()}
    got = skeleton.distances(edges, spark.createDataFrame([*starts.items(), (9, 9)], "graph long, node long")).collect()
    want = {(g, u): d for g in n for u, d in dijkstra(n[g], starts[g]).items()}
    assert {(r["graph"], r["node"]) for r in got} == set(want)
    for r in got:
        assert abs(r["distance"] - want[r["graph"], r["node"]]) < 1e-9
        assert (r["prev"] is None) == (r["node"] == starts[r["graph"]])
        assert r["prev"] is None or abs(want[r["graph"], r["prev"]] + n[r["graph"]][r["node"]][r["prev"]] - r["distance"]) < 1e-9
    cut = {g: without_spurs(v, 6) for g, v in n.items()}
    assert sum(map(len, cut.values())) < sum(map(len, n.values())) and cut[3] == n[3] and cut[4] == n[4]
    kept = skeleton.pruned(edges, 6)
    assert near(tuple(r) for r in kept.collect()) == {g: {u: vs for u, vs in v.items() if vs} for g, v in cut.items()}
    check_paths(skeleton.longest_paths(kept).collect(), cut)


def check_paths(rows, n):
    paths = {}
    for r in sorted(rows, key=lambda r: (r["graph"], r["place"])):
        paths.setdefault(r["graph"], []).append(r)
    assert set(paths) == set(n)
    for g, path in paths.items():
        start, goal, d = length(n[g])
        assert [r["place"] for r in path] == [*range(len(path))] and (path[0]["node"], path[-1]["node"]) == (start, goal)
        assert all(abs(a["distance"] + n[g][a["node"]][b["node"]] - b["distance"]) < 1e-9 for a, b in zip(path, path[1:]))
        assert abs(path[-1]["distance"] - d[goal]) < 1e-9


def test_registered_paths(spark):
    n = near(tuple(r) for r in skeleton_queries._edges(spark, SF).collect())
    check_paths(skeleton_queries.skeleton_paths(spark, SF).collect(), {g: without_spurs(v, 5) for g, v in n.items()})


def test_no_pixels(spark):
    edges = skeleton.pixel_edges(spark.createDataFrame([], PIXELS))
    assert skeleton.longest_paths(skeleton.pruned(edges, 5)).count() == 0
    assert skeleton.distances(edges, spark.createDataFrame([], "graph long, node long")).count() == 0


def test_distances_take_a_round_a_block_and_not_a_junction(spark, monkeypatch):
    # a comb: every node has a side branch, so all are junctions; numbers cross blocks and are beyond 2^53
    base = (1 << 60) + 4096 - 30
    ways = [(base + i, base + i + 1, 1.0 + i % 3) for i in range(60)] + [(base + i, base + 5000 + i, 0.5) for i in range(60)] + [(base + 5, base + 40, 20.0)]
    rounds = []
    monkeypatch.setattr(skeleton, "saved", lambda df, name, made=skeleton.saved: rounds.append(name) or made(df, name))
    edges = skeleton.both_ways(spark.createDataFrame([("g", *w) for w in ways], "graph string, u long, v long, w double"))
    got = {r["node"]: r["distance"] for r in skeleton.distances(edges, spark.createDataFrame([("g", base)], "graph string, node long")).collect()}
    ahead, want, heap = {}, {}, [(0.0, base)]
    for u, v, w in ways:
        ahead.setdefault(u, []).append((v, w))
        ahead.setdefault(v, []).append((u, w))
    while heap:
        d, u = heapq.heappop(heap)
        if u not in want:
            want[u] = d
            for v, w in ahead[u]:
                heapq.heappush(heap, (d + w, v))
    assert got == want
    assert rounds.count("distances") <= 8
