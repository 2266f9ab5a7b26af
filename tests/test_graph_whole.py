"""Graph operators on inputs that earlier limits cut."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from strataline.functions import components
from strataline.operators import graph
from strataline.plans import chart_queries
from tests.compare import SF
from tests.llm import brute


def test_components_of_a_long_shuffled_path(spark):
    ids = list(range(1000))
    random.Random(1).shuffle(ids)
    pairs = [*zip(ids, ids[1:]), (2000, 2001), (2001, 2002), (3000, 3000), (4000, None)]
    e = spark.createDataFrame(pairs, "i long, j long").repartition(4)
    got = {r["id"]: r["component"] for r in graph.components(e).collect()}
    assert got == {**dict.fromkeys(ids, 0), **dict.fromkeys((2000, 2001, 2002), 2000), 3000: 3000, 4000: 4000}


@pytest.mark.parametrize("most", [7, 60, 1000])
def test_components_whatever_a_task_settles(spark, monkeypatch, most):
    """Rounds for all edges, for the first of them, and none: a path, a tree, cycles, a star and single pairs, their numbers shuffled."""
    monkeypatch.setattr(components, "TASK_EDGES", most)
    rng = random.Random(most)
    ids = rng.sample(range(-(10**12), 10**12), 400)
    pairs = [(i, i + 1) for i in range(120)] + [(200, 201 + i) for i in range(40)] + [(i, (i - 241) // 2 + 241) for i in range(243, 300)]
    pairs += [(300 + i, 300 + (i + 1) % 9) for i in range(9)] * 2 + [(320 + 2 * i, 321 + 2 * i) for i in range(30)]
    rng.shuffle(pairs)
    root = brute.groups(400, pairs)
    met = {i for p in pairs for i in p}
    want = {ids[i]: min(ids[k] for k in met if root[k] == root[i]) for i in met}
    df = spark.createDataFrame([(ids[a], ids[b]) for a, b in pairs], "u long, v long").repartition(5)
    got = components.components(df).collect()
    assert len(got) == len(want) and {r["id"]: r["root"] for r in got} == want


def test_components_of_few_edges_take_few_tasks(spark):
    """Each round had six shuffles, with as many tasks as the session has partitions: a path of 200 took thousands."""
    put = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in put}
    sc = spark.sparkContext
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few edges", "")
        assert components.components(spark.range(200).selectExpr("id u", "id + 1 v").repartition(4)).count() == 201
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("few edges")]
        stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in j.stageIds]
        assert sum(s.numCompletedTasks for s in stages if s) < 200
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def positions(edges):
    """Positions by weighted normal equations, the first tile at 0. edges: (i, j, dx, dy, quality)."""
    ids = sorted({k for e in edges for k in e[:2]})
    at, w = None, [max(e[4], 1e-3) for e in edges]
    for _ in range(6):
        m, d = np.zeros((len(ids), len(ids))), np.zeros((len(ids), 2))
        for (i, j, dx, dy, _), x in zip(edges, w):
            a, b = ids.index(i), ids.index(j)
            m[a, a] += x * x
            m[b, b] += x * x
            m[a, b] -= x * x
            m[b, a] -= x * x
            d[b] += x * x * np.array([dx, dy])
            d[a] -= x * x * np.array([dx, dy])
        at = np.zeros((len(ids), 2))
        at[1:] = np.linalg.solve(m[1:, 1:], d[1:])
        r = [float(np.hypot(*(at[ids.index(j)] - at[ids.index(i)] - (dx, dy)))) for i, j, dx, dy, _ in edges]
        s = max(float(np.median(r)), 1.0)
        w = [max(e[4], 1e-3) / (1 + (x / (2 * s)) ** 2) ** 0.5 for e, x in zip(edges, r)]
    return {k: (*at[n], float(np.median(r))) for n, k in enumerate(ids)}


def test_positions_of_all_parts(spark):
    islands = defaultdict(list)
    for r in chart_queries._edges(spark, SF).select("i", "j", "quality").collect():
        i, j = r["i"], r["j"]
        islands[i // 20].append((i, j, j - i + (i * 13 % 7 - 3) / 10, (j * 5 % 11 - 5) / 10, r["quality"]))
    want = {(k, t): v for k, e in islands.items() for t, v in positions(e).items()}
    got = {(r["island"], r["tile"]): (r["x"], r["y"], r["residual"]) for r in chart_queries.irls_positions(spark, SF).collect()}
    parts = {r["p_partkey"] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    assert {t for _, t in got} == parts and got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(got[k], v, rtol=0, atol=2e-3), k
