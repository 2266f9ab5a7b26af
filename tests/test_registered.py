"""Registered queries that SQL can't express, against plain versions."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.operators import raster
from strataline.plans import catalog
from tests.compare import SF


def run(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def t_tail(t, df):
    """Twice the upper tail of Student's t, by the midpoint rule over its density."""
    angle = np.linspace(np.arctan(abs(t) / np.sqrt(df)), np.pi / 2, 200_001)
    mid = (angle[1:] + angle[:-1]) / 2
    half = np.linspace(0, np.pi / 2, 200_001)
    whole = (half[1:] + half[:-1]) / 2
    return float((np.cos(mid) ** (df - 1)).sum() * (angle[1] - angle[0]) / ((np.cos(whole) ** (df - 1)).sum() * (half[1] - half[0])))


def test_welch_p(spark):
    rows = run(spark, "pairwise_welch_p")
    assert rows and all(abs(r["p"] - t_tail(r["t"], r["df"])) < 5e-5 for r in rows)


def test_compare_all(spark, duck):
    values = {}
    for g, v in duck.execute("SELECT event_type, avg(value) FROM events GROUP BY event_type, user_id").fetchall():
        values.setdefault(g, []).append(v)
    rows = {(r["a"], r["b"]): r for r in run(spark, "compare_all")}
    assert set(rows) == {(a, b) for a in values for b in values if a < b}
    for (a, b), r in rows.items():
        x, y = values[a], values[b]
        u = sum((i > j) + 0.5 * (i == j) for i in x for j in y)
        assert r["n_a"] == len(x) and r["n_b"] == len(y) and abs(r["statistic"] - u) < 1e-9 and abs(r["difference"] - (np.median(x) - np.median(y))) < 1e-5
        assert abs(r["effect"] - (2 * u / (len(x) * len(y)) - 1)) < 1e-4
        # over 8 in both groups: from the normal distribution, with ties and continuity
        n, ties = len(x) + len(y), Counter(x + y).values()
        sd = math.sqrt(len(x) * len(y) / 12 * (n + 1 - sum(t**3 - t for t in ties) / (n * (n - 1))))
        assert min(len(x), len(y)) > 8 and abs(r["p"] - math.erfc(max(0.0, abs(u - len(x) * len(y) / 2) - 0.5) / sd / math.sqrt(2))) < 2e-5


@pytest.mark.parametrize("model", ["hill", "boltzmann", "exp"])
def test_curve_fits_are_least(spark, duck, model):
    bins = duck.execute("SELECT event_type, floor(value / 25) AS bin, avg(value) AS x, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY 1, 2").fetchall()
    shape = {"hill": lambda x, a, b, c, d: a + (b - a) / (1 + (c / x) ** d), "boltzmann": lambda x, a, b, c, d: a + (b - a) / (1 + np.exp((c - x) / d)), "exp": lambda x, a, b, c: a + b * np.exp(-x / c)}[model]
    names = {"hill": ("bottom", "top", "half", "slope"), "boltzmann": ("bottom", "top", "half", "slope"), "exp": ("offset", "amplitude", "tau")}[model]
    for r in run(spark, f"curve_fit_{model}"):
        own = [(x, n) for g, _, x, n in bins if g == r["event_type"]]
        x, y = np.array([o[0] for o in own]), np.cumsum([o[1] for o in own])
        at = np.array([r[n] for n in names], float)
        with np.errstate(all="ignore"):
            sse = lambda p: float(((shape(x, *p) - y) ** 2).sum())
            r2 = 1 - sse(at) / ((y - y.mean()) ** 2).sum()
            assert r["message"] is None and r["n"] == len(x) and abs(r2 - r["r2"]) < 0.02
            rng = np.random.default_rng(0)
            nearby = min(sse(at * (1 + 0.03 * rng.standard_normal(len(at)))) for _ in range(300))
        assert sse(at) <= nearby * 1.05 + 0.5


def test_irls_positions(spark, duck):
    e = duck.execute(
        """WITH e AS (SELECT a.p_partkey AS i, b.p_partkey AS j, 1 - abs(a.p_size - b.p_size) / 50.0::DOUBLE AS ncc, 1 + ((a.p_partkey * 31 + b.p_partkey * 17) % 100) / 100.0::DOUBLE AS ratio, ((a.p_partkey + b.p_partkey) % 10) / 20.0::DOUBLE AS overlap FROM part a JOIN part b ON b.p_partkey > a.p_partkey AND b.p_partkey <= a.p_partkey + 6)
        SELECT i // 20, i, j, j - i + (i * 13 % 7 - 3) / 10.0::DOUBLE, (j * 5 % 11 - 5) / 10.0::DOUBLE, power(greatest(0, least(1, (ncc - 0.35) / 0.5)), 0.8) * (0.35 + 0.65 * greatest(0, least(1, (ratio - 1) / 0.8))) * (0.45 + 0.55 * greatest(0, least(1, overlap / 0.35))) FROM e"""
    ).fetchall()
    want = {}
    for island in {r[0] for r in e}:
        own = [r for r in e if r[0] == island]
        ids = sorted({k for r in own for k in r[1:3]})
        place = {k: n for n, k in enumerate(ids)}
        base = np.array([max(r[5], 1e-3) for r in own] + [1e3])
        a, d = np.zeros((len(own) + 1, len(ids))), np.zeros((len(own) + 1, 2))
        for n, r in enumerate(own):
            a[n, place[r[1]]], a[n, place[r[2]]], d[n] = -1, 1, r[3:5]
        a[-1, 0], w = 1, base
        for _ in range(6):
            at = np.linalg.solve((a * w[:, None] ** 2).T @ a, (a * w[:, None] ** 2).T @ d)
            away = np.linalg.norm(a[:-1] @ at - d[:-1], axis=1)
            w = base / np.append(np.sqrt(1 + (away / (2 * max(np.median(away), 1.0))) ** 2), 1.0)
        want |= {(island, k): (*at[n], np.median(away)) for k, n in place.items()}
    got = {(r["island"], r["tile"]): (r["x"], r["y"], r["residual"]) for r in run(spark, "irls_positions")}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-3) for k in want)


def test_stain_estimate(spark, duck):
    od = np.array(duck.execute("SELECT -log10(least(1, greatest(1e-4, l_quantity / 50))), -log10(least(1, greatest(1e-4, 1 - l_discount * 5))), -log10(least(1, greatest(1e-4, 1 - l_tax * 8))) FROM lineitem").fetchall())
    od = od[od.sum(1) > 0.15]
    plane = np.linalg.eigh(np.cov(od.T))[1][:, 1:]
    plane = plane * np.where(plane.sum(0) < 0, -1, 1)
    angles = np.arctan2(*(od @ plane).T[::-1])
    two = sorted((np.abs(plane @ [np.cos(t), np.sin(t)]) for t in np.percentile(angles, [1, 99])), key=lambda v: v[0])
    got = {r["stain"]: np.array([r["r"], r["g"], r["b"]]) for r in run(spark, "stain_estimate")}
    assert all(np.allclose(got[n], v / np.linalg.norm(v), atol=5e-3) for n, v in zip(("muscle", "collagen"), two))
    assert abs(np.linalg.norm(got["residual"]) - 1) < 1e-3


def test_stains_fall_back(spark):
    few = spark.createDataFrame([(0.5, 0.2, 0.1)] * 20, "r double, g double, b double")
    alike = spark.createDataFrame([(0.01 * k, 0.02 * k, 0.03 * k) for k in range(1, 900)], "r double, g double, b double")
    for df in (few, alike):
        assert np.allclose(raster.stain_vectors(df, "r", "g", "b"), raster.default_stains())
    rng = np.random.default_rng(0)
    true = np.array([[0.3, 0.75, 0.58], [0.72, 0.55, 0.18]]) / np.linalg.norm([[0.3, 0.75, 0.58], [0.72, 0.55, 0.18]], axis=1, keepdims=True)
    mixed = rng.exponential(1, (4000, 2)) ** 2 @ true
    got = raster.stain_vectors(spark.createDataFrame(mixed.tolist(), "r double, g double, b double"), "r", "g", "b")
    assert np.allclose(got[:2], true, atol=0.05)
    colours = spark.createDataFrame([(0.0,), (0.3,), (1.2,)], "d double").select(raster.density_colour(F.col("d")).alias("c"))
    assert np.allclose([r["c"] for r in colours.collect()], [1.0, 10**-0.3, 10**-1.2])


def test_stitched_tiles_are_put_back(spark):
    by = {}
    for r in run(spark, "stitched_tiles"):
        by.setdefault(r["section"], {})[r["tile"]] = (r["x"], r["y"])
    assert len(by) == 3
    for tiles in by.values():
        assert len(tiles) == 4 and all(abs(tiles[k][0] - tiles[0][0] - 36 * (k % 2)) <= 0.5 and abs(tiles[k][1] - tiles[0][1] - 36 * (k // 2)) <= 0.5 for k in range(4))


def test_cluster_choice(spark, duck):
    x = np.array([v for (v,) in duck.execute("SELECT embedding FROM embeddings WHERE embedding IS NOT NULL").fetchall()], float)
    rows = {r["k"]: r for r in run(spark, "cluster_choice")}
    n, d = x.shape
    var = ((x - x.mean(0)) ** 2).sum() / (n * d)
    assert abs(rows[1]["bic"] - (n * d * (np.log(2 * np.pi * var) + 1) + (d + 1) * np.log(n))) < 1
    assert [k for k, r in rows.items() if r["best"]] == [min(rows, key=lambda k: rows[k]["bic"])]


def test_wall_profiles(spark):
    for r in run(spark, "wall_profiles"):
        assert abs(r["length"] - 2 * np.pi * 25 * 4) < 2 and 0 < r["counted_share"] <= 1
        assert abs(r["muscle_per_length"] * r["length"] - r["muscle"]) < 0.05 * abs(r["muscle"]) + 1e-6
