"""Tiles and walls drawn here, whose layout and thickness are known."""

from __future__ import annotations

import numpy as np

from strataline.operators import tiles, wall


def scene(rng, h=260, w=300):
    img = np.zeros((h, w))
    for _ in range(160):
        y, x, r = rng.uniform(0, h), rng.uniform(0, w), rng.uniform(3, 12)
        yy, xx = np.ogrid[:h, :w]
        img += rng.uniform(0.2, 1) * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * r * r))
    return img


def cut(spark=None):
    rng = np.random.default_rng(3)
    img = scene(rng)
    places = [(0, 0), (110, 6), (4, 95), (118, 100)]
    return img, places, [img[y : y + 150, x : x + 170] + rng.normal(0, 0.01, (150, 170)) for x, y in places]


def test_tiles_find_their_places(spark):
    img, places, images = cut()
    layout, edges = tiles.assemble(images)
    assert set(layout["island"]) == {0} and np.abs(layout[["x", "y"]].to_numpy() - np.array(places)).max() < 1.5
    back = tiles.render(images, np.array(places, float))
    assert np.nanmax(np.abs(back - img[: back.shape[0], : back.shape[1]])) < 0.1
    moved = np.array(places, float)
    moved[2] += [14, -9]
    assert np.abs(tiles.snap(images, moved, 2) - places[2]).max() < 1.5
    same = tiles.agreement(images[0], images[1], 110, 6)
    assert same["ncc"] > 0.95 and same["iou"] > 0.8 and tiles.agreement(images[0], images[1], 500, 0)["area"] == 0
    df = spark.createDataFrame([("s", k, *i.shape, i.astype("<f4").tobytes()) for k, i in enumerate(images)] + [("one", 0, 150, 170, images[0].astype("<f4").tobytes())], "section string, tile long, height int, width int, grey binary")
    got = {(r["section"], r["tile"]): r for r in tiles.stitch(df).collect()}
    assert len(got) == 5 and abs(got["s", 3]["x"] - 118) < 1.5 and got["one", 0]["edges"] == 0


def test_islands_by_size():
    assert tiles.islands(6, [(3, 4), (4, 5), (0, 1)]).tolist() == [1, 1, 2, 0, 0, 0]


def ring(radius=90.0, thick=20.0, size=260, period=None):
    yy, xx = np.mgrid[:size, :size]
    r = np.hypot(yy - size / 2, xx - size / 2) - radius
    muscle = np.where(np.abs(r) <= thick / 2, 1.0 + (0.5 * np.cos(2 * np.pi * r / period) if period else 0.0), 0.0)
    t = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    return muscle, np.stack([size / 2 + radius * np.cos(t), size / 2 + radius * np.sin(t)], 1)


def test_a_ring_has_its_thickness_and_layers(spark):
    muscle, line = ring(period=5.0)
    got = wall.measure(muscle, 0.3 * (muscle > 0), line, 1.0, reach_um=30.0, closed=True)
    assert abs(got["media_thickness_um"].median() - 20) < 1.5 and abs(got["arc_um"].max() - 2 * np.pi * 90) < 8
    assert abs(got["lamellar_spacing_um"].median() - 5.0) < 0.6 and abs(got["collagen_od_um"].median() / 6.0 - 1) < 0.15
    df = spark.createDataFrame([("a", *muscle.shape, 1.0, True, muscle.astype("<f4").tobytes(), muscle.astype("<f4").tobytes(), line.tolist()), ("bad", 3, 3, 1.0, True, b"", b"", line.tolist())], "section string, height int, width int, px_um double, closed boolean, muscle binary, collagen binary, line array<array<double>>")
    rows = wall.analyze(df, reach_um=30.0).collect()
    assert sum(r["section"] == "a" for r in rows) == len(got) and [r["error"] is not None for r in rows if r["section"] == "bad"] == [True]


def test_geometry():
    _, line = ring()
    xy, arc = wall.resample(line, 1.0, 2.0, True)
    assert abs(abs(wall.winding(xy)) / (np.pi * 90**2) - 1) < 0.01 and np.allclose(np.diff(arc), 1.0)
    s = wall.stretch(xy, np.array([-9.0, 0.0, 9.0]), True, 5)
    assert np.allclose(np.sort(np.median(s, 0)), [0.9, 1.0, 1.1], atol=0.01)
    straight, _ = wall.resample(np.array([[0, 0], [0, 0], [50, 0.0]]), 1.0, 3.0)
    assert np.allclose(straight[:, 1], 0) and np.allclose(straight[:, 0], np.arange(50), atol=1e-6)
    depths = np.arange(-30, 31.0)
    tissue = np.where(depths[None] > 0, 1.0, 0.0) * np.ones((40, 1))
    tissue[10] = np.nan
    assert (wall.side_votes(tissue, depths, 20.0) == -1).all()
    assert wall.branch_positions(np.array([[220.0, 131.0], [5.0, 5.0]]), xy, arc, 10.0).shape == (1,)
    band = np.tile(depths, (3, 1))
    assert np.allclose(wall.to_grid(band, depths, np.array([0.0, 1, np.nan]), np.array([10.0, 5, 3]), np.array([0.0, 0.5, 1]))[:2], [[0, 5, 10], [1, 3, 5]])


def test_zones(spark):
    from strataline.operators import zones

    rng = np.random.default_rng(0)
    h, w = 120, 240
    stripes = 0.5 + 0.5 * np.sin(np.arange(w)[None] * 1.2) * np.ones((h, 1))
    left = np.arange(w)[None] < w // 2
    collagen = np.where(left, 0.8 * stripes, 0.1) + rng.uniform(0, 0.05, (h, w))
    muscle, nuclei = np.where(left, 0.2, 0.8) + rng.uniform(0, 0.3, (h, w)), np.where(left, 0.1, 0.6) * np.ones((h, 1))
    labels, names, sure = zones.detect(collagen, muscle, nuclei, np.ones((h, w), bool), 10.0)
    assert len(names) >= 2 and labels[60, 20] == 1 and labels[60, 220] == len(names) and labels[60, 20] != labels[60, 220]
    assert zones.detect(collagen, muscle, nuclei, np.zeros((h, w), bool), 10.0)[1] == []
    df = spark.createDataFrame([("a", h, w, 10.0, *[x.astype("<f4").tobytes() for x in (collagen, muscle, nuclei)])], "section string, height int, width int, px_um double, collagen binary, muscle binary, nuclei binary")
    assert sum(r["area_um2"] for r in zones.zones(df).collect()) == h * w * 100


def test_leaves_and_fractions():
    import struct

    from strataline.operators.charts import leaf_order
    from strataline.sources.chromatogram import fractions_of

    order = leaf_order(np.array([[0, 0], [10, 10], [0.1, 0], [10, 10.2], [np.nan, 5]]))
    assert abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1 and sorted(order) == [0, 1, 2, 3, 4]
    row = lambda n, a, z: struct.pack("<d", n) + bytes(4) + struct.pack("<ddd", 200.0, a, z)
    words = b"".join(w.encode("utf-16-le") + b"\x01\x02\x03" for w in ("Location", "A1", "B12", "Volume"))
    got = fractions_of(b"\x07" * 11 + row(1.0, 60e3, 120e3) + bytes(5) + row(3.0, 1e3, 2e3) + row(2.0, 120e3, 180e3) + words, 0.5)
    assert [(r["n"], r["start_min"], r["well"], r["end_ml"]) for r in got] == [(1, 1.0, "A1", 1.0), (2, 2.0, "B12", 1.5)]
