"""Operators whose results SQL can't give, and edge cases of the rest."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataline.functions import dist
from strataline.functions.core import safe_div
from strataline.operators import charts, cohort, graph, naming, profile, raster, series, stats
from strataline.sources import chromatogram, files


def close(a, b, tol=1e-6):
    return abs(a - b) <= tol * max(1, abs(b))


def test_tails_against_tables():
    assert close(dist.t_sf2(2.228, 10), 0.05, 1e-4) and close(dist.t_sf2(12.706, 1), 0.05, 1e-4)
    assert close(dist.chi2_sf(3.841, 1), 0.05, 1e-3) and close(dist.chi2_sf(18.307, 10), 0.05, 1e-4) and close(dist.chi2_sf(0.5, 2), np.exp(-0.25), 1e-9)
    assert close(dist.f_sf(4.965, 1, 10), 0.05, 1e-3) and close(dist.normal_sf2(1.959964), 0.05, 1e-6)
    assert close(dist.mann_whitney_exact(0, 3, 3), 0.1) and close(dist.mann_whitney_exact(2, 4, 4), 8 / 70) and close(dist.wilcoxon_exact(0, 5), 0.0625)
    assert close(dist.ks_sf(1.36 / np.sqrt(50), 100, 100), 0.049, 0.05) and close(charts.fisher_exact(3, 1, 1, 3), 0.485714, 1e-4)


def section_rows(spark, rows):
    cols = "name string, genotype string, mouse string, segment string, wall_length_um double, media_area_um2 double, collagen_od_um2_total double, muscle_od_um2_total double"
    return spark.createDataFrame(rows, cols)


def test_pooling_is_of_sums(spark):
    rows = [("s1", "KO", "1", "arch", 4000.0, 8000.0, 400.0, 4000.0), ("s2", "KO", "1", "arch", 400.0, 800.0, 200.0, 400.0), ("s3", "", None, "arch", 100.0, 0.0, None, -1.0)]
    got = {r["mouse"]: r for r in cohort.pool(section_rows(spark, rows), ["genotype", "mouse"], listed=True).collect()}
    assert close(got["1"]["collagen_to_muscle_ratio"], 600 / 4400) and got["1"]["n_sections"] == 2 and got["1"]["sections"] == "s1, s2" and close(got["1"]["wall_length_mm"], 4.4)
    assert got["unknown"]["genotype"] == "unknown" and got["unknown"]["collagen_od_um2_total"] is None and got["unknown"]["collagen_to_muscle_ratio"] is None
    with pytest.raises(ValueError):
        cohort.check_columns(section_rows(spark, rows).drop("wall_length_um"))
    assert cohort.scheme_for("nothing known").name == "wall" and cohort.scheme_for("kidney").together == "all regions"


def test_summarise_gives_five_tables(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{i}", "KO" if m % 2 else "WT", str(m), seg, *rng.uniform(1, 9, 4).tolist()) for i, (m, seg) in enumerate((m, s) for m in range(6) for s in ("arch", "root") for _ in range(2))]
    t = cohort.summarise(section_rows(spark, rows))
    assert [t[k].count() for k in ("sections", "by_mouse_segment", "by_mouse")] == [24, 12, 6]
    assert t["by_genotype"].where("n = 3").count() == t["by_genotype"].count() == 3 * 2 * 5
    assert t["comparison"].where("p between 0 and 1").count() == 15


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 2.0), (3.0, 0.0), (3.0, -1.0), (float("inf"), 1.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [0.5, None, None, None, None, None]


def test_comparisons(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5])] + [("b", i, float(v)) for i, v in enumerate([6, 7, 8, 9, 30])] + [("c", 0, 1.0), ("d", 0, None)]
    df = spark.createDataFrame(rows, "g string, unit int, v double")
    got = {(r["a"], r["b"]): r for r in stats.compare(df, "v", "g").collect()}
    assert close(got["a", "b"]["p"], 2 / 252) and got["a", "b"]["effect"] == -1.0 and got["a", "b"]["difference"] == -5.0 and got["a", "c"]["p"] is None and got["a", "c"]["message"]
    t = stats.compare(df.where("g in ('a', 'b')"), "v", "g", test="paired", pair_on="unit").first()
    d = np.array([-5, -5, -5, -5, -25.0])
    assert close(t["statistic"], d.mean() / (d.std(ddof=1) / np.sqrt(5))) and t["df"] == 4
    assert stats.compare(df, "v", "g", how="control", control="a").where("b = 'a'").count() == 2
    for bad in ({"test": "nothing"}, {"test": "wilcoxon"}, {"unit": "missing"}):
        with pytest.raises(ValueError):
            stats.compare(df, "v", "g", **bad)


def test_factorial_against_a_balanced_table(spark):
    frame = pd.DataFrame([(a, b, v) for (a, b), vs in {("x", "p"): (1, 2, 3), ("x", "q"): (4, 5, 6), ("y", "p"): (2, 3, 4), ("y", "q"): (9, 10, 11)}.items() for v in vs], columns=["a", "b", "v"])
    got = stats.factorial_frame(frame, "v", ["a", "b"]).set_index("term")
    assert close(got.loc["a", "statistic"], 27.0) and close(got.loc["b", "statistic"], 75.0) and close(got.loc["a:b", "statistic"], 12.0)  # sums of squares 27, 75, 12 over a mean square of 1
    frame["s"] = list("mno") * 4
    assert set(stats.factorial_frame(frame, "v", ["a", "b"], subject="s").term) == {"a", "b", "a:b"}
    rank = stats.factorial_frame(frame, "v", ["a", "b"], kind="rank")
    assert (rank.p < 0.05).all()


def test_factorial_by_moments_equals_the_fit_of_all_rows(spark):
    rng = np.random.default_rng(5)
    # subjects lack cells, values stand on a large level, some have no subject, one block has no repeats and one level of b
    rows = [(k, f"a{i % 3}", int(i // 3 % 2) if k != "r" else 0, float(s if k == "p" else 100 * i + s), float(1e5 + 2 * (i % 3) + s % 5 + rng.normal())) for k in "pqr" for s in range(25) for i in rng.choice(6, 4)]
    rows += [("p", "a0", 1, None, 7.0), ("p", None, 1, 3.0, 7.0), ("p", "a1", 0, 3.0, float("nan")), ("q", "a1", 0, 3.0, None), (None, "a0", 0, 1.0, 1.0), (None, "a1", 0, 1.0, 2.0), (None, "a1", 0, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, a string, b int, s double, v double")
    for subject in (None, "s"):
        for kind in ("parametric", "rank"):
            got = stats.factorial(df, "v", ["a", "b"], subject, kind, ["k"]).toPandas()
            for k in ("p", "q", "r", None):
                frame = pd.DataFrame([r[1:] for r in rows if r[0] == k], columns=list("absv"))
                want = stats.factorial_frame(frame, "v", ["a", "b"], subject, kind).set_index("term")
                own = got[got.k.isna() if k is None else got.k == k].set_index("term").loc[want.index]
                assert list(own.note) == list(want.note)
                for c in ("statistic", "df1", "df2", "p", "partial_eta_sq"):
                    assert np.allclose(own[c].astype(float), want[c].astype(float), rtol=1e-4, atol=1e-6, equal_nan=True), (subject, kind, k, c)


def test_factorial_sends_moments_to_python(spark):
    rows = spark.range(30_000).selectExpr("id % 3 a", "id div 3 % 2 b", "id % 700 s", "sin(id) v")
    for subject in (None, "s"):
        plan = stats.factorial(rows, "v", ["a", "b"], subject)._jdf.queryExecution().analyzed().toString()
        assert "mean" in plan.split("FlatMapGroupsInPandas")[-1].splitlines()[1]  # cells, not rows


def test_nearest_on_an_axis_makes_no_pairs(spark):
    from strataline.operators import graph

    rng = np.random.default_rng(6)
    curve = [float(v) for v in rng.integers(0, 400, 300) / 4] + [None, float("nan"), float("inf"), 1000.0]
    points = [(i, float(v)) for i, v in enumerate(rng.integers(-100, 900, 400) / 8)] + [(900, None), (901, float("nan")), (902, 994.0), (903, 1006.0), (904, 995.0), (5, 40.0), (905, float("inf"))]
    df = graph.nearest(spark.createDataFrame(points, "p long, x double"), "p", "x", spark.createDataFrame([(v,) for v in curve], "c double"), "c", 5.0)
    want: dict = {}
    for p, x in points:
        for c in curve:
            if x is not None and c is not None and abs(x - c) <= 5.0:
                want[p] = min(want.get(p, (9.0, 0.0)), (abs(x - c), c))
    assert {r["point"]: (r["distance"], r["at"]) for r in df.collect()} == want and 904 in want and 902 not in want
    assert "Generate" not in df._jdf.queryExecution().analyzed().toString()  # no value in several cells


def test_despike_and_closed_profiles():
    v = np.array([1, 1, 9, 1, 1, np.nan, 1, 1.0])
    assert np.allclose(profile.despike_array(v, 3, 2.0), 1.0) and not profile.despike_array(np.full(3, np.nan), 3, 1.0).any()
    ramp = profile.despike_array(np.arange(10.0), 3, 5.0, 1.0)
    assert np.allclose(ramp[4:6], [4, 5], atol=1e-6)


def test_peaks():
    x = np.linspace(0, 10, 1001)
    y = np.exp(-((x - 3) ** 2) / 0.05) + 0.5 * np.exp(-((x - 7) ** 2) / 0.2)
    got = series.peaks_of(x, y, 0.1)
    assert [round(p[0], 2) for p in got] == [3.0, 7.0] and close(got[0][3], 2 * np.sqrt(0.05 * np.log(2)), 0.02)
    assert series.peaks_of(x, np.zeros(1001), 0.1) == [] and series.peaks_of(x[:2], y[:2], 0) == []
    assert series.nice(0.3) == 0.5 and series.nice(1.0) == 1.0 and series.nice(7.0) == 10.0


@pytest.mark.parametrize("model, p", [("hill", (1, 9, 3, 2)), ("boltzmann", (0, 5, 4, 0.7)), ("exp", (2, 6, 1.5)), ("linear", (1, 2))])
def test_curve_fits_find_their_parameters(model, p):
    x = np.linspace(0.2, 10, 40)
    got, r2 = charts.fit_curve(x, charts.MODELS[model][0](x, np.array(p, float)), model)
    assert r2 > 0.999999 and np.allclose(got, p, rtol=1e-3, atol=1e-3)
    with pytest.raises(ValueError):
        charts.fit_curve(x[:2], x[:2], model)


def test_names(spark):
    names = ["4_1749_L8D-E-KO, 32W_aortic arch_slide 9_sec2", "mild fibrosis_all regions_p12_WT_8w_descending thoracic aorta_extra", "", None, "just words about a carotid"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    r = {x["i"]: x for x in naming.parse_section_names(df, "name").collect()}
    assert (r[0]["mouse"], r[0]["genotype"], r[0]["age"], r[0]["segment"], r[0]["slide"], r[0]["section"], r[0]["unparsed"], r[0]["missing"]) == ("1749", "L8D-E-KO", "32W", "aortic arch", "9", "2", "4", [])
    assert (r[1]["grade"], r[1]["slide"], r[1]["genotype"], r[1]["age"], r[1]["segment"], r[1]["unparsed"]) == ("mild", "p12", "WT", "8W", "descending thoracic", "extra")
    assert r[2]["missing"] == r[3]["missing"] == ["mouse", "genotype", "segment"] and r[4]["segment"] == "carotid artery"
    wells = spark.createDataFrame([(w,) for w in ("B1", "b01", "B-1", "r02c01", "H12", "P24", "Q1", "A25", "A0", "WT1", " c3 ")], "w string")
    assert [x[0] for x in wells.select(naming.canon_well(F.col("w"))).collect()] == ["B01"] * 4 + ["H12", "P24", None, None, None, None, "C03"]
    split = spark.createDataFrame([("20260815_1_Y715C_0.czi",), ("/x/r02c01f03p01-ch2sk1fk1fl1.tiff",), ("P716L 34.czi",), ("Y715C10.tif",)], "n string")
    got = [x[0] for x in split.select(naming.split_name(F.col("n"), also_whitespace=True, trailing_digits=True)).collect()]
    assert got == [["20260815", "1", "Y715C", "0"], ["B01", "f03", "p01", "ch2", "sk1", "fk1", "fl1"], ["P716L", "34"], ["Y715C", "10"]]
    assert naming.delimiters("_ OR __,-") == ["__", "_", "-"] and len(naming.segment_names()) == 13


def test_placing_tiles():
    rng = np.random.default_rng(0)
    true = rng.uniform(0, 500, (12, 2))
    true -= true[0]
    i, j = np.array([(a, b) for a in range(12) for b in range(a + 1, 12) if (a + b) % 3]).T
    dx, dy = (true[j] - true[i]).T + rng.normal(0, 0.1, (2, len(i)))
    dx[3] += 400  # one wrong edge
    at, _ = graph.place(12, i, j, dx, dy, np.full(len(i), 0.5))
    assert np.abs(at - true).max() < 1.0


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 21)], "i long, j long")
    assert {r["id"]: r["component"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}


def test_kernels():
    rng = np.random.default_rng(1)
    mask = rng.random((40, 57)) > 0.45
    lab, n = raster.label(mask)
    seen = np.zeros_like(lab)
    k = 0
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            k += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 40 and 0 <= b < 57 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = k
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert n == k and len(set(zip(lab[mask], seen[mask]))) == k
    d = raster.distance(mask)
    off = np.argwhere(~mask)
    assert np.allclose(d, [[np.sqrt(((off - (y, x)) ** 2).sum(1)).min() for x in range(57)] for y in range(40)])
    grown = raster.square_morph(mask, 3, "dilate")
    assert all(grown[y, x] == mask[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any() for y in range(40) for x in range(57))
    hole = np.ones((9, 9), bool)
    hole[4, 4] = hole[0, 0] = False
    assert raster.fill_holes(hole).sum() == 80 and raster.drop_small(np.eye(3, dtype=bool), 2).sum() == 0
    img = rng.random((30, 30))
    assert close(raster.gaussian(np.ones((20, 20)), 2.0).mean(), 1.0) and np.allclose(raster.resize(img, 0.5), img.reshape(15, 2, 15, 2).mean((1, 3)))
    assert np.allclose(raster.bilinear(img, np.array([3.0, 2.5, -1]), np.array([4.0, 7.0, 0])), [img[3, 4], (img[2, 7] + img[3, 7]) / 2, np.nan], equal_nan=True)
    big = rng.random((60, 60))
    ncc, _ = raster.masked_ncc(big[:40, :40], np.ones((40, 40), bool), big[7:47, 12:52], np.ones((40, 40), bool))
    assert raster.best_shift(ncc)[:2] == (7, 12) and ncc.max() > 0.999
    share = np.zeros((200, 200))
    share[50:90, 60:100] = 1.0
    found = raster.lesions(share, np.ones((200, 200), bool), 4.0)
    assert len(found) == 1 and abs(found[0]["y_um"] - 278) < 8


def channel(values, version=b"130"):
    raw = bytearray(chromatogram.DATA)
    raw[0 : 1 + len(version)] = bytes([len(version)]) + version
    for name, at in chromatogram.LABELS.items():
        text = {"moment": "5-Mar-24, 10:20:30"}.get(name, name).encode("utf-16-le")
        raw[at : at + 1 + len(text)] = bytes([len(text) // 2]) + text
    struct.pack_into(">ii", raw, chromatogram.FIRST_MS, 0, 60_000 * (len(values) - 1))
    struct.pack_into(">d", raw, chromatogram.SCALE, 0.5)
    body, last = b"", 0
    for k in range(0, len(values), 100):
        part = values[k : k + 100]
        body += bytes([0x10, len(part)])
        for v in part:
            d = v - last
            body += struct.pack(">h", d) if -0x7FFF <= d <= 0x7FFF else struct.pack(">hiH", -0x8000, v >> 16, v & 0xFFFF)
            last = v
    return bytes(raw) + body


def test_chromatograms(spark, tmp_path):
    values = [0, 5, -7, 100_000, 99_990, -3_000_000] + list(range(250))
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "a.ch").write_bytes(channel(values))
    (tmp_path / "run1" / "b.ch").write_bytes(b"\x03179" + bytes(9000))
    got = chromatogram.read_channels(spark, str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in got.collect()}
    assert rows["a.ch"]["y"] == [v * 0.5 for v in values] and rows["a.ch"]["x"][-1] == len(values) - 1 and str(rows["a.ch"]["measured"]).startswith("2024-03-05 10:20:30")
    assert rows["b.ch"]["error"] and rows["b.ch"]["y"] is None
    assert chromatogram.points(got).count() == len(values) and chromatogram.wide_export(got).columns == ["i", "a.ch x", "a.ch y"] and chromatogram.in_sequence(got).first()["position"] == 1


def test_files(spark, tmp_path):
    (tmp_path / "t" / "m1").mkdir(parents=True)
    for n in ("tile10.tif", "tile2.tif", ".hidden.tif", "notes.txt"):
        (tmp_path / "t" / "m1" / n).write_bytes(b"x")
    listed = files.list_files(spark, str(tmp_path / "t"), recursive=True).orderBy("sort_key")
    assert [r["name"] for r in listed.collect()] == ["tile2.tif", "tile10.tif"] and files.scan_tray(spark, str(tmp_path / "t")).first()["images"] == 2
    (tmp_path / "o.csv").write_text("folder,mouse,age\na,1,\nb,,8W\na,2, \n")
    o = files.read_overrides(spark, str(tmp_path / "o.csv"))
    assert {r["key"]: (r["mouse"], r["age"]) for r in o.collect()} == {"a": ("2", None), "b": (None, "8W")}
    up = spark.createDataFrame([("a", "", "KO"), ("c", "7", None)], "key string, mouse string, genotype string")
    assert {r["key"]: (r["mouse"], r["age"], r["genotype"]) for r in files.merge_overrides(o, up).collect()} == {"a": (None, None, "KO"), "b": (None, "8W", None), "c": ("7", None, None)}
    tiles = spark.createDataFrame([(0, "a", "p/a", 5, 6, 0.5, 1.0, 2.0, 0.0, 0, True, False), (1, "b", "p/b", 5, 6, 0.5, 3.0, 4.0, 0.1, 0, True, True)], "index int, name string, path string, height int, width int, px_um double, x double, y double, theta double, island int, placed boolean, locked boolean")
    files.write_layout(tiles, str(tmp_path / "layout"))
    back = files.read_layout(spark, str(tmp_path / "layout"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tiles.collect()))
    moved = files.restore_poses(tiles.withColumn("x", F.lit(9.0)), back.where("name = 'b'"))
    assert {r["name"]: (r["x"], r["restored"]) for r in moved.collect()} == {"a": (9.0, False), "b": (3.0, True)}
    files.write_tables({"one": tiles}, str(tmp_path / "out"))
    assert set(files.read_tables(spark, str(tmp_path / "out"), ["one", "two"])) == {"one"}


def test_streams(spark, tmp_path):
    from strataline.streaming import pooling

    spark.createDataFrame([("KO", 1.0, 2.0), ("", 4.0, 0.0)], "g string, a double, b double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, a double, b double").parquet(str(tmp_path / "in"))
    q = pooling.running_pool(stream, ["g"], ["a", "b"], {"ratio": ("a", "b")}).writeStream.outputMode("complete").format("memory").queryName("pooled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["g"]: r["ratio"] for r in spark.table("pooled").collect()} == {"KO": 0.5, "unknown": None}
