"""What is written of sections and sessions comes back."""

from strataline.sources import files


def test_results_of_sections(spark, tmp_path):
    profile = spark.createDataFrame([("a", float(k), 1.0 + k, 2.0) for k in range(4)] + [("b", float(k), 0.5, 1.0) for k in range(3)], "section string, arc_um double, collagen_od_um double, muscle_od_um double")
    lesions = spark.createDataFrame([("a", 1, [1.0, 2.0])], "section string, lesion int, outline array<double>")
    none = spark.createDataFrame([], "section string, point int")
    for kind in ("csv", "parquet"):
        folder = str(tmp_path / kind)
        assert files.write_results({"profile": profile, "lesions": lesions, "points": none}, folder, kind=kind) == ["profile", "lesions"]
        back = files.read_results(spark, folder, kind)
        assert set(back) == {"profile", "lesions"}
        rows = {(r["section"], r["arc_um"]): r for r in back["profile"].collect()}
        assert len(rows) == 7 and abs(rows["a", 2.0]["collagen_to_muscle_running"] - 6 / 6) < 1e-9 and abs(rows["b", 2.0]["collagen_to_muscle_running"] - 0.5) < 1e-9
        assert back["lesions"].first()["outline"] in ("[1.0,2.0]", [1.0, 2.0])


def test_sessions(spark, tmp_path):
    tiles = spark.createDataFrame([(1, "t1", 5.0, 6.0, 0.0, 0, True, False), (0, "t0", 1.0, 2.0, 0.1, 0, True, True)], "index int, name string, x double, y double, theta double, island int, placed boolean, locked boolean")
    matches = spark.createDataFrame([(0, 1, 4.0, 4.0)], "i int, j int, dx double, dy double")
    files.write_session(tiles, matches, str(tmp_path / "s"), "mine", {"min": "0.35"})
    head, back, found = files.read_session(spark, str(tmp_path / "s"), "i int, j int, dx double, dy double")
    h = head.first()
    assert h["name"] == "mine" and h["settings"] == {"min": "0.35"} and h["saved"] is not None
    assert [(r["index"], r["name"], r["x"], r["locked"]) for r in back.orderBy("index").collect()] == [(0, "t0", 1.0, True), (1, "t1", 5.0, False)]
    assert [tuple(r) for r in found.collect()] == [(0, 1, 4.0, 4.0)]
    files.write_session(tiles, None, str(tmp_path / "n"), "none")
    assert files.read_session(spark, str(tmp_path / "n"), "i int")[2].count() == 0
