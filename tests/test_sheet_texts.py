"""Small texts that set a chart, and TIFF files of several kinds."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.operators import sheets
from strataline.sources import pixels


def test_numbers_limits_and_renames(spark):
    rows = [(0, None), (1, ""), (2, "1, 2.5;x -3e2\n.5"), (3, "0, 10"), (4, "5,"), (5, ", 7"), (6, "5"), (7, "a=b, c (d, e) = f; g=\nh = i=j, =k, l"), (8, "x=1;x=2"), (9, "1d, inf, 2")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {r["k"]: r for r in df.select("k", sheets.numbers(F.col("t")).alias("n"), sheets.limits(F.col("t")).alias("l"), sheets.renames(F.col("t")).alias("r")).collect()}
    assert [got[k]["n"] for k in (0, 1, 2, 9)] == [[], [], [1.0, 2.5, -300.0, 0.5], [2.0]]
    assert [got[k]["l"] and tuple(got[k]["l"]) for k in range(7)] == [None, None, (1.0, 2.5), (0.0, 10.0), (5.0, None), (None, 7.0), None]
    assert [tuple(p) for p in got[7]["r"]] == [("a", "b"), ("c (d, e)", "f"), ("g", ""), ("h", "i=j")] and got[0]["r"] == []
    assert df.select(sheets.renamed(F.lit("x"), F.col("t")).alias("y")).where("y = '2'").count() == 1


def tiff(values, bits, predictor=1, shades=1, samples=1, deflate=True):
    h, w = values.shape[:2]
    stored = values.copy()
    if predictor == 2:
        stored[:, 1:] = values[:, 1:] - values[:, :-1]
    raw = zlib.compress(stored.tobytes()) if deflate else stored.tobytes()
    tags = [(256, 4, w), (257, 4, h), (258, 3, bits), (259, 3, 8 if deflate else 1), (262, 3, shades), (273, 4, 0), (277, 3, samples), (279, 4, len(raw)), (317, 3, predictor)]
    at = 8 + 2 + 12 * len(tags) + 4
    body = b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", at if t == 273 else v)) for t, k, v in tags)
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + body + bytes(4) + raw


def test_differences_and_shades():
    v = np.array([[10, 20, 30, 40], [250, 5, 0, 255]], np.uint8)
    assert (pixels.read_tiff(tiff(v, 8, 2))[0][..., 0] == v).all()
    assert (pixels.read_tiff(tiff(v, 8, 2, shades=0))[0][..., 0] == 255 - v).all()
    w = v.astype(np.uint16) * 257
    assert (pixels.read_tiff(tiff(w, 16, 2))[0][..., 0] == w).all() and (pixels.read_tiff(tiff(w, 16, deflate=False))[0][..., 0] == w).all()


@pytest.mark.parametrize("bits, shades, predictor", [(12, 1, 1), (1, 1, 1), (8, 3, 1), (8, 1, 3), (8, 6, 1)])
def test_what_is_not_read_says_so(spark, tmp_path, bits, shades, predictor):
    v = np.zeros((2, 4), np.uint8)
    (tmp_path / "bad.tif").write_bytes(tiff(v, bits, predictor, shades))
    (tmp_path / "good.tif").write_bytes(tiff(v, 8))
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in pixels.read_tiffs(spark, str(tmp_path)).collect()}
    assert got["good.tif"] is None and "not read" in got["bad.tif"]
