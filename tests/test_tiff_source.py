"""The data source of TIFF pixels against whole reads."""

import struct
import zlib

import numpy as np
import pytest

from strataline.sources import pixels, tiff


def picture(values, order="<", deflate=False, tile=None, rows=None, differences=False, planar=False, inverted=False, photometric=1, lose=None):
    """A TIFF file of (height, width, samples) by strips of so many rows, or by tiles (height, width)."""
    h, w, n = values.shape
    high, wide = tile or (rows or h, w)
    blocks = []
    for plane in range(n) if planar else [slice(None)]:
        for y in range(0, h, high):
            for x in range(0, w, wide):
                part = np.atleast_3d(values[y : y + high, x : x + wide, plane])
                if tile:
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if differences:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                raw = part.astype(values.dtype.newbyteorder(order)).tobytes()
                blocks.append(zlib.compress(raw) if deflate else raw)
    if lose is not None:
        blocks[lose] = blocks[lose][: len(blocks[lose]) // 2]
    body, places = b"", []
    for b in blocks:
        places.append(8 + len(body))
        body += b
    put = {256: [w], 257: [h], 258: [8 * values.dtype.itemsize] * n, 259: [8 if deflate else 1], 262: [0 if inverted else photometric], 277: [n], 284: [2 if planar else 1], 317: [2 if differences else 1], 339: [{"u": 1, "i": 2, "f": 3}[values.dtype.kind]]}
    put |= {322: [wide], 323: [high], 324: places, 325: [*map(len, blocks)]} if tile else {273: places, 278: [high], 279: [*map(len, blocks)]}
    entries = b""
    for tag in sorted(put):
        v = put[tag]
        data = struct.pack(f"{order}{len(v)}I", *v)
        if len(v) > 1:
            data, body = struct.pack(f"{order}I", 8 + len(body)), body + data
        entries += struct.pack(f"{order}HHI", tag, 4, len(v)) + data
    return struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 8 + len(body)) + body + struct.pack(f"{order}H", len(put)) + entries + b"\0" * 4


@pytest.fixture(scope="module")
def source(spark):
    tiff.register(spark)
    return lambda path, size=4000: spark.read.format("tiff_pixels").option("maxPartitionBytes", size).load(str(path))


def grid(df, h, w):
    out = np.full((h, w, 3), np.nan)
    rows = df.collect()
    for r in rows:
        assert np.isnan(out[r["y"], r["x"], 0])
        out[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    assert len(rows) == h * w
    return out


def test_pixels_equal_a_whole_read_over_many_splits(source, tmp_path):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 250, (70, 90, 3)).astype("u1")
    b = rng.integers(0, 9000, (33, 50, 1)).astype("u2")
    c = rng.random((20, 31, 4)).astype("f4")
    made = {
        "strips": picture(a, rows=7), "packed": picture(a, rows=8, deflate=True, differences=True, order=">"), "tiles": picture(a, tile=(16, 32)), "planes": picture(a, rows=9, planar=True),
        "packed_tiles": picture(a, tile=(32, 16), deflate=True, differences=True), "grey": picture(b, rows=5, inverted=True), "four": picture(c, rows=6, order=">"),
    }
    for name, raw in made.items():
        (tmp_path / f"{name}.tif").write_bytes(raw)
        df = source(tmp_path / f"{name}.tif")
        assert df.rdd.getNumPartitions() > 1 or name in ("packed", "grey", "packed_tiles")
        whole = {"grey": 65535 - b, "four": c}.get(name, a)
        assert np.array_equal(grid(df, *whole.shape[:2]), (whole if whole.shape[2] > 2 else whole.repeat(3, 2))[..., :3].astype(float)), name
        if "tiles" not in name:
            assert np.array_equal(pixels.read_tiff(raw)[0], whole)
        assert np.allclose(grid(tiff.shares(df), *whole.shape[:2]), pixels.as_rgb(pixels.scaled(whole.repeat(3, 2) if whole.shape[2] == 1 else whole)), atol=1e-6), name
    every = source(tmp_path, 1 << 20)
    assert every.count() == 5 * 70 * 90 + 33 * 50 + 20 * 31 and every.rdd.getNumPartitions() == len(made)


def test_broken_files_and_strips_are_rows_with_errors(spark, source, tmp_path):
    a = np.arange(60, dtype="u1").reshape(10, 6, 1)
    (tmp_path / "a.tif").write_bytes(picture(a, rows=2, deflate=True, lose=2))
    (tmp_path / "b.tiff").write_bytes(b"nothing")
    (tmp_path / "c.tif").write_bytes(b"")
    (tmp_path / "d.tif").write_bytes(picture(a, rows=3, photometric=3))
    (tmp_path / "e.txt").write_bytes(b"no picture")
    found = source(tmp_path, 20).collect()
    bad = {(r["path"].rpartition("/")[2], r["y"]) for r in found if r["error"]}
    assert bad == {("a.tif", 4), ("b.tiff", None), ("c.tif", None), ("d.tif", None)}
    assert sorted((r["y"], r["x"], r["r"]) for r in found if not r["error"]) == [(y, x, float(a[y, x, 0])) for y in range(10) for x in range(6) if y not in (4, 5)]
    (tmp_path / "none").mkdir()
    assert source(tmp_path / "none").count() == 0
    assert source(f"file://{tmp_path}/d.tif").count() == 1
