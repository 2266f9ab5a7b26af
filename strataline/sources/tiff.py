"""Pixels of TIFF files as a data source: `spark.read.format("tiff_pixels").load(folder)` after `register(spark)`.

A file is split by ranges of its bytes, as Spark splits its own formats: a strip or tile belongs to the split in which its first
byte lies, and a task reads the tags and its own strips only. So one huge picture is many tasks, and no task holds it whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strataline.sources import pixels as px

# Tags of the format.
ROWS_PER_STRIP, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 278, 322, 323, 324, 325
SCHEMA = "path string, y int, x int, r double, g double, b double, white double, px_um double, error string"
ROWS = 65_536
BROKEN = (ValueError, KeyError, IndexError, TypeError, ZeroDivisionError, OverflowError, struct.error, zlib.error, OSError)


@dataclass
class Block:
    """A strip or tile: where its bytes are, where its pixels are, and of which plane (-1: all)."""

    at: int
    size: int
    y: int
    x: int
    height: int
    width: int
    plane: int


@dataclass
class Form:
    """What all blocks of a picture have in common."""

    height: int
    width: int
    samples: int
    kind: np.dtype
    deflated: bool
    differences: bool
    inverted: bool
    planar: bool


def form_of(order: str, tags: dict[int, tuple]) -> Form:
    """A ValueError or KeyError where the picture is of a kind that isn't read."""
    bits, sign = set(tags.get(px.BITS, (1,))), {1: "u", 2: "i", 3: "f"}.get(tags.get(px.FORMAT, (1,))[0])
    packing, shades, predictor = tags.get(px.COMPRESSION, (1,))[0], tags.get(px.PHOTOMETRIC, (px.BLACK_IS_ZERO,))[0], tags.get(px.PREDICTOR, (1,))[0]
    if packing != 1 and packing not in px.DEFLATE:
        raise ValueError(f"compression {packing} is not read")
    if len(bits) > 1 or not bits <= {8, 16, 32, 64} or sign == "f" and bits == {8} or shades not in (px.WHITE_IS_ZERO, px.BLACK_IS_ZERO, px.RGB):
        raise ValueError(f"samples of {sorted(bits)} bits with colours of kind {shades} are not read")
    if sign is None or predictor not in (1, 2) or sign == "f" and predictor == 2 or shades == px.WHITE_IS_ZERO and sign != "u":
        raise ValueError("this kind of samples or predictor is not read")
    kind = np.dtype(f"{order}{sign}{bits.pop() // 8}")
    return Form(tags[px.HEIGHT][0], tags[px.WIDTH][0], tags.get(px.SAMPLES, (1,))[0], kind, packing in px.DEFLATE, predictor == 2, shades == px.WHITE_IS_ZERO, tags.get(px.PLANAR, (1,))[0] == 2)


def blocks_of(f: Form, tags: dict[int, tuple]) -> list[Block]:
    tiled = TILES in tags
    high, wide = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(ROWS_PER_STRIP, (f.height,))[0], f.height), f.width)
    down, across = -(-f.height // high), -(-f.width // wide)
    places, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[px.STRIPS], tags[px.STRIP_BYTES])
    if len(places) != down * across * (f.samples if f.planar else 1) or len(sizes) != len(places):
        raise ValueError(f"{len(places)} strips or tiles for {down} x {across}")
    out = []
    for k, (at, size) in enumerate(zip(places, sizes)):
        plane, k = divmod(k, down * across) if f.planar else (-1, k)
        y, x = k // across * high, k % across * wide
        out.append(Block(at, size, y, x, high if tiled else min(high, f.height - y), wide, plane))
    return out


def values_of(f: Form, b: Block, raw: bytes) -> np.ndarray:
    """(height, width, samples) of a block, without what a tile has beyond the picture's edges."""
    n = 1 if f.planar else f.samples
    values = np.frombuffer(zlib.decompress(raw) if f.deflated else raw, f.kind)
    if len(values) < b.height * b.width * n:
        raise ValueError(f"a strip or tile ends early at row {b.y}")
    values = values[: b.height * b.width * n].reshape(b.height, b.width, n).astype(f.kind.newbyteorder("="))
    if f.differences:
        values = np.cumsum(values, axis=1, dtype=values.dtype)
    if f.inverted:
        values = np.iinfo(values.dtype).max - values
    return values[: f.height - b.y, : f.width - b.x]


class Split(InputPartition):
    def __init__(self, uri: str, lo: int, hi: int):
        self.uri, self.lo, self.hi = uri, lo, hi


class TiffReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Split]:
        """Of every file by its size alone; the driver opens none."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        scheme = f"{self.path.partition('://')[0]}://" if "://" in self.path else ""
        host = self.path.removeprefix(scheme)[: self.path.removeprefix(scheme).find(root)] if scheme else ""
        files = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.lower().endswith((".tif", ".tiff")))
        return [Split(f"{scheme}{host}{p}", a, a + self.split) for p, size in files for a in range(0, max(size, 1), self.split)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not partition.uri:
            return
        try:
            system, path = fs.FileSystem.from_uri(partition.uri) if "://" in partition.uri else (fs.LocalFileSystem(), partition.uri)
            with system.open_input_file(path) as file:
                order, tags = px.tags_at(lambda at, n: file.read_at(n, at))
                form = form_of(order, tags)
                blocks, size = blocks_of(form, tags), px.pixel_size(tags)
                if form.planar:  # the planes of a pixel lie apart: the first one's split reads them all
                    n = len(blocks) // form.samples
                    groups = [blocks[k::n] for k in range(n)]
                else:
                    groups = [[b] for b in blocks]
                for own in groups:
                    if partition.lo <= own[0].at < partition.hi:
                        try:
                            values = np.concatenate([values_of(form, b, file.read_at(b.size, b.at)) for b in own], axis=2)
                        except BROKEN as e:
                            yield self.error(partition.uri, e, own[0].y, own[0].x)
                            continue
                        yield from self.rows(partition.uri, own[0], values, size)
        except BROKEN as e:
            if partition.lo == 0:  # once a file
                yield self.error(partition.uri, e)

    @staticmethod
    def error(uri: str, e: Exception, y: int | None = None, x: int | None = None) -> pa.RecordBatch:
        return _batch(1, path=[uri], y=[y], x=[x], error=[f"{type(e).__name__}: {e}"])

    @staticmethod
    def rows(uri: str, b: Block, values: np.ndarray, size: float | None) -> Iterator[pa.RecordBatch]:
        high, wide, n = values.shape
        white = float(np.iinfo(values.dtype).max) if values.dtype.kind in "ui" else None
        step = max(1, ROWS // max(wide, 1))
        for a in range(0, high, step):
            part = values[a : a + step].reshape(-1, n).astype(float)
            y, x = (i.ravel().astype(np.int32) for i in np.indices((len(part) // wide, wide)))
            shades = {c: part[:, k if n >= 3 else 0] for k, c in enumerate("rgb")}
            yield _batch(len(part), path=[uri] * len(part), y=y + np.int32(a + b.y), x=x + np.int32(b.x), white=[white] * len(part), px_um=[size] * len(part), **shades)


def _batch(n: int, **columns) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    fields = [c.split() for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], types[t]) if c in columns else pa.nulls(n, types[t]) for c, t in fields], names=[c for c, _ in fields])


class TiffPixels(DataSource):
    """path, y, x, samples as stored (grey three times; further ones left out), white (the type's largest; null of floats), px_um and error.

    A file that can't be read is one row with its error; a strip or tile that can't be is one at its first row and column, and the
    others of the file are read. Option maxPartitionBytes: bytes of a file for a task. A folder without files gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff_pixels"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options["path"], int(self.options.get("maxPartitionBytes", 32 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TiffPixels)


def shares(rows: DataFrame) -> DataFrame:
    """path, y, x and r, g, b as shares of white of the rows without an error, scaled as a picture read whole is.

    Integers by their type's range, or by the picture's largest where less than 35 % of it is used; floats as they are, or by the
    largest where that is over 1.5. The largest of each picture is one partial aggregate; only it is joined back.
    """
    good = rows.where("error is null")
    top = good.groupBy("path").agg(F.max(F.greatest(*[F.when(~F.isnan(c), F.col(c)) for c in "rgb"])).alias("top"), F.first("white").alias("white"))
    low = F.col("top") < 0.35 * F.col("white")
    by = F.when(F.col("white").isNotNull(), F.when(low, F.greatest("top", F.lit(1.0))).otherwise(F.col("white"))).otherwise(F.when(F.col("top") <= 1.5, 1.0).otherwise(F.col("top")))
    whole = good.drop("white").join(top.select("path", by.alias("by")), "path")
    return whole.select("path", "y", "x", *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.col("by"))).alias(c) for c in "rgb"])
