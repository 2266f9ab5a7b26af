"""Chromatogram signals from binary channel files, decoded in Arrow batches from Spark's binaryFile source."""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format (version 130): where its fields lie and how they are written.
VERSION, LABELS = "130", {"sample": 0x35A, "operator": 0x758, "moment": 0x957, "method": 0xA0E, "units": 0x104C, "description": 0x1075}
FIRST_MS, LAST_MS, SCALE, DATA = 0x11A, 0x11E, 0x127C, 0x1800
ESCAPE = -0x8000


def text_at(raw: bytes, at: int) -> str:
    """A counted UTF-16 text."""
    n = raw[at] if at < len(raw) else 0
    return raw[at + 1 : at + 1 + 2 * n].decode("utf-16-le", "replace").strip()


def values_of(raw: bytes, at: int = DATA) -> np.ndarray:
    """Segments of a header (a mark of 0x10 and a count) and differences of 16 bits; an escape gives the next value whole, in 48 bits."""
    out: list[int] = []
    value = 0
    while at + 2 <= len(raw) and raw[at] == 0x10:
        count = raw[at + 1]
        at += 2
        for _ in range(count):
            if at + 2 > len(raw):
                return np.array(out, float)
            d = struct.unpack_from(">h", raw, at)[0]
            at += 2
            if d == ESCAPE:
                if at + 6 > len(raw):
                    return np.array(out, float)
                high, low = struct.unpack_from(">iH", raw, at)
                value = (high << 16) + low
                at += 6
            else:
                value += d
            out.append(value)
    return np.array(out, float)


def decode(raw: bytes) -> dict:
    """One channel: labels, times in minutes and scaled values; ValueError for another format."""
    if len(raw) < DATA or raw[1 : 1 + raw[0]].decode("latin-1") != VERSION:
        raise ValueError("not a version 130 channel")
    first, last = struct.unpack_from(">ii", raw, FIRST_MS)
    y = values_of(raw) * struct.unpack_from(">d", raw, SCALE)[0]
    return {k: text_at(raw, at) for k, at in LABELS.items()} | {"x": np.linspace(first / 60000.0, last / 60000.0, len(y)), "y": y}


SCHEMA = "path string, sample string, operator string, moment string, method string, units string, description string, x array<double>, y array<double>, error string"


def read_channels(spark: SparkSession, path: str, glob: str = "*.ch") -> DataFrame:
    """A row a file; a file that can't be decoded has its error instead of a signal."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return decode_channels(files)


def decode_channels(files: DataFrame) -> DataFrame:
    def work(frames):
        for pdf in frames:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    out.append({"path": path, "error": None} | decode(bytes(raw)))
                except (ValueError, struct.error, IndexError) as e:
                    out.append({"path": path, "error": str(e)} | dict.fromkeys([*LABELS, "x", "y"]))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    made = files.mapInPandas(work, SCHEMA)
    return made.withColumn("measured", F.expr("try_to_timestamp(moment, 'd-MMM-yy, HH:mm:ss')"))


def points(channels: DataFrame) -> DataFrame:
    """A row a sample of each signal."""
    return channels.where("error is null").select("path", F.posexplode(F.arrays_zip("x", "y")).alias("i", "p")).select("path", "i", "p.x", "p.y")


def in_sequence(channels: DataFrame) -> DataFrame:
    """Order of runs by their time; those without one last, by name."""
    from pyspark.sql import Window

    runs = channels.groupBy(F.regexp_extract("path", r"(.*)/[^/]*\z", 1).alias("run")).agg(F.min("measured").alias("measured"), F.count("*").alias("channels"))
    return runs.withColumn("position", F.row_number().over(Window.orderBy(F.col("measured").asc_nulls_last(), "run")))  # a row a run


def wide_export(channels: DataFrame) -> DataFrame:
    """Row i has every curve's i-th sample; shorter curves are NULL at their end. Two columns a curve."""
    curves = [r[0] for r in channels.where("error is null").select("path").distinct().orderBy("path").collect()]  # a row a curve of one table
    p = points(channels)
    agg = [F.max(F.when(F.col("path") == c, F.col(v))).alias(f"{c.rsplit('/', 1)[-1]} {v}") for c in curves for v in ("x", "y")]
    return p.groupBy("i").agg(*agg) if agg else p.select("i")


def _doubles(raw: bytes, shift: int = 0) -> np.ndarray:
    """The little-endian double at every byte position."""
    n = max(0, len(raw) - 7 - shift)
    return np.ndarray((n,), "<f8", raw, shift, (1,)) if n else np.zeros(0)


def fractions_of(raw: bytes, flow: float | None = None) -> list[dict]:
    """Rows of the fraction table within a register file, known by what their numbers must be.

    A row has its number, 12 bytes on its volume (ul), 20 and 28 bytes on its start and end (ms). Numbers run from 1 without
    gaps, starts never go back. Wells are the UTF-16 words between Location and Volume, if there are as many as rows.
    """
    n = _doubles(raw)[: max(0, len(raw) - 35)]
    volume, start, end = (_doubles(raw, k)[: len(n)] for k in (12, 20, 28))
    with np.errstate(invalid="ignore"):
        likely = np.flatnonzero((n >= 1) & (n == np.floor(n)) & (volume > 0) & (volume < 1e6) & (start >= 0) & (start < end) & (end < 1e8))
    out: list[dict] = []
    for at in likely.tolist():
        if n[at] == len(out) + 1 and (not out or start[at] >= out[-1]["start_min"] * 60_000):
            a, z = float(start[at]) / 60_000, float(end[at]) / 60_000
            out.append({"n": len(out) + 1, "ul": round(float(volume[at]), 2), "start_min": a, "end_min": z, "well": "", "start_ml": a * flow if flow else None, "end_ml": z * flow if flow else None})
    words = [w.group().decode("utf-16-le") for w in re.finditer(rb"(?:[\x20-\x7e]\x00){2,}", raw)]
    if "Location" in words and "Volume" in words:
        wells = words[words.index("Location") + 1 : words.index("Volume")]
        if len(wells) == len(out):
            out = [r | {"well": w} for r, w in zip(out, wells)]
    return out


FRACTIONS = "path string, n long, ul double, start_min double, end_min double, well string, start_ml double, end_ml double"


def read_fractions(spark: SparkSession, path: str, glob: str = "*.reg", flow: float | None = None) -> DataFrame:
    def work(frames):
        for pdf in frames:
            rows = [{"path": p, **r} for p, raw in zip(pdf["path"], pdf["content"]) for r in fractions_of(bytes(raw), flow)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in FRACTIONS.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(work, FRACTIONS)


def flow_of(content) -> Column:
    """ml a minute out of a method's UTF-16 text."""
    return F.regexp_extract(F.decode(content, "UTF-16LE"), r"(?i)flow\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?)\s*mL/min", 1).try_cast("double")
