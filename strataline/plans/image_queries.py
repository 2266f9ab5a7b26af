"""Array kernels over pictures made of the driver's tables: one picture a group, every order line in it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strataline.operators import raster, tiles, wall, zones
from strataline.plans.tables import rounded, table

SIDE = 96


def _pixels(spark, d):
    """Mean values by section, y and x."""
    li = table(spark, d, "lineitem")
    y, x = F.col("l_orderkey") * 31 % SIDE, F.col("l_partkey") * 17 % SIDE
    return li.groupBy(F.col("l_returnflag").alias("section"), y.cast("int").alias("y"), x.cast("int").alias("x")).agg(F.avg("l_discount").alias("collagen"), F.avg("l_tax").alias("muscle"), F.avg(F.col("l_quantity") / 100).alias("nuclei"))


def _picture(pdf: pd.DataFrame, column: str, sigma: float = 2.0) -> np.ndarray:
    img = np.zeros((SIDE, SIDE))
    img[pdf["y"], pdf["x"]] = pdf[column]
    return raster.gaussian(img, sigma)


def pictures(spark, d):
    """section, height, width, px_um, and three channels as float32 bytes."""

    def one(pdf):
        return pd.DataFrame([(pdf["section"].iloc[0], SIDE, SIDE, 4.0, *[_picture(pdf, c).astype("<f4").tobytes() for c in ("collagen", "muscle", "nuclei")])], columns=["section", "height", "width", "px_um", "collagen", "muscle", "nuclei"])

    return _pixels(spark, d).groupBy("section").applyInPandas(one, "section string, height int, width int, px_um double, collagen binary, muscle binary, nuclei binary")


def _by_row(one):
    """For mapInPandas: one(row) of every row, a picture each."""

    def each(batches):
        for pdf in batches:
            for i in range(len(pdf)):
                yield one(pdf.iloc[i])

    return each


def lesion_table(spark, d):
    def one(r):
        c, m = (np.frombuffer(r[k], "<f4").reshape(r["height"], r["width"]).astype(float) for k in ("collagen", "muscle"))
        found = raster.lesions(c / np.maximum(c + m, 1e-6), c + m > 0.005, float(r["px_um"]), min_area_um2=100.0, smooth_um=8.0, k=1.0)
        return pd.DataFrame([(r["section"], f["lesion"], f["area_um2"], f["x_um"], f["y_um"]) for f in found], columns=["section", "lesion", "area_um2", "x_um", "y_um"])

    return rounded(pictures(spark, d).mapInPandas(_by_row(one), "section string, lesion int, area_um2 double, x_um double, y_um double"), 3)


def kidney_zones(spark, d):
    return rounded(zones.zones(pictures(spark, d), window_um=60.0), 2)


def stitched_tiles(spark, d):
    """Each picture cut in overlapping tiles and put together again."""

    def cut(r):
        img = np.frombuffer(r["nuclei"], "<f4").reshape(r["height"], r["width"])
        parts = [img[y : y + 60, x : x + 60] for y in (0, 36) for x in (0, 36)]
        return pd.DataFrame([(r["section"], k, *p.shape, np.ascontiguousarray(p).tobytes()) for k, p in enumerate(parts)], columns=["section", "tile", "height", "width", "grey"])

    made = pictures(spark, d).mapInPandas(_by_row(cut), "section string, tile long, height int, width int, grey binary")
    return rounded(tiles.stitch(made), 1)


def wall_profiles(spark, d):
    """A ring around the middle of each picture measured as a wall, and its totals by native aggregates."""
    from strataline.operators import profile

    t = [2 * np.pi * k / 120 for k in range(120)]
    line = F.array(*[F.array(F.lit(SIDE / 2 + 25 * float(np.cos(a))), F.lit(SIDE / 2 + 25 * float(np.sin(a)))) for a in t])
    made = wall.analyze(pictures(spark, d).withColumn("closed", F.lit(True)).withColumn("line", line), reach_um=40.0, step_um=4.0, floor=0.001)
    return rounded(profile.profile_totals(made.withColumn("counted", F.col("error").isNull() & ~F.col("no_data")), ["section"], 4.0, "counted", {"muscle": "muscle_od_um", "collagen": "collagen_od_um"}, {"thickness": "media_thickness_um"}), 4)


SQL: dict[str, str] = {}
QUERIES = {f.__name__: f for f in (lesion_table, kidney_zones, stitched_tiles, wall_profiles)}
