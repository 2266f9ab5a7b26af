"""Signals over time: noise band, peaks, thinning, histograms, event rates, spans."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.core import finite, safe_div
from strataline.functions.ordering import quantiles


def positioned(df: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """i from 0 within each series, and n."""
    return df.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*at)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))


def noise_band(df: DataFrame, keys: list[str], at: list[str], value: str) -> DataFrame:
    """Median over full windows of max(5, n // 20) of the range left after each window's end-to-end line; 0 under ten samples."""
    p = positioned(df, keys, at)
    win = F.greatest(F.lit(5), F.floor(F.col("n") / 20)).cast("int")
    p = p.withColumn("win", win).withColumn("bucket", F.floor(F.col("i") / F.col("win"))).withColumn("j", F.col("i") % F.col("win"))
    p = p.where((F.col("n") >= 10) & ((F.col("bucket") + 1) * F.col("win") <= F.col("n")))
    b = Window.partitionBy(*keys, "bucket")
    first, last = F.max(F.when(F.col("j") == 0, F.col(value))).over(b), F.max(F.when(F.col("j") == F.col("win") - 1, F.col(value))).over(b)
    p = p.withColumn("flat", F.col(value) - (first + (last - first) * F.col("j") / (F.col("win") - 1)))
    ranges = p.groupBy(*keys, "bucket").agg((F.max("flat") - F.min("flat")).alias("span"))
    bands = ranges.groupBy(*keys).agg(F.median("span").alias("band"))
    return df.select(*keys).distinct().join(bands, keys, "left").select(*keys, F.coalesce("band", F.lit(0.0)).alias("noise"))


def thin(df: DataFrame, keys: list[str], at: list[str], value: str, cap: int = 1200) -> DataFrame:
    """At most about `cap` samples that keep every bucket's first least and first largest value, in order.

    Series within the cap stay whole. A flat bucket gives its first sample twice.
    """
    p = positioned(df, keys, at).withColumn("bucket", F.floor(F.col("i") / F.ceil(F.col("n") / (cap // 2))))
    row = F.struct("i", *[c for c in df.columns if c not in keys])
    ends = p.where(F.col("n") > cap).groupBy(*keys, "bucket").agg(F.min_by(row, F.struct(F.col(value), F.col("i"))).alias("low"), F.min_by(row, F.struct(-F.col(value), F.col("i"))).alias("high"))
    picked = ends.select(*keys, F.explode(F.array("low", "high")).alias("r")).select(*keys, "r.*")
    return p.where(F.col("n") <= cap).select(picked.columns).union(picked)


def peaks_of(x: np.ndarray, y: np.ndarray, floor: float, min_width: float = 0.05) -> list[tuple[float, float, float, float]]:
    """(x, height, prominence, width at half prominence) of local maxima, plateaus at their middle.

    Prominence over the higher flanking valley must exceed floor, and the width min_width. Of two peaks with a shallow valley
    between them the taller stays.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(y) < 3:
        return []
    start = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
    end = np.append(start[1:], len(y)) - 1
    level = y[start]
    tops = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    out = []
    for t in tops:
        i, h = (start[t] + end[t]) // 2, level[t]
        left = np.flatnonzero(y[: start[t]] > h)
        right = np.flatnonzero(y[end[t] + 1 :] > h)
        a = left[-1] if len(left) else 0
        z = end[t] + 1 + right[0] if len(right) else len(y) - 1
        prominence = h - max(y[a : i + 1].min(), y[i : z + 1].min())
        if prominence <= floor:
            continue
        half = h - prominence / 2
        lo, hi = i, i
        while lo > a and y[lo] > half:
            lo -= 1
        while hi < z and y[hi] > half:
            hi += 1
        cross = lambda p, q: x[p] if y[p] == y[q] else x[p] + (x[q] - x[p]) * (half - y[p]) / (y[q] - y[p])
        x0 = cross(lo, lo + 1) if y[lo] <= half else x[lo]
        x1 = cross(hi - 1, hi) if y[hi] <= half else x[hi]
        if x1 - x0 >= min_width:
            out.append((float(x[i]), float(h), float(prominence), float(x1 - x0)))
    return out


def peaks(df: DataFrame, keys: list[str], at: str, value: str, floor: float | None = None, min_width: float = 0.05) -> DataFrame:
    """peaks_of every series; floor: three times its noise band. One series is one group."""
    noise = noise_band(df, keys, [at], value)
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "x double, height double, prominence double, width double"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        got = peaks_of(pdf[at].to_numpy(float), pdf[value].to_numpy(float), 3 * float(pdf["noise"].iloc[0]) if floor is None else floor, min_width)
        made = pd.DataFrame(got, columns=["x", "height", "prominence", "width"])
        for i, k in enumerate(keys):
            made.insert(i, k, pdf[k].iloc[0])
        return made

    rows = df.select(*keys, F.col(at).cast("double").alias(at), F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    return rows.join(noise, keys).groupBy(*keys).applyInPandas(one, schema)


def nice(step: float) -> float:
    """The least of 1, 2, 5 times a power of ten that is not below a step."""
    if not step > 0:
        return 1.0
    base = 10.0 ** math.floor(math.log10(step))
    return next(m * base for m in (1.0, 2.0, 5.0, 10.0) if step <= m * base * (1 + 1e-12))


def histogram(df: DataFrame, group: str, value: str, most: int = 30) -> DataFrame:
    """Shares of each group's own values in bins shared by all: Sturges' or Freedman-Diaconis' width, whichever is finer."""
    rows = df.withColumn("v", finite(value)).where("v is not null")
    s = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not s[0]:
        return rows.select(group, F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("share"))
    n, low, high = s
    q1, q3 = quantiles(rows, F.col("v"), [0.25, 0.75])
    span = high - low
    fd, sturges = 2 * (q3 - q1) / n ** (1 / 3), span / (math.log2(n) + 1)
    width = min(fd, sturges) if fd > 0 else sturges
    bins = max(1, min(most, math.ceil(span / width) if width > 0 else 1))
    step = span / bins if span > 0 else 1.0
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / step)).cast("int")
    made = rows.groupBy(group, at.alias("bin")).agg(F.count("*").alias("n"))
    return made.select(group, "bin", (F.lit(low) + F.col("bin") * step).alias("low"), (F.lit(low) + (F.col("bin") + 1) * step).alias("high"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy(group))).alias("share"))


def event_rates(df: DataFrame, group: str, trial: str, at: str, width: float) -> DataFrame:
    """Events a second and trial in bins of a width in milliseconds."""
    bin_ = F.floor(F.col(at) / width)
    trials = df.groupBy(group).agg(F.count_distinct(trial).alias("trials"))
    made = df.where(finite(F.col(at).cast("double")).isNotNull()).groupBy(group, bin_.alias("bin")).agg(F.count("*").alias("events"))
    return made.join(trials, group).select(group, "bin", (F.col("bin") * width).alias("start"), "events", (F.col("events") / F.col("trials") / (width / 1000.0)).alias("rate"))


def active_span(df: DataFrame, at: str, spread: str, share: float = 0.03) -> DataFrame:
    """Where sweeps differ: from the first to the last place whose spread exceeds its median by 3 MAD and by a share of the rise."""
    top, (middle,) = df.agg(F.max(spread)).first()[0], quantiles(df, F.col(spread), [0.5])
    if middle is None:
        return df.limit(0).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    (mad,) = quantiles(df, F.abs(F.col(spread) - middle), [0.5])
    cut = max(middle + 3 * 1.4826 * mad, middle + share * (top - middle))
    return df.where(F.col(spread) > cut).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and 1.4826 x the median absolute deviation of each group."""
    rows = df.withColumn("v", finite(value)).where("v is not null").withColumn("m", F.median("v").over(Window.partitionBy(*keys)))
    return rows.groupBy(*keys).agg(F.max("m").alias("median"), (1.4826 * F.median(F.abs(F.col("v") - F.col("m")))).alias("mad"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which the running weight reaches half of all.

    Equal values are added up before any order, so a group holds a row for each different value.
    """
    w = Window.partitionBy(*keys)
    each = df.groupBy(*keys, value).agg(F.sum(weight).alias("_weight"))
    totals = each.withColumn("total", F.sum("_weight").over(w))
    made = totals.withColumn("running", F.sum("_weight").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return made.where(F.col("running") >= F.col("total") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def guarded_corr(a: str | Column, b: str | Column, least: int = 20) -> Column:
    """Aggregate: Pearson's r; NULL under `least` pairs or without spread."""
    x, y = finite(a), finite(b)
    use = x.isNotNull() & y.isNotNull()
    x, y = F.when(use, x), F.when(use, y)
    return F.when((F.count(x) >= least) & (F.stddev_pop(x) >= 1e-12) & (F.stddev_pop(y) >= 1e-12), F.corr(x, y))


__all__ = ["active_span", "event_rates", "guarded_corr", "histogram", "median_mad", "nice", "noise_band", "peaks", "peaks_of", "positioned", "safe_div", "thin", "weighted_median"]
