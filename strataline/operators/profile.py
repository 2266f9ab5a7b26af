"""Ordered positions along a profile: running sums, runs, gaps, despiking, flags, edges. A profile is one window partition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.core import all_of, finite, safe_div


def ordered(keys: list[str], at: list[str]):
    return Window.partitionBy(*keys).orderBy(*at)


def running_ratio(df: DataFrame, keys: list[str], at: list[str], num: str, den: str, floor: float = 0.01, name: str = "running_ratio") -> DataFrame:
    """Running sum of num over that of den; NULL until the latter exceeds a share of its final value."""
    w = ordered(keys, at).rowsBetween(Window.unboundedPreceding, 0)
    n, d = F.sum(finite(num)).over(w), F.sum(finite(den)).over(w)
    total = F.greatest(F.sum(finite(den)).over(Window.partitionBy(*keys)), F.lit(1e-9))
    return df.withColumn(name, F.when(d > floor * total, n / d))


def cumulative(df: DataFrame, keys: list[str], at: list[str], columns: list[str]) -> DataFrame:
    """cum_<column> for each column, and arc_fraction of the first of at."""
    w = ordered(keys, at).rowsBetween(Window.unboundedPreceding, 0)
    made = df.withColumns({f"cum_{c}": F.sum(finite(c)).over(w) for c in columns})
    return made.withColumn("arc_fraction", safe_div(F.col(at[0]).cast("double"), F.max(F.col(at[0]).cast("double")).over(Window.partitionBy(*keys))))


def with_runs(df: DataFrame, keys: list[str], at: list[str], flag: str, name: str = "run") -> DataFrame:
    """Number, from 1, of the run of equal flags that a row belongs to."""
    w = ordered(keys, at)
    f = F.coalesce(F.col(flag), F.lit(False))
    starts = df.withColumn("run_start", F.coalesce((f != F.lag(f).over(w)).cast("int"), F.lit(1)))
    return starts.withColumn(name, F.sum("run_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("run_start")


def segments(df: DataFrame, keys: list[str], at: list[str], cut: str, name: str = "segment") -> DataFrame:
    """Pieces between cuts, numbered from 0; -1 in a cut."""
    runs = with_runs(df, keys, at, cut, "run_id")
    open_run = ~F.coalesce(F.col(cut), F.lit(False))
    first = F.when(open_run & (F.coalesce(F.lag("run_id").over(ordered(keys, at)), F.lit(0)) != F.col("run_id")), 1).otherwise(0)
    made = runs.withColumn("piece_start", first)
    return made.withColumn(name, F.when(open_run, F.sum("piece_start").over(ordered(keys, at).rowsBetween(Window.unboundedPreceding, 0)) - 1).otherwise(-1)).drop("run_id", "piece_start")


def long_runs(df: DataFrame, keys: list[str], at: list[str], flag: str, least: float, closed: bool = False, name: str = "kept") -> DataFrame:
    """True where the flag holds in a run of at least `least` positions; closed: the last run goes on in the first."""
    n = max(1, int(np.ceil(least)))
    runs = with_runs(df, keys, at, flag, "run_id")
    f = F.coalesce(F.col(flag), F.lit(False))
    if closed:
        whole = Window.partitionBy(*keys)
        last = F.max("run_id").over(whole)
        ends = F.max(F.when(F.col("run_id") == 1, f.cast("int"))).over(whole) + F.max(F.when(F.col("run_id") == last, f.cast("int"))).over(whole)
        runs = runs.withColumn("last_run", last).withColumn("ends", ends)
        runs = runs.withColumn("run_id", F.when((F.col("ends") == 2) & (F.col("run_id") == F.col("last_run")), 1).otherwise(F.col("run_id"))).drop("last_run", "ends")
    return runs.withColumn(name, f & (F.count("*").over(Window.partitionBy(*keys, "run_id")) >= n)).drop("run_id")


def interpolate(df: DataFrame, keys: list[str], at: str, value: str, name: str = "filled", tie: list[str] | None = None) -> DataFrame:
    """Linear between known positions, held at the ends; a profile without any value is 0."""
    w = ordered(keys, [at, *(tie or [])])
    v = finite(value)
    point = F.when(v.isNotNull(), F.struct(F.col(at).cast("double").alias("x"), v.alias("y")))
    before = F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    made = df.withColumn("p0", before).withColumn("p1", after)
    x = F.col(at).cast("double")
    line = F.col("p0.y") + (F.col("p1.y") - F.col("p0.y")) * safe_div(x - F.col("p0.x"), F.col("p1.x") - F.col("p0.x"))
    filled = F.when(v.isNotNull(), v).when(F.col("p0").isNull() & F.col("p1").isNull(), 0.0).when(F.col("p0").isNull(), F.col("p1.y")).when(F.col("p1").isNull(), F.col("p0.y")).otherwise(F.coalesce(line, F.col("p0.y")))
    return made.withColumn(name, filled).drop("p0", "p1")


def rolling_median(df: DataFrame, keys: list[str], at: list[str], value: str, half: int, name: str = "rolling") -> DataFrame:
    """Median of the positions within `half` of each; the frame shrinks at the ends."""
    return df.withColumn(name, F.percentile(finite(value), F.lit(0.5)).over(ordered(keys, at).rowsBetween(-half, half)))


def spikes(df: DataFrame, keys: list[str], at: list[str], value: str, half: int, most: float, name: str = "clean") -> DataFrame:
    """Values further than `most` from their rolling median become NULL."""
    made = rolling_median(df, keys, at, value, half, "spike_median")
    return made.withColumn(name, F.when(F.abs(finite(value) - F.col("spike_median")) <= most, finite(value))).drop("spike_median")


def despike_array(v: np.ndarray, window: int, most: float, smooth: float = 0.0, closed: bool = False) -> np.ndarray:
    """Median filter on a padded profile, outliers interpolated, Gaussian smoothing; for whole profiles in one task."""
    v = np.asarray(v, float)
    n = len(v)
    if not n:
        return v
    known = np.isfinite(v)
    if not known.any():
        return np.zeros(n)
    v = np.interp(np.arange(n), np.flatnonzero(known), v[known])
    half = max(1, int(window) // 2)
    mode = "wrap" if closed else "edge"
    med = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(v, half, mode=mode), 2 * half + 1), axis=1)
    good = np.abs(v - med) <= most
    v = np.interp(np.arange(n), np.flatnonzero(good), v[good]) if good.any() else med
    if smooth > 0:
        reach = max(1, int(4 * smooth + 0.5))
        k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / smooth) ** 2)
        v = np.convolve(np.pad(v, reach, mode=mode), k / k.sum(), "valid")
    return v


def despike(df: DataFrame, keys: list[str], at: str, value: str, window: int, most: float, smooth: float = 0.0, closed: bool = False) -> DataFrame:
    """despike_array over every profile, one profile a group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        return pdf.assign(despiked=despike_array(pdf[value].to_numpy(), window, most, smooth, closed))

    return df.select(*keys, at, F.col(value).cast("double")).groupBy(*keys).applyInPandas(one, ", ".join([*(f"{k} {dict(df.dtypes)[k]}" for k in keys), f"{at} {dict(df.dtypes)[at]}", f"{value} double", "despiked double"]))


def turns(df: DataFrame, keys: list[str], at: list[str], side: str, reach: int, name: str = "turned") -> DataFrame:
    """Positions within `reach` of one whose side differs from the one before."""
    w = ordered(keys, at)
    made = df.withColumn("differs", F.coalesce((F.col(side) != F.lag(side).over(w)).cast("int"), F.lit(0)))
    return made.withColumn(name, F.max("differs").over(w.rowsBetween(-reach, reach)) == 1).drop("differs")


def curvature(df: DataFrame, keys: list[str], at: list[str], x: str, y: str, name: str = "curvature") -> DataFrame:
    """Central differences, one-sided at the ends; NULL where the curve stands still."""
    w = ordered(keys, at)
    mid = lambda c: (F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))) / (F.lead(c).over(w).isNotNull().cast("int") + F.lag(c).over(w).isNotNull().cast("int"))
    made = df.withColumn("dx", mid(x)).withColumn("dy", mid(y))
    made = made.withColumn("ddx", mid("dx")).withColumn("ddy", mid("dy"))
    return made.withColumn(name, safe_div(F.col("dx") * F.col("ddy") - F.col("dy") * F.col("ddx"), F.pow(F.col("dx") ** 2 + F.col("dy") ** 2, F.lit(1.5)))).drop("dx", "dy", "ddx", "ddy")


def arc_length(df: DataFrame, keys: list[str], at: list[str], x: str, y: str, name: str = "arc") -> DataFrame:
    w = ordered(keys, at)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    made = df.withColumn("arc_step", step)
    return made.withColumn(name, F.sum("arc_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("arc_step")


def shoelace(df: DataFrame, keys: list[str], at: list[str], x: str, y: str) -> DataFrame:
    """Signed area of the closed polygon of each group."""
    w = ordered(keys, at)
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nx, ny = F.coalesce(F.lead(x).over(w), first(x)), F.coalesce(F.lead(y).over(w), first(y))
    made = df.withColumn("cross", F.col(x) * ny - nx * F.col(y))
    return made.groupBy(*keys).agg((F.sum("cross") / 2).alias("area"), F.count("*").alias("n_points"))


def thickness_flags(df: DataFrame, keys: list[str], thickness: str, near: str = "near_branch", opening: str = "opening", no_data: str = "no_data", thick: float = 4.0, thin: float = 0.35, junction: float = 1.5) -> DataFrame:
    """too_thick, too_thin, at_branch and thickened, relative to the profile's median; a missing thickness is both too thick and too thin."""
    made = df.withColumn("typical", F.median(finite(thickness)).over(Window.partitionBy(*keys)))
    t, m = finite(thickness), F.col("typical")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False)
    made = made.withColumn("too_thick", ~F.coalesce(t < thick * m, F.lit(False))).withColumn("too_thin", ~F.coalesce(t > thin * m, F.lit(False)))
    wide = F.coalesce(t > junction * m, F.lit(False))
    made = made.withColumn("at_branch", ((F.col("too_thick") | wide) & yes(near) & ~yes(no_data)) | (yes(opening) & ~yes(no_data)))
    return made.withColumn("thickened", F.col("too_thick") & ~yes(near) & ~yes(no_data)).drop("typical")


def counted(df: DataFrame, keys: list[str], disqualifying: list[str], no_data: str = "no_data", exclude: bool = True, name: str = "counted") -> DataFrame:
    """Positions that count: none of the flags, or merely with data; where nothing is left, all of the profile."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    keep = all_of(no(c) for c in [*disqualifying, no_data]) if exclude else no(no_data)
    made = df.withColumn(name, keep)
    return made.withColumn(name, F.col(name) | ~F.bool_or(name).over(Window.partitionBy(*keys)))


def profile_totals(df: DataFrame, keys: list[str], step: float, counted: str, integrals: dict[str, str], medians: dict[str, str] | None = None) -> DataFrame:
    """Length, integrals and their ratios per length of the counted positions; here a denominator is at least 1e-9."""
    c = F.coalesce(F.col(counted), F.lit(False))
    made = df.groupBy(*keys).agg(
        (F.count(F.when(c, 1)) * F.lit(step)).alias("length"), F.avg(c.cast("double")).alias("counted_share"),
        *[F.coalesce(F.sum(F.when(c, finite(v))) * step, F.lit(0.0)).alias(k) for k, v in integrals.items()],
        *[F.median(F.when(c, finite(v))).alias(k) for k, v in (medians or {}).items()],
    )
    return made.withColumns({f"{k}_per_length": F.col(k) / F.greatest(F.col("length"), F.lit(1e-9)) for k in integrals})


def line_integral(df: DataFrame, keys: list[str], value: str, jacobian: str, mask: str, step: float) -> DataFrame:
    """Sum over depth of value x jacobian x step under a mask, and the mask's own area per length."""
    m = F.coalesce(F.col(mask), F.lit(False))
    return df.groupBy(*keys).agg((F.sum(F.when(m, finite(value) * F.col(jacobian))) * step).alias("integral"), (F.sum(F.when(m, F.col(jacobian))) * step).alias("area_per_length"))


def first_crossing(df: DataFrame, keys: list[str], at: str, value: str, level: float, hold: int) -> DataFrame:
    """The first position from which the value stays under a level for `hold` positions, placed between the two samples."""
    w = ordered(keys, [at])
    made = df.withColumn("held", F.max(finite(value)).over(w.rowsBetween(0, hold - 1)) < level).withColumn("left_v", F.lag(finite(value)).over(w)).withColumn("left_at", F.lag(at).over(w))
    found = made.where("held").groupBy(*keys).agg(F.min_by(F.struct(at, finite(value).alias("v"), "left_v", "left_at"), at).alias("p"))
    share = safe_div(F.col("p.left_v") - level, F.col("p.left_v") - F.col("p.v"))
    return found.select(*keys, F.coalesce(F.col("p.left_at") + share * (F.col(f"p.{at}") - F.col("p.left_at")), F.col(f"p.{at}").cast("double")).alias("edge"))


def beyond_edge(df: DataFrame, keys: list[str], at: str, on: str, edge: str, reach: float) -> DataFrame:
    """How far past the edge a flag still holds within reach, and the share of positions up to there where it does."""
    inside = (F.col(at) >= F.col(edge)) & (F.col(at) <= F.col(edge) + reach)
    last = df.where(inside & F.col(on)).groupBy(*keys).agg(F.max(F.col(at) - F.col(edge)).alias("beyond"))
    made = df.where(inside).join(last, keys, "left").groupBy(*keys).agg(F.coalesce(F.max("beyond"), F.lit(0.0)).alias("beyond"), F.avg(F.when(F.col(at) - F.col(edge) <= F.col("beyond"), F.col(on).cast("double"))).alias("fill"))
    return made


def radial_variation(df: DataFrame, keys: list[str], at: str, value: str, half: int, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """Coefficient of variation of the smoothed profile and of what smoothing removes, over the middle of the band."""
    w = ordered(keys, [at])
    whole = Window.partitionBy(*keys)
    made = df.withColumn("smooth", F.avg(finite(value)).over(w.rowsBetween(-half, half)))
    span = (F.col(at) - F.min(at).over(whole)) / F.nullif(F.max(at).over(whole) - F.min(at).over(whole), F.lit(0))
    made = made.withColumn("depth_share", span).where((F.col("depth_share") >= low) & (F.col("depth_share") <= high))
    return made.groupBy(*keys).agg(safe_div(F.stddev_pop("smooth"), F.avg("smooth")).alias("variation"), safe_div(F.stddev_pop(finite(value) - F.col("smooth")), F.avg("smooth")).alias("contrast"))
