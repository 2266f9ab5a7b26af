"""Stains, cuts and zones: expressions over pixel tables, and NumPy kernels for one image a row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.core import finite, safe_div
from strataline.operators.series import median_mad


def optical_density(value: Column, white: Column | float = 1.0) -> Column:
    """-log10 of the share of white, which is held between 1e-4 and 1."""
    return -F.log10(F.least(F.lit(1.0), F.greatest(F.lit(1e-4), value / white)))


def covered(*channels: Column, tolerance: float = 0.001) -> Column:
    """False for pixels that are white in all channels."""
    return ~(F.least(*channels) >= 1 - tolerance)


def unmix(od: list[Column], stains: np.ndarray) -> list[Column]:
    """Amounts of each stain (rows of a 3 x 3 or 2 x 3 matrix), not below 0."""
    inverse = np.linalg.pinv(np.asarray(stains, float))
    return [F.greatest(F.lit(0.0), sum((od[c] * float(inverse[c, k]) for c in range(1, 3)), od[0] * float(inverse[0, k]))) for k in range(inverse.shape[1])]


# Colours of the dyes, used where a section can't tell its own.
DEFAULT_STAINS = {"muscle": (0.30, 0.75, 0.58), "collagen": (0.72, 0.55, 0.18), "nuclei": (0.55, 0.60, 0.58)}


def density_colour(density: Column) -> Column:
    """The share of white that an optical density leaves; the inverse of optical_density."""
    return F.pow(F.lit(10.0), -density)


def default_stains() -> np.ndarray:
    m = np.array(list(DEFAULT_STAINS.values()))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _stained(od: DataFrame, names: tuple[str, str, str], beta: float) -> DataFrame:
    r, g, b = (finite(c) for c in names)
    return od.where(r + g + b > beta)


def stain_moments(od: DataFrame, r: str, g: str, b: str, beta: float = 0.15) -> DataFrame:
    """n and the covariances of the densities of pixels whose densities together exceed beta: one row of partial sums."""
    names = (r, g, b)
    pairs = [(p, q) for i, p in enumerate(names) for q in names[i:]]
    return _stained(od, names, beta).agg(F.count("*").alias("n"), *[F.covar_samp(p, q).alias(f"{p}_{q}") for p, q in pairs])


def stain_vectors(od: DataFrame, r: str, g: str, b: str, beta: float = 0.15, alpha: float = 1.0, least: int = 500, bins: int = 1 << 16) -> np.ndarray:
    """Unit densities of muscle, collagen and what neither explains, a row each, from a pixel table.

    Stained pixels spread along the two main axes of their covariance; their angles' alpha and 100 - alpha percentiles in that plane
    are the dyes. Collagen is the one that takes more red. Fewer stained pixels than `least`, or two dyes almost alike: the default
    dyes. A row of moments and the counts of `bins` ranges of the angle come to the driver, never pixels; a percentile is
    interpolated within its range.
    """
    names = (r, g, b)
    m = stain_moments(od, r, g, b, beta).first()
    if m["n"] < least:
        return default_stains()
    cov = np.array([[m[f"{p}_{q}"] if f"{p}_{q}" in m else m[f"{q}_{p}"] for q in names] for p in names])
    values, axes = np.linalg.eigh(cov)
    plane = axes[:, np.argsort(values)[-2:]]
    plane = plane * np.where(plane.sum(0) < 0, -1, 1)  # eigenvectors have no sign; densities are positive, so the angles don't wrap
    dot = lambda k: sum((F.col(c) * float(plane[i, k]) for i, c in enumerate(names)), F.lit(0.0))
    angle = F.atan2(dot(1), dot(0))
    counts = _stained(od, names, beta).groupBy(F.least(F.lit(bins - 1), F.floor((angle + math.pi) / (2 * math.pi / bins))).cast("int").alias("bin")).count().orderBy("bin").collect()
    at, k = np.array([c["bin"] for c in counts]), np.array([c["count"] for c in counts])
    before = np.cumsum(k) - k

    def percentile(share: float) -> float:
        rank = share * (m["n"] - 1)
        i = int(np.searchsorted(before, rank, "right")) - 1
        return (at[i] + min(1.0, (rank - before[i] + 0.5) / k[i])) * (2 * math.pi / bins) - math.pi

    one, two = (np.abs(plane @ [math.cos(t), math.sin(t)]) for t in (percentile(alpha / 100), percentile(1 - alpha / 100)))
    one, two = one / np.linalg.norm(one), two / np.linalg.norm(two)
    if np.linalg.norm(np.cross(one, two)) < 0.08:
        return default_stains()
    muscle, collagen = sorted((one, two), key=lambda v: v[0])
    rest = np.abs(np.cross(muscle, collagen))
    return np.stack([muscle, collagen, rest / np.linalg.norm(rest)])


def shared_stains(pixels: DataFrame, channels: tuple[str, str, str], tissue: Column | None = None) -> np.ndarray:
    """One matrix for a staining run: that of the tissue pixels of all its sections together. channels: shares of white."""
    od = pixels if tissue is None else pixels.where(tissue)
    return stain_vectors(od.select(*[optical_density(F.col(c)).alias(c) for c in channels]), *channels)


def binned(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """bin, its centre and count, over the range of a column."""
    v = finite(value)
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    width = (hi - lo) / bins if lo is not None and hi > lo else 1.0
    b = F.least(F.lit(bins - 1), F.floor((v - F.lit(lo)) / width)).cast("int")
    return df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("centre", F.lit(lo) + (F.col("bin") + 0.5) * width)


def otsu(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """The bin centre that splits a histogram with the largest variance between its sides (first of equals)."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most `bins` rows
    every = Window.partitionBy(F.lit(1))
    h = binned(df, value, bins).withColumn("w0", F.sum("n").over(w)).withColumn("s0", F.sum(F.col("n") * F.col("centre")).over(w)).withColumn("total", F.sum("n").over(every)).withColumn("s", F.sum(F.col("n") * F.col("centre")).over(every))
    w1 = F.col("total") - F.col("w0")
    gap = safe_div("s0", "w0") - safe_div(F.col("s") - F.col("s0"), w1)
    return h.withColumn("between", F.round(F.col("w0") * w1 * gap * gap, 3)).agg(F.min_by("centre", F.struct(-F.coalesce("between", F.lit(-1.0)), "bin")).alias("cut"))


def triangle(df: DataFrame, value: str, low: float, high: float, bins: int = 256) -> DataFrame:
    """The bin furthest below the line from the histogram's top to its far end, clamped."""
    h = binned(df, value, bins)
    ends = h.agg(F.min_by(F.struct("bin", "n"), F.struct(-F.col("n"), F.col("bin"))).alias("top"), F.min("bin").alias("first"), F.max("bin").alias("last"))
    h = h.join(F.broadcast(ends))  # one row
    far = F.when(F.col("last") - F.col("top.bin") >= F.col("top.bin") - F.col("first"), F.col("last")).otherwise(F.col("first"))
    x = safe_div(F.abs(F.col("bin") - F.col("top.bin")).cast("double"), F.abs(far - F.col("top.bin")).cast("double"))
    side = (F.col("bin") - F.col("top.bin")) * F.signum(far - F.col("top.bin")) >= 0
    drop = F.round((1 - x) * F.col("top.n") - F.col("n"), 6)
    return h.where(side).agg(F.min_by("centre", F.struct(-drop, "bin")).alias("cut")).select(F.greatest(F.lit(low), F.least(F.lit(high), F.col("cut"))).alias("cut"))


def mad_cut(df: DataFrame, keys: list[str], value: str, k: float = 3.0) -> DataFrame:
    """cut of each group: median + k times its robust spread, and how many values exceed it."""
    m = median_mad(df, keys, value).withColumn("cut", F.col("median") + k * F.greatest(F.col("mad"), F.lit(1e-6)))
    over = df.join(m, keys).groupBy(*keys).agg(F.max("median").alias("median"), F.max("mad").alias("mad"), F.max("cut").alias("cut"), F.count(F.when(finite(value) > F.col("cut"), 1)).alias("n_over"))
    return over


def nearest_centre(vector: str, centres: np.ndarray) -> tuple[Column, Column]:
    """Number of the nearest of a few fixed centres (first of equals) and its squared distance."""
    d = [sum(((F.col(vector)[i].cast("double") - float(c)) ** 2 for i, c in enumerate(row)), F.lit(0.0)) for row in np.asarray(centres, float)]
    all_d = F.array(*d)
    return F.array_position(all_d, F.array_min(all_d)) - 1, F.array_min(all_d)


def bic(rss: float, n: int, d: int, k: int) -> float:
    """Bayesian information criterion of k spherical clusters."""
    var = max(rss / (n * d), 1e-12)
    return n * d * (math.log(2 * math.pi * var) + 1) + (k * d + 1) * math.log(max(n, 2))


def choose_clusters(df: DataFrame, vector: str, most: int = 3, seed: int = 0) -> tuple[int, dict[int, float]]:
    """The number of clusters with the least BIC, by Spark's k-means over all rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    n, first = rows.count(), df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    if not n:
        return 1, {}
    spread = rows.select(Summarizer.metrics("variance").summary(F.col("features")).alias("s")).first()["s"]["variance"]
    scores = {1: bic(float(sum(spread)) * (n - 1), n, first[0], 1)}
    for k in range(2, min(most, n) + 1):
        model = KMeans(k=k, seed=seed, initSteps=4).fit(rows)
        scores[k] = bic(model.summary.trainingCost, n, first[0], k)
    return min(scores, key=scores.get), scores


def region_measures(pixels: DataFrame, region: str, inside: Column, collagen: str, counterstain: str, px_um: float) -> DataFrame:
    """The same measures over every region and over the whole section."""
    t, c, s = F.coalesce(inside, F.lit(False)), finite(collagen), finite(counterstain)
    area = px_um * px_um
    made = pixels.groupingSets([[F.col(region)], []], region).agg(
        F.when(F.grouping(region) == 1, "whole section").otherwise(F.col(region).cast("string")).alias("name"),
        (F.count("*") * area).alias("imaged_area_um2"), (F.count(F.when(t, 1)) * area).alias("tissue_area_um2"), (F.count(F.when(t & (c > s), 1)) * area).alias("collagen_area_um2"),
        (F.sum(F.when(t, c)) * area).alias("collagen_od_um2_total"), (F.sum(F.when(t, s)) * area).alias("muscle_od_um2_total"),
    )
    made = made.drop(region)
    return made.withColumn("collagen_to_muscle", safe_div("collagen_od_um2_total", "muscle_od_um2_total")).withColumn("collagen_area_fraction", safe_div("collagen_area_um2", "tissue_area_um2"))


def points_in_polygon(points: DataFrame, x: str, y: str, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges of a polygon; fewer than three corners hold nothing."""
    if len(polygon) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y0 != y1:
            at = x0 + (F.col(y) - y0) * ((x1 - x0) / (y1 - y0))
            crossings = crossings + (((F.lit(y0) > F.col(y)) != (F.lit(y1) > F.col(y))) & (F.col(x) < at)).cast("int")
    return crossings % 2 == 1


# Kernels on arrays, for mapInPandas over one image a row.


def gaussian(img: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return img.astype(float)
    reach = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    out = img.astype(float)
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in range(2)]
        out = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, np.pad(out, pad, mode="symmetric" if out.shape[axis] > reach else "edge"))
    return out


def high_pass(img: np.ndarray, sigma: float) -> np.ndarray:
    return img - gaussian(img, sigma)


def square_morph(mask: np.ndarray, size: int, op: str) -> np.ndarray:
    """erode, dilate, open or close with a square, by windows over running sums; the outside never erodes."""
    half = max(0, int(size) // 2)
    if op == "open":
        return square_morph(square_morph(mask, size, "erode"), size, "dilate")
    if op == "close":
        return square_morph(square_morph(mask, size, "dilate"), size, "erode")
    m = np.pad(mask.astype(np.int64), half, constant_values=int(op == "erode"))
    s = np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    w = 2 * half + 1
    count = s[w:, w:] - s[:-w, w:] - s[w:, :-w] + s[:-w, :-w]
    return count == w * w if op == "erode" else count > 0


def label(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, int]:
    """Connected components by runs in rows and union-find over them, numbered from 1 in reading order."""
    h, w = mask.shape
    padded = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    d = np.diff(padded, axis=1)
    rows, starts = np.nonzero(d == 1)
    _, ends = np.nonzero(d == -1)
    up = np.arange(len(rows))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    for r in range(1, h):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if starts[i] < ends[j] + diagonal and starts[j] < ends[i] + diagonal:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(up))], int)
    kept, number = np.unique(roots, return_inverse=True)
    out = np.zeros((h, w + 1), np.int64)
    np.add.at(out, (rows, starts), number + 1)
    np.add.at(out, (rows, ends), -(number + 1))
    return out.cumsum(1)[:, :w], len(kept)


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    lab, n = label(mask)
    return mask & (np.bincount(lab.ravel(), minlength=n + 1) >= least)[lab]


def fill_holes(mask: np.ndarray) -> np.ndarray:
    lab, n = label(~np.pad(mask, 1))
    outside = lab[0, 0]
    return (lab != outside)[1:-1, 1:-1]


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance to the nearest false pixel: exact, a lower envelope row by row after a column pass."""
    h, w = mask.shape
    far = float(h + w)
    g = np.full((h, w), far)
    run = np.full(w, far)
    for r in range(h):
        run = np.where(mask[r], run + 1, 0)
        g[r] = np.minimum(g[r], run)
    run = np.full(w, far)
    for r in range(h - 1, -1, -1):
        run = np.where(mask[r], run + 1, 0)
        g[r] = np.minimum(g[r], run)
    x = np.arange(w)
    across = (x[:, None] - x[None]) ** 2
    return np.sqrt(np.stack([(across + (row**2)[None]).min(1) for row in g]))


def bilinear(plane: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Sampled values; NaN outside."""
    h, w = plane.shape
    ok = (ys >= 0) & (xs >= 0) & (ys <= h - 1) & (xs <= w - 1)
    y0, x0 = np.clip(np.floor(ys), 0, max(h - 2, 0)).astype(int), np.clip(np.floor(xs), 0, max(w - 2, 0)).astype(int)
    fy, fx = ys - y0, xs - x0
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    v = plane[y0, x0] * (1 - fy) * (1 - fx) + plane[y1, x0] * fy * (1 - fx) + plane[y0, x1] * (1 - fy) * fx + plane[y1, x1] * fy * fx
    return np.where(ok, v, np.nan)


def resize(img: np.ndarray, scale: float) -> np.ndarray:
    """Area mean for shrinking by exact cell weights, bilinear for enlarging."""
    def weights(n: int) -> np.ndarray:
        m = max(1, round(n * scale))
        lo = np.arange(m) * n / m
        hi = lo + n / m
        if scale >= 1:
            c = np.clip((lo + hi) / 2 - 0.5, 0, n - 1)
            i = np.minimum(np.floor(c).astype(int), max(n - 2, 0))
            out = np.zeros((m, n))
            out[np.arange(m), i] = 1 - (c - i)
            out[np.arange(m), np.minimum(i + 1, n - 1)] += c - i
            return out
        k = np.arange(n)
        out = np.clip(np.minimum(hi[:, None], k + 1) - np.maximum(lo[:, None], k), 0, None)
        return out / out.sum(1, keepdims=True)

    return weights(img.shape[0]) @ img @ weights(img.shape[1]).T


def masked_ncc(a: np.ndarray, ma: np.ndarray, b: np.ndarray, mb: np.ndarray, least: float = 16) -> tuple[np.ndarray, np.ndarray]:
    """Normalised correlation of two masked images at every shift, and the overlap of each, by Fourier transforms.

    Entry [dy, dx] (modulo the padded size): b moved by (dy, dx) over a.
    """
    shape = tuple(p + q - 1 for p, q in zip(a.shape, b.shape))
    f = lambda x: np.fft.rfft2(x, shape)
    cross = lambda p, q: np.fft.irfft2(p * np.conj(q), shape)
    a, b = a * ma, b * mb
    fa, fb, fma, fmb, fa2, fb2 = f(a), f(b), f(ma.astype(float)), f(mb.astype(float)), f(a * a), f(b * b)
    n = np.maximum(cross(fma, fmb).round(), 0)
    sa, sb = cross(fa, fmb), cross(fma, fb)
    with np.errstate(all="ignore"):
        num = cross(fa, fb) - sa * sb / n
        va, vb = cross(fa2, fmb) - sa * sa / n, cross(fma, fb2) - sb * sb / n
        ncc = num / np.sqrt(np.maximum(va, 0) * np.maximum(vb, 0))
    tiny = 1e-9 * max(1.0, float(np.abs(va).max(initial=0) * 1e-3))
    return np.where((n >= least) & (va > tiny) & (vb > tiny), np.clip(ncc, -1, 1), 0.0), n


def best_shift(ncc: np.ndarray, exclusion: int = 12) -> tuple[int, int, float, float]:
    """Signed shift of the peak, its height and its ratio to the best outside a box around it."""
    h, w = ncc.shape
    y, x = np.unravel_index(int(ncc.argmax()), ncc.shape)
    signed = lambda k, n: int(k if k < (n + 1) // 2 else k - n)
    dy, dx = (np.abs((np.arange(n) - c + n // 2) % n - n // 2) for n, c in ((h, y), (w, x)))
    rest = np.where((dy[:, None] <= exclusion) & (dx[None] <= exclusion), -1.0, ncc)
    second = float(rest.max())
    return signed(y, h), signed(x, w), float(ncc[y, x]), float(ncc[y, x]) / max(second, 1e-6)


def match_tiles(pairs: DataFrame, height: str = "height", width: str = "width") -> DataFrame:
    """(i, j, tx, ty, ncc, peak_ratio) of pairs of grey tiles (i, j, a, b as float32 bytes, height, width), a pair a row."""

    def work(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                shape = (int(getattr(r, height)), int(getattr(r, width)))
                a, b = (np.frombuffer(v, "<f4").reshape(shape).astype(float) for v in (r.a, r.b))
                ncc, _ = masked_ncc(a, np.isfinite(a), b, np.isfinite(b), 0.05 * a.size)
                ty, tx, top, ratio = best_shift(ncc)
                out.append((r.i, r.j, tx, ty, top, ratio))
            yield pd.DataFrame(out, columns=["i", "j", "tx", "ty", "ncc", "peak_ratio"])

    return pairs.mapInPandas(work, "i long, j long, tx int, ty int, ncc double, peak_ratio double")


def lesions(share: np.ndarray, tissue: np.ndarray, px_um: float, min_area_um2: float = 2000.0, smooth_um: float = 25.0, k: float = 3.0) -> list[dict]:
    """Areas whose smoothed collagen share exceeds median + k robust spreads; none under 100 tissue pixels."""
    if tissue.sum() < 100:
        return []
    s = gaussian(np.where(tissue, share, 0.0), smooth_um / px_um)
    own = s[tissue]
    med = np.median(own)
    cut = med + k * max(1.4826 * float(np.median(np.abs(own - med))), 1e-6)
    lab, n = label(fill_holes(square_morph((s > cut) & tissue, 3, "open")), diagonal=True)
    areas = np.bincount(lab.ravel(), minlength=n + 1)[1:] * px_um**2
    ys, xs = np.nonzero(lab)
    cy, cx = (np.bincount(lab[ys, xs], v, n + 1)[1:] / np.maximum(np.bincount(lab[ys, xs], minlength=n + 1)[1:], 1) for v in (ys, xs))
    order = [i for i in np.argsort(-areas, kind="stable") if areas[i] >= min_area_um2]
    return [{"lesion": r, "area_um2": float(areas[i]), "x_um": float(cx[i] * px_um), "y_um": float(cy[i] * px_um), "cut": float(cut)} for r, i in enumerate(order, 1)]
