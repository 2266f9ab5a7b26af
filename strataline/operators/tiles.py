"""Assembling overlapping tiles: registration levels, pair scores, layouts, contradictions, and moving islands together.

One mosaic is one group: its tiles travel as rows (section, tile, height, width, grey float32 bytes), the layout is solved in
one task, and mosaics spread over the cluster. What is relational (pairs, best edges, components, reports) is in graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strataline.operators.graph import place
from strataline.operators.raster import best_shift, high_pass, masked_ncc, resize


def level(img: np.ndarray, scale: float, sigma: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """A tile shrunk, without its slow background, and the mask of what it shows."""
    small = resize(np.nan_to_num(img), scale)
    mask = resize(np.isfinite(img).astype(float), scale) > 0.5
    return np.where(mask, high_pass(small, min(sigma, min(small.shape) / 4)), 0.0), mask


def subpixel(ncc: np.ndarray, y: int, x: int) -> tuple[float, float]:
    """Peak between samples by a parabola in each direction, within half a pixel."""
    h, w = ncc.shape

    def offset(a, b, c):
        bend = a - 2 * b + c
        return float(np.clip(0.5 * (a - c) / bend, -0.5, 0.5)) if bend < 0 else 0.0

    return offset(ncc[(y - 1) % h, x], ncc[y, x], ncc[(y + 1) % h, x]), offset(ncc[y, (x - 1) % w], ncc[y, x], ncc[y, (x + 1) % w])


def match(a: np.ndarray, b: np.ndarray, scale: float = 0.5, least_overlap: float = 0.05) -> dict:
    """Shift of b over a in full pixels, its correlation, its ratio to the runner-up and the share of overlap."""
    (la, ma), (lb, mb) = level(a, scale), level(b, scale)
    ncc, n = masked_ncc(la, ma, lb, mb, least_overlap * min(ma.sum(), mb.sum()))
    ty, tx, top, ratio = best_shift(ncc)
    fy, fx = subpixel(ncc, ty % ncc.shape[0], tx % ncc.shape[1])
    sy, sx = a.shape[0] / la.shape[0], a.shape[1] / la.shape[1]
    return {"tx": (tx + fx) * sx, "ty": (ty + fy) * sy, "ncc": top, "peak_ratio": ratio, "overlap": float(n[ty % n.shape[0], tx % n.shape[1]]) / max(1.0, float(min(ma.sum(), mb.sum())))}


def quality(m: dict, least: float = 0.35) -> float:
    """The same product of clipped terms as graph.edge_quality, for one pair."""
    clip = lambda v: min(1.0, max(0.0, v))
    return clip((m["ncc"] - least) / (0.85 - least)) ** 0.8 * (0.35 + 0.65 * clip((m["peak_ratio"] - 1) / 0.8)) * (0.45 + 0.55 * clip(m["overlap"] / 0.35))


def agreement(a: np.ndarray, b: np.ndarray, dx: float, dy: float) -> dict:
    """Correlation, overlap and likeness of tissue of two tiles with b at (dx, dy) in a's frame."""
    x, y = round(dx), round(dy)
    ya, xa, yb, xb = max(0, y), max(0, x), max(0, -y), max(0, -x)
    h, w = min(a.shape[0] - ya, b.shape[0] - yb), min(a.shape[1] - xa, b.shape[1] - xb)
    if h <= 0 or w <= 0:
        return {"ncc": 0.0, "area": 0, "n_both": 0, "iou": 0.0}
    p, q = a[ya : ya + h, xa : xa + w], b[yb : yb + h, xb : xb + w]
    ok = np.isfinite(p) & np.isfinite(q)
    u, v = p[ok], q[ok]
    spread = u.std() * v.std() if len(u) else 0.0
    cut = (np.nanmean(a) + np.nanmean(b)) / 2
    ta, tb = u > cut, v > cut
    either = int((ta | tb).sum())
    return {"ncc": float(((u - u.mean()) * (v - v.mean())).mean() / spread) if spread > 1e-12 else 0.0, "area": int(ok.sum()), "n_both": int((ta & tb).sum()), "iou": float((ta & tb).sum() / either) if either else 0.0}


def islands(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """Number of each tile's island, largest first, then by its first tile."""
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in edges:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(n)])
    kept, counts = np.unique(roots, return_counts=True)
    rank = {r: k for k, r in enumerate(kept[np.lexsort((kept, -counts))])}
    return np.array([rank[r] for r in roots])


def solve(n: int, edges: pd.DataFrame) -> pd.DataFrame:
    """x, y, island and residual of n tiles from edges (i, j, tx, ty, quality); a tile without edges is an island at 0."""
    own = islands(n, list(zip(edges["i"], edges["j"])))
    out = pd.DataFrame({"tile": np.arange(n), "island": own, "x": 0.0, "y": 0.0, "residual": 0.0})
    for k in np.unique(own):
        members = np.flatnonzero(own == k)
        e = edges[edges["i"].isin(members)]
        if len(e):
            at, r = place(len(members), np.searchsorted(members, e["i"]), np.searchsorted(members, e["j"]), e["tx"].to_numpy(float), e["ty"].to_numpy(float), e["quality"].to_numpy(float))
            out.loc[members, ["x", "y"]] = at
            out.loc[members, "residual"] = float(np.median(r))
    return out


def snap(images: list[np.ndarray], poses: np.ndarray, tile: int, neighbours: int = 6) -> np.ndarray:
    """Where a tile's neighbours, those with the largest overlap, would have it: their votes weighted by quality."""
    h, w = images[tile].shape
    area = [max(0.0, min(w, poses[k, 0] - poses[tile, 0] + images[k].shape[1]) - max(0.0, poses[k, 0] - poses[tile, 0])) * max(0.0, min(h, poses[k, 1] - poses[tile, 1] + images[k].shape[0]) - max(0.0, poses[k, 1] - poses[tile, 1])) if k != tile else 0.0 for k in range(len(images))]
    votes, weights = [], []
    for k in np.argsort(-np.array(area), kind="stable")[:neighbours]:
        if area[k] > 0:
            m = match(images[k], images[tile])
            votes.append(poses[k] + [m["tx"], m["ty"]])
            weights.append(quality(m))
    return np.average(votes, axis=0, weights=weights) if sum(weights) > 0 else poses[tile]


def assemble(images: list[np.ndarray], least_ncc: float = 0.35, keep: int = 6) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Scores of all pairs, those among the best of either end, and the layout by them without edges that contradict it."""
    rows = [{"i": i, "j": j, **match(images[i], images[j])} for i in range(len(images)) for j in range(i + 1, len(images))]
    edges = pd.DataFrame(rows, columns=["i", "j", "tx", "ty", "ncc", "peak_ratio", "overlap"])
    edges["quality"] = [quality(r) for r in rows]
    good = edges[(edges["ncc"] >= least_ncc) & (edges["quality"] > 0)]
    ends = pd.concat([good.assign(tile=good["i"]), good.assign(tile=good["j"])]).sort_values(["quality", "i", "j"], ascending=[False, True, True])
    best = ends.groupby("tile").head(keep)[["i", "j"]].drop_duplicates()
    good = good.merge(best, on=["i", "j"])
    layout = solve(len(images), good)
    at = layout.set_index("tile")[["x", "y"]]
    far = np.hypot(at.loc[good["j"], "x"].to_numpy() - at.loc[good["i"], "x"].to_numpy() - good["tx"], at.loc[good["j"], "y"].to_numpy() - at.loc[good["i"], "y"].to_numpy() - good["ty"])
    if len(good) and (far > 25).any():
        good = good[far <= 25]
        layout = solve(len(images), good)
    return layout, good


def stitch(tiles: DataFrame) -> DataFrame:
    """Layout of every section from tiles (section, tile, height, width, grey); one section is one group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tile")
        layout, edges = assemble([np.frombuffer(g, "<f4").reshape(h, w).astype(float) for g, h, w in zip(pdf["grey"], pdf["height"], pdf["width"])])
        degree = pd.concat([edges["i"], edges["j"]]).value_counts()
        return pd.DataFrame({"section": pdf["section"].iloc[0], "tile": pdf["tile"].to_numpy(), "x": layout["x"], "y": layout["y"], "island": layout["island"], "residual": layout["residual"], "edges": layout["tile"].map(degree).fillna(0).astype(int)})

    return tiles.groupBy("section").applyInPandas(one, f"section {dict(tiles.dtypes)['section']}, tile long, x double, y double, island int, residual double, edges int")


def render(images: list[np.ndarray], poses: np.ndarray, feather: float = 40.0, mode: str = "feather") -> np.ndarray:
    """The mosaic: weighted by distance to the tiles' borders, or the least value; NaN where no tile is."""
    x0, y0 = np.floor(poses.min(0))
    h = int(max(np.ceil(p[1] - y0) + i.shape[0] for p, i in zip(poses, images)))
    w = int(max(np.ceil(p[0] - x0) + i.shape[1] for p, i in zip(poses, images)))
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    low = np.full((h, w), np.inf)
    for (x, y), img in zip(poses, images):
        a, b = round(y - y0), round(x - x0)
        ramp = lambda n: np.minimum(1.0, np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)) / max(feather, 1.0))
        k = np.where(np.isfinite(img), np.outer(ramp(img.shape[0]), ramp(img.shape[1])), 0.0)
        part = np.s_[a : a + img.shape[0], b : b + img.shape[1]]
        total[part] += k * np.nan_to_num(img)
        weight[part] += k
        low[part] = np.minimum(low[part], np.where(np.isfinite(img), img, np.inf))
    with np.errstate(all="ignore"):
        return np.where(np.isfinite(low), low, np.nan) if mode == "min" else np.where(weight > 0, total / weight, np.nan)
