"""Zones of a section by texture and stain, with how much to believe them; one section is one group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strataline.operators.raster import bic, gaussian, square_morph


def coherence(img: np.ndarray, sigma: float) -> np.ndarray:
    """How parallel the texture is, from 0 to 1, by the structure tensor."""
    gy, gx = np.gradient(gaussian(img, 1.0))
    a, b, c = (gaussian(v, sigma) for v in (gx * gx, gx * gy, gy * gy))
    return np.sqrt((a - c) ** 2 + 4 * b * b) / np.maximum(a + c, 1e-12)


def kmeans(x: np.ndarray, k: int, seeds: int = 4, rounds: int = 50) -> np.ndarray:
    """Centres of the best of a few starts, each by distance-weighted seeding."""
    best = None
    for s in range(seeds):
        rng = np.random.default_rng(s)
        c = x[rng.integers(len(x), size=1)]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else 0]])
        for _ in range(rounds):
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        rss = float(((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())
        if best is None or rss < best[0]:
            best = (rss, c)
    return best[1]


def detect(collagen: np.ndarray, muscle: np.ndarray, nuclei: np.ndarray, tissue: np.ndarray, px_um: float, window_um: float = 160.0, least_share: float = 0.04, names: tuple[str, ...] = ("papilla", "medulla", "cortex")) -> tuple[np.ndarray, list[str], bool]:
    """Label image (0 outside tissue), names of the zones, and whether the naming is to be believed.

    Their number, up to three, has the least BIC on samples one window apart, as neighbouring pixels say the same. Small zones
    join the nearest large one. Named from parallel, collagen-rich and nucleus-poor to the opposite; if two neighbours are
    closer than a quarter of the spread, they are only numbered.
    """
    labels = np.zeros(tissue.shape, int)
    if tissue.sum() < 200:
        return labels, [], False
    sigma = max(1.0, window_um / 2 / px_um)
    inner = square_morph(tissue, 2 * max(1, int(sigma / 2)) + 1, "erode")
    share = gaussian(inner.astype(float), sigma)
    texture = gaussian(np.where(inner, coherence(collagen + muscle, max(1.0, 15 / px_um)), 0.0), sigma) / np.maximum(share, 1e-6)
    c, m = gaussian(collagen, sigma), gaussian(muscle, sigma)
    features = np.stack([np.where(share > 0.05, texture, 0.0), c / np.maximum(c + m, 1e-6), gaussian(nuclei, sigma)], 2)[tissue]
    z = (features - features.mean(0)) / np.where(features.std(0) > 1e-9, features.std(0), 1.0)
    step = max(1, round(window_um / px_um))
    grid = np.zeros(tissue.shape, bool)
    grid[::step, ::step] = True
    apart = z[grid[tissue]] if (grid & tissue).sum() >= 24 else z[:: max(1, len(z) // 400)]
    cost = lambda k: bic(float(((apart[:, None] - kmeans(apart, k)[None]) ** 2).sum(2).min(1).sum()), len(apart), 3, k)
    k = min((1, 2, 3), key=cost)
    own = ((z[:, None] - kmeans(z, k)[None]) ** 2).sum(2).argmin(1)
    votes = np.stack([gaussian(_placed(tissue, own == j), sigma / 2) for j in range(k)])
    zone = np.where(tissue, votes.argmax(0), -1)
    sizes = np.array([(zone == j).sum() for j in range(k)])
    kept = [j for j in range(k) if sizes[j] >= least_share * tissue.sum()] or [int(sizes.argmax())]
    votes[[j for j in range(k) if j not in kept]] = -1
    zone = np.where(tissue, votes.argmax(0), -1)
    means = np.array([z[zone[tissue] == j].mean(0) for j in kept])
    rank = means @ [1.0, 1.0, -1.0]
    order = np.argsort(-rank, kind="stable")
    spread = np.ptp(rank) if len(rank) > 1 else 0.0
    sure = len(kept) > 1 and bool((np.diff(np.sort(rank)) > 0.25 * spread).all()) and spread > 0.5
    for n, j in enumerate(order, 1):
        labels[zone == kept[j]] = n
    called = (names if len(kept) == 3 else (names[0], names[-1])) if sure else tuple(f"zone {n}" for n in range(1, len(kept) + 1))
    return labels, list(called[: len(kept)]), sure


def _placed(tissue: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(tissue.shape)
    out[tissue] = values
    return out


def zones(sections: DataFrame, **options) -> DataFrame:
    """A row a zone: name, area and whether its name is sure, of sections (section, height, width, px_um, collagen, muscle, nuclei as float32 bytes)."""

    def one(r: pd.Series) -> pd.DataFrame:
        c, m, n = (np.frombuffer(r[k], "<f4").reshape(int(r["height"]), int(r["width"])).astype(float) for k in ("collagen", "muscle", "nuclei"))
        labels, names, sure = detect(c, m, n, c + m + n > 0.05, float(r["px_um"]), **options)
        return pd.DataFrame([(r["section"], k, name, float((labels == k).sum()) * float(r["px_um"]) ** 2, sure) for k, name in enumerate(names, 1)], columns=["section", "zone", "name", "area_um2", "confident"])

    def each(batches):
        for pdf in batches:
            for i in range(len(pdf)):
                yield one(pdf.iloc[i])

    return sections.mapInPandas(each, f"section {dict(sections.dtypes)['section']}, zone int, name string, area_um2 double, confident boolean")
