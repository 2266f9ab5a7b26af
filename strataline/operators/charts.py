"""What charts show: cumulative shares, survival, contingency, volcano classes, sets, fitted curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.core import finite, safe_div
from strataline.functions.ordering import numbered


def ecdf(df: DataFrame, group: str, value: str) -> DataFrame:
    """A step for each distinct value of a group: the share of its values up to there."""
    rows = df.withColumn("x", finite(value)).where("x is not null").groupBy(group, "x").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    return rows.select(group, "x", (F.sum("n").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)).alias("share"))


def ks_distance(df: DataFrame, group: str, value: str, first: str) -> DataFrame:
    """Largest distance of each group's step function from the first group's, over all their values, with both sizes."""
    rows = df.withColumn("x", finite(value)).where("x is not null").groupBy(group, "x").agg(F.count("*").alias("n"))
    mine = rows.where(F.col(group) == first).select("x", F.col("n").alias("n_first"))
    others = rows.where(F.col(group) != first)
    # the first group's steps once for each other group, whose number is the number of labels
    labels = others.select(group).distinct()
    steps = others.select(group, "x", "n", F.lit(0).cast("long").alias("n_first")).union(mine.join(F.broadcast(labels)).select(group, "x", F.lit(0).cast("long"), "n_first"))
    steps = steps.groupBy(group, "x").agg(F.sum("n").alias("n"), F.sum("n_first").alias("n_first"))
    w = Window.partitionBy(group)
    run = w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("n").over(run) / F.sum("n").over(w) - F.sum("n_first").over(run) / F.sum("n_first").over(w))
    return steps.withColumn("gap", gap).groupBy(group).agg(F.max("gap").alias("d"), F.sum("n").alias("n"), F.sum("n_first").alias("n_first"))


def kaplan_meier(df: DataFrame, group: str, time: str, event: str | Column) -> DataFrame:
    """By group and time: at risk, events, censored, and the share surviving."""
    e = F.col(event) if isinstance(event, str) else event
    at = df.where(F.col(time).isNotNull()).groupBy(group, time).agg(F.count(F.when(e, 1)).alias("events"), F.count(F.when(~F.coalesce(e, F.lit(False)), 1)).alias("censored"))
    w = Window.partitionBy(group)
    risk = F.sum(F.col("events") + F.col("censored")).over(w.orderBy(time).rowsBetween(0, Window.unboundedFollowing))
    made = at.withColumn("at_risk", risk)
    # a product of shares as a sum of logs; once nobody is left it is 0
    alive = F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk")))
    run = w.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    gone = F.max((F.col("events") >= F.col("at_risk")).cast("int")).over(run)
    return made.withColumn("survival", F.when(gone == 1, 0.0).otherwise(F.exp(F.sum(F.coalesce(alive, F.lit(0.0))).over(run))))


def logrank(df: DataFrame, group: str, time: str, event: str | Column, first: str) -> DataFrame:
    """Chi squared (one degree of freedom) of every other group against the first."""
    e = F.col(event) if isinstance(event, str) else event
    at = df.where(F.col(time).isNotNull()).groupBy(group, time).agg(F.count(F.when(e, 1)).alias("d"), F.count("*").alias("k"))
    others = at.where(F.col(group) != first).select(group, time, "d", "k", F.lit(0).cast("long").alias("d0"), F.lit(0).cast("long").alias("k0"))
    labels = others.select(group).distinct()
    base = at.where(F.col(group) == first).select(time, F.col("d").alias("d0"), F.col("k").alias("k0"))
    both = others.union(base.join(F.broadcast(labels)).select(group, time, F.lit(0).cast("long"), F.lit(0).cast("long"), "d0", "k0"))
    both = both.groupBy(group, time).agg(*[F.sum(c).alias(c) for c in ("d", "k", "d0", "k0")])
    after = Window.partitionBy(group).orderBy(time).rowsBetween(0, Window.unboundedFollowing)
    r = both.withColumn("n1", F.sum("k").over(after)).withColumn("n", F.sum(F.col("k") + F.col("k0")).over(after)).withColumn("dd", F.col("d") + F.col("d0"))
    expected = F.col("dd") * F.col("n1") / F.col("n")
    var = F.when(F.col("n") > 1, F.col("dd") * F.col("n1") / F.col("n") * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("dd")) / (F.col("n") - 1)).otherwise(0.0)
    return r.groupBy(group).agg(F.sum("d").alias("observed"), F.sum(expected).alias("expected"), safe_div(F.pow(F.sum(F.col("d") - expected), F.lit(2)), F.sum(var)).alias("chi2"))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts and percent of the row's total; rows without any are absent."""
    made = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").alias("n"))
    return made.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def chi_squared(df: DataFrame, row: str, column: str) -> DataFrame:
    """chi2 and its degrees of freedom; cells that never occur count with their expectation."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").cast("double").alias("n"))
    cells = cells.withColumn("r", F.sum("n").over(Window.partitionBy(row))).withColumn("c", F.sum("n").over(Window.partitionBy(column)))
    # sum (n - e)^2 / e over all cells is N (sum n^2 / (r c) - 1): absent cells need no row
    made = cells.agg(F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("q"), F.sum("n").alias("total"), F.count_distinct(row).alias("rows"), F.count_distinct(column).alias("columns"))
    return made.select(F.col("total").cast("long").alias("n"), (F.col("total") * (F.col("q") - 1)).alias("chi2"), ((F.col("rows") - 1) * (F.col("columns") - 1)).alias("df"))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: tables no likelier than the one seen."""
    from strataline.functions.dist import log_gamma

    n, r, k = a + b + c + d, a + b, a + c
    x = np.arange(max(0, r + k - n), min(r, k) + 1)
    choose = lambda p, q: log_gamma(p + 1.0) - log_gamma(q + 1.0) - log_gamma(p - q + 1.0)
    logs = choose(np.full(len(x), k), x) + choose(np.full(len(x), n - k), r - x) - choose(float(n), float(r))
    return float(min(1.0, np.exp(logs[logs <= logs[x == a][0] + 1e-7]).sum()))


def volcano(df: DataFrame, name: str, change: str, p: str, cut: float, p_cut: float, top: int = 10) -> DataFrame:
    """Class of each row (up, down, ns), minus log p, and whether it is among the `top` smallest p of the hits."""
    rows = df.where((F.col(p) > 0) & F.col(change).isNotNull())
    hit = F.when((F.col(change) >= cut) & (F.col(p) < p_cut), "up").when((F.col(change) <= -cut) & (F.col(p) < p_cut), "down").otherwise("ns")
    made = rows.withColumn("class", hit).withColumn("minus_log10_p", -F.log10(p))
    best = made.where("class != 'ns'").orderBy(p, name).limit(top).select(F.col(name).alias("best_name"))  # at most `top` rows
    return made.join(F.broadcast(best), F.col(name) == F.col("best_name"), "left").select(name, change, p, "class", "minus_log10_p", F.col("best_name").isNotNull().alias("labelled"))


def member_patterns(df: DataFrame, set_name: str, item: str, top: int | None = None) -> DataFrame:
    """Number of items that are in exactly these sets, largest first."""
    each = df.where(F.col(item).isNotNull()).select(set_name, item).distinct().groupBy(item).agg(F.array_join(F.array_sort(F.collect_list(F.col(set_name).cast("string"))), " & ").alias("pattern"), F.count("*").alias("degree"))
    made = each.groupBy("pattern").agg(F.count("*").alias("n"), F.max("degree").alias("degree"))
    return made.orderBy(F.col("n").desc(), "pattern").limit(top) if top else made


def venn(df: DataFrame, set_name: str, item: str, sets: list[str]) -> DataFrame:
    """Exclusive regions of two or three sets."""
    if not 2 <= len(sets) <= 3:
        raise ValueError("two or three sets")
    return member_patterns(df.where(F.col(set_name).isin(*sets)), set_name, item)


def linear_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares line with r squared; NULL under three points or without spread in x."""
    a, b = finite(x), finite(y)
    use = a.isNotNull() & b.isNotNull()
    a, b = F.when(use, a), F.when(use, b)
    ok = (F.count(a) > 2) & (F.var_pop(a) > 0)
    made = df.groupBy(*keys).agg(F.count(a).alias("n"), F.when(ok, F.regr_slope(b, a)).alias("slope"), F.when(ok, F.regr_intercept(b, a)).alias("intercept"), F.when(ok, F.regr_r2(b, a)).alias("r2"))
    return made


def _hill(x, p):
    return p[0] + (p[1] - p[0]) / (1 + (np.maximum(x, 1e-300) / p[2]) ** -p[3])


def _boltzmann(x, p):
    return p[0] + (p[1] - p[0]) / (1 + np.exp(np.clip(-(x - p[2]) / p[3], -700, 700)))


def _exponential(x, p):
    return p[0] + p[1] * np.exp(np.clip(-x / p[2], -700, 700))


MODELS = {
    "linear": (lambda x, p: p[0] + p[1] * x, ("intercept", "slope"), lambda x, y: [y.mean(), 0.0]),
    "hill": (_hill, ("bottom", "top", "half", "slope"), lambda x, y: [y.min(), y.max(), max(np.median(x), 1e-9), 1.0]),
    "boltzmann": (_boltzmann, ("bottom", "top", "half", "slope"), lambda x, y: [y.min(), y.max(), np.median(x), max(np.ptp(x) / 10, 1e-9)]),
    "exp": (_exponential, ("offset", "amplitude", "tau"), lambda x, y: [y[-1], y[0] - y[-1], max(np.ptp(x) / 3, 1e-9)]),
}


def fit_curve(x: np.ndarray, y: np.ndarray, model: str, sem: np.ndarray | None = None, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Parameters and r squared by Levenberg-Marquardt with a numeric Jacobian; more points than parameters are needed."""
    f, names, guess = MODELS[model]
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    if len(x) <= len(names):
        raise ValueError(f"{model} needs more than {len(names)} points")
    w = 1 / np.maximum(np.asarray(sem, float)[order], 1e-12) if sem is not None else np.ones(len(x))
    p, damp = np.array(guess(x, y), float), 1e-3
    with np.errstate(all="ignore"):
        cost = float((((f(x, p) - y) * w) ** 2).sum())
        for _ in range(rounds):
            step = np.maximum(np.abs(p), 1e-6) * 1e-6
            jac = np.stack([(f(x, p + step * e) - f(x, p - step * e)) / (2 * s) for e, s in zip(np.eye(len(p)), step)], 1) * w[:, None]
            r = (f(x, p) - y) * w
            a = jac.T @ jac
            move = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), -jac.T @ r, rcond=None)[0]
            new = float((((f(x, p + move) - y) * w) ** 2).sum())
            if np.isfinite(new) and new < cost:
                done = cost - new <= 1e-14 * max(cost, 1e-300)
                p, cost, damp = p + move, new, damp / 3
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
    total = float(((y - y.mean()) ** 2).sum())
    return p, 1 - float(((f(x, p) - y) ** 2).sum()) / total if total > 0 else float("nan")


def curve_fit(df: DataFrame, keys: list[str], x: str, y: str, model: str, sem: str | None = None) -> DataFrame:
    """fit_curve of every group (a curve's points): parameters by name, r2, n, message."""
    names = MODELS[model][1]
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{n} double" for n in names), "r2 double, n long, message string"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        use = pdf[[x, y, *([sem] if sem else [])]].astype(float).replace([np.inf, -np.inf], np.nan).dropna()
        row = {k: pdf[k].iloc[0] for k in keys} | dict.fromkeys(names) | {"r2": None, "n": len(use), "message": None}
        try:
            p, r2 = fit_curve(use[x].to_numpy(), use[y].to_numpy(), model, use[sem].to_numpy() if sem else None)
            row |= dict(zip(names, map(float, p))) | {"r2": r2}
        except ValueError as e:
            row["message"] = str(e)
        return pd.DataFrame([row])

    return df.groupBy(*keys).applyInPandas(one, schema)


def error_bars(df: DataFrame, keys: list[str], value: str, error: str = "sem", centre: str = "mean") -> DataFrame:
    """Centre and half-length of error bars: sd, sem, ci95 or none."""
    from strataline.functions.dist import t_quantile

    v = finite(value)
    made = df.groupBy(*keys).agg(F.count(v).alias("n"), (F.avg(v) if centre == "mean" else F.median(v)).alias("centre"), F.stddev_samp(v).alias("sd"))
    sem = F.col("sd") / F.sqrt("n")
    if error == "ci95":
        ns = [r["n"] for r in made.select("n").distinct().collect() if r["n"] > 1]  # distinct group sizes
        factor = F.create_map(*[F.lit(z) for n in ns for z in (n, t_quantile(0.975, n - 1))])[F.col("n")] if ns else F.lit(None)
        sem = F.when(F.col("n") > 1, sem * factor).otherwise(0.0)
    half = {"sd": F.col("sd"), "sem": sem, "ci95": sem, "none": F.lit(None).cast("double")}[error]
    return made.select(*keys, "n", "centre", half.alias("error"))


def ordered_names(df: DataFrame, name: str, at: str, preferred: list[str]) -> DataFrame:
    """position: preferred names first in their order, the rest as they came."""
    pref = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(name)) if preferred else F.lit(0)
    known = F.when(pref > 0, pref).otherwise(len(preferred) + 1)
    return df.withColumn("position", F.row_number().over(Window.orderBy(known, at)))  # a row a series of one figure


def matrix_of(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A row a name, a column each label: means. Labels are the columns of one figure."""
    return df.groupBy(row).pivot(column).agg(F.avg(finite(value)))


def leaf_order(m: np.ndarray) -> list[int]:
    """Rows in the order in which average linkage by Euclidean distance joins them; gaps count as the mean of all values."""
    m = np.asarray(m, float)
    m = np.where(np.isnan(m), np.nanmean(m) if np.isfinite(m).any() else 0.0, m)
    if len(m) < 2:
        return list(range(len(m)))
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    groups = {i: [i] for i in range(len(m))}
    while len(groups) > 1:
        live = sorted(groups)
        sub = d[np.ix_(live, live)]
        a, b = (live[k] for k in np.unravel_index(int(sub.argmin()), sub.shape))
        a, b = min(a, b), max(a, b)
        na, nb = len(groups[a]), len(groups[b])
        d[a] = d[:, a] = (na * d[a] + nb * d[b]) / (na + nb)  # mean distance of all pairs
        d[a, a] = np.inf
        groups[a] += groups.pop(b)
    return groups[0]


def families(df: DataFrame, at: str, keys: list[str], name: str = "family", block_rows: int = 100_000) -> DataFrame:
    """Number of the run of consecutive rows that share the keys: rows of one figure, in its order.

    Neighbours meet by their numbers; starts of runs are counted within blocks of rows, and from block to block.
    """
    rows = numbered(df, [F.col(at)], "family_at").withColumn("family_block", (F.col("family_at") / block_rows).cast("long"))
    key = F.struct(*keys)
    before = rows.select((F.col("family_at") + 1).alias("family_at"), key.alias("family_key"))
    rows = rows.join(before, "family_at", "left").withColumn("family_start", (~F.coalesce(F.col("family_key").eqNullSafe(key), F.lit(False))).cast("int"))
    blocks = rows.groupBy("family_block").agg(F.sum("family_start").alias("n"))
    blocks = blocks.select("family_block", (F.sum("n").over(Window.orderBy("family_block")) - F.col("n")).alias("family_before"))  # a row a block
    inside = F.sum("family_start").over(Window.partitionBy("family_block").orderBy("family_at"))
    return rows.withColumn("family_inside", inside).join(blocks, "family_block").withColumn(name, F.col("family_before") + F.col("family_inside")).drop("family_at", "family_block", "family_key", "family_start", "family_before", "family_inside")


def limits(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Shared axis limits of facets."""
    return df.groupBy(*keys).agg(*[f(finite(v)).alias(f"{v}_{n}") for v in values for n, f in (("min", F.min), ("max", F.max))])
