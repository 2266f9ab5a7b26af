"""Comparisons of groups: pair plans, rank and moment tests, effect sizes, multiplicity correction, factorial designs."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import dist
from strataline.functions.core import finite, safe_div
from strataline.functions.scratch import saved

# Spellings of the tests.
TESTS = {
    "mann-whitney": "mann-whitney", "mannwhitney": "mann-whitney", "mwu": "mann-whitney", "mann-whitney u": "mann-whitney",
    "wilcoxon": "wilcoxon", "signed-rank": "wilcoxon", "welch": "welch", "t-welch": "welch", "t": "welch",
    "student": "student", "t-test": "student", "ttest": "student", "paired-t": "paired-t", "paired": "paired-t",
}
PAIRED = ("wilcoxon", "paired-t")


def resolve_test(name: str) -> str:
    try:
        return TESTS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown test: {name!r}; known: {', '.join(sorted(set(TESTS.values())))}") from None


def by_unit(df: DataFrame, value: str, keys: list[str], unit: str | None) -> DataFrame:
    """Finite values; with a unit, its mean stands for all of its rows."""
    rows = df.withColumn(value, finite(F.col(value).try_cast("double"))).where(F.col(value).isNotNull())
    return rows.groupBy(*keys, unit).agg(F.avg(value).alias(value)) if unit else rows.select(*keys, value)


def describe_groups(df: DataFrame, value: str, group: str, within: str | None = None, unit: str | None = None) -> DataFrame:
    keys = [*([within] if within else []), group]
    made = by_unit(df, value, keys, unit).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.median(value).alias("median"))
    return made.withColumn("sem", F.col("sd") / F.sqrt("n"))


def level_pairs(levels: DataFrame, level: str, order: str, how: str = "all", control: str | None = None, within: list[str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b) to compare. levels: a row a level with its order.

    all: every pair in order; adjacent: neighbours; control: every other level with the control, which stands second; given: the
    rows of pairs (a, b) of which both are levels of a block and differ, each once and with its sides as given.
    """
    within = within or []
    if how == "given":
        if pairs is None:
            raise ValueError("pairs are needed")
        first, second = (levels.select(*within, F.col(level).alias(side)).distinct() for side in "ab")
        return pairs.select("a", "b").where("a != b").distinct().join(first, "a").join(second, [*within, "b"]).select(*within, "a", "b")
    a = levels.select(*within, F.col(level).alias("a"), F.col(order).alias("a_order"))
    b = levels.select(*within, F.col(level).alias("b"), F.col(order).alias("b_order"))
    if how == "all":
        on = F.col("a_order") < F.col("b_order")
    elif how == "adjacent":
        rank = Window.partitionBy(*within).orderBy(order)
        return levels.select(*within, F.col(level).alias("a"), F.lead(level).over(rank).alias("b")).where("b is not null")
    elif how == "control":
        on = (F.col("b") == F.lit(control)) & (F.col("a") != F.lit(control))
    else:
        raise ValueError(f"unknown pairs: {how!r}")
    # levels are the few labels of a factor, a proven few rows a block
    joined = a.join(b, within) if within else a.join(b, on)
    return joined.where(on).select(*within, "a", "b")


def average_rank(value: Column | str, *partition: str) -> Column:
    """Rank within a partition; ties share their mean rank."""
    v = F.col(value) if isinstance(value, str) else value
    return F.rank().over(Window.partitionBy(*partition).orderBy(v)) + (F.count("*").over(Window.partitionBy(*partition, v)) - 1) / 2


def pair_moments(rows: DataFrame, value: str, group: str, keys: list[str]) -> DataFrame:
    """For each pair of groups a < b in a block: n, mean, variance and median of both sides, from one aggregate a group."""
    m = rows.groupBy(*keys, group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.median(value).alias("median"))
    a, b = (m.select(*keys, F.col(group).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "mean", "var", "median")]) for s in "ab")
    return (a.join(b, keys) if keys else a.crossJoin(b)).where("a < b")


def mann_whitney(rows: DataFrame, value: str, group: str, a: str, b: str, keys: list[str]) -> DataFrame:
    """U of a against b in each block, Cliff's delta, and z with the tie correction and continuity correction.

    One shuffle: ranks come from a window over the block. p: exact for small samples without ties, else from z.
    """
    two = rows.where(F.col(group).isin(a, b)).withColumn("rank", average_rank(value, *keys)).withColumn("ties", F.count("*").over(Window.partitionBy(*keys, value)))
    mine = F.col(group) == a
    s = two.groupBy(*keys).agg(F.sum(F.when(mine, F.col("rank"))).alias("r_a"), F.count(F.when(mine, 1)).alias("n_a"), F.count(F.when(~mine, 1)).alias("n_b"), F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("tie_sum"))
    s = s.withColumn("u", F.col("r_a") - F.col("n_a") * (F.col("n_a") + 1) / 2).withColumn("delta", safe_div(2 * F.col("u"), F.col("n_a") * F.col("n_b")) - 1)
    n = F.col("n_a") + F.col("n_b")
    var = F.col("n_a") * F.col("n_b") / 12 * (n + 1 - safe_div(F.col("tie_sum"), n * (n - 1)))
    centre = F.col("u") - F.col("n_a") * F.col("n_b") / 2
    return s.withColumn("z", safe_div(F.greatest(F.abs(centre) - 0.5, F.lit(0.0)), F.sqrt(var)) * F.signum(centre)).drop("r_a")


def hedges_g(mean_a, mean_b, var_a, var_b, n_a, n_b) -> Column:
    n = n_a + n_b
    sd = F.sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n - 2))
    return F.when((n_a > 1) & (n_b > 1), safe_div(mean_a - mean_b, sd) * (1 - 3 / (4 * n - 9)))


def welch(mean_a, mean_b, var_a, var_b, n_a, n_b) -> tuple[Column, Column]:
    """t and its degrees of freedom."""
    qa, qb = var_a / n_a, var_b / n_b
    ok = (n_a > 1) & (n_b > 1) & (qa + qb > 0)
    return F.when(ok, (mean_a - mean_b) / F.sqrt(qa + qb)), F.when(ok, (qa + qb) ** 2 / (qa**2 / (n_a - 1) + qb**2 / (n_b - 1)))


def student(mean_a, mean_b, var_a, var_b, n_a, n_b) -> tuple[Column, Column]:
    pooled = ((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)
    ok = (n_a > 1) & (n_b > 1) & (pooled > 0)
    return F.when(ok, (mean_a - mean_b) / F.sqrt(pooled * (1 / n_a + 1 / n_b))), F.when(ok, (n_a + n_b - 2).cast("double"))


def align_pairs(df: DataFrame, value: str, group: str, a: str, b: str, unit: str, keys: list[str] | None = None) -> DataFrame:
    """One row a unit with its mean under a and under b; incomplete units have a NULL and `complete` false."""
    keys = keys or []
    mean = lambda g: F.avg(F.when(F.col(group) == g, finite(F.col(value).try_cast("double"))))
    made = df.where(F.col(group).isin(a, b)).groupBy(*keys, unit).agg(mean(a).alias("value_a"), mean(b).alias("value_b"))
    return made.withColumn("complete", F.col("value_a").isNotNull() & F.col("value_b").isNotNull())


def align_all_pairs(df: DataFrame, value: str, group: str, unit: str, keys: list[str] | None = None, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """align_pairs for every pair of levels a < b, or those given: columns a and b come before the unit.

    One aggregate a unit and level, whatever the number of pairs; a unit has a mean for each of a factor's few levels.
    """
    keys = keys or []
    means = df.groupBy(*keys, unit, group).agg(F.avg(finite(F.col(value).try_cast("double"))).alias("m"))
    if pairs is None:
        pairs = list(combinations(sorted(r[0] for r in means.select(group).where(F.col(group).isNotNull()).distinct().collect()), 2))  # labels of a factor
    each = means.groupBy(*keys, unit).agg(F.map_from_entries(F.collect_list(F.when(F.col(group).isNotNull(), F.struct(group, "m")))).alias("means"))
    if not pairs:
        return each.select(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), *keys, unit, F.lit(0.0).alias("value_a"), F.lit(0.0).alias("value_b"), F.lit(False).alias("complete")).limit(0)
    asked = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])).alias("p")
    rows = each.select(*keys, unit, "means", asked).where(F.map_contains_key("means", F.col("p.a")) | F.map_contains_key("means", F.col("p.b")))
    made = rows.select("p.a", "p.b", *keys, unit, F.try_element_at("means", F.col("p.a")).alias("value_a"), F.try_element_at("means", F.col("p.b")).alias("value_b"))
    return made.withColumn("complete", F.col("value_a").isNotNull() & F.col("value_b").isNotNull())


def paired_t(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """n, dropped, mean difference, sd, t and df of a - b over complete pairs."""
    d = F.when(F.col("complete"), F.col("value_a") - F.col("value_b"))
    made = pairs.groupBy(*keys).agg(F.count(d).alias("n"), F.count(F.when(~F.col("complete"), 1)).alias("dropped"), F.avg(d).alias("difference"), F.stddev_samp(d).alias("sd"))
    return made.withColumn("t", safe_div("difference", F.col("sd") / F.sqrt("n"))).withColumn("df", F.when(F.col("n") > 1, (F.col("n") - 1).cast("double")))


def pooled_paired_t(pairs: DataFrame, keys: list[str], ratio: bool = False, family: list[str] | None = None) -> DataFrame:
    """Paired comparisons that share one variance over all blocks; with ratio, of logs, which needs one sign in a block.

    effect: mean difference, or geometric mean ratio. family: the keys within which blocks share their variance (default: none).
    """
    family = family or []
    both = pairs.where("complete")
    if ratio:
        both = both.withColumn("d", F.when((F.col("value_a") > 0) & (F.col("value_b") > 0), F.log(F.col("value_a") / F.col("value_b"))))
        bad = F.count(F.when(F.col("d").isNull(), 1)) > 0
    else:
        both = both.withColumn("d", F.col("value_a") - F.col("value_b"))
        bad = F.lit(False)
    m = both.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), (F.var_samp("d") * (F.count("d") - 1)).alias("ss"), bad.alias("mixed")).where("not mixed and n > 1")
    shared = m.groupBy(*family).agg(F.sum("ss").alias("ss_all"), F.sum(F.col("n") - 1).cast("double").alias("df"))
    made = m.join(shared, family) if family else m.join(F.broadcast(shared))  # one row
    made = made.withColumn("t", safe_div("mean", F.sqrt(F.col("ss_all") / F.col("df")) / F.sqrt("n"))).withColumn("effect", F.exp("mean") if ratio else F.col("mean"))
    return made.select(*keys, "n", "effect", "t", "df")


def adjust(df: DataFrame, p: str, how: str, family: list[str] | None = None, order: str | None = None) -> DataFrame:
    """p_adjusted over each family (default: all rows): fdr_bh, holm, bonferroni or none. NULL p stays NULL and isn't counted.

    A family is one table of results, so its window is one partition; give the columns of larger families.
    """
    family = family or []
    usable = F.col(p).isNotNull() & ~F.isnan(p)
    rows = df.withColumn("p_used", F.when(usable, F.col(p)))
    tie = [F.col(order)] if order else []
    every = Window.partitionBy(*family, F.col("p_used").isNull())
    m = F.count("p_used").over(every)
    rank = F.row_number().over(every.orderBy("p_used", *tie))
    if how == "fdr_bh":
        made = rows.withColumn("scaled", F.col("p_used") * m / rank).withColumn("p_adjusted", F.least(F.lit(1.0), F.min("scaled").over(every.orderBy(F.col("p_used").desc(), *[t.desc() for t in tie]).rowsBetween(Window.unboundedPreceding, 0))))
    elif how == "holm":
        made = rows.withColumn("scaled", F.col("p_used") * (m - rank + 1)).withColumn("p_adjusted", F.least(F.lit(1.0), F.max("scaled").over(every.orderBy("p_used", *tie).rowsBetween(Window.unboundedPreceding, 0))))
    elif how == "bonferroni":
        made = rows.withColumn("scaled", F.col("p_used") * m).withColumn("p_adjusted", F.least(F.lit(1.0), F.col("scaled")))
    elif how == "none":
        return rows.withColumn("p_adjusted", F.col("p_used")).drop("p_used")
    else:
        raise ValueError(f"unknown correction: {how!r}")
    return made.withColumn("p_adjusted", F.when(F.col("p_used").isNotNull(), F.col("p_adjusted"))).drop("p_used", "scaled")


def stars(p: Column) -> Column:
    out = F.lit("ns")
    for cut, mark in ((0.05, "*"), (0.01, "**"), (0.001, "***"), (1e-4, "****"), (1e-5, "*****")):
        out = F.when(p < cut, F.lit(mark)).otherwise(out)
    return F.when(p.isNotNull() & ~F.isnan(p), out)


def format_p(p: Column) -> Column:
    """As printed: below 0.001 as a bound, else three decimals."""
    return F.when(p < 0.001, F.lit("p < 0.001")).when(p.isNotNull(), F.concat(F.lit("p = "), F.format_string("%.3f", p)))


_RESULT = "a string, b string, n_a long, n_b long, dropped long, median_a double, median_b double, difference double, statistic double, df double, p double, effect double, message string"


def _run(test: str, x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float, str | None]:
    """statistic, df, p, effect, message of one comparison."""
    nan = float("nan")
    if len(x) < 2 or len(y) < 2:
        return nan, nan, nan, nan, "fewer than two values on one side"
    if test == "mann-whitney":
        both = np.concatenate([x, y])
        _, where, counts = np.unique(both, return_inverse=True, return_counts=True)
        ends = np.cumsum(counts)
        rank = (ends - (counts - 1) / 2)[where]
        u = rank[: len(x)].sum() - len(x) * (len(x) + 1) / 2
        delta = 2 * u / (len(x) * len(y)) - 1
        if (counts == 1).all() and min(len(x), len(y)) <= 8:
            return u, nan, dist.mann_whitney_exact(u, len(x), len(y)), delta, None
        n = len(both)
        sd = np.sqrt(len(x) * len(y) / 12 * (n + 1 - (counts**3 - counts).sum() / (n * (n - 1))))
        if sd == 0:
            return u, nan, 1.0, delta, "all values are equal"
        z = max(0.0, abs(u - len(x) * len(y) / 2) - 0.5) / sd
        return u, nan, float(dist.normal_sf2(z)), delta, None
    if test in PAIRED:
        d = x - y
        if test == "wilcoxon":
            d = d[d != 0]
            if not len(d):
                return nan, nan, nan, nan, "all pairs are identical"
            _, where, counts = np.unique(np.abs(d), return_inverse=True, return_counts=True)
            rank = (np.cumsum(counts) - (counts - 1) / 2)[where]
            up, down = rank[d > 0].sum(), rank[d < 0].sum()
            w, n = min(up, down), len(d)
            if (counts == 1).all() and n <= 50 and n == len(x):
                return w, nan, dist.wilcoxon_exact(w, n), (up - down) / (n * (n + 1) / 2), None
            sd = np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48)
            return w, nan, float(dist.normal_sf2((w - n * (n + 1) / 4) / sd)), (up - down) / (n * (n + 1) / 2), None
        sd = d.std(ddof=1)
        if sd == 0:
            return nan, nan, nan, nan, "all differences are equal"
        t = d.mean() / (sd / np.sqrt(len(d)))
        return t, len(d) - 1, float(dist.t_sf2(t, len(d) - 1)), d.mean() / sd, None
    va, vb, na, nb = x.var(ddof=1), y.var(ddof=1), len(x), len(y)
    pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    if pooled == 0:
        return nan, nan, nan, nan, "no variance"
    g = (x.mean() - y.mean()) / np.sqrt(pooled) * (1 - 3 / (4 * (na + nb) - 9))
    if test == "student":
        t, df = (x.mean() - y.mean()) / np.sqrt(pooled * (1 / na + 1 / nb)), na + nb - 2
    else:
        qa, qb = va / na, vb / nb
        t, df = (x.mean() - y.mean()) / np.sqrt(qa + qb), (qa + qb) ** 2 / (qa**2 / (na - 1) + qb**2 / (nb - 1))
    return t, df, float(dist.t_sf2(t, df)), g, None


def compare(df: DataFrame, value: str, group: str, how: str = "all", test: str = "mann-whitney", alpha: float = 0.05, correction: str = "fdr_bh", pair_on: str | None = None, within: str | None = None, unit: str | None = None, control: str | None = None) -> DataFrame:
    """Every asked pair of levels in every block, with the family of all of them corrected together.

    Levels in order of their names. difference is of medians, a - b, whatever the test. One task sees one pair of one block.
    """
    test = resolve_test(test)
    if test in PAIRED and not pair_on:
        raise ValueError(f"{test} needs pair_on")
    for c in (value, group, within, unit, pair_on):
        if c and c not in df.columns:
            raise ValueError(f"no column {c!r}")
    keys = [within] if within else []
    rows = by_unit(df.withColumn(group, F.col(group).cast("string")), value, [*keys, group, *([pair_on] if pair_on and pair_on != unit else [])], unit)
    plan = level_pairs(rows.select(*keys, group).distinct().withColumn("level_order", F.col(group)), group, "level_order", how, control, keys)
    on = [rows[k].eqNullSafe(plan[k]) for k in keys] + [(rows[group] == plan["a"]) | (rows[group] == plan["b"])]
    dealt = rows.join(F.broadcast(plan), on).select(*[rows[k].alias(k) for k in keys], "a", "b", (rows[group] == plan["a"]).alias("first"), *([pair_on] if pair_on else []), rows[value].cast("double").alias("value"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        dropped = 0
        if test in PAIRED:
            wide = pdf.groupby([pair_on, "first"])["value"].mean().unstack("first").reindex(columns=[True, False])
            whole = wide.dropna()
            dropped = len(wide) - len(whole)
            x, y = whole[True].to_numpy(float), whole[False].to_numpy(float)
        else:
            x, y = pdf.loc[pdf["first"], "value"].to_numpy(float), pdf.loc[~pdf["first"], "value"].to_numpy(float)
        statistic, dof, p, effect, message = _run(test, x, y)
        med = [float(np.median(v)) if len(v) else float("nan") for v in (x, y)]
        head = {k: pdf[k].iloc[0] for k in (*keys, "a", "b")}
        return pd.DataFrame([{**head, "n_a": len(x), "n_b": len(y), "dropped": dropped, "median_a": med[0], "median_b": med[1], "difference": med[0] - med[1], "statistic": statistic, "df": dof, "p": p, "effect": effect, "message": message}])

    schema = ", ".join([*(f"{k} {dict(rows.dtypes)[k]}" for k in keys), _RESULT])
    made = dealt.groupBy(*keys, "a", "b").applyInPandas(one, schema)
    made = made.withColumns({c: finite(c) for c in ("median_a", "median_b", "difference", "statistic", "df", "p", "effect")})
    made = adjust(made.withColumn("pair", F.concat_ws("\0", *keys, "a", "b")), "p", correction, order="pair").drop("pair")
    return made.withColumn("test", F.lit(test)).withColumn("significant", F.coalesce(F.col("p_adjusted") < alpha, F.lit(False))).withColumn("label", stars(F.col("p_adjusted")))


def brackets(table: DataFrame, corrected: bool = True, only_significant: bool = False, alpha: float = 0.05) -> DataFrame:
    """Rows of a comparison table that a figure draws."""
    p = F.col("p_adjusted" if corrected else "p")
    made = table.where(p.isNotNull()).select("a", "b", p.alias("p"), stars(p).alias("label"))
    return made.where(F.col("p") < alpha) if only_significant else made


def aligned(df: DataFrame, value: str, factors: list[str], term: list[str], name: str = "aligned", within: list[str] | None = None) -> DataFrame:
    """df and the response aligned for one term (of each block): residual of the full cell plus the term's effect by inclusion and exclusion.

    All means come from the sums of the cells, a row a cell, which are joined back.
    """
    keys = within or []
    cells = df.groupBy(*keys, *factors).agg(F.sum(value).alias("_sum"), F.count(value).alias("_c"))
    over = lambda by: Window.partitionBy(*keys, *by) if keys or by else Window.partitionBy(F.lit(1))  # noqa: E731  over cells
    mean = lambda by: F.sum("_sum").over(over(by)) / F.sum("_c").over(over(by))
    shift = -mean(factors)
    for k in range(len(term) + 1):
        for sub in combinations(term, k):
            shift = shift + (-1) ** (len(term) - k) * mean(list(sub))
    by = [*keys, *factors]
    shifts = cells.select(*[F.col(f).alias(f"_{f}") for f in by], shift.alias("_shift"))
    made = df.join(shifts, [df[f].eqNullSafe(shifts[f"_{f}"]) for f in by])
    return made.withColumn(name, F.col(value) + F.col("_shift")).drop("_shift", *[f"_{f}" for f in by])


def terms(factors: list[str]) -> list[tuple[str, ...]]:
    """All non-empty sets of factors, small ones first."""
    return [t for k in range(1, len(factors) + 1) for t in combinations(factors, k)]


def _design(frame: pd.DataFrame, term: tuple[str, ...]) -> np.ndarray:
    """Sum contrasts of a term."""
    out = np.ones((len(frame), 1))
    for f in term:
        codes, levels = pd.factorize(frame[f], sort=True)
        c = np.vstack([np.eye(len(levels) - 1), -np.ones(len(levels) - 1)])[codes]
        out = (out[:, :, None] * c[:, None, :]).reshape(len(frame), -1)
    return out


def _rss(y: np.ndarray, parts: list[np.ndarray]) -> tuple[float, int]:
    x = np.hstack([np.ones((len(y), 1)), *parts])
    w, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    return float(((y - x @ w) ** 2).sum()), int(rank)


def _mixed(y: np.ndarray, x: np.ndarray, subject: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed effects and their covariance of a random-intercept model by maximum likelihood in the variance ratio."""
    codes, levels = pd.factorize(subject)
    n_i = np.bincount(codes)
    z_sum = lambda v: np.array([np.bincount(codes, v[:, j]) for j in range(v.shape[1])]).T
    sx, sy = z_sum(x), np.bincount(codes, y)

    def solve(theta: float):
        shrink = theta / (1 + n_i * theta)
        a = x.T @ x - (sx * shrink[:, None]).T @ sx
        b = x.T @ y - (sx * shrink[:, None]).T @ sy
        w = np.linalg.pinv(a) @ b
        r = y - x @ w
        rs = np.bincount(codes, r)
        s2 = (r @ r - (shrink * rs * rs).sum()) / len(y)
        return len(y) * np.log(max(s2, 1e-300)) + np.log1p(n_i * theta).sum(), w, np.linalg.pinv(a) * s2

    return _best_ratio(solve)[1:]


def _best_ratio(solve) -> tuple[float, np.ndarray, np.ndarray]:
    """solve's result at the variance ratio where its first value is least."""
    grid = np.concatenate([[0.0], np.logspace(-6, 6, 121)])
    k = int(np.argmin([solve(t)[0] for t in grid]))
    low, high = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    for _ in range(80):
        p, q = low + 0.382 * (high - low), low + 0.618 * (high - low)
        low, high = (low, q) if solve(p)[0] < solve(q)[0] else (p, high)
    return solve(min((0.0, (low + high) / 2), key=lambda t: solve(t)[0]))


def factorial_frame(frame: pd.DataFrame, value: str, factors: list[str], subject: str | None = None, kind: str = "parametric") -> pd.DataFrame:
    """One row a term: statistic, df, p, partial eta squared, note. Type II sums of squares, or Wald tests of a mixed model."""
    frame = frame.dropna(subset=[value, *factors]).copy()
    frame[factors] = frame[factors].astype(str)
    notes = []
    if subject:
        before = len(frame)
        frame = frame.groupby([*factors, subject], as_index=False)[value].mean()
        if len(frame) < before:
            notes.append("repeated values were averaged by subject and cell")
    kept = [f for f in factors if frame[f].nunique() > 1]
    notes += [f"{f} has one level" for f in factors if f not in kept]
    if kept and len(frame.groupby(kept)) < np.prod([frame[f].nunique() for f in kept]):
        notes.append("some cells are empty")
    all_terms = terms(kept)
    repeated = bool(subject) and any(frame.groupby(subject)[f].nunique().max() > 1 for f in kept)
    out = []
    for term in all_terms:
        y = frame[value].to_numpy(float)
        if kind == "rank":
            part = lambda by: frame.groupby(list(by))[value].transform("mean").to_numpy() if by else np.full(len(frame), y.mean())
            y = y - part(kept) + sum((-1) ** (len(term) - k) * part(s) for k in range(len(term) + 1) for s in combinations(term, k))
            y = pd.Series(np.round(y, 10)).rank().to_numpy()
        if repeated:
            blocks = [_design(frame, t) for t in all_terms]
            x = np.hstack([np.ones((len(y), 1)), *blocks])
            w, cov = _mixed(y, x, frame[subject].to_numpy())
            at = 1 + sum(b.shape[1] for b, t in zip(blocks, all_terms) if all_terms.index(t) < all_terms.index(term))
            own = slice(at, at + _design(frame, term).shape[1])
            stat = float(w[own] @ np.linalg.pinv(cov[own, own]) @ w[own])
            df1, df2, p, eta = own.stop - own.start, float("nan"), float(dist.chi2_sf(stat, own.stop - own.start)), float("nan")
        else:
            others = [_design(frame, t) for t in all_terms if t != term and not set(term) < set(t)]
            rss0, rank0 = _rss(y, others)
            rss1, rank1 = _rss(y, [*others, _design(frame, term)])
            full, rank = _rss(y, [_design(frame, t) for t in all_terms])
            df1, df2 = rank1 - rank0, len(y) - rank
            ss = rss0 - rss1
            ok = df1 > 0 and df2 > 0 and full > 0
            stat = ss / df1 / (full / df2) if ok else float("nan")
            p, eta = (float(dist.f_sf(stat, df1, df2)), ss / (ss + full)) if ok else (float("nan"), float("nan"))
        out.append((":".join(term), stat, float(df1), float(df2), p, eta, "; ".join(notes)))
    return pd.DataFrame(out, columns=["term", "statistic", "df1", "df2", "p", "partial_eta_sq", "note"])


def _cells_fit(cells: pd.DataFrame, pairs: pd.DataFrame, factors: list[str], subject: bool) -> dict[tuple[str, ...], tuple[float, float, float, float, float]]:
    """statistic, df1, df2, p and partial eta squared of each term from the moments of one block; see factorial.

    cells: the factors, term, n, mean and m2 (squares about the mean). pairs: n, a, b (numbers of two cells), many, s and ss: of the subjects that
    have n values, two of them in a and b, how many there are, and the sums of their summed differences from the means and of the squares.
    """
    kept = [f for f in factors if cells[f].nunique() > 1]
    all_terms, out = terms(kept), {}
    for term in all_terms:
        own = cells[cells.term.isin(["", ":".join(term)])].reset_index(drop=True)
        n, mean, m2 = (own[c].to_numpy(float) for c in ("n", "mean", "m2"))
        blocks = {t: _design(own, t) for t in all_terms}
        root = np.sqrt(n)[:, None]

        def rss(ts: list) -> tuple[float, int]:
            x = root * np.hstack([np.ones((len(own), 1)), *[blocks[t] for t in ts]])  # noqa: B023
            w, _, rank, _ = np.linalg.lstsq(x, root[:, 0] * mean, rcond=None)  # noqa: B023
            return float(m2.sum() + ((root[:, 0] * mean - x @ w) ** 2).sum()), int(rank)  # noqa: B023

        if subject and (pairs.n > 1).any():
            here = pairs[pairs.term.isin(["", ":".join(term)])]
            x = np.hstack([np.ones((len(own), 1)), *blocks.values()])
            w, cov = _cells_mixed(x, n, mean, m2, here, own.cell.tolist())
            at = 1 + sum(b.shape[1] for t, b in blocks.items() if all_terms.index(t) < all_terms.index(term))
            part = slice(at, at + blocks[term].shape[1])
            stat, df1 = float(w[part] @ np.linalg.pinv(cov[part, part]) @ w[part]), part.stop - part.start
            out[term] = (stat, df1, float("nan"), float(dist.chi2_sf(stat, df1)), float("nan"))
            continue
        others = [t for t in all_terms if t != term and not set(term) < set(t)]
        (rss0, rank0), (rss1, rank1), (full, rank) = rss(others), rss([*others, term]), rss(all_terms)
        df1, df2, ss = rank1 - rank0, n.sum() - rank, rss0 - rss1
        ok = df1 > 0 and df2 > 0 and full > 0
        stat = ss / df1 / (full / df2) if ok else float("nan")
        out[term] = (stat, df1, df2, *((float(dist.f_sf(stat, df1, df2)), ss / (ss + full)) if ok else (float("nan"), float("nan"))))
    return out


def _cells_mixed(x: np.ndarray, n: np.ndarray, mean: np.ndarray, m2: np.ndarray, pairs: pd.DataFrame, cell: list) -> tuple[np.ndarray, np.ndarray]:
    """As _mixed, from moments: x has a row a cell. Values are taken from their cell's mean, and the fit of the means is added to the effects."""
    sizes = np.sort(pairs.n.unique())
    number = {c: i for i, c in enumerate(cell)}
    k, a, b = np.searchsorted(sizes, pairs.n), pairs.a.map(number).to_numpy(int), pairs.b.map(number).to_numpy(int)
    both = np.zeros((len(sizes), len(n), len(n)))
    both[k, a, b] = pairs.many
    own = a == b
    sums = np.zeros((len(sizes), len(n)))
    sums[k[own], a[own]] = pairs.s[own]
    # a subject of n values is in n pairs of a cell with itself
    squares = np.bincount(k[own], pairs.ss[own], len(sizes)) / sizes
    many = np.bincount(k[own], pairs.many[own], len(sizes)) / sizes
    xx, total = x.T @ (n[:, None] * x), n.sum()
    base = np.linalg.pinv(np.sqrt(n)[:, None] * x) @ (np.sqrt(n) * mean)
    rest = mean - x @ base  # zero where the terms tell all cells apart
    sums_x, squares_x = sums + both @ rest, squares + 2 * sums @ rest + np.einsum("kab,a,b->k", both, rest, rest)
    xy, yy = x.T @ (n * rest), m2.sum() + n @ rest**2

    def solve(theta: float):
        shrink = theta / (1 + sizes * theta)
        m = np.tensordot(shrink, both, 1)
        left = xx - x.T @ m @ x
        w = np.linalg.pinv(left) @ (xy - x.T @ (shrink @ sums_x))
        fit = x @ w
        rs = squares_x - 2 * sums_x @ fit + np.einsum("kab,a,b->k", both, fit, fit)
        s2 = (yy - 2 * xy @ w + w @ xx @ w - shrink @ rs) / total
        return total * np.log(max(s2, 1e-300)) + many @ np.log1p(sizes * theta), w, np.linalg.pinv(left) * s2

    _, w, cov = _best_ratio(solve)
    return w + base, cov


def _moments(rows: DataFrame, keys: list[str], factors: list[str], subject: bool, term: str) -> DataFrame:
    """Moments of one block's cells, and of pairs of cells that subjects share: a row a cell, and a row a pair and number of values.

    rows: keys, factors, _s (subject), _v, _m (values behind _v). Both tables have no more rows than the cells, squared, times the cells.
    """
    cell = F.array(*factors)
    use = F.col("_s").isNotNull() if subject else F.lit(True)
    v = F.when(use, F.col("_v"))
    cells = saved(rows.groupBy(*keys, cell.alias("a")).agg(F.sum("_m").alias("before"), F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")), "cells")
    none = lambda t, *names: [F.lit(None).cast(t).alias(c) for c in names]
    made = cells.select(*keys, "a", *none("array<string>", "b"), "before", F.col("n").cast("long").alias("n"), "mean", "m2", *none("double", "many", "s", "ss"))
    if subject:
        means = cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("a").alias("_a"), F.col("mean").alias("_mean"))
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [cell == F.col("_a")]
        apart = rows.where(use).join(means, on).select(*keys, "_s", "_a", (F.col("_v") - F.col("_mean")).alias("_d"))
        subjects = apart.groupBy(*keys, "_s").agg(F.sum("_d").alias("d"), F.array_sort(F.collect_list("_a")).alias("has"))  # at most all cells
        same = subjects.groupBy(*keys, "has").agg(F.count("*").alias("many"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
        pairs = same.withColumn("n", F.size("has").cast("long")).withColumn("a", F.explode("has")).withColumn("b", F.explode("has"))
        pairs = pairs.groupBy(*keys, "a", "b", "n").agg(F.sum("many").cast("double").alias("many"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
        made = made.union(pairs.select(*keys, "a", "b", *none("long", "before"), "n", *none("double", "mean", "m2"), "many", "s", "ss"))
    return made.withColumn("term", F.lit(term))


def factorial(df: DataFrame, value: str, factors: list[str], subject: str | None = None, kind: str = "parametric", within: list[str] | None = None) -> DataFrame:
    """As factorial_frame for each block, however many values it has: only moments of cells and of pairs of cells come to a task's Python.

    A block's cells (combinations of levels) must be few, as in a designed experiment; its values and subjects need not be. Rows with
    a missing value, factor or (if given) subject take no part.
    """
    keys = within or []
    if not keys:
        df, keys = df.withColumn("block", F.lit("all")), ["block"]
    types = dict(df.dtypes)
    there = lambda c: F.col(c).isNotNull() & (~F.isnan(c) if types[c] in ("double", "float") else F.lit(True))
    names = [f"_f{i}" for i in range(len(factors))]
    s = F.when(there(subject), F.col(subject)) if subject else F.lit(None).cast("string")
    good = df.where(there(value))
    for f in factors:
        good = good.where(there(f))
    rows = good.select(*keys, *[F.col(f).cast("string").alias(n) for f, n in zip(factors, names)], s.alias("_s"), F.col(value).cast("double").alias("_v"))
    rows = rows.groupBy(*keys, *names, "_s").agg(F.avg("_v").alias("_v"), F.count("*").alias("_m")) if subject else rows.withColumn("_m", F.lit(1).cast("long"))
    rows = saved(rows, "rows") if subject or kind == "rank" else rows
    if kind == "rank":
        moments = None
        for term in terms(names):
            whole = aligned(rows.where("_s is not null") if subject else rows, "_v", names, list(term), "_v2", keys).withColumn("_v2", F.round("_v2", 10))
            ranks = whole.select(*keys, *names, "_s", average_rank("_v2", *keys).alias("_v"), "_m")
            part = _moments(ranks.union(rows.where("_s is null").select(ranks.columns)) if subject else ranks, keys, names, bool(subject), ":".join(factors[names.index(t)] for t in term))
            moments = part if moments is None else moments.union(part)
    else:
        moments = _moments(rows, keys, names, bool(subject), "")
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "term string, statistic double, df1 double, df2 double, p double, partial_eta_sq double, note string"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(cell=pdf.a.map(tuple))
        cells, pairs = pdf[pdf.b.isna()], pdf[pdf.b.notna()]
        first = cells[cells.term == cells.term.iloc[0]]
        before, after, cells = first.before.sum(), first.n.sum(), cells[cells.n > 0].copy()
        for i, f in enumerate(factors):
            cells[f] = [c[i] for c in cells.cell]
        notes = ["repeated values were averaged by subject and cell"] if subject and after < before else []
        kept = [f for f in factors if cells[f].nunique() > 1]
        notes += [f"{f} has one level" for f in factors if f not in kept]
        if kept and len(cells.drop_duplicates(kept)) < np.prod([cells[f].nunique() for f in kept]):
            notes.append("some cells are empty")
        fits = _cells_fit(cells, pairs.assign(a=pairs.cell, b=pairs.b.map(tuple)), factors, bool(subject))
        got = [(":".join(t), r[0], float(r[1]), float(r[2]), r[3], r[4], "; ".join(notes)) for t, r in fits.items()]
        got = pd.DataFrame(got, columns=["term", "statistic", "df1", "df2", "p", "partial_eta_sq", "note"])
        for i, k in enumerate(keys):
            got.insert(i, k, pdf[k].iloc[0])
        return got

    return moments.groupBy(*keys).applyInPandas(one, schema)


def describe_design(test: str, correction: str, alpha: float, n: int) -> str:
    return f"{n} comparisons by {resolve_test(test)}, corrected by {correction}, significant below {alpha:g}"
