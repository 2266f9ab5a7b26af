"""The cohort ladder: sections to subject and region, to subject, to group. Integrals are summed, then ratios derived."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.core import UNKNOWN, constant_or_unknown, finite, key_or_unknown, number, safe_div, unpivot, weighted_mean
from strataline.functions.scratch import saved

TASK_NAMES = 250_000  # rows; what a task holds of names, whatever the size of the input


@dataclass(frozen=True)
class Scheme:
    """Which columns add up, which readouts derive from the sums, which columns are averaged and with what weight."""

    name: str
    sums: tuple[str, ...]
    required: tuple[str, ...]
    readouts: dict[str, tuple[str, tuple[str, ...], float]]  # name: numerator, denominators (added), unit of the denominator
    averaged: tuple[str, ...] = ()
    weight: str | None = None
    coverage_weighted: tuple[str, ...] = ()
    coverage: str | None = None
    convenience: dict[str, tuple[str, float]] = field(default_factory=dict)
    rebuilt: dict[str, tuple[tuple[str, ...], float]] = field(default_factory=dict)  # absent sum: factors and a scale
    together: str = "all segments"

    def derive(self, value: Callable[[str], Column] = F.col) -> dict[str, Column]:
        """A guarded ratio for each readout."""
        out = {}
        for name, (num, den, unit) in self.readouts.items():
            total = value(den[0])
            for d in den[1:]:
                total = total + value(d)
            out[name] = safe_div(value(num), total / unit)
        return out


# Column names of the measurement tables.
WALL = Scheme(
    "wall",
    ("wall_length_um", "media_area_um2", "collagen_od_um2_total", "muscle_od_um2_total", "collagen_adventitia_od_um2_total", "collagen_area_um2_total"),
    ("wall_length_um", "media_area_um2", "collagen_od_um2_total", "muscle_od_um2_total"),
    {
        "collagen_to_muscle_ratio": ("collagen_od_um2_total", ("muscle_od_um2_total",), 1.0),
        "collagen_fraction_of_stain": ("collagen_od_um2_total", ("collagen_od_um2_total", "muscle_od_um2_total"), 1.0),
        "mean_media_thickness_um": ("media_area_um2", ("wall_length_um",), 1.0),
        "collagen_od_um2_per_mm_length": ("collagen_od_um2_total", ("wall_length_um",), 1000.0),
        "muscle_od_um2_per_mm_length": ("muscle_od_um2_total", ("wall_length_um",), 1000.0),
        "collagen_area_fraction_media": ("collagen_area_um2_total", ("media_area_um2",), 1.0),
    },
    ("muscle_variation", "lamellar_contrast", "lamellar_spacing_um", "lamellar_disorder", "lamellar_coverage", "section_edge_width_um", "median_muscle_beyond_edge_um", "median_muscle_beyond_edge_fill", "fragmented_length_fraction"),
    "wall_length_um",
    ("lamellar_spacing_um", "lamellar_disorder"),
    "lamellar_coverage",
    {"wall_length_mm": ("wall_length_um", 1000.0)},
    {"collagen_area_um2_total": (("collagen_area_um2_per_mm_length", "wall_length_um"), 1e-3)},
)
AREA = Scheme(
    "area",
    ("tissue_area_um2", "imaged_area_um2", "collagen_od_um2_total", "muscle_od_um2_total", "collagen_area_um2_total"),
    ("tissue_area_um2", "collagen_od_um2_total", "muscle_od_um2_total"),
    {
        "collagen_to_muscle_ratio": ("collagen_od_um2_total", ("muscle_od_um2_total",), 1.0),
        "collagen_fraction_of_stain": ("collagen_od_um2_total", ("collagen_od_um2_total", "muscle_od_um2_total"), 1.0),
        "collagen_area_fraction_tissue": ("collagen_area_um2_total", ("tissue_area_um2",), 1.0),
        "collagen_od_um2_per_mm2_tissue": ("collagen_od_um2_total", ("tissue_area_um2",), 1e6),
        "muscle_od_um2_per_mm2_tissue": ("muscle_od_um2_total", ("tissue_area_um2",), 1e6),
        "tissue_fraction_of_image": ("tissue_area_um2", ("imaged_area_um2",), 1.0),
    },
    convenience={"tissue_area_mm2": ("tissue_area_um2", 1e6)},
    rebuilt={c: ((c.replace("um2", "mm2"),), 1e6) for c in ("tissue_area_um2", "imaged_area_um2", "collagen_area_um2_total")},
    together="all regions",
)
SCHEMES = {"aorta": WALL, "wall": WALL, "kidney": AREA, "area": AREA, "heart": AREA}


def scheme_for(organ: str | None) -> Scheme:
    return SCHEMES.get((organ or "").strip().lower(), WALL)


def with_sums(df: DataFrame, scheme: Scheme = WALL) -> DataFrame:
    """Sums that are absent are rebuilt from the columns that determine them."""
    for name, (factors, scale) in scheme.rebuilt.items():
        if name not in df.columns and all(f in df.columns for f in factors):
            value = F.lit(scale)
            for f in factors:
                value = value * number(df, f)
            df = df.withColumn(name, value)
    return df


def check_columns(df: DataFrame, scheme: Scheme = WALL) -> DataFrame:
    """Required columns are there and hold a number; else ValueError."""
    df = with_sums(df, scheme)
    counts = df.agg(*[F.count(number(df, c)).alias(c) for c in scheme.required]).first()
    if missing := [c for c in scheme.required if not counts[c]]:
        raise ValueError(f"no values in: {', '.join(missing)}")
    return df


def with_readouts(df: DataFrame, scheme: Scheme = WALL) -> DataFrame:
    """Readouts filled in where a row has none of its own."""
    df = with_sums(df, scheme)
    derived = scheme.derive(lambda c: number(df, c))
    return df.withColumns({k: F.coalesce(number(df, k), v) for k, v in derived.items()})


def _weighted(df: DataFrame, scheme: Scheme) -> dict[str, Column]:
    """The weight of each averaged column that is there."""
    w = number(df, scheme.weight) if scheme.weight else F.lit(None).cast("double")
    cover = w * number(df, scheme.coverage) if scheme.coverage in df.columns else w
    return {c: cover if c in scheme.coverage_weighted else w for c in scheme.averaged if c in df.columns}


def _aggregates(df: DataFrame, keys: list[str], scheme: Scheme, name: str, carry: tuple[str, ...], counted: tuple[str, ...], listed: bool) -> list[Column]:
    out = [F.sum(number(df, c)).alias(c) for c in scheme.sums if c in df.columns]
    out += [weighted_mean(number(df, c), w).alias(c) for c, w in _weighted(df, scheme).items()]
    out += [constant_or_unknown(c).alias(c) for c in carry if c in df.columns and c not in keys]
    out.append((F.count_distinct(name) if name in df.columns else F.count("*")).alias("n_sections"))
    out += [F.count("*").alias("n_vessels"), F.count("*").alias("n_fields")]
    out += [F.count_distinct(key_or_unknown(c)).alias(f"n_{c}s") for c in counted if c in df.columns and c not in keys]
    if listed and name in df.columns:
        out.append(F.array_join(F.array_sort(F.collect_list(F.col(name).cast("string"))), ", ").alias("sections"))
    return out


def pool(df: DataFrame, by: list[str], scheme: Scheme = WALL, name: str = "name", carry: tuple[str, ...] = ("genotype", "age"), counted: tuple[str, ...] = ("slide", "mouse", "segment"), listed: bool = False) -> DataFrame:
    """One row a group: sums, readouts of the sums, weighted means, what the rows share, and counts.

    A sum over no value is NULL. Blank keys are `unknown`. listed: also `sections`, the names with repetition, in order; that is
    one value a group, so only for groups of a few sections.
    """
    df = with_sums(df, scheme)
    keyed = df.withColumns({k: key_or_unknown(k) for k in by})
    made = keyed.groupBy(*by).agg(*_aggregates(keyed, by, scheme, name, carry, counted, listed))
    return _finished(made, scheme)


def _finished(made: DataFrame, scheme: Scheme) -> DataFrame:
    has = lambda c: F.col(c) if c in made.columns else F.lit(None).cast("double")
    made = made.withColumns(scheme.derive(has))
    return made.withColumns({k: F.col(c) / unit for k, (c, unit) in scheme.convenience.items() if c in made.columns})


def _names(keyed: DataFrame, keys: list[str], name: str, rows: int) -> DataFrame:
    """keys, value (a name), n of each name by subject and region; `first` in one region of each subject that has the name.

    Names are about as many as rows, so they are dealt out before any task gathers them. Rows of one name that come from different tasks
    are first counted apart, so a hot one is dealt out too.
    """
    parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_NAMES))
    group, subject, region = keys
    one = keyed.where(F.col(name).isNotNull()).select(*keys, F.col(name).cast("string").alias("value"), F.spark_partition_id().alias("_task"))
    apart = one.repartition(parts, *keys, "value", "_task").groupBy(*keys, "value", "_task").agg(F.count("*").alias("n"))
    each = apart.repartition(parts, group, subject, "value").groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    return each.withColumn("first", F.row_number().over(Window.partitionBy(group, subject, "value").orderBy(region)) == 1)


def ladder(df: DataFrame, group: str = "genotype", subject: str = "mouse", region: str = "segment", scheme: Scheme = WALL, name: str = "name", carry: tuple[str, ...] = ("age",), counted: tuple[str, ...] = ("slide",), listed: bool = False) -> DataFrame:
    """Both lower steps: rows by subject and region, and by subject with the region `all segments`.

    The input is read twice, to small tables in the shared folder: by subject and region a row of sums, and a row for each different
    slide and carried value; then the number of different names. Either step adds up these: sums of sums, and counts of what differs.
    No string is an aggregate's value there, so sums, slides and carried values are hashed and combined before the shuffle.
    """
    keys = [group, subject, region]
    df = with_sums(df, scheme)
    keyed = df.withColumns({k: key_or_unknown(k) for k in keys})
    parts = {c: number(keyed, c) for c in scheme.sums if c in df.columns}
    weights = _weighted(keyed, scheme)
    for c, w in weights.items():
        use = number(keyed, c).isNotNull() & (w > 0)
        parts |= {f"num_{c}": F.when(use, number(keyed, c) * w), f"den_{c}": F.when(use, w)}
    carry = tuple(c for c in carry if c in df.columns and c not in keys)
    counted = tuple(c for c in counted if c in df.columns and c not in keys)
    kinds = {"sums": F.lit(None).cast("string")}
    kinds |= {f"n_{c}": key_or_unknown(c) for c in counted} | {f"carry_{c}": F.nullif(F.col(c).cast("string"), F.lit("")) for c in carry}
    number_of = {k: i for i, k in enumerate(kinds)}
    wide = keyed.select(*keys, F.explode(F.array(*[F.struct(F.lit(number_of[k]).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("_"), *[v.alias(f"part_{k}") for k, v in parts.items()])
    made = wide.groupBy(*keys, F.col("_.kind").alias("kind"), F.col("_.value").alias("value")).agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("_.kind") == 0, F.col(f"part_{k}"))).alias(f"part_{k}") for k in parts])
    made = saved(made, "ladder")
    if named := name in df.columns:
        each = _names(keyed, keys, name, made.where("kind = 0").agg(F.sum("n")).first()[0] or 0)
        each = saved(each, "names") if listed else each
        sections = saved(each.groupBy(*keys).agg(F.count("*").alias("n_sections"), F.count_if("first").alias("n_first")), "sections")

    def step(by: list[str]) -> DataFrame:
        sums = made.where("kind = 0").groupBy(*by).agg(F.sum("n").alias("n_vessels"), *[F.sum(f"part_{k}").alias(f"part_{k}") for k in parts])
        sums = sums.select(*by, "n_vessels", *[F.col(f"part_{c}").alias(c) for c in parts if c in scheme.sums], *[safe_div(f"part_num_{c}", f"part_den_{c}").alias(c) for c in weights])
        different = made.where("kind > 0").select(*by, "kind", "value").distinct()
        n = lambda k: F.count(F.when(F.col("kind") == number_of[k], F.col("value")))
        counts = different.groupBy(*by).agg(F.count("*").alias("_rows"), *[n(f"n_{c}").alias(f"n_{c}s") for c in counted])
        out = sums.join(counts, by, "left").drop("_rows").withColumn("n_fields", F.col("n_vessels"))
        if named:
            # a name of several regions counts once for its subject
            n_names = sections.groupBy(*by).agg(F.sum("n_sections" if by == keys else "n_first").alias("n_sections"))
            out = out.join(n_names, by, "left").withColumn("n_sections", F.coalesce("n_sections", F.lit(0).cast("long")))
        else:
            out = out.withColumn("n_sections", F.col("n_vessels"))
        for c in carry:
            one = different.where((F.col("kind") == number_of[f"carry_{c}"]) & F.col("value").isNotNull()).groupBy(*by).agg(F.count("*").alias("_k"), F.max("value").alias("_v"))
            out = out.join(one, by, "left").withColumn(c, F.when(F.col("_k") == 1, F.col("_v")).otherwise(F.lit(UNKNOWN))).drop("_k", "_v")
        if listed and named:
            names = each.groupBy(*by).agg(F.array_join(F.array_sort(F.flatten(F.collect_list(F.array_repeat("value", F.col("n").cast("int"))))), ", ").alias("sections"))
            out = out.join(names, by, "left")
        return out

    whole = step([group, subject]).withColumn(region, F.lit(scheme.together))
    both = step(keys).unionByName(whole)
    return _finished(both.select(*keys, *[c for c in both.columns if c not in keys]), scheme)


def per_group(rows: DataFrame, readouts: list[str], by: str = "genotype", region: str = "segment") -> DataFrame:
    """Long table over subjects: n, sections, mean, sample sd, sem, min and max of each readout by region and group."""
    kept = [r for r in readouts if r in rows.columns]
    base = rows.withColumns({by: key_or_unknown(by), region: key_or_unknown(region)})
    extra = ["n_sections"] if "n_sections" in rows.columns else []
    long = unpivot(base, [region, by, *extra], kept, "readout", "value").withColumn("value", finite("value")).where("value is not null")
    made = long.groupBy(region, by, "readout").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in extra], F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return made.withColumn("sem", F.col("sd") / F.sqrt("n"))


def compare_groups(rows: DataFrame, readouts: list[str], by: str = "genotype", region: str = "segment", p_values: bool = True) -> DataFrame:
    """Welch comparison of every pair of groups (a < b) for each region and readout.

    difference is b - a and ratio b / a, t is of a - b. n below 2 on either side, or no variance: no t.
    """
    from strataline.functions.dist import t_two_sided

    kept = [r for r in readouts if r in rows.columns]
    base = rows.withColumns({by: key_or_unknown(by), region: key_or_unknown(region)})
    long = unpivot(base, [region, by], kept, "readout", "value").withColumn("value", finite("value")).where("value is not null")
    m = long.groupBy(region, "readout", by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    a, b = (m.select(region, "readout", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "mean", "var")], F.col(by).alias(s)) for s in "ab")
    pairs = a.join(b, [region, "readout"]).where("a < b")
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    made = pairs.select(
        region, "readout", "a", "b", "n_a", "n_b", "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("difference"), safe_div("mean_b", "mean_a").alias("ratio"),
        F.when((F.col("n_a") > 1) & (F.col("n_b") > 1) & (va + vb > 0), (F.col("mean_a") - F.col("mean_b")) / F.sqrt(va + vb)).alias("t"),
        F.when((F.col("n_a") > 1) & (F.col("n_b") > 1) & (va + vb > 0), (va + vb) ** 2 / (va**2 / (F.col("n_a") - 1) + vb**2 / (F.col("n_b") - 1))).alias("df"),
    )
    return made.withColumn("p", t_two_sided("t", "df")) if p_values else made


def summarise(sections: DataFrame, organ: str | None = None) -> dict[str, DataFrame]:
    """The whole ladder: sections, by_mouse_segment, by_mouse, by_genotype and comparison."""
    scheme = scheme_for(organ)
    checked = check_columns(sections, scheme)
    both = ladder(checked, scheme=scheme, listed=True)
    fine, whole = both.where(F.col("segment") != scheme.together), both.where(F.col("segment") == scheme.together)
    stacked = fine.unionByName(whole, allowMissingColumns=True)
    readouts = [*scheme.readouts, *[c for c in scheme.averaged if c in stacked.columns]]
    return {"sections": with_readouts(checked, scheme), "by_mouse_segment": fine, "by_mouse": whole, "by_genotype": per_group(stacked, readouts), "comparison": compare_groups(stacked, readouts)}


def exact_medians(positions: DataFrame, by: list[str], columns: list[str], finite_share: str | None = None, beyond: str | None = None, fill: str | None = None, step: str | None = None, reach: float = 12.0, fill_limit: float = 0.8) -> DataFrame:
    """Medians over all positions of a group, not of its sections.

    coverage: share of positions where finite_share has a value. fragmented: share, of positions with a fill, where muscle
    reaches further than `reach` with a fill below the limit. Groups with more than one step have NULL everywhere.
    """
    out = [F.median(number(positions, c)).alias(c) for c in columns]
    if finite_share:
        out.append(F.avg(number(positions, finite_share).isNotNull().cast("double")).alias("coverage"))
    if beyond and fill:
        f = number(positions, fill)
        out.append(F.avg(F.when(f.isNotNull(), F.coalesce((number(positions, beyond) > reach) & (f < fill_limit), F.lit(False)).cast("double"))).alias("fragmented"))
    made = positions.groupBy(*by).agg(F.count("*").alias("n_positions"), *out, *([F.count_distinct(step).alias("steps")] if step else []))
    if not step:
        return made
    values = [c for c in made.columns if c not in (*by, "n_positions", "steps")]
    return made.withColumns({c: F.when(F.col("steps") <= 1, F.col(c)) for c in values}).drop("steps")


def depth_average(depth: DataFrame, keys: list[str], subject: str, at: str, values: list[str], weight: str) -> DataFrame:
    """Mean, sample sd and number of subjects at each depth, each subject first averaged by weight.

    A depth that a section didn't reach adds neither value nor weight.
    """
    keyed = depth.withColumns({k: key_or_unknown(k) for k in (*keys, subject)})
    each = keyed.groupBy(*keys, subject, at).agg(*[weighted_mean(number(keyed, v), number(keyed, weight)).alias(v) for v in values])
    return each.groupBy(*keys, at).agg(*[f(v).alias(f"{v}_{s}") for v in values for s, f in (("mean", F.avg), ("sd", F.stddev_samp), ("n", F.count))])


def group_options(tables: DataFrame, fields: list[str], always: str = "genotype") -> DataFrame:
    """Fields worth grouping by, with their labels: those with more than one, and always the given one."""
    long = tables.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), key_or_unknown(f).alias("label")) for f in fields])).alias("x")).select("x.*").distinct()
    made = long.groupBy("field").agg(F.count("*").alias("n_labels"), F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("labels"))
    return made.where((F.col("n_labels") > 1) | (F.col("field") == always))


def merge_metadata(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join; in shared columns the left value stands and the right fills its NULLs."""
    shared = [c for c in right.columns if c in left.columns and c != on]
    r = right.select(F.col(on), *[F.col(c).alias(f"right_{c}" if c in shared else c) for c in right.columns if c != on])
    made = left.join(r, on, "left")
    return made.select(on, *[F.coalesce(c, f"right_{c}").alias(c) if c in shared else F.col(c) for c in left.columns if c != on], *[c for c in right.columns if c not in left.columns])


def overlay(rows: DataFrame, key: str, *overrides: DataFrame) -> DataFrame:
    """Values typed by hand over parsed ones; earlier overrides win, blanks say nothing, of repeated keys the last row holds.

    Each of overrides has the key, an `at` column that orders its rows, and any of the columns of rows.
    """
    for o in reversed(overrides):
        own = [c for c in o.columns if c in rows.columns and c != key]
        last = o.groupBy(key).agg(*[F.max_by(F.nullif(F.col(c).cast("string"), F.lit("")), "at").alias(f"over_{c}") for c in own])
        rows = rows.join(last, key, "left").select(*[F.coalesce(f"over_{c}", F.col(c).cast("string")).alias(c) if c in own else F.col(c) for c in rows.columns])
    return rows


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str, default: str | None = None) -> DataFrame:
    """A label for each row from a mapping; the default, or NULL, where it has none."""
    found = rows.join(table.select(F.col(table_key).alias("lookup_key"), F.col(value).alias("looked_up")), F.col(key) == F.col("lookup_key"), "left").drop("lookup_key")
    return found.withColumn(value, F.coalesce("looked_up", F.lit(default)) if default is not None else F.col("looked_up")).drop("looked_up")


__all__ = ["AREA", "UNKNOWN", "WALL", "Scheme", "check_columns", "compare_groups", "depth_average", "exact_medians", "group_options", "ladder", "lookup", "merge_metadata", "overlay", "per_group", "pool", "scheme_for", "summarise", "with_readouts", "with_sums"]
