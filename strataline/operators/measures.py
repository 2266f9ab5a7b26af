"""Measures around marks, totals of lesions, and what tables of tiles and fields tell before any pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.functions.core import finite, safe_div
from strataline.operators.stats import adjust, stars

# Columns that name a unit of resampling, the most specific first, those that name an experiment, and the second dye.
UNIT_COLUMNS = ("dish", "replicate", "field", "image", "date")
EXPERIMENT_COLUMNS = ("date", "dish")
COUNTERSTAINS = {"aorta": "muscle", "heart": "muscle", "kidney": "parenchyma"}


def measure_points(points: DataFrame, pixels: DataFrame, px_um: float, radius_um: float = 25.0) -> DataFrame:
    """Each mark (point, x_um, y_um) with the tissue in a disc around it; a mark without any has counts of 0 and no measures.

    pixels: y, x, collagen, counterstain, tissue and, if there, lesion. Both sides are cut in cells of the disc's radius, so a mark
    meets the pixels of nine cells, and sums are combined before they are shuffled by mark.
    """
    r = max(1, round(radius_um / max(px_um, 1e-6)))
    cell = lambda c: F.floor(F.col(c) / r)
    marks = points.select("point", "x_um", "y_um", F.bround(F.col("x_um") / px_um).cast("long").alias("cx"), F.bround(F.col("y_um") / px_um).cast("long").alias("cy"))
    near = marks.select("point", "cx", "cy", F.explode(F.sequence(cell("cx") - 1, cell("cx") + 1)).alias("bx"))
    near = near.withColumn("by", F.explode(F.sequence(cell("cy") - 1, cell("cy") + 1)))
    held = pixels.withColumn("bx", cell("x")).withColumn("by", cell("y"))
    away = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    both = near.join(held, ["bx", "by"]).where(away <= r * r)
    use = F.coalesce(F.col("tissue"), F.lit(False))
    c, s = F.when(use, finite("collagen")), F.when(use, finite("counterstain"))
    found = both.groupBy("point").agg(F.count(F.when(use, 1)).alias("n_tissue_px"), F.sum(c).alias("c"), F.sum(s).alias("s"), F.avg(c).alias("collagen_mean_od"), F.avg(s).alias("counterstain_mean_od"), *([F.max(F.when((F.col("x") == F.col("cx")) & (F.col("y") == F.col("cy")), F.col("lesion"))).alias("in_lesion")] if "lesion" in pixels.columns else []))
    made = points.join(found, "point", "left").withColumn("n_tissue_px", F.coalesce("n_tissue_px", F.lit(0)))
    made = made.withColumn("collagen_to_counterstain", safe_div("c", "s")).withColumn("collagen_share", F.col("c") / F.greatest(F.col("c") + F.col("s"), F.lit(1e-9)))
    if "lesion" in pixels.columns:
        made = made.withColumn("in_lesion", F.coalesce("in_lesion", F.lit(0)))
    return made.drop("c", "s")


def lesion_totals(lesions: DataFrame, tissue_px: Column, area_px: float, keys: list[str]) -> DataFrame:
    """Number, area, share of the tissue, mean and density of the lesions of each section. lesions: keys, area_um2 (null: none)."""
    made = lesions.groupBy(*keys).agg(F.count("area_um2").alias("n_lesions"), F.coalesce(F.sum("area_um2"), F.lit(0.0)).alias("area"), F.max(tissue_px).alias("tissue"))
    tissue_um2 = F.col("tissue") * area_px
    return made.select(*keys, "n_lesions", (F.col("area") / 1e6).alias("lesion_area_mm2"), safe_div("area", tissue_um2).alias("lesion_area_fraction"), safe_div("area", F.col("n_lesions").cast("double")).alias("lesion_area_mean_um2"), safe_div(F.col("n_lesions").cast("double"), tissue_um2 / 1e6).alias("lesions_per_mm2_tissue"))


def white_point(pixels: DataFrame, keys: list[str], channels: list[str], share: float = 0.995, least: float = 1e-3) -> DataFrame:
    """A high percentile of each channel: hot pixels and dust don't set the reference.

    Channels are shares of 8- or 16-bit values, so the state of a percentile is at most as many counts as such values.
    """
    return pixels.groupBy(*keys).agg(*[F.greatest(F.lit(least), F.percentile(finite(c), F.lit(share))).alias(c) for c in channels])


def pixel_size(tiles: DataFrame, keys: list[str], size: str = "px_um") -> DataFrame:
    """The median of the known sizes of a section's tiles; NULL where none is known."""
    known = finite(F.col(size).cast("double"))
    return tiles.groupBy(*keys).agg(F.median(F.when(known > 0, known)).alias(size))


def shift_allowed(ty: Column, tx: Column, size_a: tuple[Column, Column], size_b: tuple[Column, Column], share: float) -> Column:
    """Whether a shift of two tiles (heights and widths) leaves more than a touch of them together."""
    return (F.abs(ty) <= share * F.greatest(size_a[0], size_b[0])) & (F.abs(tx) <= share * F.greatest(size_a[1], size_b[1]))


def muscle_centre(bands: DataFrame, keys: list[str], depth: str, muscle: str, reach_um: float, level: float) -> DataFrame:
    """Where along each sampling line the muscle is: depths weighted by what exceeds half of the line's peak; NULL at or below level."""
    m = F.coalesce(finite(muscle), F.lit(0.0))
    near = bands.withColumn("m", F.when(F.abs(F.col(depth)) <= reach_um, m).otherwise(0.0))
    peaks = near.groupBy(*keys).agg(F.max("m").alias("peak"))
    w = F.greatest(F.lit(0.0), F.col("m") - 0.5 * F.col("peak"))
    made = near.join(peaks, keys).groupBy(*keys).agg(F.max("peak").alias("peak"), safe_div(F.sum(w * F.col(depth)), F.sum(w)).alias("centre"))
    return made.select(*keys, F.when(F.col("peak") > level, F.col("centre")).alias("centre_um"))


def measured_only(rows: DataFrame, ok: str = "ok") -> DataFrame:
    """Rows whose measurement succeeded; a table without the column is taken as measured."""
    return rows.where(F.coalesce(F.col(ok).cast("boolean"), F.lit(False))) if ok in rows.columns else rows


def unit_column(rows: DataFrame, preference: tuple[str, ...] = UNIT_COLUMNS) -> str | None:
    """The first column of the preference that is there and has a value: one row of counts."""
    there = [c for c in preference if c in rows.columns]
    counts = rows.agg(*[F.count(c).alias(c) for c in there]).first() if there else {}
    return next((c for c in there if counts[c]), None)


def experiments(rows: DataFrame, keys: list[str], columns: tuple[str, ...] = EXPERIMENT_COLUMNS) -> DataFrame:
    """Independent experiments of each group: different combinations of the columns that the group has values in; NULL without any.

    Combinations are distinct before they are counted, so a hot group sends each of its own once a task.
    """
    there = [c for c in columns if c in rows.columns]
    if not there:
        return rows.select(*keys).distinct().withColumn("n_experiments", F.lit(None).cast("long"))
    each = rows.select(*keys, *there).distinct()
    return each.groupBy(*keys).agg(F.when(F.greatest(F.lit(0), *[F.count(c) for c in there]) > 0, F.count("*")).alias("n_experiments"))


def counterstain(organ: Column) -> Column:
    """What the second dye shows in an organ."""
    names = F.create_map(*[F.lit(x) for pair in COUNTERSTAINS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.coalesce(organ, F.lit("")))), F.lit("muscle"))


def panel_comparisons(table: DataFrame, region: str | None, readout: str, region_column: str = "segment", correction: str = "fdr_bh", alpha: float = 0.05, only_significant: bool = False) -> DataFrame:
    """Of a table of comparisons those that one panel shows, corrected together: a, b, p, significant, label."""
    rows = table.where((F.col("readout") == readout) & finite("p").isNotNull())
    if region and region_column in table.columns:
        rows = rows.where(F.col(region_column).cast("string") == region)
    made = adjust(rows, "p", correction, order="a")
    made = made.select("a", "b", F.col("p_adjusted").alias("p"), (F.col("p_adjusted") < alpha).alias("significant"), stars(F.col("p_adjusted")).alias("label"))
    return made.where("significant") if only_significant else made


def json_safe(df: DataFrame) -> DataFrame:
    """Numbers that JSON has no word for (NaN, infinities) as NULL, also inside arrays, structs and maps."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return finite(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, x: clean(x, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind]))
        return c

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def field_files(files: DataFrame, path: str) -> DataFrame:
    """For each file the channels of its field that are there, in order; a name of another form has itself alone."""
    from strataline.operators.naming import PLATE_FILE, stem

    name = F.element_at(F.split(F.col(path), "/"), -1)
    folder = F.substring(F.col(path), F.lit(1), F.char_length(F.col(path)) - F.char_length(name))
    s, suffix = stem(F.col(path)), F.regexp_extract(name, r"(\.[^.]*)\z", 1)
    g = lambda k: F.regexp_extract(s, PLATE_FILE, k)
    made = files.withColumn("field", F.when(s.rlike(PLATE_FILE), F.concat_ws("\0", folder, g(1), g(2), g(3), g(4), g(6), g(7), g(8), suffix))).withColumn("channel", g(5).try_cast("int"))
    groups = made.where("field is not null and channel between 1 and 16").groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", F.col(path).alias("path")))), lambda x: x["path"]).alias("channels"))  # 16 at most
    return made.join(groups, "field", "left").select(*files.columns, F.coalesce("channels", F.array(F.col(path))).alias("channels"))


__all__ = ["counterstain", "experiments", "field_files", "json_safe", "lesion_totals", "measure_points", "measured_only", "muscle_centre", "panel_comparisons", "pixel_size", "shift_allowed", "unit_column", "white_point"]
