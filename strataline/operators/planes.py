"""Tables of pixels, runs, corners and samples: flat fields, components of masks, unions of polygons, other grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.components import components
from strataline.functions.core import finite, safe_div

CELL = 64  # positions of a row that meet in one join key


def flat_field(pixels: DataFrame, y: str = "y", x: str = "x", value: str = "value") -> DataFrame:
    """y, x, field, gain: the median of all tiles at each position, and the factor that makes it the mean field.

    A median counts distinct values, which pixels have few of. Missing values take no part; a position without any, or with a
    median of zero or less, has gain 1.
    """
    field = pixels.groupBy(y, x).agg(F.median(finite(value)).alias("field"))
    mean = field.where("field > 0").agg(F.avg("field").alias("mean"))  # one row
    return field.join(F.broadcast(mean)).select(y, x, "field", F.when(F.col("field") > 0, F.col("mean") / F.col("field")).otherwise(1.0).alias("gain"))


def corrected(pixels: DataFrame, field: DataFrame, y: str = "y", x: str = "x", value: str = "value") -> DataFrame:
    """pixels with value times the gain of its position; positions that the field lacks stay as they are."""
    gains = field.select(F.col(y).alias("_y"), F.col(x).alias("_x"), F.col("gain").alias("_gain"))
    made = pixels.join(gains, (pixels[y] == gains["_y"]) & (pixels[x] == gains["_x"]), "left")
    return made.select(*[F.col(c) if c != value else (F.col(c) * F.coalesce("_gain", F.lit(1.0))).alias(c) for c in pixels.columns])


def mask_runs(mask: DataFrame, plane: str, y: str = "y", x: str = "x") -> DataFrame:
    """plane, y, x0, x1 (both included): the longest runs of neighbouring pixels in the rows of mask, a row a pixel inside."""
    inside = mask.where(F.col(plane).isNotNull() & F.col(y).isNotNull() & F.col(x).isNotNull()).select(F.col(plane).alias("plane"), F.col(y).cast("long").alias("y"), F.col(x).cast("long").alias("x")).distinct()
    start = F.col("x") - F.row_number().over(Window.partitionBy("plane", "y").orderBy("x"))
    return inside.withColumn("s", start).groupBy("plane", "y", "s").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("s")


def mask_components(mask: DataFrame, plane: str, y: str = "y", x: str = "x", corners: bool = False) -> DataFrame:
    """plane, y, x0, area, rows, x_min, x_max, place of each component of mask; y and x0 are its first run's, in order of rows.

    Rows become runs, runs of neighbouring rows are joined where they overlap (with corners, also where they touch at one),
    and stars contract what hangs together, so a component may be larger than a task. place ranks by area within the plane.
    Repeated pixels count once and those with a null coordinate don't; a mask without pixels has no components.
    """
    runs = mask_runs(mask, plane, y, x)
    reach = int(corners)
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / CELL), F.floor(hi / CELL))).alias("cell")
    upper = runs.select("plane", (F.col("y") + 1).alias("y"), "x0", "x1", cells(F.col("x0"), F.col("x1")))
    lower = runs.select("plane", "y", F.col("x0").alias("z0"), F.col("x1").alias("z1"), cells(F.col("x0") - reach, F.col("x1") + reach))
    met = upper.join(lower, ["plane", "y", "cell"]).where((F.col("x0") <= F.col("z1") + reach) & (F.col("z0") <= F.col("x1") + reach))
    run = lambda row, at: F.struct(F.col("plane").alias("plane"), row.alias("y"), F.col(at).alias("x0"))
    edges = met.select(run(F.col("y") - 1, "x0").alias("u"), run(F.col("y"), "z0").alias("v"))
    roots = components(edges)
    own = runs.withColumn("id", run(F.col("y"), "x0")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    made = own.groupBy("root").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.count_distinct("y").alias("rows"), F.min("x0").alias("x_min"), F.max("x1").alias("x_max"))
    order = Window.partitionBy("root.plane").orderBy(F.col("area").desc(), "root.y", "root.x0")
    return made.withColumn("place", F.row_number().over(order)).select("root.plane", "root.y", "root.x0", "area", "rows", "x_min", "x_max", "place")


def edges_of(corners: DataFrame, polygon: str, at: str, x: str, y: str) -> DataFrame:
    """polygon, x0, y0, x1, y1 of the sides of closed polygons from their corners in order of `at`; those under three corners have none."""
    own = Window.partitionBy(polygon)
    order = own.orderBy(at)
    rows = corners.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_n", F.count("*").over(own)).where("_n > 2")
    first = lambda c: F.first(c).over(order)
    return rows.select(F.col(polygon).alias("polygon"), F.col(x).alias("x0"), F.col(y).alias("y0"), F.coalesce(F.lead(x).over(order), first(x)).alias("x1"), F.coalesce(F.lead(y).over(order), first(y)).alias("y1"))


def in_polygons(points: DataFrame, key: str, x: str, y: str, edges: DataFrame, height: float) -> DataFrame:
    """key, n_polygons, inside of each point (key tells them apart): how many of the polygons hold it, and whether any does.

    Even-odd rule: a polygon's sides are cut once at each height at which points lie, in bands of the given height, and the cuts to the
    right of each point are counted along that line in one order of cuts and points. Points with a null coordinate are in none.
    """
    # few corners and points become many cuts and pairs: what is small before is dealt out by number
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    band = F.floor(F.col("_y") / height)
    sides = edges.where("y0 != y1").repartition(n).withColumn("band", F.explode(F.sequence(F.floor(F.least("y0", "y1") / height), F.floor(F.greatest("y0", "y1") / height))))
    at = points.select(F.col(key).alias("_key"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null").repartition(n)
    cut = F.col("x0") + (F.col("_y") - F.col("y0")) * ((F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    cuts = at.select("_y").distinct().withColumn("band", band).join(sides, "band").where((F.col("y0") > F.col("_y")) != (F.col("y1") > F.col("_y"))).select("_y", "polygon", cut.alias("_x"))
    met = at.join(cuts.select("_y", "polygon").distinct(), "_y")
    both = cuts.select(F.lit(None).cast(dict(at.dtypes)["_key"]).alias("_key"), "_y", "polygon", "_x", F.lit(1).alias("_cut")).unionByName(met.withColumn("_cut", F.lit(0))).repartition(n, "_y", "polygon")
    # from the right, a point before the cuts at its own place; zero has one sign
    line = Window.partitionBy("_y", "polygon").orderBy((F.col("_x") + F.lit(0.0)).desc(), "_cut").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_right", F.sum("_cut").over(line)).where("_cut = 0 and _right % 2 = 1")
    odd = inside.groupBy("_key", "polygon").agg(F.count("*").alias("n")).where("n % 2 = 1").groupBy("_key").agg(F.count("*").alias("n"))
    return points.select(key).join(odd, F.col(key) == F.col("_key"), "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n_polygons"), F.col("n").isNotNull().alias("inside"))


def resampled(samples: DataFrame, grid: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """keys, at and values of grid (keys, at), each value linear between the samples around it that have it; NULL outside of them.

    Grid points stand among the samples of their group in order; what is known last before and first behind each goes along with two
    running windows that hold one row. Samples at one place are averaged. A repeated grid point gives a row each.
    """
    place = finite(at)
    known = samples.withColumn("_at", place).where("_at is not null").groupBy(*keys, "_at").agg(*[F.avg(finite(v)).alias(v) for v in values])
    rows = known.withColumn("_grid", F.lit(False)).unionByName(grid.select(*keys, place.alias("_at"), F.lit(True).alias("_grid"), *[F.lit(None).cast("double").alias(v) for v in values]))
    # samples first among equals on the way up, and on the way down, so that a sample at the point itself is known both ways
    up = Window.partitionBy(*keys).orderBy("_at", "_grid").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.col("_at").desc(), "_grid").rowsBetween(Window.unboundedPreceding, 0)
    pair = lambda v: F.when(F.col(v).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(v).alias("v")))
    for v in values:
        rows = rows.withColumn(f"_lo_{v}", F.last(pair(v), ignorenulls=True).over(up))
    for v in values:
        rows = rows.withColumn(f"_hi_{v}", F.last(pair(v), ignorenulls=True).over(down))

    def between(v: str) -> Column:
        lo, hi = F.col(f"_lo_{v}"), F.col(f"_hi_{v}")
        share = safe_div(F.col("_at") - lo["at"], hi["at"] - lo["at"])
        return F.when(hi["at"] == lo["at"], lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * share).alias(v)

    return rows.where("_grid").select(*keys, F.col("_at").alias(at), *map(between, values))
