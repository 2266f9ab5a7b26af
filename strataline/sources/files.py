"""Folders, override tables, layouts, sessions and result tables, all through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.operators.naming import natural_key

# Suffixes of images, fields of an override table.
IMAGE_SUFFIXES = ("tif", "tiff", "png", "jpg", "jpeg", "bmp", "czi")
OVERRIDE_FIELDS = ("mouse", "genotype", "age", "segment", "slide", "section")
OVERRIDE_KEYS = ("folder", "name", "section_folder")


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, recursive: bool = False) -> DataFrame:
    """path, parent, name, length and modification time of files with these suffixes, hidden ones left out, with a natural sort key.

    Only the listing is read: content is pruned.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length", "modificationTime")
    named = df.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("parent", F.element_at(F.split("path", "/"), -2))
    return named.where(F.lower(F.regexp_extract("name", r"\.([^.]*)\z", 1)).isin(*suffixes) & ~F.col("name").startswith(".")).withColumn("sort_key", natural_key(F.col("name")))


def scan_tray(spark: SparkSession, tray: str) -> DataFrame:
    """A row for each sub-folder with images: its name and how many."""
    return list_files(spark, tray, recursive=True).groupBy("parent").agg(F.count("*").alias("images")).withColumnRenamed("parent", "folder")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """key and override fields of a CSV table: all text, blanks NULL, of repeated keys the last row."""
    raw = spark.read.option("header", True).csv(path)
    key = next((k for k in OVERRIDE_KEYS if k in raw.columns), None)
    if key is None:
        raise ValueError(f"no key column among {', '.join(OVERRIDE_KEYS)}")
    raw = raw.withColumn("at", F.monotonically_increasing_id())
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    last = raw.where(blank(key).isNotNull()).groupBy(F.trim(key).alias("key")).agg(*[F.max_by(c, "at").alias(c) for c in raw.columns if c not in (key, "at")])
    return last.select("key", *[blank(c).alias(c) for c in last.columns if c != "key"])


def merge_overrides(old: DataFrame, updates: DataFrame) -> DataFrame:
    """old with updates: a value replaces, an empty text clears, NULL leaves alone; keys without any value fall out.

    Both have key and columns; columns of only one side stay.
    """
    columns = [*[c for c in old.columns if c != "key"], *[c for c in updates.columns if c not in old.columns]]
    o = old.select("key", *[F.col(c).alias(f"o_{c}") for c in old.columns if c != "key"])
    u = updates.select("key", *[F.col(c).alias(f"u_{c}") for c in updates.columns if c != "key"])
    both = o.join(u, "key", "full")
    pick = {}
    for c in columns:
        was = F.col(f"o_{c}") if c in old.columns else F.lit(None).cast("string")
        pick[c] = F.when(F.col(f"u_{c}") == "", F.lit(None)).otherwise(F.coalesce(f"u_{c}", was)) if c in updates.columns else was
    made = both.select("key", *[v.alias(c) for c, v in pick.items()])
    return made.where(F.coalesce(*[F.col(c) for c in columns]).isNotNull())


TILE = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("path", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("px_um", T.DoubleType())])
POSE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("theta", T.DoubleType()), T.StructField("island", T.IntegerType()), T.StructField("placed", T.BooleanType()), T.StructField("locked", T.BooleanType())])
LAYOUT = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("tiles", T.ArrayType(TILE)), T.StructField("poses", T.ArrayType(POSE)), T.StructField("params", T.MapType(T.StringType(), T.StringType()))])


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """A row a tile with its pose, from layout files."""
    df = spark.read.schema(LAYOUT).option("multiLine", True).json(path)
    return df.select(F.explode(F.arrays_zip("tiles", "poses")).alias("z")).select("z.tiles.*", "z.poses.*")


def write_layout(tiles: DataFrame, path: str, params: dict[str, str] | None = None) -> None:
    """Tiles with poses as one layout document; a layout is one mosaic."""
    tile = F.struct(*[F.col(f.name) for f in TILE])
    pose = F.struct(*[F.col(f.name) for f in POSE])
    rows = tiles.agg(F.array_sort(F.collect_list(F.struct(F.col("index").alias("k"), tile.alias("t"), pose.alias("p")))).alias("r"))
    made = rows.select(F.lit(2).alias("version"), F.transform("r", lambda x: x["t"]).alias("tiles"), F.transform("r", lambda x: x["p"]).alias("poses"), F.create_map(*[F.lit(v) for kv in (params or {"engine": "spark"}).items() for v in kv]).alias("params"))
    made.write.mode("overwrite").json(path)


def restore_poses(now: DataFrame, saved: DataFrame) -> DataFrame:
    """Poses of a saved layout for tiles of the same name; other tiles keep theirs. restored: whether it had one."""
    old = saved.select("name", *[F.col(f.name).alias(f"old_{f.name}") for f in POSE], F.lit(True).alias("found"))
    made = now.join(old, "name", "left")
    return made.select(*[F.coalesce(f"old_{c}", c).alias(c) if c in POSE.names else F.col(c) for c in now.columns], F.coalesce("found", F.lit(False)).alias("restored"))


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """One table in each sub-folder cohort_<name>; lists become text for CSV."""
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) and kind == "csv" else F.col(c) for c, t in df.dtypes])
        writer = flat.write.mode("overwrite")
        (writer.option("header", True).csv if kind == "csv" else writer.parquet)(f"{folder}/cohort_{name}")


def read_tables(spark: SparkSession, folder: str, names: list[str], kind: str = "csv") -> dict[str, DataFrame]:
    """Those of the named tables that are there and can be read."""
    from pyspark.errors import AnalysisException

    out = {}
    for n in names:
        try:
            reader = spark.read.option("header", True).option("inferSchema", True)
            out[n] = (reader.csv if kind == "csv" else spark.read.parquet)(f"{folder}/cohort_{n}")
        except AnalysisException:
            continue
    return out


# Endings of the files of one section's results.
PARTS = {"profile": "along_wall", "depth": "depth_absolute_um", "depth_relative": "depth_relative", "totals": "totals", "lesions": "lesions", "points": "points"}


def write_results(results: dict[str, DataFrame], folder: str, section: str = "section", kind: str = "csv") -> list[str]:
    """Results of many sections at once: <folder>/<part>/<section>=..., and the profile with its running ratio.

    results: those of PARTS that there are, each with the section column; a part without rows is not written. Returns the parts.
    """
    from strataline.operators.profile import running_ratio

    written = []
    for part, name in PARTS.items():
        df = results.get(part)
        if df is None or df.isEmpty():
            continue
        if part == "profile" and {"arc_um", "collagen_od_um", "muscle_od_um"} <= set(df.columns):
            df = running_ratio(df, [section], ["arc_um"], "collagen_od_um", "muscle_od_um").withColumnRenamed("running_ratio", "collagen_to_muscle_running")
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) and kind == "csv" else F.col(c) for c, t in df.dtypes])
        writer = flat.write.mode("overwrite").partitionBy(section)
        (writer.option("header", True).csv if kind == "csv" else writer.parquet)(f"{folder}/{name}")
        written.append(part)
    return written


def read_results(spark: SparkSession, folder: str, kind: str = "csv") -> dict[str, DataFrame]:
    """Those parts of written results that are there."""
    from pyspark.errors import AnalysisException

    out = {}
    for part, name in PARTS.items():
        try:
            reader = spark.read.option("header", True).option("inferSchema", True)
            out[part] = (reader.csv if kind == "csv" else spark.read.parquet)(f"{folder}/{name}")
        except AnalysisException:
            continue
    return out


SESSION = T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("saved", T.TimestampType()), T.StructField("settings", T.MapType(T.StringType(), T.StringType())), T.StructField("tiles", T.ArrayType(T.StringType())), T.StructField("poses", T.ArrayType(POSE)), T.StructField("matches", T.StringType())])


def write_session(tiles: DataFrame, matches: DataFrame | None, path: str, name: str, settings: dict[str, str] | None = None) -> None:
    """One session as a document: settings, where the tiles (by name) ended up, and the accepted matches it was solved from."""
    pose = F.struct(*[F.col(f.name) for f in POSE])
    rows = tiles.agg(F.array_sort(F.collect_list(F.struct(F.col("index").alias("k"), F.col("name").alias("n"), pose.alias("p")))).alias("r"))  # the tiles of one mosaic
    kept = F.lit(None).cast("string")
    if matches is not None:
        rows = rows.join(F.broadcast(matches.agg(F.to_json(F.collect_list(F.struct(*[F.col(c) for c in matches.columns]))).alias("m"))))  # one row each
        kept = F.col("m")
    options = F.create_map(*[F.lit(str(v)) for kv in settings.items() for v in kv]) if settings else F.lit(None).cast("map<string,string>")
    rows.select(F.lit(name).alias("name"), F.lit(2).alias("version"), F.current_timestamp().alias("saved"), options.alias("settings"), F.transform("r", lambda x: x["n"]).alias("tiles"), F.transform("r", lambda x: x["p"]).alias("poses"), kept.alias("matches")).write.mode("overwrite").json(path)


def read_session(spark: SparkSession, path: str, match: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(name, version, saved, settings), tiles with poses, and matches by the given schema of one."""
    df = spark.read.schema(SESSION).json(path)
    tiles = df.select(F.posexplode(F.arrays_zip("tiles", "poses")).alias("index", "z")).select("index", F.col("z.tiles").alias("name"), "z.poses.*")
    found = None if match is None else df.select(F.explode(F.from_json("matches", f"array<struct<{match}>>")).alias("m")).select("m.*")
    return df.select("name", "version", "saved", "settings"), tiles, found
