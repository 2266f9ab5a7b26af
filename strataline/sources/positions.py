"""Positions of many sections from their files, whole groups or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTED = "counted"


def complete_groups(listing: DataFrame, reasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (group, item, ...) of listing whose whole group is good, and what spoils the others: group, item, reason.

    reasons: item, reason of every item that is known, the reason NULL where it is good. An item that isn't known is missing; a NULL item
    spoils its group too. Known items that no group lists are ignored; an item may stand in several groups.
    """
    known = reasons.groupBy("item").agg(F.max("reason").alias("reason"), F.lit(True).alias("known"))
    judged = listing.select("group", "item").distinct().join(known, "item", "left")
    reason = F.when(F.col("item").isNull(), "no item").when(F.col("known").isNull(), "missing").otherwise(F.col("reason"))
    bad = judged.select("group", "item", reason.alias("reason")).where("reason is not null")
    spoiled = bad.select(F.col("group").alias("spoiled")).distinct()
    return listing.join(spoiled, listing["group"].eqNullSafe(spoiled["spoiled"]), "left_anti"), bad


def read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """item (the path below folder), names and lines of each CSV file: a row a file, which is one section's table; an empty file gives none."""
    path = F.regexp_replace(F.col("_metadata.file_path"), r"\Afile:/+", "/")
    root = folder.removeprefix("file://").rstrip("/") + "/"
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.csv")
    lines = F.split(F.regexp_replace("value", r"\A\x{feff}", ""), r"\r\n|\n|\r")
    cut = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path)
    made = raw.select(cut.alias("item"), lines.alias("lines"))
    return made.select("item", F.transform(F.split(F.element_at("lines", 1), ","), F.trim).alias("names"), F.filter(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda c: F.trim(c) != "").alias("lines"))


def counted_positions(listing: DataFrame, tables: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """group, item and columns (doubles) of all counted positions, and the reasons why groups are left out.

    listing: group, item; tables: item, names, lines, as read_tables gives them (cells have no quoted commas). A group is left out
    whole if one of its files is missing or empty, lacks a column or has no counted position. A file without a column `counted` counts all;
    an empty or foreign cell is NULL.
    """
    cell = lambda c: F.try_element_at(F.col("cells"), F.array_position("names", c).cast("int"))
    lacking = F.array_except(F.array(*map(F.lit, columns)), "names")
    lines = tables.where(F.size(lacking) == 0).select("item", "names", F.explode("lines").alias("line")).select("item", "names", F.transform(F.split("line", ","), F.trim).alias("cells"))
    # a column that isn't there has position 0, which no array has
    flag = F.when(F.array_contains("names", COUNTED), F.lower(cell(COUNTED)).isin("true", "1", "1.0")).otherwise(True)
    number = lambda c: F.nanvl(cell(c).try_cast("double"), F.lit(None).cast("double"))
    rows = lines.where(flag).select("item", *[number(c).alias(c) for c in columns])
    some = rows.select("item").distinct().withColumn("some", F.lit(True))
    why = F.when(F.size(lacking) > 0, F.concat(F.lit("no column "), F.array_join(lacking, ", "))).when(F.col("some").isNull(), "no counted position")
    good, bad = complete_groups(listing.select("group", "item"), tables.select("item", lacking.alias("lacking"), "names").join(some, "item", "left").select("item", why.alias("reason")))
    return good.distinct().join(rows, "item").select("group", "item", *columns), bad
