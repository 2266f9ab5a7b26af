"""The driver's tables as the operators' inputs, on both sides: DataFrames, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, as the SQL does, so that the order of additions doesn't show."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as measured sections: subject the nation, group the market segment, region the return flag."""
    li, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    return (
        li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
        .select(
            F.col("o_orderkey").cast("string").alias("name"), F.col("c_mktsegment").alias("genotype"), F.col("n_name").alias("mouse"), F.col("l_returnflag").alias("segment"), F.col("o_orderstatus").alias("age"), F.col("o_orderpriority").alias("slide"),
            F.col("l_quantity").alias("wall_length_um"), F.col("l_extendedprice").alias("media_area_um2"), (F.col("l_extendedprice") * F.col("l_discount")).alias("collagen_od_um2_total"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("muscle_od_um2_total"),
            (F.col("l_quantity") * F.col("l_tax")).alias("collagen_area_um2_total"), F.col("l_discount").alias("muscle_variation"), (F.col("l_quantity") * F.col("l_discount")).alias("lamellar_spacing_um"), F.col("l_tax").alias("lamellar_coverage"),
        )
    )


SECTIONS = """sections AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS name, c.c_mktsegment AS genotype, n.n_name AS mouse, l.l_returnflag AS segment, o.o_orderstatus AS age, o.o_orderpriority AS slide,
         l.l_quantity AS len, l.l_extendedprice AS area, l.l_extendedprice * l.l_discount AS col, l.l_extendedprice * (1 - l.l_discount) AS mus,
         l.l_quantity * l.l_tax AS colarea, l.l_discount AS var, l.l_quantity * l.l_discount AS spacing, l.l_tax AS cover
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

#: The aggregates of pool over `sections`, and the readouts of its sums.
POOLED = """sum(len) AS L, sum(area) AS A, sum(col) AS C, sum(mus) AS M, sum(colarea) AS CA,
  sum(CASE WHEN len > 0 THEN var * len END) / sum(CASE WHEN len > 0 THEN len END) AS var,
  sum(CASE WHEN len * cover > 0 THEN spacing * len * cover END) / nullif(sum(CASE WHEN len * cover > 0 THEN len * cover END), 0) AS spacing,
  sum(CASE WHEN len > 0 THEN cover * len END) / sum(CASE WHEN len > 0 THEN len END) AS cover,
  count(DISTINCT name) AS n_sections, count(*) AS n_vessels, count(DISTINCT slide) AS n_slides,
  CASE WHEN count(DISTINCT age) = 1 THEN max(age) ELSE 'unknown' END AS age"""
READOUTS = """CASE WHEN M > 0 THEN C / M END AS collagen_to_muscle_ratio, CASE WHEN C + M > 0 THEN C / (C + M) END AS collagen_fraction_of_stain,
  CASE WHEN L > 0 THEN A / L END AS mean_media_thickness_um, CASE WHEN L > 0 THEN C / (L / 1000) END AS collagen_od_um2_per_mm_length,
  CASE WHEN L > 0 THEN M / (L / 1000) END AS muscle_od_um2_per_mm_length, CASE WHEN A > 0 THEN CA / A END AS collagen_area_fraction_media"""
READOUT_NAMES = ["collagen_to_muscle_ratio", "collagen_fraction_of_stain", "mean_media_thickness_um", "collagen_od_um2_per_mm_length", "muscle_od_um2_per_mm_length", "collagen_area_fraction_media"]
