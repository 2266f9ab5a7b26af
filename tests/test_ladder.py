"""The cohort ladder's counts of names, and how they are dealt out."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import cohort

KEYS = ["genotype", "mouse", "segment"]


def rows(spark, n):
    """n rows: each name in two regions, one hot name in every other row, every seventh row without one."""
    name = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 2 == 0, "hot").otherwise(F.floor(F.col("id") / 4).cast("string"))
    return spark.range(n).select(name.alias("name"), *[F.when(F.col("id") >= 0, k).alias(c) for k, c in (("g", "genotype"), ("m", "mouse"))], (F.floor(F.col("id") / 2) % 2).cast("string").alias("segment"), F.lit(1.0).alias("wall_length_um"))


def names(n, segment=None):
    kept = [i for i in range(n) if i % 7 and segment in (None, str(i // 2 % 2))]
    return len({"hot" if i % 2 == 0 else str(i // 4) for i in kept})


def test_a_name_counts_once_for_a_region_and_once_for_its_subject(spark):
    found = {r["segment"]: (r["n_sections"], r["n_vessels"]) for r in cohort.ladder(rows(spark, 3000)).collect()}
    assert found == {"0": (names(3000, "0"), 1500), "1": (names(3000, "1"), 1500), "all segments": (names(3000), 3000)}


def test_subjects_without_names_count_none(spark):
    found = cohort.ladder(rows(spark, 100).withColumn("name", F.lit(None).cast("string")), listed=True).collect()
    assert [(r["n_sections"], r["sections"]) for r in found] == [(0, None)] * 3


def test_tasks_of_names_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(cohort, "TASK_NAMES", 100)
    made = cohort._names(rows(spark, 3000), KEYS, "name", 3000)
    held = made.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(held) > 20 and max(r["count"] for r in held) < 150
    assert made.where("value = 'hot'").agg(F.sum("n")).first()[0] == sum(1 for i in range(3000) if i % 7 and i % 2 == 0)
