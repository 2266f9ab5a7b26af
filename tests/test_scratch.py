"""Tables in the shared folder."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from strataline.functions.scratch import CLEANUP, saved


def shuffles(spark) -> set[str]:
    """Names of the shuffle files that driver and executors (one process here) hold."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def left_after(spark, work) -> set[str]:
    """Shuffle files that work leaves for more than some seconds."""
    before = shuffles(spark)
    work()
    until = time.time() + 10
    while (left := shuffles(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left


def test_a_saved_table_leaves_no_shuffle_files(spark):
    rows = spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    made = []
    assert not left_after(spark, lambda: made.append(saved(rows, "counts")))
    assert {tuple(r) for r in made[0].collect()} == {(k, 1000) for k in range(10)}
    assert {tuple(r) for r in saved(rows, "again").collect()} == {(k, 1000) for k in range(10)}
    assert spark.conf.get(CLEANUP, None) is None


def test_the_session_keeps_its_own_setting(spark):
    spark.conf.set(CLEANUP, "false")
    try:
        saved(spark.range(10), "ten")
        assert spark.conf.get(CLEANUP) == "false"
    finally:
        spark.conf.unset(CLEANUP)
