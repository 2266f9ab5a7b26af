"""Positions in one order of a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.scratch import saved

RANGE_ROWS = 1_000_000


def ranges(df: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """df in ranges of the order (column _range), written, and the rows before each range: a row a range."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    cut = saved(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    return cut, sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df and each row's number from 1 in an order: ranges are sorted each for itself."""
    cut, before = ranges(df, order)
    return cut.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).join(before, "_range").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_range", "_at", "_before")


def ranked(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """df and each row's rank by a column, ties with their mean rank; equal values are in one range."""
    cut, before = ranges(df, [F.col(value)])
    ties = F.count("*").over(Window.partitionBy("_range", value)) - 1
    return cut.withColumn("_at", F.rank().over(Window.partitionBy("_range").orderBy(value)) + ties / 2).join(before, "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def quantiles(df: DataFrame, value: Column, shares: list[float], held: int = 1_000_000) -> list[float | None]:
    """Exact quantiles of a column over all rows, interpolated between neighbours; nulls are left out.

    A percentile aggregate holds a count for each different value, so it is used for up to about `held` of them. Beyond, the values
    are numbered in order, range by range, and those at the ranks asked for are read.
    """
    values = df.select(value.cast("double").alias("v")).where("v is not null")
    n, different = values.agg(F.count("*"), F.approx_count_distinct("v")).first()
    if not n:
        return [None] * len(shares)
    if different <= held:
        return values.agg(F.percentile("v", F.array(*[F.lit(float(s)) for s in shares]))).first()[0]
    ranks = {k for s in shares for k in (int(s * (n - 1)), min(n - 1, int(s * (n - 1)) + 1))}
    at = {r["k"] - 1: r["v"] for r in numbered(values, [F.col("v")], "k").where(F.col("k").isin(*[k + 1 for k in ranks])).collect()}  # two rows a share
    return [at[k] + (at[min(n - 1, k + 1)] - at[k]) * (s * (n - 1) - k) for s in shares for k in [int(s * (n - 1))]]
