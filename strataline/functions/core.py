"""Conventions that every operator follows: NULL is the only missing value, division is guarded, keys are never blank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """The value, or NULL if it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def number(df: DataFrame, name: str) -> Column:
    """A column as a finite double: what can't be read as one, and a column that is absent, is NULL."""
    return finite(F.col(name).try_cast("double")) if name in df.columns else F.lit(None).cast("double")


def safe_div(num, den) -> Column:
    """num / den where the denominator is finite and positive, else NULL."""
    d = finite(den)
    return F.when(d > 0, finite(num) / d)


def key_or_unknown(c) -> Column:
    """Blank keys are one group of their own."""
    return F.coalesce(F.nullif(col(c).cast("string"), F.lit("")), F.lit(UNKNOWN))


def constant_or_unknown(c) -> Column:
    """Aggregate: the one value that a group's rows share, else unknown."""
    value = F.nullif(col(c).cast("string"), F.lit(""))
    return F.when(F.min(value) == F.max(value), F.max(value)).otherwise(F.lit(UNKNOWN))


def weighted_mean(value, weight) -> Column:
    """Aggregate: mean over rows with a value and a positive weight; NULL if there is none."""
    v, w = finite(value), finite(weight)
    use = v.isNotNull() & (w > 0)
    return safe_div(F.sum(F.when(use, v * w)), F.sum(F.when(use, w)))


def unpivot(df: DataFrame, keys: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, [F.col(v).cast("double").alias(v) for v in values], name, value)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df over as many tasks as a shuffle has, by columns or row by row, however few bytes it is: for rows that are small but make much work or many rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def unsent(df: DataFrame) -> DataFrame:
    """df for a join by sorted partitions: a table that grows with the input and seems small in a file isn't sent through the driver, round by round."""
    return df.hint("merge")


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
