"""Vectors from array columns, as the embedding operators take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(c: str, length: int | None = None) -> Column:
    """True for vectors that take part: not null, not empty, of the given length, all components finite, not all zero."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    right = finite & F.exists(c, lambda x: x != 0)
    return F.coalesce(right if length is None else right & (F.size(c) == length), F.lit(False))


def common_length(df: DataFrame, c: str) -> int:
    """The length that most usable vectors have, the smallest of equals; 0 if there is none. A row a length comes to the driver."""
    rows = df.where(usable(c)).groupBy(F.size(c).alias("length")).agg(F.count("*").alias("n")).collect()
    return min(rows, key=lambda r: (-r["n"], r["length"]))["length"] if rows else 0


def sample_rows(df: DataFrame, column: str, most: int) -> np.ndarray:
    """At most `most` different vectors, those with the least hashes, so the same ones however the rows are dealt out.

    Only rows below a bound of the hash are gathered; where copies leave too few of them, the bound is raised.
    """
    n, hashed = df.count(), df.select(F.xxhash64(column).alias("h"), column)
    share = min(1.0, 2 * most / max(n, 1))
    while True:
        some = hashed if share >= 1 else hashed.where(F.col("h") < int(-(2**63) + share * 2**64))
        rows = some.groupBy("h").agg(F.first(column).alias("v")).orderBy("h").limit(most).collect()
        if len(rows) >= most or share >= 1:
            return np.array([r["v"] for r in rows], np.float64) if rows else np.zeros((0, 0))
        share = min(1.0, 16 * share)
