"""Orders, ranks and quantiles of whole tables, in ranges of a few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.functions import ordering
from strataline.operators import charts


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 7)


def test_numbers_and_ranks(spark, small_ranges):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 12, 60).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v long").repartition(5)
    got = ordering.numbered(df, [F.col("v"), F.col("id")]).orderBy("position").collect()
    assert [(r["position"], r["v"], r["id"]) for r in got] == [(k, x, i) for k, (x, i) in enumerate(sorted((x, i) for i, x in enumerate(v)), 1)]
    ranks = {r["id"]: r["rank"] for r in ordering.ranked(df, "v").collect()}
    assert all(ranks[i] == sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for i, x in enumerate(v))


def test_quantiles(spark, small_ranges):
    v = np.random.default_rng(1).standard_normal(41)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    for held in (10**6, 3):
        assert np.allclose(ordering.quantiles(df, F.col("v"), [0, 0.25, 0.5, 0.9, 1], held), np.quantile(v, [0, 0.25, 0.5, 0.9, 1]))
    assert ordering.quantiles(df.limit(0), F.col("v"), [0.5]) == [None]


def test_families_across_blocks(spark, small_ranges):
    keys = [1, 1, 2, 2, 2, None, None, 1, 1, 1, 1, 3, 1]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "at long, k long").repartition(4)
    got = {r["at"]: r["family"] for r in charts.families(df, "at", ["k"], block_rows=4).collect()}
    assert [got[i] for i in range(len(keys))] == [1, 1, 2, 2, 2, 3, 3, 4, 4, 4, 4, 5, 6]
