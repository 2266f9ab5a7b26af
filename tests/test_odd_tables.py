"""Registered queries give their SQL's rows on tables that the driver's small ones don't show."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from strataline.functions import components
from strataline.operators import graph, layout, planes, series
from strataline.plans import catalog
from tests.compare import SF, same


def check(spark, folder, tables, *queries):
    """Each query over tables (name: schema and rows) written to a folder, against its SQL over the same file."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, (schema, values) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(values, schema).coalesce(1).write.mode("overwrite").parquet(path)
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    for q in queries:
        same(catalog.QUERIES[q](spark, str(folder)), con, catalog.ORACLE_SQL[q])


@pytest.mark.parametrize("query", ["psth_rates", "active_span"])
def test_times_between_milliseconds(spark, tmp_path, query):
    """Times half a millisecond and less before a bin's border, also before 1970."""
    at = [datetime.datetime(*day) for day in ((2024, 1, 1, 0, 5), (2024, 1, 1, 2), (1969, 12, 31, 23, 55), (1969, 12, 31, 21))]
    near = [t + datetime.timedelta(microseconds=u) for t in at for u in (-1501, -1500, -501, -500, -499, 0, 499, 500)]
    rows = [(k, t, k % 3, "view", float(v)) for k, t in enumerate(near) for v in (0, k * k)]
    check(spark, tmp_path, {"events": ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double", rows)}, query)


def test_roles_of_numbers_of_five_digits(spark, tmp_path):
    """A number of the file stays its field when it has five digits; in a batch's scheme it is whole up to four."""
    rows = [(k, f"Brand#{k % 5}", k % 7) for k in (0, 1, 7, 9999, 10_000, 123_456, 20_240_101)]
    check(spark, tmp_path, {"part": ("p_partkey long, p_brand string, p_size int", rows)}, "part_roles", "batch_schemes")


def test_overlaps_of_equal_rectangles(spark, tmp_path, monkeypatch):
    """Rectangles of which many are the same, keys more than a list holds, by their SQL; a group meets once, not once a pair of rows."""
    monkeypatch.setattr(graph, "LISTED", 7)
    rows = [(k, k % 2 * 3 + 2) for k in range(0, 180 * 40, 60)] + [(180 * k + 1, 5) for k in range(60)]
    check(spark, tmp_path, {"part": ("p_partkey long, p_size int", rows)}, "rect_overlap_join")


def test_overlaps_hold_no_pairs_of_two_lists(spark):
    """Keys of either list become rows in steps of their own: a task holds the pairs of one key, not those of two lists."""
    made = graph.rectangle_overlaps(spark.range(50).selectExpr("id", "0.0 x", "0.0 y", "4.0 w", "4.0 h"), "id", "x", "y", "w", "h", 4.0, 8.0)
    assert made.count() == 50 * 49 // 2
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert -1 < plan.index("Generate explode(b_ks") < plan.index("Coalesce") < plan.index("Generate explode(a_ks")


def test_overlaps_of_odd_rectangles(spark):
    """Missing keys and sides link nothing, a repeated key not with itself."""
    rows = [(1, 0.0, 0.0, 4.0, 4.0), (1, 1.0, 1.0, 4.0, 4.0), (2, 1.0, 1.0, 4.0, 4.0), (2, 1.0, 1.0, 4.0, 4.0), (None, 0.0, 0.0, 4.0, 4.0), (3, None, 0.0, 4.0, 4.0), (4, 50.0, 0.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double, w double, h double")
    got = graph.rectangle_overlaps(df, "k", "x", "y", "w", "h", 4.0, 8.0).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 9.0), (1, 2, 9.0), (1, 2, 16.0), (1, 2, 16.0)]


def test_points_on_one_line_share_its_cuts(spark, tmp_path):
    """Points at few heights in polygons of many sides: at corners, on sides, repeated keys, missing places; sides are cut once a height."""
    suppliers = [(k, k % 3, float(k * 37 % 101) * 90) for k in range(0, 60)]
    customers = [(k % 400, None if k % 29 == 0 else float(k * 37 % 101) * 90 + (k % 2) * 0.25) for k in range(410)]
    customers += [(1000 * k, 4500.0) for k in range(1, 300)]
    check(spark, tmp_path, {"supplier": ("s_suppkey long, s_nationkey int, s_acctbal double", suppliers), "customer": ("c_custkey long, c_acctbal double", customers)}, "polygon_union")
    corners = spark.createDataFrame([(k % 5, k, float(k * 31 % 97), float(k * 57 % 89)) for k in range(500)], "p int, k long, x double, y double")
    points = spark.createDataFrame([(k, float(k % 97), 10.5) for k in range(2000)], "k long, x double, y double")
    made = planes.in_polygons(points, "k", "x", "y", planes.edges_of(corners, "p", "k", "x", "y"), 20.0)
    assert made.count() == 2000 and "Aggregate [_y" in made._jdf.queryExecution().optimizedPlan().toString()


def test_best_edges_are_ranked_in_as_many_tasks_as_a_shuffle_has(spark):
    """Edges are few bytes and many rows: by bytes they would all come to one task."""
    made = graph.best_edges(spark.range(1000).selectExpr("id i", "id + 1 j", "id % 7 / 7.0 quality"), 2)
    assert "RepartitionByExpression [tile" in made._jdf.queryExecution().optimizedPlan().toString()


def test_weighted_median_adds_equal_values_first(spark, tmp_path):
    """The order of a group holds different values only; rows without a value come first, as in a range."""
    rows = [(f, v, w) for f in "AB" for v in (0.1, 0.2, 0.3, None) for w in (1.0, 2.0, 5.0, None)] + [("C", 0.5, 1.0)]
    check(spark, tmp_path, {"lineitem": ("l_returnflag string, l_discount double, l_quantity double", [r for r in rows if r[1] is not None])}, "weighted_median")
    made = series.weighted_median(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], "v", "w")
    assert {r["k"]: r["weighted_median"] for r in made.collect()} == {"A": 0.1, "B": 0.1, "C": 0.5} and "RangeFrame" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_labels_of_one_small_file_are_many_tasks(spark):
    """Names are few bytes and much work: a table of one file is dealt out."""
    assert catalog.QUERIES["labels_of_files"](spark, SF).rdd.getNumPartitions() > 1


def test_section_names_of_one_small_file_are_many_tasks(spark):
    assert catalog.QUERIES["parse_section_names"](spark, SF).rdd.getNumPartitions() > 1


def broadcasts(df):
    """How often a plan that has run sends a table to all."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_components_send_no_table_to_the_driver(spark):
    steps = components._stars(spark.range(1000).selectExpr("id + 1 u", "id v"))
    assert broadcasts(steps) == 0
    assert broadcasts(graph.components(spark.range(50).selectExpr("id i", "id + 1 j"))) == 0


def test_layouts_send_only_one_row_to_all(spark):
    """A chain, and one with weak joins: forests, places, votes and groups on slivers; the median alone is broadcast."""
    joins = spark.createDataFrame([(k, k + 1, 1.0 / (k + 1), 1.0, 0.0) for k in range(12)], "i long, j long, quality double, dx double, dy double")
    forest, places = layout.best_forest(joins)
    assert broadcasts(places) == 0 and forest.count() == 12 and {(r["tile"], r["island"], r["x"]) for r in places.collect()} == {(k, 0, float(k)) for k in range(13)}
    assert broadcasts(layout.shift_votes(places.withColumn("island", F.col("tile") % 2), joins, 1.0)) == 0
    groups, held = layout.sliver_groups(places, joins.select("i", "j", F.when(F.col("i") == 5, 0.01).otherwise(1.0).alias("shared")))
    assert broadcasts(groups) == 0 and broadcasts(held) == 0 and [(r["i"], r["j"]) for r in held.collect()] == [(5, 6)]
