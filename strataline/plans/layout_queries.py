"""Queries over layouts of tiles, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.functions.core import unsent
from strataline.operators import layout
from strataline.plans.tables import rounded, table
from strataline.sources import positions

SQL: dict[str, str] = {}

_ACCEPT = 55_000


def _joins(spark, d):
    """Parts as tiles, joined with the three that follow; the quality is the mean discount in millionths, exact on both sides."""
    li = table(spark, d, "lineitem")
    i = F.col("l_partkey")
    made = li.groupBy(i.alias("i"), (i + 1 + F.col("l_suppkey") % 3).alias("j")).agg(F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("s"), F.count("*").alias("n"))
    at = lambda t, a, m: F.col(t) * a % m
    return made.select("i", "j", F.expr("s * 10000 div n").alias("quality"), (at("j", 37, 1009) - at("i", 37, 1009)).cast("double").alias("dx"), (at("j", 53, 997) - at("i", 53, 997)).cast("double").alias("dy"), "n")


_JOINS = f"""j AS (SELECT l_partkey AS i, l_partkey + 1 + l_suppkey % 3 AS j, sum(CAST(round(l_discount * 100) AS BIGINT)) * 10000 // count(*) AS quality, count(*) AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT i, j, CAST(quality AS BIGINT) AS quality, row_number() OVER (ORDER BY quality DESC, i, j) AS o FROM j WHERE quality >= {_ACCEPT})"""
_PLACES = """r(a, b) AS (SELECT i, i FROM e UNION SELECT j, j FROM e UNION SELECT r.a, CASE WHEN r.b = e.i THEN e.j ELSE e.i END FROM r JOIN e ON r.b IN (e.i, e.j)),
c AS (SELECT a AS tile, min(b) AS island FROM r GROUP BY a)"""


def _accepted(spark, d):
    return _joins(spark, d).where(F.col("quality") >= _ACCEPT)


def layout_forest(spark, d):
    return layout.best_forest(_accepted(spark, d))[0]


SQL["layout_forest"] = f"""WITH RECURSIVE {_JOINS}, b AS (SELECT i AS u, j AS v, o FROM e UNION ALL SELECT j, i, o FROM e),
r(o, v) AS (SELECT o, i FROM e UNION SELECT r.o, b.v FROM r JOIN b ON b.u = r.v AND b.o < r.o)
SELECT i, j, quality FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.o = e.o AND r.v = e.j)"""


def layout_places(spark, d):
    return layout.best_forest(_accepted(spark, d))[1]


SQL["layout_places"] = f"""WITH RECURSIVE {_JOINS}, {_PLACES}
SELECT tile, island, CAST(tile * 37 % 1009 - island * 37 % 1009 AS DOUBLE) AS x, CAST(tile * 53 % 997 - island * 53 % 997 AS DOUBLE) AS y FROM c"""


def islands_merged(spark, d):
    """Islands of the accepted joins, put together by the others where two of them or more agree; every fifth of those is off."""
    joins = _joins(spark, d)
    off = F.when((F.col("quality") < _ACCEPT) & ((F.col("i") + F.col("j")) % 5 == 0), 40.0).otherwise(0.0)
    return layout.merge_islands(layout.best_forest(_accepted(spark, d))[1], joins.withColumn("dx", F.col("dx") + off), 5.0)


def sliver_joins(spark, d):
    """What holds the parts of an island that share little, by the number of order lines of a join."""
    joins = _accepted(spark, d)
    groups, cuts = layout.sliver_groups(layout.best_forest(joins)[1], joins.select("i", "j", F.col("n").cast("double").alias("shared")), share=0.6)
    main = groups.groupBy("island").agg(F.count_if("main").alias("n_main"), F.count("*").alias("n"))
    return rounded(cuts.join(unsent(groups.select(F.col("tile").alias("i"), "island")), "i").join(unsent(main), "island"), 6)


SQL["sliver_joins"] = f"""WITH RECURSIVE {_JOINS}, {_PLACES},
m AS (SELECT median(j.n) AS typical FROM j JOIN e USING (i, j)), h AS (SELECT j.i, j.j, j.n, j.n / typical AS ratio FROM j JOIN e USING (i, j), m),
s(a, b) AS (SELECT tile, tile FROM c UNION SELECT s.a, CASE WHEN s.b = h.i THEN h.j ELSE h.i END FROM s JOIN h ON s.b IN (h.i, h.j) AND h.ratio >= 0.6),
p AS (SELECT a AS tile, min(b) AS part FROM s GROUP BY a), z AS (SELECT island, part, count(*) AS size FROM p JOIN c USING (tile) GROUP BY ALL),
k AS (SELECT island, max(size) AS n_main, CAST(sum(size) AS BIGINT) AS n FROM z GROUP BY island HAVING sum(size) >= 6 AND count(*) > 1)
SELECT h.i, h.j, CAST(h.n AS DOUBLE) AS shared, x.part AS part_i, y.part AS part_j, round(h.ratio, 6) AS ratio, c.island, k.n_main, k.n
FROM h JOIN p x ON x.tile = h.i JOIN p y ON y.tile = h.j JOIN c ON c.tile = h.i JOIN k USING (island) WHERE x.part <> y.part"""


def nearest_in_plane(spark, d):
    """Customers as branch points, order lines' parts and suppliers as places of the curve."""
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("point"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") * 7919 % 1000).cast("double").alias("y"))
    curve = table(spark, d, "orders").select(F.col("o_orderkey").alias("arc"), (F.col("o_totalprice") % 1000).alias("x"), (F.col("o_orderkey") * 31 % 1000).cast("double").alias("y"))
    return rounded(layout.nearest_in_plane(points, curve, 60.0))


SQL["nearest_in_plane"] = """WITH p AS (SELECT c_custkey AS point, c_acctbal / 10 AS x, CAST(c_custkey * 7919 % 1000 AS DOUBLE) AS y FROM customer),
c AS (SELECT o_orderkey AS arc, o_totalprice % 1000 AS x, CAST(o_orderkey * 31 % 1000 AS DOUBLE) AS y FROM orders),
b AS (SELECT point, arc, sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS d FROM p JOIN c ON c.y BETWEEN p.y - 61 AND p.y + 61 AND c.x BETWEEN p.x - 61 AND p.x + 61)
SELECT point, arc, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d, arc) AS k FROM b WHERE d <= 60) WHERE k = 1"""

QUERIES = {f.__name__: f for f in (layout_forest, layout_places, islands_merged, sliver_joins, nearest_in_plane)}


def complete_groups(spark, d):
    """Customers as groups of orders as sections: pooled only if each of the orders has lines, and none of them is all returned."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("item"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.sum("l_quantity").alias("quantity"), F.min(F.col("l_returnflag") == "R").alias("returned"))
    good, _ = positions.complete_groups(orders, lines.select("item", F.when(F.col("returned"), "returned").alias("reason")))
    return rounded(good.join(lines, "item").groupBy("group").agg(F.count("*").alias("sections"), F.sum("quantity").alias("quantity")))


SQL["complete_groups"] = """WITH l AS (SELECT l_orderkey, sum(l_quantity) AS q, min(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1)
SELECT o_custkey AS "group", count(*) AS sections, round(sum(q), 6) AS quantity FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_custkey HAVING count(q) = count(*) AND max(r) = 0"""
QUERIES["complete_groups"] = complete_groups
