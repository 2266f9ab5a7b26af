"""Queries over paths on skeletons, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import skeleton
from strataline.plans.tables import table

SQL: dict[str, str] = {}


def _edges(spark, d):
    """Orders as nodes, 200 numbers a graph, tied to one shortly before; every tenth also to the fourth before, so that there are rings."""
    k, g = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 200)
    o = table(spark, d, "orders")
    w = (1 + F.col("o_custkey") % 25).cast("double")
    one = o.select(g.alias("graph"), k.alias("u"), (k - 1 - F.when(k % 3 == 0, k % 7).otherwise(0)).alias("v"), w.alias("w"))
    two = o.where(k % 10 == 0).select(g.alias("graph"), k.alias("u"), (k - 4).alias("v"), w.alias("w"))
    return skeleton.both_ways(one.union(two).where(F.floor(F.col("v") / 200) == F.col("graph")))


_EDGES = """o AS (SELECT o_orderkey // 200 AS g, o_orderkey AS k, 1 + o_custkey % 25 AS w FROM orders),
f AS (SELECT g, k AS u, k - 1 - CASE WHEN k % 3 = 0 THEN k % 7 ELSE 0 END AS v, w FROM o UNION ALL SELECT g, k, k - 4, w FROM o WHERE k % 10 = 0),
e AS (SELECT g, u, v, min(w) AS w FROM (SELECT * FROM f UNION ALL SELECT g, v, u, w FROM f) WHERE least(u, v) >= 0 AND u // 200 = g AND v // 200 = g GROUP BY ALL)"""


def skeleton_distances(spark, d):
    """The shortest way from the least node of each graph to all it reaches."""
    edges = _edges(spark, d)
    return skeleton.distances(edges, edges.groupBy("graph").agg(F.min("u").alias("node")))


SQL["skeleton_distances"] = f"""WITH RECURSIVE {_EDGES}, s AS (SELECT g, min(u) AS n FROM e GROUP BY g),
r(g, n, d) USING KEY (g, n) AS (SELECT g, n, 0 FROM s UNION
  SELECT r.g, e.v, min(r.d + e.w) FROM r JOIN e ON e.g = r.g AND e.u = r.n LEFT JOIN recurring.r x ON x.g = e.g AND x.n = e.v WHERE x.d IS NULL OR r.d + e.w < x.d GROUP BY r.g, e.v),
p AS (SELECT a.g, a.n, arg_min(e.v, (b.d + e.w) * 1000000000 + e.v) AS prev FROM r a JOIN e ON e.g = a.g AND e.u = a.n JOIN r b ON b.g = e.g AND b.n = e.v GROUP BY ALL)
SELECT r.g AS graph, r.n AS node, CAST(r.d AS DOUBLE) AS distance, CASE WHEN s.n IS NULL THEN p.prev END AS prev FROM r JOIN p USING (g, n) LEFT JOIN s USING (g, n)"""


def skeleton_paths(spark, d):
    """The longest path of each graph once side branches of under five nodes are gone."""
    return skeleton.longest_paths(skeleton.pruned(_edges(spark, d), 5))


QUERIES = {f.__name__: f for f in (skeleton_distances, skeleton_paths)}
