"""Queries over tables of pixels, corners and samples, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import planes
from strataline.plans.tables import rounded, table

SQL: dict[str, str] = {}

_SIDE = 32


def flat_field(spark, d):
    """Order lines as pixels of tiles that darken towards their corners."""
    y, x = F.col("l_orderkey") * 31 % _SIDE, F.col("l_partkey") * 17 % _SIDE
    dark = 1 - ((y - 15.5) * (y - 15.5) + (x - 15.5) * (x - 15.5)) / 1000
    pixels = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tile"), y.alias("y"), x.alias("x"), (F.col("l_quantity") * dark).alias("value"))
    made = planes.corrected(pixels, planes.flat_field(pixels))
    return rounded(made.groupBy("y", "x").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top")))


SQL["flat_field"] = f"""WITH p AS (SELECT l_orderkey * 31 % {_SIDE} AS y, l_partkey * 17 % {_SIDE} AS x, l_quantity FROM lineitem),
v AS (SELECT y, x, l_quantity * (1 - ((y - 15.5::DOUBLE) * (y - 15.5::DOUBLE) + (x - 15.5::DOUBLE) * (x - 15.5::DOUBLE)) / 1000) AS value FROM p),
f AS (SELECT y, x, median(value) AS field FROM v GROUP BY y, x), g AS (SELECT y, x, CASE WHEN field > 0 THEN (SELECT avg(field) FROM f WHERE field > 0) / field ELSE 1 END AS gain FROM f)
SELECT v.y, v.x, count(*) AS n, round(sum(value * gain), 6) AS total, round(max(value * gain), 6) AS top FROM v JOIN g ON v.y = g.y AND v.x = g.x GROUP BY v.y, v.x"""


def mask_components(spark, d):
    """Pixels of a plane a return flag, inside where the mean discount is low."""
    y, x = F.col("l_orderkey") * 31 % 96, F.col("l_partkey") * 17 % 96
    means = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("plane"), y.alias("y"), x.alias("x")).agg(F.avg(F.col("l_discount")).alias("m"))
    return planes.mask_components(means.where("round(m, 6) < 0.045"), "plane")


SQL["mask_components"] = """WITH RECURSIVE m AS (SELECT l_returnflag AS plane, l_orderkey * 31 % 96 AS y, l_partkey * 17 % 96 AS x FROM lineitem GROUP BY 1, 2, 3 HAVING round(avg(l_discount), 6) < 0.045),
r(plane, y0, x0, y, x) AS (SELECT plane, y, x, y, x FROM m UNION SELECT r.plane, r.y0, r.x0, m.y, m.x FROM r JOIN m ON m.plane = r.plane AND abs(m.y - r.y) + abs(m.x - r.x) = 1),
c AS (SELECT plane, y, x, min((y0, x0)) AS root FROM r GROUP BY plane, y, x),
a AS (SELECT plane, root[1] AS y, root[2] AS x0, count(*) AS area, count(DISTINCT y) AS rows, min(x) AS x_min, max(x) AS x_max FROM c GROUP BY plane, root)
SELECT plane, y, x0, area, rows, x_min, x_max, row_number() OVER (PARTITION BY plane ORDER BY area DESC, y, x0) AS place FROM a"""


def polygon_union(spark, d):
    """Customers as points, the suppliers of each nation as corners of a polygon."""
    corners = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 7919 % 1000 * 10.0).alias("y"))
    points = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 53 % 1000 * 10.0 + 0.5).alias("y"))
    return planes.in_polygons(points, "c_custkey", "x", "y", planes.edges_of(corners, "s_nationkey", "s_suppkey", "x", "y"), 500.0)


SQL["polygon_union"] = """WITH c AS (SELECT s_nationkey AS p, s_suppkey AS k, s_acctbal AS x, CAST(s_suppkey * 7919 % 1000 * 10 AS DOUBLE) AS y, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
e AS (SELECT p, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM c WHERE n > 2 WINDOW w AS (PARTITION BY p ORDER BY k)),
q AS (SELECT c_custkey, c_acctbal AS x, c_custkey * 53 % 1000 * 10 + 0.5::DOUBLE AS y FROM customer),
o AS (SELECT q.c_custkey, e.p FROM q JOIN e ON (e.y0 > q.y) <> (e.y1 > q.y) AND q.x < e.x0 + (q.y - e.y0) * ((e.x1 - e.x0) / (e.y1 - e.y0)) GROUP BY q.c_custkey, e.p HAVING count(*) % 2 = 1),
n AS (SELECT c_custkey, count(*) AS n FROM o GROUP BY c_custkey) SELECT c_custkey, coalesce(n, 0) AS n_polygons, n IS NOT NULL AS inside FROM customer LEFT JOIN n USING (c_custkey)"""


def profiles_regridded(spark, d):
    """Values of each user's events at every 25,000 seconds; every seventh event has none."""
    at = F.unix_timestamp("ts").cast("double")
    rows = table(spark, d, "events").select("user_id", at.alias("at"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.col("event_id").cast("double").alias("number"))
    ends = rows.groupBy("user_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    step = F.lit(25000)
    grid = ends.select("user_id", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor(F.col("hi") / step) + 1)).alias("k")).select("user_id", (F.col("k") * step).cast("double").alias("at"))
    return rounded(planes.resampled(rows, grid, ["user_id"], "at", ["value", "number"]), 5)


SQL["profiles_regridded"] = """WITH s AS (SELECT user_id, floor(epoch(ts)) AS t, avg(CASE WHEN event_id % 7 <> 0 THEN value END) AS value, avg(CAST(event_id AS DOUBLE)) AS number FROM events GROUP BY 1, 2),
g AS (SELECT user_id, 25000.0::DOUBLE * unnest(range(CAST(floor(min(t) / 25000) AS BIGINT), CAST(floor(max(t) / 25000) AS BIGINT) + 2)) AS t FROM s GROUP BY user_id),
v AS (SELECT * FROM s WHERE value IS NOT NULL),
a AS (SELECT g.user_id, g.t, l.t AS la, l.value AS lv FROM g ASOF LEFT JOIN v l ON g.user_id = l.user_id AND g.t >= l.t),
b AS (SELECT a.*, h.t AS ha, h.value AS hv FROM a ASOF LEFT JOIN v h ON a.user_id = h.user_id AND a.t <= h.t),
c AS (SELECT b.*, l.t AS ma, l.number AS mv FROM b ASOF LEFT JOIN s l ON b.user_id = l.user_id AND b.t >= l.t),
e AS (SELECT c.*, h.t AS na, h.number AS nv FROM c ASOF LEFT JOIN s h ON c.user_id = h.user_id AND c.t <= h.t)
SELECT user_id, t AS "at", round(CASE WHEN la = ha THEN lv ELSE lv + (hv - lv) * ((t - la) / (ha - la)) END, 5) AS value, round(CASE WHEN ma = na THEN mv ELSE mv + (nv - mv) * ((t - ma) / (na - ma)) END, 5) AS number FROM e"""

QUERIES = {f.__name__: f for f in (flat_field, mask_components, polygon_union, profiles_regridded)}
