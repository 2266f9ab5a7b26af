"""Chart data, tile graphs and pixel tables over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strataline.operators import charts, graph, raster
from strataline.plans.tables import rounded, table

SQL = {}


def ecdf_steps(spark, d):
    return rounded(charts.ecdf(table(spark, d, "lineitem"), "l_returnflag", "l_quantity"))


SQL["ecdf_steps"] = "SELECT DISTINCT l_returnflag, l_quantity AS x, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 6) AS share FROM lineitem"


def ecdf_ks(spark, d):
    return rounded(charts.ks_distance(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "A"))


SQL["ecdf_ks"] = """WITH x AS (SELECT DISTINCT l_extendedprice AS v FROM lineitem), g AS (SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_returnflag),
c AS (SELECT l_returnflag, l_extendedprice AS v, count(*) AS k FROM lineitem GROUP BY 1, 2),
f AS (SELECT g.l_returnflag, x.v, coalesce(sum(c.k) OVER (PARTITION BY g.l_returnflag ORDER BY x.v ROWS UNBOUNDED PRECEDING), 0) / g.n AS s FROM g CROSS JOIN x LEFT JOIN c ON c.l_returnflag = g.l_returnflag AND c.v = x.v)
SELECT b.l_returnflag, round(max(abs(b.s - a.s)), 6) AS d, CAST((SELECT n FROM g WHERE g.l_returnflag = b.l_returnflag) AS BIGINT) AS n, CAST((SELECT n FROM g WHERE l_returnflag = 'A') AS BIGINT) AS n_first
FROM f a JOIN f b ON a.v = b.v AND a.l_returnflag = 'A' AND b.l_returnflag <> 'A' GROUP BY b.l_returnflag"""


def _survival(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("o_orderpriority", F.date_diff("l_shipdate", "o_orderdate").alias("days"), (F.col("l_returnflag") != "N").alias("event"))


_SURV = "v AS (SELECT o_orderpriority AS g, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, l_returnflag <> 'N' AS event FROM lineitem JOIN orders ON l_orderkey = o_orderkey), t AS (SELECT g, days, count(*) FILTER (event) AS events, count(*) FILTER (NOT event) AS censored FROM v GROUP BY g, days)"


def kaplan_meier(spark, d):
    return rounded(charts.kaplan_meier(_survival(spark, d), "o_orderpriority", "days", "event"))


SQL["kaplan_meier"] = f"""WITH {_SURV}, r AS (SELECT *, sum(events + censored) OVER (PARTITION BY g ORDER BY days ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM t),
s AS (SELECT *, sum(CASE WHEN events < risk THEN ln(1 - events / CAST(risk AS DOUBLE)) ELSE 0 END) OVER (PARTITION BY g ORDER BY days ROWS UNBOUNDED PRECEDING) AS lg, max(CASE WHEN events >= risk THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY days ROWS UNBOUNDED PRECEDING) AS gone FROM r)
SELECT g AS o_orderpriority, CAST(days AS INTEGER) AS days, events, censored, CAST(risk AS BIGINT) AS at_risk, round(CASE WHEN gone = 1 THEN 0.0 ELSE exp(lg) END, 6) AS survival FROM s"""


def logrank(spark, d):
    return rounded(charts.logrank(_survival(spark, d), "o_orderpriority", "days", "event", "1-URGENT"), 4)


SQL["logrank"] = f"""WITH {_SURV}, x AS (SELECT DISTINCT g FROM t WHERE g <> '1-URGENT'), p AS (SELECT x.g, t.days, CASE WHEN t.g = x.g THEN events ELSE 0 END AS d1, CASE WHEN t.g = x.g THEN events + censored ELSE 0 END AS k1, events AS d, events + censored AS k FROM x JOIN t ON t.g = x.g OR t.g = '1-URGENT'),
q AS (SELECT g, days, sum(d1) AS d1, sum(k1) AS k1, sum(d) AS d, sum(k) AS k FROM p GROUP BY g, days), r AS (SELECT *, CAST(sum(k1) OVER w AS DOUBLE) AS n1, CAST(sum(k) OVER w AS DOUBLE) AS n FROM q WINDOW w AS (PARTITION BY g ORDER BY days ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT g AS o_orderpriority, CAST(sum(d1) AS BIGINT) AS observed, round(sum(d * n1 / n), 4) AS expected, round(power(sum(d1 - d * n1 / n), 2) / sum(CASE WHEN n > 1 THEN d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END), 4) AS chi2 FROM r GROUP BY g"""


def contingency_percent(spark, d):
    return rounded(charts.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


def contingency_chi2(spark, d):
    return rounded(charts.chi_squared(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"), 5)


SQL["contingency_percent"] = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS percent FROM orders GROUP BY o_orderstatus, o_orderpriority"
SQL["contingency_chi2"] = """WITH r AS (SELECT o_orderstatus AS a, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1), c AS (SELECT o_orderpriority AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1), t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders),
o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT CAST(max(t.n) AS BIGINT) AS n, round(sum(power(coalesce(o.n, 0) - r.n * c.n / t.n, 2) / (r.n * c.n / t.n)), 5) AS chi2, (SELECT count(*) FROM r) * (SELECT count(*) FROM c) - (SELECT count(*) FROM r) - (SELECT count(*) FROM c) + 1 AS df
FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN o ON o.a = r.a AND o.b = c.b"""


def volcano_classes(spark, d):
    p = table(spark, d, "part").select("p_name", "p_partkey", ((F.col("p_size") - 25) / 10.0).alias("change"), ((F.col("p_partkey") * 7919 % 1000) / 1000.0).alias("p"))
    return rounded(charts.volcano(p.withColumn("id", F.col("p_partkey").cast("string")), "id", "change", "p", 1.0, 0.05, 5))


SQL["volcano_classes"] = """WITH v AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size - 25 AS DOUBLE) / 10 AS change, CAST(p_partkey * 7919 % 1000 AS DOUBLE) / 1000 AS p FROM part), w AS (SELECT *, CASE WHEN change >= 1 AND p < 0.05 THEN 'up' WHEN change <= -1 AND p < 0.05 THEN 'down' ELSE 'ns' END AS class FROM v WHERE p > 0)
SELECT id, change, p, class, round(-log10(p), 6) AS minus_log10_p, class <> 'ns' AND row_number() OVER (PARTITION BY class = 'ns' ORDER BY p, id) <= 5 AS labelled FROM w"""


def upset_patterns(spark, d):
    return charts.member_patterns(table(spark, d, "events"), "event_type", "user_id")


def venn_regions(spark, d):
    visits = table(spark, d, "events").withColumn("visit", F.col("user_id") * 1000 + F.dayofyear("ts"))
    return charts.venn(visits, "event_type", "visit", ["click", "purchase", "view"])


_UP = "SELECT pattern, count(*) AS n, max(degree) AS degree FROM (SELECT item, string_agg(event_type, ' & ' ORDER BY event_type) AS pattern, count(*) AS degree FROM (SELECT DISTINCT event_type, {} AS item FROM events{}) GROUP BY item) GROUP BY pattern"
SQL["upset_patterns"] = _UP.format("user_id", "")
SQL["venn_regions"] = _UP.format("user_id * 1000 + dayofyear(ts)", " WHERE event_type IN ('click', 'purchase', 'view')")


def linear_fit(spark, d):
    return rounded(charts.linear_fit(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 4)


SQL["linear_fit"] = "SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem GROUP BY l_returnflag"


def _curve(model):
    def query(spark, d):
        e = table(spark, d, "events").groupBy("event_type", F.floor(F.col("value") / 25).alias("bin")).agg(F.avg("value").alias("x"), F.count("*").cast("double").alias("n"))
        from pyspark.sql import Window

        cum = e.withColumn("y", F.sum("n").over(Window.partitionBy("event_type").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        return rounded(charts.curve_fit(cum, ["event_type"], "x", "y", model), 2)

    query.__name__ = f"curve_fit_{model}"
    return query


curve_fit_hill, curve_fit_boltzmann, curve_fit_exp = (_curve(m) for m in ("hill", "boltzmann", "exp"))


def error_bars(spark, d):
    return rounded(charts.error_bars(table(spark, d, "events"), ["event_type"], "value", "sem", "median"))


SQL["error_bars"] = "SELECT event_type, count(value) AS n, round(median(value), 6) AS centre, round(stddev_samp(value) / sqrt(count(value)), 6) AS error FROM events GROUP BY event_type"


def ordered_series(spark, d):
    return charts.ordered_names(table(spark, d, "nation").select("n_name", "n_nationkey"), "n_name", "n_nationkey", ["JAPAN", "NATION_7", "FRANCE", "NATION_3"]).select("n_name", F.col("position").cast("long"))


SQL["ordered_series"] = "SELECT n_name, row_number() OVER (ORDER BY CASE n_name WHEN 'JAPAN' THEN 1 WHEN 'NATION_7' THEN 2 WHEN 'FRANCE' THEN 3 WHEN 'NATION_3' THEN 4 ELSE 5 END, n_nationkey) AS position FROM nation"


def band_theta_pairs(spark, d):
    return graph.band_pairs(table(spark, d, "orders"), "o_orderkey", 4, ["o_custkey"])


SQL["band_theta_pairs"] = "SELECT a.o_orderkey AS i, b.o_orderkey AS j, a.o_custkey AS o_custkey_i, b.o_custkey AS o_custkey_j FROM orders a JOIN orders b ON b.o_orderkey > a.o_orderkey AND b.o_orderkey <= a.o_orderkey + 4"


def _edges(spark, d):
    p = graph.band_pairs(table(spark, d, "part"), "p_partkey", 6, ["p_size", "p_retailprice"])
    ncc = 1 - F.abs(F.col("p_size_i") - F.col("p_size_j")) / 50.0
    ratio = 1 + ((F.col("i") * 31 + F.col("j") * 17) % 100) / 100.0
    return p.select("i", "j", ncc.alias("ncc"), ratio.alias("ratio"), ((F.col("i") + F.col("j")) % 10 / 20.0).alias("overlap"), (F.col("i") % 7 + 1.0).alias("weight")).withColumn("quality", graph.edge_quality(F.col("ncc"), F.col("ratio"), F.col("overlap")))


_EDGES = """e AS (SELECT a.p_partkey AS i, b.p_partkey AS j, 1 - abs(a.p_size - b.p_size) / 50.0::DOUBLE AS ncc, 1 + ((a.p_partkey * 31 + b.p_partkey * 17) % 100) / 100.0::DOUBLE AS ratio, ((a.p_partkey + b.p_partkey) % 10) / 20.0::DOUBLE AS overlap, CAST(a.p_partkey % 7 + 1 AS DOUBLE) AS weight FROM part a JOIN part b ON b.p_partkey > a.p_partkey AND b.p_partkey <= a.p_partkey + 6),
q AS (SELECT *, power(greatest(0, least(1, (ncc - 0.35) / 0.5)), 0.8) * (0.35 + 0.65 * greatest(0, least(1, (ratio - 1) / 0.8))) * (0.45 + 0.55 * greatest(0, least(1, overlap / 0.35))) AS quality FROM e)"""


def topk_per_endpoint(spark, d):
    # ranked by rounded qualities, so that the last digit of a power makes no order; those returned are rounded once
    e = _edges(spark, d).withColumn("ranked", F.round("quality", 9))
    # ties at the seventh digit: both sides round a decimal of twelve digits
    return graph.best_edges(e, 2, "ranked").select("i", "j", F.round(F.col("quality").cast("decimal(20,12)"), 6).cast("double").alias("quality"))


SQL["topk_per_endpoint"] = f"""WITH {_EDGES}, t AS (SELECT i, j, quality, i AS tile FROM q UNION ALL SELECT i, j, quality, j FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY round(quality, 9) DESC, i, j) AS k FROM t)
SELECT DISTINCT i, j, CAST(round(CAST(quality AS DECIMAL(20, 12)), 6) AS DOUBLE) AS quality FROM r WHERE k <= 2"""


def edge_qc(spark, d):
    """Edges of which some have no correlation, some little tissue in both, some none in either."""
    n_a, n_b = F.col("weight") * 300, (F.col("j") % 8) * 250.0
    e = _edges(spark, d).withColumn("ncc", F.when((F.col("i") + F.col("j")) % 11 != 0, F.col("ncc") * 2 - 1)).withColumn("n_both", F.least(n_a, n_b))
    iou = F.when(F.col("j") % 13 != 0, F.col("overlap") * 2)
    e = e.withColumn("conflict", graph.contradicts(F.col("ncc"), iou, F.col("n_both"), n_a, n_b, (F.col("i") % 5 + 1) * 500.0))
    return rounded(graph.edge_report(e, "n_both", "ncc", "conflict", above=500.0))


SQL["edge_qc"] = f"""WITH {_EDGES}, x AS (SELECT i, j, CASE WHEN (i + j) % 11 <> 0 THEN ncc * 2 - 1 END AS ncc, CASE WHEN j % 13 <> 0 THEN overlap * 2 END AS iou, weight * 300 AS n_a, CAST(j % 8 * 250 AS DOUBLE) AS n_b, (i % 5 + 1) * 500 AS area FROM q),
c AS (SELECT *, least(n_a, n_b) AS n_both, CASE WHEN area < 1200 OR greatest(n_a, n_b) < 600 THEN false WHEN least(n_a, n_b) >= 600 AND ncc IS NOT NULL AND ncc >= 0.55 THEN false WHEN iou IS NOT NULL AND iou < 0.55 THEN true WHEN least(n_a, n_b) >= 600 AND ncc IS NOT NULL AND ncc < 0.35 THEN true ELSE false END AS conflict FROM x),
t AS (SELECT i AS tile, ncc, n_both, conflict FROM c UNION ALL SELECT j, ncc, n_both, conflict FROM c)
SELECT tile, round(sum(n_both * ncc) FILTER (ncc IS NOT NULL AND n_both > 500) / sum(n_both) FILTER (ncc IS NOT NULL AND n_both > 500), 6) AS mean_score, count(*) AS neighbours, count(*) FILTER (conflict) AS conflicts FROM t GROUP BY tile"""


def _rectangles(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 60 * 1.5).alias("x"), (F.col("p_partkey") * 7 % 90 * 1.0).alias("y"), (F.col("p_size") % 9 + 1.0).alias("w"), (F.col("p_size") % 5 + 1.0).alias("h"))


_RECT = "r AS (SELECT p_partkey AS k, p_partkey % 60 * 1.5::DOUBLE AS x, CAST(p_partkey * 7 % 90 AS DOUBLE) AS y, CAST(p_size % 9 + 1 AS DOUBLE) AS w, CAST(p_size % 5 + 1 AS DOUBLE) AS h FROM part)"


def rect_overlap_join(spark, d):
    return graph.rectangle_overlaps(_rectangles(spark, d), "p_partkey", "x", "y", "w", "h", 4.0, 8.0)


SQL["rect_overlap_join"] = f"""WITH {_RECT}, p AS (SELECT a.k AS i, b.k AS j, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS area FROM r a JOIN r b ON a.k < b.k AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h)
SELECT i, j, area FROM p WHERE area >= 4"""


def nearest_join(spark, d):
    points = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return rounded(graph.nearest(points, "s_suppkey", "s_acctbal", table(spark, d, "customer"), "c_acctbal", 5.0).withColumnRenamed("at", "nearest_at"))


SQL["nearest_join"] = """WITH p AS (SELECT s_suppkey AS point, c_acctbal AS nearest_at, abs(s_acctbal - c_acctbal) AS distance, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_acctbal) AS r FROM supplier JOIN customer ON c_acctbal BETWEEN s_acctbal - 5 AND s_acctbal + 5)
SELECT point, round(nearest_at, 6) AS nearest_at, round(distance, 6) AS distance FROM p WHERE r = 1 AND distance <= 5"""


def components(spark, d):
    """Every part is tied to the next one, or to the one before where the number two on is a square: groups between squares, of growing size."""
    i = F.col("p_partkey")
    root = F.round(F.sqrt(i + 2)).cast("long")
    return graph.components(table(spark, d, "part").select(i.alias("i"), F.when(root * root == i + 2, i - 1).otherwise(i + 1).alias("j")))


SQL["components"] = """WITH p AS (SELECT p_partkey AS i, CAST(round(sqrt(p_partkey + 2)) AS BIGINT) AS r FROM part), e AS (SELECT i, CASE WHEN r * r = i + 2 THEN i - 1 ELSE i + 1 END AS j FROM p),
v AS (SELECT i AS id FROM e UNION SELECT j FROM e) SELECT id, min(id) OVER (PARTITION BY CAST(floor(sqrt(id + 1)) AS BIGINT)) AS component FROM v"""


def irls_positions(spark, d):
    e = _edges(spark, d).select((F.col("i") / 20).cast("int").alias("island"), "i", "j", (F.col("j") - F.col("i") + (F.col("i") * 13 % 7 - 3) / 10.0).alias("dx"), ((F.col("j") * 5 % 11 - 5) / 10.0).alias("dy"), "quality")
    return rounded(graph.solve_positions(e), 3)


def bounding_boxes(spark, d):
    r = _rectangles(spark, d).withColumn("island", F.col("p_partkey") % 5)
    b = graph.bounds(r, ["island"], "x", "y", "w", "h")
    return rounded(b.join(graph.side_by_side(b, "island", "x0", "x1"), "island"))


SQL["bounding_boxes"] = f"""WITH {_RECT}, b AS (SELECT k % 5 AS island, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM r GROUP BY 1), s AS (SELECT *, sum(x1 - x0 + 0.15 * g) OVER (ORDER BY x1 - x0 DESC, island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM (SELECT *, max(x1 - x0) OVER () AS g FROM b))
SELECT island, x0, y0, x1, y1, round(coalesce(st, 0) - x0, 6) AS shift FROM s"""


def _pixels(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("y"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_quantity") / 50).alias("r"), (1 - F.col("l_discount") * 5).alias("g"), (1 - F.col("l_tax") * 8).alias("b"), "l_returnflag")


def feather_blend(spark, d):
    return rounded(graph.blend(_pixels(spark, d).withColumn("w", F.col("g") + 0.1), "y", "x", "r", "w"))


SQL["feather_blend"] = "SELECT l_orderkey % 40 AS y, l_partkey % 40 AS x, round(sum(l_quantity / 50 * (1 - l_discount * 5 + 0.1)) / sum(1 - l_discount * 5 + 0.1), 6) AS value, count(*) AS layers FROM lineitem GROUP BY 1, 2"
STAINS = np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11], [0.27, 0.57, 0.78]])


def unmix_stains(spark, d):
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[raster.optical_density(c, w).alias(n) for n, c, w in (("r", F.col("l_quantity") / 50, 1.0), ("g", 1 - F.col("l_discount") * 5, 0.9), ("b", 1 - F.col("l_tax") * 8, 0.95))])
    a = raster.unmix([F.col(c) for c in "rgb"], STAINS)
    return rounded(p.select("l_orderkey", "l_linenumber", "r", *[x.alias(f"s{k}") for k, x in enumerate(a)]))


_I = np.linalg.pinv(STAINS)
_OD = "SELECT l_orderkey, l_linenumber, -log10(least(1, greatest(1e-4, l_quantity / 50))) AS r, -log10(least(1, greatest(1e-4, (1 - l_discount * 5) / 0.9))) AS g, -log10(least(1, greatest(1e-4, (1 - l_tax * 8) / 0.95))) AS b FROM lineitem"
SQL["unmix_stains"] = f"WITH p AS ({_OD}) SELECT l_orderkey, l_linenumber, round(r, 6) AS r, " + ", ".join(f"round(greatest(0, r * ({_I[0, k]!r}::DOUBLE) + g * ({_I[1, k]!r}::DOUBLE) + b * ({_I[2, k]!r}::DOUBLE)), 6) AS s{k}" for k in range(3)).replace("np.float64(", "(") + " FROM p"


def _densities(spark, d):
    return _pixels(spark, d).select(*[raster.optical_density(F.col(c)).alias(c) for c in "rgb"])


def stain_moments(spark, d):
    """What the stain directions are read from: how many pixels are stained, and their covariances."""
    return rounded(raster.stain_moments(_densities(spark, d), "r", "g", "b"))


SQL["stain_moments"] = """WITH p AS (SELECT -log10(least(1, greatest(1e-4, l_quantity / 50))) AS r, -log10(least(1, greatest(1e-4, 1 - l_discount * 5))) AS g, -log10(least(1, greatest(1e-4, 1 - l_tax * 8))) AS b FROM lineitem)
SELECT count(*) AS n, round(covar_samp(r, r), 6) AS r_r, round(covar_samp(r, g), 6) AS r_g, round(covar_samp(r, b), 6) AS r_b, round(covar_samp(g, g), 6) AS g_g, round(covar_samp(g, b), 6) AS g_b, round(covar_samp(b, b), 6) AS b_b FROM p WHERE r + g + b > 0.15"""


def stain_estimate(spark, d):
    got = raster.stain_vectors(_densities(spark, d), "r", "g", "b")
    return spark.createDataFrame([(name, *map(float, np.round(v, 4))) for name, v in zip(("muscle", "collagen", "residual"), got)], "stain string, r double, g double, b double")


def otsu_cut(spark, d):
    return rounded(raster.otsu(table(spark, d, "part"), "p_retailprice", 64), 4)


_HIST = "s AS (SELECT min(v) AS lo, max(v) AS hi FROM t), h AS (SELECT least(63, CAST(floor((v - lo) / ((hi - lo) / 64)) AS INTEGER)) AS bin, count(*) AS n, min(lo) + (least(63, CAST(floor((v - lo) / ((hi - lo) / 64)) AS INTEGER)) + 0.5) * min((hi - lo) / 64) AS c FROM t, s GROUP BY 1)"
SQL["otsu_cut"] = f"""WITH t AS (SELECT p_retailprice AS v FROM part), {_HIST.replace("least(63, CAST(floor((v - lo) / ((hi - lo) / 64)) AS INTEGER)) + 0.5", "bin + 0.5").replace("GROUP BY 1", "GROUP BY 1").replace("h AS (SELECT least", "h0 AS (SELECT least").replace(", min(lo) + (bin + 0.5) * min((hi - lo) / 64) AS c FROM t, s GROUP BY 1)", " FROM t, s GROUP BY 1), h AS (SELECT bin, n, lo + (bin + 0.5) * ((hi - lo) / 64) AS c FROM h0, s)")},
w AS (SELECT *, CAST(sum(n) OVER o AS DOUBLE) AS w0, sum(n * c) OVER o AS s0, CAST(sum(n) OVER () AS DOUBLE) AS tn, sum(n * c) OVER () AS ts FROM h WINDOW o AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN tn > w0 THEN round(w0 * (tn - w0) * power(s0 / w0 - (ts - s0) / (tn - w0), 2), 3) ELSE -1 END AS bt FROM w)
SELECT round(c, 4) AS cut FROM b ORDER BY bt DESC, bin LIMIT 1"""


def triangle_cut(spark, d):
    return rounded(raster.triangle(table(spark, d, "lineitem"), "l_extendedprice", 0.0, 1e9, 64), 4)


SQL["triangle_cut"] = """WITH t AS (SELECT l_extendedprice AS v FROM lineitem), s AS (SELECT min(v) AS lo, (max(v) - min(v)) / 64 AS width FROM t), h AS (SELECT least(63, CAST(floor((v - lo) / width) AS INTEGER)) AS bin, count(*) AS n FROM t, s GROUP BY 1),
e AS (SELECT arg_max(bin, n * 100 - bin) AS top, max(n) AS top_n, min(bin) AS first, max(bin) AS last FROM h), f AS (SELECT *, CASE WHEN last - top >= top - first THEN last ELSE first END AS far FROM e),
g AS (SELECT bin, round((1 - abs(bin - top) / CAST(abs(far - top) AS DOUBLE)) * top_n - n, 6) AS below FROM h, f WHERE (bin - top) * sign(far - top) >= 0)
SELECT round(greatest(0.0, least(1e9, lo + (bin + 0.5) * width)), 4) AS cut FROM g, s ORDER BY below DESC, bin LIMIT 1"""


def mad_outliers(spark, d):
    return rounded(raster.mad_cut(table(spark, d, "part"), ["p_brand"], "p_retailprice", 1.0))


SQL["mad_outliers"] = """WITH m AS (SELECT p_brand, p_retailprice AS v, median(p_retailprice) OVER (PARTITION BY p_brand) AS md FROM part), c AS (SELECT p_brand, max(md) AS median, 1.4826 * median(abs(v - md)) AS mad FROM m GROUP BY p_brand)
SELECT c.p_brand, round(min(c.median), 6) AS median, round(min(mad), 6) AS mad, round(min(c.median + greatest(mad, 1e-6)), 6) AS cut, count(*) FILTER (p_retailprice > c.median + greatest(mad, 1e-6)) AS n_over FROM c JOIN part ON part.p_brand = c.p_brand GROUP BY c.p_brand"""
CENTRES = np.array([[0.1, -0.1, 0.2], [-0.2, 0.1, 0.0], [0.0, 0.2, -0.1]])


def nearest_centres(spark, d):
    e = table(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    c, dist = raster.nearest_centre("embedding", CENTRES)
    return rounded(e.select("vec_id", c.alias("centre"), dist.alias("distance")))


_D = [" + ".join(f"power(embedding[{i + 1}]::DOUBLE - ({float(v)!r}), 2)" for i, v in enumerate(row)) for row in CENTRES]
SQL["nearest_centres"] = f"WITH v AS (SELECT vec_id, {', '.join(f'{x} AS d{k}' for k, x in enumerate(_D))} FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS centre, round(least(d0, d1, d2), 6) AS distance FROM v"


def cluster_choice(spark, d):
    best, scores = raster.choose_clusters(table(spark, d, "embeddings"), "embedding")
    return spark.createDataFrame([(k, round(s, 2), k == best) for k, s in scores.items()], "k int, bic double, best boolean")


def region_measures(spark, d):
    p = _pixels(spark, d)
    return rounded(raster.region_measures(p, "l_returnflag", F.col("g") < 0.9, "r", "b", 2.0))


SQL["region_measures"] = """WITH p AS (SELECT l_returnflag, l_quantity / 50 AS r, 1 - l_discount * 5 AS g, 1 - l_tax * 8 AS b FROM lineitem), m AS (SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'whole section' ELSE l_returnflag END AS name, count(*) * 4.0::DOUBLE AS imaged_area_um2, count(*) FILTER (g < 0.9) * 4.0::DOUBLE AS tissue_area_um2,
 count(*) FILTER (g < 0.9 AND r > b) * 4.0::DOUBLE AS collagen_area_um2, sum(r) FILTER (g < 0.9) * 4 AS c, sum(b) FILTER (g < 0.9) * 4 AS s FROM p GROUP BY GROUPING SETS ((l_returnflag), ()))
SELECT name, imaged_area_um2, tissue_area_um2, collagen_area_um2, round(c, 6) AS collagen_od_um2_total, round(s, 6) AS muscle_od_um2_total, round(c / s, 6) AS collagen_to_muscle, round(collagen_area_um2 / tissue_area_um2, 6) AS collagen_area_fraction FROM m"""


def polygon_membership(spark, d):
    r = _rectangles(spark, d)
    return r.select("p_partkey", raster.points_in_polygon(r, "x", "y", [(10.0, 10.0), (60.0, 15.0), (35.0, 70.0)]).alias("inside"))


def _edge(x0, y0, x1, y1):
    return f"(CASE WHEN ({y0} > y) <> ({y1} > y) AND x < {x0} + (y - {y0}) * ({(x1 - x0) / (y1 - y0)!r}) THEN 1 ELSE 0 END)"


SQL["polygon_membership"] = f"WITH {_RECT} SELECT k AS p_partkey, ({_edge(10.0, 10.0, 60.0, 15.0)} + {_edge(60.0, 15.0, 35.0, 70.0)} + {_edge(35.0, 70.0, 10.0, 10.0)}) % 2 = 1 AS inside FROM r"

QUERIES = {f.__name__: f for f in (ecdf_steps, ecdf_ks, kaplan_meier, logrank, contingency_percent, contingency_chi2, volcano_classes, upset_patterns, venn_regions, linear_fit, curve_fit_hill, curve_fit_boltzmann, curve_fit_exp, error_bars, ordered_series, band_theta_pairs, topk_per_endpoint, edge_qc, rect_overlap_join, nearest_join, components, irls_positions, bounding_boxes, feather_blend, unmix_stains, stain_moments, stain_estimate, otsu_cut, triangle_cut, mad_outliers, nearest_centres, cluster_choice, region_measures, polygon_membership)}
