"""Sheets, names and measures around marks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.functions.core import dealt
from strataline.operators import charts, measures, sheets
from strataline.plans.tables import rounded, table

SQL = {}
_PX = "px AS (SELECT CAST(l_orderkey % 40 AS BIGINT) AS y, CAST(l_partkey % 40 AS BIGINT) AS x, avg(l_quantity / 50) AS collagen, avg(l_tax * 10 + 0.1) AS counterstain, sum(l_linenumber) % 3 <> 0 AS tissue, CAST(max(l_linenumber) AS INTEGER) AS lesion FROM lineitem GROUP BY 1, 2)"


def points_measured(spark, d):
    li = table(spark, d, "lineitem")
    px = li.groupBy((F.col("l_orderkey") % 40).cast("long").alias("y"), (F.col("l_partkey") % 40).cast("long").alias("x")).agg(F.avg(F.col("l_quantity") / 50).alias("collagen"), F.avg(F.col("l_tax") * 10 + 0.1).alias("counterstain"), (F.sum("l_linenumber") % 3 != 0).alias("tissue"), F.max("l_linenumber").cast("int").alias("lesion"))
    marks = table(spark, d, "supplier").select(F.col("s_suppkey").alias("point"), (F.col("s_suppkey") * 37 % 96 - 4.0).alias("x_um"), (F.col("s_suppkey") * 11 % 90 - 3.0).alias("y_um"))
    return rounded(measures.measure_points(marks, px, 2.0, 6.0))


SQL["points_measured"] = f"""WITH {_PX}, m AS (SELECT s_suppkey AS point, s_suppkey * 37 % 96 - 4.0::DOUBLE AS x_um, s_suppkey * 11 % 90 - 3.0::DOUBLE AS y_um FROM supplier), q AS (SELECT *, CAST(round_even(x_um / 2, 0) AS BIGINT) AS cx, CAST(round_even(y_um / 2, 0) AS BIGINT) AS cy FROM m),
f AS (SELECT q.point, count(*) FILTER (tissue) AS n, sum(collagen) FILTER (tissue) AS c, sum(counterstain) FILTER (tissue) AS s, avg(collagen) FILTER (tissue) AS mc, avg(counterstain) FILTER (tissue) AS ms, max(CASE WHEN x = cx AND y = cy THEN lesion END) AS l FROM q JOIN px ON power(x - cx, 2) + power(y - cy, 2) <= 9 GROUP BY q.point)
SELECT m.point, round(x_um, 6) AS x_um, round(y_um, 6) AS y_um, coalesce(n, 0) AS n_tissue_px, round(mc, 6) AS collagen_mean_od, round(ms, 6) AS counterstain_mean_od, coalesce(l, 0) AS in_lesion, round(CASE WHEN s > 0 THEN c / s END, 6) AS collagen_to_counterstain, round(CASE WHEN c IS NOT NULL THEN c / greatest(c + s, 1e-9) END, 6) AS collagen_share FROM m LEFT JOIN f USING (point)"""


def lesion_totals(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("area_um2"), "p_size")
    return rounded(measures.lesion_totals(rows, F.col("p_size") * 1000, 4.0, ["p_brand"]))


SQL["lesion_totals"] = """WITH g AS (SELECT p_brand, count(*) FILTER (p_size > 25) AS n, coalesce(sum(p_retailprice) FILTER (p_size > 25), 0) AS a, max(p_size * 1000) * 4.0::DOUBLE AS t FROM part GROUP BY p_brand)
SELECT p_brand, n AS n_lesions, round(a / 1e6, 6) AS lesion_area_mm2, round(CASE WHEN t > 0 THEN a / t END, 6) AS lesion_area_fraction, round(CASE WHEN n > 0 THEN a / n END, 6) AS lesion_area_mean_um2, round(CASE WHEN t > 0 THEN n / (t / 1e6) END, 6) AS lesions_per_mm2_tissue FROM g"""


def white_points(spark, d):
    return rounded(measures.white_point(table(spark, d, "lineitem").withColumn("red", F.col("l_quantity") / 50), ["l_returnflag"], ["red", "l_tax"]))


SQL["white_points"] = "SELECT l_returnflag, round(greatest(1e-3, quantile_cont(l_quantity / 50, 0.995)), 6) AS red, round(greatest(1e-3, quantile_cont(l_tax, 0.995)), 6) AS l_tax FROM lineitem GROUP BY l_returnflag"


def pixel_sizes(spark, d):
    tiles = table(spark, d, "part").select("p_brand", F.when(F.col("p_partkey") % 4 == 0, 0.0).when(F.col("p_partkey") % 5 != 0, F.col("p_size") / 8.0).alias("px_um"))
    return rounded(measures.pixel_size(tiles, ["p_brand"]))


SQL["pixel_sizes"] = "WITH t AS (SELECT p_brand, CASE WHEN p_partkey % 4 = 0 THEN 0.0 WHEN p_partkey % 5 <> 0 THEN p_size / 8.0::DOUBLE END AS s FROM part) SELECT p_brand, round(median(s) FILTER (s > 0), 6) AS px_um FROM t GROUP BY p_brand"


def muscle_centres(spark, d):
    bands = table(spark, d, "events").select("user_id", (F.col("event_id") % 41 - 20.0).alias("depth"), F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("muscle"))
    return rounded(measures.muscle_centre(bands, ["user_id"], "depth", "muscle", 12.0, 60.0))


SQL["muscle_centres"] = """WITH b AS (SELECT user_id, event_id % 41 - 20.0::DOUBLE AS depth, CASE WHEN abs(event_id % 41 - 20.0) <= 12 AND event_id % 6 <> 0 THEN coalesce(value, 0) ELSE 0 END AS m FROM events), p AS (SELECT user_id, max(m) AS peak FROM b GROUP BY user_id)
SELECT user_id, round(CASE WHEN max(peak) > 60 THEN sum(greatest(0, m - 0.5 * peak) * depth) / nullif(sum(greatest(0, m - 0.5 * peak)), 0) END, 6) AS centre_um FROM b JOIN p USING (user_id) GROUP BY user_id"""


def experiment_counts(spark, d):
    e = table(spark, d, "events").select("event_type", F.dayofyear("ts").alias("date"), F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 7).alias("dish"))
    return measures.experiments(e, ["event_type"])


SQL["experiment_counts"] = "SELECT event_type, count(*) AS n_experiments FROM (SELECT DISTINCT event_type, dayofyear(ts) AS date, CASE WHEN user_id % 5 <> 0 THEN user_id % 7 END AS dish FROM events) GROUP BY event_type"


def shifts_allowed(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") - 25).alias("ty"), (F.col("p_partkey") % 61 - 30).alias("tx"), (F.col("p_partkey") % 17 + 20).alias("h"))
    return p.select("p_partkey", measures.shift_allowed(F.col("ty"), F.col("tx"), (F.col("h"), F.lit(40)), (F.lit(25), F.lit(30)), 0.6).alias("allowed"))


SQL["shifts_allowed"] = "SELECT p_partkey, abs(p_size - 25) <= 0.6::DOUBLE * greatest(p_partkey % 17 + 20, 25) AND abs(p_partkey % 61 - 30) <= 0.6::DOUBLE * 40 AS allowed FROM part"


def numbers_for_json(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"))
    safe = measures.json_safe(e.select("event_id", "value", F.array("value").alias("several"), F.struct("value").alias("inside")))
    return safe.select("event_id", "value", F.col("several")[0].alias("first"), F.col("inside.value").alias("inside"))


SQL["numbers_for_json"] = "WITH v AS (SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events) SELECT event_id, value, value AS first, value AS inside FROM v"


def channels_of_fields(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("/plate/r"), F.lpad((F.col("s_suppkey") % 8 + 1).cast("string"), 2, "0"), F.lit("c02f"), F.lpad((F.col("s_suppkey") % 5 + 1).cast("string"), 2, "0"), F.lit("p01-ch"), ((F.col("s_suppkey") / 40).cast("int") % 3 + 1).cast("string"), F.lit("sk1fk1fl1.tiff")).alias("path"))
    names = s.select("path").distinct().union(s.select(F.concat(F.lit("/other/"), F.col("s_suppkey").cast("string"), F.lit(".tif"))))
    return measures.field_files(names, "path").select("path", F.array_join("channels", "; ").alias("channels"))


SQL["channels_of_fields"] = """WITH n AS (SELECT DISTINCT '/plate/r' || lpad(CAST(s_suppkey % 8 + 1 AS VARCHAR), 2, '0') || 'c02f' || lpad(CAST(s_suppkey % 5 + 1 AS VARCHAR), 2, '0') || 'p01-ch' AS head, CAST(s_suppkey // 40 % 3 + 1 AS VARCHAR) AS ch FROM supplier),
p AS (SELECT head || ch || 'sk1fk1fl1.tiff' AS path, head, ch FROM n), g AS (SELECT head, string_agg(path, '; ' ORDER BY ch) AS channels FROM p GROUP BY head)
SELECT path, channels FROM p JOIN g USING (head) UNION ALL SELECT '/other/' || s_suppkey || '.tif', '/other/' || s_suppkey || '.tif' FROM supplier"""


def sheet_long_form(spark, d):
    sheet = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).otherwise("7").alias("name"), F.concat(F.lit(" "), F.col("s_nationkey").cast("string")).alias("nation"), F.when(F.col("s_suppkey") % 4 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("balance"))
    return sheets.long_form(sheet, "s_suppkey", ["name", "nation", "balance"])


SQL["sheet_long_form"] = """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE '7' END AS name, CAST(s_nationkey AS DOUBLE) AS nation, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS balance FROM supplier)
SELECT s_suppkey, name, 'nation' AS series, nation AS value FROM s UNION ALL SELECT s_suppkey, name, 'balance', balance FROM s"""


def sheet_curves(spark, d):
    sheet = table(spark, d, "part").select("p_size", "p_retailprice", (F.col("p_partkey") % 9).alias("p_retailprice SEM"), (F.col("p_partkey") % 5).alias("other"), F.lit("x").alias("third sem"))
    return sheets.curves(sheet, ["p_size", "p_retailprice", "p_retailprice SEM", "other", "third sem"])


SQL["sheet_curves"] = """SELECT 'p_retailprice' AS curve, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(p_partkey % 9 AS DOUBLE) AS sem FROM part UNION ALL SELECT 'other', CAST(p_size AS DOUBLE), CAST(p_partkey % 5 AS DOUBLE), NULL FROM part UNION ALL SELECT 'third sem', CAST(p_size AS DOUBLE), NULL, NULL FROM part"""


def sheet_times(spark, d):
    sheet = table(spark, d, "part").select(F.col("p_size").alias("days"), (F.col("p_partkey") % 3).alias("days_censored"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).alias("weeks"))
    return sheets.times(sheet, ["days", "days_censored", "weeks"])


SQL["sheet_times"] = "SELECT 'days' AS \"group\", CAST(p_size AS DOUBLE) AS time, p_partkey % 3 > 0 AS event FROM part UNION ALL SELECT 'weeks', p_retailprice, true FROM part WHERE p_partkey % 2 = 0"


def names_cleaned(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.concat("p_brand", F.lit(" #"), F.col("p_partkey").cast("string")).alias("trial"), F.concat(F.lit(" "), (F.col("p_size") / 2).cast("string")).alias("member"))
    return p.select("p_partkey", sheets.trial_group(F.col("trial")).alias("group"), sheets.set_member(F.col("member")).alias("member"), sheets.renamed(sheets.trial_group(F.col("trial")), "Brand = B, Brand(1,2) = C; x").alias("shown"), sheets.flag(F.when(F.col("p_partkey") % 3 == 0, "Yes").when(F.col("p_partkey") % 3 == 1, "off")).alias("on"), sheets.number_or(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")), 3.5).alias("width"))


SQL["names_cleaned"] = r"""WITH t AS (SELECT p_partkey, p_size, regexp_replace(p_brand || ' #' || p_partkey, '[\s_#-]*\d+$', '') AS g FROM part)
SELECT p_partkey, g AS "group", regexp_replace(CAST(p_size / 2.0::DOUBLE AS VARCHAR), '\.0$', '') AS member, CASE g WHEN 'Brand' THEN 'B' ELSE g END AS shown, p_partkey % 3 = 0 AS "on", CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 3.5 END AS width FROM t"""


def axis_levels(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    both = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat("r_name", F.lit(" / "), "n_name").alias("level"), (F.col("n_regionkey") * 100 + F.col("n_nationkey")).alias("at"))
    return sheets.two_level(both, "level", "at")


SQL["axis_levels"] = "SELECT r_name || ' / ' || n_name AS name, r_name AS \"outer\", n_name AS \"inner\" FROM nation JOIN region ON n_regionkey = r_regionkey"


def batch_schemes(spark, d):
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("_", F.col("p_brand"), F.col("p_size").cast("string"))).otherwise(F.concat_ws("_", F.lit("20240101"), F.col("p_brand"), F.col("p_partkey").cast("string")))
    made = sheets.name_schemes(p.select(F.concat(name, F.lit(".tif")).alias("file")), "file")
    return made.select("n_parts", "files", F.array_join("roles", " ").alias("roles"), "place")


SQL["batch_schemes"] = """WITH c AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 3 END AS n_parts, count(*) AS files FROM part GROUP BY 1)
SELECT CAST(n_parts AS INTEGER) AS n_parts, files, CASE n_parts WHEN 2 THEN 'variant field' ELSE 'date variant ' || CASE WHEN (SELECT max(p_partkey) FROM part WHERE p_partkey % 3 <> 0) < 10000 THEN 'field' ELSE 'condition' END END AS roles, CAST(row_number() OVER (ORDER BY files DESC, n_parts) AS INTEGER) AS place FROM c"""


def labels_of_files(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("_", F.lit("20240101"), F.col("p_brand"), F.lit("dish3"), (F.col("p_partkey") % 1000).cast("string")).alias("name"))
    return dealt(p).select("p_partkey", sheets.label_of_one(F.concat("name", F.lit(".czi"))).alias("label"), sheets.label_of_one(F.concat(F.lit("r02c03f01p01-ch"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit("sk1fk1fl1.tiff"))).alias("well"))


SQL["labels_of_files"] = "SELECT p_partkey, p_brand AS label, 'B03' AS well FROM part"


def panel_comparisons(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("k")).select(F.lit("s").alias("segment"), F.lit("r").alias("readout"), F.col("p_brand").alias("a"), F.lit("z").alias("b"), ((F.col("k") * 7919 % 1000 + 1) / 10010.0).alias("p"))
    return rounded(measures.panel_comparisons(rows.union(rows.withColumn("readout", F.lit("q"))), "s", "r"))


SQL["panel_comparisons"] = """WITH t AS (SELECT p_brand AS a, CAST(min(p_partkey) * 7919 % 1000 + 1 AS DOUBLE) / 10010 AS p FROM part GROUP BY p_brand), r AS (SELECT *, row_number() OVER (ORDER BY p, a) AS k, count(*) OVER () AS m FROM t),
q AS (SELECT a, least(1, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS p FROM r)
SELECT a, 'z' AS b, round(p, 6) AS p, p < 0.05 AS significant, CASE WHEN p < 1e-5 THEN '*****' WHEN p < 1e-4 THEN '****' WHEN p < 1e-3 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS label FROM q"""


def consecutive_families(spark, d):
    return charts.families(table(spark, d, "events").select("event_id", "event_type"), "event_id", ["event_type"])


SQL["consecutive_families"] = "WITH s AS (SELECT event_id, event_type, CASE WHEN lag(event_id) OVER o IS NOT NULL AND lag(event_type) OVER o IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS st FROM events WINDOW o AS (ORDER BY event_id)) SELECT event_id, event_type, CAST(sum(st) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS family FROM s"

QUERIES = {f.__name__: f for f in (points_measured, lesion_totals, white_points, pixel_sizes, muscle_centres, experiment_counts, shifts_allowed, numbers_for_json, channels_of_fields, sheet_long_form, sheet_curves, sheet_times, names_cleaned, axis_levels, batch_schemes, labels_of_files, panel_comparisons, consecutive_families)}
