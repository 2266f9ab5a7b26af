"""Pooling and the cohort ladder over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import cohort
from strataline.plans.tables import POOLED, READOUT_NAMES, READOUTS, SECTIONS, rounded, sections, table

R = ", ".join(f"round({c}, 6) AS {c}" for c in READOUT_NAMES)
_COUNTS = ["n_sections", "n_vessels", "n_slides"]


def cohort_ladder(spark, d):
    made = cohort.ladder(sections(spark, d))
    return rounded(made.select("genotype", "mouse", "segment", *_COUNTS, "age", F.col("wall_length_um").alias("length_um"), *READOUT_NAMES, "muscle_variation", "lamellar_spacing_um"), 6)


SQL = {}
SQL["cohort_ladder"] = f"""WITH {SECTIONS}, p AS (
  SELECT genotype, mouse, CASE WHEN grouping(segment) = 1 THEN 'all segments' ELSE segment END AS segment, {POOLED}
  FROM sections GROUP BY GROUPING SETS ((genotype, mouse, segment), (genotype, mouse))),
r AS (SELECT *, {READOUTS} FROM p)
SELECT genotype, mouse, segment, n_sections, n_vessels, n_slides, age, round(L, 6) AS length_um, {R}, round(var, 6) AS muscle_variation, round(spacing, 6) AS lamellar_spacing_um FROM r"""


def pool_ratio_of_sums(spark, d):
    return rounded(cohort.pool(sections(spark, d), ["genotype", "segment"], carry=("age",), counted=("slide", "mouse")).select("genotype", "segment", "n_sections", "n_vessels", "n_slides", "n_mouses", *READOUT_NAMES))


SQL["pool_ratio_of_sums"] = f"""WITH {SECTIONS}, p AS (SELECT genotype, segment, {POOLED}, count(DISTINCT mouse) AS n_mouses FROM sections GROUP BY genotype, segment), r AS (SELECT *, {READOUTS} FROM p)
SELECT genotype, segment, n_sections, n_vessels, n_slides, n_mouses, {R} FROM r"""


def pool_weighted_columns(spark, d):
    return rounded(cohort.pool(sections(spark, d), ["mouse"], counted=()).select("mouse", "muscle_variation", "lamellar_spacing_um", "lamellar_coverage"))


SQL["pool_weighted_columns"] = f"""WITH {SECTIONS}, p AS (SELECT mouse, {POOLED} FROM sections GROUP BY mouse)
SELECT mouse, round(var, 6) AS muscle_variation, round(spacing, 6) AS lamellar_spacing_um, round(cover, 6) AS lamellar_coverage FROM p"""


def area_scheme(spark, d):
    s = table(spark, d, "part").select(F.col("p_brand").alias("genotype"), (F.col("p_size") / 10.0).alias("tissue_area_mm2"), (F.col("p_size") / 5.0).alias("imaged_area_mm2"), F.col("p_retailprice").alias("collagen_od_um2_total"), (F.col("p_retailprice") * 2 + F.col("p_size")).alias("muscle_od_um2_total"))
    return rounded(cohort.pool(s, ["genotype"], cohort.AREA).select("genotype", "tissue_area_mm2", "collagen_to_muscle_ratio", "collagen_fraction_of_stain", "collagen_od_um2_per_mm2_tissue", "tissue_fraction_of_image"))


SQL["area_scheme"] = """WITH p AS (SELECT p_brand AS genotype, sum(p_size / 10.0) AS T, sum(p_size / 5.0) AS I, sum(p_retailprice) AS C, sum(p_retailprice * 2 + p_size) AS M FROM part GROUP BY p_brand)
SELECT genotype, round(CAST(T AS DOUBLE), 6) AS tissue_area_mm2, round(C / M, 6) AS collagen_to_muscle_ratio, round(C / (C + M), 6) AS collagen_fraction_of_stain, round(C / CAST(T AS DOUBLE), 6) AS collagen_od_um2_per_mm2_tissue, round(CAST(T AS DOUBLE) / CAST(I AS DOUBLE), 6) AS tissue_fraction_of_image FROM p"""


def readouts_filled(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("wall_length_um"), F.col("l_extendedprice").alias("media_area_um2"), F.when(F.col("l_linenumber") == 1, 7.5).alias("mean_media_thickness_um"))
    return rounded(cohort.with_readouts(s).select("l_orderkey", "l_linenumber", "mean_media_thickness_um"))


SQL["readouts_filled"] = "SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber = 1 THEN 7.5 END, CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity END), 6) AS mean_media_thickness_um FROM lineitem"


def pool_exact_medians(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value", (F.col("value") / 10).alias("beyond"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 10) / 10).alias("fill"))
    return rounded(cohort.exact_medians(e, ["event_type"], ["value", "beyond"], finite_share="fill", beyond="beyond", fill="fill"))


SQL["pool_exact_medians"] = """WITH e AS (SELECT event_type, value, value / 10 AS beyond, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 10 AS DOUBLE) / 10 END AS fill FROM events)
SELECT event_type, count(*) AS n_positions, round(median(value), 6) AS value, round(median(beyond), 6) AS beyond, round(avg(CASE WHEN fill IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage,
  round(avg(CASE WHEN fill IS NOT NULL THEN CASE WHEN beyond > 12 AND fill < 0.8 THEN 1.0 ELSE 0.0 END END), 6) AS fragmented FROM e GROUP BY event_type"""


def constant_or_unknown(spark, d):
    from strataline.functions.core import constant_or_unknown as shared

    return table(spark, d, "orders").groupBy("o_custkey").agg(shared("o_orderstatus").alias("status"), F.count("*").alias("n"))


SQL["constant_or_unknown"] = "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) ELSE 'unknown' END AS status, count(*) AS n FROM orders GROUP BY o_custkey"

_SUBJECTS = f"{SECTIONS}, p AS (SELECT genotype, mouse, segment, {POOLED} FROM sections GROUP BY genotype, mouse, segment), r AS (SELECT *, {READOUTS} FROM p)"
_TWO = ["collagen_to_muscle_ratio", "mean_media_thickness_um"]
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT segment, genotype, n_sections, '{c}' AS readout, {c} AS value FROM r" for c in _TWO) + ")"


def _subjects(spark, d):
    return cohort.pool(sections(spark, d), ["genotype", "mouse", "segment"], counted=())


def group_summary_long(spark, d):
    return rounded(cohort.per_group(_subjects(spark, d), _TWO))


SQL["group_summary_long"] = f"""WITH {_SUBJECTS}, {_LONG}
SELECT segment, genotype, readout, count(*) AS n, CAST(sum(n_sections) AS BIGINT) AS n_sections, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem
FROM long WHERE value IS NOT NULL GROUP BY segment, genotype, readout"""


def pairwise_welch_t(spark, d):
    return rounded(cohort.compare_groups(_subjects(spark, d), _TWO, p_values=False), 5)


SQL["pairwise_welch_t"] = f"""WITH {_SUBJECTS}, {_LONG}, m AS (SELECT segment, readout, genotype, count(*) AS n, avg(value) AS mean, var_samp(value) AS v FROM long WHERE value IS NOT NULL GROUP BY segment, readout, genotype)
SELECT a.segment, a.readout, a.genotype AS a, b.genotype AS b, a.n AS n_a, b.n AS n_b, round(a.mean, 5) AS mean_a, round(b.mean, 5) AS mean_b, round(b.mean - a.mean, 5) AS difference, round(CASE WHEN a.mean > 0 THEN b.mean / a.mean END, 5) AS ratio,
  round(CASE WHEN a.n > 1 AND b.n > 1 AND a.v / a.n + b.v / b.n > 0 THEN (a.mean - b.mean) / sqrt(a.v / a.n + b.v / b.n) END, 5) AS t,
  round(CASE WHEN a.n > 1 AND b.n > 1 AND a.v / a.n + b.v / b.n > 0 THEN power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)) END, 5) AS df
FROM m a JOIN m b ON a.segment = b.segment AND a.readout = b.readout AND a.genotype < b.genotype"""


def pairwise_welch_p(spark, d):
    """With p, whose tail SQL can't express."""
    return rounded(cohort.compare_groups(_subjects(spark, d), _TWO), 5)


def depth_two_level_mean(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("user_id").cast("string").alias("mouse"), F.hour("ts").alias("depth"), "value", F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 5).alias("w"))
    return rounded(cohort.depth_average(e, ["event_type"], "mouse", "depth", ["value"], "w"))


SQL["depth_two_level_mean"] = """WITH e AS (SELECT event_type, user_id, CAST(extract(hour FROM ts) AS INTEGER) AS depth, value, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 5 AS DOUBLE) END AS w FROM events),
m AS (SELECT event_type, user_id, depth, sum(CASE WHEN w > 0 THEN value * w END) / sum(CASE WHEN w > 0 THEN w END) AS value FROM e GROUP BY event_type, user_id, depth)
SELECT event_type, depth, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_sd, count(value) AS value_n FROM m GROUP BY event_type, depth"""


def group_options(spark, d):
    return cohort.group_options(sections(spark, d), ["genotype", "segment", "age"])


SQL["group_options"] = f"""WITH {SECTIONS}, l AS (SELECT DISTINCT 'genotype' AS field, genotype AS label FROM sections UNION SELECT DISTINCT 'segment', segment FROM sections UNION SELECT DISTINCT 'age', age FROM sections)
SELECT field, count(*) AS n_labels, string_agg(label, ', ' ORDER BY label) AS labels FROM l GROUP BY field HAVING count(*) > 1 OR field = 'genotype'"""


def meta_left_join_coalesce(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, 1).alias("quality"))
    return cohort.merge_metadata(docs, table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id")


SQL["meta_left_join_coalesce"] = "SELECT d.doc_id, d.lang, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN 1 END, l.quality) AS quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def override_overlay(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    own = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, ""), (3, 1, "C")], "c_custkey long, at int, c_mktsegment string")
    tray = spark.createDataFrame([(2, 1, "D", "named"), (3, 1, "E", ""), (4, 1, None, "n4")], "c_custkey long, at int, c_mktsegment string, c_name string")
    return cohort.overlay(c, "c_custkey", own, tray)


SQL["override_overlay"] = """SELECT c_custkey, CASE c_custkey WHEN 1 THEN 'B' WHEN 2 THEN 'D' WHEN 3 THEN 'C' ELSE c_mktsegment END AS c_mktsegment,
CASE c_custkey WHEN 2 THEN 'named' WHEN 4 THEN 'n4' ELSE c_name END AS c_name FROM customer"""


def lookup_default_null(spark, d):
    labels = spark.createDataFrame([("Brand#11", "x"), ("Brand#12", "y"), ("Brand#21", "z")], "brand string, group string")
    return cohort.lookup(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", labels, "brand", "group")


SQL["lookup_default_null"] = "SELECT p_partkey, p_brand, CASE p_brand WHEN 'Brand#11' THEN 'x' WHEN 'Brand#12' THEN 'y' WHEN 'Brand#21' THEN 'z' END AS \"group\" FROM part"

QUERIES = {f.__name__: f for f in (cohort_ladder, pool_ratio_of_sums, pool_weighted_columns, area_scheme, readouts_filled, pool_exact_medians, constant_or_unknown, group_summary_long, pairwise_welch_t, pairwise_welch_p, depth_two_level_mean, group_options, meta_left_join_coalesce, override_overlay, lookup_default_null)}
