"""Names, layouts, sources and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.functions import ordering
from strataline.operators import naming
from strataline.plans.tables import rounded, table
from strataline.streaming import pooling

SQL = {}


def _names(spark, d):
    """Section names built from the customers' rows."""
    c = table(spark, d, "customer")
    organ = F.element_at(F.array(*[F.lit(x) for x in ("aortic arch", "Descending thoracic", "root", "middle aorta", "abdominal")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select("c_custkey", F.concat_ws("_", (F.col("c_custkey") % 9).cast("string"), (F.col("c_custkey") + 1000).cast("string"), F.concat(F.lit("L8-KO, "), (F.col("c_custkey") % 50).cast("string"), F.lit("W")), organ, F.concat(F.lit("slide "), (F.col("c_nationkey")).cast("string")), F.concat(F.lit("sec"), (F.col("c_custkey") % 4).cast("string"))).alias("name"))


def parse_section_names(spark, d):
    return naming.parse_section_names(_names(spark, d), "name").select("c_custkey", "mouse", "genotype", "age", "segment", "slide", "section", "unparsed")


SQL["parse_section_names"] = """SELECT c_custkey, CAST(c_custkey + 1000 AS VARCHAR) AS mouse, 'L8-KO' AS genotype, CAST(c_custkey % 50 AS VARCHAR) || 'W' AS age, CASE c_custkey % 5 WHEN 0 THEN 'aortic arch' WHEN 1 THEN 'descending thoracic' WHEN 2 THEN '' WHEN 3 THEN 'middle aorta' ELSE 'abdominal aorta' END AS segment,
CAST(c_nationkey AS VARCHAR) AS slide, CAST(c_custkey % 4 AS VARCHAR) AS section, CAST(c_custkey % 9 AS VARCHAR) || CASE WHEN c_custkey % 5 = 2 THEN ' | root' ELSE '' END AS unparsed FROM customer"""


def kidney_regions(spark, d):
    text = F.element_at(F.array(*[F.lit(x) for x in ("Ctx, Med", "Pap, Outer Med, Ctx", "cortex", "none")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", naming.region_of(text, "kidney").alias("region"))


SQL["kidney_regions"] = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'medulla, cortex' WHEN 1 THEN 'papilla, outer medulla, cortex' WHEN 2 THEN 'cortex' ELSE '' END AS region FROM part"


def _files(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("20260815_"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("_dish"), (F.col("p_size") % 3).cast("string"), F.lit("__"), F.col("p_partkey").cast("string"), F.lit(".tif")).alias("image"))


def split_file_names(spark, d):
    return _files(spark, d).select("p_partkey", F.array_join(naming.split_name(F.col("image"), "_ OR -"), "/").alias("parts"))


SQL["split_file_names"] = "SELECT p_partkey, '20260815/' || replace(p_brand, '#', '/') || '/dish' || CAST(p_size % 3 AS VARCHAR) || '/' || CAST(p_partkey AS VARCHAR) AS parts FROM part"


def part_roles(spark, d):
    # file numbers grow with the table: whole numbers of any length
    return naming.part_roles(_files(spark, d).select("image"), "image", digits=None).select("pos", "files", "values", "role")


SQL["part_roles"] = """SELECT 0 AS pos, count(*) AS files, CAST(1 AS BIGINT) AS "values", 'date' AS role FROM part UNION ALL SELECT 1, count(*), count(DISTINCT p_brand), 'variant' FROM part UNION ALL SELECT 2, count(*), count(DISTINCT p_size % 3), 'dish' FROM part UNION ALL SELECT 3, count(*), count(DISTINCT p_partkey), 'field' FROM part"""


def parse_names(spark, d):
    made = naming.parse_names(_files(spark, d), "image", {4: ["date", "variant", "ignore", "variant"]})
    return naming.group_labels(made).select("p_partkey", "parsed", "date", "variant", "variant_2", "group")


SQL["parse_names"] = "SELECT p_partkey, true AS parsed, '20260815' AS date, replace(p_brand, '#', '-') AS variant, CAST(p_partkey AS VARCHAR) AS variant_2, replace(p_brand, '#', '-') AS \"group\" FROM part"


def canon_wells(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("r"), (F.col("p_partkey") % 20).cast("string"), F.lit("c"), (F.col("p_size") % 30).cast("string"))).otherwise(F.concat(F.chr(F.col("p_partkey") % 20 + 97), F.lit("-"), (F.col("p_size") % 30).cast("string"))).alias("text"))
    return p.select("p_partkey", naming.canon_well(F.col("text")).alias("well"))


SQL["canon_wells"] = """WITH w AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 20 - 1 ELSE p_partkey % 20 END AS r, p_size % 30 AS c FROM part)
SELECT p_partkey, CASE WHEN r BETWEEN 0 AND 15 AND c BETWEEN 1 AND 24 THEN chr(CAST(65 + r AS INTEGER)) || lpad(CAST(c AS VARCHAR), 2, '0') END AS well FROM w"""


def well_layout(spark, d):
    p = table(spark, d, "part").select(F.lit(" dose ").alias("column"), F.concat(F.chr(F.col("p_partkey") % 20 + 65), (F.col("p_size") % 30).cast("string")).alias("w"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("label"))
    return naming.clean_layout(p, "column", "w", "label")


SQL["well_layout"] = """SELECT 'dose' AS "column", chr(CAST(65 + p_partkey % 20 AS INTEGER)) || lpad(CAST(p_size % 30 AS VARCHAR), 2, '0') AS well, max(p_brand) AS label FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 20 < 16 AND p_size % 30 BETWEEN 1 AND 24 GROUP BY 2"""


def first_channels(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("r02c01f"), F.lpad(F.floor(F.col("p_partkey") / 3).cast("string"), 4, "0"), F.lit("p01-ch"), (F.col("p_partkey") % 3 + 1).cast("string"), F.lit("sk1fk1fl1.tiff")).alias("name"), "p_partkey")
    return naming.first_channels(p, "name").select("p_partkey")


SQL["first_channels"] = "SELECT min(p_partkey) AS p_partkey FROM part GROUP BY p_partkey // 3"


def natural_order(spark, d):
    n = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("tile"), F.col("s_suppkey").cast("string"), F.lit("b")).alias("name"))
    n = n.withColumn("key", naming.natural_key(F.col("name")))
    return ordering.numbered(n, [F.col("key")]).select("s_suppkey", "position")


SQL["natural_order"] = "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS position FROM supplier"


def json_layout(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))["k"].alias("k"))


SQL["json_layout"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def streamed_pool(spark, d):
    """The stream's result after all files, through a memory sink that holds one row a group."""
    schema = table(spark, d, "events").schema
    import os
    import uuid

    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if os.path.isfile(f"{d}/events.parquet") else "*.parquet").parquet(d if os.path.isfile(f"{d}/events.parquet") else f"{d}/events.parquet")
    made = pooling.running_pool(stream.withColumn("ones", F.lit(1.0)), ["event_type"], ["value", "ones"], {"mean": ("value", "ones")})
    name = f"pool_{uuid.uuid4().hex}"
    made.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.table(name).select("event_type", "n", "mean"), 5)


SQL["streamed_pool"] = "SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean FROM events GROUP BY event_type"


def windowed_pool(spark, d):
    return rounded(pooling.windowed_pool(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean"))


SQL["windowed_pool"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2"


def idle_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return pooling.idle_sessions(e, "ts", "user_id", "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


SQL["idle_sessions"] = """WITH s AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS st FROM events) SELECT user_id, CAST(sum(st) AS BIGINT) AS sessions, count(*) AS n FROM s GROUP BY user_id"""

QUERIES = {f.__name__: f for f in (parse_section_names, kidney_regions, split_file_names, part_roles, parse_names, canon_wells, well_layout, first_channels, natural_order, json_layout, streamed_pool, windowed_pool, idle_sessions)}
