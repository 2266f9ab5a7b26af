"""Comparisons and corrections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.functions import ordering
from strataline.operators import stats
from strataline.plans.tables import rounded, table

SQL = {}
_MOMENTS = "m AS (SELECT segment, g, count(*) AS n, avg(v) AS mean, var_samp(v) AS var, median(v) AS med FROM s GROUP BY segment, g)"
_PRICES = "s AS (SELECT o_orderpriority AS segment, o_orderstatus AS g, o_totalprice AS v FROM orders)"


def describe_groups_by_unit(spark, d):
    return rounded(stats.describe_groups(table(spark, d, "events"), "value", "event_type", unit="user_id"))


SQL["describe_groups_by_unit"] = """WITH u AS (SELECT event_type, user_id, avg(value) AS value FROM events GROUP BY event_type, user_id)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem FROM u GROUP BY event_type"""


def _levels(spark, d):
    return table(spark, d, "nation").withColumn("level_order", F.col("n_nationkey"))


def pair_plan_all(spark, d):
    return stats.level_pairs(_levels(spark, d), "n_name", "level_order", "all", within=["n_regionkey"])


def pair_plan_adjacent(spark, d):
    return stats.level_pairs(_levels(spark, d), "n_name", "level_order", "adjacent", within=["n_regionkey"])


def pair_plan_control(spark, d):
    first = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return stats.level_pairs(_levels(spark, d), "n_name", "level_order", "control", first)


def pair_plan_given(spark, d):
    """Each nation listed with the seven that follow it, of which those of its region are compared; some are listed twice or with themselves."""
    n = table(spark, d, "nation")
    listed = n.select(F.col("n_name").alias("a"), F.explode(F.array(*[F.lit(k) for k in (0, 1, 2, 3, 4, 5, 5, 6, 7)])).alias("k"), "n_nationkey")
    pairs = listed.join(n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("_k")), F.col("_k") == F.col("n_nationkey") + F.col("k"))
    return stats.level_pairs(_levels(spark, d), "n_name", "level_order", "given", within=["n_regionkey"], pairs=pairs)


SQL["pair_plan_given"] = "SELECT a.n_regionkey, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey - a.n_nationkey BETWEEN 1 AND 7"
SQL["pair_plan_all"] = "SELECT a.n_regionkey, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"
SQL["pair_plan_adjacent"] = "SELECT * FROM (SELECT n_regionkey, n_name AS a, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation) WHERE b IS NOT NULL"
SQL["pair_plan_control"] = "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON b.n_name = (SELECT min(n_name) FROM nation) AND a.n_name <> b.n_name"


def mann_whitney_u(spark, d):
    return rounded(stats.mann_whitney(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", "F", "O", ["o_orderpriority"]))


SQL["mann_whitney_u"] = """WITH r AS (SELECT o_orderpriority, o_orderstatus AS g, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS rk,
  CAST(count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) AS DOUBLE) AS t FROM orders WHERE o_orderstatus IN ('F', 'O')),
s AS (SELECT o_orderpriority, count(*) FILTER (g = 'F') AS n_a, count(*) FILTER (g = 'O') AS n_b, sum(t * t - 1) AS tie_sum, CAST(sum(rk) FILTER (g = 'F') AS DOUBLE) AS ra FROM r GROUP BY o_orderpriority),
q AS (SELECT *, ra - n_a * (n_a + 1) / 2.0 AS u FROM s)
SELECT o_orderpriority, n_a, n_b, tie_sum, round(CAST(u AS DOUBLE), 6) AS u, round(2 * CAST(u AS DOUBLE) / (n_a * n_b) - 1, 6) AS delta,
  round(greatest(abs(u - n_a * n_b / 2.0) - 0.5, 0) / sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - tie_sum / ((n_a + n_b) * (n_a + n_b - 1)))) * sign(u - n_a * n_b / 2.0), 6) AS z FROM q"""


def cliffs_delta(spark, d):
    made = stats.mann_whitney(table(spark, d, "supplier").withColumn("half", F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd")).withColumn("one", F.lit(1)), "s_acctbal", "half", "even", "odd", ["one"])
    return rounded(made.select("n_a", "n_b", "delta"))


SQL["cliffs_delta"] = """WITH p AS (SELECT a.s_acctbal AS x, b.s_acctbal AS y FROM supplier a JOIN supplier b ON a.s_suppkey % 2 = 0 AND b.s_suppkey % 2 = 1)
SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS n_a, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 1) AS n_b, round(CAST(sum(CASE WHEN x > y THEN 1 WHEN x < y THEN -1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS delta FROM p"""


def _moments(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("segment"), F.col("o_orderstatus").alias("g"), F.col("o_totalprice").alias("v"))
    return stats.pair_moments(rows, "v", "g", ["segment"])


def hedges_g(spark, d):
    c = [F.col(f"{x}_{s}") for x in ("mean", "var", "n") for s in "ab"]
    return rounded(_moments(spark, d).select("segment", "a", "b", stats.hedges_g(*c).alias("g")))


def welch_and_student(spark, d):
    c = [F.col(f"{x}_{s}") for x in ("mean", "var", "n") for s in "ab"]
    w, s = stats.welch(*c), stats.student(*c)
    return rounded(_moments(spark, d).select("segment", "a", "b", w[0].alias("t_welch"), w[1].alias("df_welch"), s[0].alias("t_student"), s[1].alias("df_student"), (F.col("median_a") - F.col("median_b")).alias("difference")), 5)


_JOIN = "FROM m x JOIN m y ON x.segment = y.segment AND x.g < y.g"
SQL["hedges_g"] = f"""WITH {_PRICES}, {_MOMENTS} SELECT x.segment, x.g AS a, y.g AS b,
round((x.mean - y.mean) / sqrt(((x.n - 1) * x.var + (y.n - 1) * y.var) / (x.n + y.n - 2)) * (1 - 3.0 / (4 * (x.n + y.n) - 9)), 6) AS g {_JOIN} AND x.n > 1 AND y.n > 1"""
SQL["welch_and_student"] = f"""WITH {_PRICES}, {_MOMENTS} SELECT x.segment, x.g AS a, y.g AS b, round((x.mean - y.mean) / sqrt(x.var / x.n + y.var / y.n), 5) AS t_welch,
round(power(x.var / x.n + y.var / y.n, 2) / (power(x.var / x.n, 2) / (x.n - 1) + power(y.var / y.n, 2) / (y.n - 1)), 5) AS df_welch,
round((x.mean - y.mean) / sqrt(((x.n - 1) * x.var + (y.n - 1) * y.var) / (x.n + y.n - 2) * (1.0 / x.n + 1.0 / y.n)), 5) AS t_student, CAST(x.n + y.n - 2 AS DOUBLE) AS df_student, round(x.med - y.med, 5) AS difference {_JOIN}"""


_BLOCKS = ["a", "b", "block"]


def _pairs(spark, d):
    e = table(spark, d, "events").withColumn("block", (F.col("user_id") % 4).cast("int"))
    return stats.align_all_pairs(e, "value", "event_type", "user_id", ["block"])


_PAIRS = """t AS (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL), k AS (SELECT x.event_type AS a, y.event_type AS b FROM t x JOIN t y ON x.event_type < y.event_type),
p AS (SELECT a, b, CAST(user_id % 4 AS INTEGER) AS block, user_id, avg(CASE WHEN event_type = a THEN value END) AS va, avg(CASE WHEN event_type = b THEN value END) AS vb
      FROM events JOIN k ON event_type IN (a, b) GROUP BY a, b, user_id % 4, user_id)"""


def paired_t(spark, d):
    return rounded(stats.paired_t(_pairs(spark, d), _BLOCKS))


def pooled_paired_t(spark, d):
    """Blocks of one pair of event types share a variance."""
    return rounded(stats.pooled_paired_t(_pairs(spark, d), _BLOCKS, family=["a", "b"]))


def pooled_ratio_t(spark, d):
    return rounded(stats.pooled_paired_t(_pairs(spark, d), _BLOCKS, ratio=True, family=["a", "b"]))


SQL["paired_t"] = f"""WITH {_PAIRS} SELECT a, b, block, count(va - vb) AS n, count(*) FILTER (va IS NULL OR vb IS NULL) AS dropped, round(avg(va - vb), 6) AS difference, round(stddev_samp(va - vb), 6) AS sd,
round(avg(va - vb) / (stddev_samp(va - vb) / sqrt(count(va - vb))), 6) AS t, CAST(count(va - vb) - 1 AS DOUBLE) AS df FROM p GROUP BY a, b, block"""
_POOL = """m AS (SELECT a, b, block, count(x) AS n, avg(x) AS mean, var_samp(x) * (count(x) - 1) AS ss FROM q GROUP BY a, b, block), z AS (SELECT a, b, sum(ss) AS ss_all, CAST(sum(n - 1) AS DOUBLE) AS df FROM m GROUP BY a, b)"""
SQL["pooled_paired_t"] = f"WITH {_PAIRS}, q AS (SELECT a, b, block, va - vb AS x FROM p WHERE va IS NOT NULL AND vb IS NOT NULL), {_POOL} SELECT m.a, m.b, block, n, round(mean, 6) AS effect, round(mean / (sqrt(ss_all / df) / sqrt(n)), 6) AS t, df FROM m JOIN z USING (a, b)"
SQL["pooled_ratio_t"] = f"WITH {_PAIRS}, q AS (SELECT a, b, block, ln(va / vb) AS x FROM p WHERE va > 0 AND vb > 0), {_POOL} SELECT m.a, m.b, block, n, round(exp(mean), 6) AS effect, round(mean / (sqrt(ss_all / df) / sqrt(n)), 6) AS t, df FROM m JOIN z USING (a, b)"


def _p_values(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5).alias("family"), F.when(F.col("p_partkey") % 11 != 0, (F.col("p_partkey") * 7919 % 1000 + 1) / 1001).alias("p"))


_P = "v AS (SELECT p_partkey, p_size % 5 AS family, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey * 7919 % 1000 + 1 AS DOUBLE) / 1001 END AS p FROM part), w AS (SELECT *, count(p) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p, p_partkey) AS r FROM v)"


def _adjusted(how):
    def query(spark, d):
        return rounded(stats.adjust(_p_values(spark, d), "p", how, ["family"], "p_partkey"))

    query.__name__ = f"adjust_{how.removeprefix('fdr_')}"
    return query


adjust_bh, adjust_holm, adjust_bonferroni = (_adjusted(h) for h in ("fdr_bh", "holm", "bonferroni"))
SQL["adjust_bh"] = f"WITH {_P} SELECT p_partkey, family, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / r) OVER (PARTITION BY family, p IS NULL ORDER BY p DESC, p_partkey DESC ROWS UNBOUNDED PRECEDING)) END, 6) AS p_adjusted FROM w"
SQL["adjust_holm"] = f"WITH {_P} SELECT p_partkey, family, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(1.0, max(p * (m - r + 1)) OVER (PARTITION BY family, p IS NULL ORDER BY p, p_partkey ROWS UNBOUNDED PRECEDING)) END, 6) AS p_adjusted FROM w"
SQL["adjust_bonferroni"] = f"WITH {_P} SELECT p_partkey, family, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(1.0, p * m) END, 6) AS p_adjusted FROM w"


def p_labels(spark, d):
    return _p_values(spark, d).select("p_partkey", stats.stars(F.col("p") / 1000).alias("label"), stats.format_p(F.col("p")).alias("text"))


SQL["p_labels"] = f"""WITH {_P} SELECT p_partkey, CASE WHEN p IS NULL THEN NULL WHEN p / 1000 < 1e-5 THEN '*****' WHEN p / 1000 < 1e-4 THEN '****' WHEN p / 1000 < 0.001 THEN '***' WHEN p / 1000 < 0.01 THEN '**' WHEN p / 1000 < 0.05 THEN '*' ELSE 'ns' END AS label,
CASE WHEN p < 0.001 THEN 'p < 0.001' WHEN p IS NOT NULL THEN 'p = ' || printf('%.3f', p) END AS "text" FROM v"""


def aligned_rank(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("v"))
    rows = stats.aligned(rows, "v", ["l_returnflag", "l_linestatus"], ["l_returnflag", "l_linestatus"])
    rows = ordering.ranked(rows.withColumn("aligned", F.round("aligned", 5)), "aligned")
    return rows.select("l_orderkey", "l_linenumber", "aligned", "rank")


SQL["aligned_rank"] = """WITH a AS (SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus) + avg(l_quantity) OVER () - avg(l_quantity) OVER (PARTITION BY l_returnflag) - avg(l_quantity) OVER (PARTITION BY l_linestatus) + avg(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus), 5) AS aligned FROM lineitem)
SELECT *, rank() OVER (ORDER BY aligned) + (count(*) OVER (PARTITION BY aligned) - 1) / 2.0 AS rank FROM a"""


def average_ranks(spark, d):
    return table(spark, d, "part").select("p_partkey", stats.average_rank("p_size", "p_brand").alias("rank"))


SQL["average_ranks"] = "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank FROM part"


def compare_all(spark, d):
    return rounded(stats.compare(table(spark, d, "events"), "value", "event_type", unit="user_id"), 5)


def factorial_anova(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 3).alias("third"), F.col("c_acctbal").alias("value"))
    return rounded(stats.factorial(rows, "value", ["segment", "third"]), 5)


def factorial_mixed(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.hour("ts") % 2).alias("half"), "user_id", "value")
    return rounded(stats.factorial(rows, "value", ["event_type", "half"], subject="user_id"), 4)


QUERIES = {f.__name__: f for f in (describe_groups_by_unit, pair_plan_all, pair_plan_adjacent, pair_plan_control, pair_plan_given, mann_whitney_u, cliffs_delta, hedges_g, welch_and_student, paired_t, pooled_paired_t, pooled_ratio_t, adjust_bh, adjust_holm, adjust_bonferroni, p_labels, aligned_rank, average_ranks, compare_all, factorial_anova, factorial_mixed)}
