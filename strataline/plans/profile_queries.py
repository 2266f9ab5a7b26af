"""Ordered positions and signals over the events of each user."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strataline.operators import profile, series
from strataline.plans.tables import rounded, table

SQL = {}
K, AT = ["user_id"], ["ts", "event_id"]
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
O = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def _millis():
    """Milliseconds since 1970 of a time without zone, whatever the session's zone; to the nearest, halves away from zero."""
    return F.expr("round(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)), -3) div 1000")


def _events(spark, d):
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value", (F.col("value") > 150).alias("high"), F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("sparse"))


E = "e AS (SELECT *, value > 150 AS high, CASE WHEN event_id % 4 = 0 THEN value END AS sparse, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def running_ratio(spark, d):
    e = _events(spark, d).withColumn("num", F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0))
    return rounded(profile.running_ratio(e, K, AT, "num", "value").select("event_id", "running_ratio"))


SQL["running_ratio"] = f"""WITH e AS (SELECT *, CASE WHEN event_type = 'click' THEN value ELSE 0.0 END AS num FROM events), s AS (SELECT event_id, sum(num) {W} AS a, sum(value) {W} AS b, sum(value) OVER (PARTITION BY user_id) AS t FROM e)
SELECT event_id, round(CASE WHEN b > 0.01 * greatest(t, 1e-9) THEN a / b END, 6) AS running_ratio FROM s"""


def cumulative_columns(spark, d):
    e = series.positioned(_events(spark, d), K, AT)
    return rounded(profile.cumulative(e, K, ["i"], ["value", "sparse"]).select("event_id", "cum_value", "cum_sparse", "arc_fraction"))


SQL["cumulative_columns"] = f"WITH {E} SELECT event_id, round(sum(value) {W}, 6) AS cum_value, round(sum(sparse) {W}, 6) AS cum_sparse, round(CASE WHEN n > 1 THEN CAST(i - 1 AS DOUBLE) / (n - 1) END, 6) AS arc_fraction FROM e"


def runs_and_segments(spark, d):
    e = profile.with_runs(_events(spark, d), K, AT, "high")
    return profile.segments(e, K, AT, "high").select("event_id", "run", F.col("segment").cast("long"))


SQL["runs_and_segments"] = f"""WITH {E}, s AS (SELECT *, CASE WHEN lag(high) {O} IS NULL OR lag(high) {O} <> high THEN 1 ELSE 0 END AS st, CASE WHEN NOT high AND coalesce(lag(high) {O}, true) THEN 1 ELSE 0 END AS ps FROM e)
SELECT event_id, CAST(sum(st) {W} AS BIGINT) AS run, CASE WHEN high THEN -1 ELSE CAST(sum(ps) {W} AS BIGINT) - 1 END AS segment FROM s"""


def long_runs(spark, d):
    return profile.long_runs(_events(spark, d), K, AT, "high", 3).select("event_id", "kept")


def long_runs_closed(spark, d):
    return profile.long_runs(_events(spark, d), K, AT, "high", 3, closed=True).select("event_id", "kept")


_RUNS = f"{E}, s AS (SELECT *, CASE WHEN lag(high) {O} IS NULL OR lag(high) {O} <> high THEN 1 ELSE 0 END AS st FROM e), r AS (SELECT *, sum(st) {W} AS run FROM s)"
SQL["long_runs"] = f"WITH {_RUNS} SELECT event_id, high AND count(*) OVER (PARTITION BY user_id, run) >= 3 AS kept FROM r"
SQL["long_runs_closed"] = f"""WITH {_RUNS}, b AS (SELECT user_id, max(run) AS last FROM r GROUP BY user_id), f AS (SELECT r.user_id, bool_or(run = 1 AND high) AND bool_or(run = last AND high) AS joined FROM r JOIN b ON r.user_id = b.user_id GROUP BY r.user_id),
c AS (SELECT r.*, CASE WHEN joined AND run = last THEN 1 ELSE run END AS run2 FROM r JOIN b ON r.user_id = b.user_id JOIN f ON r.user_id = f.user_id)
SELECT event_id, high AND count(*) OVER (PARTITION BY user_id, run2) >= 3 AS kept FROM c"""


def interpolate_gaps(spark, d):
    e = series.positioned(_events(spark, d), K, AT)
    return rounded(profile.interpolate(e, K, "i", "sparse").select("event_id", "filled"))


SQL["interpolate_gaps"] = f"""WITH {E}, g AS (SELECT *, max(CASE WHEN sparse IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i0,
  min(CASE WHEN sparse IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM e)
SELECT g.event_id, round(CASE WHEN g.i0 IS NULL AND g.i1 IS NULL THEN 0.0 WHEN g.i0 IS NULL THEN b.sparse WHEN g.i1 IS NULL OR g.i0 = g.i1 THEN a.sparse ELSE a.sparse + (b.sparse - a.sparse) * (g.i - g.i0) / (g.i1 - g.i0) END, 6) AS filled
FROM g LEFT JOIN e a ON a.user_id = g.user_id AND a.i = g.i0 LEFT JOIN e b ON b.user_id = g.user_id AND b.i = g.i1"""


def rolling_despike(spark, d):
    return rounded(profile.spikes(profile.rolling_median(_events(spark, d), K, AT, "value", 2), K, AT, "value", 2, 80.0).select("event_id", "rolling", "clean"))


SQL["rolling_despike"] = f"""WITH {E}, m AS (SELECT a.event_id, a.value, median(b.value) AS med FROM e a JOIN e b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY a.event_id, a.value)
SELECT event_id, round(med, 6) AS rolling, round(CASE WHEN abs(value - med) <= 80 THEN value END, 6) AS clean FROM m"""


def despiked_profiles(spark, d):
    e = series.positioned(_events(spark, d), K, AT)
    return rounded(profile.despike(e, K, "i", "value", 5, 80.0, 1.5))


_DOWN, _UP = "OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _held(column: str, k: int) -> str:
    """The value k positions on, that of the end where the profile ends before."""
    order = "OVER (PARTITION BY user_id ORDER BY i)"
    every = "OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return column if not k else f"coalesce({'lead' if k > 0 else 'lag'}({column}, {abs(k)}) {order}, {'last' if k > 0 else 'first'}_value({column}) {every})"


_KERNEL = [math.exp(-0.5 * (k / 1.5) ** 2) for k in range(-6, 7)]
SQL["despiked_profiles"] = f"""WITH p AS (SELECT user_id, row_number() {O} - 1 AS i, value FROM events), m AS (SELECT *, list_aggregate([{", ".join(_held("value", k) for k in range(-2, 3))}], 'median') AS med FROM p),
g AS (SELECT *, CASE WHEN abs(value - med) <= 80 THEN i END AS gi, CASE WHEN abs(value - med) <= 80 THEN value END AS gv FROM m),
b AS (SELECT *, last_value(gi IGNORE NULLS) {_DOWN} AS i0, last_value(gv IGNORE NULLS) {_DOWN} AS v0, first_value(gi IGNORE NULLS) {_UP} AS i1, first_value(gv IGNORE NULLS) {_UP} AS v1 FROM g),
f AS (SELECT user_id, i, value, CASE WHEN gv IS NOT NULL THEN gv WHEN i0 IS NULL AND i1 IS NULL THEN med WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END AS v FROM b)
SELECT user_id, CAST(i AS INTEGER) AS i, round(value, 6) AS value, round(({" + ".join(f"{w!r}::DOUBLE * {_held('v', k)}" for k, w in zip(range(-6, 7), _KERNEL))}) / {sum(_KERNEL)!r}::DOUBLE, 6) AS despiked FROM f"""


def turn_zones(spark, d):
    return profile.turns(_events(spark, d).withColumn("side", F.col("event_id") % 3 == 0), K, AT, "side", 2).select("event_id", "turned")


SQL["turn_zones"] = f"""WITH s AS (SELECT *, event_id % 3 = 0 AS side FROM events), c AS (SELECT *, CASE WHEN side <> lag(side) {O} THEN 1 ELSE 0 END AS df FROM s)
SELECT event_id, max(df) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS turned FROM c"""


def curve_geometry(spark, d):
    e = series.positioned(_events(spark, d), K, AT).withColumn("x", F.col("i") * 1.0)
    made = profile.arc_length(profile.curvature(e, K, ["i"], "x", "value"), K, ["i"], "x", "value")
    return rounded(made.select("event_id", "curvature", "arc"))


_MID = "(coalesce(lead({0}) {1}, {0}) - coalesce(lag({0}) {1}, {0})) / nullif((CASE WHEN lead({0}) {1} IS NULL THEN 0 ELSE 1 END) + (CASE WHEN lag({0}) {1} IS NULL THEN 0 ELSE 1 END), 0)"
_BY = "OVER (PARTITION BY user_id ORDER BY i)"
SQL["curve_geometry"] = f"""WITH p AS (SELECT event_id, user_id, CAST(row_number() {O} - 1 AS DOUBLE) AS i, value AS y FROM events), d AS (SELECT *, {_MID.format("i", _BY)} AS dx, {_MID.format("y", _BY)} AS dy FROM p),
dd AS (SELECT *, {_MID.format("dx", _BY)} AS ddx, {_MID.format("dy", _BY)} AS ddy, coalesce(sqrt(power(i - lag(i) {_BY}, 2) + power(y - lag(y) {_BY}, 2)), 0) AS step FROM d)
SELECT event_id, round(CASE WHEN dx * dx + dy * dy > 0 THEN (dx * ddy - dy * ddx) / power(dx * dx + dy * dy, 1.5) END, 6) AS curvature, round(sum(step) {_DOWN}, 6) AS arc FROM dd"""


def polygon_area(spark, d):
    return rounded(profile.shoelace(_events(spark, d).withColumn("x", (F.col("event_id") % 17) * 1.0), K, AT, "x", "value"))


SQL["polygon_area"] = f"""WITH p AS (SELECT user_id, CAST(event_id % 17 AS DOUBLE) AS x, value AS y, coalesce(lead(CAST(event_id % 17 AS DOUBLE)) {O}, first_value(CAST(event_id % 17 AS DOUBLE)) {O}) AS nx, coalesce(lead(value) {O}, first_value(value) {O}) AS ny FROM events)
SELECT user_id, round(sum(x * ny - nx * y) / 2, 6) AS area, count(*) AS n_points FROM p GROUP BY user_id"""


def thickness_flags(spark, d):
    e = _events(spark, d).select("user_id", "event_id", F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("t"), (F.col("event_id") % 5 == 0).alias("near_branch"), (F.col("event_id") % 29 == 0).alias("opening"), (F.col("event_id") % 31 == 0).alias("no_data"))
    made = profile.thickness_flags(e, K, "t")
    return profile.counted(made, K, ["too_thick", "too_thin", "at_branch"]).select("event_id", "too_thick", "too_thin", "at_branch", "thickened", "counted")


SQL["thickness_flags"] = """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 13 <> 0 THEN value END AS t, event_id % 5 = 0 AS near, event_id % 29 = 0 AS opening, event_id % 31 = 0 AS nd FROM events),
m AS (SELECT *, median(t) OVER (PARTITION BY user_id) AS md FROM e), f AS (SELECT *, NOT coalesce(t < 4 * md, false) AS too_thick, NOT coalesce(t > 0.35 * md, false) AS too_thin, coalesce(t > 1.5 * md, false) AS wide FROM m),
g AS (SELECT *, ((too_thick OR wide) AND near AND NOT nd) OR (opening AND NOT nd) AS at_branch, too_thick AND NOT near AND NOT nd AS thickened FROM f), h AS (SELECT *, NOT (too_thick OR too_thin OR at_branch OR nd) AS c FROM g)
SELECT event_id, too_thick, too_thin, at_branch, thickened, c OR NOT bool_or(c) OVER (PARTITION BY user_id) AS counted FROM h"""


def profile_totals(spark, d):
    return rounded(profile.profile_totals(_events(spark, d), K, 0.5, "high", {"total": "value", "part": "sparse"}, {"middle": "value"}))


SQL["profile_totals"] = f"""WITH {E}, s AS (SELECT user_id, count(*) FILTER (high) * 0.5 AS length, avg(CASE WHEN high THEN 1.0 ELSE 0.0 END) AS counted_share, coalesce(sum(value) FILTER (high), 0) * 0.5 AS total, coalesce(sum(sparse) FILTER (high), 0) * 0.5 AS part, median(value) FILTER (high) AS middle FROM e GROUP BY user_id)
SELECT user_id, CAST(length AS DOUBLE) AS length, round(counted_share, 6) AS counted_share, round(total, 6) AS total, round(part, 6) AS part, round(middle, 6) AS middle, round(total / greatest(CAST(length AS DOUBLE), 1e-9), 6) AS total_per_length, round(part / greatest(CAST(length AS DOUBLE), 1e-9), 6) AS part_per_length FROM s"""


def line_integrals(spark, d):
    e = _events(spark, d).withColumn("jac", 1 + F.col("event_id") % 3)
    return rounded(profile.line_integral(e, K, "value", "jac", "high", 0.25))


SQL["line_integrals"] = "SELECT user_id, round(sum(CASE WHEN value > 150 THEN value * (1 + event_id % 3) END) * 0.25, 6) AS integral, round(sum(CASE WHEN value > 150 THEN CAST(1 + event_id % 3 AS DOUBLE) END) * 0.25, 6) AS area_per_length FROM events GROUP BY user_id"


def wall_edges(spark, d):
    e = series.positioned(_events(spark, d), K, AT)
    return rounded(profile.first_crossing(e, K, "i", "value", 150.0, 3))


SQL["wall_edges"] = f"""WITH {E}, h AS (SELECT user_id, i - 1 AS i, value, max(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS mx, lag(value) OVER (PARTITION BY user_id ORDER BY i) AS lv FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS r FROM h WHERE mx < 150)
SELECT user_id, round(CASE WHEN lv IS NULL THEN i WHEN lv - value > 0 THEN i - 1 + (lv - 150) / (lv - value) ELSE i END, 6) AS edge FROM f WHERE r = 1"""


def radial_variation(spark, d):
    e = series.positioned(_events(spark, d), K, AT)
    return rounded(profile.radial_variation(e, K, "i", "value", 2))


SQL["radial_variation"] = f"""WITH {E}, s AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM e), t AS (SELECT * FROM s WHERE n > 1 AND CAST(i - 1 AS DOUBLE) / (n - 1) BETWEEN 0.15 AND 0.85)
SELECT user_id, round(stddev_pop(sm) / avg(sm), 6) AS variation, round(stddev_pop(value - sm) / avg(sm), 6) AS contrast FROM t GROUP BY user_id"""


def noise_band(spark, d):
    return rounded(series.noise_band(_events(spark, d), K, AT, "value"))


SQL["noise_band"] = f"""WITH {E}, w AS (SELECT *, greatest(5, n // 20) AS win FROM e WHERE n >= 10), b AS (SELECT *, (i - 1) // win AS bucket, (i - 1) % win AS j FROM w), f AS (SELECT * FROM b WHERE (bucket + 1) * win <= n),
l AS (SELECT *, max(CASE WHEN j = 0 THEN value END) OVER (PARTITION BY user_id, bucket) AS v0, max(CASE WHEN j = win - 1 THEN value END) OVER (PARTITION BY user_id, bucket) AS v1 FROM f),
r AS (SELECT user_id, bucket, max(value - (v0 + (v1 - v0) * j / (win - 1))) - min(value - (v0 + (v1 - v0) * j / (win - 1))) AS s FROM l GROUP BY user_id, bucket), m AS (SELECT user_id, median(s) AS noise FROM r GROUP BY user_id)
SELECT u.user_id, round(coalesce(noise, 0), 6) AS noise FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN m ON u.user_id = m.user_id"""


def minmax_thin(spark, d):
    return series.thin(_events(spark, d).select("user_id", "ts", "event_id", "value"), K, AT, "value", cap=8).select("user_id", F.col("i").cast("long"), "event_id")


SQL["minmax_thin"] = f"""WITH {E}, b AS (SELECT *, CAST(floor((i - 1) / ceil(n / 4.0)) AS BIGINT) AS bucket FROM e WHERE n > 8),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY value, i) AS lo, row_number() OVER (PARTITION BY user_id, bucket ORDER BY value DESC, i) AS hi FROM b)
SELECT user_id, i - 1 AS i, event_id FROM e WHERE n <= 8 UNION ALL SELECT user_id, i - 1, event_id FROM r WHERE lo = 1 UNION ALL SELECT user_id, i - 1, event_id FROM r WHERE hi = 1"""


def peaks(spark, d):
    e = series.positioned(_events(spark, d), K, AT)
    return rounded(series.peaks(e.select("user_id", "i", "value"), K, "i", "value"))


def histogram_shares(spark, d):
    return rounded(series.histogram(table(spark, d, "events"), "event_type", "value"))


SQL["histogram_shares"] = """WITH s AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
w AS (SELECT *, hi - lo AS span, CASE WHEN q3 > q1 THEN least(2 * (q3 - q1) / power(n, 1.0 / 3), (hi - lo) / (log2(n) + 1)) ELSE (hi - lo) / (log2(n) + 1) END AS width FROM s),
b AS (SELECT *, greatest(1, least(30, CAST(ceil(span / width) AS INTEGER))) AS bins FROM w), g AS (SELECT event_type, least(bins - 1, CAST(floor((value - lo) / (span / bins)) AS INTEGER)) AS bin, lo, span / bins AS step FROM events, b)
SELECT event_type, bin, round(min(lo + bin * step), 6) AS low, round(min(lo + (bin + 1) * step), 6) AS high, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share FROM g GROUP BY event_type, bin"""


def psth_rates(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", ((_millis() % 3_600_000) / 1.0).alias("t"))
    return rounded(series.event_rates(e, "event_type", "user_id", "t", 300_000.0).select("event_type", F.col("bin").cast("long"), "start", "events", "rate"))


SQL["psth_rates"] = """WITH e AS (SELECT event_type, user_id, CAST(epoch_ms(ts) % 3600000 AS DOUBLE) AS t FROM events), k AS (SELECT event_type, count(DISTINCT user_id) AS trials FROM e GROUP BY event_type)
SELECT e.event_type, CAST(floor(t / 300000) AS BIGINT) AS bin, floor(t / 300000) * 300000.0 AS start, count(*) AS events, round(count(*) / CAST(min(trials) AS DOUBLE) / 300, 6) AS rate FROM e JOIN k ON e.event_type = k.event_type GROUP BY e.event_type, floor(t / 300000)"""


def mad_by_group(spark, d):
    return rounded(series.median_mad(table(spark, d, "events"), ["event_type"], "value"))


SQL["mad_by_group"] = "WITH m AS (SELECT event_type, value, median(value) OVER (PARTITION BY event_type) AS md FROM events) SELECT event_type, round(max(md), 6) AS median, round(1.4826 * median(abs(value - md)), 6) AS mad FROM m GROUP BY event_type"


def weighted_median(spark, d):
    return rounded(series.weighted_median(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity"))


SQL["weighted_median"] = """WITH r AS (SELECT l_returnflag, l_discount, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_discount RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS t FROM lineitem)
SELECT l_returnflag, round(min(l_discount), 6) AS weighted_median FROM r WHERE run >= t / 2 GROUP BY l_returnflag"""


def guarded_correlation(spark, d):
    return rounded(table(spark, d, "lineitem").groupBy("l_returnflag").agg(series.guarded_corr("l_quantity", "l_extendedprice").alias("r")))


SQL["guarded_correlation"] = "SELECT l_returnflag, round(CASE WHEN count(*) >= 20 THEN corr(l_quantity, l_extendedprice) END, 6) AS r FROM lineitem GROUP BY l_returnflag"


def active_span(spark, d):
    e = table(spark, d, "events").groupBy(F.floor(_millis() / 3_600_000).alias("hour")).agg((F.max("value") - F.min("value")).alias("spread"))
    return series.active_span(e, "hour", "spread")


SQL["active_span"] = """WITH e AS (SELECT CAST(floor(epoch_ms(ts) / 3600000.0) AS BIGINT) AS hour, max(value) - min(value) AS spread FROM events GROUP BY 1), m AS (SELECT median(spread) AS m, max(spread) AS t FROM e), a AS (SELECT median(abs(spread - m)) AS mad FROM e, m)
SELECT min(hour) AS first, max(hour) AS last, count(*) AS n FROM e, m, a WHERE spread > greatest(m + 3 * 1.4826 * mad, m + 0.03 * (t - m))"""

QUERIES = {f.__name__: f for f in (running_ratio, cumulative_columns, runs_and_segments, long_runs, long_runs_closed, interpolate_gaps, rolling_despike, despiked_profiles, turn_zones, curve_geometry, polygon_area, thickness_flags, profile_totals, line_integrals, wall_edges, radial_variation, noise_band, minmax_thin, peaks, histogram_shares, psth_rates, mad_by_group, weighted_median, guarded_correlation, active_span)}
