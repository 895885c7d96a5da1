"""Series and feature queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinegrid.functions import series as fs
from kinegrid.operators.features import aggregate, summary_features
from kinegrid.plans.prelude import FEATURES, SERIES, TRACK, sql
from kinegrid.registry import query
from kinegrid.sources import adapters as ad


def r6(name: str, column=None):
    return F.round(F.col(name) if column is None else column, 6).alias(name)


_NAMES = "max_speed mean_speed min_accel max_accel mean_accel max_abs_yaw_rate signed_max_yaw_rate max_abs_jerk p95_abs_jerk mean_abs_jerk max_lateral_accel total_heading_change".split()


@query("T01_uniform_grid", sql(TRACK, select="""
SELECT clip_id, n, round(dt, 6) AS dt FROM (SELECT clip_id, ceil((max(ts) - min(ts)) * 0.001::DOUBLE)::BIGINT + 1 AS n, (max(ts) - min(ts)) / ceil((max(ts) - min(ts)) * 0.001::DOUBLE) AS dt FROM track GROUP BY clip_id HAVING max(ts) > min(ts))"""))
def t01(spark, d):
    grid = fs.uniform_grid(ad.track(spark, d), hz=0.001)
    return grid.groupBy("clip_id").agg(F.count("*").alias("n"), F.round((F.max("t") - F.min("t")) / (F.count("*") - 1), 6).alias("dt"))


@query("T02_resample", sql(TRACK, select="""
, ends AS (SELECT clip_id, min(ts) AS t0, max(ts) AS t1, ceil((max(ts) - min(ts)) * 0.0001::DOUBLE)::BIGINT + 1 AS n FROM track GROUP BY clip_id HAVING max(ts) > min(ts)),
grid AS (SELECT clip_id, unnest(generate_series(0, n - 1)) AS i, t0, t1, n FROM ends),
timed AS (SELECT clip_id, i, t0 + i * (t1 - t0) / (n - 1) AS t FROM grid),
seg AS (SELECT *, lead(ts) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny, row_number() OVER w = 1 AS f FROM track WINDOW w AS (PARTITION BY clip_id ORDER BY ts)),
ok AS (SELECT *, max(ts) OVER (PARTITION BY clip_id) = ts AS l FROM seg WHERE nt > ts)
SELECT g.clip_id, g.i, round(s.x + (g.t - s.ts) / (s.nt - s.ts) * (s.nx - s.x), 6) AS x, round(s.y + (g.t - s.ts) / (s.nt - s.ts) * (s.ny - s.y), 6) AS y
FROM timed g JOIN ok s ON g.clip_id = s.clip_id AND (g.t >= s.ts OR s.f) AND (g.t < s.nt OR s.l)"""))
def t02(spark, d):
    tracks = ad.track(spark, d)
    return fs.resample(tracks, fs.uniform_grid(tracks, hz=0.0001), ["x", "y"]).select("clip_id", "i", r6("x"), r6("y"))


@query("T03_unwrap", sql(TRACK, select="""
, s AS (SELECT clip_id, k, yaw, yaw - lag(yaw) OVER (PARTITION BY clip_id ORDER BY k) AS dd FROM track),
c AS (SELECT *, dd - 2 * pi() * floor((dd + pi()) / (2 * pi())) AS wr FROM s),
a AS (SELECT *, coalesce(CASE WHEN abs(dd) < pi() THEN 0.0 ELSE (CASE WHEN wr = -pi() AND dd > 0 THEN pi() ELSE wr END) - dd END, 0.0) AS turn FROM c)
SELECT clip_id, k, round(yaw + sum(turn) OVER (PARTITION BY clip_id ORDER BY k ROWS UNBOUNDED PRECEDING), 6) AS yaw FROM a"""))
def t03(spark, d):
    return fs.with_unwrapped(ad.track(spark, d), "yaw", "flat", "k").select("clip_id", "k", r6("yaw", F.col("flat")))


_NEAR = "coalesce(lead({0}) OVER w, {0}) - coalesce(lag({0}) OVER w, {0})"


@query("T04_planar_speed", sql(TRACK, select=f"""
SELECT clip_id, k, round(CASE WHEN {_NEAR.format("ts")} > 0 THEN sqrt(pow(({_NEAR.format("x")}) / ({_NEAR.format("ts")}), 2) + pow(({_NEAR.format("y")}) / ({_NEAR.format("ts")}), 2)) ELSE 0 END, 6) AS speed
FROM track WINDOW w AS (PARTITION BY clip_id ORDER BY k)"""))
def t04(spark, d):
    return ad.track(spark, d).select("clip_id", "k", r6("speed", fs.planar_speed("x", "y", "ts", "k")))


@query("T05_central_differences", sql(SERIES, select=f"""
SELECT clip_id, i, round(({_NEAR.format("speed")}) / ({_NEAR.format("t")}), 6) AS d_speed, round(({_NEAR.format("accel")}) / ({_NEAR.format("t")}), 6) AS d_accel FROM series WINDOW w AS (PARTITION BY clip_id ORDER BY i)"""))
def t05(spark, d):
    return ad.series(spark, d).select("clip_id", "i", r6("d_speed", fs.central_difference("speed")), r6("d_accel", fs.central_difference("accel")))


@query("T06_smooth", sql(SERIES, select="""
, m AS (SELECT a.clip_id, a.i, sum(CASE WHEN o = 0 THEN 17.0::DOUBLE WHEN abs(o) = 1 THEN 12.0 ELSE -3.0 END * b.accel) / 35 AS v
FROM series a CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) q(o) JOIN series b ON a.clip_id = b.clip_id AND b.i = CASE WHEN abs(a.i + o) >= 64 THEN 126 - abs(a.i + o) ELSE abs(a.i + o) END GROUP BY a.clip_id, a.i)
SELECT clip_id, i, round(v, 6) AS accel FROM m"""))
def t06(spark, d):
    whole = ad.series(spark, d).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("i", "accel"))).alias("s"))
    return whole.select("clip_id", F.posexplode(fs.smooth(F.col("s.accel"))).alias("i", "accel")).select("clip_id", F.col("i").cast("long").alias("i"), r6("accel"))


def _smooth_sql(name: str, of: str, column: str) -> str:
    return f"""{name} AS (SELECT a.clip_id, a.i, sum(CASE WHEN o = 0 THEN 17.0::DOUBLE WHEN abs(o) = 1 THEN 12.0 ELSE -3.0 END * b.{column}) / 35 AS v
FROM {of} a CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) q(o) JOIN {of} b ON a.clip_id = b.clip_id AND b.i = CASE WHEN abs(a.i + o) >= 64 THEN 126 - abs(a.i + o) ELSE abs(a.i + o) END GROUP BY a.clip_id, a.i)"""


def _slope_sql(name: str, of: str) -> str:
    return f"{name} AS (SELECT clip_id, i, ({_NEAR.format('v')}) / ({_NEAR.format('i * 0.1::DOUBLE')}) AS v FROM {of} WINDOW w AS (PARTITION BY clip_id ORDER BY i))"


_CHAIN = [_smooth_sql("speeds", "series", "speed"), _slope_sql("d1", "speeds"), _smooth_sql("accels", "d1", "v"), _slope_sql("d2", "accels"), _smooth_sql("jerks", "d2", "v")]


@query("T07_derive_chain", sql(SERIES, *_CHAIN, select="""
SELECT s.clip_id, s.i, round(s.i * 0.1::DOUBLE, 6) AS t, round(s.v, 6) + 0 AS speed, round(a.v, 6) + 0 AS accel, round(j.v, 6) + 0 AS jerk
FROM speeds s JOIN accels a ON s.clip_id = a.clip_id AND s.i = a.i JOIN jerks j ON s.clip_id = j.clip_id AND s.i = j.i"""))
def t07(spark, d):
    """Speed, smoothed; its slope, smoothed; the slope's slope, smoothed."""
    whole = ad.series(spark, d).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("i", "t", "speed"))).alias("s"))

    made = whole.withColumn("t", F.col("s.t")).withColumn("speed", fs.smooth(F.col("s.speed")))
    made = made.withColumn("accel", fs.smooth(fs.slopes(F.col("speed"), F.col("t"))))
    made = made.withColumn("jerk", fs.smooth(fs.slopes(F.col("accel"), F.col("t"))))
    return made.select("clip_id", F.posexplode(F.arrays_zip("t", "speed", "accel", "jerk")).alias("i", "p")).select("clip_id", F.col("i").cast("long").alias("i"), *[r6(c, F.col(f"p.{c}")) for c in ("t", "speed", "accel", "jerk")])


@query("T08_overlapping_windows", sql(SERIES, select="""
SELECT clip_id, w, round(avg(speed), 6) AS mean_speed FROM (SELECT clip_id, w, speed, count(*) OVER (PARTITION BY clip_id, w) AS n FROM series, unnest(CASE WHEN i % 30 = 0 AND i > 0 THEN [i // 30, i // 30 - 1] ELSE [i // 30] END) u(w)) WHERE n = 31 GROUP BY clip_id, w"""))
def t08(spark, d):
    return fs.overlapping_windows(ad.series(spark, d), 31).groupBy("clip_id", F.col("w").cast("long").alias("w")).agg(r6("mean_speed", F.avg("speed")))


@query("T09_frame_ranges", "SELECT part.p_partkey AS clip_id, (p_size % 5) * 30 AS first_frame, (p_size % 5) * 30 + 31 AS end_frame FROM part")
def t09(spark, d):
    w = F.col("p_size") % 5
    return ad.table(spark, d, "part").select(F.col("p_partkey").alias("clip_id"), (w * 30).alias("first_frame"), (w * 30 + 31).alias("end_frame"))


@query("T10_quaternion_yaw", """WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS e FROM embeddings),
n AS (SELECT vec_id, a / l AS w, b / l AS x, c / l AS y, e / l AS z FROM (SELECT *, sqrt(a * a + b * b + c * c + e * e) AS l FROM q)) SELECT vec_id AS clip_id, round(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)), 6) AS yaw FROM n""")
def t10(spark, d):
    e = F.col("embedding").cast("array<double>")
    parts = [F.element_at(e, k) for k in (1, 2, 3, 4)]
    length = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    return ad.table(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), r6("yaw", fs.yaw_of(*[p / length for p in parts])))


@query("T11_even_picks", """WITH p AS (SELECT p_partkey, p_size AS n, unnest(CASE WHEN p_size <= 8 THEN generate_series(0, p_size - 1) ELSE list_transform(generate_series(0, 7), lambda k: round_even(k * (p_size - 1) / 7.0::DOUBLE, 0)::BIGINT) END) AS pick FROM part WHERE p_size > 0)
SELECT p_partkey AS clip_id, pick::BIGINT AS pick FROM p""")
def t11(spark, d):
    return ad.table(spark, d, "part").where("p_size > 0").select(F.col("p_partkey").alias("clip_id"), F.explode(fs.even_picks(F.col("p_size"), 8)).alias("pick"))


@query("T12_normalise_track", sql(TRACK, select="""
SELECT clip_id, k, round((x - x0) * cos(-a) - (y - y0) * sin(-a), 6) + 0 AS x, round((x - x0) * sin(-a) + (y - y0) * cos(-a), 6) + 0 AS y FROM (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, first_value(yaw) OVER w AS a FROM track WINDOW w AS (PARTITION BY clip_id ORDER BY k))"""))
def t12(spark, d):
    w = fs.clip_window("k")
    x, y, a = F.col("x") - F.first("x").over(w), F.col("y") - F.first("y").over(w), -F.first("yaw").over(w)
    return ad.track(spark, d).select("clip_id", "k", F.round(x * F.cos(a) - y * F.sin(a), 6).alias("x"), F.round(x * F.sin(a) + y * F.cos(a), 6).alias("y"))


@query("T13_end_point", sql(TRACK, select="""
SELECT clip_id, round(sqrt(pow(arg_max(x, k) - arg_min(x, k), 2) + pow(arg_max(y, k) - arg_min(y, k), 2)), 6) AS distance FROM track GROUP BY clip_id"""))
def t13(spark, d):
    g = ad.track(spark, d).groupBy("clip_id")
    return g.agg(r6("distance", F.hypot(F.max_by("x", "k") - F.min_by("x", "k"), F.max_by("y", "k") - F.min_by("y", "k"))))


@query("T14_lateral_accel", sql(SERIES, select="SELECT clip_id, i, round(speed * abs(yaw_rate), 6) AS lateral, round(speed * yaw_rate, 6) + 0 AS lateral_signed FROM series"))
def t14(spark, d):
    return ad.series(spark, d).select("clip_id", "i", r6("lateral", F.col("speed") * F.abs("yaw_rate")), r6("lateral_signed", F.col("speed") * F.col("yaw_rate")))


@query("T15_heading_change", sql(TRACK, select="SELECT clip_id, round(coalesce(sum(abs(s)), 0), 6) AS heading_change FROM (SELECT clip_id, yaw - lag(yaw) OVER (PARTITION BY clip_id ORDER BY k) AS s FROM track) GROUP BY clip_id"))
def t15(spark, d):
    step = F.col("yaw") - F.lag("yaw").over(fs.clip_window("k"))
    return ad.track(spark, d).withColumn("s", step).groupBy("clip_id").agg(r6("heading_change", F.coalesce(F.sum(F.abs("s")), F.lit(0.0))))


@query("T16_viewer_series", sql(SERIES, select="SELECT clip_id, string_agg((round(speed, 4) * 10000)::BIGINT::VARCHAR, ',' ORDER BY i) AS speed FROM series GROUP BY clip_id"))
def t16(spark, d):
    whole = ad.series(spark, d).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("i", "speed"))).alias("s"))
    return whole.select("clip_id", F.array_join(F.transform("s.speed", lambda v: (F.round(v, 4) * 10000).cast("decimal(20,0)").cast("string")), ",").alias("speed"))


@query("T17_slope", sql(SERIES, select="SELECT clip_id, round(regr_slope(speed, i), 6) AS slope FROM series GROUP BY clip_id HAVING count(*) >= 3"))
def t17(spark, d):
    return ad.series(spark, d).groupBy("clip_id").agg(r6("slope", F.regr_slope("speed", "i")), F.count("*").alias("n")).where("n >= 3").drop("n")


@query("T18_peak_index", sql(SERIES, select="SELECT clip_id, arg_min(i, i) AS peak FROM (SELECT *, max(speed) OVER (PARTITION BY clip_id) AS m FROM series) WHERE speed = m GROUP BY clip_id"))
def t18(spark, d):
    return ad.series(spark, d).groupBy("clip_id").agg(F.max_by("i", F.struct("speed", -F.col("i"))).alias("peak"))


@query("T19_window_features", sql(SERIES, select="""
SELECT clip_id, w, round((count(*) - 1) * 0.1, 6) AS duration_s, round(max(speed), 6) AS max_speed, round(min(accel), 6) AS min_accel FROM (SELECT *, count(*) OVER (PARTITION BY clip_id, w) AS n FROM series, unnest(CASE WHEN i % 30 = 0 AND i > 0 THEN [i // 30, i // 30 - 1] ELSE [i // 30] END) u(w)) WHERE n = 31 GROUP BY clip_id, w"""))
def t19(spark, d):
    g = fs.overlapping_windows(ad.series(spark, d), 31).groupBy("clip_id", F.col("w").cast("long").alias("w"))
    return g.agg(r6("duration_s", (F.count("*") - 1) * 0.1), r6("max_speed", F.max("speed")), r6("min_accel", F.min("accel")))


_HOWS = ("mean", "min", "max", "rms", "abs_max", "max_abs", "p75")


@query("A01_aggregations", sql(SERIES, select="""
, o AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY abs(accel) DESC, i) AS k FROM series)
SELECT clip_id, round(avg(accel), 6) AS mean, round(min(accel), 6) AS min, round(max(accel), 6) AS max, round(sqrt(avg(accel * accel)), 6) AS rms, round(max(CASE WHEN k = 1 THEN accel END), 6) AS abs_max, round(max(abs(accel)), 6) AS max_abs, round(quantile_cont(accel, 0.75), 6) AS p75 FROM o GROUP BY clip_id"""))
def a01(spark, d):
    return ad.series(spark, d).groupBy("clip_id").agg(*[r6(h, aggregate(F.col("accel"), h)) for h in _HOWS])


@query("A02_summary_features", sql(FEATURES, select="SELECT clip_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NAMES) + " FROM features"))
def a02(spark, d):
    return summary_features(ad.series(spark, d)).select("clip_id", *[r6(c) for c in _NAMES])


@query("W02_running_sum", sql(SERIES, select="SELECT clip_id, i, round(sum(yaw_rate) OVER (PARTITION BY clip_id ORDER BY i ROWS UNBOUNDED PRECEDING) * 0.1, 6) AS yaw FROM series"))
def w02(spark, d):
    w = fs.clip_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ad.series(spark, d).select("clip_id", "i", r6("yaw", F.sum("yaw_rate").over(w) * 0.1))


@query("W03_five_row_mean", sql(SERIES, select="SELECT clip_id, i, round(avg(speed) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean_5 FROM series"))
def w03(spark, d):
    return ad.series(spark, d).select("clip_id", "i", r6("mean_5", F.avg("speed").over(fs.clip_window().rowsBetween(-2, 2))))
