"""Labelling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinegrid.operators import rules
from kinegrid.operators.features import summary_features
from kinegrid.operators.labelling import label_clips
from kinegrid.plans.prelude import ANSWERS, FEATURES, SERIES, sql
from kinegrid.registry import FLAGSHIP, query, sql_of
from kinegrid.sources import adapters as ad

BRAKING = ([-3.3, -2.9, -2.6], ["emergency", "moderate", "low", "none"])
_BRAKE_CASE = "CASE WHEN min_accel < -3.3 THEN 'emergency' WHEN min_accel < -2.9 THEN 'moderate' WHEN min_accel < -2.6 THEN 'low' ELSE 'none' END"


def r6(name: str, column=None):
    return F.round(F.col(name) if column is None else column, 6).alias(name)


def features(spark, d):
    return summary_features(ad.series(spark, d))


@query(FLAGSHIP, sql(FEATURES, select=f"SELECT answer, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS fraction FROM (SELECT {_BRAKE_CASE} AS answer FROM features) GROUP BY answer"))
def flagship(spark, d):
    labels = rules.multi_threshold(features(spark, d), "min_accel", *BRAKING)
    counts = labels.groupBy("answer").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("answer", "n", r6("fraction", F.col("n") / F.col("_all")))


_PEAK = "CASE WHEN k = 1 THEN yaw_rate END"


@query("L01_yaw_rate_sign", sql(FEATURES, select="SELECT clip_id, round(signed_max_yaw_rate, 6) AS value, CASE WHEN signed_max_yaw_rate > 0.14 THEN 'left' WHEN signed_max_yaw_rate < -0.14 THEN 'right' ELSE 'straight' END AS answer FROM features"))
def l01(spark, d):
    return rules.yaw_rate_sign(ad.series(spark, d), positive=0.14, negative=-0.14).select("clip_id", r6("value"), "answer")


@query("L02_threshold_event", sql(SERIES, select="SELECT clip_id, round(min(accel), 6) AS value, CASE WHEN min(accel) < -3.0 THEN 'yes' ELSE 'no' END AS answer FROM series GROUP BY clip_id"))
def l02(spark, d):
    return rules.threshold_event(ad.series(spark, d), "accel", "less_than", -3.0).select("clip_id", r6("value"), "answer")


@query("L03_or_threshold_event", sql(SERIES, select="SELECT clip_id, CASE WHEN max(jerk) > 6.5 OR min(accel) < -3.2 THEN 'aggressive' ELSE 'normal' END AS answer FROM series GROUP BY clip_id"))
def l03(spark, d):
    conditions = [{"signal": "jerk", "operator": "greater_than", "threshold": 6.5}, {"signal": "accel", "operator": "less_than", "threshold": -3.2, "how": "min"}]
    return rules.or_threshold_event(ad.series(spark, d), conditions, "aggressive", "normal").select("clip_id", "answer")


@query("L04_feature_conversion", sql(FEATURES, select="SELECT clip_id, round(max_speed * 3.6, 2) AS answer FROM features"))
def l04(spark, d):
    return rules.feature_conversion(features(spark, d), "max_speed", 3.6, 2).select("clip_id", "answer")


@query("L05_threshold_classification", sql(FEATURES, select="SELECT clip_id, CASE WHEN mean_speed < 4.0 THEN 'below' ELSE 'above' END AS answer FROM features"))
def l05(spark, d):
    return rules.threshold_classification(features(spark, d), "mean_speed", 4.0, "below", "above").select("clip_id", "answer")


@query("L06_trend", sql(SERIES, select="SELECT clip_id, CASE WHEN avg(accel) > 0.05 THEN 'accelerating' WHEN avg(accel) < -0.05 THEN 'decelerating' ELSE 'steady' END AS answer FROM series GROUP BY clip_id"))
def l06(spark, d):
    return rules.trend(ad.series(spark, d), dead=0.05).select("clip_id", "answer")


@query("L07_range_check", sql(FEATURES, select="SELECT clip_id, CASE WHEN max_speed BETWEEN 10 AND 13 THEN 'yes' ELSE 'no' END AS answer FROM features"))
def l07(spark, d):
    return rules.range_check(features(spark, d), "max_speed", 10.0, 13.0).select("clip_id", "answer")


@query("L08_dominant_axis", sql(SERIES, select="""
, m AS (SELECT clip_id, sqrt(avg(accel * accel)) AS a, sqrt(avg(pow(speed * abs(yaw_rate), 2))) AS l FROM series GROUP BY clip_id)
SELECT clip_id, round(a, 6) AS longitudinal, round(l, 6) AS lateral, CASE WHEN a < 0.2 AND l < 0.2 THEN 'none' WHEN a < 1e-9 THEN 'lateral' WHEN l / a > 0.25 THEN 'lateral' ELSE 'longitudinal' END AS answer FROM m"""))
def l08(spark, d):
    return rules.dominant_axis(ad.series(spark, d), ratio=0.25).select("clip_id", r6("longitudinal"), r6("lateral"), "answer")


@query("L09_lateral_threshold", sql(FEATURES, select="SELECT clip_id, round(max_lateral_accel, 6) AS value, CASE WHEN max_lateral_accel > 1.0 THEN 'yes' ELSE 'no' END AS answer FROM features"))
def l09(spark, d):
    return rules.lateral_threshold(ad.series(spark, d), 1.0).select("clip_id", r6("value"), "answer")


@query("L10_sequential_event", sql(SERIES, select="""
, p AS (SELECT a.clip_id, min(a.t) AS t1, arg_min(b.t, a.t * 1e6 + b.t) - min(a.t) AS gap FROM series a JOIN series b ON a.clip_id = b.clip_id AND b.t BETWEEN a.t + 1e-6 AND a.t + 0.45 WHERE a.accel < -2.5 AND abs(b.yaw_rate) > 0.13 GROUP BY a.clip_id)
SELECT c.clip_id, round(t1, 6) AS first_t, round(gap, 6) AS gap, CASE WHEN p.clip_id IS NULL THEN 'no' ELSE 'yes' END AS answer FROM (SELECT DISTINCT clip_id FROM series) c LEFT JOIN p ON c.clip_id = p.clip_id"""))
def l10(spark, d):
    found = rules.sequential_event(ad.series(spark, d), {"signal": "accel", "operator": "less_than", "threshold": -2.5}, {"signal": "yaw_rate", "operator": "abs_greater_than", "threshold": 0.13}, (0.0, 0.45))
    return found.select("clip_id", r6("first_t"), r6("gap"), "answer")


@query("L11_peak_half", sql(SERIES, select="""
, m AS (SELECT clip_id, max(speed) AS p, avg(speed) AS a, count(*) AS n FROM series GROUP BY clip_id), k AS (SELECT s.clip_id, min(i) AS peak_i FROM series s JOIN m ON s.clip_id = m.clip_id AND s.speed = m.p GROUP BY s.clip_id)
SELECT m.clip_id, CASE WHEN (p - a) / abs(a) < 0.05 OR p < 11 THEN 'no_peak' WHEN peak_i < n // 2 THEN 'first_half' ELSE 'second_half' END AS answer FROM m JOIN k ON m.clip_id = k.clip_id"""))
def l11(spark, d):
    return rules.peak_half(ad.series(spark, d), least=11.0).select("clip_id", "answer")


@query("L12_stop_and_go", sql(SERIES, select="""
, e AS (SELECT clip_id, i, speed > 6 AS go FROM series WHERE speed < 1 OR speed > 6), c AS (SELECT clip_id, go AND NOT coalesce(lag(go) OVER (PARTITION BY clip_id ORDER BY i), TRUE) AS cyc FROM e)
SELECT s.clip_id, coalesce(sum(cyc::INT), 0)::BIGINT AS cycles, CASE WHEN coalesce(sum(cyc::INT), 0) >= 5 THEN 'yes' ELSE 'no' END AS answer FROM (SELECT DISTINCT clip_id FROM series) s LEFT JOIN c ON s.clip_id = c.clip_id GROUP BY s.clip_id"""))
def l12(spark, d):
    return rules.stop_and_go(ad.series(spark, d), stop=1.0, go=6.0, least=5).select("clip_id", "cycles", "answer")


@query("L13_half_comparison", sql(SERIES, select="""
, m AS (SELECT clip_id, sqrt(avg(CASE WHEN i < 32 THEN accel * accel END)) AS a, sqrt(avg(CASE WHEN i >= 32 THEN accel * accel END)) AS b FROM series GROUP BY clip_id)
SELECT clip_id, round(a, 6) AS first, round(b, 6) AS second, CASE WHEN greatest(a, b) < 1e-9 OR abs(a - b) / greatest(a, b) < 0.2 THEN 'similar' WHEN a > b THEN 'first_half' ELSE 'second_half' END AS answer FROM m"""))
def l13(spark, d):
    return rules.half_comparison(ad.series(spark, d)).select("clip_id", r6("first"), r6("second"), "answer")


@query("L14_multi_threshold", sql(FEATURES, select=f"SELECT clip_id, round(min_accel, 6) AS value, {_BRAKE_CASE} AS answer FROM features"))
def l14(spark, d):
    return rules.multi_threshold(features(spark, d), "min_accel", *BRAKING).select("clip_id", r6("value"), "answer")


@query("L15_answer_in_choices", sql(FEATURES, select=f"SELECT count(*) AS n, count(*) FILTER (WHERE {_BRAKE_CASE} NOT IN ('emergency', 'none')) AS rejected FROM features"))
def l15(spark, d):
    out = rules.apply_rule("multi_threshold_classification", features(spark, d), ["emergency", "none"], feature="min_accel", thresholds=BRAKING[0], labels=BRAKING[1])
    return out.agg(F.count("*").alias("n"), F.count_if("rejected").alias("rejected"))


@query("L16_proxy_labels", sql(FEATURES, select="""
SELECT clip_id, CASE WHEN max_abs_jerk <= 6.0 THEN 'smooth' ELSE 'rough' END AS smoothness, CASE WHEN abs(signed_max_yaw_rate) < 0.14 THEN 'straight' WHEN signed_max_yaw_rate > 0 THEN 'left' ELSE 'right' END AS direction,
CASE WHEN sqrt(min_accel * min_accel + max_accel * max_accel) < 0.5 AND max_lateral_accel < 0.5 THEN 'none' WHEN max_lateral_accel > sqrt(min_accel * min_accel + max_accel * max_accel) THEN 'lateral' ELSE 'longitudinal' END AS axis FROM features"""))
def l16(spark, d):
    both = F.sqrt(F.col("min_accel") * F.col("min_accel") + F.col("max_accel") * F.col("max_accel"))
    yaw, lateral = F.col("signed_max_yaw_rate"), F.col("max_lateral_accel")
    return features(spark, d).select(
        "clip_id",
        F.when(F.col("max_abs_jerk") <= 6.0, "smooth").otherwise("rough").alias("smoothness"),
        F.when(F.abs(yaw) < 0.14, "straight").when(yaw > 0, "left").otherwise("right").alias("direction"),
        F.when((both < 0.5) & (lateral < 0.5), "none").when(lateral > both, "lateral").otherwise("longitudinal").alias("axis"),
    )


_FACTORS = (0.5, 0.75, 1.0, 1.25, 1.5)


@query("L17_relabel_by_factor", sql(FEATURES, select="""
SELECT clip_id, f AS factor, CASE WHEN min_accel < -3.3 * f THEN 'emergency' WHEN min_accel < -2.9 * f THEN 'moderate' WHEN min_accel < -2.6 * f THEN 'low' ELSE 'none' END AS answer FROM features CROSS JOIN (VALUES (0.5::DOUBLE), (0.75), (1.0), (1.25), (1.5)) q(f)"""))
def l17(spark, d):
    made = features(spark, d).withColumn("factor", F.explode(F.array(*map(F.lit, _FACTORS))))
    return made.select("clip_id", "factor", rules.classify(F.col("min_accel"), [F.lit(t) * F.col("factor") for t in BRAKING[0]], BRAKING[1]).alias("answer"))


@query("L18_clip_tags", sql(ANSWERS, select="SELECT clip_id, bool_or(question_id = 'status' AND answer <> 'O') AS has_turn, bool_or(question_id = 'priority' AND answer = '1-URGENT') AS has_braking, bool_or(question_id = 'price' AND answer = 'high') AS has_aggressive FROM answers GROUP BY clip_id"))
def l18(spark, d):
    q, a = F.col("question_id"), F.col("answer")
    return ad.answers(spark, d).groupBy("clip_id").agg(F.bool_or((q == "status") & (a != "O")).alias("has_turn"), F.bool_or((q == "priority") & (a == "1-URGENT")).alias("has_braking"), F.bool_or((q == "price") & (a == "high")).alias("has_aggressive"))


@query("L19_signal_answers", sql(SERIES, select="""
, g AS (SELECT clip_id, avg(yaw_rate) AS y, regr_slope(speed, i) AS s, count(*) AS n FROM series GROUP BY clip_id)
SELECT clip_id, CASE WHEN n < 3 THEN 'straight' WHEN y > 0.002 THEN 'left' WHEN y < -0.002 THEN 'right' ELSE 'straight' END AS turn, CASE WHEN n < 3 THEN 'steady' WHEN s > 0.01 THEN 'accelerating' WHEN s < -0.01 THEN 'decelerating' ELSE 'steady' END AS trend FROM g"""))
def l19(spark, d):
    g = ad.series(spark, d).groupBy("clip_id").agg(F.avg("yaw_rate").alias("y"), F.regr_slope("speed", "i").alias("s"), F.count("*").alias("n"))
    return g.select("clip_id", F.when(F.col("n") < 3, "straight").when(F.col("y") > 0.002, "left").when(F.col("y") < -0.002, "right").otherwise("straight").alias("turn"), F.when(F.col("n") < 3, "steady").when(F.col("s") > 0.01, "accelerating").when(F.col("s") < -0.01, "decelerating").otherwise("steady").alias("trend"))


@query("F01_comparisons", sql(SERIES, select="SELECT count(*) FILTER (WHERE accel < -2) AS less, count(*) FILTER (WHERE accel > 2) AS greater, count(*) FILTER (WHERE abs(accel) > 2) AS abs_greater FROM series"))
def f01(spark, d):
    a = F.col("accel")
    return ad.series(spark, d).agg(F.count_if(rules.compare(a, "less_than", -2.0)).alias("less"), F.count_if(rules.compare(a, "greater_than", 2.0)).alias("greater"), F.count_if(rules.compare(a, "abs_greater_than", 2.0)).alias("abs_greater"))


@query("F02_category_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def f02(spark, d):
    return ad.table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")


@query("F03_allow_list", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
def f03(spark, d):
    return ad.table(spark, d, "events").where(F.col("event_type").isin("click", "error")).select("event_id")


@query("F04_plausible_clips", sql(FEATURES, select="SELECT clip_id FROM features WHERE greatest(abs(min_accel), abs(max_accel)) <= 0.4 * 9.81 AND max_lateral_accel <= 0.4 * 9.81"))
def f04(spark, d):
    most = 0.4 * 9.81
    return features(spark, d).where((F.greatest(F.abs("min_accel"), F.abs("max_accel")) <= most) & (F.col("max_lateral_accel") <= most)).select("clip_id")


@query("F05_clip_admission", "SELECT user_id AS clip_id FROM events GROUP BY user_id HAVING count(*) >= 60 AND (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 >= 0.9 * 2592000")
def f05(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = ad.table(spark, d, "events").groupBy(F.col("user_id").alias("clip_id")).agg(F.count("*").alias("n"), ((F.max(us) - F.min(us)) / 1e6).alias("span"))
    return g.where((F.col("n") >= 60) & (F.col("span") >= 0.9 * 2592000)).select("clip_id")


@query("F09_skip_patterns", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, 'ring|widget')")
def f09(spark, d):
    return ad.table(spark, d, "part").where(~F.col("p_name").rlike("ring|widget")).select("p_partkey")


@query("F10_id_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00012')")
def f10(spark, d):
    return ad.table(spark, d, "customer").where(F.lower("c_name").contains("00012")).select("c_custkey")


@query("F11_question_text", "SELECT p_partkey, replace(replace('Is {name} above {size}?', '{name}', p_name), '{size}', p_size::VARCHAR) AS question FROM part")
def f11(spark, d):
    return ad.table(spark, d, "part").select("p_partkey", F.replace(F.replace(F.lit("Is {name} above {size}?"), F.lit("{name}"), F.col("p_name")), F.lit("{size}"), F.col("p_size").cast("string")).alias("question"))


@query("F12_scaled_parameters", "SELECT * FROM (VALUES (0.5::DOUBLE, 1.0::DOUBLE, 0.05::DOUBLE), (2.0, 4.0, 0.05)) q(factor, threshold, prominence)")
def f12(spark, d):
    base = {"conditions": [{"threshold": 2.0}], "prominence": 0.05}
    rows = [(f, (p := rules.scaled(base, f))["conditions"][0]["threshold"], p["prominence"]) for f in (0.5, 2.0)]
    return spark.createDataFrame(rows, "factor double, threshold double, prominence double")


@query("F13_evidence_switch", sql(FEATURES, select="SELECT clip_id, CASE WHEN clip_id % 2 = 0 THEN round(min_accel, 6) END AS evidence FROM features"))
def f13(spark, d):
    return features(spark, d).select("clip_id", F.when(F.col("clip_id") % 2 == 0, F.round("min_accel", 6)).alias("evidence"))


def _condition(signal: str, operator: str, threshold: float, **more) -> dict:
    return {"signal": signal, "operator": operator, "threshold": threshold, **more}


#: The fourteen rules as the queries above apply them one by one; the last accepts two of its four classes only.
CONFIGURED = [
    {"id": "L01_yaw_rate_sign", "rule": "yaw_rate_sign_with_deadzone", "params": {"positive": 0.14, "negative": -0.14}},
    {"id": "L02_threshold_event", "rule": "threshold_event", "params": _condition("accel", "less_than", -3.0)},
    {"id": "L03_or_threshold_event", "rule": "or_threshold_event", "params": {"conditions": [_condition("jerk", "greater_than", 6.5), _condition("accel", "less_than", -3.2, how="min")], "yes": "aggressive", "no": "normal"}},
    {"id": "L04_feature_conversion", "rule": "feature_conversion", "params": {"feature": "max_speed", "factor": 3.6, "decimals": 2}},
    {"id": "L05_threshold_classification", "rule": "threshold_classification", "params": {"feature": "mean_speed", "threshold": 4.0, "below": "below", "above": "above"}},
    {"id": "L06_trend", "rule": "trend_classification", "params": {"dead": 0.05}},
    {"id": "L07_range_check", "rule": "range_check", "params": {"feature": "max_speed", "low": 10.0, "high": 13.0}},
    {"id": "L08_dominant_axis", "rule": "dominant_axis_comparison", "params": {"ratio": 0.25}},
    {"id": "L09_lateral_threshold", "rule": "lateral_accel_threshold", "params": {"threshold": 1.0}},
    {"id": "L10_sequential_event", "rule": "sequential_event", "params": {"first": _condition("accel", "less_than", -2.5), "second": _condition("yaw_rate", "abs_greater_than", 0.13), "gap": (0.0, 0.45)}},
    {"id": "L11_peak_half", "rule": "peak_half_detection", "params": {"least": 11.0}},
    {"id": "L12_stop_and_go", "rule": "stop_and_go_detection", "params": {"stop": 1.0, "go": 6.0, "least": 5}},
    {"id": "L13_half_comparison", "rule": "half_comparison", "params": {}},
    {"id": "L14_multi_threshold", "rule": "multi_threshold_classification", "params": {"feature": "min_accel", "thresholds": BRAKING[0], "labels": BRAKING[1]}, "choices": ["emergency", "none"]},
]


def _fused() -> str:
    """The single rules' SQL, one after the other."""
    answer = lambda name: "printf('%.2f', answer)" if name.startswith("L04") else "answer"
    reject = lambda q: f"coalesce({answer(q['id'])} NOT IN ({', '.join(repr(c) for c in q['choices'])}), TRUE)" if "choices" in q else "answer IS NULL"
    return " UNION ALL ".join(f"SELECT clip_id, '{q['id']}' AS question_id, {answer(q['id'])} AS answer, {reject(q)} AS rejected FROM ({sql_of(q['id'])})" for q in CONFIGURED)


@query("X01_fused_labels", _fused())
def x01(spark, d):
    """All fourteen rules by one grouping of the series, with the answers that are none of the choices marked."""
    series = ad.series(spark, d)
    return label_clips(series, lambda: summary_features(series), CONFIGURED).drop("evidence")


@query("X01_rejects", f"SELECT question_id, count(*) AS clips, count(*) FILTER (WHERE rejected) AS rejected FROM ({_fused()}) GROUP BY question_id")
def x01_rejects(spark, d):
    return x01(spark, d).groupBy("question_id").agg(F.count("*").alias("clips"), F.count_if("rejected").alias("rejected"))
