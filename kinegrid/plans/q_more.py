"""Containers, further sources and sinks, calibration and ablation reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinegrid.functions import series as fs
from kinegrid.functions import text as tx
from kinegrid.operators import chains, rules
from kinegrid.operators import metrics as m
from kinegrid.operators.calibration import calibrate
from kinegrid.operators.features import summary_features
from kinegrid.operators.inference import infer
from kinegrid.operators.validation import config_errors
from kinegrid.plans.prelude import ANSWERS, CLASSES, FEATURES, SERIES, TRACK, sql
from kinegrid.registry import query
from kinegrid.sources import adapters as ad
from kinegrid.sources import files
from kinegrid.sources.adapters import table
from kinegrid.sources.shared import place


def r6(name: str, column=None):
    return F.round(F.col(name) if column is None else column, 6).alias(name)


def features(spark, d):
    return summary_features(ad.series(spark, d))


QUESTIONS = [
    {"question_id": "braking", "category": "longitudinal", "question_text": "How hard does the car brake?", "answer_type": "choice", "choices": ["Emergency", "Moderate", "Low", "None"], "rule": {"name": "multi_threshold_classification", "params": {"feature": "min_accel", "thresholds": [-3.3, -2.9, -2.6]}}, "metadata": {"temporal": False}},
    {"question_id": "stops", "category": "temporal", "question_text": "Does it stop and go?", "answer_type": "choice", "choices": ["Yes", "No"], "rule": {"name": "stop_and_go_detection", "params": {"stop": 1.0, "go": 6.0}}, "metadata": {"temporal": True}},
]


@query("D10_answer_maps", sql(ANSWERS, select="SELECT clip_id, max(CASE WHEN question_id = 'status' THEN answer END) AS status, count(*) AS n FROM answers GROUP BY clip_id"))
def d10(spark, d):
    held = ad.answers(spark, d).groupBy("clip_id").agg(F.map_from_entries(F.collect_list(F.struct("question_id", "answer"))).alias("answers"))
    return held.select("clip_id", F.element_at("answers", "status").alias("status"), F.size("answers").cast("long").alias("n"))


@query("D11_metric_rows", sql(CLASSES, select=", a AS (SELECT model, count(*)::DOUBLE AS n, avg((oracle = pred)::INT) AS acc FROM classes GROUP BY model) SELECT model AS key, 'n' AS metric, round(n, 6) AS value FROM a UNION ALL SELECT model, 'accuracy', round(acc, 6) FROM a"))
def d11(spark, d):
    a = m.accuracy(ad.classes(spark, d), ["model"])
    return a.select(F.col("model").alias("key"), F.inline(F.array(F.struct(F.lit("n").alias("metric"), F.col("n").cast("double").alias("value")), F.struct(F.lit("accuracy").alias("metric"), F.round("accuracy", 6).alias("value")))))


@query("D14_split_metadata", "SELECT count(*) AS clips, count(*) FILTER (WHERE c_custkey % 5 = 0) AS val, 42 AS seed FROM customer")
def d14(spark, d):
    return table(spark, d, "customer").agg(F.count("*").alias("clips"), F.count_if(F.col("c_custkey") % 5 == 0).alias("val"), F.lit(42).alias("seed"))


@query("D15_id_map", "SELECT 'req-' || l_orderkey AS custom_id, count(*) AS items FROM lineitem GROUP BY l_orderkey")
def d15(spark, d):
    return table(spark, d, "lineitem").groupBy(F.concat(F.lit("req-"), F.col("l_orderkey").cast("string")).alias("custom_id")).agg(F.count("*").alias("items"))


@query("D16_timing", "SELECT count(*) AS n_requests, round(sum(value), 4) AS total_s, round(avg(value), 6) AS mean_s, min(value) AS min_s, max(value) AS max_s, round(count(*) / sum(value), 6) AS throughput FROM events")
def d16(spark, d):
    v = F.col("value")
    return table(spark, d, "events").agg(F.count("*").alias("n_requests"), F.round(F.sum(v), 4).alias("total_s"), r6("mean_s", F.avg(v)), F.min(v).alias("min_s"), F.max(v).alias("max_s"), r6("throughput", F.count("*") / F.sum(v)))


_LINKS = """links AS (SELECT user_id AS scene, event_id AS sample, CASE WHEN event_id % 97 = 0 THEN -event_id ELSE coalesce(lead(event_id) OVER w, CASE WHEN user_id % 10 = 0 THEN first_value(event_id) OVER w END) END AS next
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY md5(event_id::VARCHAR), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def linked(spark, d):
    """Samples that name the next one of their scene, in an order of their own; some links are broken, some scenes are rings."""
    w = Window.partitionBy("user_id").orderBy(F.md5(F.col("event_id").cast("string").cast("binary")), "event_id")
    ring = F.when(F.col("user_id") % 10 == 0, F.first("event_id").over(w))
    following = F.when(F.col("event_id") % 97 == 0, -F.col("event_id")).otherwise(F.coalesce(F.lead("event_id").over(w), ring))
    return table(spark, d, "events").select(F.col("user_id").alias("scene"), F.col("event_id").alias("sample"), following.alias("next"))


@query("S08_linked_samples", "WITH RECURSIVE " + _LINKS + """,
before AS (SELECT next AS sample, min(sample) AS before FROM links WHERE next IS NOT NULL GROUP BY next),
walk AS (SELECT sample, sample AS head, 0::BIGINT AS place FROM links WHERE sample NOT IN (SELECT sample FROM before)
  UNION ALL SELECT b.sample, w.head, w.place + 1 FROM walk w JOIN before b ON b.before = w.sample WHERE b.sample IN (SELECT sample FROM links))
SELECT l.sample, w.head, w.place, CASE WHEN l.next IS NULL THEN 'last' WHEN l.next NOT IN (SELECT sample FROM links) THEN 'missing' WHEN b.before <> l.sample THEN 'taken' ELSE 'next' END AS link
FROM links l LEFT JOIN walk w ON l.sample = w.sample LEFT JOIN before b ON b.sample = l.next""")
def s08(spark, d):
    """Places of the samples along their links, from each chain's first; samples on a ring have none."""
    return chains.chain_places(linked(spark, d))


@query("S08_scene_chains", "WITH RECURSIVE " + _LINKS + """,
before AS (SELECT next AS sample, min(sample) AS before FROM links WHERE next IS NOT NULL GROUP BY next),
walk AS (SELECT sample, sample AS head, 0::BIGINT AS place FROM links WHERE sample NOT IN (SELECT sample FROM before)
  UNION ALL SELECT b.sample, w.head, w.place + 1 FROM walk w JOIN before b ON b.before = w.sample WHERE b.sample IN (SELECT sample FROM links))
SELECT l.scene, count(DISTINCT w.head) AS chains, coalesce(max(w.place) + 1, 0) AS longest, count(*) FILTER (WHERE w.sample IS NULL) AS on_rings FROM links l LEFT JOIN walk w ON l.sample = w.sample GROUP BY l.scene""")
def s08_chains(spark, d):
    """What a walk over each scene would meet: its chains, the longest of them, and samples that no walk from a first sample reaches."""
    links = linked(spark, d)
    placed = links.join(chains.chain_places(links), "sample")
    longest = F.coalesce(F.max("place") + 1, F.lit(0))
    return placed.groupBy("scene").agg(F.count_distinct("head").alias("chains"), longest.alias("longest"), F.count_if(F.col("head").isNull()).alias("on_rings"))


@query("S10_question_config", "SELECT * FROM (VALUES ('braking', 'longitudinal', 'emergency,moderate,low,none', FALSE), ('stops', 'temporal', 'yes,no', TRUE)) q(question_id, category, choices, temporal)")
def s10(spark, d):
    rows = [(q["question_id"], q["category"], ",".join(c.lower() for c in q["choices"]), q["metadata"]["temporal"]) for q in QUESTIONS]
    return spark.createDataFrame(rows, "question_id string, category string, choices string, temporal boolean")


@query("A42_temporal_questions", "SELECT 'stops' AS question_id")
def a42(spark, d):
    return s10(spark, d).where("temporal").select("question_id")


@query("V05_config_errors", "SELECT 0 AS errors")
def v05(spark, d):
    return spark.createDataFrame([(len(config_errors(QUESTIONS, set(rules.RULES))),)], "errors int")


@query("S11_result_files", "SELECT 'm' || l_linenumber AS model, count(*) AS n_total FROM lineitem WHERE l_linenumber <> 3 GROUP BY l_linenumber HAVING count(*) >= 100")
def s11(spark, d):
    """Result documents; broken ones by name and those of too few items are left out."""
    path = place(spark, "results")
    name = F.concat(F.lit("m"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 3, "_broken").otherwise(""))
    table(spark, d, "lineitem").groupBy(name.alias("model")).agg(F.count("*").alias("n_total")).write.json(path)
    return spark.read.schema("model string, n_total long").json(path).where(~F.col("model").contains("broken") & (F.col("n_total") >= 100))


@query("S17_feature_values", sql(FEATURES, select="SELECT round(max_speed, 6) AS v FROM features WHERE max_speed IS NOT NULL"))
def s17(spark, d):
    return features(spark, d).where("max_speed IS NOT NULL").select(r6("v", F.col("max_speed")))


@query("S18_viewer_rows", "SELECT c.c_custkey, count(o.o_orderkey) AS items FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE c_acctbal > 0 GROUP BY c.c_custkey")
def s18(spark, d):
    shown = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    items = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return shown.join(items, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("items"))


@query("S20_window_tracks", sql(TRACK, select="SELECT clip_id, k // 30 AS w, count(*) AS n FROM track WHERE k % 30 < 30 GROUP BY clip_id, k // 30 HAVING count(*) = 30"))
def s20(spark, d):
    w = F.floor(F.col("k") / 30)
    return ad.track(spark, d).groupBy("clip_id", w.alias("w")).agg(F.count("*").alias("n")).where("n = 30")


@query("S21_split_inputs", "SELECT c_custkey AS clip_id, count(o_orderkey) AS items FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def s21(spark, d):
    clips, items = place(spark, "clips"), place(spark, "items")
    table(spark, d, "customer").select(F.col("c_custkey").alias("clip_id")).write.json(clips)
    table(spark, d, "orders").select(F.col("o_custkey").alias("clip_id"), "o_orderkey").write.json(items)
    one = files.read_json_lines(spark, clips, "clip_id long")
    two = files.read_json_lines(spark, items, "clip_id long, o_orderkey long").groupBy("clip_id").agg(F.count("*").alias("items"))
    return one.join(two, "clip_id")


@query("S22_safe_nested", "SELECT event_id, (props->>'$.k')::INTEGER AS k, 0 AS missing FROM events")
def s22(spark, d):
    parsed = F.from_json("props", "k int, deep struct<inner:int>")
    return table(spark, d, "events").select("event_id", parsed.alias("p")).select("event_id", F.col("p.k").alias("k"), F.coalesce("p.deep.inner", F.lit(0)).alias("missing"))


@query("K01_clip_index_sink", sql(SERIES, select="SELECT clip_id, count(*) AS samples, round(max(speed), 6) AS max_speed FROM series GROUP BY clip_id"))
def k01(spark, d):
    """Clips with their arrays inline, written as Parquet and read again."""
    path = place(spark, "clips")
    ad.series(spark, d).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("i", "speed"))).alias("samples")).write.parquet(path)
    read = spark.read.schema("clip_id long, samples array<struct<i:long,speed:double>>").parquet(path)
    return read.select("clip_id", F.size("samples").cast("long").alias("samples"), r6("max_speed", F.array_max("samples.speed")))


@query("K02_item_sink", sql(ANSWERS, select="SELECT question_id, count(*) AS n FROM answers GROUP BY question_id"))
def k02(spark, d):
    path = place(spark, "qa")
    ad.answers(spark, d).write.json(path)
    return files.read_json_lines(spark, path, "clip_id long, source string, question_id string, answer string").groupBy("question_id").agg(F.count("*").alias("n"))


@query("K04_append_sink", "SELECT 2 * count(*) AS n FROM orders")
def k04(spark, d):
    path = place(spark, "predictions")
    for _ in range(2):
        table(spark, d, "orders").select("o_orderkey").write.mode("append").json(path)
    return spark.read.schema("o_orderkey long").json(path).agg(F.count("*").alias("n"))


@query("K06_leaderboard_sink", sql(CLASSES, select="SELECT model, round(avg((oracle = pred)::INT), 6) AS accuracy, CASE WHEN model IN ('m1', 'm2') THEN 1.5::DOUBLE END AS mean_s FROM classes GROUP BY model"))
def k06(spark, d):
    """Scores with the timing that an earlier leaderboard holds for some models."""
    timing = spark.createDataFrame([("m1", 1.5), ("m2", 1.5)], "model string, mean_s double")
    return m.accuracy(ad.classes(spark, d), ["model"]).join(F.broadcast(timing), "model", "left").select("model", r6("accuracy"), "mean_s")


@query("K11_manifest", "SELECT p_brand, count(*) AS chunks, sum(p_size) AS frames FROM part GROUP BY p_brand")
def k11(spark, d):
    path = place(spark, "manifest")
    table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("chunks"), F.sum("p_size").alias("frames")).write.json(path)
    return spark.read.schema("p_brand string, chunks long, frames long").json(path)


@query("F06_video_coverage", "SELECT p_partkey FROM part WHERE (p_size % 5) * 30 + 31 <= p_size * 3")
def f06(spark, d):
    return table(spark, d, "part").where((F.col("p_size") % 5) * 30 + 31 <= F.col("p_size") * 3).select("p_partkey")


@query("P15_coordinates_text", sql(TRACK, select="SELECT clip_id, string_agg('(' || printf('%.2f', x - x0) || ', ' || printf('%.2f', y - y0) || ')', ' ' ORDER BY k) AS text FROM (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM track WINDOW w AS (PARTITION BY clip_id ORDER BY k)) WHERE k < 5 GROUP BY clip_id"))
def p15(spark, d):
    w = fs.clip_window("k")
    rows = ad.track(spark, d).select("clip_id", "k", (F.col("x") - F.first("x").over(w)).alias("x"), (F.col("y") - F.first("y").over(w)).alias("y")).where("k < 5")
    points = rows.select("clip_id", "k", F.concat(F.lit("("), tx.fixed(F.col("x"), 2), F.lit(", "), tx.fixed(F.col("y"), 2), F.lit(")")).alias("point"))
    whole = points.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.when(F.col("point").isNotNull(), F.struct("k", "point")))).alias("s"))
    return whole.select("clip_id", F.when(F.size("s") > 0, F.array_join("s.point", " ")).alias("text"))


@query("P23_text_report", sql(CLASSES, select="SELECT model, printf('%-8s n=%d', model, count(*)) AS line FROM classes GROUP BY model"))
def p23(spark, d):
    return m.accuracy(ad.classes(spark, d), ["model"]).select("model", F.format_string("%-8s n=%d", "model", "n").alias("line"))


@query("W01_lag_lead", sql(SERIES, select="SELECT clip_id, i, round(lead(speed) OVER w - lag(speed) OVER w, 6) AS change FROM series WINDOW w AS (PARTITION BY clip_id ORDER BY i)"))
def w01(spark, d):
    w = fs.clip_window()
    return ad.series(spark, d).select("clip_id", "i", r6("change", F.lead("speed").over(w) - F.lag("speed").over(w)))


@query("W08_top_questions", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def w08(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


@query("W11_sorted_deltas", sql(CLASSES, select=", s AS (SELECT model, avg((oracle = pred)::INT) AS a FROM classes GROUP BY model) SELECT model, round(a - avg(a) OVER (), 6) AS delta FROM s"))
def w11(spark, d):
    s = m.accuracy(ad.classes(spark, d), ["model"])
    mean = s.agg(F.avg("accuracy").alias("_mean"))
    return s.crossJoin(F.broadcast(mean)).select("model", r6("delta", F.col("accuracy") - F.col("_mean"))).orderBy("delta")


@query("T20_clip_records", sql(FEATURES, select="SELECT 'clip_' || clip_id AS clip_id, 'nuscenes' AS source, round(max_speed, 6) AS max_speed, NULL::INTEGER AS window_idx FROM features WHERE clip_id % 2 = 0 UNION ALL SELECT 'town__' || clip_id, 'carla', round(max_speed, 6), (clip_id % 4)::INTEGER FROM features WHERE clip_id % 2 = 1"))
def t20(spark, d):
    """Records of both sources in one table; what a source lacks is null."""
    f = features(spark, d)
    one = f.where("clip_id % 2 = 0").select(F.concat(F.lit("clip_"), F.col("clip_id").cast("string")).alias("clip_id"), F.lit("nuscenes").alias("source"), r6("max_speed"))
    two = f.where("clip_id % 2 = 1").select(F.concat(F.lit("town__"), F.col("clip_id").cast("string")).alias("clip_id"), F.lit("carla").alias("source"), r6("max_speed"), (F.col("clip_id") % 4).cast("int").alias("window_idx"))
    return one.unionByName(two, allowMissingColumns=True)


CALIBRATED = {
    "braking": {"name": "multi_threshold_classification", "params": {"feature": "min_accel", "thresholds": [-3.3, -2.9, -2.6], "labels": ["emergency", "moderate", "low", "none"]}},
    "fast": {"name": "threshold_classification", "params": {"feature": "max_speed", "threshold": 11.0, "below": "slow", "above": "fast"}},
    "turn": {"name": "yaw_rate_sign_with_deadzone", "params": {"positive": 0.14, "negative": -0.14}},
    "trend": {"name": "trend_classification", "params": {"positive": 0.1, "negative": -0.1}},
    "harsh": {"name": "or_threshold_event", "params": {"conditions": [{"feature": "max_abs_jerk", "operator": "greater_than", "threshold": 6.5}, {"feature": "min_accel", "operator": "less_than", "threshold": -3.0}]}},
    "lateral": {"name": "lateral_accel_threshold", "params": {"threshold": 1.0}},
    "kmh": {"name": "feature_conversion", "params": {"feature": "max_speed", "factor": 3.6}},
    "halves": {"name": "half_comparison", "params": {}},
}
_LONG = """
v AS (SELECT clip_id, unnest([
  {'q': 'braking', 'k': 'class', 'v': min_accel, 'l': CASE WHEN min_accel < -3.3 THEN 'emergency' WHEN min_accel < -2.9 THEN 'moderate' WHEN min_accel < -2.6 THEN 'low' ELSE 'none' END},
  {'q': 'fast', 'k': 'class', 'v': max_speed, 'l': CASE WHEN max_speed < 11 THEN 'slow' ELSE 'fast' END},
  {'q': 'turn', 'k': 'class', 'v': signed_max_yaw_rate, 'l': CASE WHEN signed_max_yaw_rate > 0.14 THEN 'left' WHEN signed_max_yaw_rate < -0.14 THEN 'right' ELSE 'straight' END},
  {'q': 'trend', 'k': 'class', 'v': mean_accel, 'l': CASE WHEN mean_accel > 0.1 THEN 'accelerating' WHEN mean_accel < -0.1 THEN 'decelerating' ELSE 'steady' END},
  {'q': 'harsh/0', 'k': 'more', 'v': max_abs_jerk, 'l': CASE WHEN max_abs_jerk > 6.5 THEN 'yes' ELSE 'no' END},
  {'q': 'harsh/1', 'k': 'less', 'v': min_accel, 'l': CASE WHEN min_accel < -3.0 THEN 'yes' ELSE 'no' END},
  {'q': 'lateral', 'k': 'class', 'v': max_lateral_accel, 'l': CASE WHEN max_lateral_accel > 1.0 THEN 'yes' ELSE 'no' END},
  {'q': 'kmh', 'k': 'class', 'v': max_speed * 3.6::DOUBLE, 'l': NULL}], recursive := true) FROM features),
h AS (SELECT clip_id, sqrt(avg(CASE WHEN i < 32 THEN accel * accel END)) AS a, sqrt(avg(CASE WHEN i >= 32 THEN accel * accel END)) AS b FROM series GROUP BY clip_id),
labels AS (SELECT q, 'balance' AS part, l FROM v WHERE l IS NOT NULL
  UNION ALL SELECT 'harsh', 'combined', CASE WHEN max_abs_jerk > 6.5 OR min_accel < -3.0 THEN 'yes' ELSE 'no' END FROM features
  UNION ALL SELECT 'halves', 'balance', CASE WHEN greatest(a, b) < 1e-9 OR abs(a - b) / greatest(a, b) < 0.2 THEN 'similar' WHEN a > b THEN 'first_half' ELSE 'second_half' END FROM h),
tried AS (SELECT * FROM (SELECT DISTINCT q, k FROM v) JOIN (VALUES ('class', 10), ('class', 25), ('class', 50), ('class', 75), ('class', 90), ('more', 70), ('more', 80), ('more', 85), ('more', 90), ('more', 95), ('less', 5), ('less', 10), ('less', 15), ('less', 20), ('less', 30)) t(k, p) USING (k)),
cuts AS (SELECT q, k, p, o[1 + floor(p / 100.0::DOUBLE * (len(o) - 1))::INT] AS lo, o[1 + ceil(p / 100.0::DOUBLE * (len(o) - 1))::INT] AS hi, p / 100.0::DOUBLE * (len(o) - 1) - floor(p / 100.0::DOUBLE * (len(o) - 1)) AS s FROM tried JOIN (SELECT q, list(v ORDER BY v) AS o FROM v GROUP BY q) USING (q)),
t AS (SELECT c.q, c.k, c.p, c.lo + (c.hi - c.lo) * c.s AS threshold, count(*) FILTER (WHERE v.v < c.lo + (c.hi - c.lo) * c.s) AS below, count(*) FILTER (WHERE v.v > c.lo + (c.hi - c.lo) * c.s) AS above, count(*) AS total FROM cuts c JOIN v ON v.q = c.q GROUP BY c.q, c.k, c.p, c.lo, c.hi, c.s)
SELECT q AS question, part, l AS label, NULL::INT AS p, NULL::DOUBLE AS threshold, count(*) AS n, sum(count(*)) OVER (PARTITION BY q, part)::BIGINT AS total FROM labels GROUP BY q, part, l
UNION ALL SELECT q, 'below', NULL, p, round(threshold, 6), below, total FROM t WHERE k = 'class' UNION ALL SELECT q, 'above', NULL, p, round(threshold, 6), total - below, total FROM t WHERE k = 'class'
UNION ALL SELECT q, 'yes', NULL, p, round(threshold, 6), CASE k WHEN 'less' THEN below ELSE above END, total FROM t WHERE k <> 'class'"""


@query("A35_calibration", sql(FEATURES, select="," + _LONG))
def a35(spark, d):
    """Balance and sensitivity of seven kinds of rules, all features in one sorted pass, and of a rule over the series."""
    out = calibrate(CALIBRATED, features(spark, d), ad.series(spark, d))
    return out.select("question", "part", "label", "p", r6("threshold"), "n", "total")


@query("A36_replicate_metrics", sql(CLASSES, select="""
, k AS (SELECT b, c.*, ('0x' || substr(md5(b || ':' || clip_id), 1, 8))::BIGINT % 3 AS w FROM classes c CROSS JOIN generate_series(1, 5) g(b)), e AS (SELECT * FROM k, generate_series(1, 2) r(copy) WHERE copy <= w),
s AS (SELECT b, oracle AS label, (oracle = pred)::INT AS hit FROM e), r AS (SELECT b, label, avg(hit) AS rec FROM s GROUP BY b, label) SELECT b, round(avg(rec), 6) AS balanced_accuracy FROM r GROUP BY b"""))
def a36(spark, d):
    """A clip drawn twice counts twice: counts are multiplied by the draw instead of copying rows."""
    drawn = ad.classes(spark, d).groupBy("clip_id", "oracle", "pred").agg(F.count("*").alias("n")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(5))))
    w = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("b").cast("string"), F.col("clip_id").cast("string"))), 1, 8), 16, 10).cast("long") % 3
    rows = drawn.withColumn("n", F.col("n") * w).where("n > 0")
    recall = rows.groupBy("b", "oracle").agg((F.sum(F.when(F.col("oracle") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("r"))
    return recall.groupBy("b").agg(r6("balanced_accuracy", F.avg("r")))


@query("A37_question_table", sql(CLASSES, select="SELECT m.model, q.q AS question_id, count(c.clip_id) AS n, round(avg((c.oracle = c.pred)::INT), 6) AS accuracy FROM (SELECT DISTINCT model FROM classes) m CROSS JOIN (VALUES ('A'), ('R'), ('Z')) q(q) LEFT JOIN classes c ON c.model = m.model AND c.question_id = q.q GROUP BY m.model, q.q"))
def a37(spark, d):
    """Every model with every question of a fixed list; 0 and null where there is nothing."""
    c = ad.classes(spark, d)
    grid = c.select("model").distinct().withColumn("question_id", F.explode(F.array(*map(F.lit, ("A", "R", "Z")))))
    got = c.groupBy("model", "question_id").agg(F.count("*").alias("k"), F.round(F.avg((F.col("oracle") == F.col("pred")).cast("double")), 6).alias("accuracy"))
    return grid.join(got, ["model", "question_id"], "left").select("model", "question_id", F.coalesce("k", F.lit(0)).cast("long").alias("n"), "accuracy")


@query("A40_ablation_rows", sql(CLASSES, select=", s AS (SELECT model, avg((oracle = pred)::INT) AS a FROM classes GROUP BY model) SELECT q.label, round(s.a, 6) AS accuracy FROM (VALUES ('vision', 'm2'), ('text', 'm4'), ('both', 'm1')) q(label, model) JOIN s ON s.model = q.model"))
def a40(spark, d):
    """For each condition the first of its candidate models that has results."""
    wanted = spark.createDataFrame([("vision", 0, "none"), ("vision", 1, "m2"), ("text", 0, "m4"), ("both", 0, "m1"), ("both", 1, "m3")], "label string, place int, model string")
    s = m.accuracy(ad.classes(spark, d), ["model"])
    return s.join(F.broadcast(wanted), "model").groupBy("label").agg(r6("accuracy", F.min_by("accuracy", "place")))


@query("X02_inference", "SELECT p_partkey, upper(p_name) AS model_answer FROM part")
def x02(spark, d):
    prompts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("prompt"))
    return infer(prompts, lambda text: text.upper()).select("p_partkey", "model_answer")
