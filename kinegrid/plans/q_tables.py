"""Joins, set operations, selection, validation, ranking and report queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinegrid.functions import series as fs
from kinegrid.operators import conventions, rules
from kinegrid.operators import selection as sel
from kinegrid.operators import validation as val
from kinegrid.operators.features import summary_features
from kinegrid.operators.quantiles import quantiles
from kinegrid.plans.prelude import ANSWERS, CLASSES, FEATURES, SERIES, TRACK, sql
from kinegrid.registry import query
from kinegrid.sources import adapters as ad
from kinegrid.sources.adapters import table
from kinegrid.sources.shared import place


def r6(name: str, column=None):
    return F.round(F.col(name) if column is None else column, 6).alias(name)


def features(spark, d):
    return summary_features(ad.series(spark, d))


# --- joins

@query("J01_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j01(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(urgent, "l_orderkey", "left_semi")


@query("J02_resume_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j02(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("J03_all_done", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING NOT bool_and(l_linestatus = 'F')")
def j03(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("done")).where("NOT done").select("l_orderkey")


@query("J04_lookup_with_misses", "SELECT count(*) FILTER (WHERE s.s_suppkey IS NOT NULL) AS found, count(*) FILTER (WHERE s.s_suppkey IS NULL) AS missed FROM lineitem l LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s_suppkey")
def j04(spark, d):
    kept = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("hit"))
    return table(spark, d, "lineitem").join(kept, "l_suppkey", "left").agg(F.count("hit").alias("found"), F.count_if(F.col("hit").isNull()).alias("missed"))


@query("J05_clip_by_question", "SELECT count(*) AS n, count(DISTINCT c_custkey) AS clips FROM customer CROSS JOIN (SELECT n_name FROM nation WHERE n_nationkey < 14)")
def j05(spark, d):
    """Every clip with every question template; templates are a fixed few."""
    questions = table(spark, d, "nation").where("n_nationkey < 14").select("n_name")
    return table(spark, d, "customer").crossJoin(F.broadcast(questions)).agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("clips"))


@query("J06_last_wins", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def j06(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("J07_two_key_join", sql(ANSWERS, select="SELECT a.clip_id, a.question_id, a.answer FROM answers a JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') o ON a.clip_id = o.o_custkey AND a.question_id = 'status'"))
def j07(spark, d):
    keys = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("clip_id"), F.lit("status").alias("question_id")).distinct()
    return ad.answers(spark, d).join(keys, ["clip_id", "question_id"]).select("clip_id", "question_id", "answer")


@query("J08_unknown_ids", "SELECT count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS unknown FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j08(spark, d):
    known = table(spark, d, "labels").select("doc_id", F.lit(True).alias("hit"))
    return table(spark, d, "documents").select("doc_id").join(known, "doc_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("hit").isNull()).alias("unknown"))


@query("J09_positional", "SELECT a.conv_id, a.turn, md5(a.text) AS request, md5(b.text) AS response FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND a.k = b.k")
def j09(spark, d):
    rows = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    placed = rows.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")))
    pick = lambda role, c: F.max(F.when(F.col("role") == role, c))
    both = placed.groupBy("conv_id", "k").agg(pick("user", F.col("turn")).alias("turn"), pick("user", F.md5("text")).alias("request"), pick("assistant", F.md5("text")).alias("response"))
    return both.where("request IS NOT NULL AND response IS NOT NULL").drop("k")


@query("J10_forward_range", sql(SERIES, select="SELECT a.clip_id, a.i, round(min(b.t) - a.t, 6) AS gap FROM series a JOIN series b ON a.clip_id = b.clip_id AND b.t BETWEEN a.t + 1e-6 AND a.t + 0.55 WHERE a.accel < -2.5 AND abs(b.yaw_rate) > 0.13 GROUP BY a.clip_id, a.i, a.t"))
def j10(spark, d):
    s = fs.with_next(ad.series(spark, d).select("clip_id", "i", "t", "accel", "yaw_rate"), F.abs("yaw_rate") > 0.13, "t2", 1e-6, 0.55)
    return s.where("accel < -2.5 AND t2 IS NOT NULL").select("clip_id", "i", r6("gap", F.col("t2") - F.col("t")))


@query("J11_interval", sql(TRACK, select="SELECT a.clip_id, a.k, count(*) AS frames FROM (SELECT * FROM track WHERE k % 10 = 0) a JOIN track b ON a.clip_id = b.clip_id AND b.ts BETWEEN a.ts AND a.ts + 86400 GROUP BY a.clip_id, a.k"))
def j11(spark, d):
    """Frames of the day after every tenth sample of a track."""
    track = ad.track(spark, d).select("clip_id", "k", "ts")
    spans = track.where("k % 10 = 0").withColumn("end", F.col("ts") + 86400)
    return fs.count_inside(spans, track, "k", "ts", "end", "ts").select("clip_id", "k", F.col("points").alias("frames"))


@query("J11_frame_places", sql(TRACK, select="SELECT a.clip_id, a.k, min(b.k) AS first, max(b.k) AS last FROM track a LEFT JOIN track b ON a.clip_id = b.clip_id AND b.ts BETWEEN a.ts + 1000 AND a.ts + 700000 GROUP BY a.clip_id, a.k"))
def j11_places(spark, d):
    """The first and last frame of a span that begins after the sample, for every sample; spans may be empty."""
    track = ad.track(spark, d).select("clip_id", "k", "ts")
    spans = track.select("clip_id", "k", (F.col("ts") + 1000).alias("begin"), (F.col("ts") + 700000).alias("end"))
    return fs.count_inside(spans, track, "k", "begin", "end", "ts").select("clip_id", "k", "first", "last")


@query("L10_open_gap", sql(SERIES, select="""
, p AS (SELECT a.clip_id, min(a.t) AS t1 FROM series a JOIN series b ON a.clip_id = b.clip_id AND b.t >= a.t + 1.5 WHERE a.accel < -2.0 AND b.accel > 2.0 GROUP BY a.clip_id)
SELECT c.clip_id, round(t1, 6) AS first_t, round((SELECT min(b.t) FROM series b WHERE b.clip_id = c.clip_id AND b.accel > 2.0 AND b.t >= t1 + 1.5) - t1, 6) AS gap, CASE WHEN p.clip_id IS NULL THEN 'no' ELSE 'yes' END AS answer FROM (SELECT DISTINCT clip_id FROM series) c LEFT JOIN p ON c.clip_id = p.clip_id"""))
def l10_open(spark, d):
    """A gap of at least 1.5 s without an end."""
    rule = rules.rule_named("sequential_event")
    found = rule(ad.series(spark, d), {"signal": "accel", "operator": "less_than", "threshold": -2.0}, {"signal": "accel", "operator": "greater_than", "threshold": 2.0}, (1.5, float("inf")))
    return found.select("clip_id", r6("first_t"), r6("gap"), "answer")


@query("J12_exclude_scenes", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def j12(spark, d):
    out = table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(F.broadcast(out), "c_nationkey", "left_anti").select("c_custkey")


@query("J14_paired_models", sql(CLASSES, select=", s AS (SELECT model, avg((oracle = pred)::INT) AS a FROM classes GROUP BY model) SELECT x.model, round(y.a - x.a, 6) AS gain FROM s x JOIN s y ON y.model = CASE x.model WHEN 'm1' THEN 'm2' WHEN 'm3' THEN 'm4' END"))
def j14(spark, d):
    from kinegrid.operators.metrics import accuracy

    s = accuracy(ad.classes(spark, d), ["model"])
    other = F.when(F.col("model") == "m1", "m2").when(F.col("model") == "m3", "m4")
    pair = s.select(F.col("model").alias("other"), F.col("accuracy").alias("b"))
    return s.withColumn("other", other).join(pair, "other").select("model", r6("gain", F.col("b") - F.col("accuracy")))


@query("J15_missing_references", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j15(spark, d):
    return val.missing_references(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), "doc_id")


@query("J16_overlap", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def j16(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("J17_first_candidate", "SELECT o_custkey, arg_min(o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END * 1e12 + o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def j17(spark, d):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(rank, "o_orderkey")).alias("o_orderkey"))


# --- set operations, splits, selection

@query("U01_union", "SELECT count(*) AS n FROM (SELECT s_name AS n FROM supplier UNION ALL SELECT c_name FROM customer)")
def u01(spark, d):
    return table(spark, d, "supplier").select(F.col("s_name").alias("n")).unionByName(table(spark, d, "customer").select(F.col("c_name").alias("n"))).agg(F.count("*").alias("n"))


@query("U02_label_union", sql(CLASSES, select="SELECT DISTINCT oracle AS label FROM classes UNION SELECT DISTINCT pred FROM classes"))
def u02(spark, d):
    c = ad.classes(spark, d)
    return c.select(F.explode(F.array("oracle", "pred")).alias("label")).distinct()


@query("U03_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u03(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("U04_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def u04(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")))


_TAGS = ", tags AS (SELECT clip_id, bool_or(question_id = 'status' AND answer <> 'O')::INT AS a, bool_or(question_id = 'priority' AND answer = '1-URGENT')::INT AS b, bool_or(question_id = 'price' AND answer = 'high')::INT AS c FROM answers GROUP BY clip_id)"


def _tags(spark, d):
    q, a = F.col("question_id"), F.col("answer")
    bit = lambda c: F.bool_or(c).cast("int")
    return ad.answers(spark, d).groupBy("clip_id").agg(bit((q == "status") & (a != "O")).alias("a"), bit((q == "priority") & (a == "1-URGENT")).alias("b"), bit((q == "price") & (a == "high")).alias("c"))


@query("U05_strata", sql(ANSWERS, select=_TAGS + " SELECT a, b, c, count(*) AS n FROM tags GROUP BY a, b, c"))
def u05(spark, d):
    return _tags(spark, d).groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def _sampled(rows: str, total: str, least: int) -> str:
    """WITH clauses for the stratified sample of a table with clip_id, a, b, c."""
    return f"""sizes AS (SELECT a, b, c, count(*) AS size FROM {rows} GROUP BY a, b, c),
q AS (SELECT *, least(size, least(size, {least}) + floor(greatest({total} - sum(least(size, {least})) OVER (), 0) * size / sum(size) OVER ())) AS quota FROM sizes),
r AS (SELECT t.*, ('0x' || substr(md5('42:' || clip_id), 1, 8))::BIGINT AS draw, row_number() OVER (PARTITION BY a, b, c ORDER BY ('0x' || substr(md5('42:' || clip_id), 1, 8))::BIGINT, clip_id) AS k FROM {rows} t),
m AS (SELECT r.clip_id, r.draw, k <= quota AS held FROM r JOIN q ON r.a = q.a AND r.b = q.b AND r.c = q.c),
sample AS (SELECT clip_id FROM m QUALIFY row_number() OVER (ORDER BY held DESC, draw, clip_id) <= {total})"""


@query("U06_stratified_sample", sql(ANSWERS, select=_TAGS + ", " + _sampled("tags", "200", 5) + " SELECT clip_id FROM sample"))
def u06(spark, d):
    return sel.stratified_sample(_tags(spark, d), "clip_id", ["a", "b", "c"], 200, 5).select("clip_id")


@query("U06_trimmed_sample", sql(ANSWERS, select=_TAGS + ", " + _sampled("tags", "21", 5) + " SELECT clip_id FROM sample"))
def u06_trimmed(spark, d):
    """The bins' least alone pass the total."""
    return sel.stratified_sample(_tags(spark, d), "clip_id", ["a", "b", "c"], 21, 5).select("clip_id")


_ELIGIBLE = _TAGS + ", eligible AS (SELECT tags.* FROM tags JOIN customer ON clip_id = c_custkey WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0))"
_SPLIT = """ SELECT clip_id, 'val' AS split FROM sample UNION ALL SELECT clip_id, 'train' FROM (SELECT clip_id FROM eligible WHERE clip_id NOT IN (SELECT clip_id FROM sample)
  QUALIFY row_number() OVER (ORDER BY ('0x' || substr(md5('42-train:' || clip_id), 1, 8))::BIGINT, clip_id) <= {train})"""


def _split_inputs(spark, d):
    clips = table(spark, d, "customer").select(F.col("c_custkey").alias("clip_id"), F.col("c_nationkey").alias("scene"))
    return clips, _tags(spark, d), table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("scene"))


@query("U07_build_splits", sql(ANSWERS, select=_ELIGIBLE + ", " + _sampled("eligible", "100", 4) + _SPLIT.format(train=150)))
def u07(spark, d):
    """Customers of all regions but one, those without orders left out; 100 for validation and 150 for training."""
    clips, tags, excluded = _split_inputs(spark, d)
    return sel.build_splits(clips, tags, ["a", "b", "c"], 100, 150, 4, excluded=excluded)


@query("U07_ratio_splits", sql(ANSWERS, select=_ELIGIBLE + ", target AS (SELECT floor(count(*) * 0.2::DOUBLE)::BIGINT AS n FROM eligible), " + _sampled("eligible", "(SELECT n FROM target)", 10) + _SPLIT.format(train="(SELECT count(*) FROM eligible)")))
def u07_ratio(spark, d):
    clips, tags, excluded = _split_inputs(spark, d)
    return sel.build_splits(clips, tags, ["a", "b", "c"], 0, 0, 10, ratio=0.2, excluded=excluded)


@query("U08_imbalance", sql(ANSWERS, select=", n AS (SELECT question_id, answer, count(*) AS n FROM answers GROUP BY question_id, answer) SELECT question_id, round(max(o), 6) AS imbalance FROM (SELECT question_id, abs(n::DOUBLE / sum(n) OVER w - 1.0::DOUBLE / count(*) OVER w) AS o FROM n WINDOW w AS (PARTITION BY question_id)) GROUP BY question_id"))
def u08(spark, d):
    return sel.imbalance(ad.answers(spark, d)).select("question_id", r6("imbalance"))


#: One pick a step; the state is what has been chosen, with counts by class and source kept as lists.
_GREEDY = sql(ANSWERS, select=""",
class AS (SELECT question_id, answer, row_number() OVER (ORDER BY question_id, answer) AS c, dense_rank() OVER (ORDER BY question_id) AS q FROM (SELECT DISTINCT question_id, answer FROM answers)),
fair AS (SELECT list(1.0::DOUBLE / k ORDER BY c) AS fair, list(q ORDER BY c) AS question, max(q) AS n_q, max(c) AS n_c FROM (SELECT *, count(*) OVER (PARTITION BY q) AS k FROM class)),
pool AS MATERIALIZED (SELECT clip_id, any_value(source) AS source, ('0x' || substr(md5('42:' || clip_id), 1, 8))::BIGINT AS draw, list(c ORDER BY q) AS own FROM answers JOIN class USING (question_id, answer) GROUP BY clip_id),
g AS (SELECT 0 AS pick, NULL::BIGINT AS last, []::BIGINT[] AS chosen, list_transform(fair, lambda x: 0) AS n, 0 AS real FROM fair
  UNION ALL
  SELECT pick + 1, b.clip_id, list_append(chosen, b.clip_id), list_transform(range(1, n_c + 1), lambda i: n[i] + (CASE WHEN list_contains(b.own, i) THEN 1 ELSE 0 END)), real + (b.source = 'real')::INT
  FROM (SELECT pick, chosen, n, real, n_c, arg_max({'clip_id': clip_id, 'own': own, 'source': source}, {'fits': fits, 'helps': helps, 'draw': -draw, 'id': -clip_id}) AS b
    FROM (SELECT s.*, p.clip_id, p.own, p.source, p.draw, (p.own[worst] = wanted)::INT AS fits,
        round(list_sum(list_transform(p.own, lambda c: CASE WHEN question[c] = worst THEN 0 ELSE greatest(lack[c], 0) END)), 9) AS helps
      FROM (SELECT *, list_position(asked, list_max(asked)) AS wanted
          FROM (SELECT *, list_transform(range(1, n_c + 1), lambda i: CASE WHEN question[i] = worst THEN lack[i] ELSE -9 END) AS asked
          FROM (SELECT *, list_position(off, list_max(off)) AS worst
            FROM (SELECT *, list_transform(range(1, n_q + 1), lambda k: CASE WHEN pick = 0 THEN 1.0 ELSE round(list_max(list_transform(range(1, n_c + 1), lambda i: CASE WHEN question[i] = k THEN abs(n[i]::DOUBLE / pick - fair[i]) ELSE 0 END)), 9) END) AS off,
                    list_transform(range(1, n_c + 1), lambda i: round(fair[i] - n[i]::DOUBLE / greatest(pick, 1), 9)) AS lack
                  FROM g, fair WHERE pick < {size})))) s
      JOIN pool p ON NOT list_contains(s.chosen, p.clip_id) AND (p.source <> 'real' OR s.real < {real}) AND (p.source = 'real' OR s.pick - s.real < {simulated})) GROUP BY pick, chosen, n, real, n_c))
SELECT last AS clip_id, pick FROM g WHERE pick > 0""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("U09_balanced_subset", _GREEDY.replace("{size}", "100").replace("{real}", "100").replace("{simulated}", "100"))
def u09(spark, d):
    """A hundred clips with even answers, picked one by one; the queues are longer than the table's classes, as the SQL looks at all."""
    return sel.balanced_subset(ad.answers(spark, d), 100, candidates=1_000_000)


@query("U09_source_caps", _GREEDY.replace("{size}", "60").replace("{real}", "15").replace("{simulated}", "60"))
def u09_caps(spark, d):
    """Three quarters of the picks stay open to simulated clips."""
    return sel.balanced_subset(ad.answers(spark, d), 60, candidates=1_000_000, least={"simulated": 0.75})


@query("U10_selection_report", sql(ANSWERS, select="SELECT source, count(DISTINCT clip_id) AS clips, count(DISTINCT answer) AS answers FROM answers GROUP BY source"))
def u10(spark, d):
    return ad.answers(spark, d).groupBy("source").agg(F.count_distinct("clip_id").alias("clips"), F.count_distinct("answer").alias("answers"))


@query("U11_seeded_sample", "SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY ('0x' || substr(md5('42:' || c_custkey), 1, 8))::BIGINT, c_custkey LIMIT 50)")
def u11(spark, d):
    return table(spark, d, "customer").select("c_custkey").orderBy(sel.seeded(F.col("c_custkey"), "42"), "c_custkey").limit(50)


# --- validation

@query("V01_array_checks", "SELECT count(*) AS n, count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 64 OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS bad FROM embeddings")
def v01(spark, d):
    ok = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad"))


@query("V02_clip_violations", sql(FEATURES, select="SELECT clip_id, 'speed too high' AS reason FROM features WHERE NOT (max_speed < 13) UNION ALL SELECT clip_id, 'weak braking' FROM features WHERE NOT (min_accel < -2.6)"))
def v02(spark, d):
    return val.violations(features(spark, d), "clip_id", {"speed too high": F.col("max_speed") < 13, "weak braking": F.col("min_accel") < -2.6})


@query("V03_answer_violations", sql(ANSWERS, select="SELECT clip_id, 'unknown answer' AS reason FROM answers WHERE answer NOT IN ('F', 'O', 'low', 'medium', 'high', '1-URGENT', '2-HIGH')"))
def v03(spark, d):
    return val.violations(ad.answers(spark, d), "clip_id", {"unknown answer": F.col("answer").isin("F", "O", "low", "medium", "high", "1-URGENT", "2-HIGH")})


@query("V04_split_overlap", "SELECT count(*) AS overlap FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 5 <> 0)")
def v04(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderkey % 5 = 0").select("o_custkey").intersect(o.where("o_orderkey % 5 <> 0").select("o_custkey")).agg(F.count("*").alias("overlap"))


_WHOLE_CLIPS = """
clip AS (SELECT user_id AS clip_id, 0.0::DOUBLE AS t_start, (user_id % 4) * 800000.0::DOUBLE AS t_end, count(*) AS tokens, count(*) - (user_id % 5 = 0)::INT AS paths, CASE WHEN user_id % 9 <> 0 THEN user_id || '.npz' END AS array_ref FROM events GROUP BY user_id),
sample AS (SELECT user_id AS clip_id, event_id AS k, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS ts, CASE WHEN event_id % 501 = 0 THEN 'NaN'::DOUBLE ELSE value END AS x, value AS y, CASE WHEN event_id % 400 = 7 THEN NULL ELSE value END AS yaw FROM events WHERE user_id % 13 <> 5),
step AS (SELECT *, ts - lag(ts) OVER (PARTITION BY clip_id ORDER BY k) AS step FROM sample),
t AS (SELECT clip_id, count(*) AS n, min(step) AS least, arg_min(ts, k) AS first, arg_max(ts, k) AS last, count(*) FILTER (WHERE NOT isfinite(x)) AS bx, count(*) FILTER (WHERE yaw IS NULL) AS byaw FROM step GROUP BY clip_id),
f AS (SELECT user_id AS clip_id, CASE WHEN user_id % 8 = 3 THEN NULL ELSE max(value) END AS max_value FROM events WHERE user_id % 10 <> 2 GROUP BY user_id),
j AS (SELECT clip.*, t.n, least, first, last, bx, byaw, max_value FROM clip LEFT JOIN t USING (clip_id) LEFT JOIN f USING (clip_id))"""


@query("V02_whole_clips", sql(_WHOLE_CLIPS, select="""
SELECT clip_id, unnest(list_filter([CASE WHEN abs(t_end - t_start - 1600000) > 1000 THEN 'duration' END, CASE WHEN t_end <= t_start THEN 'order' END, CASE WHEN tokens <> paths THEN 'frames and paths differ' END, CASE WHEN tokens < 60 THEN 'few frames' END,
  CASE WHEN array_ref IS NULL THEN 'no array_ref' END, CASE WHEN array_ref IS NOT NULL AND n IS NULL THEN 'no array' END, CASE WHEN bx > 0 THEN 'x not finite' END, CASE WHEN byaw > 0 THEN 'yaw not finite' END, CASE WHEN n > 1 AND least <= 0 THEN 'times do not rise' END,
  CASE WHEN abs(first) > 1000 THEN 'first time' END, CASE WHEN abs(last - first - (t_end - t_start)) > 1000 THEN 'array duration' END, CASE WHEN max_value IS NULL THEN 'feature max_value' END], lambda r: r IS NOT NULL)) AS reason FROM j"""))
def v02_whole(spark, d):
    """Every check of a clip: its times and frames, its arrays' values, order and duration, its features."""
    user, event = F.col("user_id"), F.col("event_id")
    e = table(spark, d, "events")
    clips = e.groupBy(user.alias("clip_id")).agg(F.count("*").alias("tokens"))
    c = F.col("clip_id")
    clips = clips.select("clip_id", F.lit(0.0).alias("t_start"), ((c % 4) * 800000.0).alias("t_end"), "tokens", (F.col("tokens") - (c % 5 == 0).cast("int")).alias("paths"), F.when(c % 9 != 0, F.concat(c.cast("string"), F.lit(".npz"))).alias("array_ref"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ts = (micros - F.min(micros).over(Window.partitionBy("user_id"))) / 1e6
    x, yaw = F.when(event % 501 == 0, float("nan")).otherwise(F.col("value")), F.when(event % 400 != 7, F.col("value"))
    samples = e.select(user.alias("clip_id"), event.alias("k"), ts.alias("ts"), x.alias("x"), F.col("value").alias("y"), yaw.alias("yaw")).where("clip_id % 13 <> 5")
    found = e.where("user_id % 10 <> 2").groupBy(user.alias("clip_id")).agg(F.max("value").alias("max_value")).withColumn("max_value", F.when(c % 8 != 3, F.col("max_value")))
    return val.clip_violations(clips, samples, found, 1_600_000.0, 1000.0, 60)


_ITEMS = """
item AS (SELECT l_orderkey * 8 + l_linenumber AS line, CASE WHEN l_partkey % 50 <> 0 THEN 'q' || l_orderkey || '-' || l_suppkey END AS qa_id, l_orderkey AS clip_id, CASE WHEN l_suppkey % 40 <> 1 THEN l_returnflag END AS question_id,
  CASE l_linenumber WHEN 1 THEN 'multiclass' WHEN 2 THEN 'binary' WHEN 3 THEN 'numeric' WHEN 4 THEN 'multiclass' WHEN 5 THEN 'numeric' ELSE 'open' END AS answer_type, CASE WHEN l_linenumber = 3 THEN l_quantity::VARCHAR ELSE l_linestatus END AS answer, CASE l_linenumber WHEN 1 THEN ['O'] WHEN 2 THEN ['F'] END AS choices FROM lineitem),
clip AS (SELECT o_orderkey AS clip_id FROM orders WHERE o_orderstatus <> 'P')"""


@query("V03_items", sql(_ITEMS, select="""
, whole AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY line) AS place FROM item WHERE qa_id IS NOT NULL AND question_id IS NOT NULL)
SELECT line, 'no qa_id' AS reason FROM item WHERE qa_id IS NULL UNION ALL SELECT line, 'no question_id' FROM item WHERE question_id IS NULL UNION ALL SELECT line, 'duplicate' FROM whole WHERE place > 1 UNION ALL SELECT line, 'answer type' FROM whole WHERE answer_type = 'open'
UNION ALL SELECT line, 'no choices' FROM whole WHERE answer_type = 'multiclass' AND choices IS NULL UNION ALL SELECT line, 'answer not in choices' FROM whole WHERE choices IS NOT NULL AND NOT list_contains(choices, answer)
UNION ALL SELECT line, 'answer not a number' FROM whole WHERE answer_type = 'numeric' AND try_cast(answer AS DOUBLE) IS NULL UNION ALL SELECT line, 'unknown clip' FROM whole WHERE clip_id NOT IN (SELECT clip_id FROM clip)"""))
def v03_items(spark, d):
    """Every check of an item: fields, repeated ids, types, choices, numbers, references."""
    n, l = F.col("l_linenumber"), table(spark, d, "lineitem")
    kind = F.when(n.isin(1, 4), "multiclass").when(n == 2, "binary").when(n.isin(3, 5), "numeric").otherwise("open")
    key = F.concat(F.lit("q"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    items = l.select(
        (F.col("l_orderkey") * 8 + n).alias("line"), F.when(F.col("l_partkey") % 50 != 0, key).alias("qa_id"), F.col("l_orderkey").alias("clip_id"), F.when(F.col("l_suppkey") % 40 != 1, F.col("l_returnflag")).alias("question_id"),
        kind.alias("answer_type"), F.when(n == 3, F.col("l_quantity").cast("string")).otherwise(F.col("l_linestatus")).alias("answer"), F.when(n == 1, F.array(F.lit("O"))).when(n == 2, F.array(F.lit("F"))).alias("choices"),
    )
    return val.item_violations(items, table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("clip_id")))


@query("V04_splits", """
WITH c AS (SELECT o_custkey AS clip_id, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders), i AS (SELECT c_custkey AS clip_id, CASE WHEN c_acctbal > 0 THEN 'train' ELSE 'val' END AS split FROM customer),
ids AS (SELECT clip_id, count(DISTINCT split) AS s, count(*) AS n FROM c GROUP BY clip_id), told AS (SELECT * FROM (VALUES ('train', 100, 100), ('test', (SELECT count(*) FROM c WHERE split = 'test'), 0)) t(split, clips, items))
SELECT 'clips in both splits' AS reason, count(*) AS n FROM ids WHERE s > 1 UNION ALL SELECT 'clips twice in a split', count(*) FROM ids WHERE n > s UNION ALL SELECT 'split is neither train nor val', count(*) FROM c WHERE split = 'test'
UNION ALL SELECT 'items without their clip', count(*) FROM i WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.clip_id = i.clip_id AND c.split = i.split) UNION ALL SELECT 'counts differ from the metadata', 2""")
def v04_splits(spark, d):
    """Overlap, repeats, names, lost items and counts of written splits; the metadata is right about one split of three."""
    status = F.col("o_orderstatus")
    clips = table(spark, d, "orders").select(F.col("o_custkey").alias("clip_id"), F.when(status == "F", "train").when(status == "O", "val").otherwise("test").alias("split"))
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("clip_id"), F.when(F.col("c_acctbal") > 0, "train").otherwise("val").alias("split"))
    told = spark.createDataFrame([("train", 100, 100)], "split string, clips long, items long").unionByName(clips.where("split = 'test'").groupBy("split").agg(F.count("*").alias("clips"), F.lit(0).cast("long").alias("items")))
    return val.split_violations(clips, items, told)


@query("A43_validation_summary", sql(FEATURES, select="SELECT count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS invalid FROM (SELECT max_speed < 13 AND min_accel < -2.6 AS ok FROM features)"))
def a43(spark, d):
    ok = (F.col("max_speed") < 13) & (F.col("min_accel") < -2.6)
    return features(spark, d).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


# --- ranking

@query("W05_grouped_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS place FROM part")
def w05(spark, d):
    return table(spark, d, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("place"))


@query("W06_top_groups", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def w06(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("W07_top_clips", sql(FEATURES, select="SELECT clip_id, round(max_abs_yaw_rate, 6) AS v FROM features ORDER BY max_abs_yaw_rate DESC, clip_id LIMIT 50"))
def w07(spark, d):
    return features(spark, d).orderBy(F.desc("max_abs_yaw_rate"), "clip_id").limit(50).select("clip_id", r6("v", F.col("max_abs_yaw_rate")))


@query("W09_sample_per_group", sql(CLASSES, select="SELECT model, clip_id, question_id FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY md5(clip_id::VARCHAR || question_id), clip_id, question_id) AS k FROM (SELECT DISTINCT model, clip_id, question_id FROM classes WHERE oracle <> pred)) WHERE k <= 5"))
def w09(spark, d):
    wrong = ad.classes(spark, d).where("oracle <> pred").select("model", "clip_id", "question_id")
    digest = F.md5(F.concat(F.col("clip_id").cast("string"), "question_id"))
    k = F.row_number().over(Window.partitionBy("model").orderBy(*(c.asc_nulls_last() for c in (digest, F.col("clip_id"), F.col("question_id")))))
    return sel.least_digests(wrong, "model", digest, 5).distinct().withColumn("k", k).where("k <= 5").drop("k")


@query("W10_preferred_order", "SELECT event_type, row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 9 END, event_type) AS place FROM (SELECT DISTINCT event_type FROM events)")
def w10(spark, d):
    kinds = table(spark, d, "events").select("event_type").distinct()
    first = F.array_position(F.array(F.lit("error"), F.lit("click")), F.col("event_type"))
    return kinds.select("event_type", F.row_number().over(Window.orderBy(F.when(first > 0, first).otherwise(9), "event_type")).alias("place"))


@query("W12_limit_per_clip", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k <= 2")
def w12(spark, d):
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, d, "lineitem").withColumn("k", k).where("k <= 2").select("l_orderkey", "l_linenumber", "l_partkey")


# --- reports

@query("A11_distribution", sql(FEATURES, select="SELECT count(*) AS n, round(avg(max_speed), 6) AS mean, round(stddev_pop(max_speed), 6) AS std, round(min(max_speed), 6) AS min, round(quantile_cont(max_speed, 0.05), 6) AS p5, round(quantile_cont(max_speed, 0.5), 6) AS p50, round(quantile_cont(max_speed, 0.95), 6) AS p95, round(max(max_speed), 6) AS max FROM features"))
def a11(spark, d):
    f, v = features(spark, d), F.col("max_speed")
    one = f.agg(F.count("*").alias("n"), r6("mean", F.avg(v)), r6("std", F.stddev_pop(v)), r6("min", F.min(v)), r6("max", F.max(v)))
    places = quantiles(f, "max_speed", {f"p{p}": p / 100 for p in (5, 50, 95)})
    return one.crossJoin(F.broadcast(places)).select("n", "mean", "std", "min", *map(r6, places.columns), "max")


@query("A12_class_balance", sql(ANSWERS, select="SELECT question_id, answer, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY question_id), 6) AS fraction FROM answers GROUP BY question_id, answer"))
def a12(spark, d):
    n = ad.answers(spark, d).groupBy("question_id", "answer").agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("question_id")), 6))


@query("A13_answer_counts", sql(ANSWERS, select="SELECT source, question_id, answer, count(*) AS n FROM answers GROUP BY source, question_id, answer"))
def a13(spark, d):
    return ad.answers(spark, d).groupBy("source", "question_id", "answer").agg(F.count("*").alias("n"))


@query("A14_positive_fraction", sql(ANSWERS, select="SELECT question_id, round(avg(CASE WHEN source = 'real' THEN (answer IN ('F', 'high', '1-URGENT'))::INT END), 6) AS real, round(avg((answer IN ('F', 'high', '1-URGENT'))::INT), 6) AS overall FROM answers GROUP BY question_id"))
def a14(spark, d):
    hit = F.col("answer").isin("F", "high", "1-URGENT").cast("double")
    return ad.answers(spark, d).groupBy("question_id").agg(r6("real", F.avg(F.when(F.col("source") == "real", hit))), r6("overall", F.avg(hit)))


@query("A15_source_summary", sql(FEATURES, select=", s AS (SELECT *, CASE WHEN clip_id % 2 = 0 THEN 'real' ELSE 'simulated' END AS source FROM features) SELECT coalesce(source, 'all') AS source, count(*) AS n, round(avg(max_speed), 6) AS mean FROM s GROUP BY ROLLUP(source)"))
def a15(spark, d):
    s = features(spark, d).withColumn("source", F.when(F.col("clip_id") % 2 == 0, "real").otherwise("simulated"))
    return s.rollup("source").agg(F.count("*").alias("n"), r6("mean", F.avg("max_speed"))).select(F.coalesce("source", F.lit("all")).alias("source"), "n", "mean")


@query("A16_entropy", sql(ANSWERS, select=", n AS (SELECT question_id, count(*) AS n FROM answers GROUP BY question_id, answer), p AS (SELECT question_id, n::DOUBLE / sum(n) OVER (PARTITION BY question_id) AS p FROM n) SELECT question_id, round(CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-p * ln(p)) / ln(count(*)) END, 6) AS entropy FROM p GROUP BY question_id"))
def a16(spark, d):
    n = ad.answers(spark, d).groupBy("question_id", "answer").agg(F.count("*").alias("n"))
    return sel.normalised_entropy(n, ["question_id"]).select("question_id", r6("entropy"))


_CORR = ("max_speed", "mean_speed", "min_accel", "max_abs_yaw_rate", "max_abs_jerk")


@query("A17_correlations", sql(FEATURES, select=" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) AS r FROM features" for k, a in enumerate(_CORR) for b in _CORR[k + 1 :])))
def a17(spark, d):
    pairs = [(a, b) for k, a in enumerate(_CORR) for b in _CORR[k + 1 :]]
    one = features(spark, d).agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 5).alias("r")) for a, b in pairs]).alias("x"))
    return one.select(F.inline("x"))


@query("A18_jaccard_tags", sql(ANSWERS, select=_TAGS + " SELECT round(count(*) FILTER (WHERE a = 1 AND b = 1)::DOUBLE / nullif(count(*) FILTER (WHERE a = 1 OR b = 1), 0), 6) AS turn_braking, round(count(*) FILTER (WHERE a = 1 AND c = 1)::DOUBLE / nullif(count(*) FILTER (WHERE a = 1 OR c = 1), 0), 6) AS turn_aggressive FROM tags"))
def a18(spark, d):
    both = lambda x, y: F.count_if((F.col(x) == 1) & (F.col(y) == 1)) / F.nullif(F.count_if((F.col(x) == 1) | (F.col(y) == 1)), F.lit(0))
    return _tags(spark, d).agg(r6("turn_braking", both("a", "b")), r6("turn_aggressive", both("a", "c")))


@query("A19_behaviour_means", "SELECT event_type, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY event_type")
def a19(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(r6("mean_value", F.avg("value")), F.count("*").alias("n"))


@query("A20_hit_rates", sql(FEATURES, select="SELECT q.name, round(avg(CASE WHEN q.name = 'fast' THEN (max_speed > q.v)::INT ELSE (max_abs_jerk > q.v)::INT END), 6) AS rate FROM features CROSS JOIN (VALUES ('fast', 11.0::DOUBLE), ('jerky', 6.5)) q(name, v) GROUP BY q.name"))
def a20(spark, d):
    limits = F.explode(F.array(F.struct(F.lit("fast").alias("name"), (F.col("max_speed") > 11.0).alias("hit")), F.struct(F.lit("jerky").alias("name"), (F.col("max_abs_jerk") > 6.5).alias("hit"))))
    return features(spark, d).select(limits.alias("x")).groupBy("x.name").agg(r6("rate", F.avg(F.col("x.hit").cast("double"))))


@query("A21_items_per_clip", "SELECT round(avg(n), 6) AS mean, round(median(n), 6) AS median, min(n) AS min, max(n) AS max FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def a21(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    one = n.agg(r6("mean", F.avg("n")), F.min("n").alias("min"), F.max("n").alias("max"))
    return one.crossJoin(F.broadcast(quantiles(n, "n", {"median": 0.5}))).select("mean", r6("median"), "min", "max")


@query("A22_composition", "SELECT p_type AS behaviour, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS fraction FROM part GROUP BY p_type")
def a22(spark, d):
    clip = F.concat(F.lit("town__"), "p_type", F.lit("__w1"))
    n = table(spark, d, "part").select(F.split(clip, "__")[1].alias("behaviour")).groupBy("behaviour").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("behaviour", "n", r6("fraction", F.col("n") / F.col("_all")))


@query("A23_zero_filled", sql(ANSWERS, select="SELECT k.label, count(a.clip_id) AS n FROM (VALUES ('low'), ('medium'), ('high'), ('none')) k(label) LEFT JOIN answers a ON a.answer = k.label AND a.question_id = 'price' GROUP BY k.label"))
def a23(spark, d):
    labels = spark.createDataFrame([(x,) for x in ("low", "medium", "high", "none")], "label string")
    n = ad.answers(spark, d).where("question_id = 'price'").groupBy(F.col("answer").alias("label")).agg(F.count("*").alias("n"))
    return labels.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("A24_latency_summary", "SELECT event_type, max(CASE WHEN k = n // 2 THEN value END) AS median, max(CASE WHEN k = floor(0.95 * n)::BIGINT THEN value END) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def a24(spark, d):
    """The upper median and the 95th percentile as picked places, not interpolated."""
    return quantiles(table(spark, d, "events"), "value", {"median": 0.5, "p95": 0.95}, by=("event_type",), between=False)


_SIGNS = """
, g AS (SELECT clip_id, avg(yaw_rate) AS rate, sum(yaw_rate * 0.1) - arg_min(yaw_rate, i) * 0.1 AS turned, max(abs(yaw_rate)) AS most, min(accel) AS least, avg(accel) AS mean, arg_max(speed, i) - arg_min(speed, i) AS gained FROM series GROUP BY clip_id),
t AS (SELECT * FROM g ORDER BY most DESC, clip_id LIMIT 50), b AS (SELECT * FROM g ORDER BY least, clip_id LIMIT 20),
n AS (SELECT 'turning' AS convention, count(*) AS n, count(*) FILTER (WHERE sign(rate) = sign(turned)) AS agree, count(*) FILTER (WHERE sign(rate) <> sign(turned)) AS differ FROM t
  UNION ALL SELECT 'braking', count(*), count(*) FILTER (WHERE mean < 0 AND gained < 0), count(*) FILTER (WHERE mean < 0 AND gained > 0) FROM b),
signs AS (SELECT *, CASE WHEN convention = 'braking' AND agree = 0 THEN 'insufficient_data' WHEN agree::DOUBLE / (agree + differ) > CASE convention WHEN 'turning' THEN 0.9 ELSE 0.7 END THEN 'correct' ELSE 'inconsistent' END AS verdict FROM n)
"""


def _heading(spark, d):
    """The series with its heading: the yaw rate summed up over the samples."""
    w = Window.partitionBy("clip_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ad.series(spark, d).withColumn("yaw", F.sum(F.col("yaw_rate") * 0.1).over(w))


@query("A29_sign_convention", sql(SERIES, select=_SIGNS + "SELECT * FROM signs"))
def a29(spark, d):
    """Both checks with their verdicts."""
    return conventions.sign_report(_heading(spark, d))


@query("K09_sign_report", sql(SERIES, select=_SIGNS + """SELECT '# Sign conventions' || chr(10) || chr(10) || '| convention | clips | agree | differ | verdict |' || chr(10) || '|---|---|---|---|---|' || chr(10) || string_agg('| ' || convention || ' | ' || n || ' | ' || agree || ' | ' || differ || ' | ' || verdict || ' |', chr(10) ORDER BY convention)
  || chr(10) || chr(10) || CASE WHEN bool_and(verdict = 'correct') THEN 'No fix is needed.' ELSE 'To be looked into.' END AS report FROM signs"""))
def k09_signs(spark, d):
    """The report of both checks, written as text and read again."""
    path = place(spark, "report")
    conventions.as_report(conventions.sign_report(_heading(spark, d))).write.text(path)
    return spark.read.text(path, wholetext=True).select(F.rtrim(F.regexp_replace("value", "\\n$", "")).alias("report"))


@query("A30_equal_frequency", sql(FEATURES, select=", q AS (SELECT quantile_cont(min_accel, 0.25) AS a, quantile_cont(min_accel, 0.5) AS b, quantile_cont(min_accel, 0.75) AS c FROM features) SELECT CASE WHEN min_accel < a THEN 0 WHEN min_accel < b THEN 1 WHEN min_accel < c THEN 2 ELSE 3 END AS class, count(*) AS n FROM features, q GROUP BY class"))
def a30(spark, d):
    f = features(spark, d).select("min_accel")
    cuts = quantiles(f, "min_accel", {"a": 0.25, "b": 0.5, "c": 0.75})
    label = F.when(F.col("min_accel") < F.col("a"), 0).when(F.col("min_accel") < F.col("b"), 1).when(F.col("min_accel") < F.col("c"), 2).otherwise(3)
    return f.crossJoin(F.broadcast(cuts)).groupBy(label.alias("class")).agg(F.count("*").alias("n"))


@query("A31_threshold_table", sql(FEATURES, select=", q AS (SELECT p, quantile_cont(max_speed, p) AS v FROM features, (VALUES (0.1::DOUBLE), (0.5), (0.9)) k(p) GROUP BY p) SELECT p, count(*) FILTER (WHERE max_speed < v) AS below, count(*) FILTER (WHERE max_speed >= v) AS above FROM features, q GROUP BY p").replace("quantile_cont(max_speed, p) AS v FROM features, (VALUES (0.1::DOUBLE), (0.5), (0.9)) k(p) GROUP BY p", "CASE p WHEN 0.1 THEN a WHEN 0.5 THEN b ELSE c END AS v FROM (SELECT quantile_cont(max_speed, 0.1) AS a, quantile_cont(max_speed, 0.5) AS b, quantile_cont(max_speed, 0.9) AS c FROM features), (VALUES (0.1::DOUBLE), (0.5), (0.9)) k(p)"))
def a31(spark, d):
    f = features(spark, d).select("max_speed")
    cuts = quantiles(f, "max_speed", {f"v{k}": p for k, p in enumerate((0.1, 0.5, 0.9))})
    cuts = cuts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"v{k}").alias("v")) for k, p in enumerate((0.1, 0.5, 0.9))])).alias("x")).select("x.p", "x.v")
    below = F.col("max_speed") < F.col("v")
    return f.crossJoin(F.broadcast(cuts)).groupBy("p").agg(F.count_if(below).alias("below"), F.count_if(~below).alias("above"))


@query("A32_rule_sensitivity", sql(SERIES, select=", c AS (SELECT clip_id, q.stop, i, speed > 6 AS go FROM series CROSS JOIN (VALUES (0.5::DOUBLE), (1.0), (2.0)) q(stop) WHERE speed < q.stop OR speed > 6), k AS (SELECT stop, go AND NOT coalesce(lag(go) OVER (PARTITION BY clip_id, stop ORDER BY i), TRUE) AS cyc FROM c) SELECT stop, sum(cyc::INT)::BIGINT AS cycles FROM k GROUP BY stop"))
def a32(spark, d):
    s = ad.series(spark, d).withColumn("stop", F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0)))))
    e = s.where((F.col("speed") < F.col("stop")) | (F.col("speed") > 6)).withColumn("go", F.col("speed") > 6)
    before = F.lag("go").over(Window.partitionBy("clip_id", "stop").orderBy("i"))
    return e.withColumn("cyc", F.col("go") & ~F.coalesce(before, F.lit(True))).groupBy("stop").agg(F.sum(F.col("cyc").cast("int")).cast("long").alias("cycles"))


@query("A32_sequence_rates", sql(SERIES, select="""
, p AS (SELECT a.clip_id, min(a.t) AS t1, arg_min(b.t, a.t * 1e6 + b.t) - min(a.t) AS gap FROM series a JOIN series b ON a.clip_id = b.clip_id AND b.t BETWEEN a.t + 1e-6 AND a.t + 1.45 WHERE a.accel < -2.5 AND abs(b.yaw_rate) > 0.13 GROUP BY a.clip_id),
c AS (SELECT clip_id, bool_or(accel < -2.5) AS a, bool_or(abs(yaw_rate) > 0.13) AS b FROM series GROUP BY clip_id)
SELECT count(*) AS clips, count(*) FILTER (WHERE a) AS with_first, count(*) FILTER (WHERE b) AS with_second, count(gap) AS with_sequence, round(min(gap), 6) AS least, round(avg(gap), 6) AS mean, round(max(gap), 6) AS most FROM c LEFT JOIN p USING (clip_id)"""))
def a32_sequence(spark, d):
    """How many clips have each event, both in sequence, and the gaps."""
    s = ad.series(spark, d)
    first, second = {"signal": "accel", "operator": "less_than", "threshold": -2.5}, {"signal": "yaw_rate", "operator": "abs_greater_than", "threshold": 0.13}
    found = rules.sequential_event(s, first, second, (0.0, 1.45))
    out = conventions.event_rates(s, found, F.col("accel") < -2.5, F.abs("yaw_rate") > 0.13)
    return out.select("clips", "with_first", "with_second", "with_sequence", r6("least"), r6("mean"), r6("most"))


@query("A32_stop_table", sql(SERIES, select="""
, c AS (SELECT clip_id, q.stop, i, speed > 6 AS go FROM series CROSS JOIN (VALUES (0.3::DOUBLE), (0.5), (0.8), (1.0), (1.5)) q(stop) WHERE speed < q.stop OR speed > 6), k AS (SELECT clip_id, stop, go AND NOT coalesce(lag(go) OVER (PARTITION BY clip_id, stop ORDER BY i), TRUE) AS cyc FROM c),
n AS (SELECT clip_id, stop, sum(cyc::INT) AS cycles FROM k GROUP BY clip_id, stop) SELECT q.stop, count(n.clip_id) AS yes, (SELECT count(DISTINCT clip_id) FROM series) - count(n.clip_id) AS no FROM (VALUES (0.3::DOUBLE), (0.5), (0.8), (1.0), (1.5)) q(stop) LEFT JOIN n ON n.stop = q.stop AND n.cycles >= 3 GROUP BY q.stop"""))
def a32_stops(spark, d):
    return conventions.stop_table(ad.series(spark, d), [0.3, 0.5, 0.8, 1.0, 1.5], 6.0, 3)


@query("A32_similarity", sql(SERIES, select="""
, m AS (SELECT clip_id, sqrt(avg(CASE WHEN i < 32 THEN accel * accel END)) AS a, sqrt(avg(CASE WHEN i >= 32 THEN accel * accel END)) AS b FROM series GROUP BY clip_id), r AS (SELECT *, abs(a - b) / greatest(a, b, 1e-9) AS r FROM m)
SELECT q.t AS threshold, count(*) FILTER (WHERE r < q.t) AS similar, count(*) FILTER (WHERE r >= q.t AND a > b) AS first, count(*) FILTER (WHERE r >= q.t AND a <= b) AS second FROM r CROSS JOIN (VALUES (0.05::DOUBLE), (0.1), (0.15), (0.2), (0.25), (0.3), (0.4), (0.5)) q(t) GROUP BY q.t"""))
def a32_similarity(spark, d):
    return conventions.similarity_table(rules.half_comparison(ad.series(spark, d)), [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5])


@query("A32_ratio", sql(SERIES, select="""
, m AS (SELECT clip_id, sqrt(avg(accel * accel)) AS a, sqrt(avg(pow(speed * abs(yaw_rate), 2))) AS l FROM series GROUP BY clip_id)
SELECT q.t AS threshold, count(*) FILTER (WHERE l / a <= q.t) AS longitudinal, count(*) FILTER (WHERE l / a > q.t) AS lateral FROM m CROSS JOIN (VALUES (0.15::DOUBLE), (0.2), (0.25), (0.3), (0.5), (1.0)) q(t) WHERE a > 1e-9 GROUP BY q.t"""))
def a32_ratio(spark, d):
    return conventions.ratio_table(rules.dominant_axis(ad.series(spark, d)), [0.15, 0.2, 0.25, 0.3, 0.5, 1.0])


@query("A38_split_report", sql(ANSWERS, select="SELECT question_id, answer, count(*) FILTER (WHERE clip_id % 5 <> 0) AS train, count(*) FILTER (WHERE clip_id % 5 = 0) AS val FROM answers GROUP BY question_id, answer"))
def a38(spark, d):
    s = ad.answers(spark, d).withColumn("split", F.when(F.col("clip_id") % 5 == 0, "val").otherwise("train"))
    return s.groupBy("question_id", "answer").pivot("split", ["train", "val"]).agg(F.count(F.lit(1))).na.fill(0)


@query("A39_generation_summary", sql(ANSWERS, select="SELECT question_id, count(*) AS n, round(count(*)::DOUBLE / count(DISTINCT clip_id), 6) AS per_clip FROM answers GROUP BY question_id"))
def a39(spark, d):
    return ad.answers(spark, d).groupBy("question_id").agg(F.count("*").alias("n"), r6("per_clip", F.count("*") / F.count_distinct("clip_id")))


@query("A41_plot_range", sql(FEATURES, select="SELECT round(quantile_cont(max_speed, 0.01) - 0.1 * greatest(abs(quantile_cont(max_speed, 0.01)), abs(quantile_cont(max_speed, 0.99))), 6) AS low, round(quantile_cont(max_speed, 0.99) + 0.1 * greatest(abs(quantile_cont(max_speed, 0.01)), abs(quantile_cont(max_speed, 0.99))), 6) AS high FROM features"))
def a41(spark, d):
    g = quantiles(features(spark, d), "max_speed", {"a": 0.01, "b": 0.99})
    margin = 0.1 * F.greatest(F.abs("a"), F.abs("b"))
    return g.select(r6("low", F.col("a") - margin), r6("high", F.col("b") + margin))


@query("S09_record_per_clip", sql(ANSWERS, select="SELECT clip_id, string_agg(question_id || '=' || answer, ',' ORDER BY question_id) AS answers FROM answers GROUP BY clip_id"))
def s09(spark, d):
    return ad.answers(spark, d).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.concat("question_id", F.lit("="), "answer"))).alias("a")).select("clip_id", F.array_join("a", ",").alias("answers"))


@query("S13_backfill", sql(SERIES, select="SELECT clip_id, round(coalesce(CASE WHEN clip_id % 3 = 0 THEN 0.5::DOUBLE END, max(speed)), 6) AS max_speed FROM series GROUP BY clip_id"))
def s13(spark, d):
    known = F.when(F.col("clip_id") % 3 == 0, 0.5)
    return ad.series(spark, d).groupBy("clip_id").agg(F.max("speed").alias("m")).select("clip_id", r6("max_speed", F.coalesce(known, "m")))
