"""Scoring, consistency, sensitivity and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinegrid.operators import bootstrap as bs
from kinegrid.operators import metrics as m
from kinegrid.operators.agreement import kendall_tau
from kinegrid.plans.prelude import ANSWERS, CLASSES, FEATURES, sql
from kinegrid.registry import query
from kinegrid.sources import adapters as ad


def r6(name: str, column=None):
    return F.round(F.col(name) if column is None else column, 6).alias(name)


def _counts(keys: str) -> str:
    """Label counts in SQL by the given keys."""
    k = f"{keys}, " if keys else ""
    return f"""
, sides AS (SELECT {k}oracle AS label, (oracle = pred)::INT AS hit, 1 AS o, 0 AS p FROM classes UNION ALL SELECT {k}pred, 0, 0, 1 FROM classes),
counts AS (SELECT {k}label, sum(hit) AS tp, sum(o) AS n_oracle, sum(p) AS n_pred FROM sides GROUP BY {k}label)
"""


_BACC = "round(avg(CASE WHEN n_oracle > 0 THEN tp::DOUBLE / n_oracle END), 6) AS balanced_accuracy"
_F1 = "round(avg(2.0::DOUBLE * tp / (n_oracle + n_pred)), 6) AS macro_f1"
_ALL = f"sum(n_oracle)::BIGINT AS n, round(sum(tp)::DOUBLE / sum(n_oracle), 6) AS accuracy, {_BACC}, {_F1}"


def _rounded(df, *keys):
    return df.select(*keys, F.col("n").cast("long").alias("n"), r6("accuracy"), r6("balanced_accuracy"), r6("macro_f1"))


@query("A03_semantic_accuracy", sql(CLASSES, select="SELECT model, count(*) AS n, round(avg((oracle = pred)::INT), 6) AS accuracy FROM classes GROUP BY model"))
def a03(spark, d):
    return m.accuracy(ad.classes(spark, d), ["model"]).select("model", "n", r6("accuracy"))


@query("A04_confusion_matrix", sql(CLASSES, select="SELECT a.l AS oracle, b.l AS pred, count(c.clip_id) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) a(l) CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) b(l) LEFT JOIN classes c ON c.oracle = a.l AND c.pred = b.l GROUP BY a.l, b.l"))
def a04(spark, d):
    return m.confusion(ad.classes(spark, d), ["F", "O", "P", "X"])


@query("A05_macro_f1", sql(CLASSES, select=_counts("model") + f"SELECT model, {_F1} FROM counts GROUP BY model"))
def a05(spark, d):
    return m.macro_f1(m.label_counts(ad.classes(spark, d), ["model"]), ["model"]).select("model", r6("macro_f1"))


@query("A06_balanced_accuracy", sql(CLASSES, select=_counts("model") + f"SELECT model, {_BACC} FROM counts GROUP BY model"))
def a06(spark, d):
    return m.balanced_accuracy(m.label_counts(ad.classes(spark, d), ["model"]), ["model"]).select("model", r6("balanced_accuracy"))


@query("A07_group_metrics", sql(CLASSES, select=_counts("model, source") + f"SELECT model, source, {_ALL} FROM counts GROUP BY model, source"))
def a07(spark, d):
    return _rounded(m.group_metrics(ad.classes(spark, d), ["model", "source"]), "model", "source")


def _scope(name: str, column: str) -> str:
    return f"SELECT '{name}' AS scope, {column} AS key, oracle, pred FROM classes"


_SCOPES = " UNION ALL ".join(_scope(*x) for x in (("global", "''"), ("category", "category"), ("question_id", "question_id"), ("source", "source")))


#: Labels that count for a question; the third has none and takes those that occur.
CHOICES = {"A": ["F", "O", "P", "X"], "N": ["O"]}
_CHOICES = "choices AS (SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{label}')" for q, own in CHOICES.items() for label in own) + ") c(key, label))"


@query("A08_multi_grouping", sql(CLASSES, select=f"""
, {_CHOICES}, scoped AS ({_SCOPES} UNION ALL SELECT 'temporal', '', oracle, pred FROM classes WHERE question_id IN ('N', 'R')), whole AS (SELECT scope, key, count(*) AS n, round(avg((oracle = pred)::INT), 6) AS accuracy FROM scoped GROUP BY scope, key),
sides AS (SELECT scope, key, oracle AS label, (oracle = pred)::INT AS hit, 1 AS o, 0 AS p FROM scoped UNION ALL SELECT scope, key, pred, 0, 0, 1 FROM scoped
  UNION ALL SELECT 'question_id', key, label, 0, 0, 0 FROM choices),
counts AS (SELECT scope, key, label, sum(hit) AS tp, sum(o) AS n_oracle, sum(p) AS n_pred FROM sides s
  WHERE scope <> 'question_id' OR key NOT IN (SELECT key FROM choices) OR EXISTS (SELECT 1 FROM choices c WHERE c.key = s.key AND c.label = s.label) GROUP BY scope, key, label),
scored AS (SELECT scope, key, {_BACC}, round(avg(CASE WHEN n_oracle + n_pred > 0 THEN 2.0::DOUBLE * tp / (n_oracle + n_pred) ELSE 0 END), 6) AS macro_f1 FROM counts GROUP BY scope, key)
SELECT scope, key, n, accuracy, coalesce(balanced_accuracy, 0) AS balanced_accuracy, macro_f1 FROM whole JOIN scored USING (scope, key)"""))
def a08(spark, d):
    """All scopes of an evaluation: global, temporal, by category, by question over its choices, by source."""
    return _rounded(m.multi_group_metrics(ad.classes(spark, d), ["category", "question_id", "source"], temporal=["N", "R"], choices=CHOICES), "scope", "key")


RULES = [
    ("urgent_is_open", "priority", "eq", "1-URGENT", "status", "eq", "O"),
    ("high_not_filled", "price", "eq", "high", "status", "neq", "F"),
    ("never", "price", "eq", "none", "status", "eq", "O"),
]
_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in RULES) + ") q(name, if_qid, if_op, if_val, then_qid, then_op, then_val))"
_CHECKS = """checks AS (SELECT a.clip_id, r.name, NOT (CASE WHEN r.then_op = 'eq' THEN b.answer = r.then_val ELSE b.answer <> r.then_val END) AS violated
FROM rules r JOIN answers a ON a.question_id = r.if_qid AND (CASE WHEN r.if_op = 'eq' THEN a.answer = r.if_val ELSE a.answer <> r.if_val END) JOIN answers b ON b.clip_id = a.clip_id AND b.question_id = r.then_qid)"""


def _rules(spark):
    return spark.createDataFrame(RULES, m.RULE)


@query("J13_rule_checks", sql(ANSWERS, _RULES, _CHECKS, select="SELECT * FROM checks"))
def j13(spark, d):
    return m.rule_checks(ad.answers(spark, d), _rules(spark))


@query("A09_consistency", sql(ANSWERS, _RULES, _CHECKS, select="""
, c AS (SELECT clip_id, count(*) FILTER (WHERE violated) AS v FROM checks GROUP BY clip_id), k AS (SELECT count(*) AS n, count(*) FILTER (WHERE v = 0) AS clean, avg(v) AS mv FROM c),
r AS (SELECT rules.name, count(checks.name) AS n, count(*) FILTER (WHERE violated) AS v FROM rules LEFT JOIN checks ON rules.name = checks.name GROUP BY rules.name),
a AS (SELECT avg((n > 0)::INT) AS cov, avg(CASE WHEN n > 0 THEN 1 - v::DOUBLE / n ELSE 1 END) AS mc FROM r), t AS (SELECT count(DISTINCT clip_id) AS clips FROM answers)
SELECT round(clean::DOUBLE / n, 4) AS rate, round(round(clean::DOUBLE / n, 4) * cov, 4) AS wemcr, round(mc, 4) AS mean_compliance, round(n::DOUBLE / clips, 4) AS coverage, round(mv, 4) AS mean_violations FROM k, a, t"""))
def a09(spark, d):
    return m.consistency(ad.answers(spark, d), _rules(spark))


@query("A34_rule_compliance", sql(ANSWERS, _RULES, _CHECKS, select="""
SELECT rules.name, count(checks.name) AS n_applicable, count(*) FILTER (WHERE violated) AS n_violations, round(CASE WHEN count(checks.name) > 0 THEN 1 - (count(*) FILTER (WHERE violated))::DOUBLE / count(checks.name) ELSE 1 END, 6) AS compliance FROM rules LEFT JOIN checks ON rules.name = checks.name GROUP BY rules.name"""))
def a34(spark, d):
    out = m.rule_compliance(m.rule_checks(ad.answers(spark, d), _rules(spark)), _rules(spark))
    return out.select("name", "n_applicable", "n_violations", r6("compliance"))


@query("A10_coverage", sql(CLASSES, select="SELECT model, count(*) AS total, count(*) FILTER (WHERE pred = 'O') AS parsed, round((count(*) FILTER (WHERE pred = 'O'))::DOUBLE / count(*), 6) AS coverage FROM classes GROUP BY model"))
def a10(spark, d):
    parsed = F.count_if(F.col("pred") == "O")
    return ad.classes(spark, d).groupBy("model").agg(F.count("*").alias("total"), parsed.alias("parsed"), r6("coverage", parsed / F.count("*")))


@query("A25_flip_rate", sql(FEATURES, select="""
, f AS (SELECT clip_id, q.f, min_accel < -2.9 AS base, min_accel < -2.9 * q.f AS scaled FROM features CROSS JOIN (VALUES (0.5::DOUBLE), (0.9), (1.1), (1.5)) q(f))
SELECT f AS factor, count(*) FILTER (WHERE base <> scaled) AS flips, round((count(*) FILTER (WHERE base <> scaled))::DOUBLE / count(*), 6) AS rate FROM f GROUP BY f"""))
def a25(spark, d):
    from kinegrid.plans.q_rules import features

    made = features(spark, d).withColumn("factor", F.explode(F.array(*map(F.lit, (0.5, 0.9, 1.1, 1.5)))))
    flipped = (F.col("min_accel") < -2.9) != (F.col("min_accel") < -2.9 * F.col("factor"))
    return made.groupBy("factor").agg(F.count_if(flipped).alias("flips"), r6("rate", F.count_if(flipped) / F.count("*")))


@query("A26_kendall_tau", sql(CLASSES, select="""
, s AS (SELECT model, avg((oracle = pred)::INT) AS a, count(*) AS b FROM classes GROUP BY model), p AS (SELECT sign(x.a - y.a) * sign(x.b - y.b) AS s FROM s x JOIN s y ON x.model < y.model)
SELECT round(CASE WHEN count(*) FILTER (WHERE s <> 0) = 0 THEN 1.0::DOUBLE ELSE (count(*) FILTER (WHERE s > 0) - count(*) FILTER (WHERE s < 0))::DOUBLE / count(*) FILTER (WHERE s <> 0) END, 6) AS tau FROM p"""))
def a26(spark, d):
    """Two rankings of the models, by accuracy and by number of answers."""
    s = m.accuracy(ad.classes(spark, d), ["model"])
    return kendall_tau(s.select("model", F.col("accuracy").alias("rank")), s.select("model", F.col("n").alias("rank")), "model").select(r6("tau"))


@query("A26_part_rankings", """
WITH s AS (SELECT p_partkey, p_retailprice::DOUBLE AS a, p_size AS b FROM part), p AS (SELECT sign(x.a - y.a) * sign(x.b - y.b) AS s FROM s x JOIN s y ON x.p_partkey < y.p_partkey)
SELECT round((count(*) FILTER (WHERE s > 0) - count(*) FILTER (WHERE s < 0))::DOUBLE / count(*) FILTER (WHERE s <> 0), 6) AS tau, count(*) FILTER (WHERE s > 0) AS concordant, count(*) FILTER (WHERE s < 0) AS discordant FROM p""")
def a26_parts(spark, d):
    """All parts ranked by price and by size: many ties, pairs counted as inversions."""
    part = ad.table(spark, d, "part")
    one, two = part.select("p_partkey", F.col("p_retailprice").cast("double").alias("rank")), part.select("p_partkey", F.col("p_size").alias("rank"))
    out = kendall_tau(one, two, "p_partkey")
    return out.select(r6("tau"), F.col("concordant").cast("long").alias("concordant"), F.col("discordant").cast("long").alias("discordant"))


@query("A27_relative_change", sql(FEATURES, select="""
, c AS (SELECT q.f, count(*) FILTER (WHERE min_accel < -2.9 * q.f)::DOUBLE AS n FROM features CROSS JOIN (VALUES (1.0::DOUBLE), (0.9), (1.1)) q(f) GROUP BY q.f)
SELECT round(max(abs(c.n - b.n) / b.n), 6) AS max_change, round(avg(abs(c.n - b.n) / b.n), 6) AS mean_change FROM c JOIN c b ON b.f = 1.0 AND b.n > 0 WHERE c.f <> 1.0"""))
def a27(spark, d):
    from kinegrid.plans.q_rules import features

    made = features(spark, d).withColumn("factor", F.explode(F.array(*map(F.lit, (1.0, 0.9, 1.1)))))
    n = made.groupBy("factor").agg(F.count_if(F.col("min_accel") < -2.9 * F.col("factor")).cast("double").alias("n"))
    base = n.where("factor = 1.0 AND n > 0").select(F.col("n").alias("b"))
    change = F.abs(F.col("n") - F.col("b")) / F.col("b")
    return n.where("factor <> 1.0").crossJoin(F.broadcast(base)).agg(r6("max_change", F.max(change)), r6("mean_change", F.avg(change)))


_SCORED = """scored AS (SELECT q.model, clip_id, question_id, answer AS oracle, CASE WHEN (clip_id * 7 + length(question_id) * 3 + q.shift) % 5 = 0 THEN CASE question_id WHEN 'status' THEN 'O' WHEN 'priority' THEN '1-URGENT' ELSE 'high' END ELSE answer END AS pred
  FROM answers CROSS JOIN (VALUES ('a', 0), ('b', 2)) q(model, shift))"""
_REPLICATES = sql(ANSWERS, _RULES, _SCORED, select="""
, checks AS (SELECT a.model, a.clip_id, r.name, NOT (CASE WHEN r.then_op = 'eq' THEN b.pred = r.then_val ELSE b.pred <> r.then_val END) AS violated
  FROM rules r JOIN scored a ON a.question_id = r.if_qid AND (CASE WHEN r.if_op = 'eq' THEN a.pred = r.if_val ELSE a.pred <> r.if_val END) JOIN scored b ON b.model = a.model AND b.clip_id = a.clip_id AND b.question_id = r.then_qid),
drawn AS (SELECT clip_id, b, ('0x' || substr(md5((b // 4) || ':' || clip_id), 1 + 8 * (b % 4)::INT, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT clip_id FROM scored) CROSS JOIN generate_series(0, 19) g(b)),
w AS (SELECT clip_id, b, CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.9196986 THEN 2 WHEN u < 0.98101184 THEN 3 WHEN u < 0.99634015 THEN 4 ELSE 5 END AS k FROM drawn),
recall AS (SELECT model, b, oracle, sum(k * (oracle = pred)::INT)::DOUBLE / nullif(sum(k), 0) AS r FROM scored JOIN w USING (clip_id) GROUP BY model, b, oracle),
bacc AS (SELECT model, b, coalesce(avg(r), 0) AS balanced_accuracy FROM recall GROUP BY model, b),
clip AS (SELECT model, clip_id, bool_or(violated) AS bad FROM checks GROUP BY model, clip_id),
rate AS (SELECT model, b, round(coalesce(sum(CASE WHEN bad THEN 0 ELSE k END)::DOUBLE / nullif(sum(k), 0), 0), 4) AS rate FROM clip JOIN w USING (clip_id) GROUP BY model, b),
used AS (SELECT model, b, name, sum(k) AS k FROM checks JOIN w USING (clip_id) GROUP BY model, b, name),
cover AS (SELECT model, b, count(*) FILTER (WHERE k > 0)::DOUBLE / (SELECT count(*) FROM rules) AS c FROM used GROUP BY model, b),
replicates AS (SELECT model, b AS replicate, balanced_accuracy, round(rate * c, 4) AS wpcr FROM bacc JOIN rate USING (model, b) JOIN cover USING (model, b))
""")


def scored(spark, d):
    """Answers of two models to the questions on each customer's first order; a fifth of them are changed."""
    models = spark.createDataFrame([("a", 0), ("b", 2)], "model string, shift int")
    other = F.when(F.col("question_id") == "status", "O").when(F.col("question_id") == "priority", "1-URGENT").otherwise("high")
    changed = (F.col("clip_id") * 7 + F.length("question_id") * 3 + F.col("shift")) % 5 == 0
    both = ad.answers(spark, d).crossJoin(F.broadcast(models))
    return both.select("model", "clip_id", "question_id", F.col("answer").alias("oracle"), F.when(changed, other).otherwise(F.col("answer")).alias("pred"))


@query("A28_bootstrap", _REPLICATES + ", long AS (SELECT model, 'balanced_accuracy' AS metric, balanced_accuracy AS v FROM replicates UNION ALL SELECT model, 'wpcr', wpcr FROM replicates) SELECT model, metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM long GROUP BY model, metric")
def a28(spark, d):
    """Clips are resampled by draws from a hash of replicate and clip; no row is copied for a replicate."""
    return bs.bootstrap(scored(spark, d), RULES, 20).select("model", "metric", *map(r6, ("mean", "low", "high")))


@query("A36_replicates", _REPLICATES + "SELECT model, replicate, round(balanced_accuracy, 6) AS balanced_accuracy, wpcr FROM replicates")
def a36_replicates(spark, d):
    """Both statistics of every replicate."""
    found = bs.replicate_metrics(bs.replicate_sums(bs.clip_cells(scored(spark, d), RULES), 20))
    return found.select("model", F.col("replicate").cast("long").alias("replicate"), r6("balanced_accuracy"), "wpcr")


@query("W04_leaderboard", sql(CLASSES, select=_counts("model") + f"SELECT row_number() OVER (ORDER BY b DESC, model) AS rank, model, n, round(b, 6) AS balanced_accuracy FROM (SELECT model, sum(n_oracle)::BIGINT AS n, avg(CASE WHEN n_oracle > 0 THEN tp::DOUBLE / n_oracle END) AS b FROM counts GROUP BY model)"))
def w04(spark, d):
    g = m.group_metrics(ad.classes(spark, d), ["model"])
    rank = F.row_number().over(Window.orderBy(F.desc("balanced_accuracy"), "model"))
    return g.select(rank.alias("rank"), "model", F.col("n").cast("long").alias("n"), r6("balanced_accuracy"))


@query("D12_leaderboard_row", sql(CLASSES, select="SELECT model, " + ", ".join(f"round(avg(CASE WHEN category = '{c}' THEN (oracle = pred)::INT END), 6) AS \"{c}\"" for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM classes GROUP BY model"))
def d12(spark, d):
    values = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return ad.classes(spark, d).groupBy("model").pivot("category", values).agg(F.round(F.avg((F.col("oracle") == F.col("pred")).cast("double")), 6))


@query("A33_replaced_oracles", sql(CLASSES, select="""
, o AS (SELECT o_orderkey AS clip_id, q.f, CASE WHEN o_totalprice < 250000 * q.f THEN 'F' ELSE 'O' END AS oracle FROM orders CROSS JOIN (VALUES (0.8::DOUBLE), (1.0), (1.2)) q(f)),
j AS (SELECT c.model, o.f, o.oracle, c.pred FROM classes c JOIN o ON c.clip_id = o.clip_id) SELECT model, f AS factor, count(*) AS n, round(avg((oracle = pred)::INT), 6) AS accuracy FROM j GROUP BY model, f"""))
def a33(spark, d):
    oracle = ad.table(spark, d, "orders").withColumn("factor", F.explode(F.array(*map(F.lit, (0.8, 1.0, 1.2))))).select(F.col("o_orderkey").alias("clip_id"), "factor", F.when(F.col("o_totalprice") < 250000 * F.col("factor"), "F").otherwise("O").alias("oracle"))
    return m.accuracy(ad.classes(spark, d).drop("oracle").join(oracle, "clip_id"), ["model", "factor"]).select("model", "factor", "n", r6("accuracy"))


@query("F07_scored_gate", sql(CLASSES, select="SELECT CASE WHEN question_id = 'N' THEN 'unknown question' WHEN pred = 'F' AND category = '5-LOW' THEN 'unparsable' ELSE 'scored' END AS reason, count(*) AS n FROM classes GROUP BY reason"))
def f07(spark, d):
    reason = F.when(F.col("question_id") == "N", "unknown question").when((F.col("pred") == "F") & (F.col("category") == "5-LOW"), "unparsable").otherwise("scored")
    return ad.classes(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("F08_label_precedence", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.04 THEN CASE WHEN l_discount > 0.05 THEN NULL ELSE l_returnflag END ELSE l_linestatus END AS label FROM lineitem")
def f08(spark, d):
    """An oracle label that is present counts even where it is null; only an absent one gives way to the answer."""
    present, oracle = F.col("l_tax") > 0.04, F.when(F.col("l_discount") > 0.05, F.lit(None)).otherwise(F.col("l_returnflag"))
    return ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(present, oracle).otherwise(F.col("l_linestatus")).alias("label"))


@query("P22_prediction_record", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_discount > 0.05 THEN NULL ELSE l_returnflag END, l_linestatus) AS label FROM lineitem")
def p22(spark, d):
    answer = F.when(F.col("l_discount") <= 0.05, F.col("l_returnflag"))
    return ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(answer, "l_linestatus").alias("label"))
