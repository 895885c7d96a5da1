"""Fused rules against the single ones, and calibration reports against plain Python."""

import random

import numpy as np
import pytest

from kinegrid.operators import labelling, rules
from kinegrid.operators.calibration import calibrate
from kinegrid.operators.features import summary_features
from kinegrid.plans.q_rules import CONFIGURED


@pytest.fixture(scope="module")
def series(spark):
    draw = random.Random(23)
    rows = [(c, i, i * 0.25, round(draw.uniform(0, 14), 2), round(draw.uniform(-4, 4), 2), round(draw.uniform(-0.3, 0.3), 3), round(draw.uniform(-8, 8), 2)) for c, n in enumerate([1, 2, 3, 9, 16, 16, 25] * 3) for i in range(n)]
    return spark.createDataFrame(rows, "clip_id long, i long, t double, speed double, accel double, yaw_rate double, jerk double")


FEATURE_RULES = {"feature_conversion", "threshold_classification", "range_check", "multi_threshold_classification"}
OPEN = {"id": "open", "rule": "sequential_event", "params": {"first": {"signal": "accel", "operator": "less_than", "threshold": -1.0}, "second": {"signal": "accel", "operator": "greater_than", "threshold": 3.0}, "gap": (1.0, float("inf"))}}


def test_fused_labels_equal_the_single_rules_by_one_exchange(spark, series):
    questions = [*CONFIGURED, OPEN]
    fused = labelling.label_clips(series, lambda: summary_features(series), questions)
    plan = fused._jdf.queryExecution().sparkPlan().toString() and fused._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange SinglePartition" not in plan
    got = {(r.clip_id, r.question_id): (r.answer, r.rejected) for r in fused.collect()}
    features = summary_features(series)
    for q in questions:
        single = rules.apply_rule(q["rule"], features if q["rule"] in FEATURE_RULES else series, q.get("choices"), **q["params"])
        for r in single.collect():
            want = f"{r.answer:.2f}" if q["rule"] == "feature_conversion" else r.answer
            assert got.pop((r.clip_id, q["id"])) == (want, r.rejected), (q["id"], r.clip_id)
    assert not got


def test_evidence_and_rules_of_the_callers_own(spark, series):
    import json

    @rules.rule("long clip")
    def long_clip(data, least=10):
        from pyspark.sql import functions as F

        return data.groupBy("clip_id").agg(rules.yes_no(F.count("*") >= least).alias("answer"))

    questions = [OPEN, {"id": "long", "rule": "long clip", "params": {"least": 12}, "choices": ["yes"]}]
    rows = labelling.label_clips(series, lambda: summary_features(series), questions).collect()
    gaps = {r.clip_id: json.loads(r.evidence) for r in rows if r.question_id == "open"}
    single = {r.clip_id: r for r in rules.sequential_event(series, **OPEN["params"]).collect()}
    assert all(gaps[c].get("first_t") == single[c].first_t and gaps[c].get("gap", -1) == pytest.approx(-1 if single[c].gap is None else single[c].gap) for c in single)
    assert {r.answer: r.rejected for r in rows if r.question_id == "long"} == {"yes": False, "no": True}
    with pytest.raises(KeyError):
        labelling.label_clips(series, lambda: series, [{"id": "x", "rule": "no such rule"}])


def test_calibration_report(spark, series):
    draw = random.Random(4)
    rows = [(c, draw.choice([None, 1.0, draw.uniform(0, 9)]), draw.uniform(-5, 0), 0.5, 0.1) for c in range(70)]
    features = spark.createDataFrame(rows, "clip_id long, v double, w double, max_lateral_accel double, mean_accel double")
    questions = {
        "two": {"name": "threshold_classification", "params": {"feature": "v", "threshold": 4.0, "below": "low", "above": "high"}},
        "or": {"name": "or_threshold_event", "params": {"conditions": [{"feature": "v", "operator": "greater_than", "threshold": 6.0}, {"feature": "w", "operator": "less_than", "threshold": -4.0}]}},
        "stops": {"name": "stop_and_go_detection", "params": {"stop": 1.0, "go": 6.0}},
    }
    got = {(r.question, r.part, r.label, r.p): (r.n, r.total, r.threshold) for r in calibrate(questions, features, series).collect()}
    v, w = [r[1] for r in rows if r[1] is not None], [r[2] for r in rows]
    assert got["two", "balance", "low", None][:2] == (sum(x < 4 for x in v), len(v))
    for p in (10, 25, 50, 75, 90):
        t = float(np.percentile(v, p))
        assert got["two", "below", None, p][2] == pytest.approx(t) and got["two", "below", None, p][0] + got["two", "above", None, p][0] == len(v)
    assert got["or/1", "yes", None, 30][0] == sum(x < got["or/1", "yes", None, 30][2] for x in w)
    # side by side by position among the clips that have each feature, as the surveyed report does
    both = [a > 6 or b < -4 for a, b in zip(v, w)]
    assert got["or", "combined", "yes", None][:2] == (sum(both), len(v))
    assert sum(n for (q, part, _, _), (n, _, _) in got.items() if q == "stops") == series.select("clip_id").distinct().count()
    assert calibrate({}, features, series).count() == 0
