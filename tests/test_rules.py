"""Labelling rules and features on random series, against plain Python."""

import math
import random

import numpy as np
import pytest

from kinegrid.operators import rules
from kinegrid.operators.features import aggregate, summary_features
from kinegrid.operators.validation import config_errors

SIGNALS = ("speed", "accel", "yaw_rate", "jerk")


@pytest.fixture(scope="module")
def clips():
    draw = random.Random(17)
    return {k: {s: [round(draw.uniform(*r), 2) for _ in range(n)] for s, r in zip(SIGNALS, ((0, 9), (-4, 4), (-0.6, 0.6), (-30, 30)), strict=True)} for k, n in enumerate([1, 2, 3, 7, 8, 12, 12, 13, 20, 25] * 3)}


@pytest.fixture(scope="module")
def df(spark, clips):
    rows = [(k, i, 0.25 * i, *(own[s][i] for s in SIGNALS)) for k, own in clips.items() for i in range(len(own["speed"]))]
    return spark.createDataFrame(rows, "clip_id long, i long, t double, speed double, accel double, yaw_rate double, jerk double")


def answers(out):
    return {r.clip_id: r.answer for r in out.collect()}


def rms(values):
    return math.sqrt(sum(v * v for v in values) / len(values))


def test_aggregations_equal_numpy_without_nan(spark):
    from pyspark.sql import functions as F

    draw = random.Random(3)
    values = [draw.choice([float("nan"), None, draw.gauss(0, 5)]) for _ in range(60)]
    kept = np.array([v for v in values if v is not None and v == v])
    one = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    hows = {"mean": kept.mean(), "min": kept.min(), "max": kept.max(), "p25": np.percentile(kept, 25), "p90": np.percentile(kept, 90), "rms": rms(kept), "max_abs": abs(kept).max(), "abs_max": kept[abs(kept).argmax()]}
    got = one.agg(*[aggregate(F.col("v"), h).alias(h) for h in hows]).first()
    assert all(abs(got[h] - v) < 1e-9 for h, v in hows.items())
    with pytest.raises(ValueError):
        aggregate(F.col("v"), "p500")


def test_rules_of_one_value(df, clips):
    means = {k: sum(own["yaw_rate"]) / len(own["yaw_rate"]) for k, own in clips.items()}
    assert answers(rules.yaw_rate_sign(df, how="mean", positive=0.03, negative=-0.02)) == {k: "left" if v > 0.03 else "right" if v < -0.02 else "straight" for k, v in means.items()}
    assert answers(rules.threshold_event(df, "accel", "less_than", -3.7)) == {k: "yes" if min(own["accel"]) < -3.7 else "no" for k, own in clips.items()}
    either = [{"signal": "jerk", "operator": "abs_greater_than", "threshold": 29, "how": "max"}, {"signal": "speed", "operator": "less_than", "threshold": 0.4, "how": "min"}]
    assert answers(rules.or_threshold_event(df, either)) == {k: "yes" if abs(max(own["jerk"])) > 29 or min(own["speed"]) < 0.4 else "no" for k, own in clips.items()}
    accel = {k: sum(own["accel"]) / len(own["accel"]) for k, own in clips.items()}
    assert answers(rules.trend(df, dead=0.3)) == {k: "accelerating" if v > 0.3 else "decelerating" if v < -0.3 else "steady" for k, v in accel.items()}
    with pytest.raises(ValueError):
        rules.threshold_event(df, "accel", "is_near", 1.0)


def test_classes_of_a_feature(spark):
    draw = random.Random(5)
    values = [None, 2.0, 7.0, *(draw.uniform(-1, 12) for _ in range(50))]
    f = spark.createDataFrame(list(enumerate(values)), "clip_id long, v double")
    names = ["tiny", "small", "large"]
    assert answers(rules.multi_threshold(f, "v", [2.0, 7.0], names)) == {k: None if v is None else names[(v >= 2.0) + (v >= 7.0)] for k, v in enumerate(values)}
    assert answers(rules.range_check(f, "v", 2.0, 7.0)) == {k: "yes" if v is not None and 2.0 <= v <= 7.0 else "no" for k, v in enumerate(values)}
    assert answers(rules.threshold_classification(f, "v", 7.0, "under", "over")) == {k: None if v is None else "under" if v < 7.0 else "over" for k, v in enumerate(values)}
    with pytest.raises(ValueError):
        rules.multi_threshold(f, "v", [2.0, 7.0], names[:2])


def test_dominant_axis(df, clips):
    want = {}
    for k, own in clips.items():
        a, b = rms(own["accel"]), rms([s * abs(y) for s, y in zip(own["speed"], own["yaw_rate"], strict=True)])
        want[k] = "none" if max(a, b) < 1.8 else "lateral" if b / a > 0.9 else "longitudinal"
    assert answers(rules.dominant_axis(df, dead=1.8, ratio=0.9)) == want


@pytest.mark.parametrize("gap", [(0.0, 0.5), (0.6, 1.5), (0.0, float("inf"))])
def test_sequences_equal_all_pairs(df, clips, gap):
    first, second = {"signal": "accel", "operator": "less_than", "threshold": -3.0}, {"signal": "yaw_rate", "operator": "abs_greater_than", "threshold": 0.5}
    want = {}
    for k, own in clips.items():
        times = [0.25 * i for i in range(len(own["accel"]))]
        pairs = [(a, b) for a, x in zip(times, own["accel"], strict=True) if x < -3.0 for b, y in zip(times, own["yaw_rate"], strict=True) if abs(y) > 0.5 and a + max(gap[0], 1e-6) <= b <= a + gap[1]]
        want[k] = ("yes", min(pairs)[0], min(pairs)[1] - min(pairs)[0]) if pairs else ("no", None, None)
    got = {r.clip_id: (r.answer, r.first_t, r.gap) for r in rules.sequential_event(df, first, second, gap=gap).collect()}
    assert got == want and len({w[0] for w in want.values()}) == 2


def test_peaks_and_halves(df, clips):
    peak, half = {}, {}
    for k, own in clips.items():
        v, mean = own["speed"], sum(own["speed"]) / len(own["speed"])
        peak[k] = "no_peak" if (max(v) - mean) / abs(mean) < 0.5 else "first_half" if v.index(max(v)) < len(v) // 2 else "second_half"
        a, b = own["accel"][: len(v) // 2], own["accel"][len(v) // 2 :]
        if a:
            x, y = rms(a), rms(b)
            half[k] = "similar" if abs(x - y) / max(x, y) < 0.25 else "first_half" if x > y else "second_half"
    assert answers(rules.peak_half(df, prominence=0.5)) == peak
    got = answers(rules.half_comparison(df, similar=0.25))
    assert {k: got[k] for k in half} == half


def test_stops(df, clips):
    want = {}
    for k, own in clips.items():
        cycles, standing = 0, False
        for v in own["speed"]:
            if v < 1.5:
                standing = True
            elif v > 5.0 and standing:
                cycles, standing = cycles + 1, False
        want[k] = cycles
    got = {r.clip_id: (r.cycles, r.answer) for r in rules.stop_and_go(df, stop=1.5, go=5.0, least=2).collect()}
    assert got == {k: (n, "yes" if n >= 2 else "no") for k, n in want.items()}
    with pytest.raises(ValueError):
        rules.stop_and_go(df, stop=3.0, go=2.5)


def test_summary_equals_numpy(df, clips):
    got = {r.clip_id: r for r in summary_features(df).collect()}
    for k, own in clips.items():
        s, a, y, j = (np.array(own[c]) for c in SIGNALS)
        want = {"max_speed": s.max(), "mean_speed": s.mean(), "min_accel": a.min(), "max_accel": a.max(), "mean_accel": a.mean(), "max_abs_yaw_rate": abs(y).max(), "signed_max_yaw_rate": y[abs(y).argmax()], "max_abs_jerk": abs(j).max(), "p95_abs_jerk": np.percentile(abs(j), 95), "mean_abs_jerk": abs(j).mean(), "max_lateral_accel": (s * abs(y)).max(), "total_heading_change": (abs(y[1:]) * 0.1).sum()}
        assert all(abs(got[k][c] - v) < 1e-9 for c, v in want.items()), k


def test_registry_and_scaling(spark):
    assert len(rules.RULES) == 14
    with pytest.raises(KeyError):
        rules.rule_named("no such rule")
    with pytest.warns(UserWarning):
        rules.rule("range_check")(rules.RULES["range_check"])
    assert rules.scaled({"dead": 0.3, "how": "mean", "ratio": 1.5, "conditions": [{"threshold": 8, "signal": "jerk"}], "low": -2.0}, 0.5) == {"dead": 0.15, "how": "mean", "ratio": 1.5, "conditions": [{"threshold": 4.0, "signal": "jerk"}], "low": -1.0}


def test_config_validation():
    good = {"question_id": "stops", "category": "speed", "question_text": "Does it stop?", "answer_type": "choice", "choices": ["yes", "no"], "rule": {"name": "stop_and_go_detection", "params": {"how": "p10", "conditions": [{"operator": "greater_than", "threshold": 2.5}]}}}
    known = set(rules.RULES)
    assert config_errors([good], known) == []
    assert config_errors([good, good], known)
    for change in ({"question_text": ""}, {"choices": []}, {"rule": {"name": "unheard_of"}}, {"rule": {"name": "trend_classification", "params": {"threshold": "high"}}}, {"rule": {"name": "range_check", "params": {"how": "p999"}}}, {"rule": {"name": "range_check", "params": {"c": [{"operator": "around"}]}}}):
        assert config_errors([good | change], known)
