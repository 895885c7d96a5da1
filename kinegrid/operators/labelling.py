"""All configured rules over a series in one grouping.

A rule is compiled into window columns (rarely), aggregates, and an answer over these. The aggregates of all rules are computed together, each
expression once, so the series is shuffled by clip once whatever the number of rules; answers and evidence are resolved on the clip's one row.
Rules registered without a compiler are applied by themselves and their rows are added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinegrid.functions.series import clip_window
from kinegrid.operators.features import aggregate, feature_aggregates
from kinegrid.operators.rules import classify, compare, rule_named, yes_no


@dataclass
class Compiled:
    """aggregates by name; answer and evidence from a function that gives each aggregate's column; window columns by name."""

    aggregates: dict[str, Column]
    answer: Callable[[Callable[[str], Column]], Column]
    evidence: Callable[[Callable[[str], Column]], dict[str, Column]] = field(default=lambda at: {"value": at("value")})
    windows: dict[str, Column] = field(default_factory=dict)


COMPILERS: dict[str, Callable[..., Compiled]] = {}


def compiler(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        COMPILERS[name] = f
        return f

    return add


def _one(value: Column, answer: Callable[[Column], Column]) -> Compiled:
    return Compiled({"value": value}, lambda at: answer(at("value")))


def _feature(name: str) -> Column:
    return feature_aggregates()[name]


@compiler("yaw_rate_sign_with_deadzone")
def _yaw(signal="yaw_rate", how="abs_max", positive=0.04, negative=-0.04) -> Compiled:
    return _one(aggregate(F.col(signal), how), lambda v: F.when(v > positive, "left").when(v < negative, "right").otherwise("straight"))


@compiler("threshold_event")
def _event(signal, operator, threshold, how="min") -> Compiled:
    return _one(aggregate(F.col(signal), how), lambda v: yes_no(compare(v, operator, threshold)))


@compiler("or_threshold_event")
def _either(conditions, yes="yes", no="no") -> Compiled:
    def met(at):
        out = F.lit(False)
        for k, c in enumerate(conditions):
            out = out | F.coalesce(compare(at(f"value_{k}"), c["operator"], c["threshold"]), F.lit(False))
        return F.when(out, yes).otherwise(no)

    return Compiled({f"value_{k}": aggregate(F.col(c["signal"]), c.get("how", "max")) for k, c in enumerate(conditions)}, met, lambda at: {f"value_{k}": at(f"value_{k}") for k in range(len(conditions))})


@compiler("feature_conversion")
def _converted(feature, factor, decimals=1) -> Compiled:
    return _one(_feature(feature), lambda v: F.format_string(f"%.{decimals}f", F.bround(v * factor, decimals)))


@compiler("threshold_classification")
def _two(feature, threshold, below, above) -> Compiled:
    return _one(_feature(feature), lambda v: F.when(v < threshold, below).when(v.isNotNull(), above))


@compiler("trend_classification")
def _trend(signal="accel", how="mean", dead=0.25) -> Compiled:
    return _one(aggregate(F.col(signal), how), lambda v: F.when(v > dead, "accelerating").when(v < -dead, "decelerating").otherwise("steady"))


@compiler("range_check")
def _range(feature, low=float("-inf"), high=float("inf")) -> Compiled:
    return _one(_feature(feature), lambda v: yes_no(v.between(low, high)))


@compiler("dominant_axis_comparison")
def _axis(dead=0.2, ratio=1.0) -> Compiled:
    lateral = F.col("speed") * F.abs("yaw_rate")

    def answer(at):
        a, b = at("longitudinal"), at("lateral")
        return F.when((a < dead) & (b < dead), "none").when(a < 1e-9, "lateral").when(b / a > ratio, "lateral").otherwise("longitudinal")

    return Compiled({"longitudinal": F.sqrt(F.avg(F.pow("accel", 2))), "lateral": F.sqrt(F.avg(lateral * lateral))}, answer, lambda at: {k: at(k) for k in ("longitudinal", "lateral")})


@compiler("lateral_accel_threshold")
def _lateral(threshold=2.0, how="max") -> Compiled:
    return _one(aggregate(F.col("speed") * F.abs("yaw_rate"), how), lambda v: yes_no(v > threshold))


@compiler("sequential_event")
def _sequence(first, second, gap=(0.0, 2.0)) -> Compiled:
    """Only the events are kept, and walked through once from the last to the first with the second event that comes next."""
    begins, follows = (F.coalesce(compare(F.col(c["signal"]), c["operator"], c["threshold"]), F.lit(False)) for c in (first, second))
    low, high, t = float(max(gap[0], 1e-6)), float(gap[1]), F.col("t").cast("double")
    entry = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"), t.alias("t"))
    none = F.array().cast("array<struct<at:double,kind:int,t:double>>")
    own = F.concat(F.when(begins, F.array(entry(t + low, 0))).otherwise(none), F.when(follows, F.array(entry(t, 1))).otherwise(none))

    def found(at):
        state = lambda following, one, two: F.struct(following.alias("next"), one.alias("t1"), two.alias("t2"))
        null = F.lit(None).cast("double")
        step = lambda s, x: F.when(x["kind"] == 1, state(x["t"], s["t1"], s["t2"])).when(s["next"] <= x["t"] + high, state(s["next"], x["t"], s["next"])).otherwise(s)
        return F.aggregate(F.reverse(F.array_sort(at("events"))), state(null, null, null), step)

    return Compiled({"events": F.flatten(F.collect_list(F.when(begins | follows, own)))}, lambda at: yes_no(found(at)["t1"].isNotNull()), lambda at: {"first_t": found(at)["t1"], "gap": found(at)["t2"] - found(at)["t1"]})


@compiler("peak_half_detection")
def _peak(signal="speed", prominence=0.05, least=0.0) -> Compiled:
    v = F.col(signal)

    def answer(at):
        peak, mean = at("peak"), at("mean")
        flat = F.when(F.abs(mean) < 1e-9, peak < prominence).otherwise((peak - mean) / F.abs(mean) < prominence)
        return F.when(flat | (peak < least), "no_peak").when(at("at") < F.floor(at("n") / 2), "first_half").otherwise("second_half")

    return Compiled({"at": F.max_by("i", F.struct(v, -F.col("i"))), "peak": F.max(v), "mean": F.avg(v), "n": F.count("*")}, answer, lambda at: {k: at(k) for k in ("at", "peak", "mean")})


@compiler("stop_and_go_detection")
def _stops(signal="speed", stop=0.5, go=2.0, least=1) -> Compiled:
    if stop > go:
        raise ValueError("stop must not be above go")
    v = F.col(signal)
    events = F.collect_list(F.when((v < stop) | (v > go), F.struct(F.col("i").alias("i"), (v > go).alias("go"))))

    def cycles(at):
        step = lambda s, x: F.struct(x["go"].alias("go"), (s["n"] + F.when(x["go"] & ~s["go"], 1).otherwise(0)).alias("n"))
        return F.aggregate(F.array_sort(at("events")), F.struct(F.lit(True).alias("go"), F.lit(0).alias("n")), step)["n"]

    return Compiled({"events": events}, lambda at: yes_no(cycles(at) >= least), lambda at: {"cycles": cycles(at)})


@compiler("half_comparison")
def _halves(signal="accel", how="rms", similar=0.2) -> Compiled:
    first = F.row_number().over(clip_window()) <= F.floor(F.count("*").over(Window.partitionBy("clip_id")) / 2)

    def answer(at):
        one, two = at("first"), at("second")
        most = F.greatest(F.abs(one), F.abs(two))
        return F.when(most < 1e-9, "similar").when(F.abs(one - two) / most < similar, "similar").when(one > two, "first_half").otherwise("second_half")

    aggregates = {"first": aggregate(F.when(F.col("_first_half"), F.col(signal)), how), "second": aggregate(F.when(~F.col("_first_half"), F.col(signal)), how)}
    return Compiled(aggregates, answer, lambda at: {k: at(k) for k in ("first", "second")}, {"_first_half": first})


@compiler("multi_threshold_classification")
def _many(feature, thresholds, labels) -> Compiled:
    return _one(_feature(feature), lambda v: classify(v, thresholds, labels))


def label_clips(series: DataFrame, features: Callable[[], DataFrame], questions: list[dict]) -> DataFrame:
    """clip_id, question_id, answer, rejected, evidence (JSON) for each clip and question ({"id", "rule", "params", "choices"}).

    A rule that is not registered raises an error. features: gives feature rows, for rules without a compiler that read them. An answer that is missing or none of the
    choices is rejected.
    """
    windows, names, aggregates, rows, alone = {}, {}, [], [], []
    for q in questions:
        rule_named(q["rule"])
        if q["rule"] not in COMPILERS:
            alone.append(q)
            continue
        made = COMPILERS[q["rule"]](**q.get("params", {}))
        windows |= made.windows
        own = {}
        for name, column in made.aggregates.items():
            text = str(column)
            if text not in names:
                names[text] = f"_a{len(names)}"
                aggregates.append(column.alias(names[text]))
            own[name] = names[text]
        at = lambda name, own=own: F.col(own[name])
        answer = made.answer(at).cast("string")
        choices = q.get("choices")
        rejected = answer.isNull() | (~answer.isin(choices) if choices else F.lit(False))
        evidence = F.to_json(F.struct(*[c.alias(n) for n, c in made.evidence(at).items()]))
        rows.append(F.struct(F.lit(q["id"]).alias("question_id"), answer.alias("answer"), rejected.alias("rejected"), evidence.alias("evidence")))
    out = None
    if rows:
        out = series.withColumns(windows).groupBy("clip_id").agg(*aggregates).select("clip_id", F.inline(F.array(*rows)))
    for q in alone:
        made = rule_named(q["rule"])(series if q.get("reads", "series") == "series" else features(), **q.get("params", {}))
        answer = F.col("answer").cast("string")
        rejected = answer.isNull() | (~answer.isin(q["choices"]) if q.get("choices") else F.lit(False))
        one = made.select("clip_id", F.lit(q["id"]).alias("question_id"), answer.alias("answer"), rejected.alias("rejected"), F.lit(None).cast("string").alias("evidence"))
        out = one if out is None else out.unionByName(one)
    return out
