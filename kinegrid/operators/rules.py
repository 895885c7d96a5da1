"""Labelling rules as column expressions, in a registry that callers can extend.

A rule is a function of its parameters that gives an aggregation plan: the rule's columns (label and evidence) over one grouping
of a series by clip. Rules that only read features give expressions over a feature row.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinegrid.functions.series import clip_window, stop_go_cycles, with_next
from kinegrid.operators.features import aggregate, known

RULES: dict[str, Callable] = {}


def rule(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        if name in RULES:
            warnings.warn(f"rule {name} is replaced", stacklevel=2)
        RULES[name] = f
        return f

    return add


def rule_named(name: str) -> Callable:
    if name not in RULES:
        raise KeyError(f"no rule named {name}; there are {sorted(RULES)}")
    return RULES[name]


def compare(value: Column, operator: str, threshold: float) -> Column:
    """less_than and greater_than are strict; abs_greater_than compares magnitudes."""
    if operator == "less_than":
        return value < threshold
    if operator == "greater_than":
        return value > threshold
    if operator == "abs_greater_than":
        return F.abs(value) > threshold
    raise ValueError(f"unknown operator {operator}")


def yes_no(condition: Column) -> Column:
    return F.when(condition, "yes").otherwise("no")


def _labelled(series: DataFrame, value: Column, label: Callable[[Column], Column]) -> DataFrame:
    return series.groupBy("clip_id").agg(value.alias("value")).withColumn("answer", label(F.col("value")))


@rule("yaw_rate_sign_with_deadzone")
def yaw_rate_sign(series: DataFrame, signal: str = "yaw_rate", how: str = "abs_max", positive: float = 0.04, negative: float = -0.04) -> DataFrame:
    return _labelled(series, aggregate(F.col(signal), how), lambda v: F.when(v > positive, "left").when(v < negative, "right").otherwise("straight"))


@rule("threshold_event")
def threshold_event(series: DataFrame, signal: str, operator: str, threshold: float, how: str = "min") -> DataFrame:
    return _labelled(series, aggregate(F.col(signal), how), lambda v: yes_no(compare(v, operator, threshold)))


@rule("or_threshold_event")
def or_threshold_event(series: DataFrame, conditions: list[dict], yes: str = "yes", no: str = "no") -> DataFrame:
    values = [aggregate(F.col(c["signal"]), c.get("how", "max")).alias(f"value_{k}") for k, c in enumerate(conditions)]
    met = F.lit(False)
    for k, c in enumerate(conditions):
        met = met | F.coalesce(compare(F.col(f"value_{k}"), c["operator"], c["threshold"]), F.lit(False))
    return series.groupBy("clip_id").agg(*values).withColumn("answer", F.when(met, yes).otherwise(no))


@rule("feature_conversion")
def feature_conversion(features: DataFrame, feature: str, factor: float, decimals: int = 1) -> DataFrame:
    return features.select("clip_id", F.col(feature).alias("value"), F.bround(F.col(feature) * factor, decimals).alias("answer"))


@rule("threshold_classification")
def threshold_classification(features: DataFrame, feature: str, threshold: float, below: str, above: str) -> DataFrame:
    v = F.col(feature)
    return features.select("clip_id", v.alias("value"), F.when(v < threshold, below).when(v.isNotNull(), above).alias("answer"))


@rule("trend_classification")
def trend(series: DataFrame, signal: str = "accel", how: str = "mean", dead: float = 0.25) -> DataFrame:
    return _labelled(series, aggregate(F.col(signal), how), lambda v: F.when(v > dead, "accelerating").when(v < -dead, "decelerating").otherwise("steady"))


@rule("range_check")
def range_check(features: DataFrame, feature: str, low: float = float("-inf"), high: float = float("inf")) -> DataFrame:
    return features.select("clip_id", F.col(feature).alias("value"), yes_no(F.col(feature).between(low, high)).alias("answer"))


@rule("dominant_axis_comparison")
def dominant_axis(series: DataFrame, dead: float = 0.2, ratio: float = 1.0) -> DataFrame:
    """Longitudinal or lateral, by the larger root mean square; none if both are inside the deadzone."""
    lateral = F.col("speed") * F.abs("yaw_rate")
    rms = series.groupBy("clip_id").agg(F.sqrt(F.avg(F.pow("accel", 2))).alias("longitudinal"), F.sqrt(F.avg(lateral * lateral)).alias("lateral"))
    answer = F.when((F.col("longitudinal") < dead) & (F.col("lateral") < dead), "none").when(F.col("longitudinal") < 1e-9, "lateral").when(F.col("lateral") / F.col("longitudinal") > ratio, "lateral").otherwise("longitudinal")
    return rms.withColumn("answer", answer)


@rule("lateral_accel_threshold")
def lateral_threshold(series: DataFrame, threshold: float = 2.0, how: str = "max") -> DataFrame:
    return _labelled(series, aggregate(F.col("speed") * F.abs("yaw_rate"), how), lambda v: yes_no(v > threshold))


@rule("sequential_event")
def sequential_event(series: DataFrame, first: dict, second: dict, gap: tuple[float, float] = (0.0, 2.0)) -> DataFrame:
    """Whether a second event begins within the gap after a first one, ends included, not at the same time. Evidence: the earliest first time and the gap to its earliest second."""
    begins, follows = (compare(F.col(c["signal"]), c["operator"], c["threshold"]) for c in (first, second))
    timed = series.select("clip_id", "t", begins.alias("_begins"), follows.alias("_follows"))
    found = with_next(timed, F.col("_follows"), "t2", float(max(gap[0], 1e-6)), float(gap[1])).groupBy("clip_id").agg(F.min(F.when(F.col("_begins") & F.col("t2").isNotNull(), F.struct(F.col("t").alias("t1"), "t2"))).alias("m"))
    return found.select("clip_id", F.col("m.t1").alias("first_t"), (F.col("m.t2") - F.col("m.t1")).alias("gap"), yes_no(F.col("m").isNotNull()).alias("answer"))


@rule("peak_half_detection")
def peak_half(series: DataFrame, signal: str = "speed", prominence: float = 0.05, least: float = 0.0) -> DataFrame:
    v = F.col(signal)
    g = series.groupBy("clip_id").agg(F.max_by("i", F.struct(v, -F.col("i"))).alias("at"), F.max(v).alias("peak"), F.avg(v).alias("mean"), F.count("*").alias("n"))
    flat = F.when(F.abs("mean") < 1e-9, F.col("peak") < prominence).otherwise((F.col("peak") - F.col("mean")) / F.abs("mean") < prominence)
    answer = F.when(flat | (F.col("peak") < least), "no_peak").when(F.col("at") < F.floor(F.col("n") / 2), "first_half").otherwise("second_half")
    return g.withColumn("answer", answer)


@rule("stop_and_go_detection")
def stop_and_go(series: DataFrame, signal: str = "speed", stop: float = 0.5, go: float = 2.0, least: int = 1) -> DataFrame:
    cycles = stop_go_cycles(series, signal, stop, go)
    clips = series.select("clip_id").distinct()
    out = clips.join(cycles, "clip_id", "left").withColumn("cycles", F.coalesce("cycles", F.lit(0)).cast("long"))
    return out.withColumn("answer", yes_no(F.col("cycles") >= least))


@rule("half_comparison")
def half_comparison(series: DataFrame, signal: str = "accel", how: str = "rms", similar: float = 0.2) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("clip_id"))
    halves = series.withColumn("_first", F.row_number().over(clip_window()) <= F.floor(n / 2))
    one, two = (aggregate(F.when(c, F.col(signal)), how) for c in (F.col("_first"), ~F.col("_first")))
    g = halves.groupBy("clip_id").agg(one.alias("first"), two.alias("second"))
    most = F.greatest(F.abs("first"), F.abs("second"))
    answer = F.when(most < 1e-9, "similar").when(F.abs(F.col("first") - F.col("second")) / most < similar, "similar").when(F.col("first") > F.col("second"), "first_half").otherwise("second_half")
    return g.withColumn("answer", answer)


def classify(value: Column, thresholds: list, labels: list[str]) -> Column:
    """The label of the first threshold above the value, else the last label."""
    if len(labels) != len(thresholds) + 1:
        raise ValueError("one label more than thresholds is needed")
    out = None
    for t, name in zip(thresholds, labels, strict=False):
        out = F.when(value < t, name) if out is None else out.when(value < t, name)
    return F.when(value.isNotNull(), out.otherwise(labels[-1]))


@rule("multi_threshold_classification")
def multi_threshold(features: DataFrame, feature: str, thresholds: list[float], labels: list[str]) -> DataFrame:
    return features.select("clip_id", F.col(feature).alias("value"), classify(F.col(feature), thresholds, labels).alias("answer"))


def apply_rule(name: str, data: DataFrame, choices: list[str] | None = None, **params) -> DataFrame:
    """A rule's rows with `rejected`: the answer is missing or none of the choices."""
    out = rule_named(name)(data, **params)
    return out.withColumn("rejected", F.col("answer").isNull() | (~F.col("answer").isin(choices) if choices else F.lit(False)))


def usable(value: Column) -> Column:
    return known(value).isNotNull()


#: Parameters that hold thresholds and grow with the factor of a sensitivity study; a prominence ratio does not.
SCALED = ("threshold", "thresholds", "positive", "negative", "dead", "stop", "go", "similar", "low", "high", "least")


def scaled(params: object, factor: float) -> object:
    """Parameters with every threshold multiplied, inside nested conditions too."""
    if isinstance(params, list):
        return [scaled(p, factor) for p in params]
    if not isinstance(params, dict):
        return params

    def grow(v):
        return [x * factor for x in v] if isinstance(v, list) else v * factor

    return {k: grow(v) if k in SCALED and not isinstance(v, bool) else scaled(v, factor) for k, v in params.items()}
