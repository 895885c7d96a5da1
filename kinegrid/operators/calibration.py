"""Class balance and threshold sensitivity of the configured rules, from counts at every value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinegrid.operators.rules import classify, compare, rule_named, yes_no
from kinegrid.sources.shared import cut, numbered

#: Percentiles at which a threshold is tried, by the side that triggers.
TRIED = {"greater_than": (70, 80, 85, 90, 95), "less_than": (5, 10, 15, 20, 30), "class": (10, 25, 50, 75, 90)}


def value_counts(values: DataFrame) -> DataFrame:
    """question, value, n, below, total of values (question, value): how often each value occurs and how many are smaller, by one sort over ranges of question and value."""
    counts = values.where(F.col("value").isNotNull()).groupBy("question", "value").agg(F.count("*").alias("n"))
    placed = cut(numbered(counts, ["question", "value"], F.col("n")), "values")
    ends = placed.groupBy("question").agg(F.min("_begin").alias("_start"), F.sum("n").alias("total"))
    return placed.join(F.broadcast(ends), "question").select("question", "value", "n", (F.col("_begin") - F.col("_start")).alias("below"), "total")


def percentiles(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """question, p and threshold: the p-th percentile of each question's values by straight lines. wanted: a few rows of question and p."""
    place = F.col("p") / 100 * (F.col("total") - 1)
    inside = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    low, high = (F.max(F.when(inside(k), F.col("value"))) for k in (F.floor(place), F.ceil(place)))
    found = counts.join(F.broadcast(wanted), "question").groupBy("question", "p").agg(low.alias("low"), high.alias("high"), F.max(place - F.floor(place)).alias("share"))
    return found.select("question", "p", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("threshold"))


def sensitivity(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """question, p, threshold, below, above (strictly either side) and total, for each tried percentile of each question."""
    counts = cut(value_counts(values), "counts")
    tried = cut(percentiles(counts, wanted), "tried")
    both = counts.join(F.broadcast(tried), "question")
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return both.groupBy("question", "p", "threshold").agg(side(F.col("value") < F.col("threshold")).alias("below"), side(F.col("value") > F.col("threshold")).alias("above"), F.max("total").alias("total"))


def _feature_rule(rule: dict) -> tuple[str, Column, Column] | None:
    """The percentiles to try, the value and its class, of a rule that reads one feature."""
    name, p = rule["name"], rule["params"]
    if name == "multi_threshold_classification":
        v = F.col(p["feature"])
        return "class", v, classify(v, p["thresholds"], p["labels"])
    if name == "threshold_classification":
        v = F.col(p["feature"])
        return "class", v, F.when(v < p["threshold"], p["below"]).when(v.isNotNull(), p["above"])
    if name in ("yaw_rate_sign_with_deadzone", "trend_classification"):
        v, labels = (F.col("signed_max_yaw_rate"), ("left", "right", "straight")) if name[0] == "y" else (F.col("mean_accel"), ("accelerating", "decelerating", "steady"))
        return "class", v, F.when(v > p["positive"], labels[0]).when(v < p["negative"], labels[1]).when(v.isNotNull(), labels[2])
    if name == "lateral_accel_threshold":
        v = F.col("max_lateral_accel")
        return "class", v, F.when(v.isNotNull(), yes_no(v > p["threshold"]))
    if name == "feature_conversion":
        v = F.col(p["feature"]) * p["factor"]
        return "class", v, F.lit(None).cast("string")  # a number: nothing to balance
    return None


REPORT = "question string, part string, label string, p int, threshold double, n long, total long"


def calibrate(questions: dict[str, dict], features: DataFrame, series: DataFrame) -> DataFrame:
    """Rows of a calibration report: question, part, label, p, threshold, n, total.

    questions: question -> {"name": rule, "params": ...}. part "balance": n clips with the label, of total. part "below" and "above": n values on either side of the threshold
    at percentile p; "yes" for a condition of an or-rule (its question is "<question>/<k>"). part "combined": the or of its conditions. Conditions are put side by side by
    position among the clips that have their feature, up to the shortest, as the surveyed reports do. Rules over series are applied and balanced.

    All feature rules and conditions are one long table, counted and sorted once.
    """
    spark = features.sparkSession
    features = cut(features, "features")
    values, classes, wanted, combined = [], [], [], []
    for question, rule in questions.items():
        params = rule["params"]
        if found := _feature_rule(rule):
            kind, value, label = found
            values.append(F.struct(F.lit(question).alias("question"), value.cast("double").alias("value")))
            classes.append(F.struct(F.lit(question).alias("question"), label.alias("label")))
            wanted += [(question, p, kind) for p in TRIED[kind]]
        elif rule["name"] == "or_threshold_event":
            masks = []
            for k, c in enumerate(params["conditions"]):
                value = F.col(c["feature"])
                values.append(F.struct(F.lit(f"{question}/{k}").alias("question"), value.cast("double").alias("value")))
                classes.append(F.struct(F.lit(f"{question}/{k}").alias("question"), F.when(value.isNotNull(), yes_no(compare(value, c["operator"], c["threshold"]))).alias("label")))
                wanted += [(f"{question}/{k}", p, c["operator"]) for p in TRIED[c["operator"]]]
                held = features.where(value.isNotNull()).select("clip_id", compare(value, c["operator"], c["threshold"]).alias(f"m{k}"))
                masks.append(numbered(held, ["clip_id"]).drop("clip_id"))
            one = masks[0]
            for m in masks[1:]:
                one = one.join(m, "_idx")  # by position, to the shortest
            met = F.array_contains(F.array(*[f"m{k}" for k in range(len(masks))]), True)
            combined.append(one.select(F.lit(question).alias("question"), F.lit("combined").alias("part"), yes_no(met).alias("label")))
        else:
            answers = rule_named(rule["name"])(series, **params).select(F.lit(question).alias("question"), F.lit("balance").alias("part"), F.col("answer").cast("string").alias("label"))
            combined.append(answers.where("label IS NOT NULL"))
    none = lambda t: F.lit(None).cast(t)
    labelled = features.select(F.inline(F.array(*classes))).where("label IS NOT NULL").withColumn("part", F.lit("balance")) if classes else spark.createDataFrame([], "question string, label string, part string")
    for c in combined:
        labelled = labelled.unionByName(c)
    balance = labelled.groupBy("question", "part", "label").agg(F.count("*").alias("n"))
    totals = balance.groupBy("question", "part").agg(F.sum("n").alias("total"))
    balance = balance.join(F.broadcast(totals), ["question", "part"]).select("question", "part", "label", none("int").alias("p"), none("double").alias("threshold"), "n", "total")
    if not values:
        return balance
    tried = spark.createDataFrame(wanted, "question string, p int, kind string")
    table = sensitivity(features.select(F.inline(F.array(*values))), tried.select("question", "p")).join(F.broadcast(tried), ["question", "p"])
    sides = F.when(F.col("kind") == "class", F.array(F.struct(F.lit("below").alias("part"), F.col("below").alias("n")), F.struct(F.lit("above").alias("part"), (F.col("total") - F.col("below")).alias("n")))).otherwise(
        F.array(F.struct(F.lit("yes").alias("part"), F.when(F.col("kind") == "less_than", F.col("below")).otherwise(F.col("above")).alias("n")))
    )
    lines = table.withColumn("_s", F.explode(sides)).select("question", F.col("_s.part").alias("part"), none("string").alias("label"), "p", "threshold", F.col("_s.n").alias("n"), "total")
    return balance.unionByName(lines)
