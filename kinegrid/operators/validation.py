"""Checks of tables as rows of violations, and of rule configurations on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """A row (key, reason) for every check that does not hold, in one pass. A check that is null does not hold."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return df.select(F.col(key), F.explode(reasons).alias("reason"))


def finite(column: str) -> Column:
    v = F.col(column).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing_references(df: DataFrame, key: str, index: DataFrame, index_key: str) -> DataFrame:
    return df.join(index.select(F.col(index_key).alias(key)), key, "left_anti")


def increasing(df: DataFrame, clip: str, order: str, time: str) -> DataFrame:
    """Clips whose times do not rise from row to row."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(clip).orderBy(order))
    return df.withColumn("_step", step).groupBy(clip).agg(F.min("_step").alias("_least")).where("_least <= 0").select(clip)


def clip_violations(clips: DataFrame, samples: DataFrame, features: DataFrame, duration: float = 3.0, tolerance: float = 0.1, least_frames: int = 20, signals: tuple[str, ...] = ("x", "y", "yaw"), order: str = "k") -> DataFrame:
    """clip_id and reason for every check that a clip fails.

    clips: clip_id, t_start, t_end, tokens, paths (numbers of frames named and found), array_ref. samples: the clips' arrays, a row for each sample in order, with ts from the clip's
    start. features: a row for each clip. Clips come first: samples and features without a clip are looked at by nobody. A clip with neither samples nor an array_ref fails both of these checks
    alone, not those of the samples' values.
    """
    step = F.col("ts") - F.lag("ts").over(Window.partitionBy("clip_id").orderBy(order))
    good = lambda c: F.coalesce(finite(c), F.lit(False))
    tracks = samples.withColumn("_step", step).groupBy("clip_id").agg(
        F.count("*").alias("_samples"), F.min("_step").alias("_least"), F.count_if(F.col("_step").isNull()).alias("_untold"), F.min_by("ts", order).alias("_first"), F.max_by("ts", order).alias("_last"), *[F.count_if(~good(c)).alias(f"_bad_{c}") for c in ("ts", *signals)]
    )
    named = [c for c in features.columns if c != "clip_id"]
    own = features.select("clip_id", *[F.col(c).alias(f"_feature_{c}") for c in named])
    joined = clips.join(tracks, "clip_id", "left").join(own, "clip_id", "left")
    none, long = F.col("_samples").isNull(), F.col("t_end") - F.col("t_start")
    ref = F.coalesce(F.col("array_ref"), F.lit("")) != ""
    checks = {
        "duration": F.abs(long - duration) <= tolerance,
        "order": F.col("t_end") > F.col("t_start"),
        "no frames": F.col("tokens") > 0,
        "frames and paths differ": F.col("tokens") == F.col("paths"),
        "few frames": F.col("tokens") >= least_frames,
        "no array_ref": ref,
        "no array": ~ref | ~none,
        **{f"{c} not finite": none | (F.col(f"_bad_{c}") == 0) for c in ("ts", *signals)},
        "times do not rise": none | (F.col("_samples") == 1) | ((F.col("_least") > 0) & (F.col("_untold") == 1)),
        "first time": none | (F.abs("_first") <= tolerance),
        "array duration": none | (F.abs(F.col("_last") - F.col("_first") - long) <= tolerance),
        **{f"feature {c}": good(f"_feature_{c}") for c in named},
    }
    return violations(joined, "clip_id", checks)


#: What an item must have, and the types of answers there are.
REQUIRED = ("qa_id", "clip_id", "question_id", "answer_type", "answer")
ANSWER_TYPES = ("multiclass", "binary", "numeric")


def item_violations(items: DataFrame, clips: DataFrame, line: str = "line") -> DataFrame:
    """line and reason for every check that an item (with choices, an array, null if it has none) fails. An item that lacks a field is not looked at further, and does not make a later one a duplicate."""
    lacking = violations(items, line, {f"no {c}": F.col(c).isNotNull() for c in REQUIRED})
    whole = items.where(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED))
    place = F.row_number().over(Window.partitionBy("qa_id").orderBy(line))
    known = clips.select("clip_id").distinct().withColumn("_known", F.lit(True))
    checked = whole.withColumn("_place", place).join(known, "clip_id", "left")
    kind, some = F.col("answer_type"), F.coalesce(F.size("choices"), F.lit(0)) > 0
    inside = F.coalesce(F.array_contains("choices", F.col("answer")), F.lit(False))
    checks = {
        "duplicate": F.col("_place") == 1,
        "answer type": kind.isin(*ANSWER_TYPES),
        "no choices": (kind != "multiclass") | some,
        "answer not in choices": ~kind.isin("multiclass", "binary") | ~some | inside,
        "answer not a number": (kind != "numeric") | F.col("answer").try_cast("double").isNotNull(),
        "unknown clip": F.coalesce("_known", F.lit(False)),
    }
    return lacking.unionByName(violations(checked, line, checks))


def split_violations(clips: DataFrame, items: DataFrame, counts: DataFrame) -> DataFrame:
    """reason, n: what is wrong with written splits. clips and items have split, counts (split, clips, items) is what their metadata says."""
    ids = clips.groupBy("clip_id").agg(F.count_distinct("split").alias("_splits"), F.count("*").alias("_n"))
    wrong = ids.agg(F.count_if(F.col("_splits") > 1).alias("clips in both splits"), F.count_if(F.col("_n") > F.col("_splits")).alias("clips twice in a split"))
    names = clips.agg(F.count_if(~F.coalesce(F.col("split").isin("train", "val"), F.lit(False))).alias("split is neither train nor val"))
    lost = items.join(clips.select("clip_id", "split").distinct(), ["clip_id", "split"], "left_anti").agg(F.count("*").alias("items without their clip"))
    own = clips.groupBy("split").agg(F.count("*").alias("_c")).join(items.groupBy("split").agg(F.count("*").alias("_i")), "split", "full")
    told = own.join(counts, "split", "full").agg(F.count_if(~(F.coalesce("_c", F.lit(0)).eqNullSafe(F.col("clips")) & F.coalesce("_i", F.lit(0)).eqNullSafe(F.col("items")))).alias("counts differ from the metadata"))
    one = wrong.crossJoin(names).crossJoin(lost).crossJoin(told)  # of one row each
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("reason"), F.col(f"`{c}`").alias("n")) for c in one.columns])))


AGGREGATIONS = {"mean", "min", "max", "rms", "abs_max", "max_abs"}
OPERATORS = {"less_than", "greater_than", "abs_greater_than"}


def config_errors(questions: list[dict], known_rules: set[str]) -> list[str]:
    """What is wrong with a list of questions: missing fields, repeated ids, unknown rules, bad thresholds, aggregations or operators."""
    errors, seen = [], set()
    for k, q in enumerate(questions):
        at = f"question {k}"
        for name in ("question_id", "category", "question_text", "answer_type", "rule"):
            if not q.get(name):
                errors.append(f"{at}: {name} is missing")
        if q.get("question_id") in seen:
            errors.append(f"{at}: {q['question_id']} is there twice")
        seen.add(q.get("question_id"))
        if q.get("answer_type") == "choice" and len(q.get("choices") or []) < 2:
            errors.append(f"{at}: fewer than two choices")
        rule = q.get("rule") or {}
        if rule and rule.get("name") not in known_rules:
            errors.append(f"{at}: no rule named {rule.get('name')}")
        errors += _params(rule.get("params") or {}, at)
    return errors


def _params(params: object, at: str) -> list[str]:
    if isinstance(params, list):
        return [e for k, p in enumerate(params) for e in _params(p, f"{at}[{k}]")]
    if not isinstance(params, dict):
        return []
    out = []
    for key, value in params.items():
        if "threshold" in key:
            if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in (value if isinstance(value, list) else [value])):
                out.append(f"{at}.{key}: not a number")
        elif key in ("how", "aggregation"):
            if value not in AGGREGATIONS and not (isinstance(value, str) and value[:1] == "p" and value[1:].isdigit() and int(value[1:]) <= 100):
                out.append(f"{at}.{key}: no aggregation {value}")
        elif key == "operator" and value not in OPERATORS:
            out.append(f"{at}.{key}: no operator {value}")
        else:
            out += _params(value, f"{at}.{key}")
    return out
