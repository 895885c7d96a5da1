"""Per-clip features of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(value: Column) -> Column:
    """The value, null where it is not a number."""
    return F.when(~F.isnan(value), value)


def aggregate(value: Column, how: str, order: Column | None = None) -> Column:
    """mean, min, max, rms, abs_max (the value of largest magnitude, the earliest on ties), max_abs or pNN; values that are not numbers are left out."""
    v = known(value)
    plain = {"mean": F.avg, "min": F.min, "max": F.max}
    if how in plain:
        return plain[how](v)
    if how == "rms":
        return F.sqrt(F.avg(v * v))
    if how == "max_abs":
        return F.max(F.abs(v))
    if how == "abs_max":
        return F.max_by(v, F.when(v.isNotNull(), F.struct(F.abs(v), -(order if order is not None else F.col("i")))))
    if how.startswith("p") and how[1:].isdigit() and int(how[1:]) <= 100:
        return F.percentile(v, int(how[1:]) / 100)
    raise ValueError(f"unknown aggregation {how}")


def feature_aggregates() -> dict[str, Column]:
    """The twelve features of a clip, each as an aggregate; the heading change adds up the turn of every step but the first."""
    speed, accel, yaw_rate, jerk = (F.col(c) for c in ("speed", "accel", "yaw_rate", "jerk"))
    return {
        "max_speed": F.max(speed),
        "mean_speed": F.avg(speed),
        "min_accel": F.min(accel),
        "max_accel": F.max(accel),
        "mean_accel": F.avg(accel),
        "max_abs_yaw_rate": F.max(F.abs(yaw_rate)),
        "signed_max_yaw_rate": aggregate(yaw_rate, "abs_max"),
        "max_abs_jerk": F.max(F.abs(jerk)),
        "p95_abs_jerk": F.percentile(F.abs(jerk), 0.95),
        "mean_abs_jerk": F.avg(F.abs(jerk)),
        "max_lateral_accel": F.max(speed * F.abs(yaw_rate)),
        "total_heading_change": F.sum(F.when(F.col("i") > 0, F.abs(yaw_rate) * 0.1).otherwise(0.0)),
    }


def summary_features(series: DataFrame) -> DataFrame:
    """All features of each clip in one aggregation."""
    return series.groupBy("clip_id").agg(*[c.alias(n) for n, c in feature_aggregates().items()])
