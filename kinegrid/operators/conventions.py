"""Sign conventions of the signals, and sensitivity of the rules that read a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinegrid.functions.series import stop_go_cycles

#: Clips looked at, and shares from which a convention is taken as right.
TURNING, BRAKING = 50, 20
TURNING_SHARE, BRAKING_SHARE = 0.9, 0.7


def sign_report(series: DataFrame, heading: str = "yaw", turning: int = TURNING, braking: int = BRAKING) -> DataFrame:
    """convention, n, agree, differ and verdict of the two conventions: turning (mean yaw rate against the change of heading, over the clips of the largest yaw rates; all that do not agree
    differ) and braking (falling speed where the mean acceleration is negative, over the clips of the lowest acceleration; unchanged speeds are in neither). Ties go to the smaller clip.
    """
    change = lambda c: F.max_by(c, "i") - F.min_by(c, "i")
    clips = series.groupBy("clip_id").agg(F.avg("yaw_rate").alias("rate"), change(heading).alias("turned"), F.max(F.abs("yaw_rate")).alias("most"), F.min("accel").alias("least"), F.avg("accel").alias("mean"), change("speed").alias("gained"))
    turns = clips.orderBy(F.desc("most"), "clip_id").limit(turning).agg(F.count("*").alias("n"), F.count_if(F.signum("rate") == F.signum("turned")).alias("agree"))
    turns = turns.select(F.lit("turning").alias("convention"), "n", "agree", (F.col("n") - F.col("agree")).alias("differ"), F.when(F.col("agree") / F.nullif("n", F.lit(0)) > TURNING_SHARE, "correct").otherwise("inconsistent").alias("verdict"))
    slow = clips.orderBy("least", "clip_id").limit(braking)
    falls = lambda c: F.count_if((F.col("mean") < 0) & c)
    brakes = slow.agg(F.count("*").alias("n"), falls(F.col("gained") < 0).alias("agree"), falls(F.col("gained") > 0).alias("differ"))
    right = F.col("agree") / (F.col("agree") + F.col("differ"))
    verdict = F.when(F.col("agree") == 0, "insufficient_data").when(right > BRAKING_SHARE, "correct").otherwise("inconsistent")
    return turns.unionByName(brakes.select(F.lit("braking").alias("convention"), "n", "agree", "differ", verdict.alias("verdict")))


def as_report(signs: DataFrame) -> DataFrame:
    """One Markdown document from sign_report."""
    row = F.format_string("| %s | %d | %d | %d | %s |", "convention", "n", "agree", "differ", "verdict")
    lines = F.array_sort(F.collect_list(row))
    head = "# Sign conventions\n\n| convention | clips | agree | differ | verdict |\n|---|---|---|---|---|\n"
    end = F.when(F.bool_and(F.col("verdict") == "correct"), "\n\nNo fix is needed.").otherwise("\n\nTo be looked into.")
    return signs.agg(F.concat(F.lit(head), F.array_join(lines, "\n"), end).alias("report"))


def event_rates(series: DataFrame, found: DataFrame, first: Column, second: Column) -> DataFrame:
    """clips, with_first, with_second, with_sequence and the least, mean and largest gap. found: clip_id and gap of sequential_event."""
    own = series.groupBy("clip_id").agg(F.bool_or(F.coalesce(first, F.lit(False))).alias("a"), F.bool_or(F.coalesce(second, F.lit(False))).alias("b"))
    gap = F.col("gap")
    return own.join(found.select("clip_id", "gap"), "clip_id", "left").agg(F.count("*").alias("clips"), F.count_if("a").alias("with_first"), F.count_if("b").alias("with_second"), F.count(gap).alias("with_sequence"), F.min(gap).alias("least"), F.avg(gap).alias("mean"), F.max(gap).alias("most"))


def stop_table(series: DataFrame, stops: list[float], go: float, least: int = 1, signal: str = "speed") -> DataFrame:
    """stop, yes, no: clips with at least so many cycles at each stop threshold. The series is spread over the thresholds only where it is an event of any."""
    some = series.where((F.col(signal) < max(stops)) | (F.col(signal) > go)).select("clip_id", "i", signal)
    keyed = some.withColumn("stop", F.explode(F.array(*map(F.lit, stops)))).withColumn("clip_id", F.struct("clip_id", "stop"))
    keyed = keyed.withColumn("_s", F.when((F.col(signal) < F.col("stop")), -1.0).when(F.col(signal) > go, 1.0).otherwise(0.0))
    cycles = stop_go_cycles(keyed, "_s", -0.5, 0.5)
    yes = cycles.where(F.col("cycles") >= least).groupBy(F.col("clip_id.stop").alias("stop")).agg(F.count("*").alias("yes"))
    clips = series.agg(F.count_distinct("clip_id").alias("clips"))
    grid = series.sparkSession.createDataFrame([(float(s),) for s in stops], "stop double")
    return grid.join(yes, "stop", "left").crossJoin(F.broadcast(clips)).select("stop", F.coalesce("yes", F.lit(0)).cast("long").alias("yes"), (F.col("clips") - F.coalesce("yes", F.lit(0))).alias("no"))


def similarity_table(halves: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, similar, first, second from clips with the values of both halves (first, second). The difference is held against the larger value, 1e-9 at least."""
    one, two = F.abs("first"), F.abs("second")
    ratio = F.abs(one - two) / F.greatest(one, two, F.lit(1e-9))
    counts = [F.struct(F.lit(t).alias("threshold"), F.count_if(ratio < t).alias("similar"), F.count_if((ratio >= t) & (one > two)).alias("first"), F.count_if((ratio >= t) & ~(one > two)).alias("second")) for t in thresholds]
    return halves.agg(F.array(*counts).alias("x")).select(F.inline("x"))


def ratio_table(axes: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, longitudinal, lateral from clips with both root mean squares; clips without longitudinal acceleration are left out."""
    ratio = F.col("lateral") / F.col("longitudinal")
    kept = axes.where(F.col("longitudinal") > 1e-9)
    counts = [F.struct(F.lit(t).alias("threshold"), F.count_if(~(ratio > t)).alias("longitudinal"), F.count_if(ratio > t).alias("lateral")) for t in thresholds]
    return kept.agg(F.array(*counts).alias("x")).select(F.inline("x"))
