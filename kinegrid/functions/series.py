"""Time-series operators over rows in the order of a clip's samples."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quadratic smoothing over five samples.
SMOOTH_5 = (-3.0, 12.0, 17.0, 12.0, -3.0)
SMOOTH_5_SUM = 35.0
GRAVITY = 9.81


def clip_window(order: str = "i"):
    return Window.partitionBy("clip_id").orderBy(order)


def central_difference(value: str, time: str = "t", order: str = "i") -> Column:
    """Slope between the two neighbours; one-sided at the ends, 0 for a lone sample."""
    w = clip_window(order)

    def near(name: str, step: int) -> Column:
        return F.coalesce((F.lead if step > 0 else F.lag)(name).over(w), F.col(name))

    dt = near(time, 1) - near(time, -1)
    return F.when(dt > 0, (near(value, 1) - near(value, -1)) / dt).otherwise(0.0)


def planar_speed(x: str = "x", y: str = "y", time: str = "t", order: str = "i") -> Column:
    return F.sqrt(F.pow(central_difference(x, time, order), 2) + F.pow(central_difference(y, time, order), 2))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def smooth(values: Column) -> Column:
    """Five-sample quadratic smoothing of an array, mirrored at the ends without repeating them; fewer than five samples stay."""
    return let(values, _smoothed)


def slopes(values: Column, times: Column) -> Column:
    """Central differences of an array against another, one-sided at the ends."""

    def of(v: Column) -> Column:
        n = F.size(v)
        low = lambda i: F.greatest(i - 1, F.lit(0)) + 1
        high = lambda i: F.least(i + 1, n - 1) + 1
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.element_at(v, high(i)) - F.element_at(v, low(i))) / (F.element_at(times, high(i)) - F.element_at(times, low(i))))

    return let(values, of)


def _smoothed(values: Column) -> Column:
    n = F.size(values)

    def at(i: Column) -> Column:
        k = F.abs(i)
        return F.element_at(values, F.when(k >= n, 2 * n - 2 - k).otherwise(k) + 1)

    def one(i: Column) -> Column:
        total = SMOOTH_5[0] * at(i - 2)
        for k in range(1, 5):
            total = total + SMOOTH_5[k] * at(i + (k - 2))
        return total / SMOOTH_5_SUM

    return F.when(n < 5, values).otherwise(F.transform(F.sequence(F.lit(0), n - 1), one))


def unwrapped(angle: str, order: str = "i") -> Column:
    """Angles with jumps of over half a turn taken out: a running sum of whole turns."""
    step = F.col(angle) - F.lag(angle).over(clip_window(order))
    wrapped = step - 2 * pi * F.floor((step + pi) / (2 * pi))
    fixed = F.when((wrapped == -pi) & (step > 0), pi).otherwise(wrapped)
    return F.struct(F.coalesce(F.when(F.abs(step) < pi, F.lit(0.0)).otherwise(fixed - step), F.lit(0.0)).alias("turn"))["turn"]


def with_unwrapped(df: DataFrame, angle: str, name: str, order: str = "i") -> DataFrame:
    turned = df.withColumn("_turn", unwrapped(angle, order))
    total = F.sum("_turn").over(clip_window(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return turned.withColumn(name, F.col(angle) + total).drop("_turn")


#: Samples of a clip's grid at most: over a day at ten a second. A clip beyond has a wrong time, and over_long names it.
MOST_SAMPLES = 1_000_000


def _spans(tracks: DataFrame, hz: float) -> DataFrame:
    ends = tracks.groupBy("clip_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return ends.withColumn("n", F.ceil((F.col("t1") - F.col("t0")) * hz) + 1)


def uniform_grid(tracks: DataFrame, hz: float = 10.0, most: int = MOST_SAMPLES) -> DataFrame:
    """clip_id, i, t: ceil(duration * hz) + 1 samples from the first to the last time, both included. Clips of more than `most` samples get none."""
    rows = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    kept = _spans(tracks, hz).where((F.col("t1") > F.col("t0")) & (F.col("n") <= most))
    return kept.select("clip_id", rows.alias("i"), "t0", "t1", "n").select("clip_id", "i", (F.col("t0") + F.col("i") * (F.col("t1") - F.col("t0")) / (F.col("n") - 1)).alias("t"))


def over_long(tracks: DataFrame, hz: float = 10.0, most: int = MOST_SAMPLES) -> DataFrame:
    """clip_id, t0, t1 and n of the clips that uniform_grid leaves out."""
    return _spans(tracks, hz).where(F.col("n") > most)


def resample(tracks: DataFrame, grid: DataFrame, values: list[str]) -> DataFrame:
    """Values of the tracks at the grid's times by straight lines between samples; the end segments go on beyond the ends. One sort of both by time."""
    w = clip_window("ts")
    ahead = tracks.withColumns({"_to": F.lead("ts").over(w), **{f"_{v}": F.lead(v).over(w) for v in values}}).where("_to > ts")
    segments = ahead.select("clip_id", F.lit(None).cast("long").alias("i"), F.col("ts").alias("t"), F.struct("ts", "_to", *values, *[f"_{v}" for v in values]).alias("_s"))
    both = segments.unionByName(grid.select("clip_id", "i", "t"), allowMissingColumns=True)
    passed = Window.partitionBy("clip_id").orderBy("t", F.col("i").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min(F.when(F.col("i").isNull(), F.col("_s"))).over(Window.partitionBy("clip_id"))
    placed = both.withColumn("_s", F.coalesce(F.last("_s", ignorenulls=True).over(passed), first)).where("i IS NOT NULL AND _s IS NOT NULL")
    share = (F.col("t") - F.col("_s.ts")) / (F.col("_s._to") - F.col("_s.ts"))
    return placed.select("clip_id", "i", "t", *[(F.col(f"_s.{v}") + share * (F.col(f"_s._{v}") - F.col(f"_s.{v}"))).alias(v) for v in values])


def with_next(df: DataFrame, event: Column, name: str, low: float, high: float, order: str = "t", group: str = "clip_id") -> DataFrame:
    """df with the earliest time at which the event holds between low and high after the row's own time, both included; null if there is none.

    Rows and events of a group are put in one order from the last to the first, the rows moved on by low, and the event met last is carried
    along: one sort and one pass, however wide the gap.
    """
    at = F.col(order)
    own = F.array(F.struct((at + low).alias("_at"), F.lit(None).cast("double").alias("_event")))
    events = F.when(event, F.array(F.struct(at.cast("double").alias("_at"), at.cast("double").alias("_event")))).otherwise(F.array().cast("array<struct<_at:double,_event:double>>"))
    both = df.withColumn("_m", F.explode(F.concat(own, events))).select(*df.columns, "_m._at", "_m._event")
    # at the same time an event comes before the rows that look for it
    passed = Window.partitionBy(group).orderBy(F.desc("_at"), F.col("_event").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(name, F.last("_event", ignorenulls=True).over(passed)).where("_event IS NULL")
    return found.withColumn(name, F.when(F.col(name) <= at + high, F.col(name))).select(*df.columns, name)


def count_inside(spans: DataFrame, points: DataFrame, key: str, begin: str, end: str, time: str, group: str = "clip_id") -> DataFrame:
    """group, key and points: how many points of the group lie between begin and end of each span, both included, and the places of the first and last (from 0; null if none).

    Ends of spans and points are put in one order with a running count; a span's points are those counted at its end and not at its begin. The
    cost does not depend on how long the spans are. A span has at most one row for each key.
    """
    ends = F.explode(F.array(F.struct(F.col(begin).cast("double").alias("_at"), F.lit(0).alias("_kind")), F.struct(F.col(end).cast("double").alias("_at"), F.lit(2).alias("_kind"))))
    marks = spans.select(group, key, ends.alias("_m")).select(group, key, "_m._at", "_m._kind")
    both = marks.unionByName(points.select(group, F.col(time).cast("double").alias("_at"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    passed = Window.partitionBy(group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("_n", F.count(F.when(F.col("_kind") == 1, 1)).over(passed)).where("_kind <> 1")
    low, high = (F.max(F.when(F.col("_kind") == k, F.col("_n"))) for k in (0, 2))
    n = F.greatest(high - low, F.lit(0))
    return counted.groupBy(group, key).agg(n.alias("points"), F.when(high > low, low).alias("first"), F.when(high > low, high - 1).alias("last"))


def overlapping_windows(track: DataFrame, size: int, order: str = "i") -> DataFrame:
    """Windows of `size` samples, each beginning at the last sample of the one before; a partial window at the end is dropped. Adds w and j."""
    step = size - 1
    k = F.col(order)
    own = F.array(F.floor(k / step))
    windows = F.when((k % step == 0) & (k > 0), F.concat(own, F.array(F.floor(k / step) - 1))).otherwise(own)
    placed = track.withColumn("w", F.explode(windows)).withColumn("j", k - F.col("w") * step)
    return placed.withColumn("_n", F.count("*").over(Window.partitionBy("clip_id", "w"))).where(F.col("_n") == size).drop("_n")


def even_picks(n: Column, k: int) -> Column:
    """k places among n, evenly spaced, ties of rounding to even; all if n <= k, the middle one if k is 1."""
    if k == 1:
        return F.when(n > 0, F.array(F.floor(n / 2).cast("long"))).otherwise(F.array().cast("array<long>"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(k - 1)), 0).cast("long"))
    return F.when(n <= 0, F.array().cast("array<long>")).when(n <= k, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(picks)


def yaw_of(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Heading of a unit quaternion."""
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def stop_go_cycles(df: DataFrame, value: str, stop: float, go: float, order: str = "i") -> DataFrame:
    """Times a clip goes from stopped (below stop) to moving (above go), stop <= go: changes between the events that are either."""
    if stop > go:
        raise ValueError("stop must not be above go")
    events = df.where((F.col(value) < stop) | (F.col(value) > go)).withColumn("_go", F.col(value) > go)
    before = F.lag("_go").over(clip_window(order))
    counted = events.withColumn("_cycle", F.col("_go") & ~F.coalesce(before, F.lit(True)))
    return counted.groupBy("clip_id").agg(F.sum(F.col("_cycle").cast("int")).cast("long").alias("cycles"))
