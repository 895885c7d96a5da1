"""Exact quantiles of a column, without bringing its rows into one task."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that distinct values are dealt over, at most.
RANGES = 4096


def above(value: Column, bounds: list[float], reaching: bool = False) -> Column:
    """How many of the sorted bounds are below the value (or equal to it, if reaching).

    The bounds are one constant array: first every k-th of them is compared, then the k between two of those, so a row costs about
    twice the root of their number.
    """
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) or 1

    def held(numbers: list[float]) -> Column:
        return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")  # folded to one literal

    def passed(numbers: Column) -> Column:
        v = value.cast("double")
        return F.size(F.filter(numbers, lambda b: b <= v if reaching else b < v))

    whole = passed(held([float(b) for b in bounds[step - 1 :: step]])) * step
    return whole + passed(F.slice(held([float(b) for b in bounds]), whole + 1, F.lit(step)))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = (), between: bool = True) -> DataFrame:
    """One row for each group of `by` (one in all without it) with a column for each share.

    between: at share * (n - 1), by a straight line between the two values there; else the value at place share * n, rounded down.

    Equal values are counted first, so a value held by many rows is one row. The distinct values are dealt over ranges, one for each
    shuffle partition, whose bounds come from an approximate pass; every range is summed up by itself, and the sums
    of the ranges say where it begins. Bad bounds would cost time, never change a result. Nulls take no part; an empty table
    gives nulls (no row with `by`).
    """
    parts = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.select(*by, F.col(value).alias("_v")).where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    wanted = [k / parts for k in range(1, parts)]
    bounds = counts.agg(F.percentile_approx("_v", wanted, 10 * parts)).first()[0] if wanted else None
    dealt = counts.withColumns({"_group": F.struct(F.lit(0), *by), "_part": above(F.col("_v"), sorted(set(bounds or [])))})

    ranges = dealt.groupBy("_group", "_part").agg(F.sum("_n").alias("_s"))
    whole = Window.partitionBy("_group")
    before = ranges.select("_group", "_part", (F.sum("_s").over(whole.orderBy("_part")) - F.col("_s")).alias("_before"), F.sum("_s").over(whole).alias("_all"))
    inside = F.sum("_n").over(Window.partitionBy("_group", "_part").orderBy("_v"))
    placed = dealt.withColumn("_inside", inside).join(before if by else F.broadcast(before), ["_group", "_part"])
    end = F.col("_before") + F.col("_inside")

    def at(place: Column) -> Column:
        return F.max(F.when((end - F.col("_n") <= place) & (place < end), F.col("_v")))

    places = {name: share * (F.col("_all") - 1) if between else F.floor(share * F.col("_all")) for name, share in shares.items()}
    found = placed.groupBy(*by).agg(
        *[at(F.floor(p)).alias(f"_low_{n}") for n, p in places.items()],
        *[at(F.ceil(p)).alias(f"_high_{n}") for n, p in places.items()],
        *[F.max(p - F.floor(p)).alias(f"_share_{n}") for n, p in places.items()],
    )
    line = lambda n: F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_share_{n}")
    return found.select(*by, *[(line(n) if between else F.col(f"_low_{n}")).alias(n) for n in shares])
