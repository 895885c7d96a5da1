"""Kendall's tau of two rankings by counting inversions, without comparing pairs of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinegrid.operators.quantiles import above
from kinegrid.sources.shared import cut

#: Bounds that each ranking is cut at, at most. Pairs of different ranges are counted from (2 * RANGES + 1) ** 2 sums at most.
RANGES = 256
BIG = "decimal(38,0)"


def inversions(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> int:
    """Pairs of rows, each counted n times, of which one is first by a and the other by b."""
    if not len(a):
        return 0
    order = np.lexsort((b, a))
    b, n = np.unique(b[order], return_inverse=True)[1].ravel(), n[order].astype(np.int64)
    found = 0
    # From the highest bit on: rows of a group agree in the bits above, and a one that stands before a zero is an inversion.
    for bit in reversed(range(max(1, int(b.max()).bit_length()))):
        place = np.argsort(b >> (bit + 1), kind="stable")
        b, n = b[place], n[place]
        group, one = b >> (bit + 1), ((b >> bit) & 1).astype(bool)
        ones = np.cumsum(np.where(one, n, 0))
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        base = np.repeat(ones[heads] - np.where(one[heads], n[heads], 0), np.diff(np.append(heads, len(group))))
        found += sum(int(x) * int(y) for x, y in zip(n[~one], (ones - base)[~one], strict=True) if y)
    return found


def _cells(cells: pd.DataFrame) -> int:
    """Inversions between rows of different ranges in both rankings, from the sums of the cells."""
    rows, a = np.unique(cells["ra"], return_inverse=True)
    columns, b = np.unique(cells["rb"], return_inverse=True)
    grid = np.zeros((len(rows) + 1, len(columns) + 1), np.int64)
    grid[a.ravel() + 1, b.ravel()] = cells["n"]
    earlier = np.cumsum(np.cumsum(grid[:, ::-1], 0), 1)[:, ::-1]  # ranges up to this one by a, from this one on by b
    return sum(int(n) * int(earlier[i, j + 1]) for n, i, j in zip(cells["n"], a.ravel(), b.ravel(), strict=True))


def ranked(rows: DataFrame, left: str, right: str, ranges: int = RANGES) -> DataFrame:
    """One row: concordant and discordant pairs, of rows with two numbers; ties in either are in neither.

    Equal rows are counted first. Each number is cut into ranges at approximate quantiles, and each bound is a range of its own, so no range but
    those of one value is large, and inside these there is nothing to count. Discordant pairs are inversions: in different ranges of both
    numbers they come from the sums of the cells, in one range of the first from that range's rows, and in one range of the
    second alone from that range's rows. Concordant pairs are all pairs without the ties and the discordant ones.
    """
    pairs = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).cast("double").alias("a"), F.col(right).cast("double").alias("b")).agg(F.count("*").alias("n"))
    pairs = cut(pairs, "pairs")
    places = [k / ranges for k in range(1, ranges)]
    cuts = pairs.agg(*[F.percentile_approx(c, places, 10 * ranges) for c in ("a", "b")]).first()
    held = pairs.withColumns({f"r{c}": _range(F.col(c), sorted(set(bounds or []))) for c, bounds in zip("ab", cuts, strict=True)})
    held = cut(held, "ranged")

    def inside(one: str, two: str):
        def count(own: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"d": [inversions(own[one].to_numpy(), own[two].to_numpy(), own["n"].to_numpy())]}).astype({"d": object}).map(_whole)

        return count

    whole = held.where("ra % 2 = 0").select("ra", "a", "b", "n").groupBy("ra").applyInPandas(inside("a", "b"), f"d {BIG}")
    apart = held.where("rb % 2 = 0").groupBy("rb", "ra", "b").agg(F.sum("n").alias("n")).groupBy("rb").applyInPandas(inside("ra", "b"), f"d {BIG}")
    cells = held.groupBy("ra", "rb").agg(F.sum("n").alias("n")).withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda own: pd.DataFrame({"d": [_whole(_cells(own))]}), f"d {BIG}")
    discordant = whole.unionByName(apart).unionByName(cells).agg(F.coalesce(F.sum("d"), F.lit(0)).cast(BIG).alias("discordant"))

    def tied(*keys: str) -> DataFrame:
        s = F.sum("n").cast(BIG)
        return pairs.groupBy(*keys).agg(s.alias("s")).agg(F.coalesce(F.sum((F.col("s") * (F.col("s") - 1) / 2).cast(BIG)), F.lit(0)).cast(BIG).alias("_".join(["t", *keys])))

    one = tied().crossJoin(tied("a")).crossJoin(tied("b")).crossJoin(tied("a", "b")).crossJoin(discordant)  # of one row each
    return one.select((F.col("t") - F.col("t_a") - F.col("t_b") + F.col("t_a_b") - F.col("discordant")).cast(BIG).alias("concordant"), "discordant")


def _whole(x: int):
    from decimal import Decimal

    return Decimal(int(x))


def _range(value: Column, bounds: list[float]) -> Column:
    """Even numbers for the values between bounds, odd ones for the bounds themselves."""
    return 2 * above(value, bounds, True) - F.when(above(value, bounds, True) == above(value, bounds, False), 0).otherwise(1)


def kendall_tau(first: DataFrame, second: DataFrame, key: str = "name", rank: str = "rank") -> DataFrame:
    """tau, concordant, discordant of two rankings (key, rank) over the keys that both have: (C - D) / (C + D).

    0 if a ranking is empty, 1 if under two keys are in both or no pair is in order. A key or rank that is null takes no part; a repeated key counts with its smallest rank.
    """
    one, two = (r.where(F.col(key).isNotNull() & F.col(rank).isNotNull()).groupBy(key).agg(F.min(rank).alias(n)) for r, n in ((first, "_a"), (second, "_b")))
    counts = ranked(one.join(two, key), "_a", "_b")
    none = one.agg((F.count("*") == 0).alias("_x")).crossJoin(two.agg((F.count("*") == 0).alias("_y")))
    c, d = F.col("concordant").cast("double"), F.col("discordant").cast("double")
    tau = F.when(F.col("_x") | F.col("_y"), 0.0).when(c + d == 0, 1.0).otherwise((c - d) / (c + d))
    return counts.crossJoin(none).select(tau.alias("tau"), "concordant", "discordant")
