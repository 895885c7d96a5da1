"""Rows put into files in order, each file bounded by bytes and by rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinegrid.sources.shared import cut, numbered


def jumps(begin: np.ndarray, size: np.ndarray, own: int, most_bytes: int, most_rows: int) -> np.ndarray:
    """For each of the first `own` rows, the first row that no longer fits into a file that begins with it."""
    start = np.arange(own)
    full = np.searchsorted(begin + size, begin[:own] + most_bytes, side="right")
    return np.maximum(np.minimum(full, start + most_rows), start + 1)


def leaving(jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the files that begin with each row lead out of the rows, and how many files that takes."""
    own, to, hops = len(jump), jump.copy(), np.ones(len(jump), np.int64)
    while (inside := np.flatnonzero(to < own)).size:
        hops[inside], to[inside] = hops[inside] + hops[to[inside]], to[to[inside]]
    return to, hops


def next_fit(df: DataFrame, order: list, size: Column, most_bytes: int, most_rows: int) -> DataFrame:
    """df with batch: rows in order go to the open file, and a new file is begun where one would pass most_bytes or most_rows.

    That is the sequential rule; a row larger than most_bytes has a file of its own, and if it is the very first, file 0 stays empty. The rows are cut
    into ranges of at least most_rows. A task knows of each row in its range which row begins the next file, by a search in prefix
    sums (with the next range's first rows), and so for each row at which a file from before may end, where the range is left and after how many files. These short maps are
    composed, doubling their reach in each round, to find the one row at which each range is really entered; the files inside follow from it. No task holds more than two ranges.
    """
    spark = df.sparkSession
    rows = cut(numbered(df, order, size), "numbered")
    n = rows.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = max(most_rows, -(-n // parts), 1)
    last = max(1, n // width) - 1
    at = F.least(F.floor(F.col("_idx") / width), F.lit(last)).cast("long")
    slim = rows.select("_idx", "_begin", "_size", at.alias("_range"))
    ahead = slim.where((F.col("_range") > 0) & (F.col("_idx") - F.col("_range") * width < most_rows)).withColumn("_range", F.col("_range") - 1)
    both = slim.unionByName(ahead)

    def parted(own: pd.DataFrame) -> tuple[int, int, np.ndarray]:
        own = own.sort_values("_idx")
        low = int(own["_range"].iloc[0]) * width
        count = len(own) if low // width == last else width
        return low, count, jumps(own["_begin"].to_numpy(), own["_size"].to_numpy(), count, most_bytes, most_rows)

    def passes(own: pd.DataFrame) -> pd.DataFrame:
        low, count, jump = parted(own)
        to, hops = leaving(jump)
        entries = np.arange(min(most_rows, count))
        return pd.DataFrame({"at": low + entries, "to": low + to[entries], "hops": hops[entries]})

    steps = cut(both.groupBy("_range").applyInPandas(passes, "at long, to long, hops long"), "passes")
    first = rows.where("_idx = 0").select((F.col("_size") > most_bytes).cast("long")).first()
    known = spark.createDataFrame([(0, first[0])] if first else [], "at long, file long")
    while True:
        new = known.join(steps, "at").where(F.col("to") < n).select(F.col("to").alias("at"), (F.col("file") + F.col("hops")).alias("file"))
        both_known = cut(known.unionByName(new).distinct(), "entries")
        if both_known.count() == known.count():
            break
        known = both_known
        onward = steps.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"))
        steps = cut(steps.join(onward, "to").select("at", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops")), "passes")
    entered = known.select(F.least(F.floor(F.col("at") / width), F.lit(last)).cast("long").alias("_range"), "at", "file")

    def begun(own: pd.DataFrame) -> pd.DataFrame:
        low, count, jump = parted(own)
        k, file, out = int(own["at"].iloc[0]) - low, int(own["file"].iloc[0]), []
        while k < count:
            out.append((low // width, low + k, file))
            k, file = int(jump[k]), file + 1
        return pd.DataFrame(out, columns=["_range", "_idx", "batch"])

    starts = both.join(entered, "_range").groupBy("_range").applyInPandas(begun, "_range long, _idx long, batch long")
    # The begins of files and the rows are put in order together; rows before a range's first begin are in the file before.
    marked = rows.drop("_begin", "_size").withColumn("_range", at).unionByName(starts.withColumn("_begins", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy("_range")
    open_file = F.last("batch", ignorenulls=True).over(inside.orderBy("_idx", F.col("_begins").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = marked.withColumns({"_open": open_file, "_first": F.min("batch").over(inside)}).where("_begins IS NULL")
    return placed.withColumn("batch", F.coalesce("_open", F.col("_first") - 1)).select(*df.columns, "batch")


def bodies(placed: DataFrame, columns: list[str]) -> DataFrame:
    """batch and body: what each file of next_fit holds, its rows as JSON lines in the order of the columns.

    A record for each file keeps millions of small files in a few large ones; a body is bounded as a file is, and an uploader takes records as they are.
    """
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    return placed.groupBy("batch").agg(F.array_join(F.transform(rows, lambda x: F.to_json(x)), "\n").alias("body"))


def in_sequence(sizes: Iterator[int], most_bytes: int, most_rows: int) -> list[int]:
    """The rule itself, one row after the other: the file of each."""
    out, file, held, count = [], 0, 0, 0
    for size in sizes:
        if held + size > most_bytes or count >= most_rows:
            file, held, count = file + 1, 0, 0
        held, count = held + size, count + 1
        out.append(file)
    return out
