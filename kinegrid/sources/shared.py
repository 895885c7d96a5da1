"""Intermediate tables in the folder that all executors share, and positions of rows in an order."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a local session without it gets a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(Path(tempfile.mkdtemp(prefix="kinegrid-files-")).as_uri())
        shared = _own[0]
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: later jobs neither repeat its work nor depend on lost executors."""
    spark, path = df.sparkSession, place(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, size: Column | None = None) -> DataFrame:
    """df with _idx, the row's place in the order from 0, and _begin, the sum of size over the rows before it (with a size, kept as _size).

    Rows are dealt by range and kept; a range is put in order by itself, and the counts of the ranges, a row for each, say where it begins.
    """
    sized = df.withColumn("_size", (F.lit(0) if size is None else size).cast("long"))
    placed = cut(sized.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_all"))
    upto = Window.orderBy("_part")
    before = sums.select("_part", (F.sum("_rows").over(upto) - F.col("_rows")).alias("_rows"), (F.sum("_all").over(upto) - F.col("_all")).alias("_all"))
    inside = Window.partitionBy("_part").orderBy(*order)
    running = F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size")
    out = placed.withColumns({"_idx": (F.row_number().over(inside) - 1).cast("long"), "_begin": running}).join(F.broadcast(before), "_part")
    out = out.withColumns({"_idx": F.col("_idx") + F.col("_rows"), "_begin": F.col("_begin") + F.col("_all")}).drop("_part", "_rows", "_all")
    return out.drop("_begin", "_size") if size is None else out
