"""Reading tables, and cutting lineage through the folder that all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_large: dict = {}
_settings: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local session may go without; it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(Path(tempfile.mkdtemp(prefix="kinegrid-")).as_uri())
    return _own[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs neither repeat its work nor depend on lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: list, rank: str = "rank") -> DataFrame:
    """Position of every row in a total order, from 0, without bringing the rows into one task.

    Rows are dealt by range and kept; each range's count is added up over the ranges (as many rows as partitions).
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(rank, F.col("_before") + F.col("_inside") - 1).drop("_range", "_inside", "_before")


def set_aside(df: DataFrame) -> tuple[DataFrame, list]:
    """df with every column that begins with an underscore renamed, as the operators' own columns do, and the columns that give df back."""
    new = {c: f"aside{k}_{c.strip('_')}" if c.startswith("_") else c for k, c in enumerate(df.columns)}
    return df.toDF(*new.values()), [F.col(f"`{n}`").alias(c) for c, n in new.items()]


def large(key, make: Callable):
    """What make() gives, kept in a worker process for its next tasks. A worker keeps one such object: asking for another drops it."""
    if key not in _large:
        _large.clear()
        _large[key] = make()
    return _large[key]


def _give_back() -> None:
    """Free memory goes back to the system: a worker process lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: glibc's mallopt: arrays from this many bytes on go back to the system as soon as they are freed, and all threads share one heap.
_M_MMAP_THRESHOLD, _M_ARENA_MAX, _MAPPED_BYTES = -3, -8, 1 << 20


def _stay_lean() -> None:
    """Arrow and numpy in this worker process hold no memory that is free; done once for each process."""
    if "lean" in _settings:
        return
    _settings.add("lean")
    pa.set_memory_pool(pa.system_memory_pool())
    if option := getattr(ctypes.CDLL(None), "mallopt", None):
        option(_M_MMAP_THRESHOLD, _MAPPED_BYTES)
        option(_M_ARENA_MAX, 1)


def in_tasks(df: DataFrame, work: Callable, schema, keeps: bool = False) -> DataFrame:
    """mapInArrow, after which the worker gives its free memory back. keeps: the work uses large(); other work drops what a worker kept."""

    def run(batches):
        _stay_lean()
        if not keeps:
            _large.clear()
        yield from work(batches)
        _give_back()

    return df.mapInArrow(run, schema)
