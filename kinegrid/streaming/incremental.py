"""Answers that arrive over time: those already stored are skipped, new ones are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def remaining(items: DataFrame, done: DataFrame, key: str = "qa_id") -> DataFrame:
    """Items not done yet; an item without a key is never skipped."""
    stored = done.where(F.coalesce(F.col(key), F.lit("")) != "").select(key).distinct()
    return items.join(stored, key, "left_anti")


def remaining_groups(items: DataFrame, done: DataFrame, group: str = "clip_id", key: str = "qa_id") -> DataFrame:
    """Items of the groups of which not every item is done."""
    marked = items.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    open_groups = marked.groupBy(group).agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("_all")).where("NOT _all").select(group)
    return items.join(open_groups, group, "left_semi")


#: Folders of a store. A row's folder follows from a hash, so a reader of some keys opens only their folders.
BUCKETS = 256


def _bucketed(rows: DataFrame, by: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce(F.col(by).cast("string"), F.lit(""))), F.lit(buckets)).cast("int"))


def store(rows: DataFrame, path: str, by: str = "qa_id", buckets: int = BUCKETS) -> None:
    """Append rows to the store, in the folders that `by` names."""
    _bucketed(rows, by, buckets).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def touched(rows: DataFrame, path: str, by: str = "qa_id", buckets: int = BUCKETS) -> DataFrame | None:
    """What is stored in the folders that rows fall into, None without a store. Those folders' numbers, at most `buckets`, are all that the driver sees."""
    spark = rows.sparkSession
    if not _exists(spark, path):
        return None
    numbers = [r.bucket for r in _bucketed(rows.select(by), by, buckets).select("bucket").distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(numbers))


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str = "qa_id", by: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Append each micro-batch's rows whose key is not stored. Keys are dropped within a batch and against the folders it falls into, so a batch that is run again adds nothing.

    by: the column whose hash names the folder, the key as a rule; a group's id keeps the group together, and then keys are told apart within groups.
    """
    place = by or key

    def add(batch: DataFrame, epoch: int) -> None:
        same = ["bucket", key] if place == key else ["bucket", place, key]
        named = (F.col(key).isNotNull()) & (F.col(key).cast("string") != "")
        rest = [c for c in batch.columns if c not in same]
        whole = (F.struct(*rest) if rest else F.lit(None)).alias("_rest")
        rows = _bucketed(batch.withColumn("_own", F.when(~named, F.monotonically_increasing_id())), place, buckets)  # an item without a key is never skipped
        rows = rows.select(*same, "_own", whole, F.lit(False).alias("_stored"))
        stored = touched(batch, path, place, buckets)
        if stored is not None:
            rows = rows.unionByName(stored.where(named).select(*same, F.lit(True).alias("_stored")), allowMissingColumns=True)
        # Dealt once, by the folder; a join would deal both sides again by all keys.
        found = rows.repartition("bucket").groupBy(*same, "_own").agg(F.bool_or("_stored").alias("_stored"), *([F.first("_rest", ignorenulls=True).alias("_rest")] if rest else []))
        new = found.where("NOT _stored").select(*[F.col(f"_rest.{c}") if c in rest else c for c in batch.columns], "bucket")
        new.write.mode("append").partitionBy("bucket").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_groups(items: DataFrame, path: str, group: str = "clip_id", key: str = "qa_id", buckets: int = BUCKETS) -> DataFrame:
    """Items of the groups of which the store (kept by group) lacks any: what is to be asked again. Only the folders of these groups are read."""
    stored = touched(items, path, group, buckets)
    if stored is None:
        return items
    asked = items.where(F.col(group).isNotNull()).select(*items.columns, F.lit(False).alias("_stored"))
    # Dealt once, by group, for the verdict on keys and on groups; a join would deal both sides again by both keys.
    both = asked.unionByName(stored.select(group, key, F.lit(True).alias("_stored")), allowMissingColumns=True).repartition(group)
    held = F.col(key).isNotNull() & F.bool_or("_stored").over(Window.partitionBy(group, key))
    marked = both.withColumn("_held", held).withColumn("_all", F.bool_and(F.col("_stored") | F.col("_held")).over(Window.partitionBy(group)))
    return marked.where("NOT _all AND NOT _stored").select(*items.columns)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def windowed_accuracy(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Accuracy of answers (ts, oracle, pred) by time window, with rows later than the watermark left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.avg((F.col("oracle") == F.col("pred")).cast("double")).alias("accuracy"))
