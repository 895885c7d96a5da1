"""The test tables in the shapes the operators expect; each has the same meaning in SQL in kinegrid.plans.prelude."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip for each vector: clip_id, i, t (0.1 s apart), speed, accel, yaw_rate, jerk."""
    e = F.col("embedding").cast("array<double>")

    def at(shift: int):
        return lambda i: F.element_at(e, ((i + shift) % F.size(e)) + 1)

    rows = F.transform(
        F.sequence(F.lit(0), F.size(e) - 1),
        lambda i: F.struct(i.cast("long").alias("i"), (i * F.lit(0.1)).alias("t"), (F.abs(at(0)(i)) * 40).alias("speed"), (at(0)(i) * 10).alias("accel"), (at(7)(i) * F.lit(0.5)).alias("yaw_rate"), (at(13)(i) * 20).alias("jerk")),
    )
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.inline(rows))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track for each user's events: clip_id, k, ts (seconds from its first), x, y, yaw; irregular in time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip_id"),
        (F.row_number().over(w) - 1).cast("long").alias("k"),
        ((micros - F.first(micros).over(w)) / 1e6).alias("ts"),
        F.col("value").alias("x"),
        (F.col("value") * F.col("value") / 100).alias("y"),
        ((F.col("event_id") % 7).cast("double") - 3.0).alias("yaw"),
    )


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against labels: model, clip_id, category, question_id, source, oracle, pred."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
        F.col("l_orderkey").alias("clip_id"),
        F.col("o_orderpriority").alias("category"),
        F.col("l_returnflag").alias("question_id"),
        F.when(F.col("l_suppkey") % 3 == 0, "real").otherwise("simulated").alias("source"),
        F.col("o_orderstatus").alias("oracle"),
        F.col("l_linestatus").alias("pred"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled clips by question: clip_id (a customer), source, question_id, answer; an order for each question is kept, the smallest key."""
    orders = table(spark, sf_dir, "orders")
    first = orders.groupBy("o_custkey").agg(F.min_by(F.struct("o_orderstatus", "o_orderpriority", "o_totalprice"), "o_orderkey").alias("o"))
    price = F.when(F.col("o.o_totalprice") < 150000, "low").when(F.col("o.o_totalprice") < 300000, "medium").otherwise("high")
    return first.select(
        F.col("o_custkey").alias("clip_id"),
        F.when(F.col("o_custkey") % 2 == 0, "real").otherwise("simulated").alias("source"),
        F.stack(F.lit(3), F.lit("status"), F.col("o.o_orderstatus"), F.lit("priority"), F.col("o.o_orderpriority"), F.lit("price"), price).alias("question_id", "answer"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text answers: conv_id, turn, model_answer."""
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("model_answer"))
