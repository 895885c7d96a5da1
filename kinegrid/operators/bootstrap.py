"""Bootstrap intervals of balanced accuracy and rule compliance, all replicates in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The distribution of a Poisson draw of mean 1, up to four.
POISSON = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015)
ALPHA = 0.05


def draws(clip: str, replicates: int, seed: str = "") -> np.ndarray:
    """How often each replicate draws the clip. A digest of block and clip holds the draws of four replicates."""
    blocks = b"".join(md5(f"{seed}{k}:{clip}".encode()).digest() for k in range(-(-replicates // 4)))
    return np.searchsorted(np.array(POISSON), np.frombuffer(blocks, ">u4")[:replicates] / 4294967296.0, side="right")


def _holds(op: str, answer: Column, value: str) -> Column:
    return answer == value if op == "eq" else answer != value


def clip_cells(scored: DataFrame, rules: list[tuple]) -> DataFrame:
    """A row for each model and clip: its oracle labels, hits, and for each rule whether it applies and whether it is violated. Of several answers to a question the largest counts for the rules."""
    answers = F.map_from_entries(F.array_agg(F.struct("question_id", "pred")))
    once = scored.groupBy("model", "clip_id", "question_id").agg(F.max("pred").alias("pred"), F.array_agg(F.struct("oracle", (F.col("oracle") == F.col("pred")).alias("hit"))).alias("own"))
    clips = once.groupBy("model", "clip_id").agg(answers.alias("a"), F.flatten(F.array_agg("own")).alias("own"))
    applies, violated = [], []
    for _, if_qid, if_op, if_value, then_qid, then_op, then_value in rules:
        one, two = F.col("a")[if_qid], F.col("a")[then_qid]
        met = F.coalesce(_holds(if_op, one, if_value) & two.isNotNull(), F.lit(False))
        applies.append(met)
        violated.append(met & ~_holds(then_op, two, then_value))
    none = F.array().cast("array<boolean>")
    return clips.select("model", F.col("clip_id").cast("string").alias("clip_id"), F.col("own.oracle").alias("labels"), F.col("own.hit").alias("hits"), (F.array(*applies) if rules else none).alias("applies"), (F.array(*violated) if rules else none).alias("violated"))


def replicate_sums(cells: DataFrame, replicates: int, seed: str = "") -> DataFrame:
    """Weighted counts of each model by kind, name and replicate.

    A clip's draws are a vector with a number for each replicate, and a task adds up one vector for each cell (label, rule), so
    the rows do not grow with the replicates; what leaves a task is a vector for each cell.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def to(model, kind: str, name: str, weight: np.ndarray) -> None:
            key = (model, kind, name)
            if key not in sums:
                sums[key] = np.zeros(replicates, np.int64)
            sums[key] += weight

        for batch in batches:
            for model, clip, labels, hits, applies, violated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                weight = draws(clip, replicates, seed)
                for label, hit in zip(labels, hits, strict=True):
                    to(model, "n", label, weight)
                    to(model, "tp", label, weight * bool(hit))
                if any(applies):
                    to(model, "evaluable", "", weight)
                    to(model, "clean", "", weight * (not any(violated)))
                for k, met in enumerate(applies):
                    to(model, "rule", str(k), weight * bool(met))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in sums], pa.string()) for i in range(3)] + [pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["model", "kind", "name", "sums"])

    found = cells.select("model", "clip_id", "labels", "hits", "applies", "violated").mapInArrow(add, "model string, kind string, name string, sums array<long>")
    return found.select("model", "kind", "name", F.posexplode("sums").alias("replicate", "n")).groupBy("model", "kind", "name", "replicate").agg(F.sum("n").alias("n"))


def replicate_metrics(sums: DataFrame, digits: int = 4) -> DataFrame:
    """model, replicate, balanced_accuracy, wpcr: the rate of clips without a violation, times the share of the rules that apply to any, both rounded."""
    by = sums.groupBy("model", "replicate", "name").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("n", "tp", "evaluable", "clean", "rule")])
    rate = F.round(F.coalesce(F.sum("clean") / F.nullif(F.sum("evaluable"), F.lit(0)), F.lit(0.0)), digits)
    covered = F.coalesce(F.avg((F.col("rule") > 0).cast("double")), F.lit(0.0))
    recall = F.coalesce(F.avg(F.col("tp") / F.nullif("n", F.lit(0))), F.lit(0.0))
    return by.groupBy("model", "replicate").agg(recall.alias("balanced_accuracy"), F.round(rate * covered, digits).alias("wpcr"))


def intervals(metrics: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """model, metric, mean, low, high over the replicates; bounds by straight lines between the two nearest."""
    long = metrics.select("model", F.stack(F.lit(2), F.lit("balanced_accuracy"), "balanced_accuracy", F.lit("wpcr"), "wpcr").alias("metric", "v"))
    return long.groupBy("model", "metric").agg(F.avg("v").alias("mean"), F.percentile("v", alpha / 2).alias("low"), F.percentile("v", 1 - alpha / 2).alias("high"))


def bootstrap(scored: DataFrame, rules: list[tuple], replicates: int = 1000, seed: str = "", alpha: float = ALPHA) -> DataFrame:
    """Intervals from scored answers (model, clip_id, question_id, oracle, pred). Clips are drawn with replacement by Poisson draws from a hash, and one that is drawn twice counts as two clips."""
    known = scored.where("clip_id IS NOT NULL AND question_id IS NOT NULL AND oracle IS NOT NULL AND pred IS NOT NULL")
    return intervals(replicate_metrics(replicate_sums(clip_cells(known, rules), replicates, seed)), alpha)
