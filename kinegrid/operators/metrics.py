"""Scoring of predictions against labels: one confusion count feeds every metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, keys: list[str], oracle: str = "oracle", pred: str = "pred") -> DataFrame:
    """n and accuracy of each group; 0 where there is nothing."""
    right = F.avg((F.col(oracle) == F.col(pred)).cast("double"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(right, F.lit(0.0)).alias("accuracy"))


def label_counts(df: DataFrame, keys: list[str], oracle: str = "oracle", pred: str = "pred") -> DataFrame:
    """tp, n_oracle and n_pred of each label that occurs on either side, by group: one shuffle of counted pairs."""
    pairs = df.groupBy(*keys, oracle, pred).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col(oracle).alias("label"), F.lit(True).alias("is_oracle")), F.struct(F.col(pred).alias("label"), F.lit(False).alias("is_oracle"))))
    spread = pairs.withColumn("s", sides)
    same = F.col(oracle) == F.col(pred)
    return spread.groupBy(*keys, F.col("s.label").alias("label")).agg(
        F.sum(F.when(same & F.col("s.is_oracle"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.is_oracle"), F.col("n")).otherwise(0)).alias("n_oracle"),
        F.sum(F.when(~F.col("s.is_oracle"), F.col("n")).otherwise(0)).alias("n_pred"),
    )


def f1() -> Column:
    return F.coalesce(2 * F.col("tp") / F.nullif(F.col("n_oracle") + F.col("n_pred"), F.lit(0)), F.lit(0.0))


def macro_f1(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean F1 over all labels of a group; a label never hit scores 0."""
    return counts.groupBy(*keys).agg(F.avg(f1()).alias("macro_f1"))


def balanced_accuracy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean recall over the labels that the oracle has."""
    recall = F.col("tp") / F.nullif("n_oracle", F.lit(0))
    return counts.groupBy(*keys).agg(F.coalesce(F.avg(recall), F.lit(0.0)).alias("balanced_accuracy"))


def group_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, accuracy, balanced_accuracy, macro_f1, from the label counts alone."""
    counts = label_counts(df, keys)
    recall = F.col("tp") / F.nullif("n_oracle", F.lit(0))
    return counts.groupBy(*keys).agg(F.sum("n_oracle").alias("n"), (F.sum("tp") / F.sum("n_oracle")).alias("accuracy"), F.coalesce(F.avg(recall), F.lit(0.0)).alias("balanced_accuracy"), F.avg(f1()).alias("macro_f1"))


def multi_group_metrics(df: DataFrame, groupings: list[str], temporal: list[str] | None = None, choices: dict[str, list[str]] | None = None) -> DataFrame:
    """n, accuracy, balanced_accuracy and macro_f1 overall, by each of the groupings and over the temporal questions: (scope, key, ...).

    The labels of a group are those that occur in it on either side; those of a question that has choices are its choices, whether they
    occur or not: others count in n and accuracy alone. The pairs are counted once for all scopes. Groups without a row are left out, the temporal one
    too.
    """
    spark = df.sparkSession
    by = list(dict.fromkeys([*groupings, *(["question_id"] if temporal is not None or choices else [])]))
    pairs = df.groupBy(*by, "oracle", "pred").agg(F.count("*").alias("n"))
    scope = lambda name, key: F.struct(F.lit(name).alias("scope"), key.cast("string").alias("key"))
    scopes = [scope("global", F.lit("")), *[scope(g, F.col(g)) for g in groupings]]
    if temporal is not None:
        scopes.append(F.when(F.col("question_id").isin(temporal), scope("temporal", F.lit(""))))
    cube = pairs.withColumn("g", F.explode(F.array_compact(F.array(*scopes)))).groupBy(F.col("g.scope").alias("scope"), F.col("g.key").alias("key"), "oracle", "pred").agg(F.sum("n").alias("n"))
    right = F.sum(F.when(F.col("oracle") == F.col("pred"), F.col("n")).otherwise(0))
    whole = cube.groupBy("scope", "key").agg(F.sum("n").alias("n"), (right / F.sum("n")).alias("accuracy"))
    sides = F.explode(F.array(F.struct(F.col("oracle").alias("label"), F.lit(True).alias("o")), F.struct(F.col("pred").alias("label"), F.lit(False).alias("o"))))
    same = F.col("oracle") == F.col("pred")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    counts = cube.withColumn("s", sides).groupBy("scope", "key", F.col("s.label").alias("label")).agg(total(same & F.col("s.o")).alias("tp"), total(F.col("s.o")).alias("n_oracle"), total(~F.col("s.o")).alias("n_pred"))
    if choices:
        listed = spark.createDataFrame([("question_id", q, label) for q, own in choices.items() for label in own], "scope string, key string, label string")
        fixed = listed.select("scope", "key").distinct().withColumn("_fixed", F.lit(True))
        free = counts.join(F.broadcast(fixed), ["scope", "key"], "left_anti")
        there = F.broadcast(listed).join(whole.select("scope", "key"), ["scope", "key"])
        counts = free.unionByName(there.join(counts, ["scope", "key", "label"], "left").na.fill(0, ["tp", "n_oracle", "n_pred"]))
    recall = F.col("tp") / F.nullif("n_oracle", F.lit(0))
    scored = counts.groupBy("scope", "key").agg(F.coalesce(F.avg(recall), F.lit(0.0)).alias("balanced_accuracy"), F.avg(f1()).alias("macro_f1"))
    return whole.join(scored, ["scope", "key"]).select("scope", "key", "n", "accuracy", "balanced_accuracy", "macro_f1")


def confusion(df: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each pair of the given labels, 0 where it never occurs; other pairs are left out."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "oracle string, pred string")
    counts = df.where(F.col("oracle").isin(labels) & F.col("pred").isin(labels)).groupBy("oracle", "pred").agg(F.count("*").alias("n"))
    return grid.join(counts, ["oracle", "pred"], "left").select("oracle", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: A rule: if the clip's answer to one question is (or is not) a value, its answer to another must be (or not be) a value.
RULE = "name string, if_qid string, if_op string, if_val string, then_qid string, then_op string, then_val string"


def rule_checks(answers: DataFrame, rules: DataFrame) -> DataFrame:
    """clip_id, name, violated for every rule that applies to a clip with both answers. The rules are a small table."""

    def holds(op: str, answer: str, value: str) -> Column:
        return F.when(F.col(op) == "eq", F.col(answer) == F.col(value)).otherwise(F.col(answer) != F.col(value))

    one = answers.select("clip_id", F.col("question_id").alias("if_qid"), F.col("answer").alias("if_answer"))
    two = answers.select("clip_id", F.col("question_id").alias("then_qid"), F.col("answer").alias("then_answer"))
    met = one.join(F.broadcast(rules), "if_qid").where(holds("if_op", "if_answer", "if_val"))
    return met.join(two, ["clip_id", "then_qid"]).select("clip_id", "name", (~holds("then_op", "then_answer", "then_val")).alias("violated"))


def rule_compliance(checks: DataFrame, rules: DataFrame) -> DataFrame:
    """n_applicable, n_violations and compliance of each rule; 1 where it never applies."""
    counts = checks.groupBy("name").agg(F.count("*").alias("n_applicable"), F.count_if("violated").alias("n_violations"))
    out = rules.select("name").join(counts, "name", "left").na.fill(0, ["n_applicable", "n_violations"])
    return out.withColumn("compliance", F.when(F.col("n_applicable") > 0, 1 - F.col("n_violations") / F.col("n_applicable")).otherwise(1.0))


def consistency(answers: DataFrame, rules: DataFrame, digits: int = 4) -> DataFrame:
    """One row: rate (clips without a violation among those that a rule applies to), coverage, mean violations, mean compliance, and wemcr, the rounded rate times the share of rules that ever apply."""
    checks = rule_checks(answers, rules)
    clips = checks.groupBy("clip_id").agg(F.count_if("violated").alias("v"))
    c = clips.agg(F.count("*").alias("n"), F.count_if(F.expr("v = 0")).alias("clean"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean_violations"))
    r = rule_compliance(checks, rules).agg(F.avg((F.col("n_applicable") > 0).cast("double")).alias("rule_coverage"), F.avg("compliance").alias("mean_compliance"))
    total = answers.agg(F.count_distinct("clip_id").alias("clips"))
    rate = F.round(F.when(F.col("n") > 0, F.col("clean") / F.col("n")).otherwise(0.0), digits)
    return c.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(total)).select(rate.alias("rate"), F.round(rate * F.col("rule_coverage"), digits).alias("wemcr"), F.round("mean_compliance", digits).alias("mean_compliance"), F.round(F.col("n") / F.nullif("clips", F.lit(0)), digits).alias("coverage"), F.round("mean_violations", digits).alias("mean_violations"))
