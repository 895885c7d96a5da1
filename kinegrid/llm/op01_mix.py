"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

A budget of words is shared among the sources by weight. A source whose share passes its cap (a number of epochs of its own
words) is clamped there and the excess goes to the others by weight, until none is above its cap. A document is then taken
for every whole epoch of its source, and the fraction that is left takes documents in the order of a seeded hash up to the
point where the words reach the target, so a source misses its target by half a document at most.

Nulls: a null source is a source of its own and sorts last; a null text has size 0; a null id hashes as the text "null".
Repeated rows are documents of their own with the same fate. An empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinegrid.llm.common import cut, global_rank, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, BUDGET, EPOCHS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, "mix-1"
HASH_BITS = 60
#: Documents that share a hash bucket, about; the bucket in which a source's target falls is put in order.
IN_BUCKET = 4096
#: Sources in a table that is sent to every executor; beyond it the join is dealt out by source.
SENT_SOURCES = 20_000


def draw(doc_id: Column, seed: str) -> Column:
    """A seeded draw in [0, 2**60), the same on every run and in SQL."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, HASH_BITS // 4), 16, 10).cast("long")


def fill(sources: DataFrame, budget: float) -> float:
    """The level at which min(cap, weight * level) adds up to the budget. sources: weight, cap. Each round reads one row of sums."""
    level = 0.0
    while True:
        held = F.col("cap") <= F.col("weight") * F.lit(level)
        clamped, open_weight = sources.agg(F.sum(F.when(held, F.col("cap")).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            return level
        risen = (budget - clamped) / open_weight
        if risen <= level:
            return level
        level = risen


def source_plan(sized: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """A row for each source: source, source_size, target, whole (epochs for all its documents), last_draw (documents that draw this or less get one more).

    sized: _source, _size, _draw of every document. It is read three times, so it should be a written table.
    """
    totals = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count("*").alias("_docs"))
    ranked = global_rank(totals, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int") + 1)
    ranked = cut(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(epochs)), "sources")
    total, most = ranked.agg(F.sum("source_size"), F.max("_docs")).first()
    level = fill(ranked, min(budget, epochs) * (total or 0))
    plan = ranked.withColumn("target", F.least("cap", F.col("weight") * F.lit(level)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole).withColumn("_goal", F.col("target") - F.col("whole") * F.col("source_size"))

    bits = min(20, max(4, ceil(log2(max(1, (most or 1) / IN_BUCKET)))))
    bucketed = sized.withColumn("_bucket", F.shiftright("_draw", HASH_BITS - bits))
    sums = bucketed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"))
    upto = F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket"))
    goals = F.broadcast(plan.select("source", "_goal")) if ranked.count() <= SENT_SOURCES else plan.select("source", "_goal")
    edge = (
        sums.withColumn("_upto", upto)
        .join(goals, F.col("_source").eqNullSafe(F.col("source")))
        .where((F.col("_upto") - F.col("_words") <= F.col("_goal")) & (F.col("_goal") < F.col("_upto")))
        .select(F.col("source"), F.col("_bucket").alias("_edge"), (F.col("_goal") - F.col("_upto") + F.col("_words")).alias("_rest"))
    )
    edge = cut(edge, "edges")
    at_edge = bucketed.join(F.broadcast(edge) if edge.count() <= SENT_SOURCES else edge, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_bucket") == F.col("_edge")))
    groups = at_edge.groupBy("source", "_edge", "_rest", "_draw").agg(F.sum("_size").alias("_words"))
    middle = F.sum("_words").over(Window.partitionBy("source").orderBy("_draw")) - F.col("_words") / 2
    last = F.max(F.when(F.col("_middle") <= F.col("_rest"), F.col("_draw")))
    before = F.shiftleft(F.first("_edge"), HASH_BITS - bits) - 1
    reached = groups.withColumn("_middle", middle).groupBy("source").agg(F.coalesce(last, before).alias("last_draw")).withColumnRenamed("source", "_of")
    out = plan.join(reached, F.col("source").eqNullSafe(F.col("_of")), "left")
    return out.select("source", "source_size", "target", "whole", F.when(F.col("_goal") > 0, F.coalesce("last_draw", F.lit(-1))).otherwise(F.lit(-1)).cast("long").alias("last_draw"))


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").alias("_source"), size.alias("_size"), draw(F.col("doc_id"), seed).alias("_draw"))


def _planned(docs: DataFrame, plan: DataFrame) -> DataFrame:
    few = plan.count() <= SENT_SOURCES
    plan = plan.withColumnRenamed("source", "_of")
    return docs.join(F.broadcast(plan) if few else plan, F.col("_source").eqNullSafe(F.col("_of")))


def _copies() -> Column:
    return F.col("whole") + F.when(F.col("_draw") <= F.col("last_draw"), 1).otherwise(0)


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """How many words the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    sized = cut(sizes(docs, how.get("seed", SEED)), "sizes")
    plan = cut(source_plan(sized, **how), "plan")
    return _planned(sized, plan).select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * _copies()).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    seed = how.get("seed", SEED)
    plan = cut(source_plan(cut(sizes(docs, seed), "sizes"), **how), "plan")
    drawn = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("source").alias("_source"), draw(F.col("doc_id"), seed).alias("_draw"))
    copies = _planned(drawn, plan.drop("source_size", "target")).withColumn("_copies", _copies().cast("int")).where("_copies > 0")
    return copies.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


QUERIES = {"op1_mix": op1_mix}

ORACLE_SQL = {
    "op1_mix": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio, sum(cap) OVER r - cap AS cap_before, sum(weight) OVER r - weight AS weight_before, sum(weight) OVER () AS weights, 1.5::DOUBLE * sum(source_size) OVER () AS budget
      FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT min((budget - cap_before) / (weights - weight_before)) AS level FROM (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS k FROM o WHERE (budget - cap_before) / (weights - weight_before) <= ratio) WHERE k = 1),
p AS (SELECT source, source_size, least(cap, weight * level) AS target FROM w, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM p),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
m AS (SELECT source, h, sum(words) OVER (PARTITION BY source ORDER BY h) - words / 2.0::DOUBLE AS middle FROM g)
SELECT d.doc_id, d.source, d.size, q.source_size, q.target,
       (d.size * (q.whole + CASE WHEN q.target - q.whole * q.source_size > 0 AND m.middle <= q.target - q.whole * q.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.h = m.h""",
}
