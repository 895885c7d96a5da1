"""Places of samples in the chains that their links make, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrid.sources.shared import cut


def chain_places(links: DataFrame, sample: str = "sample", following: str = "next") -> DataFrame:
    """A row for each sample: sample, head (the first of its chain), place (from 0), link.

    Every sample begins with a pointer to the one before it. A round replaces each pointer by its target's pointer and adds up the
    distances, so a chain of n samples is ranked in log2(n) rounds, whatever the number of chains. Samples that have found their head
    leave the rounds; pointers still open after as many steps as there are samples lie on a ring, which has no head and no places.

    link: "next" if the chain goes on after the sample, "last" if it names none, "missing" if the one it names is not there, "taken" if
    another sample, of a smaller id, names the same one. A null sample is left out; of repeated samples the smallest link counts.
    """
    nodes = links.where(F.col(sample).isNotNull()).groupBy(F.col(sample).alias("sample")).agg(F.min(following).alias("next"))
    nodes = cut(nodes, "samples")
    before = nodes.where("next IS NOT NULL").groupBy(F.col("next").alias("sample")).agg(F.min("sample").alias("before"))
    first = F.col("before").isNull()
    known = nodes.select("sample").join(before, "sample", "left").select("sample", F.coalesce("before", "sample").alias("head"), F.when(first, 0).otherwise(1).cast("long").alias("place"), first.alias("done"))
    known = cut(known, "pointers")
    n, steps = nodes.count(), 1
    found, waiting = known.where("done"), known.where("NOT done")
    while steps < max(n, 2) and waiting.limit(1).count():
        target = found.unionByName(waiting).select(F.col("sample").alias("head"), F.col("head").alias("_head"), F.col("place").alias("_place"), F.col("done").alias("_done"))
        moved = waiting.select("sample", "head", "place").join(target, "head").select("sample", F.col("_head").alias("head"), (F.col("place") + F.col("_place")).alias("place"), F.col("_done").alias("done"))
        moved = cut(moved, "pointers")
        found, waiting, steps = found.unionByName(moved.where("done")), moved.where("NOT done"), 2 * steps
    placed = found.select("sample", "head", "place").unionByName(waiting.select("sample", F.lit(None).cast(nodes.schema["sample"].dataType).alias("head"), F.lit(None).cast("long").alias("place")))
    named = before.select(F.col("sample").alias("next"), "before").join(nodes.select(F.col("sample").alias("next"), F.lit(True).alias("there")), "next", "left")
    link = F.when(F.col("next").isNull(), "last").when(F.col("there").isNull(), "missing").when(F.col("before") != F.col("sample"), "taken").otherwise("next")
    return placed.join(nodes.join(named, "next", "left").select("sample", link.alias("link")), "sample")
