"""Filter interaction audit by lattice edges.

k filters applied in every order take only k * 2**(k-1) different steps: the set already applied, and the filter that comes next (80
for five filters). The documents are first counted by part and by the set of filters they fail; each of these counts goes to all
edges of the lattice, edges are added up by part, and every step of every order reads its edge. A filter's Shapley sum is made from
its edges too: an edge with s filters before it lies on s! * (k-1-s)! orders.

Copies are judged over the whole table: a row fails if a smaller id has the same text (128 bits of MD5 stand for a text). Rows of
one text meet as counts by part, set and flags, so a text that a third of all rows share is a few rows.

Nulls: a null text is empty, a null source is the part "", a null id is neither smaller nor larger than any id, a null label is no
label. Of several labels of a document any one counts; repeated rows count each, and are no copies of each other. Long texts are
read whole, one at a time. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinegrid.llm.common import table

#: All orders are listed: 7! orders of 7 steps are 35,280 rows a part.
MOST_FILTERS = 7
COUNTS = ("kept", "removed", "redundant", "unique_fails")


def text_filters(text: Column) -> dict[str, Column]:
    """Conditions on which a text fails: A too short, B too repetitive, C too many capitals, D holds symbols."""
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), lambda w: w != "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(names: list[str], fails: dict[str, Column]) -> Column:
    return sum((F.when(condition, 1 << names.index(name)).otherwise(0) for name, condition in fails.items()), F.lit(0))


def failed_sets(docs: DataFrame, names: list[str], fails: dict[str, Column], copies: str | None, flags: dict[str, tuple[DataFrame, Column]], part: str = "source") -> DataFrame:
    """Counts (n, and one for each flag) of docs (doc_id, text, part) by part and by set of failed filters, a bit for each of names.

    copies: the filter that texts of a smaller id fail. flags: name -> (table with doc_id, condition on its rows).
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), _mask(names, fails).alias("mask"), F.unhex(F.md5(text)).alias("same"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("same") % 1024).otherwise(0))
    for name, (labels, condition) in flags.items():
        held = labels.where(condition & F.col("doc_id").isNotNull()).select("doc_id", F.lit(0).cast("long").alias("salt")).groupBy("doc_id", "salt").agg(F.lit(1).alias(name))
        rows = rows.join(held, ["doc_id", "salt"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    kinds = ["part", "mask", *flags]
    if copies:
        # Rows of one id are counted first: they are no copies of each other.
        counted = rows.groupBy("same", *kinds, "doc_id", "salt").agg(F.count("*").alias("n"))
        known = F.col("doc_id").isNotNull()
        alike = counted.groupBy("same", *kinds).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unknown"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"))
        least = F.min("first.doc_id").over(Window.partitionBy("same"))
        spared = F.col("unknown") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
        bit = F.lit(1 << names.index(copies))
        both = F.array(F.struct(F.col("mask").alias("mask"), spared.alias("n")), F.struct((F.col("mask").bitwiseOR(bit)).alias("mask"), (F.col("n") - spared).alias("n")))
        rows = alike.withColumn("both", both).select("part", *flags, F.explode("both").alias("_b")).select("part", *flags, "_b.mask", "_b.n").where("n > 0")
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col(f) * F.col("n")).alias(f) for f in flags])


def lattice(k: int) -> list[tuple[int, int, int]]:
    """(applied, next, orders) of every edge: the set applied before, the filter's bit, and the number of orders through the edge."""
    from math import factorial

    edges = [(s, 1 << f) for s in range(1 << k) for f in range(k) if not s >> f & 1]
    return [(s, f, factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for s, f in edges]


def audit(sets: DataFrame, names: list[str], flags: list[str]) -> DataFrame:
    """One row for each part, order and step, from failed_sets: what the step keeps and removes, and what was removed before it."""
    k = len(names)
    if k > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters")
    spark = sets.sparkSession
    edges = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next"), F.lit(o).cast("long").alias("orders")) for s, f, o in lattice(k)])
    spread = sets.withColumn("_e", F.explode(edges)).select("*", "_e.*")
    alive, failing = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(F.col("next")) != 0

    def total(condition: Column, n: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(n)).otherwise(0))

    counts = [total(alive & ~failing), total(alive & failing), total(~alive & failing), total(F.col("mask") == F.col("next"))]
    lost = [total(alive & failing, f).alias(f"{f}_lost") for f in flags]
    by_edge = spread.groupBy("part", "applied", "next", "orders").agg(*[c.alias(n) for c, n in zip(counts, COUNTS, strict=True)], *lost)
    by_edge = by_edge.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "next")))
    steps = [("".join(names[f] for f in order), at + 1, sum(1 << f for f in order[:at]), 1 << order[at]) for order in permutations(range(k)) for at in range(k)]
    paths = spark.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    return by_edge.join(F.broadcast(paths), ["applied", "next"]).select("part", "filter_order", "step", *COUNTS, *[f"{f}_lost" for f in flags], "shapley")


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    names = list("ABCDE")
    flags = {"good": (labels, F.col("quality") == 1), "toxic": (labels, F.col("toxic") == 1)}
    return audit(failed_sets(docs, names, text_filters(F.coalesce("text", F.lit(""))), "E", flags), names, list(flags))


QUERIES = {"op11_audit": op11_audit}
ORACLE_SQL = {
    "op11_audit": r"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM raw),
judged AS (
  SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic,
    {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(least < doc_id, false)} AS f
  FROM worded),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM orders),
failing AS (
  SELECT part, good, toxic, (CASE WHEN f.A THEN 'A' ELSE '' END || CASE WHEN f.B THEN 'B' ELSE '' END || CASE WHEN f.C THEN 'C' ELSE '' END || CASE WHEN f.D THEN 'D' ELSE '' END || CASE WHEN f.E THEN 'E' ELSE '' END) AS fails, count(*) AS n
  FROM judged GROUP BY ALL),
walked AS (
  SELECT part, filter_order, step, filter_order[step] AS own, n, good, toxic, fails, contains(fails, filter_order[step]) AS fail,
    CASE WHEN fails = '' THEN 0 ELSE list_min(list_transform(string_split(fails, ''), lambda l: strpos(filter_order, l))) END AS gone
  FROM failing, steps),
counted AS (
  SELECT part, filter_order, step, any_value(own) AS own,
    sum(CASE WHEN gone = 0 OR gone > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fail AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN gone = step AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM walked GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM counted
"""
}
