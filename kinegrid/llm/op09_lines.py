"""Line dedup by pairwise alignment.

Documents are lists of lines. Overlapping documents are found by the lines they share: first by rare ones (at most RARE holders), each
later holder with the line's first holder; then, for lines that no alignment has deleted, by any shared line in the same way; and what is still left is
tried with every other earlier holder, the nearest first, twice as many in each round. So a shared line is deleted nowhere in a document only if no earlier document that holds it
aligns it, as if all pairs were aligned; a document whose lines go early is spared most of these pairs. (Where a document repeats a line, a
deleted place is enough.) Blank lines make no pairs. A pair is aligned by patience diff. The maximal blocks of consecutive lines aligned in both are deleted from the later
document, except blocks of blank lines alone; a blank line goes with a block of a pair that was aligned. The first holder keeps its
lines, so one copy of every deleted line stays.

Documents with the same text are one: the smallest id's is aligned with others, all lines of the later copies are deleted.
Lines are compared by 64-bit hashes (in 1e12 different lines some 30,000 pairs clash, and a clash can delete a line only where it aligns); rows and texts
by 128 bits.

Nulls: a null text is empty and has no lines. A null id counts as larger than all others. Rows that share an id are not aligned
with one another. A long text is one row of line hashes, aligned in one task. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrid.llm.common import cut, global_rank, table

#: Holders of a line up to which it is rare.
RARE = 16
#: Pairs of one earlier document that a task aligns, about.
FAN = 2000
#: Earlier documents of many pairs sent to every executor; beyond it they are joined by a shuffle.
SENT_FIRSTS = 100_000
LAST_ID = (1 << 63) - 1


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], rising in both: equal ends first, then the longest rising run of the items that are unique in both, then the gaps between them."""
    out, waiting = [], [(0, len(a), 0, len(b))]
    while waiting:
        i, end_i, j, end_j = waiting.pop()
        while i < end_i and j < end_j and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < end_i and j < end_j and a[end_i - 1] == b[end_j - 1]:
            end_i, end_j = end_i - 1, end_j - 1
            out.append((end_i, end_j))
        if i == end_i or j == end_j:
            continue
        in_a, in_b = Counter(a[i:end_i]), Counter(b[j:end_j])
        place = {x: k for k, x in enumerate(b[j:end_j], j) if in_b[x] == 1 and in_a[x] == 1}
        both = [(k, place[x]) for k, x in enumerate(a[i:end_i], i) if x in place]
        tops: list[int] = []
        last: list[int] = []
        before: list[int] = []
        for n, (_, y) in enumerate(both):
            k = bisect_left(tops, y)
            before.append(last[k - 1] if k else -1)
            tops[k:] = [y] + tops[k + 1 :]
            last[k:] = [n] + last[k + 1 :]
        chain, n = [], last[-1] if last else -1
        while n >= 0:
            chain.append(both[n])
            n = before[n]
        if chain:
            edges = [(i - 1, j - 1), *reversed(chain), (end_i, end_j)]
            out += chain
            waiting += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def deleted(first: list, later: list) -> list[int]:
    """Lines of the later document to delete: those of aligned blocks that hold a line that is not blank (0)."""
    out: list[int] = []
    block: list[int] = []
    held, end = False, (-2, -2)
    for i, j in [*patience(first, later), (-9, -9)]:
        if (i - 1, j - 1) != end:
            out += block if held else []
            block, held = [], False
        if j >= 0:
            block.append(j)
            held |= later[j] != 0
        end = (i, j)
    return out


def _lined(docs: DataFrame) -> DataFrame:
    """k (key of the row), d, same (key of the text), lines: hashes of the lines; blank lines hash to 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    hashed = F.transform(F.split(text, "\n", -1), lambda x: F.when(F.trim(x) == "", F.lit(0)).otherwise(F.xxhash64(x)))
    lines = F.when(text == "", F.array().cast("array<long>")).otherwise(hashed)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), d.alias("d"), F.unhex(F.md5(F.concat_ws(":", d.cast("string"), text))).alias("k"), F.unhex(F.md5(text)).alias("same"), lines.alias("lines"), text.alias("text"))


def _aligned(pairs: DataFrame, lines: DataFrame, fan: int) -> DataFrame:
    """k, gone (lines to delete) and hit (their hashes) of each pair (k, first_k) that has any. The earlier document stands before its pairs, once in a task; one of a great many pairs goes to several tasks."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list = []
        for batch in batches:
            found: list[tuple] = []
            for later, k, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not later:
                    first = own.as_py()
                elif gone := deleted(first, own := own.as_py()):
                    found.append((k, gone, list({own[j] for j in gone})))
            columns = [pa.array([f[n] for f in found], t) for n, t in enumerate((pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "gone", "hit"])

    counts = cut(pairs.groupBy("first_k").agg(F.ceil(F.count("*") / fan).alias("tasks")), "fans")
    hot = counts.where("tasks > 1")
    hot = F.broadcast(hot) if hot.count() <= SENT_FIRSTS else hot
    dealt = pairs.join(hot, "first_k", "left").select("k", "first_k", F.coalesce(F.pmod(F.xxhash64("k", "first_k"), F.col("tasks")), F.lit(0)).alias("task"))
    later = dealt.join(lines, "k").select("first_k", "task", F.lit(True).alias("later"), "k", "lines")
    firsts = lines.withColumnRenamed("k", "first_k").join(counts, "first_k").select("first_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), F.lit(False).alias("later"), F.col("first_k").alias("k"), "lines")
    both = firsts.unionByName(later).repartition("first_k", "task").sortWithinPartitions("first_k", "task", "later")
    return both.select("later", "k", "lines").mapInArrow(align, "k binary, gone array<int>, hit array<long>")


def line_deletions(lined: DataFrame, fan: int = FAN, rare: int = RARE) -> DataFrame:
    """k and gone (sorted lines to delete) of every document that loses some by alignment. lined: a written table of documents whose texts differ."""
    held = lined.select("k", "d", F.explode(F.array_distinct("lines")).alias("line")).where("line <> 0")
    shared = held.groupBy("line").agg(F.count("*").alias("holders"), F.min(F.struct("d", "k")).alias("f")).where("holders > 1")
    # written first: the join below then has a shuffle of its own, which Spark splits where one line has a great many holders
    shared = cut(shared.select("line", "holders", F.col("f.d").alias("first_d"), F.col("f.k").alias("first_k")), "shared")
    anchors = cut(held.join(shared, "line"), "anchors")
    lines, parts, tried = lined.select("k", "lines"), [], []

    def left_after(waiting: DataFrame, pairs: DataFrame) -> DataFrame:
        """The shared lines (k, line, ...) that aligning the pairs that are new has not deleted anywhere."""
        new = pairs.select("k", "first_k").distinct()
        if tried:
            before = tried[0]
            for t in tried[1:]:
                before = before.unionByName(t)
            new = new.join(before, ["k", "first_k"], "left_anti")
        tried.append(cut(new, "pairs"))
        parts.append(cut(_aligned(tried[-1], lines, fan), "aligned"))
        hit = parts[-1].select("k", F.explode("hit").alias("line"))
        return cut(waiting.join(hit, ["k", "line"], "left_anti"), "left")

    waiting = anchors.where("d > first_d")
    waiting = left_after(waiting, waiting.where(F.col("holders") <= rare))
    waiting = left_after(waiting, waiting).where("holders > 2").select("k", "line")
    if waiting.limit(1).count():
        # The holders of a line stand one after the other, by id: those before a document are its other partners.
        held = anchors.join(waiting.select("line").distinct(), "line", "left_semi").select("line", "d", "k")
        placed, reach = cut(global_rank(held, ["line", "d", "k"]), "holders"), 1
        before = placed.select("line", F.col("rank").alias("_at"), F.col("k").alias("first_k"), F.col("d").alias("_d"))
        while True:
            here = placed.join(waiting, ["k", "line"], "left_semi").select("k", "d", "line", F.explode(F.sequence(F.lit(reach), F.lit(2 * reach - 1))).alias("_back"), "rank")
            pairs = cut(here.withColumn("_at", F.col("rank") - F.col("_back")).join(before, ["line", "_at"]).select("k", "first_k", (F.col("_d") < F.col("d")).alias("earlier")), "partners")
            if not pairs.limit(1).count():
                break
            waiting, reach = left_after(waiting, pairs.where("earlier")), 2 * reach
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_lines, n_removed, text (the lines that are kept)."""
    rows = _lined(docs)
    narrow = cut(rows.drop("text"), "lines")
    least = narrow.groupBy("same").agg(F.min("d").alias("least"))
    marked = narrow.join(least, "same")
    once = cut(marked.where("d = least").select("k", "d", "lines").dropDuplicates(["k"]), "once")
    gone = cut(line_deletions(once, **how), "gone")
    fate = marked.select("k", (F.col("d") > F.col("least")).alias("copy")).distinct().join(gone, "k", "left")
    fate = cut(fate.where("copy OR gone IS NOT NULL"), "fate")
    few = fate.agg(F.sum(1 + F.coalesce(F.size("gone"), F.lit(0)))).first()[0] or 0
    out = rows.join(F.broadcast(fate) if few <= 1_000_000 else fate, "k", "left")
    parts = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1))
    kept = F.when(F.col("gone").isNull(), parts).otherwise(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)))
    kept = F.when(F.coalesce("copy", F.lit(False)), F.array().cast("array<string>")).otherwise(kept)
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(kept)).cast("long").alias("n_removed"), F.array_join(kept, "\n").alias("text"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op9_lines": op9_lines}
