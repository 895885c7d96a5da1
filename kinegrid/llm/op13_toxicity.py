"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, block-max inverted indexes, distance-weighted votes.

The vocabulary is the terms that go with the label (LIFT times as frequent among toxic examples as among clean ones, chi-square of SIGNIFICANT or
more, SEEN examples at least) and one term of weight BACKGROUND that every text holds: without it a text with one chance hit would be as near to toxic texts as one with many. A
term weighs (1 + ln tf) * (1 + ln((N + 1) / (df + 1))), with N and df counted over all documents. Examples with equal vectors are one
entry with their votes.

Entries are sorted by their heaviest terms and dealt into blocks of BLOCK; each term's postings keep the largest weight of every
block. A query adds those up to a bound for each block, visits blocks best bound first, a few at a time, and stops when no block left can hold an entry as
near as its NEAREST-th vote. The score is the toxic share of these votes, each weighed by its squared cosine and by the share of its class that
was drawn, so it estimates the rate of toxic documents; the nearest examples are its evidence.

Examples are at most about SAMPLE documents of each class, drawn by a hash of the id; every document, whole, is scored in one pass.

Nulls: a null or empty text has the background term alone. A null label teaches nothing; of several labels of an id, toxic
wins; a null id has no label. With nothing to learn from, all scores are 0. Repeated rows are scored alike, and are one
example. Long texts are read in pieces. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrid.llm.common import cut, in_tasks, set_aside, table
from kinegrid.llm.op12_search import count_terms

#: Examples of each class, about; terms of the vocabulary at most (the most significant).
SAMPLE, TERMS = 10_000, 20_000
SIGNIFICANT, LIFT, SEEN, BACKGROUND = 20.0, 4.0, 3, 3.0
NEAREST, THRESHOLD, BLOCK, EVIDENCE = 15, 0.3, 64, 3
#: Blocks that are visited together at first; twice as many each time after.
WAVE = 4
#: Scores of vectors that a task has met last.
KEPT = 50_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def draw_examples(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, tuple[float, float]]:
    """Labelled documents (doc_id, text, toxic), and the share that was drawn of the clean and of the toxic ones."""
    spark = docs.sparkSession
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rates = tuple(min(1.0, sample / n[k]) if n.get(k) else 1.0 for k in (0, 1))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(place < F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0]))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "text"])
    return cut(rows.select("doc_id", "text", "toxic"), "examples").repartition(spark.sparkContext.defaultParallelism), rates


def choose_terms(examples: DataFrame, significant: float = SIGNIFICANT, lift: float = LIFT, seen: int = SEEN, most: int = TERMS) -> list[str]:
    """The terms whose presence goes with the label, most significant first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for term in count_terms(text.as_py()):
                    total[term.decode("utf-8", "replace")][toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array([v[k] for v in total.values()], pa.int64()) for k in (0, 1))], ["term", "clean", "toxic"])

    n0, n1 = examples.agg(F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    terms = in_tasks(examples.select("text", "toxic"), count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    square = F.lit(float(n0 + n1)) * (b * (n0 - a) - a * (n1 - b)) ** 2
    chosen = terms.where(F.col("a") + F.col("b") >= seen).withColumn("chi", square / F.greatest(F.lit(1.0), (a + b) * (n0 + n1 - a - b) * float(n0) * float(n1)))
    return [r["term"] for r in chosen.where((F.col("chi") >= significant) & (b * float(n0) >= lift * a * float(n1))).orderBy(F.desc("chi"), "term").limit(most).select("term").collect()]


def _held(text: str | None, number: dict[bytes, int]) -> list[tuple[int, int]]:
    found = count_terms(text)
    return sorted((number[t], n) for t, n in found.items() if t in number) if len(found) < len(number) else sorted((k, found[t]) for t, k in number.items() if t in found)


def document_counts(docs: DataFrame, vocabulary) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many hold each term (the number of all documents stands at -1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = vocabulary.value, 0
        df = np.zeros(len(number), np.int64)
        for batch in batches:
            rows += len(batch)
            for text in batch.column(0):
                for k, _ in _held(text.as_py(), number):
                    df[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *np.flatnonzero(df).tolist()], pa.int32()), pa.array([rows, *df[df > 0].tolist()], pa.int64())], ["term", "n"])

    n, df = 0, np.zeros(len(vocabulary.value), np.int64)
    for term, count_ in in_tasks(docs.select("text"), count, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        if term < 0:
            n = count_
        else:
            df[term] = count_
    return n, df


class Index:
    """The examples' entries by blocks, and each term's postings with the largest weight of every block."""

    def __init__(self, examples: list[tuple], idf: np.ndarray, rates: tuple[float, float], background: float = BACKGROUND, block: int = BLOCK):
        """examples: (doc_id, toxic, terms with their frequencies)."""
        self.idf, self.background, self.block = idf, background, block
        entries: dict[tuple, list] = {}
        for doc_id, toxic, held in examples:
            own = entries.setdefault(tuple(held), [doc_id, [0, 0]])
            own[0] = min(own[0], doc_id)
            own[1][toxic] += 1
        vectors = [(self.vector(held), *own) for held, own in entries.items()]
        vectors.sort(key=lambda e: (e[0][0][np.argsort(-e[0][1], kind="stable")].tolist(), e[0][1].tolist(), e[1]))
        self.ids = [e[1] for e in vectors]
        self.votes = np.array([e[2] for e in vectors], float).reshape(-1, 2)
        self.shares = self.votes / np.array(rates)
        of = np.repeat(np.arange(len(vectors)), [len(e[0][0]) for e in vectors])
        terms, weights = (np.concatenate([e[0][k] for e in vectors]) if vectors else np.zeros(0) for k in (0, 1))
        order = np.lexsort((of, terms))
        self.of, self.weight, terms = of[order], weights[order], terms[order].astype(np.int64)
        n = len(idf) + 1
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(terms) != 0) | (np.diff(self.of // block) != 0)])) if len(terms) else np.zeros(0, np.int64)
        self.head_block, self.head_most = (self.of[heads] // block, np.maximum.reduceat(self.weight, heads)) if len(heads) else (heads, heads)
        self.head_at, self.head_end = heads, np.append(heads[1:], len(terms))
        self.list_at = np.searchsorted(terms[heads], np.arange(n + 1))
        self.n_blocks, self.inside = -(-len(vectors) // block), np.arange(block)

    def vector(self, held) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights, of length 1. The background term is the last."""
        terms = np.array([k for k, _ in held] + [len(self.idf)], np.int64)
        weight = np.append((1 + np.log(np.array([n for _, n in held], float))) * self.idf[terms[:-1]], self.background)
        return terms, weight / np.sqrt((weight * weight).sum())

    def nearest(self, held, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the k nearest votes, nearest first (ties: the entry that stands first), and their cosines."""
        terms, weight = self.vector(held)
        lists = [slice(self.list_at[t], self.list_at[t + 1]) for t in terms]
        bound = np.zeros(self.n_blocks)
        for heads, w in zip(lists, weight, strict=True):
            bound[self.head_block[heads]] += w * self.head_most[heads]
        order = np.argsort(-bound, kind="stable")
        bound = bound[order] * (1 + 1e-9)
        cosine, open_ = np.zeros(self.n_blocks * self.block), np.zeros(self.n_blocks, bool)
        found, at, wave, kth = np.zeros(0, np.int64), 0, WAVE, -1.0
        while at < self.n_blocks and bound[at] >= kth:
            own = order[at : at + wave]
            own = own[: int(np.searchsorted(-bound[at : at + wave], -kth, side="right"))]
            open_[:], open_[own] = False, True
            for heads, w in zip(lists, weight, strict=True):
                held_here = np.flatnonzero(open_[self.head_block[heads]]) + heads.start
                size = self.head_end[held_here] - self.head_at[held_here]
                rows = np.arange(size.sum()) + np.repeat(self.head_at[held_here] - (np.cumsum(size) - size), size)
                cosine[self.of[rows]] += w * self.weight[rows]
            at, wave = at + len(own), 2 * wave
            new = (own[:, None] * self.block + self.inside).ravel()
            found = np.concatenate([found, new[new < len(self.ids)]])
            # Each entry has a vote at least, so the k nearest entries hold k votes.
            if len(found) > k:
                found = found[cosine[found] >= np.partition(cosine[found], -k)[-k]]
            found = found[np.lexsort((found, -cosine[found]))]
            upto = int(np.searchsorted(np.cumsum(self.votes[found].sum(1)), k)) + 1
            kth = float(cosine[found[upto - 1]]) if upto <= len(found) else -1.0
            found = found[:upto]
        return found, cosine[found]

    def score(self, held, k: int = NEAREST) -> tuple[float, list]:
        """The toxic share of the nearest votes, and the ids of the nearest examples."""
        found, cosines = self.nearest(held, k)
        if not len(found):
            return 0.0, []
        votes = self.votes[found].sum(1)
        part = np.clip(k - (np.cumsum(votes) - votes), 0, votes) / votes
        clean, toxic = (cosines**2 * part) @ self.shares[found]
        return float(toxic / (clean + toxic)) if clean + toxic else 0.0, [self.ids[f] for f in found[:EVIDENCE]]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[bytes, int], Index]:
    """The vocabulary and the index of examples, from labelled rows; counts are over all docs."""
    context = docs.sparkSession.sparkContext
    examples, rates = draw_examples(docs, labels, sample)
    number = {t.encode(): k for k, t in enumerate(sorted(choose_terms(examples)))}
    sent = context.broadcast(number)
    n, df = document_counts(docs, sent)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_held(t.as_py(), sent.value) for t in batch.column(2)]
            lists = [pa.array([[p[k] for p in own] for own in held], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "toxic", "terms", "tf"])

    rows = in_tasks(examples.select("doc_id", "toxic", "text"), hold, f"doc_id {id_type}, toxic int, terms array<int>, tf array<int>").collect()
    sent.destroy()
    return number, Index([(r[0], r[1], list(zip(r[2], r[3], strict=True))) for r in rows], 1 + np.log((n + 1) / (df + 1)), rates)


def rate(docs: DataFrame, number: dict[bytes, int], index: Index) -> DataFrame:
    """docs with _score and _evidence (ids of the nearest examples), all other columns kept."""
    sent = docs.sparkSession.sparkContext.broadcast((number, index))
    names, text = docs.columns, docs.columns.index("text")
    schema = docs.select("*", F.lit(0.0).alias("_score"), F.array("doc_id").alias("_evidence")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, index = sent.value
        kept: dict[tuple, tuple[float, list]] = {}
        for batch in batches:
            found = []
            for t in batch.column(text):
                held = tuple(_held(t.as_py(), number))
                if held not in kept:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[held] = index.score(held)
                found.append(kept[held])
            evidence = pa.array([f[1] for f in found], pa.list_(batch.schema.field("doc_id").type))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.float64()), evidence], names=[*names, "_score", "_evidence"])

    return in_tasks(docs, judge, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    safe, back = set_aside(docs)
    return rate(safe, *learn(safe, labels)).where(F.col("_score") < threshold).select(*back)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    score = F.col("_score")
    return rate(docs, *model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), F.col("_evidence").alias("evidence"))


QUERIES = {"op13_toxicity": op13_toxicity}
