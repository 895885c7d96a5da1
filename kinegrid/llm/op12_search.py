"""Ranked lexical search, score at a time: postings grouped by exact impact, processed in descending order.

One pass over the texts keeps, of every document, its number of terms and the frequencies of the query terms it holds, as a written
table. Its rows are then taken in blocks of bounded size, each with an index of its own: a term's postings, highest impact first. For
a query, whole groups of equal impact are added to the documents' scores, those above half the highest impact left at a time,
from all its terms. What a document may still gain is at most the sum of the terms' next impacts; once no document outside the
candidates (score so far plus that sum at least the k-th score) can reach the k-th score, the processing stops and the
candidates' scores are completed from the documents' own rows. The k-th score of a block counts for the next block of its task, and
the k-th score of a part of the documents that is searched first (one in SEED) for all others, so few rows leave a task.

Queries are sent to the executors in slices of about SLICE_BYTES of text; a further slice is a further pass over the texts.

Nulls: a null text has no terms; a null item or document id is kept, and comes last among equal scores. Repeated rows are documents
and items of their own. Long texts are cut into terms CHUNK bytes at a time. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinegrid.llm.common import in_tasks, scratch_path, table

K = 50
#: Postings and documents of a block: its arrays take about 60 bytes a posting.
BLOCK_POSTINGS, BLOCK_DOCS = 1_000_000, 50_000
#: One document in so many is searched first, for a bound on the k-th score.
SEED = 64
SLICE_BYTES = 16 << 20
CHUNK = 4 << 20
#: Candidates to complete beyond which the next groups are processed first.
MANY = 1000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def count_terms(text: str | None) -> Counter:
    """How often each term occurs. Only A-Z are lower-cased; all but letters, digits and what is beyond ASCII parts terms."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    found, at = Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK) if at + CHUNK < len(data) else -1
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


class Queries:
    """The items of a slice: their ids, the numbers of their terms, and the number of each term."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        found = [sorted(count_terms(text)) for _, text in items]
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for own in found for t in own}))}
        self.terms = [np.array([self.vocabulary[t] for t in own], np.int64) for own in found]


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Block:
    """An impact-ordered index of some documents. terms, tf: of all documents one after the other; of: the document of each."""

    def __init__(self, n: np.ndarray, of: np.ndarray, terms: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        m = np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)
        impact = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[of]))
        held = impact > 0
        self.of, self.terms, self.impact = of[held], terms[held], impact[held]
        self.start = np.searchsorted(self.of, np.arange(len(n) + 1))
        order = np.lexsort((-self.impact, self.terms))
        self.doc, self.falling = self.of[order], -self.impact[order]
        self.list_at = np.searchsorted(self.terms[order], np.arange(len(weight) + 1))
        self.score, self.asked = np.zeros(len(n), np.int64), np.zeros(len(weight), bool)

    def _complete(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Whole scores of some documents, from their own rows."""
        size = self.start[docs + 1] - self.start[docs]
        rows = np.arange(size.sum()) + np.repeat(self.start[docs] - (np.cumsum(size) - size), size)
        self.asked[terms] = True
        rows, owner = rows[held := self.asked[self.terms[rows]]], np.repeat(np.arange(len(docs)), size)[held]
        self.asked[terms] = False
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, owner, self.impact[rows])
        return out

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score is least or more and not below the k-th score, and their scores. Ties of the k-th are all there."""
        score, at, end = self.score, self.list_at[terms], self.list_at[terms + 1]
        score[:] = 0
        terms_left = np.flatnonzero(at < end)
        while True:
            following = np.zeros(len(at), np.int64)
            following[terms_left] = -self.falling[at[terms_left]]
            rest = int(following.sum())
            kth = max(least, int(np.partition(score, -k)[-k]) if len(score) >= k else 0, 1)
            # Not even an untouched document may reach the k-th score; those that may are few.
            if rest < kth and (not rest or np.count_nonzero(score >= kth - rest) <= MANY):
                break
            level = int(following.max()) // 2
            for t in terms_left[following[terms_left] > level]:
                to = at[t] + int(np.searchsorted(self.falling[at[t] : end[t]], -level))
                score[self.doc[at[t] : to]] -= self.falling[at[t] : to]
                at[t] = to
            terms_left = np.flatnonzero(at < end)
        docs = np.flatnonzero(score >= kth - rest)
        whole = self._complete(docs, terms) if rest else score[docs]
        if len(whole) > k:
            kth = max(kth, int(np.partition(whole, -k)[-k]))
        return docs[whole >= kth], whole[whole >= kth]


def forward(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tf (of the query terms), seed, for every document that has a term."""
    id_type = docs.schema["doc_id"].dataType
    known = docs.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(SEED)) == 0).alias("seed"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            keep, n, terms, tf = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                found = count_terms(text.as_py())
                if found:
                    own = sorted((number[t], c) for t, c in found.items() if t in number)
                    keep.append(row)
                    n.append(found.total())
                    terms.append([t for t, _ in own])
                    tf.append([c for _, c in own])
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32())), kept.column(2)], ["doc_id", "n", "terms", "tf", "seed"])

    return in_tasks(known, count, f"doc_id {id_type.simpleString()}, n long, terms array<int>, tf array<int>, seed boolean")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = docs = 0
    for batch in batches:
        held.append(batch)
        size, docs = size + len(batch.column(2).flatten()), docs + len(batch)
        if size >= BLOCK_POSTINGS or docs >= BLOCK_DOCS:
            yield pa.Table.from_batches(held)
            held, size, docs = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held)


def search(rows: DataFrame, queries, weight, n_docs: int, n_terms: int, k: int, least) -> DataFrame:
    """item (its number), doc_id and score of what may be among the k best; least: broadcast, a score below which nothing counts, for each item."""
    schema = f"item int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score long"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floor = queries.value, list(least.value)
        for part in _blocks(batches):
            lists = part.column("terms").combine_chunks()
            of = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            terms, tf = (part.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
            block = Block(part.column("n").to_numpy(), of, terms, tf, weight.value, n_docs, n_terms)
            ids = part.column("doc_id").combine_chunks()
            for item, own in enumerate(asked):
                docs, scores = block.search(own, k, floor[item])
                if not len(docs):
                    continue
                if len(docs) >= k:
                    floor[item] = max(floor[item], int(np.partition(scores, -k)[-k]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), item, np.int32)), ids.take(pa.array(docs)), pa.array(scores)], ["item", "doc_id", "score"])

    return in_tasks(rows.select("doc_id", "n", "terms", "tf"), find, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _slices(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """The items with a text, about `size` bytes of it at a time."""
    held = items.where("text IS NOT NULL").select("item_id", "text")
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / size))
    for k in range(n):
        yield [(r[0], r[1]) for r in held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def rank_documents(items: DataFrame, docs: DataFrame, k: int = K, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, from written tables."""
    spark = docs.sparkSession
    context, out = spark.sparkContext, scratch_path(spark, "ranked")
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for own in _slices(items, slice_bytes):
        queries = Queries(own)
        if not queries.vocabulary:
            continue
        words = context.broadcast(queries.vocabulary)
        path = scratch_path(spark, "forward")
        rows = forward(docs, words)
        rows.write.partitionBy("seed").parquet(path)
        words.destroy()
        rows = spark.read.schema(rows.schema).parquet(path)
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(queries.vocabulary), np.int64)
        for term, n in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        asked, weight, nothing = (context.broadcast(x) for x in (queries.terms, weights(df, n_docs), [0] * len(own)))
        first = scratch_path(spark, "seed")
        _best(search(rows.where("seed"), asked, weight, n_docs, n_terms, k, nothing), k).write.parquet(first)
        seeded = spark.read.schema(schema.replace("item_id " + items.schema["item_id"].dataType.simpleString(), "item int")).parquet(first)
        bound = [0] * len(own)
        for item, score in seeded.where(F.col("rank") == k).select("item", "score").collect():
            bound[item] = score
        least = context.broadcast(bound)
        found = search(rows.where("NOT seed"), asked, weight, n_docs, n_terms, k, least).unionByName(seeded.select("item", "doc_id", "score"))
        ids = spark.createDataFrame(list(enumerate(queries.ids)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        _best(found, k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(out)
        for sent in (asked, weight, nothing, least):
            sent.destroy()
    return spark.read.schema(schema).parquet(out)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


QUERIES = {"op12_search": op12_search}
ORACLE_SQL = {
    "op12_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS terms FROM d WHERE len(words) > 0),
q AS (SELECT row_number() OVER () AS k, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS words FROM benchmark WHERE text IS NOT NULL),
a AS (SELECT k, item_id, unnest(words) AS term FROM q),
u AS (SELECT r, doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d),
f AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM u WHERE term IN (SELECT term FROM a) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY term, docs),
p AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS impact FROM f JOIN w USING (term), s),
z AS (SELECT k, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(impact)::BIGINT AS score FROM a JOIN p USING (term) GROUP BY k, r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM z WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
}
