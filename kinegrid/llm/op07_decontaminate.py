"""Benchmark decontamination with one Aho-Corasick automaton over the normalised windows of the test items.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. An item's windows are its runs of 13 consecutive
words (all its words, if fewer). Each document is normalised and scanned once; a match marks its words and, through the words'
places in the UTF-8 text, the span of the original.

The automaton goes to the workers as a broadcast of at most WINDOW_BYTES; a larger benchmark is scanned as several such slices,
one after the other over the same rows, so no window is left out.

Nulls: a null text has no words, a null item text no windows, a null item id is the text "null". Items that share an id are one
item; repeated documents are judged each. Empty tables: no rows, or nothing hit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrid.llm.common import in_tasks, large, set_aside, table

WINDOW_WORDS = 13
#: Bytes of window text in one automaton.
WINDOW_BYTES = 16 << 20
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: str | None) -> bytes:
    """The text's UTF-8 bytes, lower-cased, with a blank for every byte outside a word; as long as the text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)


def benchmark_windows(items: DataFrame, words: int = WINDOW_WORDS) -> DataFrame:
    """A row for each distinct window: win (words joined by blanks, as bytes), items (the ids that hold it)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = normalised(text).split()
                for at in range(max(1, len(own) - words + 1) if own else 0):
                    keys.append(key)
                    found.append(b" ".join(own[at : at + words]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.binary())], ["item", "win"])

    texts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return texts.mapInArrow(cut, "item string, win binary").groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _automaton(key: str, rows: list[tuple[bytes, list[str]]]):
    """One for each worker process and slice. key: of the slice; no other slice ever has it."""

    def make():
        import ahocorasick

        made = ahocorasick.Automaton()
        for win, items in rows:
            made.add_word(f" {win.decode('latin-1')} ", (len(win) + 2, items))
        made.make_automaton()
        return made

    return large(("automaton", key), make)


def mark(docs: DataFrame, items: DataFrame, words: int = WINDOW_WORDS, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """docs with _n_words, _hits (word indices inside a window, little-endian 32-bit) and _items (ids of the items met), all others kept."""
    spark = docs.sparkSession
    windows = benchmark_windows(items, words).persist()
    total = windows.agg(F.sum(F.octet_length("win") + 48 * F.size("items"))).first()[0] or 0
    slices = max(1, ceil(total / window_bytes))
    out = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_hits": F.lit(None).cast("binary"), "_items": F.lit(None).cast("array<string>")})
    for k in range(slices):
        part = windows if slices == 1 else windows.where(F.pmod(F.xxhash64("win"), F.lit(slices)) == k)
        out = _scan(out, spark.sparkContext.broadcast([(bytes(r.win), list(r["items"])) for r in part.collect()]), uuid.uuid4().hex)
    windows.unpersist()
    return out


def _scan(docs: DataFrame, windows, key: str) -> DataFrame:
    names = docs.columns
    text, n_at, hits_at, items_at = (names.index(c) for c in ("text", "_n_words", "_hits", "_items"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = windows.value
        automaton = _automaton(key, rows) if rows else None
        for batch in batches:
            n_words, hits, met = [], [], []
            for row in range(batch.num_rows):
                line = b" ".join([b"", *(own := normalised(batch.column(text)[row].as_py()).split()), b""])
                n_words.append(len(own))
                found = list(automaton.iter(line.decode("latin-1"))) if automaton and own else []
                if not found:
                    hits.append(batch.column(hits_at)[row].as_py())
                    met.append(batch.column(items_at)[row].as_py())
                    continue
                word_at = np.cumsum(np.frombuffer(line, np.uint8) == 32)  # of the blank before a word: its index from 1
                change = np.zeros(len(own) + 1, np.int32)
                ends = np.array([e for e, _ in found])
                starts = ends + 1 - np.array([v[0] for _, v in found])
                np.add.at(change, word_at[starts] - 1, 1)
                np.add.at(change, word_at[ends] - 1, -1)
                inside = np.cumsum(change[:-1]) > 0
                if (before := batch.column(hits_at)[row].as_py()) is not None:
                    inside[np.frombuffer(before, "<i4")] = True
                hits.append(np.flatnonzero(inside).astype("<i4").tobytes())
                met.append(sorted({i for _, v in found for i in v[1]} | set(batch.column(items_at)[row].as_py() or ())))
            new = {n_at: pa.array(n_words, pa.int64()), hits_at: pa.array(hits, pa.binary()), items_at: pa.array(met, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(k, c) for k, c in enumerate(batch.columns)], names=names)

    return in_tasks(docs, scan, docs.schema, keeps=True)


def n_hit() -> Column:
    return F.coalesce(F.octet_length("_hits") / 4, F.lit(0)).cast("long")


def contaminated() -> Column:
    """At least one word in twenty, and one at all, is inside a window."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("_n_words"))


def spans(text: str, hits: bytes) -> list[tuple[int, int]]:
    """Places in the original text, in code points, of the runs of marked words."""
    plain = np.frombuffer(normalised(text), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], plain.view(np.int8), [0]])))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)])
    marked = np.frombuffer(hits, "<i4")
    runs = np.split(marked, np.flatnonzero(np.diff(marked) > 1) + 1) if len(marked) else []
    return [(int(points[edge[2 * r[0]]]), int(points[edge[2 * r[-1] + 1]])) for r in runs]


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans of the original in code points."""
    report = _report(mark(docs.select("doc_id", "text"), items), "text", "_hits")
    names = report.columns[:-2]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if hits is None else [{"start": a, "stop": b} for a, b in spans(text, hits)] for text, hits in zip(*(c.to_pylist() for c in batch.columns[-2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, kind)], [*names, "spans"])

    return in_tasks(report, place, report.select(*names, F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans")).schema)


def _report(marked: DataFrame, *more) -> DataFrame:
    met = F.coalesce("_items", F.array().cast("array<string>"))
    return marked.select("doc_id", F.col("_n_words").alias("n_words"), n_hit().alias("n_hit"), F.size(met).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(met)), 256).alias("items_sha256"), contaminated().alias("contaminated"), *more)


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    safe, back = set_aside(docs)
    return mark(safe, items).where(~contaminated()).select(*back)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


QUERIES = {"op7_decontaminate": op7_decontaminate}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op7_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, ks, unnest(generate_series(1, len(w) - k + 1)) t(i) WHERE len(w) >= k),
h AS (SELECT p.doc_id, p.i, p.k, bw.item_id FROM p JOIN bw ON p.s = bw.s AND p.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(generate_series(h.i, h.i + h.k - 1)) t(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN it ON d.doc_id = it.doc_id""",
}
