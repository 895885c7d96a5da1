"""A training corpus from raw documents: language ID, near-dedup, decontamination, mixing, token files.

Every stage takes an empty table, repeated rows, nulls in any column, texts of any length and columns of any name, and all but
the last give back the columns they were given. A null text is empty: the first stage drops it; later stages, given one, keep it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinegrid.llm.common import cut, table
from kinegrid.llm.op01_mix import mix_documents
from kinegrid.llm.op06_minhash import drop_near_duplicates
from kinegrid.llm.op07_decontaminate import decontaminate
from kinegrid.llm.op08_language import keep_identified
from kinegrid.llm.op10_tokens import token_rows
from kinegrid.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null texts among them, are in no language and go. Repeated rows are judged alike."""
    ship(spark)
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: shingles of five words, similarity 0.8. The smallest id stays, null ids last, ties by the text's hash; empty texts all stay but repeated rows of theirs."""
    ship(spark)
    return drop_near_duplicates(docs, percent=80, size=5)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go; with an empty benchmark none does. Items without text or id change nothing or count as the id "null"."""
    ship(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for: never, once or twice. A null source is one of its own; texts of no words are taken with their source's whole epochs."""
    return mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids are written to the shared folder; a row of checks for each document is read back. A null id comes first, a null text has the end id alone."""
    ship(spark)
    return token_rows(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("source_mix", source_mix), ("token_files", token_files)]

#: Language profiles, links by shared shingles and byte-pair ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
