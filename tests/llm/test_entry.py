"""The registered queries of the subpackage."""

from conftest import same_rows

import __spark_entry__
import corpus_pipeline
from kinegrid.llm import registry


def test_all_operators_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{k}_" for k in range(1, 14)} <= {n[: n.index("_") + 1] for n in names if n.startswith("op")} and "pipeline" in names


def test_queries_with_sql(spark, sf, duck):
    for name, sql in registry.oracle_sql().items():
        same_rows(registry.queries()[name](spark, sf).toPandas(), duck.execute(sql).df())


def test_pipeline(spark, sf):
    rows = corpus_pipeline.run(spark, sf).orderBy("start").collect()
    assert rows and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(rows[:-1], rows[1:], strict=True))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_passages", "source_mix", "token_files"]


def test_stages_of_nothing_and_of_odd_rows(spark, sf):
    """Each stage on an empty table, and on nulls, empty texts, repeated rows and columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _lang string, node string"
    odd = [(1, None, None, None, None, "x", "y"), (1, "", "en", "web", 0, "x", "y"), (None, "some words of a text " * 9, "en", None, 5, "x", "y"), (2, "some words of a text " * 9, "en", "web", 5, "x", None), (2, "some words of a text " * 9, "en", "web", 5, "x", None)]
    for name, stage in corpus_pipeline.STAGES:
        for rows in ([], odd):
            docs = spark.createDataFrame(rows, schema)
            out = stage(spark, docs, sf)
            got = out.count()
            assert got == 0 if not rows else True
            if name != "token_files":
                assert out.columns == docs.columns
            else:
                assert got == len(rows)


def test_pipeline_keeps_and_drops_what_it_should(spark, sf):
    """The rows after each stage against plain Python on the stage's own input."""
    import re

    from test_duplicates import near_by_hand

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    spoken = {r.doc_id for r in stages["language"](spark, docs, sf).collect()}
    assert spoken == {i for i, t in rows if re.search(r"[^\W\d_]", t or "")}
    rows = [(i, t) for i, t in rows if i in spoken]
    kept = {r.doc_id for r in stages["near_duplicates"](spark, docs.where(docs.doc_id.isin(list(spoken))), sf).collect()}
    assert kept == {i for i, n, least in near_by_hand(rows, 5) if i == least}
