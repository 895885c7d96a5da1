"""Quotas, splits, greedy picks and stores on random rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinegrid.operators import selection as sel
from kinegrid.streaming import incremental


@pytest.mark.parametrize("total", [0, 7, 20, 45, 60, 1000])
def test_a_sample_has_as_many_rows_as_asked_for(spark, total):
    draw = random.Random(total)
    rows = [(k, draw.choice("aaaaab"), draw.choice([None, 1, 2])) for k in range(60)]
    got = sel.stratified_sample(spark.createDataFrame(rows, "clip_id long, a string, b int"), "clip_id", ["a", "b"], total, 3).collect()
    assert len({r.clip_id for r in got}) == len(got) == min(total, 60)
    bins = {}
    for k, *key in rows:
        bins.setdefault(tuple(key), []).append(k)
    if sum(min(3, len(v)) for v in bins.values()) <= total:
        taken = {r.clip_id for r in got}
        assert all(len(taken & set(v)) >= min(3, len(v)) for v in bins.values())


def test_splits_leave_out_and_keep_apart(spark):
    clips = spark.createDataFrame([(k, f"s{k % 5}") for k in range(100)], "clip_id long, scene string")
    tags = spark.createDataFrame([(k, k % 2) for k in range(80)], "clip_id long, a int")
    out = spark.createDataFrame([("s0",)], "scene string")
    rows = sel.build_splits(clips, tags, ["a"], 10, 20, 2, excluded=out).collect()
    by = {s: {r.clip_id for r in rows if r.split == s} for s in ("val", "train")}
    assert (len(by["val"]), len(by["train"])) == (10, 20) and not by["val"] & by["train"] and all(k % 5 and k < 80 for k in by["val"] | by["train"])
    ratio = sel.build_splits(clips, tags, ["a"], 0, 0, 2, ratio=0.25).collect()
    assert len(ratio) == 80 and sum(r.split == "val" for r in ratio) == 20
    assert sel.build_splits(clips, tags.limit(0), ["a"], 5, 5, 1).count() == 0


@pytest.mark.parametrize("candidates", [1, 4, 50])
def test_queues_hold_all_that_greedy_picks_look_at(spark, candidates):
    draw = random.Random(candidates)
    rows = [(k, draw.choice(["real", "simulated", None]), q, draw.choices(a, w)[0]) for k in range(120) for q, a, w in (("p", "xyz", (8, 1, 1)), ("q", "uv", (3, 1)), ("r", "mn", (1, 1))) if draw.random() < 0.95]
    df = spark.createDataFrame(rows, "clip_id long, source string, question_id string, answer string")
    for least in (None, {"simulated": 0.6}):
        got = {r.pick: r.clip_id for r in sel.balanced_subset(df, 15, candidates=candidates, least=least).collect()}
        everything = sel.candidate_queues(df, 1000, 1000, "42").toPandas().sort_values(["draw", "clip_id"]).reset_index(drop=True)
        classes = {q: sorted({r[3] for r in rows if r[2] == q}) for q in "pqr"}
        most = {s: 15 - (9 if least and s != "simulated" else 0) for s in everything["source"].unique()}
        want = [int(everything["clip_id"][k]) for k in sel.greedy_picks(everything, classes, 15, candidates, most)]
        assert [got[k + 1] for k in range(15)] == want
        if least:
            assert sum(everything.set_index("clip_id")["source"][k] != "simulated" for k in want) <= 12


def test_greedy_picks_are_even():
    draw = random.Random(1)
    pool = pd.DataFrame({"clip_id": range(300), "source": "", "answers": [{"p": draw.choices("xy", (9, 1))[0]} for _ in range(300)]})
    picks = sel.greedy_picks(pool, {"p": ["x", "y"]}, 20, 500, {})
    assert sorted(pool["answers"][k]["p"] for k in picks) == ["x"] * 10 + ["y"] * 10 and len(set(picks)) == 20
    assert len(sel.greedy_picks(pool.head(5), {"p": ["x", "y"]}, 20, 500, {})) == 5 and sel.greedy_picks(pool, {}, 20, 500, {}) == []


def test_a_store_is_read_by_folder_and_a_replay_adds_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "clip_id long, qa_id string"
    for n, rows in enumerate(([(k // 3, f"q{k}") for k in range(60)], [(k // 3, f"q{k}") for k in range(30, 90)], [(1, "q3"), (2, None), (2, "")])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        for again in range(2):  # the second time from the start, as if no progress had been kept
            stream = spark.readStream.schema(schema).parquet(source)
            incremental.append_new(stream, out, str(tmp_path / f"progress{n}-{again}"), by="clip_id", buckets=16).awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.where("qa_id <> ''").count() == stored.where("qa_id <> ''").distinct().count() == 90
    one = spark.createDataFrame([(1, "q3"), (1, "qx")], schema)
    read = incremental.touched(one, out, "clip_id", 16)
    assert len({r.bucket for r in read.select("bucket").distinct().collect()}) == 1
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in read._jdf.queryExecution().toString()
    items = spark.createDataFrame([(1, "q3"), (1, "q4"), (1, "q5"), (2, "q6"), (2, "new"), (99, "other")], schema)
    assert sorted((r.clip_id, r.qa_id) for r in incremental.open_groups(items, out, buckets=16).collect()) == [(2, "new"), (2, "q6"), (99, "other")]
    assert incremental.open_groups(items, str(tmp_path / "none")).count() == 6


def test_least_digests_hold_the_least_of_each_group(spark):
    import hashlib
    import random

    from pyspark.sql import functions as F

    from kinegrid.operators.selection import least_digests

    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), str(draw.randrange(4000))) for _ in range(6000)] + [("few", "1"), ("few", "1"), ("few", None), ("one", None)]
    got = least_digests(spark.createDataFrame(rows, "model string, v string"), "model", F.md5("v"), 5).collect()
    order = lambda v: (v is None, hashlib.md5((v or "").encode()).hexdigest())
    for group in ("a", "b", None, "few", "one"):
        least = lambda found: sorted({v for g, v in found if g == group}, key=order)[:5]
        assert least(map(tuple, got)) == least(rows)
    assert len(got) < 100


def test_open_groups_deals_rows_once(spark, tmp_path):
    from kinegrid.streaming import incremental

    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None)], "clip_id long, qa_id string")
    incremental.store(items.where("qa_id = 'a' OR qa_id = 'c'"), f"file://{tmp_path}/s", by="clip_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = incremental.open_groups(items, f"file://{tmp_path}/s")
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted((r.clip_id, r.qa_id or "") for r in found.collect()) == [(1, "a"), (1, "b"), (3, "")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
