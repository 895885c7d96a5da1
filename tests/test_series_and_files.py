"""Series operators on tracks with known motion, and file sources."""

import math

import numpy as np
from pyspark.sql import functions as F

from kinegrid.functions import series as fs
from kinegrid.operators import selection as sel
from kinegrid.sources import files
from kinegrid.streaming import incremental


def test_resample_and_speed_of_a_straight_line(spark):
    track = spark.createDataFrame([(1, 0.5 * k, 5.0 * k, 0.0) for k in range(7)], "clip_id long, ts double, x double, y double")
    grid = fs.uniform_grid(track)
    assert grid.count() == 31
    even = fs.resample(track, grid, ["x", "y"])
    speeds = [r.s for r in even.select(fs.planar_speed().alias("s")).collect()]
    assert len(speeds) == 31 and all(abs(s - 10) < 1e-6 for s in speeds)


def test_smooth_keeps_parabolas_and_short_arrays(spark):
    df = spark.createDataFrame([([float(k * k) for k in range(9)],), ([1.0, 5.0],)], "v array<double>")
    long, short = (r.s for r in df.select(fs.smooth(F.col("v")).alias("s")).collect())
    assert all(abs(a - k * k) < 1e-9 for k, a in enumerate(long[2:7], 2)) and short == [1.0, 5.0]


def test_unwrap(spark):
    angles = np.cumsum(np.random.default_rng(1).uniform(-3, 3, 50))
    wrapped = np.angle(np.exp(1j * angles))
    df = spark.createDataFrame([(0, k, float(a)) for k, a in enumerate(wrapped)], "clip_id long, i long, a double")
    got = [r.u for r in fs.with_unwrapped(df, "a", "u").orderBy("i").collect()]
    assert np.allclose(got, np.unwrap(wrapped))


def test_windows_share_a_sample(spark):
    df = spark.createDataFrame([(0, k) for k in range(70)], "clip_id long, i long")
    got = {r.w: (r.a, r.b) for r in fs.overlapping_windows(df, 31).groupBy("w").agg(F.min("i").alias("a"), F.max("i").alias("b")).collect()}
    assert got == {0: (0, 30), 1: (30, 60)}


def test_even_picks(spark):
    got = spark.range(1).select(fs.even_picks(F.lit(31), 5).alias("a"), fs.even_picks(F.lit(3), 5).alias("b"), fs.even_picks(F.lit(0), 5).alias("c"), fs.even_picks(F.lit(9), 1).alias("d")).first()
    assert (got.a, got.b, got.c, got.d) == ([0, 8, 15, 22, 30], [0, 1, 2], [], [4])


def test_quaternion(spark):
    half = math.pi / 6
    q = [F.lit(v) for v in (math.cos(half), 0.0, 0.0, math.sin(half))]
    assert abs(spark.range(1).select(fs.yaw_of(*q).alias("y")).first().y - math.pi / 3) < 1e-12


def test_array_files_and_logs(spark, tmp_path):
    n = 5
    np.savez(tmp_path / "clip.npz", timestamps=np.arange(n) / 10, position=np.ones((n, 2)), yaw=np.zeros(n), speed=np.arange(n), accel=np.zeros(n), yaw_rate=np.zeros(n), jerk=np.zeros(n))
    rows = files.read_array_files(spark, (tmp_path / "clip.npz").as_uri()).orderBy("i").collect()
    assert [r.speed for r in rows] == [0, 1, 2, 3, 4] and rows[2].x == 1.0
    head = "x_position_vehicle_m;y_position_vehicle_m;velocities_mps;theta_orientations_rad\n"
    (tmp_path / "a_logs.csv").write_text(head + '1;2;"3,4";"0.1,0.2"\n2;2;"4,5";"0.2,0.3"\n')
    (tmp_path / "b_logs.csv").write_text(head + '1;2;"bad,4";"0.1,0.2"\n2;2;"4,5";"0.2,0.3"\n')
    (tmp_path / "c_logs.csv").write_text(head + '1;2;"3,4";"0.1,0.2"\n')
    got = files.read_planner_logs(spark, tmp_path.as_uri() + "/*.csv").orderBy("step").collect()
    assert [(r.log, r.step, r.speed) for r in got] == [("a_logs.csv", 0, 3.0), ("a_logs.csv", 1, 4.0)]


def test_resume(spark):
    items = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("", "c")], "qa_id string, clip_id string")
    done = spark.createDataFrame([("1",), ("3",), ("",)], "qa_id string")
    assert sorted(r.qa_id for r in incremental.remaining(items, done).collect()) == ["", "2"]
    assert sorted(r.qa_id for r in incremental.remaining_groups(items.where("qa_id <> ''"), done).collect()) == ["1", "2"]


def test_balanced_subset_is_even_and_repeats(spark):
    rows = [(k, "q", "common" if k % 10 else "rare") for k in range(400)]
    df = spark.createDataFrame(rows, "clip_id long, question_id string, answer string")
    one, two = ({r.clip_id for r in sel.balanced_subset(df, 60).collect()} for _ in range(2))
    assert one == two and len(one) == 60
    assert 20 <= sum(k % 10 == 0 for k in one) <= 40


def written(folder):
    return [p for p in folder.rglob("part-*") if not p.name.endswith(".crc")]


def test_logs_share_files(spark, sf, tmp_path, monkeypatch):
    from kinegrid.plans import q_files

    monkeypatch.setattr(q_files, "place", lambda spark, name: f"file://{tmp_path}/{name}")
    assert q_files.s06(spark, sf).count() == 15 and 0 < len(written(tmp_path / "logs")) <= 8


def test_request_files_are_records(spark, sf, tmp_path, monkeypatch):
    import json

    from kinegrid.plans import q_files

    monkeypatch.setattr(q_files, "place", lambda spark, name: f"file://{tmp_path}/{name}")
    counted = {r.batch: (r.requests, r.bytes) for r in q_files.k10_sizes(spark, sf).collect()}
    assert len(counted) > 40 and 0 < len(written(tmp_path / "requests")) <= 8
    held = {r.batch: [json.loads(x) for x in r.body.split("\n")] for r in spark.read.parquet(f"{tmp_path}/requests").collect()}
    assert {k: (len(v), sum(len(x["line"]) for x in v)) for k, v in held.items()} == counted
    in_order = [x["id"] for k in sorted(held) for x in held[k]]
    assert in_order == sorted(in_order) == [r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").orderBy("o_orderkey").collect()]
