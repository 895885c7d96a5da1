"""Chains, files by size, tau and quantiles on random rows against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrid.operators.agreement import inversions, kendall_tau, ranked
from kinegrid.operators.batching import in_sequence, next_fit
from kinegrid.operators.chains import chain_places
from kinegrid.operators.quantiles import above, quantiles


def chains_by_hand(links):
    nodes, named = dict(links), {}
    for s in sorted(nodes):
        if nodes[s] is not None:
            named.setdefault(nodes[s], s)
    out = {s: [None, None, "last" if n is None else "missing" if n not in nodes else "next" if named[n] == s else "taken"] for s, n in nodes.items()}
    for s in nodes:
        if s not in named:
            at, k = s, 0
            while True:
                out[at][:2] = [s, k]
                if out[at][2] != "next":
                    break
                at, k = nodes[at], k + 1
    return {s: tuple(v) for s, v in out.items()}


def test_chains_rings_and_breaks(spark):
    draw = random.Random(11)
    for n in (0, 1, 2, 60):
        ids = draw.sample(range(1000), n)
        links = [(s, draw.choice([None, draw.choice(ids), 5000 + s]) if draw.random() < 0.3 else ids[(k + 1) % n]) for k, s in enumerate(ids)]
        got = chain_places(spark.createDataFrame(links, "sample long, next long"))
        assert {r.sample: (r.head, r.place, r.link) for r in got.collect()} == chains_by_hand(links)


def test_a_long_chain_a_ring_and_repeated_rows(spark):
    links = [(k, k + 1) for k in range(700)] + [(700, None), (5, 6), (None, 3), (901, 902), (902, 901), (903, 903)]
    got = {r.sample: (r.head, r.place) for r in chain_places(spark.createDataFrame(links, "sample long, next long")).collect()}
    assert got == {**{k: (0, k) for k in range(701)}, 901: (None, None), 902: (None, None), 903: (None, None)}


@pytest.mark.parametrize("most_bytes, most_rows", [(100, 1000), (10**9, 7), (60, 3), (25, 50), (1, 4), (400, 11)])
def test_files_by_size_equal_the_sequential_rule(spark, most_bytes, most_rows):
    draw = random.Random(most_bytes)
    for n in (0, 1, 3, 200):
        rows = [(k, draw.choice([0, 1, 5, draw.randrange(1, 40), 130])) for k in range(n)]
        shuffled = draw.sample(rows, n)
        df = spark.createDataFrame(shuffled, "k long, size long")
        got = {r.k: r.batch for r in next_fit(df, ["k"], F.col("size"), most_bytes, most_rows).collect()}
        assert [got[k] for k in range(n)] == in_sequence((s for _, s in rows), most_bytes, most_rows)


def pairs_by_hand(rows):
    c = d = 0
    for i in range(len(rows)):
        for j in range(i):
            s = (rows[i][0] - rows[j][0]) * (rows[i][1] - rows[j][1])
            c, d = c + (s > 0), d + (s < 0)
    return c, d


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 30, 200):
        a, b, w = rng.integers(0, 15, n), rng.integers(0, 15, n), rng.integers(1, 4, n)
        assert inversions(a, b, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i) if (a[i] - a[j]) * (b[i] - b[j]) < 0)


@pytest.mark.parametrize("spread", [3, 40, 10**6])
def test_pairs_of_ranked_rows(spark, spread):
    draw = random.Random(spread)
    rows = [(draw.randrange(spread), 7 if draw.random() < 0.3 else draw.randrange(spread)) for _ in range(160)] + [(None, 1), (2, None)]
    got = ranked(spark.createDataFrame(rows, "a long, b long"), "a", "b", ranges=8).first()
    assert (got.concordant, got.discordant) == pairs_by_hand([r for r in rows if None not in r])


def test_tau_and_its_ends(spark):
    def of(one, two):
        a, b = (spark.createDataFrame([(k, n) for n, k in enumerate(r)], "name string, rank long") for r in (one, two))
        return kendall_tau(a, b).first().tau

    assert of("abcd", "abcd") == 1.0 and of("abcd", "dcba") == -1.0 and of("abcx", "bac") == pytest.approx(1 / 3)
    assert of("", "ab") == 0.0 and of("ab", "") == 0.0 and of("ab", "bx") == 1.0 and of("ab", "xy") == 1.0
    tied = spark.createDataFrame([("a", 1), ("b", 1)], "name string, rank long")
    assert kendall_tau(tied, tied).first().tau == 1.0


@pytest.mark.parametrize("parts", ["400", "5000"])
def test_quantiles_at_a_clusters_settings(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(20_000).selectExpr("CAST((id * 7919) % 20000 AS DOUBLE) AS v")
        assert list(quantiles(df, "v", {"a": 0.05, "b": 0.5, "c": 1.0}).first()) == pytest.approx([999.95, 9999.5, 19999.0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_above_counts_the_bounds_below(spark):
    values = [float(v) for v in range(-3, 60)] + [2.5, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (0, 1, 2, 5, 23, 50):
        bounds = [float(2 * k) for k in range(n)]
        for r in df.select("v", above(F.col("v"), bounds).alias("a"), above(F.col("v"), bounds, True).alias("b")).collect():
            assert (r.a, r.b) == (sum(b < r.v for b in bounds), sum(b <= r.v for b in bounds))


def test_bootstrap_equals_copied_clips(spark):
    from hashlib import md5

    from kinegrid.operators import bootstrap as bs

    draw = random.Random(2)
    rules = [("one", "p", "eq", "x", "q", "eq", "y"), ("two", "q", "neq", "y", "p", "neq", "z"), ("never", "p", "eq", "w", "q", "eq", "y")]
    rows = [(m, c, q, draw.choice("xyz"), draw.choice("xyz")) for m in "ab" for c in range(12) for q in "pq" if draw.random() < 0.9]
    df = spark.createDataFrame(rows, "model string, clip_id long, question_id string, oracle string, pred string")
    got = {(r.model, r.replicate): (r.balanced_accuracy, r.wpcr) for r in bs.replicate_metrics(bs.replicate_sums(bs.clip_cells(df, rules), 9)).collect()}
    for model in "ab":
        for b in range(9):
            copies = []
            for c in range(12):
                u = int(md5(f"{b // 4}:{c}".encode()).hexdigest()[8 * (b % 4) : 8 * (b % 4) + 8], 16) / 2**32
                copies += [[r for r in rows if r[0] == model and r[1] == c]] * sum(u >= x for x in bs.POISSON)
            flat = [r for clip in copies for r in clip]
            recalls = [sum(r[4] == r[3] for r in flat if r[3] == label) / sum(r[3] == label for r in flat) for label in {r[3] for r in flat}]
            checked, used = [], set()
            for clip in copies:
                own, found = {r[2]: r[4] for r in clip}, []
                for name, p, op, x, q, op2, y in rules:
                    if p in own and q in own and (own[p] == x) == (op == "eq"):
                        found.append((own[q] == y) != (op2 == "eq"))
                        used.add(name)
                if found:
                    checked.append(any(found))
            rate = round(checked.count(False) / len(checked), 4)
            assert got[model, b] == pytest.approx((sum(recalls) / len(recalls), round(rate * len(used) / 3, 4)), abs=1e-4)


def test_next_events_and_counts_inside(spark):
    from kinegrid.functions.series import count_inside, with_next

    draw = random.Random(9)
    rows = [(c, k, draw.randrange(0, 30) / 4, draw.random() < 0.4) for c in range(5) for k in range(30)]
    df = spark.createDataFrame(rows, "clip_id long, k long, t double, e boolean")
    for low, high in ((0.0, 2.0), (0.5, 0.5), (1.0, float("inf")), (3.0, 1.0)):
        got = {(r.clip_id, r.k): r.x for r in with_next(df, F.col("e"), "x", low, high).collect()}
        assert got == {(c, k): min((u for d, _, u, e in rows if d == c and e and t + low <= u <= t + high), default=None) for c, k, t, _ in rows}
        spans = df.withColumns({"a": F.col("t") + low, "b": F.col("t") + high})
        counts = {(r.clip_id, r.k): r.points for r in count_inside(spans, df, "k", "a", "b", "t").collect()}
        assert counts == {(c, k): sum(d == c and t + low <= u <= t + high for d, _, u, _ in rows) for c, k, t, _ in rows}


def test_a_clip_of_a_million_samples_and_an_open_gap(spark):
    from kinegrid.operators.rules import sequential_event

    clip = spark.range(1_000_000).selectExpr("1L AS clip_id", "id AS i", "id * 0.1D AS t", "CASE WHEN id = 10 THEN -9.0D ELSE 0.0D END AS accel", "CASE WHEN id = 999990 THEN 1.0D ELSE 0.0D END AS yaw_rate")
    first, second = {"signal": "accel", "operator": "less_than", "threshold": -5.0}, {"signal": "yaw_rate", "operator": "greater_than", "threshold": 0.5}
    r = sequential_event(clip, first, second, (0.0, float("inf"))).first()
    assert (r.answer, r.first_t) == ("yes", 1.0) and r.gap == pytest.approx(99998.0)
    assert sequential_event(clip, first, second, (0.0, 99997.0)).first().answer == "no"


def test_a_wrong_time_makes_no_endless_grid(spark):
    from kinegrid.functions.series import over_long, uniform_grid

    tracks = spark.createDataFrame([(1, 0.0), (1, 2.0), (2, 0.0), (2, 1e12)], "clip_id long, ts double")
    assert {r.clip_id for r in uniform_grid(tracks).collect()} == {1} and [r.clip_id for r in over_long(tracks).collect()] == [2]
