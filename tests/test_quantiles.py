"""Exact quantiles against numpy and sorted lists."""

import random

import numpy as np
import pytest

from kinegrid.operators.quantiles import quantiles

SHARES = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}


@pytest.mark.parametrize("hot", [0.0, 0.7])
def test_groups_against_sorted_lists(spark, hot):
    draw = random.Random(5)
    rows = [(draw.choice(["x", "y", None]), 3.0 if draw.random() < hot else draw.uniform(-50, 50)) for _ in range(701)]
    df = spark.createDataFrame(rows + [("x", None), ("z", None)], "g string, v double")
    lines = {r.g: r for r in quantiles(df, "v", SHARES, by=("g",)).collect()}
    picks = {r.g: r for r in quantiles(df, "v", {"c": 0.5, "d": 0.95}, by=("g",), between=False).collect()}
    assert set(lines) == set(picks) == {"x", "y", None}
    for g in lines:
        own = sorted(v for k, v in rows if k == g)
        assert [lines[g][n] for n in SHARES] == pytest.approx([float(np.quantile(own, p)) for p in SHARES.values()])
        assert (picks[g].c, picks[g].d) == (own[len(own) // 2], own[int(0.95 * len(own))])


def test_lone_rows_and_empty_tables(spark):
    one = spark.createDataFrame([(7,)], "v long")
    assert list(quantiles(one, "v", SHARES).first()) == [7.0] * 5
    assert list(quantiles(one.limit(0), "v", {"a": 0.5}).first()) == [None]
    assert quantiles(one.limit(0).selectExpr("v", "v AS g"), "v", {"a": 0.5}, by=("g",)).count() == 0
