"""Answer parsing on sentences of its own, scoring on random tables against plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from kinegrid.functions import text as tx
from kinegrid.operators import metrics as m


def parsed(spark, texts, choices):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r.p for r in df.select("k", tx.parse_choice(F.col("t"), choices).alias("p")).orderBy("k").collect()]


def test_parse_choice(spark):
    colours = ["dark_red", "red", "blue"]
    texts = ["Blue", "  BLUE. ", "I think it is **red**", "dark red", "It looks dark red to me", "", None, "hard to say", "It moves and turns.\nAnswer: blue", "redder"]
    assert parsed(spark, texts, colours) == ["blue", "blue", "red", "dark_red", "dark_red", None, None, None, "blue", None]


def test_numbers(spark):
    df = spark.createDataFrame([("it was -17.25 m",), ("no digits",), ("7 of 9",)], "t string")
    assert [r.n for r in df.select(tx.first_number(F.col("t")).alias("n")).collect()] == ["-17.25", None, "7"]
    draw = random.Random(8)
    values = [f"{draw.uniform(-1, 1) * 10 ** draw.randint(-7, 9):.8f}" for _ in range(200)] + ["word", "12.0"]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v string").select("k", tx.short_number(F.col("v")).alias("n")).orderBy("k").collect()
    assert [r.n for r in rows[:200]] == [f"{float(v):g}" for v in values[:200]] and [r.n for r in rows[200:]] == ["word", "12"]


def test_grouped_answers(spark):
    df = spark.createDataFrame([("3) third\nA2: second\n9: none\n3. last third",)], "t string")
    assert df.select(tx.grouped_answers(F.col("t"), 4).alias("a")).first().a == ["", "second", "last third", ""]


def by_hand(pairs):
    """accuracy, macro F1 over all labels seen, balanced accuracy over the labels that occur as oracle."""
    names = {x for p in pairs for x in p}
    hit, said, true = Counter(o for o, p in pairs if o == p), Counter(p for _, p in pairs), Counter(o for o, _ in pairs)
    f1 = [2 * hit[x] / (said[x] + true[x]) for x in names]
    return sum(hit.values()) / len(pairs), sum(f1) / len(f1), sum(hit[x] / true[x] for x in true) / len(true)


def test_metrics_equal_plain_python(spark):
    draw = random.Random(11)
    groups = {f"g{k}": [(draw.choice("abcd"[: 1 + k % 4]), draw.choice("abcde"[: 1 + k % 5])) for _ in range(draw.randint(1, 30))] for k in range(20)}
    df = spark.createDataFrame([(g, o, p) for g, pairs in groups.items() for o, p in pairs], "g string, oracle string, pred string")
    got = {r.g: (r.accuracy, r.macro_f1, r.balanced_accuracy) for r in m.group_metrics(df, ["g"]).collect()}
    for g, pairs in groups.items():
        assert all(abs(x - y) < 1e-6 for x, y in zip(got[g], by_hand(pairs), strict=True)), g
    everything = [p for pairs in groups.values() for p in pairs]
    grid = {(r.oracle, r.pred): r.n for r in m.confusion(df, list("abcdef")).collect()}
    assert grid == {(o, p): Counter(everything)[o, p] for o in "abcdef" for p in "abcdef"}
    both = {(r.scope, r.key): r.accuracy for r in m.multi_group_metrics(df, ["g"]).collect()}
    assert abs(both["global", ""] - by_hand(everything)[0]) < 1e-6 and len(both) == 21


def test_consistency_by_hand(spark):
    draw = random.Random(13)
    given = {(f"c{k}", q): draw.choice(["low", "high"]) for k in range(30) for q in ("p", "q", "r") if draw.random() < 0.8}
    answers = spark.createDataFrame([(c, q, a) for (c, q), a in given.items()], "clip_id string, question_id string, answer string")
    rules = spark.createDataFrame([("one", "p", "eq", "low", "q", "eq", "high"), ("two", "q", "eq", "high", "r", "eq", "low")], m.RULE)
    fired = [(c, x, y, v) for c in {c for c, _ in given} for x, u, y, v in (("p", "low", "q", "high"), ("q", "high", "r", "low")) if given.get((c, x)) == u and (c, y) in given]
    touched, broken = {c for c, *_ in fired}, {c for c, _, y, v in fired if given[c, y] != v}
    got = m.consistency(answers, rules).first()
    assert abs(got.rate - (1 - len(broken) / len(touched))) < 1e-3
    assert abs(got.mean_violations - sum(given[c, y] != v for c, _, y, v in fired) / len(touched)) < 1e-3


def test_decimals_are_those_of_the_binary_value(spark):
    values = [0.0, -0.0, -0.001, 1.005, 0.125, 0.345, -2.675, 0.995, 9.9999, 7e14 + 0.125, 2.0**62, 5e17 + 3, 1e-300, float("inf"), float("-inf"), float("nan"), 0.25, 123456789.005, 143.5, 144.5]
    values += [k / 1000 for k in range(-1005, 1005, 10)] + [a / 100 - b / 100 for a in range(0, 9000, 125) for b in (10_003.36, 77.77)]
    for decimals in (0, 1, 2):
        got = [r.t for r in spark.createDataFrame(list(enumerate(values)), "k int, v double").select("k", tx.fixed(F.col("v"), decimals).alias("t")).orderBy("k").collect()]
        assert got == [f"{v:.{decimals}f}" for v in values]
    assert spark.range(1).select(tx.fixed(F.lit(None).cast("double"), 2).alias("t")).first().t is None
    texts = ["1.0000005", "2.5000015", "0.00012345650", "143.0625", "-7.25", "Infinity", "word", None]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "k int, v string").select("k", tx.short_number(F.col("v")).alias("t")).orderBy("k").collect()]
    assert got == [f"{float(t):g}" for t in texts[:5]] + ["Infinity", "word", None]


def test_coordinates_equal_sql_at_ties_and_gaps(spark, tmp_path):
    import datetime

    import duckdb

    from kinegrid import registry

    rows = [(k, u, v) for k, (u, v) in enumerate((u, v) for u, track in enumerate([[0.0, 1.005, 0.125, 4.65, 5.85, 9.0], [0.345, 1.35, None, 2.0], [None, 1.0], [3.0]]) for v in track)]
    start = datetime.datetime(2024, 1, 1)
    frame = spark.createDataFrame([(k, start + datetime.timedelta(seconds=k), u, "click", v) for k, u, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["P15_coordinates_text"]).fetchall()
    assert sorted(map(tuple, registry.queries()["P15_coordinates_text"](spark, str(tmp_path)).collect())) == sorted(want)
