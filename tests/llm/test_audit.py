"""The filter interaction audit against a walk through every order."""

from itertools import permutations

from conftest import same_rows

import pandas as pd
from pyspark.sql import functions as F

from kinegrid.llm.op11_audit import audit, failed_sets, lattice, text_filters

DOCS = "doc_id long, text string, source string, part string, mask int, n string"
LONG = " ".join(f"w{k}" for k in range(300))
ROWS = [
    (1, LONG, "a", "x", 1, "y"),
    (2, LONG, "a", "x", 1, "y"),
    (2, LONG, "a", "x", 1, "y"),
    (None, LONG, "a", None, None, None),
    (3, "", "b", None, 1, None),
    (4, None, "b", "x", 1, "y"),
    (5, "SHOUT | a a a a", None, "x", 1, "y"),
    (6, "word " * 50_000, "", "x", 1, "y"),
    (7, LONG.upper() + " $", "a", "x", 1, "y"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (5, None, 1), (None, 1, 1), (7, 1, 0)]


def by_hand(rows, labels):
    import re

    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    docs = []
    for i, text, source, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        fails["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)
        docs.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own, removed = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for at, letter in enumerate(order):
                gone = [d for d in left if letter in d[1]]
                redundant = sum(letter in d[1] for d in own) - len(gone)
                left = [d for d in left if letter not in d[1]]
                removed[letter] += len(gone)
                out.append([part, "".join(order), at + 1, len(left), len(gone), redundant, sum(d[1] == {letter} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)])
        for row in out[-600:]:
            row.append(removed[row[1][row[2] - 1]])
    return pd.DataFrame(out, columns="part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split())


def audited(spark, rows, labels):
    docs, held = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flags = {"good": (held, F.col("quality") == 1), "toxic": (held, F.col("toxic") == 1)}
    return audit(failed_sets(docs, list("ABCDE"), text_filters(F.coalesce("text", F.lit(""))), "E", flags), list("ABCDE"), list(flags))


def test_every_step_of_every_order(spark):
    same_rows(audited(spark, ROWS, LABELS).toPandas(), by_hand(ROWS, LABELS))


def test_nothing_and_no_labels(spark):
    assert audited(spark, [], LABELS).count() == 0
    same_rows(audited(spark, ROWS[:5], []).toPandas(), by_hand(ROWS[:5], []))


def test_lattice_of_five_has_eighty_edges_and_all_orders():
    edges = lattice(5)
    assert len(edges) == 80 and sum(n for _, _, n in edges) == 600


def test_filters_of_the_callers_own(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "bb", "s"), (3, "ccc", "s")], "doc_id long, text string, source string")
    fails = {"X": F.length("text") < 2, "Y": F.length("text") < 3}
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in audit(failed_sets(docs, ["X", "Y"], fails, None, {}), ["X", "Y"], []).collect()}
    assert rows == {("XY", 1): (2, 1, 0), ("XY", 2): (1, 1, 1), ("YX", 1): (1, 2, 0), ("YX", 2): (1, 0, 1)}
