"""Toxicity by nearest examples: the index against all cosines, the whole operator against a plain version, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kinegrid.llm.op12_search import count_terms
from kinegrid.llm.op13_toxicity import BACKGROUND, LIFT, NEAREST, SEEN, SIGNIFICANT, Index, drop_toxic, learn, op13_toxicity, rate

DOCS = "doc_id long, text string, lang string, _score string, _evidence string"


def vector(held, idf):
    v = np.zeros(len(idf) + 1)
    for k, n in held:
        v[k] = (1 + math.log(n)) * idf[k]
    v[-1] = BACKGROUND
    return v / np.linalg.norm(v)


def scores_by_hand(held, examples, idf, rates, k=NEAREST):
    """Those of equal vectors share what is left of the votes. Of entries at equal cosines any may come first: the least and the most that the score can be."""
    return [_by_hand(held, examples, idf, rates, k, sign) for sign in (1, -1)]


def _by_hand(held, examples, idf, rates, k, sign):
    groups = {}
    for _, toxic, own in examples:
        groups.setdefault(tuple(own), [0, 0])[toxic] += 1
    q = vector(held, idf)
    near = sorted(((float(q @ vector(g, idf)), n) for g, n in groups.items()), key=lambda x: (-round(x[0], 12), sign * x[1][1] / sum(x[1])))
    left, share = k, [0.0, 0.0]
    for cosine, n in near:
        part = min(left, sum(n)) / sum(n)
        for c in (0, 1):
            share[c] += cosine**2 * part * n[c] / rates[c]
        left -= min(left, sum(n))
        if not left:
            break
    return share[1] / sum(share) if sum(share) else 0.0


def random_held(rng, terms):
    return tuple((int(k), int(rng.integers(1, 4))) for k in np.sort(rng.choice(terms, rng.integers(0, 5), replace=False)))


def test_index_finds_the_nearest_of_all():
    rng = np.random.default_rng(3)
    for n in (1, 5, 90, 900):
        idf = rng.random(40) * 5 + 1
        examples = [(i, int(rng.random() < 0.3), random_held(rng, 40)) for i in range(n)]
        index = Index(examples, idf, (0.5, 1.0), block=16)
        for _ in range(60):
            held = random_held(rng, 40)
            found, cosines = index.nearest(held, 7)
            whole = np.array([vector(held, idf) @ vector(h, idf) for h in {e[2]: 0 for e in examples}])
            assert np.allclose(np.sort(whole)[::-1][: len(cosines)], cosines)
            assert index.votes[found].sum() >= min(7, n) and (len(found) < 2 or index.votes[found[:-1]].sum() < 7)


def test_index_of_nothing():
    assert Index([], np.ones(3), (1.0, 1.0)).score(((0, 1),)) == (0.0, [])
    assert Index([(1, 1, ())], np.ones(0), (1.0, 1.0)).score(()) == (1.0, [1])


def test_query_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held_out = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 4 == 2 for d in docs}
    counts = {d.doc_id: count_terms(d.text) for d in docs}
    learned = [(i, labels[i]) for i in counts if i in labels and not held_out[i]]
    n1 = sum(t for _, t in learned)
    n0, seen = len(learned) - n1, {0: Counter(), 1: Counter()}
    for i, t in learned:
        seen[t].update(counts[i].keys())
    chosen = []
    for t in set(seen[0]) | set(seen[1]):
        a, b = seen[0][t], seen[1][t]
        chi = (n0 + n1) * (b * (n0 - a) - a * (n1 - b)) ** 2 / max(1, (a + b) * (n0 + n1 - a - b) * n0 * n1)
        if a + b >= SEEN and chi >= SIGNIFICANT and b * n0 >= LIFT * a * n1:
            chosen.append(t)
    chosen.sort(key=bytes.decode)
    idf = [1 + math.log((len(docs) + 1) / (sum(t in c for c in counts.values()) + 1)) for t in chosen]
    held = {i: tuple((k, c[t]) for k, t in enumerate(chosen) if t in c) for i, c in counts.items()}
    examples = [(i, t, held[i]) for i, t in learned]
    assert chosen
    rows = op13_toxicity(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        least, most = scores_by_hand(held[r.doc_id], examples, idf, (1.0, 1.0))
        assert r.held_out == held_out[r.doc_id] and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1
        assert least - 1e-9 <= r.score <= most + 1e-9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op13_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic]
    spared = [1 - r.predicted for r in rows if not r.toxic]
    assert sum(caught) >= 0.5 * len(caught) and sum(spared) >= 0.97 * len(spared)


def toxic_rows():
    rows = [(i, f"word{i} some plain text", "en", "x", "y") for i in range(60)] + [(100 + i, f"word{i} you vile fool", "en", "x", "y") for i in range(40)]
    labels = [(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(40)]
    return rows, labels


def test_odd_rows(spark):
    rows, labels = toxic_rows()
    odd = [(None, None, None, None, None), (None, "vile fool you", None, None, None), (500, "", None, None, None), (501, "plain " * 200_000 + "text some", None, None, None), (501, "you vile fool", None, None, None), (501, "you vile fool", None, None, None)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    held = spark.createDataFrame([*labels, (None, 1), (1, None), (2, 1), (2, 0), (999, 1)], "doc_id long, toxic int")
    out = rate(docs.drop("_score", "_evidence"), *learn(docs, held)).collect()
    assert len(out) == len(rows) + len(odd)
    score = {(r.doc_id, r.text): r._score for r in out}
    assert score[None, "vile fool you"] > 0.9 and score[501, "you vile fool"] > 0.9
    assert score[501, "plain " * 200_000 + "text some"] < 0.1 and score[None, None] == score[500, ""] < 0.9
    kept = drop_toxic(docs, held)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(3, 60))
    assert not {r.doc_id for r in kept.collect()} & set(range(100, 140))


def test_nothing_to_learn_and_no_rows(spark):
    rows, labels = toxic_rows()
    docs, held = spark.createDataFrame(rows, DOCS).drop("_score", "_evidence"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert {r._score for r in rate(docs, *learn(docs, held.limit(0))).collect()} == {0.0}
    assert rate(docs.limit(0), *learn(docs.limit(0), held)).count() == 0


def test_a_bounded_sample_keeps_the_rate(spark):
    rows, labels = toxic_rows()
    docs, held = spark.createDataFrame(rows, DOCS).drop("_score", "_evidence"), spark.createDataFrame(labels, "doc_id long, toxic int")
    number, index = learn(docs, held, sample=20)
    assert 10 <= index.votes.sum() <= 70
    scores = {r.doc_id: r._score for r in rate(docs, number, index).collect()}
    assert np.mean([scores[i] for i in range(100, 140)]) > np.mean([scores[i] for i in range(60)]) + 0.3
