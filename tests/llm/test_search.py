"""Ranked lexical search against every score computed plainly."""

import math
import re
from collections import Counter

import numpy as np

from kinegrid.llm.op12_search import Block, count_terms, rank_documents, weights

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id long, score string, rank string, seed string, n string"
ROWS = [
    (1, "The cat sat; the CAT ran.", 9, "x", "x", "x", "x"),
    (2, "the cat", None, None, None, None, None),
    (2, "the cat", None, None, None, None, None),
    (None, "the cat", None, None, None, None, None),
    (3, None, None, None, None, None, None),
    (4, "", None, None, None, None, None),
    (5, "... !?", None, None, None, None, None),
    (6, "É É été_cat Straße STRASSE 12", None, None, None, None, None),
    (7, "dog " * 300_000 + "cat", None, None, None, None, None),
] + [(100 + k, "cat " * (k % 3 + 1) + "filler " * (k % 5), None, None, None, None, None) for k in range(80)]
ITEMS = [(1, "The cat's cat"), (2, "dog été"), (2, "Straße"), (None, "ran 12"), (3, None), (4, "?"), (5, "unknownword")]


def folded(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def by_hand(items, docs, k):
    counts = [(i, Counter(folded(t))) for i, t, *_ in docs]
    held = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    out = []
    for item, text in items:
        terms, scored = set(folded(text)), []
        for i, c in held:
            m, score = 50 + (50 * c.total() * n_docs) // n_terms, 0
            for t in terms & set(c):
                df = sum(t in x for _, x in held)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_terms():
    for text in ("Ab_C9 é\x00É~", "x" * 10, None, "  ", "a b\x7fc", "\ud800 lone"):
        assert count_terms(text) == Counter(t.encode("utf-8", "surrogatepass") for t in folded(text))


def test_ranks(spark):
    docs, items = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = by_hand(ITEMS, ROWS, 50)
    assert sorted(map(tuple, rank_documents(items, docs).collect()), key=str) == want
    assert sorted(map(tuple, rank_documents(items, docs, slice_bytes=8).collect()), key=str) == want
    assert sorted(map(tuple, rank_documents(items, docs, k=3).collect()), key=str) == by_hand(ITEMS, ROWS, 3)


def test_nothing(spark):
    docs, items = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rank_documents(items.limit(0), docs).count() == 0 and rank_documents(items, docs.limit(0)).count() == 0


def test_blocks_stop_early_and_lose_nothing():
    rng = np.random.default_rng(5)
    for n, vocabulary, least in ((1, 3, 0), (40, 6, 0), (6000, 30, 0), (6000, 30, 3_000_000_000)):
        size = rng.integers(1, vocabulary, n)
        terms = np.concatenate([np.sort(rng.choice(vocabulary, s, replace=False)) for s in size])
        of, tf = np.repeat(np.arange(n), size), rng.zipf(1.7, size.sum()) % 1000 + 1
        length = np.bincount(of, tf, n).astype(np.int64)
        weight = weights(np.bincount(terms, minlength=vocabulary), n)
        block = Block(length, of, terms, tf, weight, n, int(length.sum()))
        for _ in range(12):
            asked = np.sort(rng.choice(vocabulary, rng.integers(1, vocabulary), replace=False))
            whole = np.zeros(n, np.int64)
            m = 50 + 50 * length * n // int(length.sum())
            np.add.at(whole, of, np.where(np.isin(terms, asked), weight[terms] * (10**9 * tf // (1000 * tf + 20 * m[of])), 0))
            docs, scores = block.search(asked, 10, least)
            kth = max(np.sort(whole)[-10:][0], least, 1) if n >= 10 else max(1, least)
            assert sorted(zip(docs, scores)) == [(i, whole[i]) for i in np.flatnonzero(whole >= kth)]
