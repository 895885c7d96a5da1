"""Repeated passages and near-duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from kinegrid.llm import op02_repeats, op06_minhash
from kinegrid.llm.components import components
from kinegrid.llm.suffixes import common_prefixes, two_stage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_suffix_array_and_common_prefixes():
    draw = random.Random(1)
    for _ in range(400):
        alphabet = draw.choice([b"ab", b"abc", bytes(range(1, 255)), b"a"])
        text = bytes(draw.choice(alphabet) for _ in range(draw.randint(1, 60)))
        data = np.frombuffer(text, np.uint8)
        order = two_stage(data, 64)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        for k, length in enumerate(common_prefixes(data, order, 64).tolist()[1:], 1):
            a, b = text[order[k] :], text[order[k - 1] :]
            assert a[:length] == b[:length] and (len(b) == length or a[length : length + 1] != b[length : length + 1])


def repeats_by_hand(rows, length=50):
    out, seen = [], {}
    for i, t in rows:
        body = (t or "").encode()
        for k in range(len(body) - length + 1):
            s = body[k : k + length]
            seen[s] = min(seen.get(s, 1 << 63), i if i is not None else (1 << 63) - 1)
    for i, t in rows:
        body, own = (t or "").encode(), i if i is not None else (1 << 63) - 1
        gone = np.zeros(len(body), bool)
        for k in range(len(body) - length + 1):
            if seen[body[k : k + length]] < own:
                gone[k : k + length] = True
        left = np.frombuffer(body, np.uint8)[~gone].tobytes()
        out.append((i if i is not None else -1, len(body), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats_equal_brute_force(spark, hot):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6)))
    parts = [" ".join(word() for _ in range(draw.randint(3, 40))) for _ in range(12)]
    rows = [(k, " ".join(draw.choice(parts) if draw.random() < 0.4 else word() for _ in range(draw.randint(0, 12)))) for k in range(120)]
    rows += [(200, rows[5][1]), (201, rows[5][1]), (201, rows[5][1]), (202, None), (203, ""), (7, "x" * 300), (8, "x" * 120), (8, "x" * 49), (None, rows[9][1]), (None, parts[0] * 3)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, key string").select("doc_id", "text")
    got = op02_repeats.remove_repeats(df, group_bytes=3000, part_bytes=5000, hot=hot, window=700).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeats_by_hand(rows)


@pytest.mark.parametrize("size", [64, 300, 1 << 20])
def test_windows_hold_every_passage_once(size):
    draw = random.Random(8)
    texts = [bytes(draw.choice(b"ab ") for _ in range(draw.choice([0, 3, 49, 50, 51, 200, 900]))) for _ in range(40)]
    found = []
    for w in op02_repeats.windows([memoryview(t) for t in texts], np.arange(40), 50, size):
        for a, b in zip(w.first.tolist(), w.last.tolist(), strict=True):
            piece = int(np.searchsorted(w.begin, a, side="right")) - 1
            found += [(int(w.docs[piece]), s - int(w.begin[piece]) + int(w.offsets[piece])) for s in range(a, b + 1)]
            assert w.data[a : b + 50].tobytes() in texts[w.docs[piece]]
    assert sorted(found) == [(k, s) for k, t in enumerate(texts) for s in range(len(t) - 49)]


def test_a_very_long_text_takes_windows():
    """200 MB of text: the working memory of its windows stays far below what the whole would take."""
    import tracemalloc

    text = memoryview(np.random.default_rng(3).integers(97, 123, 200 << 20, dtype=np.uint8).tobytes())
    tracemalloc.start()
    for k, w in enumerate(op02_repeats.windows([text], np.array([1]), 50)):
        assert len(w.first) > 10_000
        if k == 3:
            break
    assert tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()


def test_repeats_of_nothing(spark):
    assert op02_repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_group_sends_a_part_one_row(spark):
    """Rows grow as groups times parts, not as windows times parts; at 10 GB of text they are under a million."""
    draw = random.Random(4)
    parts = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(60, 200))) for _ in range(60)]
    rows = [(k, str(k), "".join(draw.choice(parts) + draw.choice("xyz") for _ in range(6))) for k in range(120)]
    name = op02_repeats._grouped(spark.createDataFrame(rows, "d long, key string, text string"), 3, 2)
    texts = spark.table(name)
    answers = op02_repeats._judge(op02_repeats._send_records(texts, 4, 50, 700), 2000).localCheckpoint()
    sent = [(r.g, r.q) for r in op02_repeats._apply(texts, answers, 4, 50, 700).collect()]
    spark.sql(f"DROP TABLE {name}")
    assert len(sent) == len(set(sent)) and sum(q is not None for _, q in sent) > 4
    total = 10 << 30
    assert total / op02_repeats.group_size(total) * total / op02_repeats.PART_BYTES < 1e6


@pytest.mark.parametrize("ids", [[5], [5, 5, 6, 300], [-4, 0, 70_000, 1 << 40, (1 << 63) - 1], [9, 2, 2], [-(1 << 63), (1 << 63) - 1]])
def test_ids_are_sent_as_steps(ids):
    assert op02_repeats._full(op02_repeats._thin(np.array(ids, np.int64)), len(ids)).tolist() == ids


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats_sent_in_turns_equal_brute_force(spark, hot, monkeypatch):
    """A group that holds much sends several rows to a part; passages in a row, and zero bytes, are removed as one by one."""
    monkeypatch.setattr(op02_repeats, "HELD_BYTES", 500)
    monkeypatch.setattr(op02_repeats, "ROWS", 2)
    draw = random.Random(6)
    parts = ["".join(draw.choice("ab\0 ") for _ in range(draw.randint(45, 140))) for _ in range(9)]
    rows = [(k - 3, "".join(draw.choice(parts) for _ in range(draw.randint(0, 5)))) for k in range(60)]
    got = op02_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=3000, part_bytes=5000, hot=hot, window=700).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeats_by_hand(rows)


def near_by_hand(rows, size, percent=80):
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        n = min(size, len(words))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 1 << 60), 1 << 60 if i is None else i)
    return [(i, len(s), least[find(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 6, 30, 80]))]
        for _ in range(draw.randint(1, 12)):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 12))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).upper() if draw.random() < 0.2 else "\t".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "alone"), (904, "ALONE"), (3, rows[40][1])]
    draw.shuffle(rows)
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, node string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op06_minhash.near_duplicates(df, size=size).collect())
    assert got == sorted((i, n, c, i == c) for i, n, c in near_by_hand(rows, size))
    kept = op06_minhash.drop_near_duplicates(df, size=size)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, n, c, k in got if k})


def test_near_duplicates_with_null_ids_equal_brute_force(spark):
    """Null ids, alone in a bucket and as near copies of each other and of rows with ids."""
    draw = random.Random(4)
    rows = []
    for g in range(60):
        base = [f"v{draw.randrange(4000)}" for _ in range(40)]
        for k in range(draw.randint(1, 3)):
            copy = list(base)
            copy[draw.randrange(40)] = "x"
            rows.append((None if g % 3 == 0 or (g % 3 == 1 and k == 0) else len(rows), " ".join(copy)))
    rows += [(None, None), (None, " ")]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in op06_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()]
    want = [(i, n, None if c == 1 << 60 else c) for i, n, c in near_by_hand(rows, 2)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_drop_near_duplicates_decides_by_row(spark):
    """Rows that share an id, or have none, go only as copies of a row that stays."""
    a, b, c, x, y, z = (" ".join(f"{letter}{k}" for k in range(60)) for letter in "abcxyz")
    rows = [(0, b), (1, b + " more"), (1, a), (2, c), (2, c), (2, c.upper()), (None, x), (None, x + " more"), (None, y), (None, z), (5, z + " more"), (6, " "), (None, None)]
    for some in (rows, [r for r in rows if r[0] not in (1, 2)]):
        df = spark.createDataFrame([(i, t, {"k": "v"}) for i, t in some], "doc_id long, text string, more map<string,string>")
        kept = op06_minhash.drop_near_duplicates(df)
        assert kept.schema == df.schema
        got = [(r.doc_id, None if r.text is None else r.text.lower().removesuffix(" more")) for r in kept.collect()]
        want = [(0, b), (1, a), (2, c), (None, x), (None, y), (5, z), (6, " "), (None, None)]
        assert sorted(got, key=str) == sorted((w for w in want if w[0] in [i for i, _ in some]), key=str)


def test_near_duplicates_of_nothing(spark):
    assert op06_minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_between_components_of_a_bucket(spark):
    """Two nodes that no hub ties together are still linked in their bucket."""
    texts = [" ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(3, 60))]
    sets = [op06_minhash.shingle_set(t) for t in texts]
    rows = [(1, op06_minhash.set_key(s), op06_minhash.set_key(s), bytearray(op06_minhash.band_keys(s)[1]), len(s), bytearray(np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes())) for s in sets]
    df = spark.createDataFrame(rows, "key long, node long, label long, signature binary, n long, body binary")
    assert op06_minhash._links_between(df, 80).count() == 1
    assert op06_minhash._links_between(df, 99).count() == 0


def test_links_between_parts_of_a_bucket(spark):
    """A bucket cut into many small units gives the same links between components as one unit, and no unit holds it whole."""
    draw = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[draw.randint(0, 6) :] + [f"y{k}"]) for k in range(60)]
    rows = []
    for k, t in enumerate(texts):
        s = op06_minhash.shingle_set(t)
        rows.append((1, op06_minhash.set_key(s), 1 if k < 40 else k, bytearray(op06_minhash.band_keys(s)[1]), len(s), bytearray(np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes())))
    df = spark.createDataFrame(rows, "key long, node long, label long, signature binary, n long, body binary")
    label = {r[1]: r[2] for r in rows}
    found = []
    for block in (op06_minhash.BLOCK, 300):
        found.append({tuple(sorted((label[r.u], label[r.v]))) for r in op06_minhash._links_between(df, 80, block).collect()})
    assert found[0] == found[1] and len(found[0]) > 100
    units = op06_minhash._dealt(df, 300).groupBy("key", "b", "c").count().collect()
    assert len(units) > 8 and max(u["count"] for u in units) < 60


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, 200), (300, 100), (7, 7), (400, 399), (398, 400)] + [(k, 500) for k in range(501, 600)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 10 for k in range(11, 41)}, 200: 100, 300: 100, 399: 398, 400: 398, **{k: 500 for k in range(501, 600)}}
