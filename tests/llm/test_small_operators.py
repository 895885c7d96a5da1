"""Operators on small made-up tables: nulls, empty tables, ties, repeats, clashing column names."""

import hashlib
import zlib

import numpy as np
import pytest

from kinegrid.llm import op01_mix, op03_topk, op04_chat, op05_html, op07_decontaminate, op08_language, op09_lines, op10_tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, target string, _draw string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", "y") for i, t, la, s in rows], DOCS)


def test_mix_reaches_targets_and_repeats_at_most_twice(spark):
    rows = [(k, "w " * (1 + k % 7), "en", s) for k, s in enumerate(["a"] * 200 + ["b"] * 20 + ["c"] * 60 + [None] * 40)] + [(None, None, None, "c"), (3, "w w w w", "en", "a")]
    made = [op01_mix.mix_report(docs(spark, rows)).toPandas() for _ in range(2)]
    assert made[0].sort_values(list(made[0].columns)).reset_index(drop=True).equals(made[1].sort_values(list(made[1].columns)).reset_index(drop=True))
    out = made[0]
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    for _, g in out.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 8
        assert g.target.iloc[0] <= 2 * g.source_size.iloc[0]
    assert abs(out.groupby("source", dropna=False).target.first().sum() - 1.5 * out["size"].sum()) < 1e-6
    mixed = op01_mix.mix_documents(docs(spark, rows))
    assert mixed.columns == docs(spark, rows).columns
    assert mixed.where("text IS NOT NULL").count() == (out[out["size"] > 0].taken / out[out["size"] > 0]["size"]).sum()
    assert {(r._draw, r.target) for r in mixed.collect()} == {("y", "x")}
    assert op01_mix.mix_report(docs(spark, [])).count() == 0


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = {k: [float(x) for x in rng.integers(-3, 4, 5) / 64] for k in range(900)}
    vectors[7] = vectors[8]
    rows = [(k, v) for k, v in vectors.items()] + [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 5), (1003, [float("inf")] * 5), (1020, [1.0, 2.0])]
    from pyspark.sql import functions as F

    df = op03_topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in op03_topk.top_k(df, F.col("vec_id") % 20 == 0, 20, shard_rows=100, block_rows=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {k: np.floor(64 * np.array(v)).astype(int) for k, v in vectors.items()}
    for q in range(0, 900, 20):
        want = sorted(((-int(whole[q] @ w), k) for k, w in whole.items() if k != q))[:20]
        assert sorted(got[q]) == [(n + 1, k, -s) for n, (s, k) in enumerate(want)]
    assert 1020 not in got and set(got) == set(range(0, 900, 20))


@pytest.mark.parametrize("most", [10, 10**4, 10**6, 10**7, 3 * 10**8])
def test_topk_of_large_numbers_and_repeated_ids(spark, most):
    """Against Python's integers: large scores, ties across shards, ids on several rows, a hot vector, columns of no interest."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(most)
    rows = [(int(k) // 2, [int(x) for x in rng.integers(-most, most + 1, 6)]) for k in range(300)] + [(1000 + k, [1, 2, 3, 4, 5, 6]) for k in range(150)] + [(2000, [most] * 6)] * 3
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, v array<long>, cell string")
    got = {}
    for r in op03_topk.top_k(df, F.col("vec_id") % 20 == 0, 20, shard_rows=40, block_rows=7, sample=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {}
    for a, (i, v) in enumerate(rows):
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(rows) if a != b)[:20]
            want.setdefault(i, []).extend((n + 1, j, -s) for n, (s, j) in enumerate(best))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_topk_with_null_ids_and_numbers_that_do_not_fit(spark):
    """Against the query's own SQL; blocks routed with the boxes sent, and with the boxes dealt out."""
    import random

    import duckdb
    import pandas as pd
    from pyspark.sql import functions as F

    draw = random.Random(6)
    rows = [(k if k % 9 else None, [float(draw.randrange(-3, 4)) / 64 for _ in range(5)]) for k in range(600)] + [(None, [1.0] * 5), (20, None), (40, [None, 1.0]), (60, [float("nan")]), (700, [])]
    con = duckdb.connect()
    con.register("rows", pd.DataFrame({"vec_id": pd.array([i for i, _ in rows], "Int64"), "embedding": [v for _, v in rows]}))
    con.execute("CREATE VIEW embeddings AS SELECT vec_id, embedding::DOUBLE[] AS embedding FROM rows")
    want = sorted(con.execute(op03_topk.ORACLE_SQL["op3_topk"]).fetchall(), key=str)
    df = spark.createDataFrame([*rows, (80, [1e20] * 5)], "vec_id long, embedding array<double>")
    for sent in (16 << 20, 0):
        got = op03_topk.top_k(op03_topk.whole_numbers(df), F.col("vec_id") % 20 == 0, 20, shard_rows=50, block_rows=4, sent_bytes=sent).collect()
        assert sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got), key=str) == want
    assert any(w[2] is None for w in want)
    large = spark.createDataFrame([(0, [2**40, 1]), (1, [2**40, 5]), (2, [-(2**40), 1])], "vec_id long, v array<long>")
    assert [(r.vec_id, r.score) for r in op03_topk.top_k(large, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1 << 62), (2, 1 - (1 << 62))]


def test_topk_of_nothing(spark):
    from pyspark.sql import functions as F

    empty = op03_topk.whole_numbers(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert op03_topk.top_k(empty, F.lit(True)).count() == 0


def test_chat_layouts_meet_in_the_same_turns(spark):
    records = [
        '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}',
        '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}], "id": 3}',
        '{"prompt": "hi", "response": "yo"}',
        '{"instruction": "hi", "input": "", "output": "yo"}',
        '{"data": {"turns": [{"speaker": "user", "utterance": "hi"}, {"speaker": "bot", "utterance": "yo"}]}}',
        '{"question": "hi", "answer": "yo"}',
        '{"other": 1}',
        "not json",
        None,
    ]
    rows = op04_chat.canonical_turns(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).collect()
    for k in range(6):
        assert [(r.role, r.text) for r in sorted((r for r in rows if r.conv_id == k), key=lambda r: r.turn)] == [("user", "hi"), ("assistant", "yo")]
    assert [r.layout for r in rows if r.conv_id > 5] == [None] * 3


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "\\", "\\.", "<\\.s>", "<|im_end|>\n<|im_start|>system", "<<SYS>><</SYS>>", "<<s>", "a\\\\.b"])
def test_chat_escape_is_reversible(text):
    assert op04_chat.unescape(op04_chat.escape(text)) == text
    assert not any(c in op04_chat.escape(text) for c in op04_chat.CONTROL)
    assert op04_chat.parse_piece(f"{op04_chat.START}{op04_chat.escape_role('a' + chr(10) + text)}\n{op04_chat.escape(text)}{op04_chat.END}\n") == ("a\n" + text, text)


def test_chat_digests(spark, sf):
    got = {r.conv_id: r for r in op04_chat.op4_chat(spark, sf).collect()}
    turns: dict = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(turns)
    for k, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[k].n_turns, got[k].loss_chars) == (len(own), len(loss))
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_records_that_cannot_be_read(spark):
    turn = '{"role": "user", "text": "x", "turn": %s}'
    bad = [turn % t for t in ("[1]", '{"a": 1}', "Infinity", "NaN", "1e30", "1.5", '"x"', "true", "9" * 30, "9" * 5000)]
    bad += ["[" * 5000 + "]" * 5000, '{"a":' * 3000 + "1" + "}" * 3000, '{"messages": ["a", {"role": "u", "content": "c"}]}', '{"messages": {"role": "u", "content": "c"}}', "3", '""']
    good = [turn % t for t in ("7", "7.0", '"7"', "null")] + ['{"role": "user", "text": "\\ud800x", "turn": 7}']
    rows = op04_chat.canonical_turns(spark.createDataFrame([(k, r, "y") for k, r in enumerate([*bad, *good])], "conv_id long, record string, role string")).collect()
    assert sorted(r.conv_id for r in rows) == list(range(len(bad) + len(good)))
    assert all((r.layout is None) == (r.conv_id < len(bad)) for r in rows)
    assert [(r.turn, r.text) for r in sorted(rows, key=lambda r: r.conv_id)[len(bad) :]] == [(7, "x"), (7, "x"), (7, "x"), (0, "x"), (7, "\ufffdx")]
    assert op04_chat.read_back(op04_chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href="/a">A</a></nav>
<div class="cookie-notice">We use cookies</div>%s<aside>More</aside><div id="comments"><p>Great read thanks a lot for it</p></div><form><input>Mail</form><footer>&copy; 2024</footer></body></html>"""


def test_html_main_text(spark):
    labelled = [(k, f"u{k}", PAGE % f"<article><h1>Head {k}</h1><p>Some <b>bold</b>words &amp; more of them here</p><script>x='</p>'</script><p>End</p></article>") for k in range(20)]
    other = [(100, "u", PAGE % "<div><h1>No article</h1><p>Plain words that stand in a plain block of text</p><p>End.</p></div>"), (101, None, None), (102, "u", ""), (103, "u", "just text &lt;b&gt;"), (104, "u", "<article><p>cut off <b>he"), (105, "u", "<p>a<br>b</p><!-- open"), (106, "u", "<p class=")]
    pages = spark.createDataFrame(labelled + other, "page_id long, url string, html string")
    got = {r.page_id: r for r in op05_html.extract(pages, op05_html.learn(pages)).collect()}
    assert got[3].text == "Head 3 Some boldwords & more of them here End"
    assert got[100].text == "No article Plain words that stand in a plain block of text End."
    assert [got[k].text for k in range(101, 107)] == ["", "", "just text <b>", "cut off he", "a b", ""]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_html_weights_are_learned(spark):
    """Headlines in headers, forms around pages, lists in articles, classes that pages use for content, no labels, clashing columns."""
    nav = "<nav><ul>" + "".join(f"<li><a href='/{k}'>menu entry {k}</a></li>" for k in range(40)) + "</ul></nav>"
    body = "<p>" + "plain words of the story " * 8 + "</p>"
    story = " ".join(["plain words of the story"] * 8)
    rows = [(k, f"<body>{nav}<div class='teaser-rail'>{'buy this now ' * 20}</div><article><header><h1>Head {k}</h1></header>{body}<div class='related-work'>as others found</div></article><footer>imprint</footer></body>") for k in range(30)]
    rows += [
        (100, f"<body><form action='/x'>{nav}<div class='entry-header'><h1>Title</h1></div>{body}<div class='teaser-rail'>{'buy this now ' * 20}</div></form></body>"),
        (101, f"<body>{nav}<article><ul>" + "".join(f"<li>point {k} of many</li>" for k in range(30)) + "</ul></article></body>"),
        (102, f"<body>{nav}<article>{body}<div class='teaser-rail'>buy</div>{body}</article></body>"),
    ]
    pages = spark.createDataFrame([(i, "u", h, "mine", 3) for i, h in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in op05_html.extract(pages, op05_html.learn(pages)).collect()}
    assert got[3].text == f"Head 3 {story} as others found" and (got[3].page_text, got[3].page_n_chars) == ("mine", 3)
    assert got[100].text == f"Title {story}"
    assert got[101].text == " ".join(f"point {k} of many" for k in range(30))
    assert got[102].text == f"{story} {story}"
    plain = pages.where("page_id = 100")
    assert op05_html.extract(plain, op05_html.learn(plain)).first().text.startswith(f"Title {story}")
    empty = spark.createDataFrame([], pages.schema)
    assert op05_html.extract(empty, op05_html.learn(empty)).count() == 0


def test_html_of_a_page_called_like_furniture_and_of_many_features(spark):
    own = "<div class='social'><h1>Social history</h1><p>" + "Villages and towns changed over the years. " * 9 + "</p></div><nav>Home</nav>"
    lone = spark.createDataFrame([(1, "u", own)], "page_id long, url string, html string")
    assert op05_html.extract(lone, op05_html.learn(lone)).first().text.startswith("Social history Villages")
    many = [(k, "u", f"<div class='box{k}'><p>outside words of page {k} stand here</p></div><article class='a{k}'><h1>Inside {k}</h1><p>{'some words of the story ' * 5}</p></article><div class='box{k % 700}'>more outside</div>") for k in range(700)]
    pages = spark.createDataFrame(many, "page_id long, url string, html string")
    weights = op05_html.learn(pages)
    assert sum(kind == "feature" for kind, _ in weights) > 600
    got = op05_html.extract(pages, weights).collect()
    assert all(r.text == f"Inside {r.page_id} " + " ".join(["some words of the story"] * 5) for r in got)


def test_html_scan_equals_all_runs():
    import random

    draw = random.Random(9)
    for _ in range(300):
        scores = [draw.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(draw.randint(0, 14))]
        low, high = op05_html.best_run(scores)
        assert sum(scores[low:high]) == max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1))])


def test_decontamination(spark):
    words = [f"w{k}" for k in range(40)]
    item = " ".join(words[:20])
    items = spark.createDataFrame([(1, item), (2, "Short One."), (3, None), (4, ""), (2, "short one")], "item_id long, text string")
    rows = [(1, "x " + ", ".join(words[:13]).upper() + "\ny", "en", "s"), (2, " ".join(words[:12]), "en", "s"), (3, "a short-one b", "en", "s"), (4, None, None, None), (5, "", "en", "s"), (6, "shorts one " * 3, "en", "s"), (7, "z " * 500 + "short one", "en", "s")]
    for size in (1 << 20, 60):  # one automaton, and many in turn
        marked = op07_decontaminate.mark(docs(spark, rows), items, window_bytes=size)
        got = {r.doc_id: r for r in op07_decontaminate._report(marked).collect()}
        assert [(got[k].n_words, got[k].n_hit, got[k].n_items, got[k].contaminated) for k in range(1, 8)] == [(15, 13, 1, True), (12, 0, 0, False), (4, 2, 1, True), (0, 0, 0, False), (0, 0, 0, False), (6, 0, 0, False), (502, 2, 1, False)]
        assert got[3].items_sha256 == hashlib.sha256(b"2").hexdigest() and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    kept = op07_decontaminate.decontaminate(docs(spark, rows), items)
    assert kept.columns == docs(spark, rows).columns and {r.doc_id for r in kept.collect()} == {2, 4, 5, 6, 7}
    full = {r.doc_id: r for r in op07_decontaminate.contamination(docs(spark, rows), items).collect()}
    assert [rows[2][1][s.start : s.stop] for s in full[3].spans] == ["short-one"]


def test_language_profiles(spark):
    rows = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * 5, "en" if k % 2 else "de", "s") for k in range(60)]
    rows += [(100, None, "en", "s"), (101, "123 !!", "en", "s"), (102, "", None, "s"), (103, "THE CAT", None, None)]
    df = docs(spark, rows)
    got = {r.doc_id: (r._lang, r._score) for r in op08_language.identify(df, op08_language.learn(df)).collect()}
    assert all(got[k][0] == ("en" if k % 2 else "de") and 0.5 < got[k][1] <= 1 for k in range(60))
    assert [got[k] for k in (100, 101, 102)] == [("und", 0.0)] * 3 and got[103][0] == "en"
    assert {r._lang for r in op08_language.identify(df, {}).collect()} == {"und"}
    kept = op08_language.keep_identified(df.withColumn("_lang", op08_language.F.lit("mine")))
    assert kept.count() == 61 and {r._lang for r in kept.collect()} == {"mine"}
    assert op08_language.learn(docs(spark, [])) == {}


def test_language_held_out_accuracy(spark):
    got = op08_language.op8_language(spark, "/root/testdata/sf0.01").toPandas()
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(lang, on="doc_id")
    assert set(both.held_out) == {bool(h) for h in both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)}
    own = both[both.held_out]
    assert (own.lang == own.lang_pred).mean() > 0.98


def test_patience_and_line_dedup(spark):
    assert op09_lines.patience(list("abcdef"), list("axbcyf")) == [(0, 0), (1, 2), (2, 3), (5, 5)]
    text = "one\ntwo\nthree\nfour"
    rows = [(1, text, "en", "s"), (2, "zero\ntwo\nthree\nnine", "en", "s"), (3, text, "en", "s"), (4, None, None, None), (5, "", "en", "s"), (6, "\n\n", "en", "s"), (6, "four", "en", "s"), (1, "four\nown", "en", "s"), (None, "one\nmine", "en", "s")]
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_lines, r.n_removed, r.text) for r in op09_lines.dedup_lines(docs(spark, rows)).collect())
    assert got == [(1, 2, 0, "four\nown"), (1, 4, 0, text), (2, 4, 2, "zero\nnine"), (3, 4, 4, ""), (4, 0, 0, ""), (5, 0, 0, ""), (6, 1, 1, ""), (6, 3, 0, "\n\n"), (99, 2, 1, "mine")]


@pytest.mark.parametrize("fan", [2000, 20])
def test_line_dedup_of_lines_that_many_hold(spark, fan):
    """A line goes from all later holders, however many there are, and so do all aligned blocks of a pair."""
    rows = [(k, f"own {k}\nin all\n\nin all too\nown {k} too" + ("\nof two" if k in (3, 9) else ""), "en", "s") for k in range(150)]
    got = {r.doc_id: (r.n_removed, r.text) for r in op09_lines.dedup_lines(docs(spark, rows), fan=fan).collect()}
    assert got == {k: (0, rows[0][1]) if k == 0 else (4, f"own {k}\nown {k} too") if k == 9 else (3, f"own {k}\nown {k} too" + ("\nof two" if k == 3 else "")) for k in range(150)}


def line_results(rows, df, **how):
    """n_lines, the lines deleted somewhere, and those kept, without blank ones."""
    out = {}
    for r in op09_lines.dedup_lines(df, **how).collect():
        kept, own = [x for x in r.text.split("\n") if x.strip()], [x for x in dict(rows)[r.doc_id].split("\n") if x.strip()]
        out[r.doc_id] = (r.n_lines, {x for x in own if kept.count(x) < own.count(x)}, kept)
    return out


def lines_by_hand(rows):
    """Every pair of documents that share a line is aligned. Blank lines are left out: they go with the block of a pair that was aligned."""
    texts = [(i, [x.strip() and x for x in t.split("\n")]) for i, t in rows]
    out = {}
    for j, (i, later) in enumerate(texts):
        gone = set()
        for k, (e, first) in enumerate(texts[:j]):
            if any(x and x in first for x in later):
                pairs = op09_lines.patience(first, later)
                assert all(first[a] == later[b] for a, b in pairs) and pairs == sorted(pairs) and len({a for a, _ in pairs}) == len(pairs)
                if len(set(first)) == len(first) and len(set(later)) == len(later):  # then the longest common subsequence is the longest rising run
                    rising = [first.index(x) for x in later if x in first]
                    best = [1] * len(rising)
                    for n in range(len(rising)):
                        best[n] += max([best[q] for q in range(n) if rising[q] < rising[n]], default=0)
                    assert len(pairs) == max(best, default=0)
                block = []
                for a, b in [*pairs, (-9, -9)]:
                    if not block or (a, b) != (block[-1][0] + 1, block[-1][1] + 1):
                        gone |= {q for _, q in block} if any(later[q] for _, q in block) else set()
                        block = []
                    if a >= 0:
                        block.append((a, b))
        out[i] = (len(later), {x for k, x in enumerate(later) if x and k in gone}, [x for k, x in enumerate(later) if x and k not in gone])
    return out


def test_line_dedup_equals_all_pairs(spark):
    import random

    draw = random.Random(12)
    pool = [f"line {k}" for k in range(60)] + ["", " "]
    rows = [(k, f"own {k}\n" + "\n".join(draw.choices(pool, k=draw.randint(1, 12))) + (f"\n{chr(10).join(pool[5:9])}" if k % 3 == 0 else "")) for k in range(80)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lines string")
    for rare in (16, 3):
        got, want = line_results(rows, df, fan=5, rare=rare), lines_by_hand(rows)
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
        assert all(set(want[k][2]) <= set(got[k][2]) for k in want)
        lone = [k for k, t in rows if len({x for x in t.split("\n") if x.strip()}) == sum(bool(x.strip()) for x in t.split("\n"))]
        assert len(lone) > 20 and all(got[k] == want[k] for k in lone)
    assert op09_lines.dedup_lines(spark.createDataFrame([], df.schema)).count() == 0


def test_line_dedup_of_blocks_in_another_order(spark):
    """A block that two later documents share goes, though its lines' first holder has them in another order; and so in shuffled copies."""
    import random

    draw = random.Random(3)
    falling, rising = [f"l{k}" for k in range(5, -1, -1)], [f"l{k}" for k in range(6)]
    rows = [(1, "\n".join(falling)), (2, "\n".join(rising)), (3, "\n".join(rising) + "\nown"), (4, "a\nb"), (5, "b\na"), (6, "b\na\nx")]
    rows += [(10 + k, "\n".join(draw.sample([f"s{n}" for n in range(9)], 9))) for k in range(14)]
    got = line_results(rows, spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == lines_by_hand(rows) and got[3][2] == ["own"] and got[6][2] == ["x"]


def test_line_dedup_of_a_long_text(spark):
    long = "\n".join(f"line {k}" for k in range(60_000))
    rows = [(1, long), (2, "first\n" + long + "\nlast")]
    assert {r.doc_id: r.text for r in op09_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: long, 2: "first\nlast"}


def test_language_equals_out_of_place_distance(spark):
    """The judge against the distance as it is written down: ranks of a document's n-grams against each profile's."""
    import random
    from collections import Counter

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        padded = " " + " ".join(words) + " " if words else ""
        found = Counter(c for c in padded if c != " ")
        for n in (2, 3):
            found.update(padded[k : k + n] for k in range(len(padded) - n + 1))
        code = lambda g: sum((0 if c == " " else ord(c)) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
        return [g for g, _ in sorted(((code(g), n) for g, n in found.items()), key=lambda x: (-x[1], x[0]))]

    draw = random.Random(4)
    speak = {la: lambda la=la: " ".join("".join(draw.choice(la) for _ in range(draw.randint(1, 7))) for _ in range(draw.randint(3, 60))) for la in ("abcdeé", "abxyzß", "nmopqы")}
    texts = [(la, speak[la]()) for la in speak for _ in range(25)]
    df = docs(spark, [(k, t, la, "s") for k, (la, t) in enumerate(texts)])
    profiles = op08_language.learn(df, profile=80)
    for la in speak:
        total = Counter()
        for own, t in texts:
            if own == la:
                total.update(dict(zip(*(x.tolist() for x in op08_language.ngrams(t)), strict=True)))
        assert profiles[la] == [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:80]]
    judge = op08_language.Judge(profiles, 80)
    for _, t in texts:
        own = grams(t)[:80]
        cost = {la: sum(abs(p.index(g) - k) if g in p else 80 for k, g in enumerate(own)) / len(own) for la, p in profiles.items()}
        assert judge(t)[0] == min(sorted(cost), key=cost.get)


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    packed = op10_tokens.pack(ids, bits)
    assert len(packed) == -(-1000 * bits // 8)
    assert (op10_tokens.unpack(packed, bits, 1000) == ids).all() and (op10_tokens.unpack(packed, bits, 37, 501) == ids[501:538]).all()


def test_token_files_round_trip(spark, tmp_path):
    rows = [(k, t, "en", "s") for k, t in [(9, "Hello  world \n next"), (2, None), (2, "two"), (5, ""), (None, "none"), (7, " a <|endoftext|> b\n\n"), (1, "ß中 " * 50)]]
    path, vocabulary = (tmp_path / "t").as_uri(), op10_tokens.public_vocabulary()
    op10_tokens.write_token_files(docs(spark, rows), path, block_ids=20, parts=3)
    library = op10_tokens.encoder(vocabulary).library
    want = sorted(((i if i is not None else -1, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, _, _ in rows), key=lambda x: (x[0], zlib.crc32(np.array(x[1], "<u4").tobytes())))
    got = op10_tokens.read_documents(spark, path).orderBy("start").collect()
    assert [(r.doc_id if r.doc_id is not None else -1, r.ids) for r in got] == want
    flat = [x for _, ids in want for x in ids]
    assert op10_tokens.read_range(spark, path, 3, 60) == flat[3:60]
    sums = op10_tokens.checksums(spark, path).orderBy("start").collect()
    assert [r.ids_crc32 for r in sums] == [zlib.crc32(np.array(ids, "<u4").tobytes()) for _, ids in want]
    op10_tokens.write_token_files(docs(spark, []), (tmp_path / "e").as_uri())
    assert op10_tokens.checksums(spark, (tmp_path / "e").as_uri()).count() == 0


def test_encoder_equals_library():
    import random

    own, draw = op10_tokens.Encoder(op10_tokens.public_vocabulary(), kept=2000), random.Random(5)
    alphabet = [*"ab .,'\n\t0é_|ß中", " ", "\u0085", "\x1c", "<|endoftext|>", "'s", " the", "'ll", "\u0301", "\r", "я", "½", "\xa0", "😀"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(6000)]
    texts += [f"a{c}a{c}{c} {c}b 1{c} '{c} {c}'s{c}\n{c}'" for c in map(chr, range(0x600))]
    texts += ["word's end 12 " * 250_000, "x" * 3_000_000, None, ""]
    for text, ids, found in zip(texts, own.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False), own.encode(op10_tokens.pa.array(texts)), strict=True):
        assert np.array_equal(ids.ids, found), (text or "")[:60]


def test_words_of_one_piece_go_to_the_model():
    """Only digits and contractions need the pre-tokenizer; words of every size around SHORT, also when met again, keep their ids."""
    import random

    own, draw, sent = op10_tokens.Encoder(op10_tokens.public_vocabulary(), kept=3000), random.Random(8), []
    ids_of = own._ids
    own._ids = lambda texts: sent.extend(texts) or ids_of(texts)
    words = ["".join(draw.choice("th er on re qu x \u00df \u044f".split()) for _ in range(draw.randint(1, 12))) for _ in range(6000)]
    words += ["a" * k for k in range(1, 40)] + ["~" * k for k in range(1, 20)]
    texts = [" ".join(draw.choice(words) for _ in range(40)) + draw.choice(["", ".", "\n\n", "  "]) for _ in range(20_000)]
    want = own.library.encode_batch_fast(texts, add_special_tokens=False)
    assert all(np.array_equal(w.ids, g) for w, g in zip(want, own.encode(op10_tokens.pa.array(texts)), strict=True))
    assert not sent
    assert own.count <= 3000 + len(words) * 2
    mixed = "it's 12 x"
    assert next(own.encode(op10_tokens.pa.array([mixed]))).tolist() == own.library.encode(mixed, add_special_tokens=False).ids and sent
    own.forget()
    assert sum(x.nbytes for x in vars(own).values() if isinstance(x, np.ndarray)) < 1 << 20


def test_an_id_of_many_rows_is_dealt_over_parts(spark, tmp_path):
    rows = [(5, f"text {k}", "en", "s") for k in range(400)] + [(k, "other", "en", "s") for k in range(200)]
    path = (tmp_path / "hot").as_uri()
    op10_tokens.write_token_files(docs(spark, rows), path, parts=12, block_ids=50)
    sizes = {r.part: r["count"] for r in spark.read.parquet(path).selectExpr("part", "explode(doc_ids) d").groupBy("part").count().collect()}
    assert max(sizes.values()) < 150
    got = op10_tokens.checksums(spark, path).orderBy("start").collect()
    assert len(got) == 600 and [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got[:-1], got[1:], strict=True))


def test_decontamination_by_one_benchmark_after_another(spark):
    """A worker that serves several benchmarks in turn scans each with its own windows."""
    one = docs(spark, [(k, f"alpha{k} beta{k}", "en", "s") for k in range(12)]).coalesce(1)
    for k in range(12):
        items = spark.createDataFrame([(k, f"alpha{k} beta{k}")], "item_id long, text string")
        got = op07_decontaminate._report(op07_decontaminate.mark(one, items)).collect()
        assert {r.doc_id for r in got if r.contaminated} == {k}
