"""The training-data operators against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import ann, bpe, cover_tree, html_extract, lm_scoring, mixing, quality, secrets, sentence_spans, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, k string"
rng = random.Random(5)
SYLLABLES = "th er on an in re nd ti es or".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 9 == 0 else w for i, w in enumerate(words))


def documents(spark, rows):
    """Rows (doc_id, text, source); other columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", None) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "b"), (3, "  \n\t ", None), (None, prose(40, 1), "a"), (5, prose(300, 2), "c"), (5, prose(300, 2), "c"), (6, prose(300, 2) + " thth", "b"), (7, "x" * 50_000, "a"), (8, prose(5000, 3), "b"), (9, "Password: hunter22 é中\U0001f600", None), (10, "one", "a"), (11, "one two", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


def rows(df):
    return df.collect()


# ---- 1: language-model scores


def test_scores_cover_every_token_and_base_matches(spark, odd):
    found = rows(lm_scoring.score(odd, spark, heads=64, least=100, batch=8, frequent=20))
    assert len(found) == len(ODD)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in ODD}
    words = lambda t: (t or "").encode().lower().split() + [None]
    counts = Counter(w for i, t, _ in ODD if not held[i] for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words(t)), 6)) for i, t, _ in ODD)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == want
    assert all(r.train_tokens == total and r.score < 0 and r.held_out == held[r.doc_id] for r in found)


def test_probabilities_sum_to_one():
    model = lm_scoring.Model(np.array([5, 3, 9, 0, 2, 1, 1]), 4, heads=4)
    model.ready()
    first = [np.array([s], np.int32) for s in range(3, 4 + len(model.of) - 4)]
    # All ways to go on after the begin: an end, or one symbol (whose own end is not part of the sum).
    h = model._hidden(np.array([[0] * 16, [1] + [0] * 15], np.int32))[0, 0]
    logs = model._picked(np.repeat(np.append(h, np.float32(1))[None], len(first) + 1, 0), np.array([2, *[f[0] for f in first]]))
    assert abs(np.exp(logs).sum() - 1) < 1e-4
    assert abs(np.exp(model.rare[model.symbol == 3]).sum() - 1) < 1e-9


def test_gradient_matches_differences():
    model = lm_scoring.Model(np.arange(12), 3, heads=6)
    x, y, _ = model.windows([np.array([4, 5, 6, 3, 4, 7] * 6, np.int32)])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, g = model.gradient(x, y)
    for name, at in (("q", (4, 1)), ("k", (5, 2)), ("v", (4, 3)), ("one", (6, 0)), ("two", (5, 1)), ("far", (2,)), ("bias", (3,)), ("c", (0, 1)), ("d", (0, 1, 2)), ("db", (0, 1))):
        keep = model.p[name][at]
        sides = []
        for step in (1e-5, -1e-5):
            model.p[name][at] = keep + step
            sides.append(model.gradient(x, y)[0])
        model.p[name][at] = keep
        assert abs((sides[0] - sides[1]) / 2e-5 - g[name][at]) < 1e-5, name


def test_scoring_equals_the_training_path():
    r = np.random.default_rng(7)
    model = lm_scoring.Model(r.integers(0, 50, 300), 9, heads=128)
    model.p = {k: v + r.normal(0, 0.3, v.shape).astype(np.float32) for k, v in model.p.items()}
    symbols = [r.integers(3, 131, n).astype(np.int32) for n in (0, 1, 15, 16, 17, 200)]
    fast = model.ready().log_probs(symbols)
    for k, one in enumerate(symbols):
        x, y, _ = model.windows([one])
        assert abs(fast[k] + model.gradient(x, y)[0] * (len(one) + 1)) < 1e-3


def test_runs_hold_the_same_windows_and_gradient():
    r = np.random.default_rng(3)
    model = lm_scoring.Model(r.integers(1, 50, 200), 9, heads=100)
    model.p = {k: v.astype(np.float64) + r.normal(0, 0.3, v.shape) for k, v in model.p.items()}
    symbols = [r.integers(3, 103, n).astype(np.int32) for n in (0, 1, 15, 16, 17, 200, 31, 0, 500)]
    x, y, _ = model.windows(symbols)
    ins, outs = model.runs(symbols)
    step = lm_scoring.STEP
    parts = [(a[at : at + 2 * step], b[at : at + step]) for a, b in zip(ins, outs) for at in range(0, len(b), step) if b[at : at + step].any()]
    assert np.array_equal([a for a, _ in parts], x) and np.array_equal([b for _, b in parts], y)
    for scale in (1, 40):  # the second beyond what exp takes in single precision
        model.p["q"] = model.p["q"] * scale
        (one, want), (two, found) = model.gradient(x, y), model.gradient(ins, outs)
        assert abs(one - two) < 1e-9 and all(np.abs(want[k] - found[k]).max() < 1e-9 for k in want)
        assert all(np.abs(v - found[k]).max() < 1e-9 for k, v in model.gradient(ins, outs, False)[1].items())


def test_gradients_are_added_up_by_symbol():
    r = np.random.default_rng(4)
    index, grads = r.integers(0, 37, (9, 20)) ** 2 % 50, r.normal(0, 1, (9, 20, 5))
    want = np.zeros((51, 5))
    np.add.at(want, index.ravel(), grads.reshape(-1, 5))
    assert np.abs(lm_scoring._scattered(index, 51, grads) - want).max() < 1e-12


def test_training_reads_every_training_document(spark, monkeypatch):
    # With dense windows, what the trainers see is every block of every training document.
    data = [(i, prose(5 + 13 * i, 600 + i), "a") for i in range(40)] + [(None, prose(30, 9), "a"), (3, None, "a")]
    df = documents(spark, data)
    with open(__import__("public_tokenizers").path(lm_scoring.VOCABULARY), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    learn = df.filter(~lm_scoring.held_out())
    counts = lm_scoring.word_counts(learn.select("doc_id", "text"))
    ids = lm_scoring.id_counts(counts, ranks, lm_scoring.speller(ranks.value).size)
    model = lm_scoring.Model(ids, learn.count(), 64)
    corpus = lm_scoring.Corpus(counts, learn.count(), 50)
    found = lm_scoring.spelled(df, spark.sparkContext.broadcast((model, corpus)), ranks, 3)
    train = [r for r in rows(found) if r["round"] >= 0]
    assert len(train) == learn.count() and {r["round"] for r in train} == {0, 1, 2}
    assert sum(len(r.symbols) // 2 for r in train) == ids.sum()


def test_scoring_beats_the_base_where_order_tells(spark):
    # Words follow one another in one fixed round: context tells the next one, counts of words do not.
    r = random.Random(9)
    ring = ["".join(r.choice(SYLLABLES) for _ in range(2)) + str(i) for i in range(60)]
    df = documents(spark, [(i, " ".join(ring[(i * 7 + k) % 60] for k in range(80)), "a") for i in range(120)])
    found = rows(lm_scoring.score(df, spark, heads=256, least=8000, batch=32))
    held = [r for r in found if r.held_out]
    assert held and sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)


def test_every_window_is_learnt_from(spark):
    docs = [(i, prose(30 + 7 * (i % 40), 5000 + i), "a") for i in range(120)]
    df = documents(spark, docs)
    with open(__import__("public_tokenizers").path(lm_scoring.VOCABULARY), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    learn = df.filter(~lm_scoring.held_out())
    counts = lm_scoring.word_counts(learn)
    ids = lm_scoring.id_counts(counts, ranks, lm_scoring.speller(ranks.value).size)
    model = lm_scoring.Model(ids, learn.count(), 64)
    found = lm_scoring.spelled(df, spark.sparkContext.broadcast((model, lm_scoring.Corpus(counts, learn.count(), 50))), ranks, 3).persist()
    want = sum(-(-(len(r.symbols) // 2 + 1) // lm_scoring.STEP) for r in rows(found) if r["round"] >= 0)
    # Far more windows than the least number: before, every eighth of them was looked at.
    assert lm_scoring.learnt(found, model, want, least=want // 20, rounds=3, batch=32).learnt_from == want


def test_empty_table_has_no_scores(spark):
    empty = documents(spark, [])
    assert rows(lm_scoring.score(empty, spark)) == []


# ---- 2: mixing


def test_mix_meets_targets(spark):
    data = [(i, " ".join(["w"] * rng.randrange(0, 400)), rng.choice(["a", "b", "c", None, "é"])) for i in range(200)] + [(200, "w " * 5, "tiny"), (201, None, "a"), (201, None, "a")]
    found = rows(mixing.mix(documents(spark, data), spark, block=16, shards=4))
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(names, mixing.targets([sizes[n] for n in names]), strict=True))
    source = {i: s for i, _, s in data}
    taken = Counter()
    for r in found:
        taken[source[r.doc_id]] += r.taken
        assert r.taken <= 3 * r["size"] and r.source_size == sizes[source[r.doc_id]] and r.target == want[source[r.doc_id]]
    assert len(found) == len(data)
    for n in names:
        assert abs(taken[n] - want[n]) <= 1
    again = rows(mixing.mix(documents(spark, data), spark, block=16, shards=4))
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mixed_documents_hold_the_words_taken(spark, odd):
    taken = Counter()
    for r in rows(mixing.mix(odd, spark, block=16, shards=3)):
        taken[r.doc_id] += r.taken
    out = mixing.mixed_documents(odd, spark, block=16, shards=3)
    assert out.columns == odd.columns
    words = Counter()
    for r in rows(out):
        words[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_permutations_are_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))
        assert (mixing.unpermuted(mixing.permuted(np.arange(n), n, 3), n, 3) == np.arange(n)).all()


def test_mix_equals_a_plain_walk(spark):
    # Every slot of the plan in turn, word by word, over sources laid out one row after another.
    data = [(i, " ".join(f"{i}.{w}" for w in range(rng.randrange(0, 90))), rng.choice(["a", "b", None])) for i in range(120)] + [(None, "x y z", "a")] * 9 + [(7, "q " * 40, "b")] * 30
    df = documents(spark, data)
    for sizes in ({"per_bucket": 16, "group": 3}, {}):
        placed, laid = rows(mixing.placed(mixing.sized(df), **sizes)), {}
        for r in sorted(placed, key=lambda r: (r.at, r["size"])):
            assert r.at == len(laid.setdefault(r.source, [])), "rows stand end to end"
            laid[r.source] += [r.row] * r["size"]
    names, made = mixing.plan(mixing.sized(df), 16, 3)
    taken, seen = Counter(), Counter()
    for k, name in enumerate(names):
        for n in range(made.slots[k]):
            block = int(mixing.permuted(np.array([n % made.blocks[k]]), made.blocks[k], made.seed + k)[0])
            words = laid[name][16 * block : 16 * block + 16]
            if n == made.slots[k] - 1:
                words = words[: len(words) - made.cut[k]]
            taken.update(words)
    by_row = {r.row: r.doc_id for r in placed}
    want = sorted((str(by_row[i]), taken[i]) for i in by_row)
    assert sorted((str(r.doc_id), r.taken) for r in rows(mixing.mix(df, spark, block=16, shards=3))) == want
    for r in rows(mixing.slots(spark, made)):
        seen[r.shard, r.k] += 1
        assert r["pass"] < 3 and 0 <= r.block < made.blocks[r.k]
    assert all(seen[s, k] == made.shards[s, k] for s in range(3) for k in range(len(names)))
    again = rows(mixing.mix(df.repartition(3, "text"), spark, block=16, shards=3))
    assert sorted((str(r.doc_id), r.taken) for r in again) == want


def test_empty_mix(spark):
    assert rows(mixing.mix(documents(spark, []), spark)) == [] and rows(mixing.mixed_documents(documents(spark, []), spark)) == []
    assert [r.taken for r in rows(mixing.mix(documents(spark, [(1, None, None)]), spark))] == [0]


# ---- 3: HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div><!-- x --><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p><b>One<br>two&nbsp;three<p>Four</p><div class="comments"><p>First!</p></div><aside>More</aside></article>
<form><p>Name</p></form><footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_page(spark):
    bare = "<body><div>Site menu</div><div>{}</div><div>Imprint</div>"
    pages = [(1, "http://h.org/a/1", PAGE), (2, "http://h.org/a/2", None), (3, "http://g.org/x/1", bare.format("Text one")), (4, "http://g.org/x/2", bare.format("Text  two")), (5, None, ""), (6, "::bad[", "<p>x"), (3, "http://g.org/x/1", bare.format("Text one"))]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, path string")
    found = {r.page_id: r for r in rows(html_extract.extract(df, spark))}
    assert {i: r.text for i, r in found.items()} == {1: "A & B One two three Four", 2: "", 3: "Text one", 4: "Text two", 5: "", 6: "x"}
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert html_extract.extract(df, spark).count() == len(pages)
    assert rows(html_extract.extract(df.limit(0), spark)) == []


def test_marks_are_whole_names():
    for page in ('<div class="layout has-sidebar"><article>Text</article></div>', '<div class="content no-sidebar"><article>Text</article></div>', '<article class="post category-social">Text</article>', '<article class="entry comments-open">Text</article>', '<div class="overlay"><article class="widget">Text</article></div>', '<form><main>Text</main></form>'):
        assert html_extract.main_text(f"<body>{page}<footer>us</footer></body>", [])[0] == "Text", page
    for name in ("ad", "cookie-notice", "site-footer", "main-nav", "sidebar_left", "x share-bar"):
        assert html_extract.main_text(f'<article>Text<div class="{name}">no</div></article>', [])[0] == "Text", name
    assert html_extract.main_text('<main>Text<div id="comments"><article>First!</article></div></main>', [])[0] == "Text"
    assert html_extract.main_text('<p>A longer text</p><aside><article>Teaser</article></aside>', [])[0] == "A longer text"


def test_attributes_are_read_as_html_does():
    for tag in ("<p data-x=don't>", '<p title="a > b">', "<p data-class='ad' data-y=\"class='ad'\">", '<p " broken>', "<p a=1/b c='>'  d>"):
        assert html_extract.main_text(f"<article>{tag}Text</p></article><footer>us</footer>", [])[0] == "Text", tag


def test_differencing_decides_and_structure_breaks_ties(spark):
    frame = "<div>Site menu</div><div>Log in here</div>{}<div>Imprint of the site</div>"
    pages = [(i, f"http://h.org/p/{i}", frame.format(f"<div>Lead number {i}</div><article>Text number {i} is the longest block of all here<p>CC BY 4.0</p></article>")) for i in range(4)]
    pages += [(10 + i, f"http://g.org/p/{i}", frame.format(f"<div>The body of page {i} without any mark</div><article>Teaser {i}</article>")) for i in range(3)]
    pages += [(20 + i, f"http://m.org/p/{i}", "<div>A mirrored text of some length</div>") for i in range(2)]
    found = {r.page_id: r for r in rows(html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), spark))}
    for i in range(4):  # the licence line is shared, but stands in the article; the frame has no marks, and goes
        assert found[i].text == f"Text number {i} is the longest block of all here CC BY 4.0" and found[i].n_shared == 3
        assert "Site menu" in html_extract.main_text(pages[i][2].replace("article", "section"), [])[0]
    for i in range(3):
        assert found[10 + i].text == f"The body of page {i} without any mark Teaser {i}"
    assert found[20].text == found[21].text == "A mirrored text of some length"


def test_pages_meet_the_nearest_of_their_host(spark):
    r = random.Random(4)
    pages = [(i, f"http://h{r.randrange(3)}.org/{r.choice('abc')}/{r.randrange(30)}" if r.random() < 0.9 else None, f"<p>line {r.randrange(9)}</p><p>own {i}</p>") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("row", F.xxhash64("page_id", "url", "html"))
    line = {x: html_extract.line_hashes([(f"line {x}", 1)])[0] for x in range(9)}
    order = sorted((*html_extract.place(r.url), r.row, r.page_id, r.html) for r in rows(df))
    want = {}
    for k, (host, _, _, i, _) in enumerate(order):
        near = [order[j] for d in (1, 2) for j in (k - d, k + d) if 0 <= j < len(order) and order[j][0] == host]
        want[i] = sorted(line[int(html[8])] for *_, html in near)
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = {r.page_id: sorted(o[0] for o in r.others) for r in rows(html_extract.neighbours(df, spark))}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert found == want


def test_common_lines_are_longest():
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = html_extract.common_lines(a, b)
        assert len(found) == table[-1][-1]
        at = 0
        for i in sorted(found):  # a subsequence of both
            at = b.index(a[i], at) + 1


# ---- 4 and 6: vectors


def vectors(spark):
    r = np.random.default_rng(1)
    data = [(i, r.normal(0, 1, 8).tolist()) for i in range(400)]
    data += [(500 + i, data[50][1]) for i in range(30)]  # many copies of a query
    data += [(50, data[50][1]), (600, None), (650, [1.0, None] * 4), (700, [math.nan] * 8), (None, data[0][1]), (750, []), (800, [0.0] * 8), (850, [1.0, 2.0]), (851, [3.0, 1.0]), (900, [math.inf] + [0.0] * 7)]
    return spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<double>, block string, width int"), data


def brute(data, of):
    """By (query's place): each row is a candidate of every other row of its length."""
    fine = [(k, i, v) for k, (i, v) in enumerate(data) if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, q, v in fine:
        if q % 50 == 0:
            scores = [(-s, i) for m, i, w in fine if m != k and len(w) == len(v) and (s := of(v, w)) is not None]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])]
    return sorted(out)


def test_top_k_is_exact(spark):
    df, data = vectors(spark)
    whole = lambda v: [math.floor(256 * x) for x in v]
    want = brute(data, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b), strict=True)))
    for part_bytes in (64 << 20, 4096):
        found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows(cover_tree.top_k(df, spark, query_block=4, part_bytes=part_bytes)))
        assert found == want
    assert rows(cover_tree.top_k(df.limit(0), spark)) == []


def test_top_k_agrees_with_its_sql(spark):
    import duckdb

    df, data = vectors(spark)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [(i, v) for i, v in data])
    want = sorted(con.execute(cover_tree.ORACLE).fetchall())
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows(cover_tree.top_k(df, spark))) == want


def test_top_k_scores_are_exact_beyond_doubles(spark):
    data = [(0, [1e6, 1.0]), (1, [1e6, 1.0]), (2, [1e6, 1.0 + 1 / 256]), (3, [1e6, 1.0]), (50, [2.0**40, 3.0]), (51, [2.0**41, 5.0])]
    whole = lambda v: [math.floor(256 * x) for x in v]
    top = (1 << 63) - 1
    want = brute(data, lambda a, b: max(-top, min(top, sum(x * y for x, y in zip(whole(a), whole(b), strict=True)))))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows(cover_tree.top_k(df, spark))) == want
    a = np.random.default_rng(3).integers(-(1 << 29), 1 << 29, (9, 4)).astype(float)
    assert (cover_tree.products(a, a) == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in a] for p in a]).all()


def test_pruning_skips_pairs():
    r = np.random.default_rng(2)
    centres = r.normal(0, 2000, (12, 8))
    points = np.floor(np.repeat(centres, 100, 0) + r.normal(0, 5, (1200, 8)))
    data, queries = cover_tree.Tree(np.arange(1200), np.arange(1200), points), cover_tree.Tree(np.arange(40), np.arange(40), points[:40])
    best = cover_tree.Best(40, 5)
    leaves = sum(x is not None for x in data.rows) * sum(x is not None for x in queries.rows)
    assert cover_tree.search(queries, data, best) < leaves / 2
    scores = points[:40] @ points.T
    scores[np.arange(40), np.arange(40)] = -np.inf
    assert (best.scores == -np.sort(-scores, axis=1)[:, :5]).all()


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    size = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return None if size == 0 else float((a * b).sum() / size)


def test_nearest_reaches_its_recall(spark):
    df, data = vectors(spark)
    want = brute(data, cosine)
    for part_bytes in (64 << 20, 4096):
        found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows(ann.nearest(df, spark, rerank=10, part_bytes=part_bytes)))
        assert [f[:2] for f in found] == [w[:2] for w in want]
        assert all(abs(f[3] - w[3]) < 1e-12 for f, w in zip(found, want, strict=True))
    assert rows(ann.nearest(df.limit(0), spark)) == []


def test_nearest_in_a_tight_group(spark):
    # A third of all rows differ by less than codes tell apart; their neighbours are found all the same.
    r = np.random.default_rng(6)
    middle = r.normal(0, 1, 16)
    data = [(i, (middle + r.normal(0, 0.02, 16) if i % 3 == 0 else r.normal(0, 1, 16)).tolist()) for i in range(1500)]
    want = brute(data, cosine)
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows(ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), spark, rerank=20)))
    assert [f[:3] for f in found] == [w[:3] for w in want]


# ---- 5: near-duplicates


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, odd):
    data = [(i, t) for i, t, _ in ODD]
    found = rows(simhash.near_duplicates(odd, spark))
    assert sorted((str(r.doc_id), r.fp % (1 << 64)) for r in found) == sorted((str(i), slow_fingerprint(t)) for i, t in data)
    zero = [r for r in found if r.fp == 0]
    assert {r.doc_id for r in zero} == {1, 2, 3} and {r.component_id for r in zero} == {1}
    kept = rows(simhash.one_of_each(odd, spark))
    assert sum(r.doc_id == 5 for r in kept) == 1 and len(kept[0]) == len(odd.columns)


def test_links_are_all_pairs_within_three_bits(spark):
    r = random.Random(3)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 30)):
            x ^= sum(1 << b for b in r.sample(range(64), r.randrange(0, 5)))
            fps.add(x)
    fps = sorted(fps)
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= 3:
                a, b = sorted((root(x), root(y)))
                up[b] = a
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for most in (16_384, 8):
        links = simhash.near_links(df, most=most)
        found = {r.node: r.root for r in rows(simhash.components(links, spark, "t"))}
        groups, want = {}, {}
        for x in fps:
            groups.setdefault(found.get(signed(x), signed(x)), set()).add(x)
            want.setdefault(root(x), set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_copies_at_five_word_similarity_go(spark):
    r, sets, data = random.Random(8), {}, []
    for k in range(25):
        words = prose(300, 2000 + k).lower().split()
        for copy in range(4):  # 0 to 9 words changed: similarities on both sides of 0.8
            changed = list(words)
            for at in r.sample(range(300), 3 * copy):
                changed[at] = f"w{r.random()}"
            data.append((4 * k + copy, " ".join(changed), "a"))
    for i, t, _ in data:
        w = t.split()
        sets[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)}
    up = {i: i for i in sets}
    for i in sorted(sets):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = {x: a if y == b else y for x, y in up.items()}
    want = set(up.values())
    assert 30 < len(want) < 90
    assert {r.doc_id for r in rows(simhash.one_of_each(documents(spark, data), spark))} == want


def test_the_pipelines_copies_go_by_simhash_too(spark):
    # A repeated line decides both fingerprints, while their sets of shingles have little in common.
    line = "alpha beta gamma delta epsilon zeta eta " * 300
    data = [(4, line + prose(40, 3200), "a"), (2, line + prose(40, 3201), "a"), (9, prose(300, 3202), "a")]
    one, two = (set(simhash.shingles(t.encode(), 5).tolist()) for _, t, _ in data[:2])
    assert len(one & two) < 0.3 * len(one | two)
    assert (simhash.fingerprint(data[0][1].encode(), 5) ^ simhash.fingerprint(data[1][1].encode(), 5)) % (1 << 64) in {0} | {1 << b for b in range(64)}
    assert sorted(r.doc_id for r in rows(simhash.one_of_each(documents(spark, data), spark))) == [2, 9]


def test_rows_without_an_id_are_texts_of_their_own(spark):
    data = [(None, prose(60, 3000 + i), "a") for i in range(8)] + [(None, prose(60, 3000), "b"), (4, prose(60, 3001), "a"), (7, prose(60, 3100), "a"), (7, prose(60, 3101), "a"), (7, prose(60, 3101), "a")]
    kept = rows(simhash.one_of_each(documents(spark, data), spark))
    assert sorted(r.text for r in kept) == sorted({t for _, t, _ in data})
    assert [r.doc_id for r in kept if r.text == prose(60, 3001)] == [4]


# ---- 7: BPE


def test_encoding_equals_the_library(spark, odd):
    import tokenizers

    path = bpe.vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = bpe.Tokenizer(f.read())
    letters = "aabcdehinorstuw  \n'.,!09<|>éÉİΣσ中́\U0001f600\x1c\x85²ª"
    cases = [t or "" for _, t, _ in ODD] + ["<|endoftext|>", "a<|startoftext|>B c", "'S don't I'LL", "ΑΣ", "hahahahaha" * 9, "-" * 40]
    cases += ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(500)] + ["".join(rng.choice("aehlnorst") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    for text in cases:
        want = library.encode(text, add_special_tokens=False).ids
        ids, decoded = own.encode(text)
        assert ids == " ".join(map(str, want)), text
        assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(want)
    found = rows(bpe.encode(odd, with_ids=True))
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in ODD]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids) for r in found) == sorted((str(i), len(w), w) for (i, _, _), w in zip(ODD, want, strict=True))
    assert {r.ids_sha256 for r in found} == {hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest() for w in want}


def test_every_prefix_has_one_last_token():
    with open(bpe.vocabulary(), encoding="utf-8") as f:
        auto = bpe.Tokenizer(f.read()).automaton
    for k in range(400):
        word = "".join(rng.choice(SYLLABLES + ["ü", "9", "-", "ing", "q"]) for _ in range(rng.randrange(1, 9))).encode()
        state = np.zeros(1, np.int64)
        for byte in word[:-1]:
            assert len(auto.accepted(state, np.array([byte]))[1]) == 1, word
            state = auto._look(state, np.array([byte])).astype(np.int64)
        assert len(auto.accepted(state, np.array([word[-1] + 256]))[1]) == 1, word
        assert auto.paths([word]) == [auto._alone(word)]


def test_tables_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    with open(bpe.vocabulary(), encoding="utf-8") as f:
        small = bpe.Tokenizer(f.read(), remember=10)
    monkeypatch.undo()
    with open(bpe.vocabulary(), encoding="utf-8") as f:
        large = bpe.Tokenizer(f.read())
    some = [prose(200, k) + " " + "".join(rng.choice("aeinorst-") for _ in range(300)) for k in range(5)]
    monkeypatch.setattr(bpe, "STATES", 50)
    found = [small.encode(t) for t in some]
    monkeypatch.undo()
    assert found == large.encode_all(some)


def test_empty_table_has_no_ids(spark):
    assert rows(bpe.encode(documents(spark, []))) == []


# ---- 8: sentence spans


def test_repeated_passages_go_and_others_stay(spark):
    passage = "Or thener onin re. " + prose(60, 77) + " Ander inre thor tion."
    data = [(1, f"{prose(30, 11)} {passage} {prose(30, 12)}"), (2, f"{prose(25, 13)} anti {passage}\n{prose(40, 14)}"), (3, prose(80, 15)), (4, None), (5, ""), (6, prose(200, 16)), (6, prose(200, 16)), (7, prose(200, 16)), (None, "One. Two."), (8, "One. Two."), (9, "x " * 30_000)]
    df = documents(spark, [(i, t, "a") for i, t in data])
    found = rows(sentence_spans.dedup(df, spark))
    by = {r.doc_id: r for r in found}
    assert len(found) == len(data) and by[1].text == data[0][1] and by[3].text == data[2][1] and by[8].text == "One. Two."
    assert by[2].text.split() == f"{prose(25, 13)} anti {prose(40, 14)}".split()
    assert by[7].text == "" and [r.n_removed for r in found if r.doc_id == 6] == [0, 0]
    assert by[4].text == by[5].text == "" and by[9].text == data[-1][1]


def test_removed_sentences_equal_a_slow_walk(spark):
    r = random.Random(12)
    parts = [prose(r.randrange(8, 70), 900 + i) for i in range(25)]
    parts[3], parts[4] = parts[3].lower().replace(".", ""), "。".join("字句" * r.randrange(2, 9) for _ in range(40)) + "。"
    data = [(i if i % 7 else None, " ".join(r.choice(parts) if r.random() < 0.5 else prose(r.randrange(5, 60), 5000 + 50 * i + k) for k in range(r.randrange(0, 6)))) for i in range(60)] + [(5, "One line.\n" * 40), (70, None)]
    order = sorted({(-(1 << 63) if i is None else i, t or "") for i, t in data}, key=lambda x: x[0])
    key = {(r.doc_id, r.text): r.row for r in rows(sentence_spans.rows_of(documents(spark, [(i, t, "a") for i, t in data])))}
    order.sort(key=lambda x: (x[0], key[(None if x[0] == -(1 << 63) else x[0], x[1] if x[1] or x[0] != 70 else None)]))
    assert len({(k[0], r) for k, r in key.items()}) == len(key)
    seen, want = {}, {}
    for i, text in order:
        cut = [" ".join(text[a:b].split()) for a, b in sentence_spans.sentences(text)]
        assert " ".join(cut).split() == text.split() or "。" in text
        gone = set()
        for k in range(len(cut) - 2):
            run = " ".join(cut[k : k + 3])
            if seen.setdefault(run, (i, text, k)) != (i, text, k):
                gone |= {k, k + 1, k + 2}
        for k in sorted(gone):  # regions too short stay
            if k - 1 not in gone:
                end = k
                while end in gone:
                    end += 1
                if sum(len(x.split()) for x in cut[k:end]) < 30:
                    gone -= set(range(k, end))
        want[i, text] = len(gone), " ".join(x for k, x in enumerate(cut) if k not in gone).split()
    assert sum(n for n, _ in want.values()) > 100
    for heavy in (2000, 10**9):
        found = rows(sentence_spans.dedup(documents(spark, [(i, t, "a") for i, t in data]), spark))
        texts = {(-(1 << 63) if i is None else i): set() for i, _ in data}
        assert len(found) == len(data)
        for r in found:
            texts[-(1 << 63) if r.doc_id is None else r.doc_id].add((r.n_removed, "".join(r.text.split())))
        for (i, _), (n, left) in want.items():
            assert (n, "".join(left)) in texts[i]


def test_frequent_runs_are_joined_apart(spark, monkeypatch):
    df = documents(spark, [(i, "Alpha beta. Gamma delta. Epsilon zeta. Eta theta. " * 30, "a") for i in range(40)])
    want = sorted((r.doc_id, r.n_removed) for r in rows(sentence_spans.dedup(df, spark)))
    monkeypatch.setattr(sentence_spans, "HEAVY", 10**9)
    assert sorted((r.doc_id, r.n_removed) for r in rows(sentence_spans.dedup(df, spark))) == want
    assert [n for _, n in want[1:]] == [120] * 39
    assert rows(sentence_spans.dedup(documents(spark, []), spark)) == []


def test_passages_go_wherever_they_are_cut(spark):
    # A passage set into other sentences, without capitals or closing marks, loses no more than its first and last pieces.
    words = [w.lower().replace(".", "") for w in prose(70, 31).split()]
    data = [(1, " ".join(["ab"] * 7 + words + ["cd"] * 9)), (2, " ".join(prose(9, 32).lower().split() + words + prose(9, 33).lower().split()))]
    found = {r.doc_id: r for r in rows(sentence_spans.dedup(documents(spark, [(i, t, "a") for i, t in data]), spark))}
    assert found[1].n_removed == 0 and found[2].words_removed >= 30


# ---- 9: secrets


def test_secret_spans(spark, odd):
    key, digest, token = "AKIA" + "Z9" * 8, "d41d8cd98f00b204e9800998ecf8427e", "qT7xZ2pLm9Kv4Rw8Ns3Bd6Y"
    text = f"é api_key: 'abc123=' AKIAX {key}. token=ab {digest} {token} user_name_example_12 550e8400-e29b-41d4-a716-446655440000 internationalization secret secret = x.y/z+1"
    found = rows(secrets.scan(documents(spark, [(1, text, "a"), (2, None, "a")])))
    by = {r.doc_id: r for r in found}
    spans = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in by[1].spans.split(","))]
    assert spans == [("assign", "api_key: 'abc123="), ("access", key), ("hex", digest), ("random", token), ("assign", "secret = x.y/z+1")]
    base = ",".join(s for s in by[1].spans.split(",") if not s.startswith("random"))
    assert by[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and by[2].spans == ""
    clean = rows(secrets.redact(odd))
    assert len(clean) == len(ODD) and [r.text for r in clean if r.doc_id == 9] == ["[SECRET] é中\U0001f600"]
    assert all(r.text == t for r, (i, t, _) in zip(clean, ODD, strict=True) if i != 9)


def test_base_spans_match_plain_patterns():
    for _ in range(300):
        text = "".join(rng.choice(["password", "API_KEY", " ", "=", ":", '"', "abc123", "AKIA", "ABCD1234", "deadbeef", "é", "token"]) for _ in range(30))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert secrets.base_spans(text) == sorted(want)


def test_random_runs_equal_a_slow_scan():
    import string

    encode = secrets._encoding(secrets._ranks(None)).encode_ordinary
    r = random.Random(11)
    alphabets = [string.ascii_lowercase, string.ascii_letters, string.ascii_letters + string.digits, string.ascii_uppercase, "0123456789", "0123456789abcdef"]
    keys = set(string.ascii_letters + string.digits + "+/_=-")
    planted = hit = 0
    for _ in range(300):
        secret = "".join(r.choice(r.choice(alphabets[:4])) for _ in range(r.randrange(12, 40)))
        other = "".join(r.choice(alphabets[r.randrange(6)]) for _ in range(r.choice([5, 12, 16, 32, 40])))
        text = " ".join(r.sample(["token = abcdef123", secret, other, "user/name/option_of_it-12", "internationalization", f"AKIA{other.upper()}", "é" + other, "x=" + secret[:9]], 6))
        base = secrets.base_spans(text)
        covered = {i for a, _, b in base for i in range(a, b)}
        want, at = [], 0
        while at < len(text):  # a run of key characters that began as one of 12 or more, cut at base spans
            end = at
            while end < len(text) and text[end] in keys:
                end += 1
            if end - at >= 12:
                a = at
                while a < end:
                    b = a
                    while b < end and b not in covered:
                        b += 1
                    run = text[a:b]
                    numbers = all(c in "0123456789+/_=-" for c in run) or all(c in "0123456789+/_=-" for c in run[2:]) and run[:2].isupper()
                    digest = len(run) in secrets.DIGESTS and all(c in string.hexdigits for c in run)
                    if len(run) >= 12 and not numbers and not digest:
                        parts = re.split("[_+/=-]", run)
                        name = len(parts) > 1 and all(not p or (p[1:].islower() or len(p) == 1) and p.isalpha() or p.isupper() and p.isalpha() or p.isdigit() and len(p) < 7 for p in parts)
                        spots = [(a, b)] if not name else [(a + m.start(), a + m.end()) for m in re.finditer("[A-Za-z0-9]{12,}", run)]
                        for x, y in spots:
                            ratio = (y - x) / len(encode(text[x:y]))
                            if ratio <= (2.0 if y - x >= 20 else 1.75 if y - x >= 16 else 1.5):
                                want.append((x, 3, y))
                    a = b + 1
            at = end + 1
        assert secrets.random_spans(text, base, encode) == want, text
        if secret in text and len(secret) >= 20:
            planted, hit = planted + 1, hit + any(text[a:b] == secret for a, _, b in want)
    assert planted > 50 and hit > 0.9 * planted


def test_clean_words_are_no_secrets(spark):
    words = "Donaudampfschifffahrtsgesellschaft internationalization anticonstitutionnellement /usr/local/share/applications --no-install-recommends https://example.org/a/path_of_words 4111111111111111 DE89370400440532013000 +49-30-123456 ===================="
    found = rows(secrets.scan(documents(spark, [(1, words + " " + prose(2000, 5), "a"), (2, "zqxvkjwpfhtnmbcd", "a"), (3, "token=abcdef,qZxVkJwPfHtNmBcDy", "a")])))
    by = {r.doc_id: r for r in found}
    assert by[1].n_random == 0 and by[2].spans == "random:0:16" and by[3].spans == "assign:0:12,random:13:30"
    assert rows(secrets.scan(documents(spark, []))) == [] and rows(secrets.redact(documents(spark, []))) == []


# ---- 10: quality


def test_quality_is_learnt_and_odd_rows_have_scores(spark):
    good = [(i, prose(150, i), "a") for i in range(200)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(150, i).split()), "a") for i in range(100)]
    df = documents(spark, good + bad + [(5000, None, "a"), (5001, "", "a"), (None, prose(30, 1), "a")])
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _, _ in good + bad] + [(1, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    found = rows(quality.score(df, quality.fit(df, labels, sample=200)))
    assert len(found) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id < 5000]
    assert held and all(r.predicted == int(r.doc_id < 1000) for r in held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    kept = rows(quality.keep_good(df, quality.fit(df, labels, sample=200)))
    assert {r.doc_id for r in kept} >= {i for i, _, _ in good} and not {r.doc_id for r in kept} & {i for i, _, _ in bad}


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in rows(quality.score(odd, quality.fit(odd, none)))} == {0.5}
    assert rows(quality.score(odd.limit(0), quality.fit(odd.limit(0), none))) == []


# ---- the pipeline


def test_pipeline_stages_agree_with_plain_steps(spark, tmp_path):
    import corpus_pipeline

    good = [(i, prose(150, i), rng.choice("abc")) for i in range(60)] + [(60, prose(150, 3), "a"), (61, "token = 'abcdefgh12' " + prose(80, 500), "b")]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose(150, i).split()), "a") for i in range(40)]
    documents(spark, good + bad).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _, _ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, str(tmp_path))
        found.write.parquet(f"{tmp_path}/{k}")
        assert k == 4 or found.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs)
    assert {r.doc_id for r in rows(out[0])} == {i for i, _, _ in good}
    assert {r.doc_id for r in rows(out[1])} == {i for i, _, _ in good} - {60}
    text = {r.doc_id: r.text for r in rows(out[2])}
    assert text[61].startswith("[SECRET]' ") and all(text[i] == t for i, t, _ in good[:60])
    words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert abs(words(out[3]) - words(out[2])) <= 3
    assert out[4].count() == out[3].count() and corpus_pipeline.run(spark, str(tmp_path)).count() == out[4].count()


def test_workers_give_memory_back_before_a_partition():
    """A partition starts without what an earlier stage of the same worker freed but kept, and ends so too."""
    import pyarrow as pa

    from quern.llm import common

    class Rows:
        sparkSession = None

        def mapInArrow(self, run, schema):
            return run

    given, before, held = [], common.give_back, common.to_arrow
    try:
        common.give_back, common.to_arrow = lambda: given.append(len(given)), lambda spark, schema: pa.schema([("a", pa.int64())])
        run = common.arrow_map(Rows(), lambda part: {"a": part["a"].to_pylist()}, "a long", rows=2, after=lambda: given.append("after"))
        out = run(iter([pa.RecordBatch.from_pydict({"a": [1, 2, 3]})]))
        assert next(out).num_rows == 2 and given == [0]
        assert [b.num_rows for b in out] == [1] and given == [0, "after", 2]
    finally:
        common.give_back, common.to_arrow = before, held
