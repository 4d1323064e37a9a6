"""Main text, the weak-label classifier and packing."""

import random

import numpy as np
import public_tokenizers
import pytest

from nodeloom.llm import maincontent, packing, weaklabel
from nodeloom.llm.bytewords import SPACED, words_of
from tests.llm import brute

rng = random.Random(13)
PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>hidden</p> -->
<div class="cookie-notice">We use cookies, do you agree?</div><article><header><h1>The  title &amp;
more</h1></header><p><b>First paragraph with several words, and a <a href=x>link</a>.<br><p>Second one&nbsp;here &lt;b&gt;; it goes on.</p>
<div class="advert">Buy this now, it is cheap and good.</div><ul><li>Item one</li><li>Item two</li></ul><p>End</article>
<section id="comments"><p>Nice article, I really liked it a lot, thank you.</p></section><aside>Related: other things</aside>
<form><input name=q><label>Search</label></form><footer>&copy; somebody</footer></body></html>"""
MODEL = [-1.0, 1.0, -3.0, 0.1, 0.0, 0.0]


def test_main_text_of_a_page():
    assert maincontent.main_text(PAGE, MODEL) == "\n".join([
        "The title & more", "First paragraph with several words, and a link.", "Second one here <b>; it goes on.", "Item one", "Item two", "End"])


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("   ", ""), ("<script>x", ""), ("<article><p>cut of", "cut of"), ("<article>a < b &am", "a < b &am"),
    ("<article><p>one</p", "one"), ("<ARTICLE><P CLASS='x>y'>one<P>two", "one\ntwo"), ("<article hidden><p>no</article><main><p>yes", "yes"),
    ("<article>" + "<div>" * 3000 + "deep", "deep"), ("<article><p>" + "word " * 50_000, ("word " * 50_000).strip())])
def test_odd_pages(page, want):
    assert maincontent.main_text(page, MODEL) == want


def test_pages_without_an_article_are_judged_by_text():
    text = "A long paragraph of real text, with several sentences in it. It goes on for a while, as paragraphs do."
    page = f"<body><div><a href=1>Home</a> <a href=2>About us</a></div><div><p>{text}</p><p>{text}</p></div><div><a href=3>Terms</a></div>"
    assert maincontent.main_text(page, MODEL) == f"{text}\n{text}"


REAL = "A long paragraph of real text, with several sentences in it. It goes on for a while, as paragraphs do."


@pytest.mark.parametrize("body", [
    f"<form><input type=hidden name=s><input name=q><p>{REAL}</p><p>{REAL}</p></form>", f"<form><article><p>{REAL}</p><p>{REAL}</p></article></form>",
    f"<div class='content has-sidebar'><p>{REAL}<p>{REAL}</div>", f"<div class='content has-sidebar'><article><p>{REAL}<p>{REAL}</article></div>",
    f"<div id='search-wrapper'><article><p>{REAL}<p>{REAL}</article></div>", f"<div id='search-wrapper'><p>{REAL}<p>{REAL}</div>",
    f"<div class='sidebar'><main><p>{REAL}<p>{REAL}</main></div>", f"<div class=notice><p>{REAL}<p>{REAL}</div><div class=related><p>Other things</div>",
    f"<article><p>{REAL}<p>{REAL}</article><div class='related'><article>Read this one too, it is good.</article></div><div class=site-comments>{REAL}</div>",
    f"<article><p>{REAL}<p>{REAL}<form>Your mail address, for news of us.<input><button>Go</button></form></article>"])
def test_wrapped_text_is_kept_and_page_parts_are_not(body):
    page = f"<body><nav><a href=1>Home</a></nav>{body}<footer>End</footer>"
    assert maincontent.main_text(page, MODEL) == f"{REAL}\n{REAL}"


def test_minimum_cut_is_minimal():
    for _ in range(200):
        n = rng.randrange(1, 7)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randrange(9))]
        edges = [e for e in edges if e[0] != e[1]]

        def cost(labels, gain=gain, edges=edges):
            return sum(-g if x else 0 for g, x in zip(gain, labels, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost([bool(c >> i & 1) for i in range(n)]) for c in range(2 ** n))
        assert abs(cost(maincontent.minimum_cut(gain, edges)) - best) < 1e-6


def test_extract_on_tables(spark):
    table = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id bigint, url string, html string")
    got = maincontent.report(table).collect()
    assert len(got) == 3 and got[0] == got[1] and got[2]["text"] == "" and got[2]["n_chars"] == 0
    assert got[0]["n_chars"] == len(got[0]["text"]) > 0
    assert maincontent.report(table.limit(0)).count() == 0


GOOD = ["The house of the man is on the hill. It was built in the old days, and he liked it.", "Some of us go to the sea. Others stay at home."]


def documents():
    words = [f"{a}{b}" for a in ("ta", "ri", "mon", "le") for b in ("ka", "so", "ren", "dil", "pu")] + ["a", "of", "to", "it", "is"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 12))) + "."
    good = ["\n".join(sentence() for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    long = [w for w in words if len(w) > 3]
    bad = [" ".join(f"{rng.choice(words)}###" for _ in range(60)) for _ in range(40)]
    bad += [" | ".join(rng.choice(long) + rng.choice(long) for _ in range(40)) for _ in range(40)]
    bad += [" ".join([*rng.sample(words, 6)] * 12) for _ in range(40)]
    rows = [(t, 1) for t in good] + [(t, 0) for t in bad]
    rng.shuffle(rows)
    return rows


def test_classifier_on_held_out_rows(spark):
    rows = documents()
    table = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)], "doc_id bigint, text string, kept string")
    labels = weaklabel.label_model(table)
    weights = weaklabel.scorer(table.filter("doc_id < 400"), labels)
    right = 0
    for t, good in rows[400:]:
        words = words_of(__import__("pyarrow").array([t]), SPACED)
        _, slot, value = weaklabel.features(words, words.hashes())
        right += (weights[slot] @ value + weights[-1] >= 0) == good
    assert right >= 0.95 * len(rows[400:])
    got = weaklabel.report(table.select("doc_id", "text")).collect()
    assert sum(r["kept"] == bool(rows[r["doc_id"]][1]) for r in got) >= 0.95 * len(rows)


def test_samples_are_drawn_from_the_whole_table(spark):
    rows = sorted(documents(), key=lambda r: -r[1])  # all good ones first
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string").coalesce(2)
    weights = weaklabel.scorer(table, weaklabel.label_model(table), fit_docs=300)
    right = 0
    for t, good in rows:
        words = words_of(__import__("pyarrow").array([t]), SPACED)
        _, slot, value = weaklabel.features(words, words.hashes())
        right += (weights[slot] @ value + weights[-1] >= 0) == good
    assert right >= 0.95 * len(rows)
    pages = [(i, f"<article><p>{'Real words, many of them. ' * 9}</article>") for i in range(300)]
    pages += [(i, f"<nav><a href=1>Home {i}</a></nav>") for i in range(300, 600)]
    model = maincontent.fit_model(spark.createDataFrame(pages, "page_id bigint, html string").coalesce(2), fit_blocks=200)
    assert model != [-2.0, 1.0, -4.0, 1.0, 0.0, 0.0]


def test_expectation_maximisation_recovers_rates():
    true = np.array([[[0.6, 0.3, 0.1], [0.02, 0.28, 0.7]], [[0.4, 0.6, 0.0], [0.01, 0.99, 0.0]], [[0.5, 0.2, 0.3], [0.1, 0.2, 0.7]]])
    draw = np.random.default_rng(1)
    good = draw.random(60_000) < 0.8
    v = np.stack([[draw.choice([-1, 0, 1], p=true[j, int(g)]) for g in good] for j in range(3)], 1)
    codes, counts = np.unique(weaklabel.pattern(v), return_counts=True)
    model = weaklabel.estimate(codes, counts.astype(float), labellers=3, rounds=2000)
    assert abs(model.good - 0.8) < 0.1 and np.abs(model.rates - true).max() < 0.12
    assert np.array_equal(weaklabel.unpattern(weaklabel.pattern(v), 3), v)


def test_classifier_edge_cases(spark):
    table = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x" * 9000), (3, GOOD[0] * 300)], "doc_id bigint, text string")
    got = weaklabel.report(table).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in got)
    assert weaklabel.report(table.limit(0)).count() == 0


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "Hello, World... it's THE end!", "<|endoftext|> in text", "ÉTÉ été Σίσυφος ΑΣ", "x" * 3000, "a\tb c\x1cd e", "日本語 テキスト",
       "word. " * 9000, "n0punct " * 3000, "12 345 6.78 'll 's U.S.A. a.b, c,.", "é ́x", ". . , ,", "it's,", "don't.", "x.,y"]


def test_word_cache_gives_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    coder, words = Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER)
    pieces = ["a", "Be", "é", ".", ",", "'s", "'", "1", " ", "\n", "\t", " ", "ß", "İ", "!", "́", "-"]
    for text in [*ODD, *["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(3000)]]:
        assert words.ids(text).tolist() == coder.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("block", [1 << 20, 9000])
def test_packing_covers_every_id_once(spark, block, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD * 2 + [" ".join(rng.choice(GOOD) for _ in range(rng.randrange(40))) for _ in range(60)])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    from pyspark.sql import functions as F

    pieces = packing.pack(table, TOKENIZER, block_tokens=block).select(
        "doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()
    assert brute.check_packing([tuple(p) for p in pieces], rows, TOKENIZER) < 0.05


def test_packing_keeps_stored_order_and_repeated_rows(spark):
    table = spark.createDataFrame([(5, "one two"), (5, "one two"), (None, "x"), (3, None)], "doc_id bigint, text string").coalesce(1)
    got = packing.report(table, TOKENIZER).orderBy("sequence_id", "offset").collect()
    assert [r["doc_id"] for r in got if r["start"] == 0] == [5, 5, None, 3]
    assert packing.report(table.limit(0), TOKENIZER).count() == 0


def test_cuts_are_the_cheapest():
    for _ in range(300):
        size = rng.choice([4, 8, 11])
        steps = [rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 9))]
        position = np.concatenate([[0], np.cumsum(steps)])
        cost = np.array([0] + [rng.randrange(4) for _ in steps])
        n = len(position)

        def total(cuts, position=position, cost=cost, size=size):
            out, last = 0, 0
            for j in cuts:
                width = int(position[j] - position[last])
                if width > size:
                    return 10**9
                out += (0 if width & (width - 1) == 0 else size - width) + int(cost[j])
                last = j
            return out

        best = min(total([j for j in range(1, n) if j == n - 1 or c >> (j - 1) & 1]) for c in range(2 ** (n - 2) if n > 1 else 1))
        assert total(packing.choose_cuts(position, cost, size)) == best
