"""Licence scan, decontamination, language spans and HTML extraction."""

import random
import textwrap

import numpy as np
import pytest

from textfold.llm import edit_decontam, language_spans, license_scan, wrapper_extract
from tests.llm import brute

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ licences

def test_every_template_finds_itself():
    s = license_scan.Scanner(license_scan.TEMPLATES)
    for name, notices in license_scan.TEMPLATES.items():
        for n in notices:
            hits = s.licences(f"some words\n{n}\nmore words here")
            assert [(h[1], h[3]) for h in hits] == [(name, 0)], (n, hits)


def test_licence_wording_decides(spark):
    rows = [(1, "x\nLicensed under CC BY 4.0.\ny", 0), (2, "Licensed under CC BY-NC 4.0.", 0), (3, None, 0), (4, "", 0),
            (5, "the licensed plumber redistributed flyers about public domain books", 0),
            (6, "intro text then Released under the  MIT  license! and more", 0), (6, "Released under the MIT License.", 0),
            (7, "Licence fees " * 5000 + "\nLicensed under the Apache License, Version 2.0.", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int")
    got = sorted((r["doc_id"], r["license"], r["n_different"]) for r in license_scan.scan_licenses(df).collect())
    assert got == [(1, "CC-BY-4.0", 0), (2, "CC-BY-NC-4.0", 0), (6, "MIT", 0), (6, "MIT", 0), (7, "Apache-2.0", 0)]
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("words", [0, 3, 6, 20, 40])
def test_short_notices_in_long_lines(words):
    s = license_scan.Scanner(license_scan.TEMPLATES)
    rng = random.Random(words)
    before, after = (" ".join("".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randrange(2, 9))) for _ in range(words))
                     for _ in range(2))
    for name, notices in license_scan.TEMPLATES.items():
        for n in notices:
            assert {(h[1], h[3]) for h in s.licences(f"{before} {n} {after}")} == {(name, 0)}, n


def test_wrapped_notices_and_several_in_a_line():
    s = license_scan.Scanner(license_scan.TEMPLATES)
    for mark in ("", "# ", " * "):
        for width in (14, 30, 74):
            for name, notices in license_scan.TEMPLATES.items():
                for n in notices:
                    head = "\n".join(["some code", *textwrap.wrap(n, width, break_long_words=False, break_on_hyphens=False)]).replace("\n", "\n" + mark) + "\nmore code"
                    got = [(h[0], h[1], h[3]) for h in s.licences(head)]
                    assert got == [(10 + len(mark), name, 0)], (head, got)
    line = "Released under the MIT License. Licensed under the Apache License, Version 2.0. All rights reserved."
    assert [(h[0], h[1], h[3]) for h in s.licences(line)] == [(0, "MIT", 0), (32, "Apache-2.0", 0), (80, "Proprietary", 0)]
    twice = "All rights reserved. " * 3 + "Copyright 2020 Acme. All rights\nreserved."
    assert [(h[0], h[1]) for h in s.licences(twice)] == [(at, "Proprietary") for at in (0, 21, 42, 84)]


def test_nearest_run_of_words():
    rng = random.Random(9)
    for _ in range(300):
        words = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
        notice = [rng.choice("abcd") for _ in range(rng.randrange(1, 6))]
        at = rng.randrange(len(words))

        def differ(x, y):
            if not x or not y:
                return len(x) + len(y)
            return differ(x[1:], y[1:]) if x[0] == y[0] else 1 + min(differ(x[1:], y), differ(x, y[1:]))
        d, a, b = min((differ(notice, words[a:b]), a, b) for a in range(at + 1) for b in range(at + 1, len(words) + 1))
        got = license_scan.nearest(notice, words, at, at)
        assert got is None or got[0] >= d
        if 4 * d <= len(notice):
            assert got and got[0] == d and differ(notice, words[got[2]:got[2] + got[1]]) == d


def test_licence_lines_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(df).collect()}
    names = {n: name for name, ns in license_scan.TEMPLATES.items() for n in ns}
    planted = {(r["doc_id"], names[line]) for r in df.collect() for line in r["text"].split("\n") if line in names}
    assert planted and planted == got


# ------------------------------------------------------------------ decontamination

def test_myers_distance():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))
        assert edit_decontam.Pattern(item).distance(text) == brute.edit_distance_inside(item, text)


def test_pieces_cover_the_item():
    assert "".join(p for _, p in edit_decontam.pieces("abcdefghij", 3)) == "abcdefghij"
    assert len(edit_decontam.pieces("abcdefghij", 3)) == 4


def test_edited_passages(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(30))) for i in range(8)]
    items += [(98, None), (99, "short"), (7, items[7][1])]
    rows = [(0, None), (1, ""), (2, "alpha beta " * 4000)]
    for d in range(3, 60):
        t = list(rng.choice(items[:8])[1])
        for _ in range(rng.randrange(16)):
            at = rng.randrange(len(t))
            t[at:at + rng.randrange(2)] = rng.choice(["", "z", "Q"])
        rows.append((d, "Before it\n\n" + "".join(t).upper() + "  and after " + "x" * rng.randrange(50)))
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int")
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for d, t in rows:
        for i, x in items:
            if t and x and len(x) >= edit_decontam.LEAST_CHARS:
                n = brute.edit_distance_inside(edit_decontam.normal(x), edit_decontam.normal(t)) if d != 2 else 10**9
                if n <= int(edit_decontam.EDIT_SHARE * len(x)):
                    expected.append((d, i, n))
    got = sorted(tuple(r) for r in edit_decontam.find_items(docs, table).collect())
    assert got == sorted(expected) and len({d for d, _, _ in got}) < 57
    small = sorted(tuple(r) for r in edit_decontam.find_items(docs, table, block_bytes=300).collect())
    assert small == got
    kept = edit_decontam.drop_contaminated(docs, table, block_bytes=500)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _, _ in got}
    assert edit_decontam.find_items(docs.limit(0), table).count() == edit_decontam.find_items(docs, table.limit(0)).count() == 0


def test_short_items(spark):
    rows = [(1, "He asked: What is  two plus\ntwo? Yes."), (2, "yesterday, whatever"), (3, "yes_no"), (4, "他说你好吗然后走了"), (5, None)]
    items = [(1, "What is two plus two?"), (2, "two plus two"), (3, "yes"), (4, "你好吗"), (5, " "), (6, "whatever"), (7, "plus t"), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in edit_decontam.find_items(docs, table).collect())
    assert got == [(1, 1, 0), (1, 2, 0), (1, 3, 0), (2, 6, 0), (4, 4, 0)]
    assert {r["doc_id"] for r in edit_decontam.drop_contaminated(docs, table).collect()} == {3, 5}


def test_exact_passages_of_documents(spark):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in edit_decontam.find_items(docs, items).collect()}
    texts = [(r["item_id"], edit_decontam.normal(r["text"])) for r in items.collect()]
    exact = {(r["doc_id"], i) for r in docs.collect() for i, t in texts if t in edit_decontam.normal(r["text"])}
    assert exact and got == exact


# ------------------------------------------------------------------ languages

def test_viterbi_many_texts_at_once():
    rng = np.random.default_rng(1)
    count = np.array([0, 1, 7, 300, 2, 0, 41])
    score = np.maximum(np.log(rng.dirichlet(np.full(4, 0.3), int(count.sum()))), -4).astype(np.float32)
    label = language_spans.viterbi(score, count, 3.0)
    at = 0
    for n in count:
        if n:
            assert label[at:at + n].tolist() == brute.viterbi(score[at:at + n], 3.0)
        at += n
    assert len(language_spans.viterbi(score[:0], np.zeros(3, int))) == 0


def test_language_accuracy_and_spans(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_spans.fit(df)
    rows = language_spans.label_languages(df, model).join(df.select("doc_id", "lang", language_spans.held_out(df.doc_id).alias("h")),
                                                          "doc_id").collect()
    held = [r for r in rows if r["h"]]
    assert len(held) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    texts = {lang: next(r["text"] for r in df.orderBy("doc_id").collect() if r["lang"] == lang and 800 < len(r["text"]) < 4000)
             for lang in ("en", "de")}
    rows = [(1, texts["en"] + "\n" + texts["de"]), (2, None), (3, "12 !? \n"), (4, ""), (5, "слово за слово"), (5, "слово за слово")]
    got = {r["doc_id"]: r for r in language_spans.label_languages(
        spark.createDataFrame([(d, t, "zz", 0.5) for d, t in rows], "doc_id long, text string, lang string, score double"), model).collect()}
    spans = [s for s in got[1]["spans"] if s["end_word"] - s["first_word"] > 20]
    assert [s["lang"] for s in spans] == ["en", "de"] and 0 < got[1]["score"] < 1
    words = len(language_spans.LETTERS.findall(texts["en"]))
    assert abs(spans[0]["end_word"] - words) <= 5
    for d in (2, 3, 4):
        assert (got[d]["lang_pred"], got[d]["score"], got[d]["spans"]) == ("und", 0.0, [])
    assert got[5]["lang_pred"] in model.languages
    kept = language_spans.keep_languages(df, model, 0.5)
    assert kept.schema == df.schema and kept.count() == df.count()


def test_languages_without_training(spark):
    df = spark.createDataFrame([(1, "some words", None), (None, "words", "en")], "doc_id long, text string, lang string")
    model = language_spans.fit(df)
    assert [r["lang_pred"] for r in language_spans.label_languages(df, model).collect()] == ["und", "und"]
    assert language_spans.label_languages(df.limit(0), model).count() == 0


def test_texts_in_several_languages_stay(spark):
    text = {"ru": "нет да слово дело", "el": "ναι οχι λογος", "en": "yes no word deed"}
    df = spark.createDataFrame([(100 * i + j, t, lang) for i, (lang, t) in enumerate(text.items()) for j in range(40)],
                               "doc_id long, text string, lang string")
    model = language_spans.fit(df)
    three = " ".join((t + " ") * 20 for t in text.values())
    rows = [(1, three), (2, (text["en"] + " ") * 20 + (text["ru"] + " ") * 20), (3, "שלום " * 30 + "yes no"), (4, None), (5, "12 !?"),
            (6, "yes no word " * 9 + "שלום")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in language_spans.label_languages(texts, model).collect()}
    assert score[1] < 0.5
    assert {r["doc_id"] for r in language_spans.keep_languages(texts, model, 0.5).collect()} == {1, 2, 6}


def test_stage_without_training_raises(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "some words", None), (None, "words", "en")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="no language learned"):
        corpus_pipeline.keep_known_languages(spark, df, SF)
    assert corpus_pipeline.keep_known_languages(spark, df.limit(0), SF).count() == 0


def test_script_narrows(spark):
    rows = [(i, "нет да слово дело", "ru") for i in range(40)] + [(100 + i, "ναι οχι λογος", "el") for i in range(40)] \
        + [(200 + i, "yes no word deed", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_spans.fit(df)
    got = language_spans.label_languages(spark.createDataFrame([(1, "абвгд"), (2, "ξψω"), (3, "zzz")], "doc_id long, text string"), model)
    assert [r["lang_pred"] for r in got.orderBy("doc_id").collect()] == ["ru", "el", "en"]


# ------------------------------------------------------------------ pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>{nav}<li><a href=/b>B</a></ul></nav><!-- ad <p>no</p> --><div class="ad">buy {n}</div>
<div class=cookie-notice>We use cookies</div><div class="crumbs">Home</div>
<article><h1>Title {n}</h1><p><b>First {n} &lt;b&gt;.<br><p>Sec<i>ond</i>\n  para</p><div class="share-box">Share</div>
<p class="promo-line">Subscribe</p><p>Same words<form><input value=">">Search</form><div class="comments"><p>nice one</p></div></article>
<aside>more</aside><footer>&copy; {n}</footer></body></html>"""


@pytest.mark.parametrize("n", [1, 2, 30])
def test_extract_article(spark, n):
    rows = [(i, f"https://x.example/p{i}", PAGE.format(n=i, nav="A" * (i % 3))) for i in range(n)]
    got = wrapper_extract.extract_pages(spark.createDataFrame([(*r, "h", b"t") for r in rows],
                                                              "page_id long, url string, html string, host string, template binary"))
    for r in got.collect():
        i = r["page_id"]
        assert r["text"] == f"Title {i} First {i} <b>. Second para Same words"
        assert r["n_chars"] == len(r["text"])


def test_constant_slots_of_a_host_are_template(spark):
    page = "<body><div class=top>Our site motto</div><div class=x><p>Story {i} about things</p></div><div class=y>All the best</div></body>"
    rows = [(i, "http://h.example/", page.format(i=i)) for i in range(20)]
    got = wrapper_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["text"] for r in got.collect()} == {f"Story {i} about things" for i in range(20)}
    copies = spark.createDataFrame([(i, "http://h.example/", page.format(i=0)) for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in wrapper_extract.extract_pages(copies).collect()} == {"Our site motto Story 0 about things All the best"}


@pytest.mark.parametrize("copies", [4, 5, 40])
def test_copies_of_a_page_are_no_template(spark, copies):
    page = ("<body><nav>n{j}</nav><article><h1>Story {i}</h1><p>about {i}</p>{more}<div class=follow-us>Follow us</div></article>"
            "<div class=ad>{j}</div></body>")
    own = "<ul><li>one</li></ul><table><tr><td>two</td></tr></table><p class=lead>three</p><dl><dt>four</dt></dl>"
    rows = [(i, "http://h.example/", page.format(i=i, j=0, more="")) for i in range(20)]
    rows += [(100 + j, "http://h.example/", page.format(i=100, j=j, more=own)) for j in range(copies)]  # the same article
    rows += [(200 + j, "http://h.example/", page.format(i=200 + j, j=j, more="<figure>" + own + "</figure>")) for j in range(6)]
    got = {r["page_id"]: r["text"] for r in wrapper_extract.extract_pages(
        spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    words = "one two three four"
    assert got == {i: f"Story {i} about {i}" for i in range(20)} | {100 + j: f"Story 100 about 100 {words}" for j in range(copies)} \
        | {200 + j: f"Story {200 + j} about {200 + j} {words}" for j in range(6)}


def test_names_about_neighbours_stay():
    page = "<body class='has-sidebar'><div class='post with-sidebar'><p>text</p></div><div class='rightSidebar'>x</div></body>"
    assert wrapper_extract.extract(page, None) == "text"


@pytest.mark.parametrize("page, text", [
    ("<article><h2 id='related-work'>Related work</h2><p id=notice>We</p><section id='social-impact'><p>show</p></section>"
     "<section id=disclaimer><p>that</p></section><div class=section id=related><a id=share>it</a> holds</div></article>",
     "Related work We show that it holds"),
    ("<div class='elementor-widget-container'><article><p>text</p></article></div>", "text"),
    ("<div class='layout-sidebar-right'><p>text</p></div>", "text"),
    ("<div class='widget'><article><p>text</p></article></div>", "text"),
    ("<div class='sidebar-right'><main><p>text</p></main></div>", "text"),
    ("<div class='sidebar'><p>text</p></div>", "text"),
    ("<main><div class='widget'><article><p>text</p></article></div></main>", "text"),
    ("<article><p>text</p></article><div id=comments class='comments-area'><article class='comment-body'>first</article></div>", "text"),
    ("<article><p>text</p><div class='related-posts'><article>other</article></div><div id=comments>c</div></article>", "text"),
    ("<body><div class='site-footer'>f</div><div id=sidebar>s</div><h2 id=notice>Notice</h2><p>text</p></body>", "Notice text"),
])
def test_names_drop_no_content(page, text):
    assert wrapper_extract.extract(page, None) == text


@pytest.mark.parametrize("page, text", [
    ("<article><p>a <svg class='icon'/> b</p><p>c</p></article>", "a b c"),
    ("<article><p>a <math/>b</p><svg class=i /><p>c</p><svg><text>t</text></svg><p>d</p></article>", "a b c d"),
    ("<article><p>so <math><msup><mi>x</mi><mn>2</mn></msup><mspace/><mo>=</mo><mn>4</mn></math> holds</p></article>", "so x2=4 holds"),
    ("<article><svg><g><path d=''/></g><p>a</p><svg><svg/><svg><g/></svg><text>t</text></svg><p>b</p></article>", "a b"),
    ("<article><svg><foreignObject><div>t</div></foreignObject><text>u</text></svg>a</article><p>b", "a"),
    ("<article><p><math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr></mtable></math>", "1 2"),
    ("<article>a<script/>x</script>b<style>p{}</style>c</article>", "abc"),
])
def test_drawings_and_formulas(page, text):
    assert wrapper_extract.extract(page, None) == text


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "", ""), (3, "no url", "just text &amp; more"), (4, "http://a/", "<article>cut <p>off <foot"),
            (5, "http://a/", deep), (6, "http://a/", "<p>one<!-- never closed"), (7, "http://a/", "a < b and <3 c"),
            (8, "http://a/", "<article><p title=don't>x</p><p>y</article>"), (8, "http://a/", "<article><p title=don't>x</p><p>y</article>"),
            (9, "http://a/", "<article>" + "<p>para</p>" * 20000 + "</article>")]
    got = {r["page_id"]: r["text"] for r in wrapper_extract.extract_pages(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "", 2: "", 3: "just text & more", 4: "cut off", 5: "deep", 6: "one", 7: "a < b and <3 c", 8: "x y",
                   9: " ".join(["para"] * 20000)}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrapper_extract.extract_pages(empty).count() == 0


def test_tree_matching():
    a = wrapper_extract.template_of(wrapper_extract.parse("<nav>n</nav><h1>t</h1><p>x</p><footer>f</footer>"))
    b = wrapper_extract.template_of(wrapper_extract.parse("<h1>t</h1><ul><li>1</ul><p>y</p><footer>f</footer>"))
    assert wrapper_extract.weight(a, b) == 4
    t = wrapper_extract.fold(a, b)
    assert {k[0][0]: (k[1], k[3]) for k in t[4]} == {"nav": (1, False), "h1": (2, False), "ul": (1, False), "p": (2, True),
                                                     "footer": (2, False)}


def _tree(depth, side):
    """Nested blocks with one sibling more on one side at every level."""
    kids = [_tree(depth - 1, side)] if depth else []
    own = [[("p", side, depth), 1, 0, False, []]] * (depth % 2 == side)
    return [("div",), 1, 0, False, own + kids + [[("hr",), 1, depth, False, []]]]


def _brute_weight(a, b):
    """Every way to match the children in order."""
    def best(x, y):
        if not x or not y:
            return 0
        w = 1 + best(x[0][4], y[0][4]) + best(x[1:], y[1:]) if x[0][0] == y[0][0] else 0
        return max(w, best(x[1:], y), best(x, y[1:]))
    return 1 + best(a[4], b[4])


def test_tree_matching_is_the_best_and_stays_fast():
    import random
    import time

    rng = random.Random(4)

    def tree(depth):
        return [("n", rng.randrange(2)) if depth < 3 else ("r",), 1, 0, False, [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []]
    for _ in range(60):
        a, b = tree(3), tree(3)
        assert wrapper_extract.weight(a, b) == _brute_weight(a, b)
    began = time.time()
    a, b = _tree(60, 0), _tree(60, 1)
    assert wrapper_extract.weight(a, b) == 122
    wrapper_extract.fold(a, b)
    assert time.time() - began < 1
