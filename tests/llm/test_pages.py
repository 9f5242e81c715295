"""Main text and language of pages."""

import html as entities
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import EDGE

from turnwise.llm import html, language, urls


def plain(source):
    """Blocks of the article by splitting at its block tags."""
    inner = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
    parts = (" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?p>|</?h1>", inner))
    return "\n".join(p for p in parts if p)


def test_articles_of_the_table(pages):
    source = {r.page_id: r.html for r in pages.collect()}
    got = html.extract(pages).collect()
    assert len(got) == len(source) and all(r.text == plain(source[r.page_id]) for r in got)


def text(source, noise=frozenset()):
    return html.main_text(html.parse(source), noise)


def test_markup_rules():
    page = ('<html><body class="x with-sidebar"><div id=wrap class="sidebar-left"><header><h1>Site</h1></header><nav><p>menu</p></nav><main>'
            '<header><h2>Ti&nbsp;tle</h2></header>one <b>t</b>wo<script>if(a<b){"</p>"}</script>, three<div class="ad">x</div>four &lt;5&gt;<br>five'
            '<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><section id="comments"><p>no</p></section><aside>no</aside></main></div>'
            '<form>f<p>g</p></form><div class="cookie-notice">c</div><footer>f</footer></body>')
    assert text(page) == "Ti tle\none two, three\nfour <5> five\na\nb\nc\nd"
    assert text("<p>a<p>b <i>c</i> 5 < 6 <!-- no <p>zz") == "a\nb c 5 < 6"
    assert text("") == text("<nav>x</nav>") == text("<!-- x") == ""
    assert text("<p><b>un<p>closed</b> <a href='x>y'>l</a>\n  t</div></p>") == "un\nclosed l t"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert text(deep) == "x"


def site(spark, n=20):
    """Pages without an article element: a repeated line, a repeated box, a text of its own, a class name of its own."""
    rows = [(i, f"http://host.example/{i}", f"<body><div class='top'><p>Our site</p></div><div class='mid r{i}'><p>row {i} alone</p></div>"
             f"<div class='text'><p>Story {i} tells of {i * 7}.</p><p>More {i}</p></div><div class='low'><p>All rights</p></div></body>")
            for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_low_nodes_of_a_host_go(spark, monkeypatch):
    for limit in (html.BROADCAST_NODES, -1):  # broadcast, and node by node
        monkeypatch.setattr(html, "BROADCAST_NODES", limit)
        got = {r.page_id: r.text for r in html.extract(site(spark)).collect()}
        assert got == {i: f"row {i} alone\nStory {i} tells of {i * 7}.\nMore {i}" for i in range(20)}
    few = {r.page_id: r.text for r in html.extract(site(spark, 3)).collect()}
    assert few[0].startswith("Our site\n")  # three pages say little


def test_importance_like_a_plain_tree(spark):
    pages = [(f"<body><div><p>same</p>{'<p>x</p>' * (i % 2)}<p>own {i}</p></div>said {i % 2}</body>") for i in range(8)]
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    got = {bytes(r.node): r for r in html.style_tree(df).collect()}
    trees = [html.style_rows(html.parse(p)) for p in pages]
    nodes = {n for t in trees for n, *_ in t}
    assert set(got) == nodes
    for node in nodes:
        styles = Counter(s for t in trees for n, s, _ in t if n == node and s)
        contents = Counter(c for t in trees for n, _, c in t if n == node and c)
        m = sum(styles.values())
        p = np.array(list(styles.values())) / m
        assert got[node].pages == m and abs(got[node].presentation + (p * np.log(p)).sum() / np.log(m)) < 1e-9
        if contents:
            assert abs(got[node].content - (1 - np.mean([np.log(c) / np.log(m) for c in contents.values()]))) < 1e-9
        else:
            assert got[node].content is None
    root = html.parse(pages[1])
    html.weigh(root, {k: (r.presentation, r.content, r.pages) for k, r in got.items()})
    body, = root.children
    div = body.children[0]
    g, known = html.GAMMA, 8 / 10

    def importance(node, below):
        w, shown = g ** node.depth, 1 - known * (1 - got[node.key].presentation)
        return (1 - w) * shown + w * np.mean(below)
    leaf = 1 - known * (1 - got[div.children[0].key].content)  # the three paragraphs are one node
    inner = importance(div.children[0], [leaf])
    assert body.low == (importance(body, [importance(div, [inner] * 3), 1 - known * (1 - got[body.key].content)]) < html.LEAST_IMPORTANCE)
    assert not div.low


def test_texts_change_with_the_pages_of_a_host_once(spark):
    """From one page to twenty, what all pages repeat goes at one number of pages and does not come back; the rest stays."""
    seen = []
    for n in range(1, 21):
        got = {r.page_id: r.text for r in html.extract(site(spark, n)).collect()} if n in (1, 4, 8, 9, 14, 20) else None
        if got:
            assert all(f"row {i} alone\nStory {i} tells of {i * 7}.\nMore {i}" in t for i, t in got.items())
            seen.append("Our site" in got[0])
    assert seen[0] and not seen[-1] and sorted(seen, reverse=True) == seen


def test_odd_markup_loses_no_text():
    assert text("<p>x <a title=it's>hello</a> world</p><p>don't lose me</p>") == "x hello world\ndon't lose me"
    assert text("<p>a<i class=\"x'>b</i> c</p><p>d's</p>") == "ab c\nd's"
    assert text("<p a = 'x>y' b=\"<p>\" c>t</p><p/ =x>u</p><!DOCTYPE html><p>v") == "t\nu\nv"
    assert text("<div title='class=ad'><p>stays</p></div><p data-x=\"1\"id=ad>goes</p><p class='' id=x>y") == "stays\ny"
    assert text("<p>a < b <3 &lt; c") == "a < b <3 < c"


@pytest.mark.parametrize("page", ["<div>" * 50_000, "<font>" * 50_000, "<div class=a><p>x" * 20_000, "<b>" * 20_000 + "</section>" * 20_000, "<li><font>" * 20_000,
                                  "<div>" + "<font>" * 20_000 + "<tr>" * 20_000, "<!" * 200_000, "<!--" * 200_000, "<script>" * 50_000, "<a b='" * 50_000, "<a b=\"" * 50_000,
                                  "<" * 300_000, "<p>x</div>" * 20_000, "<a =" * 50_000])
def test_long_and_deep_pages_take_time_in_proportion(page):
    start = time.time()
    html.style_rows(html.parse(page + "<p>end"))
    html.main_text(html.parse(page + "<p>end"))
    assert time.time() - start < 20


def test_tags_are_left_out_in_one_pass(spark):
    model = np.zeros((4, language.BUCKETS))
    pages = ["<!--" * 50_000, "<script>" * 50_000, "<" * 200_000, "<p>abc<!-- x --><b class='q'>d</b><script>no</script> 1 < 2 e"]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, text string")
    start = time.time()
    got = {r.id: r.grams for r in language.text_evidence(df, model, markup=True).collect()}
    assert time.time() - start < 30 and got[0] == got[1] == 0 and got[3] == len(language.trigrams(" abc d  1 < 2 e"))


def test_pages_edge_rows(spark):
    rows = [(1, None, None), (2, "x", ""), (2, "x", ""), (None, "http://a/b", "<p>t"), (3, "http://a/b", "<p>" + "w " * 200_000)]
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], "page_id long, url string, html string, text string, noise string")
    got = html.extract(df).collect()
    assert sorted((str(r.page_id), r.text[:3], len(r.text)) for r in got) == sorted(
        [("1", "", 0), ("2", "", 0), ("2", "", 0), ("None", "t", 1), ("3", "w w", 399_999)])
    assert html.extract(df.filter("false")).collect() == []


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = F.col("doc_id") % 2 == 1
    model = language.train(docs.filter(odd), rows=60)
    rows = docs.filter(~odd).select("doc_id", "text", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"),
                                    F.lit(None).cast("string").alias("declared"), F.col("lang").alias("truth"))
    got = language.identify(rows, model).collect()
    assert len(got) == rows.count()
    right = sum(r.lang == r.truth for r in got) / len(got)
    assert right >= 0.93, right


def test_evidence_is_fused(spark):
    rng = np.random.default_rng(1)
    model = np.log(rng.dirichlet(np.ones(language.BUCKETS), 4))
    rows = [(1, "", "h", "com", "de"), (2, None, None, None, None), (3, "12 34", "h", "de", "fr"), (4, "q", "h", None, None)]
    rows += [(100 + i, "abc def", "french.example", "com", "fr") for i in range(300)] + [(500, "abc def", "french.example", "com", None)]
    df = spark.createDataFrame([(*r, "?") for r in rows], "id long, text string, host string, suffix string, declared string, said string")
    even = np.log(np.full((4, language.BUCKETS), 1 / language.BUCKETS))
    got = {r.id: r for r in language.identify(df, even).collect()}
    assert len(got) == len(rows)
    assert {got[i].lang for i in (1, 2, 3)} == {language.NONE} and got[1].confidence == 0.0
    assert got[500].lang == "fr"  # the text says nothing; the host's other pages do
    assert language.identify(df.filter("false"), model).collect() == []


def test_language_edge_rows(edge, none):
    model = language.train(edge)
    rows = edge.toDF(*[f"x{i}" if c != "text" else "text" for i, c in enumerate(edge.columns)])
    rows = rows.select(F.col("x0").alias("score0"), "text", F.col("x3").alias("host"), F.lit(None).cast("string").alias("suffix"),
                       F.col("x2").alias("declared"))
    got = language.identify(rows, model).collect()
    assert len(got) == len(EDGE)
    assert all((r.lang == language.NONE) == (not re.search(r"[^\W\d_]", t or "")) for r, t in (
        (r, dict(EDGE[:5]).get(r.score0, "x")) for r in got if r.score0 in (1, 2, 3, 4)))
    assert np.allclose(language.train(none), -np.log(language.BUCKETS))


def test_hosts():
    assert urls.LOWER == urls.UPPER.lower()


def test_names_are_matched_whole():
    for name in ("page no-sidebar", "layout with-sidebar", "elementor-widget-text-editor", "share-price", "non-ad", "download"):
        assert text(f"<body><div class='{name}'><p>Story</p></div></body>") == "Story", name
        assert text(f"<article><p>a</p><p class='{name}'>Story</p></article>") == "a\nStory", name
    for name in ("sidebar", "sidebar-left", "x site-header", "cookie-notice", "ad-slot-3", "comment_list"):
        assert text(f"<body><div class='{name}'><p>no</p></div><div><p>Story</p></div></body>") == "Story", name


def test_text_beside_teaser_articles_stays():
    page = "<body><div class='text'><p>A long story told in full.</p></div><article><p>Teaser</p></article><div class='ad'>{}</div></body>"
    assert text(page.format("x" * 500)) == "A long story told in full.\nTeaser"


def test_the_tree_overrules_names_and_keeps_what_stands_outside_articles(spark, monkeypatch):
    rows = [(i, f"http://a.example/{i}", f"<body><div class='top'>Site</div><div class='widget'><p>Story {i} tells of {i * 7}.</p></div></body>")
            for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", f"<body><p class='low'>All rights</p><p class='own'>Fact {i}</p><div class='ad'><p>Buy {i * 3}</p></div>"
              f"<article><p>A teaser of some length, number {i}</p></article></body>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (html.BROADCAST_NODES, -1):
        monkeypatch.setattr(html, "BROADCAST_NODES", limit)
        got = {r.page_id: r.text for r in html.extract(df).collect()}
        assert got == ({i: f"Story {i} tells of {i * 7}." for i in range(20)}
                       | {100 + i: f"Fact {i}\nA teaser of some length, number {i}" for i in range(20)})


def test_language_model_counts_every_text(spark):
    """More texts of a language than any fixed number: the model and the floors are those of a plain loop over all."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefg "), 12)) + "x" for _ in range(1500)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    table = np.ones(language.BUCKETS)
    for t in texts:
        table += np.bincount(language.trigrams(t), minlength=language.BUCKETS)
    model = language.train(docs)
    assert np.allclose(model[0], np.log(table / table.sum()))
    usual, _, spread = language.floors(docs, model)[0]
    said = [model[0, language.trigrams(t)] for t in texts]
    assert abs(usual - np.quantile([x.mean() for x in said], 0.05, method="lower")) <= 0.001
    assert abs(spread - np.sqrt(np.mean([x.var() for x in said]))) < 1e-3
