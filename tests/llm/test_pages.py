"""Main text of pages: the tree against brute force, with and without its measure, and odd pages."""

import math
import resource
import time
from collections import defaultdict

from pyspark.sql import functions as F

from talewind.llm import style_tree
from talewind.llm.style_tree import Page, branch

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title&nbsp;%d</h1><p>First &amp; best %d<p>a &lt;tag&gt;
 here %d</article><div class="comments"><p>reader %d</p></div><script>var t="</p>";</script><footer>foot</footer></body>"""


def test_main_text(spark):
    rows = [(i, f"https://www.a.org/{i}", PAGE % (i, i, i, i), "x", "y") for i in range(6)]
    rows += [(10, None, None, "x", "y"), (11, "https://b.org/", "", "x", "y"), (12, "https://b.org/2", "<p>cut <b>off", "x", "y"), (12, "https://b.org/2", "<p>cut <b>off", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, low string")
    got = [(r.page_id, r.text) for r in style_tree.extract(pages).orderBy("page_id").collect()]
    assert got[:6] == [(i, f"Title {i}\n\nFirst & best {i}\n\na <tag> here {i}") for i in range(6)]
    assert got[6:] == [(10, ""), (11, ""), (12, "cut off"), (12, "cut off")]
    assert style_tree.extract(pages.limit(0)).count() == 0



def host_of(spark, htmls, host="c.org"):
    return spark.createDataFrame([(i, f"https://{host}/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").withColumn("host", F.lit(host))


def texts(pages):
    return [r.text for r in style_tree.extract(pages).orderBy("page_id").collect()]


def prior_alone(html):
    return style_tree.main_text(html, frozenset())


PLAIN = "<body><div><p>always the same menu</p></div><section><p>own text %d</p><p>and more of it, %d</p></section><div><div>all rights</div></div></body>"


def test_the_tree_cuts_what_repeats_under_plain_names(spark):
    htmls = [PLAIN % (i, i) for i in range(12)]
    assert prior_alone(htmls[3]) == "always the same menu\n\nown text 3\n\nand more of it, 3\n\nall rights"
    assert texts(host_of(spark, htmls)) == [f"own text {i}\n\nand more of it, {i}" for i in range(12)]


def test_the_tree_cuts_a_notice_among_an_articles_paragraphs(spark):
    htmls = [f"<article><h1>T {i}</h1><p>first {i}<p>Subscribe to our letter<p>last {i}</article>" for i in range(20)]
    assert "Subscribe" in prior_alone(htmls[0])
    assert texts(host_of(spark, htmls)) == [f"T {i}\n\nfirst {i}\n\nlast {i}" for i in range(20)]


def test_copies_of_one_article_are_no_notice(spark):
    htmls = [f"<nav>menu {i}</nav><article><h1>T</h1><p>the same article<p>on all pages</article>" for i in range(20)]
    assert texts(host_of(spark, htmls)) == ["T\n\nthe same article\n\non all pages"] * 20


def test_the_tree_keeps_a_varying_body_under_the_name_of_noise(spark):
    htmls = [f'<div class="header-widget"><p>{" ".join(f"w{i}x{k}" for k in range(60))}</p></div><div class="ad">buy {i}</div>' for i in range(20)]
    assert {prior_alone(h) for h in htmls} == {""}
    assert all(t.startswith(f"w{i}x0 ") and "buy" not in t for i, t in enumerate(texts(host_of(spark, htmls))))
    comments = [h.replace("header-widget", "comments") for h in htmls]
    assert set(texts(host_of(spark, comments))) == {""}


def test_importance_equals_the_entropies(spark):
    htmls = [f"<div><p>{'same' if i % 3 else i}</p></div><section><h2>s {i % 2}</h2>{'<p>x</p>' * (i % 4)}</section>" for i in range(12)]
    htmls = list(dict.fromkeys(htmls))  # equal pages count once
    got = {r.branch: r for r in style_tree.branch_importance(host_of(spark, htmls)).filter("text IS NULL").collect()}
    shown, sequences = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for i, h in enumerate(htmls):
        page = Page(h)
        for node, parent, _, verdict, _, text in page.blocks:
            shown[branch(node, verdict)][text].add(i)
            sequences[branch(node, verdict)][tuple(page.children.get(node) or page.children[parent])].add(i)
    squeezed = lambda names: (tuple(n for k, n in enumerate(names) if not k or n != names[k - 1]), len(names))
    assert set(got) == set(shown)
    for key, by_text in shown.items():
        m = len({i for pages in by_text.values() for i in pages})
        merged = defaultdict(set)
        for names, pages in sequences[key].items():
            merged[squeezed(names)] |= pages
        repeated = lambda groups: sum(len(g) * math.log(len(g)) for g in groups) / sum(map(len, groups)) / math.log(m)  # noqa: B023, E731
        assert got[key].pages == m
        assert math.isclose(got[key].measured, 0.9 * (1 - repeated(by_text.values())) + 0.1 * (1 - repeated(merged.values())))


def test_deep_and_unclosed_pages(spark):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    deep = "<div>" * 200_000 + "deep"  # a megabyte that is never closed
    assert prior_alone(deep) == "deep"
    assert len(style_tree.page_features(deep)[1]) == 4
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 250_000  # KB
    assert prior_alone("<p>a<svg><p>b<select><p>c<!-- open <p>d") == "a\n\nb\n\nc"
    assert prior_alone("<p>a<script>b<p>c") == "a"
    start = time.process_time()
    prior_alone("<p>a<svg><select>" * 60_000)  # a megabyte of tags that nothing closes
    assert time.process_time() - start < 10
    assert len(prior_alone("<p>" + "long " * 400_000)) == 1_999_999
    prior_alone("<center>" * 50_000 + "<dt></dt>" * 50_000 + "</ul>" * 50_000 + "<a '" * 50_001)
    assert texts(host_of(spark, [deep, "<p>&amp", "plain", "<"])) == ["deep", "&", "plain", "<"]


def test_long_lists_of_branches_are_joined(spark, monkeypatch):
    htmls = [PLAIN % (i, i) for i in range(12)]
    monkeypatch.setattr(style_tree, "BROADCAST_BYTES", -1)
    assert texts(host_of(spark, htmls)) == [f"own text {i}\n\nand more of it, {i}" for i in range(12)]
