import html
import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import cases
from pyspark.sql import functions as F

from quern.llm import htmltext
from quern.sources.tables import table


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def text_of(spark, *htmls, url="http://h/1"):
    return [r.text for r in htmltext.extracted(pages(spark, [(url, h) for h in htmls])).orderBy("page_id").collect()]


def test_article(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav><div class="ad">buy</div>
      <article><h1>A &amp;\n B</h1><p><b>one<br>two<p>three&nbsp;x<script>var t="</p>";</script></p><!-- c --><form>f</form><section id="comments"><p>no</p></section></article>
      <aside>side</aside><footer>foot</footer>"""
    assert text_of(spark, page) == ["A & B\n\none two\n\nthree x"]


def test_low_branches_go(spark):
    """Without an article element, what all pages of a host show alike goes and what differs stays."""
    some = [f"<body><div><div class=top>Welcome to our site</div><div class=box><h2>Summary</h2><p>story {chr(97 + i)} of it</p>{'<p>more</p>' * (i % 3)}</div></div></body>" for i in range(12)]
    found = text_of(spark, *some)
    assert all(t.startswith(f"Summary\n\nstory {chr(97 + i)} of it") for i, t in enumerate(found))
    assert text_of(spark, some[0])[0].startswith("Welcome")  # one page shows nothing about its host
    assert text_of(spark, *[some[0]] * 50)[0].startswith("Welcome")  # nor do equal ones


def test_tree_removes_what_no_list_names(spark):
    """Boxes of unknown names: those alike on most pages go, in an article too; one that differs stays, whatever it is called."""
    page = "<div class=zq>Same on <b>all</b> pages 12</div><article><p>own {0} text</p><div class=share-price>price of {0}</div><div class=qz><h3>Who we are</h3><p>The same lines</p></div></article><div class=kl>note on {0}</div>"
    names = [f"{a}{b}" for a in "abcdefg" for b in "abcdefg"]
    found = text_of(spark, *[page.format(n) for n in names])
    assert found == [f"own {n} text\n\nprice of {n}\n\nnote on {n}" for n in names]


def test_tree_of_the_domain(spark):
    """Hosts with one page each share a template."""
    rows = [(f"http://h{i}.site.org/", f"<div class=zq>One template for all of them</div><div class=x>story {chr(97 + i)}</div>") for i in range(20)]
    found = [r.text for r in htmltext.extracted(pages(spark, rows)).orderBy("page_id").collect()]
    assert found == [f"story {chr(97 + i)}" for i in range(20)]


def test_joined_and_broadcast_nodes_agree(spark):
    for sf in (cases.SF, "/root/testdata/sf0.01"):
        for meanings in (True, False):
            one, two = (htmltext.extracted(table(spark, sf, "pages"), meanings, most_broadcast=n) for n in (0, 10**6))
            assert cases.sorted_rows(one) == cases.sorted_rows(two)
    rows = [(f"http://h{i % 3}.site.org/", f"<div class=zq>One template for all of them</div><div class=x>story {chr(97 + i)}</div>") for i in range(20)]
    assert [r.text for r in htmltext.extracted(pages(spark, rows), most_broadcast=0).orderBy("page_id").collect()] == [f"story {chr(97 + i)}" for i in range(20)]


def test_tree_alone(spark):
    """With the lists off, the tree alone finds the article on most pages."""
    made = htmltext.extracted(table(spark, "/root/testdata/sf0.1", "pages"), meanings=False).select("page_id", "text")
    whole = htmltext.op5_html_text(spark, "/root/testdata/sf0.1").select("page_id", F.col("text").alias("want"))
    assert made.join(whole, "page_id").agg(F.avg((F.col("text") == F.col("want")).cast("int"))).first()[0] > 0.9


def test_names_inside_an_article(spark):
    """Only whole names decide: parts of names lose nothing, and an unclosed button ends at the next block."""
    page = "<article><p class=share-price>one</p><div class='notice-board'>two</div><section id=related-work>three</section><button>press<p>four</p><div class='x comments'>five</div><form>six</form></article><form><article>seven</article></form>"
    assert text_of(spark, page) == ["one\n\ntwo\n\nthree\n\nfour\n\nseven"]


def test_omitted_tags():
    wrapped, bare = htmltext.Page("<html><head><title>T</title></head><body><div class=a>x</div></body></html>"), htmltext.Page("<title>T</title><div class=a>x</div>")
    assert wrapped.keys[-1] == bare.keys[-1] and htmltext.Page("<head><title>T</title><p>x").text(set()) == bare.text(set()) == "x"


def test_deep_pages():
    """Many nested elements, open tags that never end and end tags that never began: time and memory in proportion."""
    began = time.time()
    for html in ("<div>" * 20_000 + "deep", "<b>" * 20_000 + "<hr>" * 20_000 + "deep", "<p><button>" + "<b>" * 20_000 + "</i><hr>" * 20_000 + "deep", "<div class=a><p>" * 20_000 + "deep" + "</div>" * 20_000):
        assert htmltext.Page(html).text(set()) == "deep" and len(htmltext.parsed([html])["nodes"]) == 1
    assert time.time() - began < 20


HOSTILE = ["<a ", '<a b="', "<a b='", "<!--", "<!-->", "<", "</", "</a ", "<script>", "<script></scrip", "<a =", "<a b=c d", "<p class=x>", "<![CDATA[", "<?", "&", "&amp;", "&#", '<a "', "<title>", "<style><", "x<b>y</i>"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_parsing_time_grows_with_length(piece):
    began = time.time()
    htmltext.Page(piece * (1_000_000 // len(piece))).text(set())
    htmltext.Page("<a" + "\n" * 500_000 + "<p style='display" + " " * 500_000).text(set())
    assert time.time() - began < 15


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*HOSTILE, ">", "/>", '"', "'", " ", "x", "<p>", "</p>", "-->", "--!>", "<b c=1 c='2'>", "<br/>", "<div/>", "</script>", "<svg>", "&lt;", "&#x41;", "\x00"]), max_size=30))
def test_any_markup(pieces):
    """Nothing fails, and the quick way through common tags and the general one agree."""
    html = "".join(pieces)
    page = htmltext.Page(html)
    quick, htmltext.PLAIN = htmltext.PLAIN, re.compile("(?!)")
    quick_end, htmltext.PLAIN_END = htmltext.PLAIN_END, re.compile("(?!)")
    try:
        slow = htmltext.Page(html)
    finally:
        htmltext.PLAIN, htmltext.PLAIN_END = quick, quick_end
    assert (page.keys, page.above, page.says, page.looks, page.pieces) == (slow.keys, slow.above, slow.says, slow.looks, slow.pieces)


@pytest.mark.parametrize(
    "html,want",
    [
        ("a<!-- b > c -->d<!-->e<!--->f<!-- g --!>h<!x>i<?y>j</ z>k", "adefhijk"),
        ("a<b title='x>y' class=z>c</b>d<p", "acd"),
        ("a <b", "a"),
        ("1 < 2 <3 <= 4", "1 < 2 <3 <= 4"),
        ("<p class=\"x\" class=\"ad\">one<p class='ad' class=x>two", "one"),
        ("<p>a<p hidden>b<p style='Display : none'>c<div style=\"visibility:hidden\"><p>d</div><p style='color:red'>e", "a\n\ne"),
        ("<article>a<ol class=commentlist><li>b</ol><div class='comments-area x'><div class=comment-body>c</div></div><div class=commentary>d</div></article>", "a\n\nd"),
        ("a<label for=q>Your name</label><input id=q><select><option>b</select>", "a"),
        ("&#0065;&#x00042;&#" + "9" * 5000 + ";&#xFFFFFFFFFFFF;&copy &unknown; &#150;", "AB\ufffd\ufffd© &unknown; –"),
        ("a<script>if (x < y) '</p>'</script >b<STYLE>c</Style>d<textarea><p>e</textarea>f", "abdf"),
        ("a<script>never closed <p>b", "a"),
        ("<div/>a<br/>b<svg><text>c</text></svg>", "a b"),
    ],
)
def test_markup(html, want):
    assert htmltext.Page(html).text(set()) == want


def test_importances(spark):
    """style_tree() against a plain computation of both entropies, to the base of the number of pages."""
    rnd = random.Random(9)
    rows = [(s, p, k, rnd.randrange(3), rnd.choice([None, 1, 2, p]), k % 2 == 0) for s in ("a", "b.a") for p in range(12) for k in range(6) if rnd.random() < 0.7] + [("c", 1, 1, 1, 1, False)]
    found = htmltext.style_tree(spark.createDataFrame(rows, "site string, page long, key long, look long, content long, inside boolean"))
    got = {(r.site, r.key): (r.inside, r.pages, r.importance) for r in found.collect()}
    want = {}
    for site, key in {(r[0], r[2]) for r in rows}:
        mine = [r for r in rows if (r[0], r[2]) == (site, key)]
        m = len(mine)
        entropy = lambda xs: -sum(xs.count(x) / len(xs) * math.log(xs.count(x) / len(xs), m) for x in set(xs))  # noqa: B023, E731
        looks, texts = [r[3] for r in mine], [r[4] for r in mine if r[4] is not None]
        shared = [math.log(texts.count(x), m) if m > 1 else 0.0 for x in set(texts)]  # of each distinct text
        of_look = entropy(looks) if m > 1 else 1.0
        of_text = 1 - sum(shared) / len(shared) if texts and m > 1 else float(bool(texts))
        want[site, key] = (mine[0][5], m, 1 - (1 - of_look) * (1 - of_text))
    assert got.keys() == want.keys()
    for k, (inside, m, importance) in want.items():
        assert got[k][:2] == (inside, m) and got[k][2] == pytest.approx(importance, abs=1e-9)


def test_the_tree_changes_the_result(spark):
    """Boilerplate under names that no list has stays if only lists are asked, and goes by the tree; texts of the pages' own stay both ways."""
    rows = [("http://h.org/x", f"<main><div class=qx1>Follow our channel for news</div><div class=body7><p>Report {a}{b} of the day</p><p>By the desk in {b}{a}</p></div><div class=qx2><p>All rights are with the publisher</p></div></main>") for a in "abcdef" for b in "ghijkl"]
    by_tree = [r.text for r in htmltext.extracted(pages(spark, rows)).orderBy("page_id").collect()]
    by_lists = [r.text for r in htmltext.extracted(pages(spark, rows), trees=False).orderBy("page_id").collect()]
    own = [f"Report {a}{b} of the day\n\nBy the desk in {b}{a}" for a in "abcdef" for b in "ghijkl"]
    assert by_tree == own
    assert by_lists == [f"Follow our channel for news\n\n{t}\n\nAll rights are with the publisher" for t in own]


def test_whole_table(spark):
    """The pages' article elements, cut by plain patterns."""
    for r in htmltext.op5_html_text(spark, cases.SF).join(table(spark, cases.SF, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:h1|p|div)\b[^>]*>", article)
        want = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in want if b) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(None, None), ("http://h/1", ""), ("x", "plain < text & more"), ("http://h/2", "<div>" * 3000 + "deep"), ("http://h/2", "<div>" * 3000 + "deep"), ("http://h/3", "<article>" + "word " * 200_000)]
    frame = pages(spark, rows).withColumn("host", F.lit(1)).withColumn("removed", F.lit(2)).withColumn("text", F.lit(3))
    found = {r.page_id: r for r in htmltext.extracted(frame).collect()}
    assert (found[0].text, found[1].text, found[3].text, found[5].n_chars) == ("", "", "deep", 999_999) and found[2].text == "plain < text & more"
    assert htmltext.extracted(frame.limit(0)).count() == 0
