"""Operator 6: cuts against brute force, pages by example."""

import html
import random
import re
import time
from itertools import product

from hopglass.llm import pages

PAGE = """<!DOCTYPE html><html lang=en><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body class="main">
<header><h1>Site name of the year</h1><p>We write about many things every day of the week.</p></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site a better place for all of our readers.</p></div><div class=ad>Buy now, it is cheap and good for you and for all.</div>
<article><header><h1>Head &amp; line</h1></header><p><b>First   paragraph&nbsp;&#233;,<br>with <a href="x>y">a link</a> inside.<p>Second one: 1 &lt; 2.</p><!-- no --><ul><li>Point<li>Other point</ul>
<aside>Related: read this other very long story about something else entirely.</aside><table><tr><td>Cell one<td>Cell two</table><p hidden>Not shown at all, ever.</p><div>Plain text in a division, last of all.</div></article>
<section id="comments"><p>I think that this is a wonderful article, thank you so much!</p></section><form><p>Your name please, and your mail address.</p><input></form>
<div class="sidebar"><p>Subscribe to our letter and get the latest news every morning.</p></div><footer>&copy; Site, all rights reserved by the people who made it.</footer></body></html>"""
WANT = ["Head & line", "First paragraph é, with a link inside.", "Second one: 1 < 2.", "Point", "Other point", "Cell one", "Cell two", "Plain text in a division, last of all."]


def cost(keep, drop, edges, label):
    return sum(d if x else k for k, d, x in zip(keep, drop, label, strict=True)) + sum(c for a, b, c in edges if label[a] != label[b])


def test_least_cut_against_all_labellings():
    rnd = random.Random(1)
    for _ in range(150):
        n = rnd.randrange(1, 9)
        keep, drop = ([rnd.randrange(20) for _ in range(n)] for _ in range(2))
        edges = [(a, b, rnd.randrange(12)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]
        label = pages.least_cut(keep, drop, edges)
        assert cost(keep, drop, edges, label) == min(cost(keep, drop, edges, x) for x in product([False, True], repeat=n))


def test_a_page_with_everything_around_the_article():
    assert pages.main_blocks(PAGE) == WANT


def test_smoothness_carries_a_short_line_between_paragraphs():
    page = "<body><div>" + "<p>A paragraph that has quite a few words in it, so it is text.</p>" * 3 + "<p>Yes</p>" + "<p>Another paragraph with enough words to be the text of it.</p></div></body>"
    assert "Yes" in pages.main_blocks(page)


def test_no_article_element_and_odd_markup():
    assert pages.main_blocks("just text, no tags, but long enough to count as an article of some sort.") == ["just text, no tags, but long enough to count as an article of some sort."]
    for odd in ("", "   ", "<", "<p", "</p></div>", "<!-- open", "<script>x", "<a<b>c", "&#xZZ; &bogus;", "<p>" * 3000, "<div>" * 3000 + "x"):
        assert isinstance(pages.main_blocks(odd), list)
    deep = "<article>" + "<div>" * 400 + "deep text that goes on for a while, and then some more words." + "</div>" * 400 + "</article>"
    assert pages.main_blocks(deep) == ["deep text that goes on for a while, and then some more words."]


def test_hostile_markup_is_read_once():
    for page in ("<div data-x=" + '"a":' * 250_000, "<a " * 350_000, "<a '" * 250_000, "<!" * 500_000, "<!--" * 250_000, "<b \"" * 200_000 + ">x", "<script>" + "</script " * 120_000, "<i \">" * 150_000 + "'"):
        start = time.process_time()
        pages.blocks_of(page)
        assert time.process_time() - start < 4, page[:12]


def test_ends_of_tags():
    tags = lambda page: [page[slice(*x[:2])] for x in found(page)]

    def found(page):
        t, at = pages.Tags(page), 0
        while x := t.next(at):
            at = x[1]
            yield x

    assert tags('a<b c="x>y">d</b>') == ['<b c="x>y">', "</b>"]
    assert tags('<b c="x>y <i>z') == ['<b c="x>', "<i>"] and tags("<b c='x>y'") == ["<b c='x>"]
    assert tags("1 < 2 <3> <!DOCTYPE x><?y?><!-- <p> --><!-- open <p>") == ["<!DOCTYPE x>", "<?y?>", "<!-- <p> -->", "<!-- open <p>"]
    assert tags("<!-->a<b>") == ["<!-->", "<b>"] and tags("<b") == [] and tags("<! <b>") == ["<! <b>"]


def test_formulas_stay_in_their_sentence():
    page = "<article><p>Euler wrote that <math><mrow><msup><mi>e</mi><mi>x</mi></msup><mo>=</mo><mn>1</mn></mrow><annotation>e^x</annotation></math> holds for all of the numbers that he looked at.</p></article>"
    assert pages.main_blocks(page) == ["Euler wrote that ex=1 holds for all of the numbers that he looked at."]


def test_rows(spark):
    rows = [(1, "u", PAGE, "a", "b"), (2, None, None, "a", "b"), (3, "v", "", "a", "b"), (None, "u", PAGE, "a", "b"), (1, "u", PAGE, "a", "b"), (4, "w", "<article>" + "<p>word &amp; word.</p>" * 20_000 + "</article>", "a", "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string").repartition(3)
    got = sorted(map(tuple, pages.extracted(df).collect()), key=str)
    assert len(got) == 6 and got.count((1, "u", "\n\n".join(WANT), len("\n\n".join(WANT)), len(WANT))) == 2
    assert (2, None, "", 0, 0) in got and (3, "v", "", 0, 0) in got and next(r for r in got if r[0] == 4)[4] == 20_000
    assert pages.extracted(df.limit(0)).count() == 0


def test_given_pages_against_the_article_element(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in df.collect()}
    for r in pages.extracted(df).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", sources[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|h2|div|ul|li)\b[^>]*>", inside)]
        assert r["text"] == "\n\n".join(filter(None, parts)) and r["n_chars"] == len(r["text"])
