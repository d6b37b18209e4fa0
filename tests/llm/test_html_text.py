"""Main text against the markup the test pages are made of, and pages written by hand."""

import html
import re
import time

import pytest

from logweir.llm import queries
from logweir.llm.html_text import extract_main_text, main_text

SF_DIR = "/root/testdata/sf0.01"
FOREIGN = (
    '<html><head><title>T</title></head><body class="single-post"><header><h1>Site</h1><nav><a href=x>Home</a></nav></header>'
    '<div id=cookie-notice>We use cookies, ok? Yes.</div><div class="wrap"><div class="post-content"><h2>Title &amp; more</h2>'
    "<p>First para, with <b>bold</b> and <a href=u>link</a>.<p>Second&nbsp;one;\n unclosed<ul><li>item one<li>item two</ul>"
    '<div class="ad-slot">Buy now, cheap!</div><pre>x  y</pre></div><div class="comments"><p>I disagree with this, strongly, because of'
    " reasons. A very long comment here, really, it is so long.</p></div><aside>Related: a, b.</aside></div>"
    "<footer>&copy; 2020, all rights.</footer></body></html>"
)


def article(page):
    inside = page[page.index("<article>") + 9 :]
    inside = inside[: inside.find("</article>")] if "</article>" in inside else inside.split("<footer>")[0]
    blocks = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(block for block in blocks if block)


def test_pages(spark):
    pages = {row.page_id: row for row in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    found = queries.op8_html_text(spark, SF_DIR).collect()
    assert len(found) == len(pages)
    for row in found:
        assert row.text == article(pages[row.page_id].html) and row.n_chars == len(row.text) and row.url == pages[row.page_id].url


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (FOREIGN, "Title & more\nFirst para, with bold and link.\nSecond one; unclosed\nitem one\nitem two\nx y"),
        ("", ""), ("plain text only, no tags.", "plain text only, no tags."), ("<p>", ""), ("&lt;b&gt; <", "<b> <"), ("<a", ""), ("</p></div>", ""),
        ("<script>var a='<p>x</p>'", ""), ("<article><p>A.</p><script>x</script><form>f</form><p>B</p></article>", "A.\nB"),
        ("<div>" * 20_000 + "x y z." + "</div>" * 20_000, "x y z."),
        ("<main><p>One, two.</p></main><p hidden>no</p>", "One, two."),
        ("<article><header><h1>Head</h1></header><p>Body, text.</p><div class='comment'>No, no.</div></article>", "Head\nBody, text."),
    ],
)
def test_by_hand(page, text):
    assert main_text(page) == text


LEAD = "A short lead, of one line."
BODY = "".join(f"<p>Sentence {k}, which is somewhat longer, and goes on; it ends here.</p>" for k in range(8))
BODY_LINES = [f"Sentence {k}, which is somewhat longer, and goes on; it ends here." for k in range(8)]
TAIL = "A section at the end, of some length, with marks; and a full stop."


@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_all_of_an_article(around):
    """Title, lead and a second section stay when most text is in one inner container; what is marginal goes."""
    page = (
        f"<body><nav><a href=x>Home</a></nav><{around}><h1>T</h1><div class=lead>{LEAD}</div><div class=body>{BODY}</div>"
        f"<section class=end><p>{TAIL}</p></section><div class=share>Share, now.</div></{around}><footer>F, g.</footer></body>"
    )
    assert main_text(page).split("\n") == ["T", LEAD, *BODY_LINES, TAIL]


@pytest.mark.parametrize("share", [3, 8])
def test_sections_of_different_classes(share):
    page = f"<div><section class=one>{BODY}</section><section class=two>{BODY[: BODY.index('<p>Sentence 2')] if share == 3 else BODY}</section></div>"
    assert main_text(page).split("\n") == BODY_LINES + BODY_LINES[: 2 if share == 3 else 8]


def test_formulas_and_drawings():
    math = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding=t>x=2</annotation></semantics></math>"
    drawing = '<svg viewBox="0 0 1 1"><title>no</title><path d="M0"/><g><text x=1>Axis <tspan>label</tspan></text></g></svg>'
    icon = '<svg aria-hidden="true"><text>icon</text></svg>'
    page = f"<article><p>So {math} holds, {icon}as said.</p><figure>{drawing}</figure><p>End, here.</p></article>"
    assert main_text(page) == "So x = 2 holds, as said.\nAxis label\nEnd, here."


def test_table(spark):
    rows = [(1, None, "k", "old"), (2, "<p>A.</p>", "k", "old"), (None, "<p>A.</p>", "k", "old")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    found = extract_main_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "k", "", 0), (2, "k", "A.", 2), (None, "k", "A.", 2)], key=repr)
    assert extract_main_text(pages.limit(0)).count() == 0


ARTICLE = (
    '<html><body><nav class="menu"><a href="/">Home</a></nav><article><h1>T</h1><p>First text of the article, it is long enough. Yes.</p>%s'
    '<p>Last part of the text, also with words.</p><div class="comment-list"><p>Nice one, says a reader.</p></div>'
    '<div class="ad-slot">Buy now, it is cheap.</div><ul class="share-buttons"><li>Mail it.</li></ul></article></body></html>'
)


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ('<h2 id="related-work">Related work</h2>', "Related work"), ('<h2 id="search">Search</h2>', "Search"),
        ('<section id="social-impact"><p>Impact, it says.</p></section>', "Impact, it says."), ('<section id="copyright-law"><p>Law.</p></section>', "Law."),
        ('<div class="side-by-side"><p>Left. Right.</p></div>', "Left. Right."), ('<blockquote class="quote promotion">A quote.</blockquote>', "A quote."),
        # Names of menus and notices, and doubtful ones with the ratios of a menu.
        ('<div class="related-posts"><p>Another story, in short.</p></div>', None), ('<div id="newsletter">Get our mail. Weekly.</div>', None),
        ('<div class="social-things"><a href="/1">Tweet.</a> <a href="/2">Mail.</a></div>', None), ('<div class="search-again">Type here</div>', None),
    ],
)
def test_names_inside_an_article(part, text):
    lines = ["T", "First text of the article, it is long enough. Yes.", text, "Last part of the text, also with words."]
    assert main_text(ARTICLE % part) == "\n".join(line for line in lines if line)


@pytest.mark.parametrize("part", ["<desc>", "<title>", "<div class='side-note'>", "<p>a <svg>"])
def test_time_is_in_proportion_to_the_page(part):
    began = time.monotonic()
    main_text("<p>x y.</p>" + part * 40_000)
    assert time.monotonic() - began < 5
