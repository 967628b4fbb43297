import html as H
import re

import pytest

from chronoweave.llm.html import extract, lines, main_text, surges

ARTICLE = "<h1>Title &amp; more</h1><p>First <b>par</b>agraph &lt;kept&gt; with a <a href=x>link</a> and text that is long enough to rise.<p>Short.<ul><li>one<li>two</ul><table><tr><td>cell</td><td>next</td></tr></table><p>Last&nbsp;one.<br>New line</p>"
TEXT = "Title & more First paragraph <kept> with a link and text that is long enough to rise. Short. one two cell next Last one. New line"
AROUND = [
    "<header><a href=/>Site</a> a tagline of some words that go on and on for long enough to count as text</header>",
    "<nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>",
    "<div class='cookie-notice'>We use cookies for many reasons, all of them good, and would like you to agree to all of them.</div>",
    "<aside class=sidebar><p>Side text that is long enough to be taken for an article if only its length were looked at.</p></aside>",
    "<div id=ad-top class='ad banner'>Buy now! Buy now! Buy now! Buy now! Buy now! Buy now! Buy now! Buy now! Buy now!</div>",
    "<form action=/s><label>Search here for anything that you may want to find on this site</label><input name=q><button>Go</button></form>",
    "<script>var x = '</p><p>not text' + \"<div>\";</script><style>p{margin:0}</style><!-- <p>nothing</p> -->",
    "<section id=comments><h2>Comments</h2><div class=comment><p>A reader says so much that it would pass for an article by its length alone.</p></div></section>",
    "<footer>Copyright by somebody who reserves all of the rights that there are to be reserved, and more.</footer>",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div>{}</div>", "<div class='layout with-sidebar'><div role=main>{}</div></div>"])
@pytest.mark.parametrize("at", range(10))
def test_the_article_is_kept_wherever_it_stands(wrap, at):
    page = "<!DOCTYPE html><html><head><title>Not this</title></head><body>" + "".join(AROUND[:at]) + wrap.format(ARTICLE) + "".join(AROUND[at:]) + "</body></html>"
    assert main_text(page)[0] == TEXT


@pytest.mark.parametrize("inner", AROUND[2:8])
def test_what_stands_apart_inside_an_article_goes(inner):
    assert main_text(f"<article>{ARTICLE}{inner}</article>")[0] == TEXT
    assert main_text(f"<article><p>Before.</p>{inner}{ARTICLE}</article>")[0] == "Before. " + TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("   ", ""), ("plain &amp; text", "plain & text"), ("<p>a<b>b</b> c<br>d", "ab c d"), ("<article>x</article>", "x"), ("<div><p>open <div>never closed", "open never closed"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<script>never ends <p>x", ""), ("<p title='a > b'>q</p>", "q"), ('<p title="broken>q</p>', "q")],
)
def test_odd_pages(page, text):
    assert main_text(page)[0] == text


def test_very_long_pages():
    assert len(main_text("<article>" + "<p>some words</p>" * 20_000 + "</article>")[0]) == 20_000 * 11 - 1
    assert main_text("<div>" * 5_000 + "deep" + "</div>" * 5_000)[0] == "deep"


def test_surge_and_dive_points():
    assert surges([0, 0, 50, 60, 0, 70, 0, 0, 0, 10, 0], 3, 86) == [(2, 6)]
    assert surges([], 3, 86) == [] and surges([0, 0], 3, 0) == []


@pytest.mark.parametrize("wrap", ["{}", "<div class=content>{}</div>"])
def test_a_short_last_section_of_a_long_page_without_marks_is_kept(wrap):
    body = "<p>A paragraph with enough words to rise over the threshold of a window all by itself, as most of them do.</p>" * 60
    last = "A last section that is short beside the sixty paragraphs before it, but long enough to rise over the threshold."
    page = wrap.format(body + "".join(AROUND[4:5] * 3) + f"<p>{last}</p>")
    assert main_text(page)[0].endswith("as most of them do. " + last)


def test_lines_tell_links_from_text():
    found = lines("<p>ab <a href=x>cdef</a> gh</p><nav>menu</nav>")
    assert [(x.text, x.apart) for x in found] == [("ab cdef gh", False), ("menu", True)] and found[0].plain == 4


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = extract(pages).collect()
    assert len(rows) == pages.count()
    html = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        inner = re.search("<article>(.*?)</article>", html[r.page_id], re.S)[1]
        assert r.text == " ".join(H.unescape(re.sub("</?(p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")).split()) and r.n_chars == len(r.text)


def test_null_pages_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", None, "t", 5), (2, None, "<p>hello</p>", "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in extract(df).collect()) == [(1, "u", "", 0), (2, "", "hello", 5)]
    assert extract(df.limit(0)).collect() == []
