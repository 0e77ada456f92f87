import html
import re
import time

import pytest

from tessera.llm import html_text

BODY = "<p>First long paragraph of the article, with a good number of words in it.</p><p>Second one &amp; more of its words, as long as the first one is.</p>"
WANT = "First long paragraph of the article, with a good number of words in it. Second one & more of its words, as long as the first one is."


@pytest.mark.parametrize("page", [
    f"<body><nav><a href=x>Home</a></nav><article>{BODY}</article><footer>foot</footer></body>",
    f"<body><div class='menu'><ul><li><a href=x>m</a></ul></div><div id=content>{BODY}</div><div class='sidebar'><p>side words that are many, too</p></div></body>",
    f"<body><header><h1>Site</h1></header><main>{BODY}<section id='comments'><p>reader words</p></section></main><div class='cookie-notice'>we use</div></body>",
    f"<body>{BODY}<form>Name <input><button>Go</button></form><script>if (a<b) document.write('<p>no</p>')</script><style>p{{}}</style><!-- <p>no</p> --></body>",
    f"<div class='ad'>Buy this now, a long advert of many words.</div>{BODY}<aside>also</aside>",
    f"<article>{BODY}<div hidden>no</div><p style='display: none'>no</p></article><div role=navigation>x</div>",
    f"<ARTICLE>{BODY.replace('</p>', '')}<div class=\"share-buttons\">tweet</div>",
])
def test_the_article_alone(page):
    assert html_text.main_text(page) == WANT


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("<p>", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<b>b</b>c<br>d<p>e", "abc d e"), ("<p>x &am y &amp z&nbsp;&#233;&#x1F600;", "x &am y & z é\U0001f600"), ("<p>cut <a hre", "cut"), ("<ul><li>a<li>b</ul>", "a b"), ("a < b", "a < b")])
def test_small_pages(page, want):
    assert html_text.main_text(page) == want


HOSTILE = ["<", "<a ", "<a b='", "<a \">", "<a \">\"' ", "<div>", "<p><b>", "</p>", "<!--", "<script>", "<b></i>", "<b><p>", "<i><div><b></i>", "<table><tr>", "<li><b>", "&", "<h1><b>", "<a b=\"'\" c='>"]


@pytest.mark.parametrize("unit", HOSTILE)
def test_hostile_pages_take_time_by_their_length(unit):
    for page in (unit * (900_000 // len(unit)), unit * (450_000 // len(unit)) + ">" + "</i>" * 90_000, unit * 60_000 + "'"):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 10


def test_class_names_need_more_than_one_word():
    inside = "<p class='promo-code'>Enter the code at the till.</p><section class='social-history'><p>How people lived then, at length.</p></section>"
    links = "<div class='related-work'><a href=x>One more</a> <a href=y>Another</a></div><div class='social-share'>tweet this now</div>"
    got = html_text.main_text(f"<body><nav><a href=x>Home</a></nav><article>{BODY}{inside}{links}</article></body>")
    assert got == f"{WANT} Enter the code at the till. How people lived then, at length."


def test_whole_table_against_a_plain_reading(spark, sf):
    got = {r["page_id"]: r for r in html_text.op8_html(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        own = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", own).replace("<b>", "").replace("</b>", "")).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


@pytest.mark.parametrize(("old", "new"), [("<article>", "<div>"), ("<article>", '<div class="x1">'), ("<article>", "<section>"), ('class="ad"', 'class="adverts-box"'), ("<nav>", '<div role="navigation">')])
def test_other_names_give_the_same_texts(spark, sf, old, new):
    """Neither the article's element nor the spelling of the parts beside it decides: every page of the table."""
    tag, other = old.strip("<>").split()[0], new.strip("<>").split()[0]
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").distinct().collect():
        page = r["html"].replace(old, new)
        page = page.replace(f"</{tag}>", f"</{other}>") if old[0] == "<" else page
        assert html_text.main_text(page) == html_text.main_text(r["html"])


def test_nulls_and_empty(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "u", "<p>a"), (1, "u", "<p>a")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html_text.extracted(pages).collect()) == ["", "a", "a"]
    assert html_text.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 3])
def test_an_article_in_several_elements_is_whole(n):
    parts = [f"<article><p>Part {k} of the text, with a good number of words in it that all belong together.</p><p>It goes on here &amp; has a second paragraph.</p></article>" for k in range(n)]
    page = f"<body><nav><a href=x>Home</a></nav><div id=content>{''.join(parts)}</div><footer>foot</footer></body>"
    got = html_text.main_text(page)
    assert all(f"Part {k} of the text" in got for k in range(n)) and "Home" not in got and "foot" not in got
