import pytest

from tidegraph.llm import html

LONG = "An article of some length stands here, with all its words. " * 6


def text(page):
    p = html.Page(page)
    return p.text(p.best()) if p.best() else ""


def test_a_quote_that_never_ends():
    assert text('<div class="a><p>Hello world this is text</p></div>') == "Hello world this is text"
    assert text("<div class=x><p>One</p><p title='two>Two</p></div>") == "One Two"
    assert text('<div class="a b" data-x="1 > 0"><p>One</p></div><div') == "One"


@pytest.mark.parametrize("name", ["social-history", "widget-review", "comment", "ad"])
def test_an_article_in_a_part_named_like_a_notice(name):
    page = f'<body><header>Site name</header><div class="{name}"><p>{LONG}</p><div class="share-bar">share this</div><p class="ad">buy</p></div><div>imprint</div></body>'
    assert text(page) == LONG.strip()


@pytest.mark.parametrize("name", ["social-links", "widget", "comments", "cookie-notice"])
def test_notices_beside_an_article(name):
    box = f'<div class="{name}"><p>{LONG}</p><p>{LONG}</p></div>'
    assert text(f'<body><div class="post"><p>{LONG}</p>{box}<p>end <span class="share">x</span>of it</p></div>{box}</body>') == LONG + "end of it"


def test_ties_go_to_the_outer_then_the_first():
    assert html.Page("<body><div class=b><p>same</p></div><div class=a><p>same</p></div></body>").best() == "html>body>div.b".removeprefix("html>")
    assert html.Page("<div class=x>four<div class=y>four</div></div>").best() == "div.x"


def test_a_chosen_path_without_text_gives_way(spark):
    usual = '<body><div class="post"><p>article {0} goes here</p></div></body>'
    odd = f'<body><div class="post"><div class="share">share this</div></div><div class="other"><p>{LONG}</p></div></body>'
    rows = [(k, "http://a.org/", usual.format(k)) for k in range(5)] + [(9, "http://a.org/", odd)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == LONG.strip() and got[3] == "article 3 goes here"
