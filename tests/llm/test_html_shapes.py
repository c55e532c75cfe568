"""Articles in shapes that lose text easily, several pages a host, with the known article of each."""

import pytest

from tidegraph.llm import html

LINE = "words that a reader wants to have, all of them, {0}. " * 6


def shape(kind, k):
    """One page's body and its article's text."""
    a, b, c = (LINE.format(f"{name}{k}").strip() for name in ("first", "second", "third"))
    if kind == "sections":
        return f'<article><section class="lead"><p>{a}</p></section><section class="rest"><p>{b}</p></section></article>', f"{a} {b}"
    if kind == "parts of a div":
        return f'<div class="article"><div class="lead">{a[:40]}</div><div class="rest">{b} {c}</div></div>', f"{a[:40]} {b} {c}"
    if kind == "spread":
        return f'<div class="x"><div class="one">{a}</div><div class="two">{b}</div><div class="three">{c}</div></div>', f"{a} {b} {c}"
    if kind == "intro":
        return f"<main><p>Intro {k}</p><section><p>{a}</p></section><section><p>{b}</p></section></main>", f"Intro {k} {a} {b}"
    if kind == "cells":
        return f'<article><p>{a[:50]}</p><table><tr><td class="x">{b}</td><td class="y">y{k}</td></tr></table><p>{c[:30].strip()}</p></article>', f"{a[:50].strip()} {b} y{k} {c[:30].strip()}"
    if kind == "layout table":
        return f'<table><tr><td class="nav"><a href="/">home</a> <a href="/x">other things to read</a></td><td class="text"><p>{a}</p><p>{b}</p></td></tr></table>', f"{a} {b}"
    if kind == "words in ids":
        return f'<article><h1 id="search-trees">Trees {k}</h1><section id="related-work"><h2 id="related">Related</h2><p class="search-history">{a}</p></section></article>', f"Trees {k} Related {a}"
    if kind == "words in a line":
        return f'<article><p>{a} <em class="share">shared</em> and <span class="ad-hoc">more</span></p></article>', f"{a} shared and more"
    if kind == "thread":
        return f'<article><p>Short piece {k}.</p></article><div class="thread"><div class="c">{a} {b}</div><div class="c">{c}</div></div>', f"Short piece {k}."
    if kind == "notices inside":
        return f'<article><p>{a}</p><div class="related-posts"><p>{b}</p></div><div class="share-buttons">share it</div><aside>{c}</aside></article>', a
    raise ValueError(kind)


KINDS = ["sections", "parts of a div", "spread", "intro", "cells", "layout table", "words in ids", "words in a line", "thread", "notices inside"]


def page(body):
    return f'<html><head><title>t</title></head><body><nav><a href="/">home</a></nav>{body}<div class="footer">all rights kept by somebody, some terms of use</div></body></html>'


@pytest.mark.parametrize("kind", KINDS)
def test_one_page(kind):
    body, want = shape(kind, 1)
    read = html.Page(page(body))
    assert read.text(read.best()) == " ".join(want.split())


def test_hosts_of_several_pages(spark):
    rows, want = [], {}
    for h, kind in enumerate(KINDS):
        for k in range(4):
            body, text = shape(kind, k)
            rows.append((10 * h + k, f"https://h{h}.example/{k}", page(body)))
            want[10 * h + k] = " ".join(text.split())
    rows += rows[:3]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want


def test_ties_of_votes(spark):
    """Two paths with two votes each on one host: the first by name is taken where a page has both, else its own."""
    a, b = "<section class='a'><p>{}</p></section>", "<section class='b'><p>{}</p></section>"
    texts = [LINE.format(k).strip() for k in range(4)]
    rows = [(k, "https://one.example/", (a if k < 2 else b).format(t)) for k, t in enumerate(texts)]
    got = {r.page_id: (r.text, r.path) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: (t, "section.a" if k < 2 else "section.b") for k, t in enumerate(texts)}
