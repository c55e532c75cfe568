import hashlib
import random
import re
import zlib

import pytest

from tidegraph.llm import digests, html, licenses, media

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


EDGES = [(1, None), (2, ""), (3, "mit license word " * 8000), (None, "x y"), (4, "é z"), (4, "é z")]

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), places


def test_licenses_against_brute_force(spark, sf_dir):
    scanner, rng = licenses.Scanner(), random.Random(1)
    parts = ["MIT", "license", "License", "apache", "general", "public", " ", "-", "\n", "é", "gnu", "1", "the "]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        found = scanner.scan(t)
        assert (found["n_words"], found["base"]) == plain_base(t), repr(t)
    got = {r["doc_id"]: r for r in licenses.op3_license_scan(spark, sf_dir).collect()}
    for i, t in documents(spark, sf_dir):
        n, places = plain_base(t)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert {x for _, x in places} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    "text,parts,labels,permissive",
    [
        ("MIT", ["MIT"], {"mit"}, True),
        ("MIT OR GPL-2.0-only AND BSD-3-Clause", ["MIT", "GPL-2.0-only", "BSD-3-Clause", "and", "or"], {"mit", "gpl", "bsd"}, True),
        ("(MIT or Apache-2.0) and GPL-3.0 WITH Classpath-exception-2.0 */", ["MIT", "Apache-2.0", "or", "GPL-3.0", "Classpath-exception-2.0", "with", "and"], {"mit", "apache", "gpl"}, False),
        ("AND MIT", None, None, None),
        ("(MIT", None, None, None),
        ("MIT and", None, None, None),
    ],
)
def test_expressions(text, parts, labels, permissive):
    assert licenses.postfix(text) == parts
    if parts:
        assert licenses.evaluate(parts) == (frozenset(labels), permissive)


def test_license_edges(spark):
    got = licenses.scan(docs_of(spark, EDGES).selectExpr("*", "1 AS score", "2 AS labels")).collect()
    assert len(got) == 6 and {r["n_base"] for r in got if r["doc_id"] == 3} == {8000}
    assert licenses.scan(docs_of(spark, [])).count() == 0
    tag = licenses.summary(licenses.Scanner().scan("x\n// SPDX-License-Identifier: Apache-2.0 OR MPL-2.0\n"))
    assert tag["labels"] == "apache,mpl,permissive" and tag["n_base"] == 0


@pytest.mark.parametrize("kind", media.STORED)
def test_media_round_trip_and_carving(kind):
    rng = random.Random(kind)
    magic = media.automaton()
    for n in (1, 3):
        payload = bytes(rng.randrange(256) for _ in range(192 * n))
        stored = media.write(kind, payload)
        assert media.end_of(kind, stored, 0) == len(stored) and media.read_back(kind, stored) == payload
        assert media.sniff(stored, magic)[0] == (kind, 0, len(stored))
        assert media.sniff(b"BM RIFF text " + stored + b"tail BM", magic) == [(kind, 13, 13 + len(stored))]
        assert media.sniff(b"text " + stored[:-5], magic) == []


def test_media_against_the_contract(spark, sf_dir):
    got = {r["doc_id"]: r for r in media.op9_media_signatures(spark, sf_dir).collect()}
    for i, t in documents(spark, sf_dir):
        raw = t.encode()
        payload = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.write(r["feature"].split(",")[0], payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_media_edges(spark):
    stored = media.store(docs_of(spark, EDGES).selectExpr("*", "1 AS media", "2 AS detected"))
    seen = media.inspect(stored).collect()
    assert len(seen) == 6 and all(r["detected"] in media.STORED and not r["carved"] for r in seen)
    assert any(r["detected"] != r["declared"] for r in seen) or all(r["detected"] == r["declared"] for r in seen)
    odd = spark.createDataFrame([(1, None), (2, b""), (3, b"RIFF"), (4, b"GIF89a")], "k long, media binary")
    assert [r["detected"] for r in media.inspect(odd).collect()] == [None] * 4
    assert media.inspect(media.store(docs_of(spark, []))).count() == 0


def plain_digests(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1] or ""
        t = t or ""
        h = len(t) // 2
        new = t[: len(t) - h] + nxt[:h]
        a, b, c = (digests.digest(x.encode()) for x in (t, new, nxt))
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, digests.likeness(a, b), digests.likeness(a, c))
    return out


@pytest.mark.parametrize("rows_a_part", [4000, 17, 1])
def test_digests_against_brute_force(spark, sf_dir, rows_a_part, monkeypatch):
    rows = documents(spark, sf_dir)[: 200 if rows_a_part > 1 else 40] + [(100_000, None), (-5, "")]
    plain = digests.parts
    monkeypatch.setattr(digests, "parts", lambda d: plain(d, rows_a_part))
    got = {r["doc_id"]: tuple(r)[1:7] for r in digests.fingerprints(docs_of(spark, rows)).collect()}
    assert got == plain_digests(rows)


def test_digest_edges(spark):
    got = digests.fingerprints(docs_of(spark, [*EDGES, (None, "b c")]).selectExpr("*", "1 AS part", "2 AS h", "3 AS tail")).collect()
    assert len(got) == 7 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert digests.fingerprints(docs_of(spark, [])).count() == 0
    (one,) = digests.fingerprints(docs_of(spark, [(7, "abcdef")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1


def test_digest_tells_near_from_far():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    a = [rng.choice(words[:150]) for _ in range(400)]
    near = a[:390] + [rng.choice(words) for _ in range(10)]
    far = [rng.choice(words[150:]) for _ in range(400)]
    d = lambda w: digests.digest(" ".join(w).encode())
    assert digests.likeness(d(a), d(near)) > 0.8 > digests.likeness(d(a), d(far)) and digests.likeness(d(a), d(a)) == 1


def plain_article(page):
    if not page:
        return ""
    import html as entities

    body = page[page.index("<article>") + 9 : page.index("</article>")]
    body = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", body)
    blocks = re.split(r"</?(?:p|h1|h2|h3|li|ul|ol|div|table|tr|td)\b[^>]*>|<br/?>", body)
    return " ".join(x for b in blocks if (x := " ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split())))


def test_html_against_the_known_article(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in html.op1_html_consensus(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(got)
    for r in rows:
        assert got[r["page_id"]]["text"] == plain_article(r["html"]) and got[r["page_id"]]["n_chars"] == len(plain_article(r["html"]))


def test_html_parts_that_are_not_content():
    page = """<html><body class="ad-free"><header>Site</header><div class="menu"><a href=x>Home</a></div><div id="post-17" class="post17 wide">
    <h2>T&eacute;st &amp; co</h2><p>One<b>two</b> <i>three</i><p>four &lt;b&gt; five<ul><li>six<li>seven</ul><table><tr><td>eight<td>nine</table>
    <form>no</form><div class="comments"><p>never said</p></div><script>if (a < b) "</p>"</script><!-- <p>not --></div>
    <aside>side</aside><div class="cookie-notice">cookies</div></body></html>"""
    p = html.Page(page)
    assert p.best() == "html>body.ad-free>div.post"
    assert p.text(p.best()) == "Tést & co Onetwo three four <b> five six seven eight nine"


def test_consensus_outvotes_a_page(spark):
    usual = '<body><div class="text{0}"><p>article {0} goes here</p></div><div class="extra"><p>more</p></div></body>'
    odd = '<body><div class="text9"><p>short</p></div><div class="extra"><p>a box that is far longer than the article itself</p></div></body>'
    rows = [(k, f"http://a.org/{k}", usual.format(k)) for k in range(5)] + [(9, "http://A.org/9", odd), (10, None, None), (11, "nowhere", "plain text"), (12, "http://b.org", ""), (9, "http://A.org/9", odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS paths", "3 AS path")
    got = sorted((r["page_id"], r["text"]) for r in html.extract(pages).collect())
    assert got[-5:] == [(9, "short"), (9, "short"), (10, ""), (11, "plain text"), (12, "")] and got[0] == (0, "article 0 goes here")
    assert html.extract(pages.limit(0)).count() == 0


def test_a_very_long_page():
    page = "<body><article>" + "<p>some words &amp; more</p>" * 20_000 + "</article>" + "<div><p>" * 2000
    p = html.Page(page)
    assert len(p.text(p.best())) == 20_000 * 18 - 1
