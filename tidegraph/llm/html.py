"""HTML extraction by consensus host paths.

A page is read once into text blocks, each known by its containers. A container's score is the text that stands right
in it (in its paragraphs, not in containers inside), less what links hold; parts that aren't content by their tags or
roles (menus, headers, footers, sidebars, forms) score nothing, and parts that only words in their classes or ids name
a notice, advert, menu or the like score little. A class or an id names such a part if it has one of those words and
no others but words of layout (related-posts, but not related-work); those of headings and of words in a line name nothing, a span's or link's
only itself. The best container passes its score on: to the innermost article around it, and to a parent whose
text is spread over several of its containers. Every page votes for the path of the container so found, tags with their
first classes, digits left out. Votes are summed for each host in Spark; a second pass
takes from every page the containers of that of its own paths that has most of its host's votes.

Scale: the paths of pages are small rows, joined with the summed votes by host and path, of which all are kept; only
pages that are outvoted, with the path chosen for them, meet the pages again. Both joins leave the choice between
broadcast (by measured size) and a shuffled join, of which hot paths are split, to adaptive execution.

Defined results: null html and html without text give an empty string; a null or odd url belongs to an empty host;
repeated pages stay and vote each; pages of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?:(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|(?P<loose>[^>]*+)(?:>|\Z))""",
    re.S,
)
NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea iframe svg math object select title xmp".split())
CONTAINER = frozenset("html body article main section div td th table tbody tr center blockquote figure details dl ul ol".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split())
NOT_CONTENT = frozenset("nav header footer aside form menu button dialog head".split())
#: What text in a part that its words name a notice counts in a score: its container wins where there is hardly another.
DOUBTED = 0.05
#: Words in classes and ids of what isn't the article.
NOTICE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright footer header "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies share "
    "sharing sidebar social sponsor sponsored subscribe subscription toolbar widget disqus login signup search thread discussion respond".split()
)
#: Words of layout that may stand beside them; any other word makes a class or an id that of content.
LAYOUT_WORDS = frozenset(
    "area bar block body bottom box button buttons col column container content element field fixed float form global group header inline inner item items "
    "js left links list main menu module more nav outer overlay page pages pane panel post posts right row section site slot sticky tab text title top unit user wrap wrapper".split()
)
#: Words in classes and ids of an article's own container.
ARTICLE_WORDS = frozenset("article articlebody post entry story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The share of a parent's score below which a container isn't all of the article.
SPREAD = 0.75
SPLIT = re.compile(r"[^a-z]+")
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table html body article section main div".split())


def names_notice(value: str) -> bool:
    """Whether one of the names in a class or an id has words of notices and layout alone."""
    for name in value.split():
        of = {w for w in SPLIT.split(name) if w}
        if not NOTICE_WORDS.isdisjoint(of) and of <= NOTICE_WORDS | LAYOUT_WORDS:
            return True
    return False


def tag_of(path: str) -> str:
    return path.rsplit(">", 1)[-1].split(".")[0]


class Page:
    """blocks: (text, characters in links, containers' numbers, doubt) in page order; paths: of the containers.

    doubt is how far in the innermost part stands whose class or id names it a notice (the number of containers around
    and with it, and a half more if it is none itself): what is in such a part counts for little when containers are
    scored, and for nothing in a container that the part stands in.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, tuple[int, ...], float]] = []
        self.paths: list[str] = ["page"]
        self.articles: set[str] = set()
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, bool, tuple[int, ...], float]] = []  # tag, whether it counts, containers around and with it, doubt
        parts, links, linked = [], 0, 0
        counts, within, doubt = True, (0,), 0.0

        def flush():
            nonlocal links
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((text, links, within, doubt))
                parts.clear()
            links = 0

        def leave(to: int):
            nonlocal counts, within, doubt, linked
            if any(tag not in INLINE for tag, _, _, _ in stack[to:]):
                flush()
            linked -= sum(tag == "a" for tag, _, _, _ in stack[to:])
            del stack[to:]
            counts, within, doubt = stack[-1][1:] if stack else (True, (0,), 0.0)

        def put(text: str):
            nonlocal links
            if counts and text:
                text = entities.unescape(text)
                parts.append(text)
                if linked:
                    links += len(text.strip())

        at, n = 0, len(html)
        while at < n:
            m = TOKEN.search(html, at)
            put(html[at : m.start()] if m else html[at:])
            if not m:
                break
            at = m.end()
            if m["cdata"]:
                put(entities.unescape(m["cdata"]) and m["cdata"].replace("&", "&amp;"))
            if not m["tag"]:
                continue
            tag = m["tag"].lower()
            if m["end"]:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] != tag and not (tag in INLINE and stack[k][0] not in INLINE):
                    k -= 1
                if k >= 0 and stack[k][0] == tag:
                    leave(k)
                elif tag == "p":
                    flush()
                continue
            if tag == "br" or tag == "hr":
                parts.append(" ") if counts and parts else None
                if tag == "hr":
                    flush()
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else n
                continue
            if tag in CLOSES_P:
                k = len(stack) - 1
                while k >= 0 and (stack[k][0] in INLINE or stack[k][0] == "p"):
                    if stack[k][0] == "p":
                        leave(k)
                        break
                    k -= 1
            if tag in ENDS:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in STOPS:
                    if stack[k][0] in ENDS[tag]:
                        leave(k)
                        break
                    k -= 1
            if tag not in INLINE:
                flush()
            attrs = m["attrs"] if m["attrs"] is not None else m["loose"]  # a quote that never ends doesn't hide the tag's end
            first, fine, noticed, article = "", tag not in NOT_CONTENT, False, tag in ("article", "main")
            if attrs and attrs.strip("/ "):
                for name, a, b, c in NAMES.findall(attrs):
                    value = (a or b or c).lower()
                    name = name.lower()
                    if name == "class" and not first and value.split():
                        first = re.sub(r"\d+", "", value.split()[0])
                    if tag not in INLINE and tag not in HEADINGS and tag not in ("html", "body", "article", "main"):
                        noticed = noticed or names_notice(value)
                    elif tag in ("span", "a") and names_notice(value):  # a mark-up without a meaning of its own: a button or an advert in a line
                        fine = False
                    article = article or (name == "role" and value in ("main", "article")) or not ARTICLE_WORDS.isdisjoint(SPLIT.split(value))
                    if name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog"):
                        fine = False
                fine = fine and not HIDDEN.search(attrs)
            inner = within
            if tag in CONTAINER:
                step = f"{tag}.{first}" if first else tag
                self.paths.append(f"{self.paths[within[-1]]}>{step}" if within[-1] else step)
                inner = (*within, len(self.paths) - 1)
                if article and not noticed and tag not in ("html", "body"):
                    self.articles.add(self.paths[-1])
            if attrs.endswith("/") and tag not in CONTAINER and tag not in INLINE:
                continue
            deeper = doubt
            if noticed:
                deeper = len(inner) + (0.0 if tag in CONTAINER else 0.5)
            stack.append((tag, counts and fine, inner, deeper))
            counts, within, doubt = stack[-1][1:]
            linked += tag == "a"
        flush()

    def best(self) -> str:
        """The path of the container that holds most text of its own (a tie goes to the outer, then the first one), or of
        the one around it that the article fills."""
        scores: dict[str, float] = {}
        totals: dict[str, float] = {}
        named = any(not doubt and self.paths[k] in self.articles for _, _, within, doubt in self.blocks for k in within)
        for text, links, within, doubt in self.blocks:
            holder, in_article = within[-1], any(self.paths[k] in self.articles for k in within)
            for depth in range(len(within) - 1, -1, -1):  # lists, quotes and table parts count for what is around them
                holder = within[depth]
                tag = tag_of(self.paths[holder])
                if tag in ("div", "article", "main", "section", "body", "center", "page") or tag == "td" and not in_article:
                    break
            if doubt > depth + 1 or doubt and named:  # where a page names its article, notices are none
                continue
            score = (len(text) - 1.5 * links) * (DOUBTED if doubt else 1)
            scores[self.paths[holder]] = scores.get(self.paths[holder], 0.0) + score
            for path in {self.paths[k] for k in within[: depth + 1]}:
                totals[path] = totals.get(path, 0.0) + score
        scores = {p: s for p, s in scores.items() if s > 0}
        return self._filled(max(scores, key=lambda p: (scores[p], -p.count(">"))), totals) if scores else ""

    def _filled(self, path: str, totals: dict[str, float]) -> str:
        while tag_of(path) not in ("article", "main"):
            around = [path[:k] for k in range(len(path)) if path[k] == ">"]
            if article := next((p for p in reversed(around) if p in self.articles), None):
                path = article
            elif around and path not in self.articles and tag_of(around[-1]) not in ("body", "html", "page") and totals[path] < SPREAD * totals[around[-1]]:
                path = around[-1]
            else:
                break
        return path

    def text(self, path: str) -> str:
        """The text of all containers of a path, in page order."""
        chosen = {k for k, p in enumerate(self.paths) if p == path}
        inside = lambda within, doubt: any(k in chosen and doubt <= depth + 1 for depth, k in enumerate(within))
        return " ".join(t for t, _, within, doubt in self.blocks if inside(within, doubt))


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1))


def page_paths(pages: DataFrame) -> DataFrame:
    """page_key, host, path and best (is it the page's own best container's) of every path with text of every page."""

    def make():
        def f(batch):
            rows = []
            for key, host, html in zip(*(batch.column(c).to_pylist() for c in ("page_key", "host", "html"))):
                page = Page(html or "")
                best = page.best()
                rows += [(key, host, path, path == best) for path in {page.paths[k] for _, _, within, _ in page.blocks for k in within}]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], ["page_key", "host", "path", "best"])

        return f

    return common.map_batches(pages.select("page_key", "host", "html"), make, "page_key long, host string, path string, best boolean")


def outvoted(paths: DataFrame) -> DataFrame:
    """page_key and chosen, its host's leading path among the page's own, of the pages whose own best is another one."""
    votes = paths.where("best").groupBy("host", "path").agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("less"), "path")).alias("first")
    leading = paths.join(votes, ["host", "path"]).groupBy("page_key").agg(first, F.max(F.when(F.col("best"), F.col("path"))).alias("own"))
    return leading.select("page_key", F.col("first.path").alias("chosen"), "own").where("own IS NULL OR own <> chosen").drop("own")


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and path (of the containers it is from) for every row of pages."""
    pages = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"), host_of(F.col(url_column)).alias("host")
    ).withColumn("page_key", F.xxhash64("host", "html"))
    chosen = common.written(outvoted(common.written(page_paths(pages), "page-paths")), "page-chosen")
    joined = pages.join(chosen, "page_key", "left").select("page_id", "url", "html", "chosen")

    def make():
        def f(batch):
            texts, used = [], []
            for html, path in zip(batch.column("html").to_pylist(), batch.column("chosen").to_pylist()):
                page = Page(html or "")
                text = page.text(path) if path else ""
                if not text and (path := page.best()):
                    text = page.text(path)
                texts.append(text)
                used.append(path if text else "")
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(used, pa.string())], ["page_id", "url", "text", "path"])

        return f

    return common.map_batches(joined, make, "page_id long, url string, text string, path string")


def op1_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
