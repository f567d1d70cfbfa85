"""Operator 6, main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one scores each block: stop-word density, length and link density
speak for or against it, a mark of the article (`article`, `main`, those roles) around it is worth one point, a class or
id name that hints at boilerplate costs one (headings apart, which go with what follows). A text of middle length needs a
good neighbour or a mark beside its stop words, unless the page has no longer one. A block with enough points is good, one with too few bad, a short one mostly
open. Pass two gives every open block the label of its nearest decided neighbour, where leaving a container counts as
distance, and so does going past the beginning of a heading, which opens a part of the page; two sweeps do that. Menus,
footers, asides, forms (but for one that frames the page) and containers named as such are decided as they stand.

Marks of articles are believed as far as the densities bear them out: teasers with a fraction of the largest one's text
are not the article, and a mark is ignored where the text found by densities outside is far longer. Where it is believed,
blocks outside are bad, and open blocks inside hear only neighbours inside, and count as good if none is decided. Stop words
are English, German, French and Spanish ones; on pages that hardly have any, long blocks with few links count as text.

Edge cases: null or empty html gives an empty text; unclosed comments and scripts run to the end of the page; a tag with
an unclosed quote ends at its first `>`; very long pages are read whole, in time that grows with their length; an open block
as far from a good as from a bad neighbour is good; repeated rows each get their own result; an empty table gives no row; further
columns of the input are kept out of the result, save url. White space is what Python's str.split() splits at, character
references are those of HTML 5.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.memory import tidied

# Element names of HTML, words that mark boilerplate containers, frequent function words.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table tbody td tr ul li p span a button select svg object iframe canvas video audio map noscript label".split())
RAW_TAGS = ("script", "style", "textarea", "template", "noscript", "title", "iframe", "svg", "math", "xmp", "noembed", "noframes")
BOILERPLATE_TAGS = frozenset("nav footer aside menu dialog select button fieldset object canvas video audio map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of containers that are boilerplate where the whole name says so, alone or with words of place and form.
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners promo promos promoted promotion sponsor sponsored sponsors "
    "nav navbar navigation navi menu menus breadcrumb breadcrumbs pager pagination toolbar topbar masthead footer colophon copyright "
    "sidebar sidebars cookie cookies consent gdpr ccpa notice notices popup modal overlay newsletter subscribe subscription signup login signin paywall "
    "share sharing social related recommended recommendations comment comments commentlist commenters replies respond disqus skiplink".split()
)
PLACE_WORDS = frozenset(
    "area article articles bar big block blog body bottom box button buttons card cards col column component container content desktop email entry fixed floating footer form full global grid group header holder home icon icons image inline inner item items "
    "large left link links list main mini mobile module news new outer page pages panel panels popular post posts primary reader readers region right row rows secondary section sections site slot small sticky stories story strip text the this thread title top "
    "tower unit user users view web wide widget widgets wrap wrapper zone".split()
)
#: Of these, words of what a page is about: names that begin and end with such are not decided by a word between them.
CONTENT_WORDS = frozenset("article articles blog body content entry news page pages post posts stories story text thread".split())
#: Words that only cost a point where they are part of another name.
HINTS = BOILERPLATE_NAMES | frozenset("crumb crumbs paging foot rail widget widgets alert alerts register follow trending reply discussion search skip toc legal disclaimer".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an they you were her she there been one all we their has would when if so no "
    "der die das und in zu den von ist nicht mit des auf für sich dem ein eine im als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man "
    "le la les de des du et en un une que qui dans pour sur est pas par au aux avec ce il elle se ne plus son sa ses ou mais nous vous on leur cette sont ont été "
    "el los las del y que se por un una con no para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos es".split()
)
EDGES = ".,;:!?|&%#*$\"'()[]{}<>-_=+~/\\…“”„«»’"
#: Thresholds of pass one, in characters and shares; below NO_STOPS a long block, or a page, hardly has stop words.
SHORT, LONG, STOPS_GOOD, STOPS_NEAR, NO_STOPS, LINKS_MOST, LINKS_IN_ARTICLE = 70, 140, 0.20, 0.08, 0.03, 0.34, 0.66
#: Points from which a block is good, and up to which it is bad.
GOOD, BAD = 2, -1
#: Distance of leaving or entering a container in pass two, and of a heading from what comes before it.
BOUNDARY, BEFORE_HEADING = 2, 8
#: An article of less than this share of the largest one's text is a teaser; marks with less than the other of the text outside are ignored.
TEASER, BELIEVED = 0.2, 0.25
#: A form with this share of the page's text and an article or a heading in it is the page's frame, not a form to fill in.
FRAME = 0.5

# a tag: with quoted values without `<`; with any quoted values that something proper follows; or up to the first `>`
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:([^>\"']*(?:(?:\"[^\"<]*\"|'[^'<]*')[^>\"']*)*)>|([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')(?=[\s/>])[^>\"']*)*)>|([^>]*)>)|<[!?/][^>]*>",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    linked: int
    boilerplate: bool  # by the container that it stands in
    hints: int  # names of containers around it that cost a point
    article: int  # number of the marked article that it stands in, 0 outside
    form: int  # number of the form that it stands in, 0 outside
    heading: bool = False
    listed: bool = False
    gap: int = 0  # containers left and entered since the block before
    label: str = field(default="")
    why: str = field(default="")  # container, density or neighbour


def _hints(tag: str, attrs: str) -> tuple[bool, int, bool]:
    """Whether the element is a boilerplate container, the points that its names cost, and whether it marks an article."""
    given = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)} if attrs.strip(" /") else {}
    found = {k: v.lower() for k, v in given.items()}
    role = found.get("role", "")
    article = tag in ("article", "main") or role in ("article", "main") or found.get("itemprop") == "articlebody"
    bad = tag in BOILERPLATE_TAGS or bool(set(role.split()) & BOILERPLATE_ROLES) or "hidden" in found or found.get("aria-hidden") == "true"
    hint = 0
    if not bad and tag not in ("html", "body", "article", "main", "p", *HEADINGS):
        for name in f"{given.get('class', '')} {given.get('id', '')}".split():
            words = [w for x in _SPLIT.split(_CAMEL.sub("-", name).lower()) if (w := x.rstrip("0123456789"))]
            parts = set(words)
            if not parts & HINTS or parts & {"with", "has", "no", "without"}:  # `with-sidebar` describes a layout that has one
                continue
            told = [w for w in words if w in BOILERPLATE_NAMES or w in CONTENT_WORDS]
            bad = bad or parts <= BOILERPLATE_NAMES | PLACE_WORDS and bool({*told[:1], *told[-1:]} & BOILERPLATE_NAMES)
            hint = 1
    return bad, hint, article


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int, int]] = []  # tag, boilerplate, hints, article, form: each with what encloses it
    parts: list[str] = []
    linked = links = breaks = gap = articles = forms = 0
    outside = (False, 0, 0, 0)
    now = outside  # boilerplate, hints, article, form
    inside = ""  # the block-level tag that the text is in

    def close():
        nonlocal linked, breaks, gap
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, min(linked, len(text)), *now, inside in HEADINGS, inside in ("li", "td", "dd", "dt"), gap))
            gap = 0
        parts.clear()
        linked = breaks = 0

    at, low = 0, ""
    while True:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece)
            if not piece.isspace():
                breaks = 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                close()
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            close()
            inside = "" if m[1] else tag
        if not m[1]:
            attrs = m[3] if m[3] is not None else m[4] if m[4] is not None else m[5]
            closed = attrs.endswith("/")
            if tag in RAW_TAGS:
                if closed and tag in ("svg", "math"):
                    continue
                low = low or page.lower()
                end = low.find(f"</{tag}", at)
                if end < 0:
                    break
                at = low.find(">", end) + 1 or len(page)
                continue
            if tag == "a":
                links = 1
            if tag in CONTAINERS and not closed and not (tag in ("p", "li", "td", "tr", "a", "span") and not attrs.strip()):
                bad, hint, article = _hints(tag, attrs)
                if tag == "header" and not now[2]:
                    bad = True
                around = stack[-1][1:] if stack else outside
                if tag in ("p", "li", "td", "tr"):  # their end tags may be left out
                    while stack and stack[-1][0] == tag:
                        stack.pop()
                    around = stack[-1][1:] if stack else outside
                    if not bad and not hint:
                        now = around
                        continue
                elif tag not in ("a", "span"):
                    gap += 1
                if article and around[2]:
                    hint, article = hint + (tag == "article"), tag == "article" and any(t[0] == "main" for t in stack) and not any(t[0] == "article" for t in stack)
                    hint -= article  # an article in an article may be a reader's comment, one in `main` is the article
                articles += article
                forms += tag == "form"
                now = (around[0] or bad, around[1] + hint, articles if article else around[2], forms if tag == "form" else around[3])
                stack.append((tag, *now))
        else:
            if tag == "a":
                links = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    gap += sum(t[0] not in ("p", "li", "td", "tr", "a", "span") for t in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and tag in ("p", "a", "span", "li"):
                    break
            now = stack[-1][1:] if stack else outside
    close()
    return out


def _stops(text: str) -> tuple[int, int]:
    words = text.lower().split()
    return sum(w.strip(EDGES) in STOP_WORDS for w in words), len(words)


def classify(blocks: list[Block]) -> None:
    """Set the label of every block to good or bad."""
    stops = [_stops(b.text) for b in blocks]
    of_page = [(n, m) for b, (n, m) in zip(blocks, stops) if not b.boilerplate and len(b.text) >= SHORT]
    telling = sum(n for n, _ in of_page) >= NO_STOPS * sum(m for _, m in of_page)

    def points(b: Block, share: float) -> int:
        """What length, links and stop words say."""
        dense = b.linked / len(b.text)
        if dense > (LINKS_IN_ARTICLE if b.article else LINKS_MOST):
            return -3 if b.listed or not b.article else 0
        if len(b.text) < SHORT:
            return 0
        if not telling or share >= STOPS_GOOD:
            return 2 if len(b.text) >= LONG else 1
        return 1 if share >= STOPS_NEAR else 0 if share >= NO_STOPS else -1

    _forms(blocks, [points(b, n / m) + bool(b.article) for b, (n, m) in zip(blocks, stops)])
    own = [-4 if b.boilerplate else points(b, n / m) - min(b.hints, 2) * (not b.heading) - 3 * (not b.article and b.text.lower().startswith(("©", "copyright "))) for b, (n, m) in zip(blocks, stops)]
    size: dict[int, int] = {}  # text of each marked article, and of what densities find outside
    for b, p in zip(blocks, own):
        if not b.boilerplate and (b.article or p >= GOOD):
            size[b.article] = size.get(b.article, 0) + len(b.text)
    away = size.pop(0, 0)
    marked = {k for k, n in size.items() if n >= TEASER * max(size.values()) and max(size.values()) >= BELIEVED * away}
    open_to = [(b, p + (b.article in marked)) for b, p in zip(blocks, own) if not b.boilerplate and (not marked or b.article in marked)]
    good = GOOD if any(p >= GOOD for _, p in open_to) else GOOD - 1  # a page of short texts has its best ones
    for b, p in zip(blocks, own):
        if b.boilerplate or marked and b.article not in marked:
            b.label, b.why = "bad", "container"
            continue
        p += b.article in marked
        b.label, b.why = "good" if p >= good else "bad" if p <= BAD else "", "density"
    left, right = _nearest(blocks, range(len(blocks))), _nearest(blocks, range(len(blocks) - 1, -1, -1))
    for b, (n, x), (m, y) in zip(blocks, left, right):
        if b.label:
            continue
        b.why = "neighbour"
        found = {x, y} - {""} if n == m else {x if n < m else y} - {""}
        b.label = "good" if "good" in found or not found and b.article in marked else "bad"


def _forms(blocks: list[Block], points: list[int]) -> None:
    """Forms are boilerplate, unless one is the frame of the whole page."""
    text: dict[int, int] = {}
    for b, p in zip(blocks, points):
        if not b.boilerplate and (b.article or p >= GOOD):
            text[b.form] = text.get(b.form, 0) + len(b.text)
    telling = {b.form for b in blocks if b.article or b.heading}
    frames = {0} | {f for f, n in text.items() if f in telling and n >= FRAME * sum(text.values())}
    for b in blocks:
        b.boilerplate = b.boilerplate or b.form not in frames


def _nearest(blocks: list[Block], order: range) -> list[tuple[float, str]]:
    """Distance and label of the decided block before each one, in the order of the sweep; in an article, of one by densities inside."""
    out: list[tuple[float, str]] = [(float("inf"), "")] * len(blocks)
    away, label, article = float("inf"), "", None
    last = None
    for i in order:
        b = blocks[i]
        if last is not None:
            later = blocks[max(i, last)]
            away += 1 + BOUNDARY * later.gap + BEFORE_HEADING * later.heading
        last = i
        if b.article != article:
            article = b.article
            away, label = (float("inf"), "") if article else (away, label)
        out[i] = (away, label)
        if b.label and not (article and b.why == "container"):
            away, label = 0.0, b.label
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
