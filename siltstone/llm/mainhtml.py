"""Operator 3, the main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags. First pass: each block adds up
evidence. Long prose with many stop words speaks for it, a high share of linked
characters against it; the names of elements, roles, classes and ids are features
beside these: for a block in an article or main element, against one outside it,
against one in a menu, header, footer, sidebar, notice, advert, form or reader
comments. A heading that repeats the page's title speaks for, a copyright line
and a place before that heading against. What comes to ``SURE`` or more is text, to ``-SURE`` or less is not, the rest
(short or mixed blocks) stays open. Second pass: an open block takes the label of its
nearest decided neighbours, the better one if they are equally near. A step into
another section, over the start of a heading or of a copyright line counts as
``FAR`` more. Where nothing is
decided to be text, open blocks are text.

Scripts, styles, form controls and what a page hides are never blocks.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

#: Characters of a block that is long enough to be judged, and of a long one.
SHORT, LONG = 70, 200
LINKS, STOP_LOW, STOP_HIGH = 0.4, 0.1, 0.2
#: Evidence that decides a block; of links, of a sign, of standing in the article, outside it, and before the heading that repeats the title.
SURE, LINKED, SIGN, INSIDE, OUTSIDE, EARLY = 2, -3, -4, 2, -4, -2
#: Blocks that a step over a boundary counts as.
FAR = 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noframes xmp noembed".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul option select textarea button".split()
)
_NEVER = frozenset("head script style noscript template iframe button select option textarea label input svg math canvas object title noframes audio video".split())
_APART = frozenset("nav footer aside form dialog menu fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_SIGNS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored sponsors promo promos promotion promoted sidebar sidebars comment comments commentlist "
    "disqus replies respond cookie cookies consent gdpr notice notices notification notifications alert alerts banner banners popup modal overlay menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead share sharing social related recommended recommendations newsletter subscribe subscription paywall login signup signin search toolbar pagination pager "
    "widget widgets disclaimer skip".split()
)
_OF_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related".split())
_ROOTS = frozenset(("html", "body", "main"))
_WORD = re.compile(r"[^\s_-]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was be with as by this are from at or an not have has i you he she they we his her their but which will would there been can "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou mais comme "
    "el los las y del se por con una su para es al lo como más o pero sus le ha me si sin sobre este ya entre".split()
)


#: How an element's names speak of its content: not at all; a part of a class or id does, as of a layout's wrapper; a whole class or id does; the element's name or role does; it isn't shown.
NOTHING, PART, CLASS, NAME, UNSEEN = range(5)
_COLOPHON = re.compile(r"\s*(?:©|\(c\)\s|copyright\b)|.{0,60}\ball rights reserved\b", re.I | re.S)


def sign(name: str, attrs: str, in_article: int) -> int:
    """What an element's name, role, class and id say against its content."""
    if name in _NEVER:
        return UNSEEN
    found = NAME if name in _APART or name == "header" and not in_article else NOTHING
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return found
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return UNSEEN
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return UNSEEN
        if key == "role" and value.lower() in _ROLES:
            found = max(found, NAME)
        if key in ("class", "id") and name not in _ROOTS:
            signs = {w.lower() for w in _WORD.findall(_CAMEL.sub(" ", value))}
            if signs & (_OF_ARTICLE if name == "article" else _SIGNS):
                found = max(found, CLASS if name == "article" or not _SIGNS.isdisjoint(value.lower().split()) else PART)
    return found


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    article: int  # 1 in an article or main element, 2 in one whose wrapper has a sign in a part of its class or id
    sign: int
    heading: bool
    section: int


def blocks(html: str) -> tuple[str, list[Block]]:
    """The page's title, and its blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool, int]] = []  # name, sign, in an article, in its header, section
    parts: list[str] = []
    title = ""
    linked = links = sections = 0
    mark = article = section = 0
    head = heading = False

    def end_block():
        nonlocal parts, linked, heading
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, article, mark, heading, section))
        parts, linked, heading = [], 0, False

    def close(to: int):
        nonlocal mark, article, head, links, section
        links -= sum(1 for s in stack[to:] if s[0] == "a")
        del stack[to:]
        mark, article, head, section = (stack[-1][1:]) if stack else (0, 0, False, 0)

    def say(text: str):
        nonlocal linked, heading
        if mark == UNSEEN:
            return
        titled = any(s[0] in _HEADINGS for s in reversed(stack))
        if head and not titled:
            return
        text = unescape(text)
        parts.append(text)
        heading = heading or titled and not text.isspace()
        if links:
            linked += len(text)

    at, size = 0, len(html)
    while at < size:
        found = html.find("<", at)
        if found < 0:
            say(html[at:])
            break
        if found > at:
            say(html[at:found])
        m = _TOKEN.match(html, found) or _LOOSE.match(html, found)
        if not m:
            say("<")
            at = found + 1
            continue
        at = m.end()
        if not m.lastindex or m[2] is None:
            continue
        name = m[2].lower()
        if name in _BLOCK:
            end_block()
        elif name == "br":
            parts.append("\n")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in _RAW:
            tail = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            if name == "title" and not title:
                title = " ".join(unescape(html[at : tail.start() if tail else size]).split())
            at = size if not tail else html.find(">", tail.start()) + 1 or size
            continue
        if name in _VOID:
            continue
        if name in _BLOCK:  # an open paragraph ends here, an open list item at the next
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
            if name in ("li", "dt", "dd", "tr", "td", "th"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name or name in ("dt", "dd") and stack[k][0] in ("dt", "dd"):
                        close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "tr" if name != "tr" else "table"):
                        break
        attrs = m[3] or ""
        opens = name in ("article", "main") or ("=" in attrs and re.search(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b", attrs, re.I) is not None)
        inside = article or int(opens)
        own = sign(name, attrs, article)
        if own and name not in _BLOCK:
            own = UNSEEN  # within a line: no block of its own
        now = max(mark, own)
        if inside and not article and mark == PART and not own:
            now, inside = NOTHING, 2
        place = section
        if own or opens and not article:
            sections += 1
            place = sections
        stack.append((name, now, inside, head or name == "header" and bool(article), place))
        if name == "a":
            links += 1
        if attrs.endswith("/") and name in ("svg", "path"):
            close(len(stack) - 1)
            continue
        mark, article, head, section = stack[-1][1:]
    end_block()
    return title, out


def prose(text: str, linked: int) -> int:
    """Evidence of a block's length, stop words and links, whatever its tags are."""
    density = linked / max(1, len(text))
    if density > LINKS:
        return LINKED
    if len(text) < SHORT:
        return 0
    words = text.split()
    stop = sum(w.lower().strip(".,;:!?\"'()*&%$#") in STOP_WORDS for w in words) / len(words)
    if stop >= STOP_HIGH and (len(text) >= LONG or density == 0):
        return SURE
    return 1 if stop >= STOP_LOW else -1 if len(text) >= LONG and density > 0 else 0


def colophon(b: Block) -> bool:
    return not b.article and len(b.text) < 2 * LONG and _COLOPHON.match(b.text) is not None


def first_pass(title: str, found: list[Block]) -> list[int]:
    """1 text, 0 not, -1 open."""
    sure = min((b.article for b in found if b.article and b.sign < CLASS), default=0)
    titled = next((k for k, b in enumerate(found) if b.heading and len(title) > 2 and (b.text.startswith(title) or title.startswith(b.text))), -1)
    evidence, own = [], []
    for k, b in enumerate(found):
        e = p = prose(b.text, b.linked)
        if k == titled:
            e += SURE
        elif colophon(b):
            e += SIGN
        elif k < titled and not b.article:
            e += EARLY
        if sure:
            e += INSIDE if b.article == sure else OUTSIDE
        if b.sign:
            e += SIGN
        evidence.append(e)
        own.append(p)
    if max(evidence, default=0) < SURE:  # a class or id alone doesn't hide all prose that a page has
        doubted = {b.section for p, b in zip(own, found) if p >= SURE and b.sign in (PART, CLASS)}
        evidence = [e - SIGN if b.section in doubted and b.sign in (PART, CLASS) else e for e, b in zip(evidence, found)]
    return [1 if e >= SURE else 0 if e <= -SURE else -1 for e in evidence]


def second_pass(first: list[int], found: list[Block]) -> list[int]:
    """Labels without open ones, each scan carrying the nearest decided block along."""
    if 1 not in first:
        return [int(label != 0) for label in first]
    n, none = len(first), (10**9, 0)
    step = [1 + FAR * ((found[k].section != found[k + 1].section) + (found[k + 1].heading or colophon(found[k + 1]))) for k in range(n - 1)]
    before, after = [none] * n, [none] * n
    last = none
    for k in range(n):
        last = (0, first[k]) if first[k] >= 0 else (last[0] + step[k - 1] if k else last[0], last[1])
        before[k] = last
    last = none
    for k in range(n - 1, -1, -1):
        last = (0, first[k]) if first[k] >= 0 else (last[0] + step[k] if k < n - 1 else last[0], last[1])
        after[k] = last
    return [label if label >= 0 else max(b[1], a[1]) if b[0] == a[0] else min(b, a)[1] for label, b, a in zip(first, before, after)]


def main_text(html: str | None) -> str:
    title, found = blocks(html or "")
    labels = second_pass(first_pass(title, found), found)
    return "\n\n".join(b.text for b, label in zip(found, labels) if label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of ``pages`` (page_id, url, html).

    A null or empty page, and one without main text, has the empty text. Tags that
    aren't closed, or are cut off, end with their parent or the page. Null ids and
    URLs are kept, repeated rows all returned, other columns ignored. No rows give
    no rows.
    """
    tune(pages.sparkSession)
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=out)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
