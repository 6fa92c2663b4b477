"""Parsers of text formats."""

from __future__ import annotations

import csv as csvlib
import io
import json as jsonlib
import re
from html.parser import HTMLParser

from .base import Failure, Parsed, check_size, xml_events


def encoding_of(data: bytes) -> str | None:
    for mark, name in ((b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if data.startswith(mark):
            return name
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return "UTF-8"


def line_count(text: str) -> int:
    return text.count("\n") + (0 if not text or text.endswith("\n") else 1)


def plain(data: bytes) -> Parsed:
    name = encoding_of(data)
    if name is None:
        raise Failure("the text's encoding isn't known")
    if name == "UTF-8":
        text = data.removeprefix(b"\xef\xbb\xbf").decode()
    else:
        body = data[2:]
        text = body[: len(body) // 2 * 2].decode(name, "replace")
    return text, {"character_count": len(text), "line_count": line_count(text), "encoding": name}


def _number(x) -> str:
    return jsonlib.dumps(x)


def json_text(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(map(json_text, value))
    if isinstance(value, dict):
        return "\n".join(f"{k}: {json_text(value[k])}" for k in sorted(value))
    return _number(value)


def json_sketch(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        return f"array[{json_sketch(value[0]) if value else ''}]"
    return f"object{{{', '.join(sorted(value))}}}"


def json(data: bytes) -> Parsed:
    def refuse(x):
        raise ValueError(f"{x} is no JSON number")

    try:
        value = jsonlib.loads(data.decode("utf-8"), parse_constant=refuse)
        return json_text(value), {"valid": True, "schema_info": json_sketch(value)}
    except (ValueError, RecursionError) as e:
        raise Failure(f"invalid JSON: {e}") from None


DELIMITERS = {",": "comma", ";": "semicolon", "\t": "tab", "|": "pipe"}


def delimiter(data: bytes) -> str:
    try:
        lines = data[:1024].decode().splitlines()[:10]
    except UnicodeDecodeError:
        return ","
    best, most = ",", 0
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines]
        score = counts.count(counts[0]) * counts[0] if counts else 0
        if score > most:
            best, most = d, score
    return best


def csv(data: bytes) -> Parsed:
    d = delimiter(data)
    try:
        text = data.decode().removeprefix("\ufeff")
    except UnicodeDecodeError as e:
        raise Failure(f"table isn't UTF-8: {e}") from None
    limit = csvlib.field_size_limit(1 << 30)
    try:
        rows = [r for r in csvlib.reader(io.StringIO(text, newline=""), delimiter=d) if r]
    except csvlib.Error as e:
        raise Failure(f"table: {e}") from None
    finally:
        csvlib.field_size_limit(limit)
    head = rows[0] if rows else []
    for k, r in enumerate(rows):
        if len(r) != len(head):
            raise Failure(f"record {k} has {len(r)} fields, the header {len(head)}")
    return "\n".join(", ".join(r) for r in rows), {"column_count": len(head), "row_count": max(0, len(rows) - 1), "headers": head, "delimiter": DELIMITERS[d]}


def xml(data: bytes) -> Parsed:
    parts: list[str] = []
    state = {"root": None, "text": ""}
    spaces: set[str] = set()

    def flush():
        t = state["text"].strip()
        if t:
            parts.append(t)
        state["text"] = ""

    def start(name, attrs):
        flush()
        state["root"] = state["root"] or name
        spaces.update(v for k, v in attrs.items() if k.startswith("xmlns"))

    def more(t):
        state["text"] += t

    xml_events(data, start, lambda _: flush(), more)
    meta: dict = {"root_element": state["root"]} if state["root"] else {}
    if spaces:
        meta["namespaces"] = sorted(spaces)
    return " ".join(parts), meta


class _Page(HTMLParser):
    """Visible text and metadata of a page, in one pass."""

    QUIET = frozenset(("script", "style"))
    HEADED = frozenset(("title", "meta", "link", "base", "head", "html"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.meta: dict = {}
        self.quiet = 0
        self.title: list[str] | None = None
        self.in_head = False
        self.headings = [0] * 6
        self.run: list[str] = []

    def flush(self):
        t = "".join(self.run).strip()
        if t:
            self.parts.append(t)
        self.run = []

    def handle_starttag(self, tag, attrs):
        self.flush()
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag in self.QUIET:
            self.quiet += 1
        if tag == "head":
            self.in_head = True
        elif tag == "body" or self.in_head and tag not in self.HEADED and tag not in self.QUIET and tag not in ("noscript", "template"):
            self.in_head = False
        if tag == "title" and "title" not in self.meta and self.title is None:
            self.title = []
        elif tag == "html" and "lang" in a:
            self.meta.setdefault("language", a["lang"])
        elif tag == "link" and a.get("rel") == "canonical" and "href" in a:
            self.meta.setdefault("canonical_url", a["href"])
        elif tag == "meta":
            self.of_meta(a)
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.headings[int(tag[1]) - 1] += 1

    def of_meta(self, a):
        content = a.get("content")
        name = a.get("name", "").lower()
        if content is not None:
            if name in ("description", "author", "keywords", "viewport", "robots"):
                self.meta[name] = content
            elif name.startswith("twitter:"):
                self.meta[name.replace(":", "_")] = content
            prop = a.get("property", "").lower()
            if prop.startswith("og:"):
                self.meta[prop.replace(":", "_")] = content
            if "http-equiv" in a:
                self.meta[f"http_equiv_{a['http-equiv'].lower()}"] = content
        if "charset" in a:
            self.meta["charset"] = a["charset"]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in self.QUIET:
            self.quiet -= 1

    def handle_endtag(self, tag):
        self.flush()
        if tag in self.QUIET and self.quiet:
            self.quiet -= 1
        if tag == "head":
            self.in_head = False
        if tag == "title" and self.title is not None:
            t = "".join(self.title).strip()
            if t:
                self.meta["title"] = t
            self.title = None

    def handle_comment(self, data):
        self.flush()

    def handle_data(self, data):
        if self.title is not None:
            self.title.append(data)
        elif not self.quiet and not self.in_head:
            self.run.append(data)


def html(data: bytes) -> Parsed:
    check_size(data, "text/html")
    page = _Page()
    page.feed(data.decode("utf-8", "replace"))
    page.close()
    page.flush()
    meta = page.meta | {f"heading_h{k}_count": n for k, n in enumerate(page.headings, 1) if n}
    return "\n".join(page.parts), meta


_CSS = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|@[-\w]+|url\(\s*[^)]*\)|[{};,]|[^\s{};,@\"'/]+|/|\s+", re.S | re.I)


def css(data: bytes, compat: bool = False) -> Parsed:
    """Counts of top-level rules and their selectors, and imports. ``compat`` counts as an analyser that never leaves the first block: one rule at most, and only the selectors before it."""
    check_size(data, "text/css")
    text = data.decode("utf-8", "replace")
    rules = selectors = depth = 0
    imports: list[str] = []
    prelude, importing, at_rule = False, False, False
    entered = False
    for m in _CSS.finditer(text):
        t = m[0]
        if t.isspace() or t.startswith("/*"):
            continue
        if compat and entered:
            continue
        if importing:
            importing = False
            if t[0] in "\"'":
                imports.append(t.strip("\"'"))
                prelude = False
                continue
            if t.lower().startswith("url("):
                imports.append(t[4:-1].strip().strip("\"'"))
                continue
        if t == "{":
            if depth == 0:
                rules += 1
                if prelude and not at_rule:
                    selectors += 1
                entered = True
            depth += 1
            prelude = at_rule = False
        elif t == "}":
            depth = max(0, depth - 1)
            prelude = at_rule = False
        elif t == ";":
            prelude = at_rule = False
        elif depth == 0 and t == ",":
            selectors += prelude and not at_rule
        elif t[0] == "@":
            importing = t.lower() == "@import"
            at_rule = depth == 0
        elif depth == 0 and t[0] not in "\"'":
            prelude = True
    if prelude and not at_rule and depth == 0:
        selectors += 1
    meta: dict = {"rule_count": rules, "selector_count": int(selectors)}
    if imports:
        meta["imports"] = ", ".join(imports)
    return text, meta


_RTF_SKIP = frozenset("* info fonttbl colortbl stylesheet title author subject creatim".split())
_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\([A-Za-z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)|[\r\n]", re.S)


def rtf_text(text: str) -> str:
    out: list[str] = []
    depth, skipped = 0, []
    first = False
    for m in _RTF.finditer(text):
        code, word, _, symbol, brace, run = m.groups()
        opening = first
        first = False
        if brace == "{":
            depth += 1
            first = True
        elif brace == "}":
            if skipped and skipped[-1] == depth:
                skipped.pop()
            depth = max(0, depth - 1)
        elif opening and (symbol == "*" or word in _RTF_SKIP):
            skipped.append(depth)
        elif skipped:
            continue
        elif code:
            out.append(bytes.fromhex(code).decode("latin-1"))
        elif word:
            out.append({"par": "\n", "line": "\n", "tab": "\t"}.get(word, ""))
        elif symbol:
            out.append(symbol if symbol in "\\{}" else "")
        elif run and depth:
            out.append(run)
    return "".join(out).strip()


def _group(text: str, name: str) -> str | None:
    """Inside of the first group that begins with a control word."""
    at = text.find("{\\" + name)
    if at < 0:
        return None
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if not depth:
            return text[at + len(name) + 2 : k]
    return None


def rtf(data: bytes) -> Parsed:
    check_size(data, "application/rtf")
    text = data.decode("utf-8", "replace")
    if not text.lstrip().startswith("{\\rtf"):
        raise Failure("no RTF header")
    meta: dict = {"encoding": "Windows-1252"}
    version = re.search(r"\{\\rtf(\d)", text)
    if version:
        meta["rtf_version"] = version[1]
    info = _group(text, "info")
    if info:
        for key in ("title", "author", "subject"):
            inside = _group(info, key)
            value = rtf_text("{\\rtf1 " + inside.strip() + "}") if inside and inside.strip() else ""
            if value:
                meta[key] = value
        made = info.find("{\\creatim")
        if made >= 0:
            date = [re.search(rf"\\{k}(\d+)(?=\D)", info[made:]) for k in ("yr", "mo", "dy")]
            if all(date):
                meta["creation_date"] = "{:04d}-{:02d}-{:02d}".format(*(int(d[1]) for d in date))
    return rtf_text(text), meta


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^ {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_IMAGE = re.compile(r"!\[((?:[^\[\]\\]|\\.|\[[^\]]*\])*)\]\((?:<[^>]*>|[^()\s]*(?:\([^()]*\)[^()\s]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
_LINK = re.compile(r"(?<!!)\[((?:[^\[\]\\]|\\.|\[[^\]]*\])*)\]\((?:<[^>]*>|[^()\s]*(?:\([^()]*\)[^()\s]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
_AUTO = re.compile(r"<([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w.-]+)>")


def _inline(text: str, counts: dict) -> str:
    codes: list[str] = []

    def code(m):
        inner = m[2].replace("\n", " ")
        codes.append(inner[1:-1] if len(inner) > 2 and inner[0] == inner[-1] == " " and inner.strip() else inner)
        return f"\0{len(codes) - 1}\0"

    def image(m):
        counts["image"] += 1
        return m[1]

    def link(m):
        counts["link"] += 1
        return m[1]

    text = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", code, text, flags=re.S)
    text = _IMAGE.sub(image, text)
    text = _LINK.sub(link, text)
    text = _AUTO.sub(link, text)
    text = re.sub(r"</?[a-zA-Z][^>]*>|<!--.*?-->", "", text, flags=re.S)
    text = re.sub(r"(?<![\\*])(\*{1,3})(?=\S)(.+?)(?<=\S)\1(?!\*)", r"\2", text, flags=re.S)
    text = re.sub(r"(?<![\\\w_])(_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", text, flags=re.S)
    text = re.sub(r"(?: {2,}|\\)?\n[ \t]*", " ", text)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)
    from html import unescape

    return re.sub("\0(\\d+)\0", lambda m: codes[int(m[1])], unescape(text))


def markdown(data: bytes) -> Parsed:
    """Block by block: headings and paragraphs as text, counts of headings, links, images and code blocks."""
    text = data.decode("utf-8", "replace").replace("\r\n", "\n")
    out: list[str] = []
    counts = {"link": 0, "image": 0, "code": 0}
    headings = [0] * 6
    title = None
    para: list[str] = []
    in_item = False

    def flush():
        nonlocal para
        if para:
            out.append(_inline("\n".join(x.strip(" \t") if k else x.lstrip() for k, x in enumerate(para)).rstrip(), counts) + ("" if in_item else "\n\n"))
        para = []

    def heading(level, raw):
        nonlocal title
        headings[level - 1] += 1
        t = _inline(raw.strip(), counts)
        if level == 1 and title is None and t.strip():
            title = t.strip()
        if t.strip():
            out.append(t + "\n")

    lines = text.split("\n")
    k = 0
    while k < len(lines):
        line = re.sub(r"^ {0,3}>[ ]?", "", lines[k])
        fence = _FENCE.match(line)
        if fence:
            flush()
            counts["code"] += 1
            k += 1
            while k < len(lines) and not re.match(rf"^ {{0,3}}{fence[1][0]}{{{len(fence[1])},}}[ \t]*$", lines[k]):
                out.append(lines[k] + "\n")
                k += 1
            k += 1
            continue
        atx = _ATX.match(line)
        if atx:
            flush()
            heading(len(atx[1]), atx[2] or "")
        elif para and not in_item and _SETEXT.match(line):
            raw, para = "\n".join(para), []
            heading(1 if "=" in line else 2, raw)
        elif not line.strip():
            flush()
            in_item = False
        elif _RULE.match(line):
            flush()
        elif not para and re.match(r"^(?: {4}|\t)", line) and not in_item:
            counts["code"] += 1
            while k < len(lines) and (re.match(r"^(?: {4}|\t)", lines[k]) or not lines[k].strip()):
                out.append(re.sub(r"^(?: {4}|\t)", "", lines[k]) + "\n")
                k += 1
            continue
        elif _ITEM.match(line):
            flush()
            in_item = True
            para = [_ITEM.sub("", line)]
        else:
            para.append(line)
        k += 1
    flush()
    meta: dict = {"title": title} if title else {}
    meta |= {f"heading_h{k}_count": n for k, n in enumerate(headings, 1) if n}
    meta |= {key: counts[n] for n, key in (("link", "link_count"), ("image", "image_count"), ("code", "code_block_count")) if counts[n]}
    return "".join(out).strip(), meta
