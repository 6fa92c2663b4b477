"""Parsers of packaged office formats: ZIP containers of XML parts."""

from __future__ import annotations

import datetime
import posixpath
import re

from .base import Archive, Corrupted, Failure, Parsed, check_size, local, properties, xml_events
from ...functions.formats import ODP, ODS, PPTX, XLSX

_CORE = {"title": "title", "creator": "author", "subject": "subject", "description": "description", "created": "creation_date", "modified": "modified_date"}
_CORE_MORE = _CORE | {"lastModifiedBy": "last_modified_by", "revision": "revision"}
_META = {"title": "title", "initial-creator": "author", "creator": "author", "subject": "subject", "description": "description", "creation-date": "creation_date", "date": "modified_date"}
_META_MORE = _META | {"generator": "generator", "editing-cycles": "editing_cycles", "page-count": "page_count", "word-count": "word_count", "character-count": "character_count"}
#: Repeated empty cells beyond it are layout, not data.
REPEATS = 1024


def docx(data: bytes) -> Parsed:
    z = Archive(data)
    out: list[str] = []
    inside = 0

    def start(name, _):
        nonlocal inside
        inside += name == "w:t"

    def end(name):
        nonlocal inside
        inside -= name == "w:t"
        if name == "w:p":
            out.append("\n")

    xml_events(z.read("word/document.xml"), start, end, lambda t: out.append(t) if inside else None)
    return "".join(out).strip(), properties(z.get("docProps/core.xml"), _CORE_MORE, ("revision",))


class _Runs:
    """Trimmed text runs between tags, as an event reader that trims text sees them."""

    def __init__(self):
        self.held = ""

    def take(self) -> str:
        t, self.held = self.held.strip(), ""
        return t


def odt(data: bytes) -> Parsed:
    z = Archive(data)
    runs, out, body = _Runs(), [""], 0

    def flush():
        t = runs.take()
        if t and body:
            text = out[0]
            out[0] = text + (" " if text and text[-1] not in " \n" else "") + t

    def start(name, _):
        nonlocal body
        flush()
        body += local(name) == "body"
        if body and local(name) == "p" and out[0] and not out[0].endswith("\n"):
            out[0] += "\n"

    def end(name):
        nonlocal body
        flush()
        body -= local(name) == "body"

    def more(t):
        runs.held += t

    xml_events(z.read("content.xml"), start, end, more)
    return out[0].strip(), properties(z.get("meta.xml"), _META_MORE, ("editing_cycles", "page_count", "word_count", "character_count"))


def ods_tables(data: bytes) -> list[tuple[str, list[list[str]]]]:
    tables: list[tuple[str, list[list[str]]]] = []
    runs, row, cell = _Runs(), None, False

    def flush():
        t = runs.take()
        if t and cell and row:
            row[-1] = f"{row[-1]} {t}".strip()

    def start(name, attrs):
        nonlocal row, cell
        flush()
        name = local(name)
        if name == "table":
            tables.append((next((v for k, v in attrs.items() if local(k) == "name"), ""), []))
        elif name == "table-row" and tables:
            row = []
        elif name in ("table-cell", "covered-table-cell") and row is not None and name == "table-cell":
            n = next((v for k, v in attrs.items() if local(k) == "number-columns-repeated"), "1")
            row.extend([""] * min(int(n) if n.isdigit() else 1, REPEATS))
            cell = True

    def end(name):
        nonlocal row, cell
        flush()
        name = local(name)
        if name == "table-cell":
            cell = False
        elif name == "table-row":
            if row:
                tables[-1][1].append(row)
            row = None

    def more(t):
        runs.held += t

    xml_events(data, start, end, more)
    return tables


def ods(data: bytes) -> Parsed:
    check_size(data, ODS)
    z = Archive(data, ("content.xml",))
    tables = ods_tables(z.read("content.xml"))
    text = "\n\n".join(f"=== Table: {n} ===\n" + "".join(",".join(r) + "\n" for r in rows) for n, rows in tables)
    meta = properties(z.get("meta.xml"), _META) | {"table_count": len(tables)}
    if tables:
        meta["table_names"] = ", ".join(n for n, _ in tables)
    return text, meta


def odp(data: bytes) -> Parsed:
    check_size(data, ODP)
    z = Archive(data, ("content.xml",))
    slides: list[str] = []
    runs, page, para = _Runs(), 0, 0

    def flush():
        t = runs.take()
        if t and page and para:
            s = slides[-1]
            slides[-1] = s + (" " if s and s[-1] not in " \n" else "") + t

    def start(name, _):
        nonlocal page, para
        flush()
        if local(name) == "page":
            page += 1
            slides.append("")
        elif local(name) == "p":
            para += 1

    def end(name):
        nonlocal page, para
        flush()
        if local(name) == "page":
            page -= 1
        elif local(name) == "p":
            para -= 1
            if page and slides[-1] and not slides[-1].endswith("\n"):
                slides[-1] += "\n"

    def more(t):
        runs.held += t

    xml_events(z.read("content.xml"), start, end, more)
    text = "\n\n".join(f"--- Slide {k} ---\n{s.strip()}" for k, s in enumerate(slides, 1))
    return text, properties(z.get("meta.xml"), _META) | {"slide_count": len(slides)}


def _drawn(data: bytes) -> str:
    """Text of a slide part: runs followed by a blank, paragraphs by a line feed."""
    out: list[str] = []
    inside, held = 0, ""

    def start(name, _):
        nonlocal inside
        inside += local(name) == "t"

    def more(t):
        nonlocal held
        if inside:
            held += t

    def end(name):
        nonlocal inside, held
        if local(name) == "t":
            inside -= 1
            if held.strip():
                out.append(held.strip() + " ")
            held = ""
        elif local(name) == "p" and out and not out[-1].endswith("\n"):
            out.append("\n")

    xml_events(data, start, end, more)
    return "".join(out).strip()


def pptx_slides(data: bytes, compat: bool = False) -> list[tuple[str, str]]:
    """(text, notes) of each slide, by the numbers of the parts; with ``compat`` in the order of their names, notes by position."""
    z = Archive(data, ("[Content_Types].xml",))
    names = [n for n in z.names if n.startswith("ppt/slides/slide") and n.endswith(".xml") and "_rels" not in n]
    number = lambda n: int(re.sub(r"\D", "", posixpath.basename(n)) or 0)
    names.sort(key=None if compat else lambda n: (number(n), n))
    out = []
    for k, n in enumerate(names, 1):
        notes = z.get(f"ppt/notesSlides/notesSlide{k if compat else number(n)}.xml")
        try:
            said = _drawn(notes) if notes else ""
        except Failure:
            said = ""
        out.append((_drawn(z.read(n)), said))
    return out


def pptx(data: bytes, compat: bool = False) -> Parsed:
    check_size(data, PPTX)
    slides = pptx_slides(data, compat)
    text = "\n\n".join(f"--- Slide {k} ---\n{t}" + (f"\n\nSpeaker Notes:\n{n}" if n else "") for k, (t, n) in enumerate(slides, 1))
    z = Archive(data)
    noted = any(re.fullmatch(r"ppt/notesSlides/notesSlide.*\.xml", n) for n in z.names)
    return text, properties(z.get("docProps/core.xml"), _CORE) | {"slide_count": len(slides), "has_notes": noted}


_DATE_CODES = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47))


def number(value: str) -> str:
    """A number as a spreadsheet shows it without a format: whole ones without a fraction."""
    try:
        x = float(value)
    except ValueError:
        return value
    return str(int(x)) if x.is_integer() and abs(x) < 1e16 else repr(x)


def serial_date(value: str, old: bool = False) -> str:
    try:
        x = float(value)
        day = datetime.datetime(1904, 1, 1) if old else datetime.datetime(1899, 12, 30)
        return (day + datetime.timedelta(days=x)).replace(microsecond=0).isoformat(" ")
    except (ValueError, OverflowError):
        return value


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _shared(data: bytes | None) -> list[str]:
    out: list[str] = []
    if not data:
        return out
    state = {"t": 0, "rph": 0}

    def start(name, _):
        name = local(name)
        if name == "si":
            out.append("")
        elif name in state:
            state[name] += 1
        elif name == "rPh":
            state["rph"] += 1

    def end(name):
        name = local(name)
        if name == "rPh":
            state["rph"] -= 1
        elif name in state:
            state[name] -= 1

    def more(t):
        if state["t"] and not state["rph"]:
            out[-1] += t

    xml_events(data, start, end, more)
    return out


def _date_styles(data: bytes | None) -> set[int]:
    """Cell styles whose number format shows a date."""
    formats: dict[int, bool] = {}
    dates: set[int] = set()
    state = {"xfs": False, "n": 0}
    if not data:
        return dates

    def start(name, a):
        name = local(name)
        if name == "numFmt":
            code = re.sub(r"\"[^\"]*\"|\\.|\[[^\]]*\]", "", a.get("formatCode", ""))
            formats[int(a.get("numFmtId", -1))] = bool(re.search(r"[dmyhs]", code, re.I)) and "general" not in code.lower()
        elif name == "cellXfs":
            state["xfs"] = True
        elif name == "xf" and state["xfs"]:
            code = int(a.get("numFmtId", 0))
            if code in _DATE_CODES or formats.get(code):
                dates.add(state["n"])
            state["n"] += 1

    def end(name):
        if local(name) == "cellXfs":
            state["xfs"] = False

    xml_events(data, start, end)
    return dates


def sheet_cells(data: bytes, shared: list[str], dates: set[int], old: bool) -> list[list[str]]:
    """Rows of a sheet, from its first used cell to its last."""
    cells: dict[tuple[int, int], str] = {}
    state: dict = {"row": -1, "col": -1, "type": "", "style": 0, "v": None, "in": 0}

    def start(name, a):
        name = local(name)
        if name == "row":
            state["row"] = int(a["r"]) - 1 if a.get("r", "").isdigit() else state["row"] + 1
            state["col"] = -1
        elif name == "c":
            ref = a.get("r", "")
            state["col"] = _column(ref) if ref else state["col"] + 1
            state["type"], state["style"], state["v"] = a.get("t", "n"), int(a.get("s", 0) or 0), None
        elif name in ("v", "t"):
            state["in"] += 1
            state["v"] = state["v"] or ""

    def end(name):
        name = local(name)
        if name in ("v", "t"):
            state["in"] -= 1
        elif name == "c" and state["v"] is not None:
            kind, v = state["type"], state["v"]
            if kind == "s":
                v = shared[int(v)] if v.strip().isdigit() and int(v) < len(shared) else ""
            elif kind == "b":
                v = "true" if v.strip() == "1" else "false"
            elif kind == "e":
                v = f"#ERROR: {v}"
            elif kind == "n":
                v = serial_date(v, old) if state["style"] in dates else number(v)
            cells[state["row"], state["col"]] = v

    def more(t):
        if state["in"]:
            state["v"] += t

    xml_events(data, start, end, more)
    return grid(cells)


def grid(cells: dict[tuple[int, int], str]) -> list[list[str]]:
    if not cells:
        return []
    rows, cols = [r for r, _ in cells], [c for _, c in cells]
    top, left, right = min(rows), min(cols), max(cols)
    return [[cells.get((r, c), "") for c in range(left, right + 1)] for r in range(top, max(rows) + 1)]


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    z = Archive(data, ("[Content_Types].xml", "xl/workbook.xml"))
    sheets: list[tuple[str, str]] = []
    old = [False]

    def book(name, a):
        if local(name) == "sheet":
            sheets.append((a.get("name", ""), next((v for k, v in a.items() if local(k) == "id" and ":" in k), "")))
        elif local(name) == "workbookPr":
            old[0] = a.get("date1904") in ("1", "true")

    xml_events(z.read("xl/workbook.xml"), book)
    targets: dict[str, str] = {}
    rels = z.get("xl/_rels/workbook.xml.rels")
    if rels:
        xml_events(rels, lambda n, a: targets.update({a["Id"]: a.get("Target", "")}) if local(n) == "Relationship" and "Id" in a else None)
    shared, dates = _shared(z.get("xl/sharedStrings.xml")), _date_styles(z.get("xl/styles.xml"))
    out = []
    for k, (name, rid) in enumerate(sheets, 1):
        target = targets.get(rid, f"worksheets/sheet{k}.xml")
        part = z.get(target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}"))
        out.append((name, sheet_cells(part, shared, dates, old[0]) if part else []))
    return out


def sheets_parsed(sheets: list[tuple[str, list[list[str]]]]) -> Parsed:
    text = "\n\n".join(f"=== Sheet: {n} ===\n" + "".join(",".join(r) + "\n" for r in rows) for n, rows in sheets)
    meta: dict = {"sheet_count": len(sheets), "sheet_names": ", ".join(n for n, _ in sheets)}
    for n, rows in sheets:
        meta |= {f"sheet_{n}_rows": len(rows), f"sheet_{n}_columns": len(rows[0]) if rows else 0}
    meta["total_rows"] = sum(len(rows) for _, rows in sheets)
    meta["max_columns"] = max((len(rows[0]) for _, rows in sheets if rows), default=0)
    return text, meta


def xlsx(data: bytes) -> Parsed:
    check_size(data, XLSX)
    return sheets_parsed(xlsx_sheets(data))


_OPF = {"title": "title", "creator": "author", "publisher": "publisher", "language": "language", "description": "description", "date": "publication_date", "subject": "keywords", "identifier": "identifier"}


def _body(xhtml: bytes) -> str:
    from html.parser import HTMLParser

    parts: list[str] = []

    class Strip(HTMLParser):
        inside = 0

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "body"

        def handle_endtag(self, tag):
            self.inside -= tag == "body"

        def handle_data(self, d):
            if self.inside and d.strip():
                parts.append(d.strip())

    s = Strip(convert_charrefs=True)
    s.feed(xhtml.decode("utf-8", "replace"))
    s.close()
    return "".join(p + " " for p in parts) + "\n" if parts else ""


def epub(data: bytes) -> Parsed:
    z = Archive(data, ("META-INF/container.xml",))
    roots: list[str] = []
    xml_events(z.read("META-INF/container.xml"), lambda n, a: roots.append(a["full-path"]) if local(n) == "rootfile" and "full-path" in a else None)
    if not roots:
        raise Corrupted("the container names no package")
    package = z.read(roots[0])
    base = posixpath.dirname(roots[0])
    items: dict[str, str] = {}
    spine: list[str] = []
    meta: dict = {}
    stack: list[list[str]] = []

    def start(name, a):
        name = local(name)
        stack.append([name, ""])
        if name == "item":
            items[a.get("id", "")] = a.get("href", "")
        elif name == "itemref":
            spine.append(a.get("idref", ""))

    def end(_):
        name, text = stack.pop()
        key = _OPF.get(name)
        if key and text.strip():
            meta.setdefault(key, text.strip())

    def more(t):
        if stack:
            stack[-1][1] += t

    xml_events(package, start, end, more)
    from urllib.parse import unquote

    chapters = []
    for ref in spine:
        part = z.get(posixpath.normpath(posixpath.join(base, unquote(items.get(ref, "")))))
        text = _body(part) if part else ""
        if text.strip():
            chapters.append(text)
    return "\n\n".join(chapters).strip(), meta | {"spine_count": len(spine), "resource_count": len(items)}
