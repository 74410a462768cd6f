"""Word-processor files as bundles: DOCX and ODT, read from binaryFile rows in mapInPandas with the standard library.

A document becomes block rows in body order: kind (heading, paragraph, list, table, image, note), level, text, HTML, table
grid (its first row is the header) with the spans of its cells, and the id of the part an image refers to. Styles inherit
through basedOn (cycles are cut); a heading is what its style's name, title or outline level or its own outline level says,
of level 6 at most. Links, bookmarks and symbols stand in the HTML. Text boxes give their first Choice, else their Fallback.
Notes come only where the text refers to them; a mark stands in their place. Files that are no such archive, or over the size limits, give one row of kind 'error'.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, pos int, kind string, level int, text string, html string, grid array<array<string>>, ref string, spans array<struct<row: int, col: int, rowspan: int, colspan: int>>"
#: Limits of an import.
MAX_BYTES, MAX_RATIO = 200 << 20, 50
#: A cell or gap spans at most so many columns (the formats' own limits are lower).
MOST_CELLS = 1000

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
TEXT, TABLE, OFFICE, DRAW, XLINK = (f"{{urn:oasis:names:tc:opendocument:xmlns:{n}:1.0}}" for n in ("text", "table", "office", "drawing", "xlink"))
XLINK = "{http://www.w3.org/1999/xlink}"

#: Names of heading, title and subtitle styles, and the marks of notes.
HEADING_NAME = re.compile(r"(?i)(?:Heading|見出し|見だし|みだし|Titre|Header|Headline|H)\s*([1-9])")
TITLE_NAMES, SUBTITLE_NAMES = ("title", "タイトル", "表題"), ("subtitle", "サブタイトル", "副題")
NOTE_MARKS = {"footnote": "脚注", "endnote": "文末脚注", "comment": "コメント"}
MOST_LEVEL = 6


def zip_fault(content: bytes, most: int = MAX_BYTES, ratio: int = MAX_RATIO) -> str | None:
    """Why an archive must not be opened: no archive, too large, packed too tightly, unsafe names."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError, ValueError):
        return "not a zip archive"
    total = sum(i.file_size for i in z.infolist())
    if total > most:
        return "expands beyond the limit"
    if total > ratio * max(1, len(content)):
        return "compression ratio beyond the limit"
    if any(i.filename.startswith("/") or ".." in i.filename.split("/") for i in z.infolist()):
        return "unsafe member name"
    return None


def _outline(pr: ET.Element | None) -> int | None:
    """The outline level of properties: 1 to 6, 0 for body text, None if they say nothing."""
    e = pr.find(f"{W}outlineLvl") if pr is not None else None
    value = e.get(f"{W}val", "") if e is not None else ""
    return None if not value.isdigit() else min(int(value) + 1, MOST_LEVEL) if int(value) < 9 else 0


def _named_level(name: str) -> int | None:
    if m := HEADING_NAME.fullmatch(name):
        return min(int(m[1]), MOST_LEVEL)
    return 1 if name.lower() in TITLE_NAMES else 2 if name.lower() in SUBTITLE_NAMES else None


def heading_levels(styles: ET.Element | None) -> dict[str, int]:
    """Style id -> heading level (1 to 6), inherited through basedOn. A style that says body text ends the search."""
    own: dict[str, int] = {}
    based: dict[str, str] = {}
    for s in styles.iter(f"{W}style") if styles is not None else ():
        sid, name, base = s.get(f"{W}styleId", ""), s.find(f"{W}name"), s.find(f"{W}basedOn")
        said = (_outline(s.find(f"{W}pPr")), _named_level(sid), _named_level(name.get(f"{W}val", "")) if name is not None else None)
        if (level := next((x for x in said if x is not None), None)) is not None:
            own[sid] = level
        if base is not None:
            based[sid] = base.get(f"{W}val", "")
    out = {}
    for sid in {*own, *based}:
        at, seen = sid, set()
        while at and at not in own and at not in seen:
            seen.add(at)
            at = based.get(at, "")
        if own.get(at):
            out[sid] = own[at]
    return out


class _Docx:
    def __init__(self, z: zipfile.ZipFile) -> None:
        load = lambda n: ET.fromstring(z.read(n)) if n in z.namelist() else None
        self.body = load("word/document.xml").find(f"{W}body")
        self.levels = heading_levels(load("word/styles.xml"))
        rels = load("word/_rels/document.xml.rels")
        self.targets = {r.get("Id"): r.get("Target", "") for r in rels} if rels is not None else {}
        self.notes = {k: {n.get(f"{W}id"): n for n in x if n.get(f"{W}type") in (None, "normal")} if (x := load(f"word/{k}s.xml")) is not None else {} for k in ("footnote", "endnote", "comment")}
        self.asked: list[tuple[str, str]] = []
        self.images: list[str] = []

    def runs(self, p: ET.Element) -> tuple[str, str]:
        """Plain text and HTML of a paragraph."""
        text, out = [], []

        def walk(e: ET.Element) -> None:
            if e.tag == f"{MC}AlternateContent":
                pick = e.find(f"{MC}Choice")
                pick = e.find(f"{MC}Fallback") if pick is None else pick
                for c in pick if pick is not None else ():
                    walk(c)
                return
            if e.tag in (f"{W}del", f"{W}instrText", f"{W}pPr"):
                return
            if e.tag == f"{W}r":
                pr = e.find(f"{W}rPr")
                marks = [t for k, t in (("b", "strong"), ("i", "em"), ("u", "u"), ("strike", "del")) if pr is not None and (x := pr.find(f"{W}{k}")) is not None and x.get(f"{W}val") not in ("0", "false", "off", "none")]
                va = pr.find(f"{W}vertAlign") if pr is not None else None
                marks += [{"superscript": "sup", "subscript": "sub"}[va.get(f"{W}val")]] if va is not None and va.get(f"{W}val") in ("superscript", "subscript") else []
                start = len(out)
                for c in e:
                    walk(c)
                if marks and len(out) > start:
                    out[start:] = ["".join(f"<{m}>" for m in marks), *out[start:], "".join(f"</{m}>" for m in reversed(marks))]
                return
            if e.tag == f"{W}t":
                text.append(e.text or "")
                out.append(html.escape(e.text or ""))
            elif e.tag == f"{W}tab":
                text.append("\t"), out.append("\t")
            elif e.tag in (f"{W}br", f"{W}cr"):
                text.append("\n"), out.append("<br>")
            elif e.tag in (f"{W}footnoteReference", f"{W}endnoteReference", f"{W}commentReference"):
                kind, i = e.tag[len(W) : -len("Reference")], e.get(f"{W}id")
                if i in self.notes[kind]:
                    self.asked.append((kind, i))
                    mark = f"【{NOTE_MARKS[kind]}{i}】"
                    text.append(mark), out.append(f'<sup data-note="{kind}-{html.escape(i)}">{html.escape(mark)}</sup>')
            elif e.tag == f"{W}sym":
                code = e.get(f"{W}char", "")
                sign = chr(int(code, 16)) if re.fullmatch("(?i)(?!d[89a-f])[0-9a-f]{1,4}", code) else ""
                text.append(sign), out.append(html.escape(sign))
            elif e.tag == f"{W}bookmarkStart" and e.get(f"{W}name", "_GoBack") != "_GoBack":
                out.append(f'<span id="{html.escape(e.get(f"{W}name"))}"></span>')
            elif (to := self.link(e)) is not None:
                start = len(out)
                for c in e:
                    walk(c)
                if len(out) > start:
                    out[start:] = [f'<a href="{html.escape(to)}">', *out[start:], "</a>"]
                return
            elif e.tag == f"{A}blip":
                self.images.append(e.get(f"{R}embed", ""))
            for c in e:
                walk(c)

        for c in p:
            walk(c)
        return "".join(text), "".join(out)

    def link(self, e: ET.Element) -> str | None:
        """Where a hyperlink or a hyperlink field leads: an address, or # and a bookmark."""
        if e.tag == f"{W}fldSimple":
            m = re.search(r'HYPERLINK\s+"([^"]+)"', e.get(f"{W}instr", ""))
            return m[1] if m else None
        if e.tag != f"{W}hyperlink":
            return None
        anchor = e.get(f"{W}anchor")
        return self.targets.get(e.get(f"{R}id")) or (f"#{anchor}" if anchor else None)

    def grid(self, table: ET.Element) -> tuple[list[list[str]], list[dict[str, int]]]:
        """Cell texts and the spans of the cells. A cell stands in its first row and column; what it covers is empty. A cell
        continues a vertical merge if the merged cell above begins in its column and is as wide; else it is one of its own."""
        rows, spans, above = [], [], {}
        number = lambda e, least: min(max(least, int(e.get(f"{W}val", ""))), MOST_CELLS) if e is not None and e.get(f"{W}val", "").isdigit() else least
        for at, tr in enumerate(table.findall(f"{W}tr")):
            row, merged = [""] * number(tr.find(f"{W}trPr/{W}gridBefore"), 0), {}
            for tc in tr.findall(f"{W}tc"):
                wide, merge = number(tc.find(f"{W}tcPr/{W}gridSpan"), 1), tc.find(f"{W}tcPr/{W}vMerge")
                cell, text = above.get(len(row)), ""
                if merge is not None and merge.get(f"{W}val") != "restart" and cell and cell["colspan"] == wide:
                    cell["rowspan"] += 1
                else:
                    text = " ".join(t for p in tc.iter(f"{W}p") if (t := self.runs(p)[0])).strip()
                    cell = {"row": at, "col": len(row), "rowspan": 1, "colspan": wide}
                    spans.append(cell)
                if merge is not None:
                    merged[len(row)] = cell
                row += [text] + [""] * (wide - 1)
            rows.append(row)
            above = merged
        wide = max(map(len, rows), default=0)
        return [r + [""] * (wide - len(r)) for r in rows], spans

    def rows(self) -> Iterator[tuple]:
        for e in self.body:
            if e.tag == f"{W}tbl":
                g, spans = self.grid(e)
                yield "table", None, "\n".join("\t".join(r) for r in g), None, g, None, spans
            elif e.tag == f"{W}p":
                text, markup = self.runs(e)
                pr = e.find(f"{W}pPr")
                style = pr.find(f"{W}pStyle").get(f"{W}val") if pr is not None and pr.find(f"{W}pStyle") is not None else None
                own = _outline(pr)
                level = self.levels.get(style) if own is None else own or None
                item = pr.find(f"{W}numPr/{W}ilvl") if pr is not None else None
                kind = "heading" if level else "list" if pr is not None and pr.find(f"{W}numPr") is not None else "paragraph"
                if text.strip():
                    yield kind, level or (int(item.get(f"{W}val", "0")) if item is not None else None), text, markup, None, None
                for ref in self.images:
                    yield "image", None, None, None, None, ref
                self.images.clear()
        done = set()
        for kind, i in self.asked:
            if (kind, i) not in done:
                done.add((kind, i))
                text = "\n".join(self.runs(p)[0] for p in self.notes[kind][i].iter(f"{W}p")).strip()
                yield "note", None, text, None, None, f"{kind}-{i}"


def _odt(z: zipfile.ZipFile) -> Iterator[tuple]:
    body = ET.fromstring(z.read("content.xml")).find(f"{OFFICE}body/{OFFICE}text")
    notes: list[tuple[str, str]] = []

    def plain(e: ET.Element) -> str:
        out = [e.text or ""]
        for c in e:
            if c.tag == f"{TEXT}s":
                out.append(" " * int(c.get(f"{TEXT}c", "1")))
            elif c.tag == f"{TEXT}tab":
                out.append("\t")
            elif c.tag == f"{TEXT}line-break":
                out.append("\n")
            elif c.tag == f"{TEXT}note":
                notes.append((c.get(f"{TEXT}id", ""), "\n".join(plain(p) for p in c.find(f"{TEXT}note-body").iter(f"{TEXT}p"))))
            elif c.tag == f"{OFFICE}annotation":
                notes.append(("comment", "\n".join(plain(p) for p in c.iter(f"{TEXT}p"))))
            else:
                out.append(plain(c))
            out.append(c.tail or "")
        return "".join(out)

    def walk(e: ET.Element) -> Iterator[tuple]:
        for c in e:
            if c.tag == f"{TEXT}h":
                yield "heading", int(c.get(f"{TEXT}outline-level", "1")), plain(c), None, None, None
            elif c.tag == f"{TEXT}p":
                text = plain(c)
                if text.strip():
                    yield "paragraph", None, text, html.escape(text), None, None
                for im in c.iter(f"{DRAW}image"):
                    yield "image", None, None, None, None, im.get(f"{XLINK}href")
            elif c.tag == f"{TEXT}list":
                for p in c.iter(f"{TEXT}p"):
                    yield "list", 0, plain(p), None, None, None
            elif c.tag == f"{TABLE}table":
                g = []
                for tr in c.iter(f"{TABLE}table-row"):
                    row = []
                    for tc in tr:
                        cells = min(int(tc.get(f"{TABLE}number-columns-repeated", "1")), MOST_CELLS)
                        row += ["" if tc.tag == f"{TABLE}covered-table-cell" else "\n".join(plain(p) for p in tc.iter(f"{TEXT}p"))] * cells
                    g.append(row)
                wide = max(map(len, g), default=0)
                g = [r + [""] * (wide - len(r)) for r in g]
                yield "table", None, "\n".join("\t".join(r) for r in g), None, g, None
            elif c.tag == f"{TEXT}section":
                yield from walk(c)

    yield from walk(body)
    for i, text in notes:
        yield "note", None, text.strip(), None, None, i


def blocks_of(path: str, content: bytes) -> list[tuple]:
    fault = zip_fault(content)
    try:
        if fault:
            raise ValueError(fault)
        z = zipfile.ZipFile(io.BytesIO(content))
        rows = list(_Docx(z).rows() if "word/document.xml" in z.namelist() else _odt(z))
    except (ValueError, KeyError, AttributeError, ET.ParseError, zipfile.BadZipFile) as e:
        rows = [("error", None, str(e), None, None, None)]
    return [(path, i, *r[:6], r[6] if len(r) > 6 else None) for i, r in enumerate(rows)]


def read_archives(spark: SparkSession, root: str, pattern: str = "*.{docx,odt}") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in blocks_of(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "pos", "kind", "level", "text", "html", "grid", "ref", "spans"]).astype({"level": "Int32"})

    return files.mapInPandas(parse, SCHEMA)


def odt_bytes(rows: list[tuple[str, int | None, str]]) -> bytes:
    """A small ODT file of (kind, level, text) rows."""
    parts = [f'<text:h text:outline-level="{level or 1}">{html.escape(text)}</text:h>' if kind == "heading" else f"<text:p>{html.escape(text)}</text:p>" for kind, level, text in rows]
    content = '<?xml version="1.0" encoding="UTF-8"?><office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" office:version="1.2"><office:body><office:text>' + "".join(parts) + "</office:text></office:body></office:document-content>"
    return _zip({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": content, "META-INF/manifest.xml": '<?xml version="1.0"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="application/vnd.oasis.opendocument.text"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'})


def docx_bytes(rows: list[tuple[str, int | None, str]]) -> bytes:
    """A small DOCX file of (kind, level, text) rows."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda k, n, t: f'<w:p><w:pPr>{f"<w:pStyle w:val=\"Heading{n or 1}\"/>" if k == "heading" else ""}</w:pPr><w:r><w:t xml:space="preserve">{html.escape(t)}</w:t></w:r></w:p>'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/></w:style>' for n in range(1, 10))
    return _zip({
        "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="s1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "word/styles.xml": f'<?xml version="1.0"?><w:styles {w}>{styles}</w:styles>',
        "word/document.xml": f'<?xml version="1.0"?><w:document {w}><w:body>{"".join(para(*r) for r in rows)}</w:body></w:document>',
    })


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def exported(blocks: DataFrame, kind: str = "odt") -> DataFrame:
    """blocks (doc_id, pos, kind, level, text) -> doc_id, content: one file for each document."""
    make = odt_bytes if kind == "odt" else docx_bytes

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        rows = [(k, None if pd.isna(n) else int(n), t) for k, n, t in zip(pdf["kind"], pdf["level"], pdf["text"], strict=True)]
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "content": [make(rows)]})

    return blocks.groupBy("doc_id").applyInPandas(write, "doc_id long, content binary")
