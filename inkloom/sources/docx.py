"""DOCX: the document part as HTML by way of styles, numbering and relationships, then as Markdown."""

from __future__ import annotations

import base64
import posixpath
import re
from html import escape

from inkloom.model import Options, Result
from inkloom.sources import htmlmd
from inkloom.sources.markdown import Bounded
from inkloom.sources.ooxml import Element, Package, TooComplex, target, tree

#: Elements whose content is looked through. Fixed values.
TRANSPARENT = frozenset(("ins", "smartTag", "fldSimple"))
OFF = frozenset(("0", "false", "none", "off"))
#: Styles looked at from a paragraph's own upwards. Fixed value.
MAX_STYLES = 10
#: Cells of one table row; a row of more is an error of the document, not cut.
MAX_ROW_CELLS = 1_000_000
IMAGE_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".svg": "image/svg+xml", ".webp": "image/webp", ".tif": "image/tiff", ".tiff": "image/tiff"}


def _optional(pkg: Package, name: str) -> Element | None:
    """A part that may be missing or malformed; too complex ones are an error all the same."""
    data = pkg.read(name)
    if data is None:
        return None
    try:
        return tree(data)
    except TooComplex:
        raise
    except ValueError:
        return None


def read_styles(root: Element | None) -> dict[str, tuple[str, str, int]]:
    """Paragraph styles: id to (name, based on, outline level or -1)."""
    out = {}
    for s in root.all("style") if root is not None else ():
        if s.attr("type") == "paragraph" and s.attr("styleId"):
            get = lambda *p, s=s: e.attr("val") if (e := s.path(*p)) is not None else ""
            level = get("pPr", "outlineLvl")
            out[s.attr("styleId")] = (get("name"), get("basedOn"), int(level) if level.isdigit() and int(level) < 9 else -1)
    return out


def heading_level(style: str, styles: dict[str, tuple[str, str, int]]) -> int:
    """1 to 9, or 0 for no heading: by name, then outline level, then the style it is based on."""
    for _ in range(MAX_STYLES):
        name, based, level = styles.get(style, ("", "", -1))
        for label in (style, name):
            m = re.fullmatch(r"heading\s*([1-9])", label.strip().lower())
            if m:
                return int(m[1])
            if label.strip().lower() == "title":
                return 1
        if level >= 0:
            return level + 1
        if not based:
            return 0
        style = based
    return 0


def read_numbering(root: Element | None) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """(number id to abstract id, abstract id to level to format)."""
    abstract, numbers = {}, {}
    for n in root.kids if root is not None else ():
        if n.name == "abstractNum":
            abstract[n.attr("abstractNumId")] = {v.attr("ilvl"): f.attr("val") for v in n.all("lvl") if (f := v.child("numFmt")) is not None}
        elif n.name == "num" and (a := n.child("abstractNumId")) is not None:
            numbers[n.attr("numId")] = a.attr("val")
    return numbers, abstract


def list_kind(num_id: str, level: str, numbering) -> bool | None:
    """True ordered, False bullets, None for no list."""
    numbers, abstract = numbering
    if num_id in ("", "0") or num_id not in numbers:
        return None
    # A number whose definition or level is missing still makes a list item.
    return (abstract.get(numbers[num_id], {}).get(level) or "bullet") != "bullet"


class Writer:
    def __init__(self, pkg: Package, options: Options):
        self.pkg, self.options = pkg, options
        self.styles = read_styles(_optional(pkg, "word/styles.xml"))
        self.numbering = read_numbering(_optional(pkg, "word/numbering.xml"))
        rels = _optional(pkg, "word/_rels/document.xml.rels")
        self.rels = {r.attr("Id"): (r.attr("Target"), r.attr("TargetMode") == "External") for r in (rels.kids if rels is not None else ())}
        self.out = Bounded(None if options.max_result is None else 4 * options.max_result, "DOCX result")
        self.title = ""
        self.lists: list[list] = []  # [ordered, item open]

    def blocks(self, parent: Element) -> None:
        for k in parent.kids:
            if k.name == "p":
                self.paragraph(k)
            elif k.name == "tbl":
                self.close_lists(0)
                self.table(k)
            elif k.name == "sdt" and (inner := k.child("sdtContent")) is not None:
                self.blocks(inner)

    def paragraph(self, p: Element) -> None:
        props = p.child("pPr")
        val = lambda *names: e.attr("val") if props is not None and (e := props.path(*names)) is not None else ""
        style = val("pStyle")
        inline = self.inline(p)
        level = heading_level(style, self.styles)
        own = val("outlineLvl")
        if not level and own.isdigit() and int(own) < 9:
            level = int(own) + 1
        if level:
            if inline.strip():
                self.close_lists(0)
                is_title = style.lower() == "title" or self.styles.get(style, ("",))[0].lower() == "title"
                if not self.title and (is_title or level == 1):
                    self.title = p.runs().strip()
                self.out.write(f"<h{level}>{inline}</h{level}>\n")
            return
        if props is not None and props.child("numPr") is not None:
            depth = val("numPr", "ilvl") or "0"
            ordered = list_kind(val("numPr", "numId"), depth, self.numbering)
            if ordered is not None:
                self.item(int(depth) if depth.isdigit() else 0, ordered, inline)
                return
        self.close_lists(0)
        if inline.strip():
            self.out.write(f"<p>{inline}</p>\n")

    def item(self, depth: int, ordered: bool, inline: str) -> None:
        self.close_lists(depth + 1)
        if len(self.lists) == depth + 1 and self.lists[-1][0] != ordered:
            self.close_lists(depth)
        while len(self.lists) < depth + 1:
            self.out.write("<ol>\n" if ordered else "<ul>\n")
            self.lists.append([ordered, False])
        if self.lists[-1][1]:
            self.out.write("</li>\n")
        self.out.write(f"<li>{inline}")
        self.lists[-1][1] = True

    def close_lists(self, keep: int) -> None:
        while len(self.lists) > keep:
            ordered, is_open = self.lists.pop()
            self.out.write(("</li>\n" if is_open else "") + ("</ol>\n" if ordered else "</ul>\n"))

    def inline(self, parent: Element) -> str:
        out = []
        for k in parent.kids:
            if k.name == "r":
                out.append(self.run(k))
            elif k.name == "hyperlink":
                href, external = self.rels.get(k.attr("id"), ("", False))
                inner = self.inline(k)
                out.append(f'<a href="{escape(href)}">{inner}</a>' if href and external else inner)
            elif k.name in TRANSPARENT:
                out.append(self.inline(k))
            elif k.name == "sdt" and (inner := k.child("sdtContent")) is not None:
                out.append(self.inline(inner))
            elif k.name in ("oMath", "oMathPara"):
                out.append(escape(k.runs()))
        return "".join(out)

    def run(self, r: Element) -> str:
        tags = []
        props = r.child("rPr")
        if props is not None:
            tags = [tag for name, tag in (("b", "strong"), ("i", "em"), ("strike", "del")) if (f := props.child(name)) is not None and f.attr("val").lower() not in OFF]
            align = props.child("vertAlign")
            if align is not None and align.attr("val") in ("superscript", "subscript"):
                tags.append("sup" if align.attr("val") == "superscript" else "sub")
        parts = []
        for k in r.kids:
            if k.name == "t":
                parts.append(escape(k.text))
            elif k.name == "tab":
                parts.append(" ")
            elif k.name in ("br", "cr"):
                parts.append("<br/>")
            elif k.name == "noBreakHyphen":
                parts.append("-")
            elif k.name in ("drawing", "pict", "object"):
                parts.append(self.image(k))
        text = "".join(parts)
        return "".join(f"<{t}>" for t in tags) + text + "".join(f"</{t}>" for t in reversed(tags)) if text else ""

    def image(self, drawing: Element) -> str:
        nodes = list(drawing.walk())
        embed = next((n.attr("embed") for n in nodes if n.name == "blip" and n.attr("embed")), "")
        alt = next((a for n in nodes if n.name == "docPr" and (a := n.attr("descr") or n.attr("name"))), "")
        ref, external = self.rels.get(embed, ("", False))
        if not embed or not ref:
            return ""
        src = posixpath.basename(ref)
        if self.options.keep_data_uris and not external:
            data = self.pkg.read(target("word", ref))
            if data is not None:
                kind = IMAGE_TYPES.get(posixpath.splitext(ref)[1].lower(), "application/octet-stream")
                src = f"data:{kind};base64,{base64.b64encode(data).decode()}"
        return f'<img src="{escape(src)}" alt="{escape(alt)}"/>'

    def table(self, t: Element) -> None:
        self.out.write("<table>\n")
        tag = "th"
        for tr in t.all("tr"):
            cells, n = [], 0
            for tc in tr.all("tc"):
                span = tc.path("tcPr", "gridSpan")
                merge = tc.path("tcPr", "vMerge")
                width = int(span.attr("val")) if span is not None and span.attr("val").isdigit() else 1
                text = "" if merge is not None and merge.attr("val") != "restart" else self.cell(tc)
                n += max(width, 1)
                if n > MAX_ROW_CELLS:
                    raise TooComplex(f"docx: a table row spans more than {MAX_ROW_CELLS} cells")
                cells.append(f"<{tag}>{text}</{tag}>" + f"<{tag}></{tag}>" * (width - 1))
            self.out.write("<tr>" + "".join(cells) + "</tr>\n")
            tag = "td"
        self.out.write("</table>\n")

    def cell(self, tc: Element) -> str:
        parts: list[str] = []

        def collect(n: Element) -> None:
            for k in n.kids:
                if k.name == "p" and (inner := self.inline(k)).strip():
                    parts.append(inner)
                elif k.name == "tbl" and (text := k.runs().strip()):
                    parts.append(escape(text))
                elif k.name == "sdt" and (content := k.child("sdtContent")) is not None:
                    collect(content)

        collect(tc)
        return "<br/>".join(parts)


def convert(data: bytes, options: Options) -> Result:
    pkg = Package(data, "docx")
    writer = Writer(pkg, options)
    main = pkg.read("word/document.xml")
    if main is None:
        raise ValueError("docx: missing word/document.xml")
    body = tree(main).child("body")
    if body is not None:
        writer.blocks(body)
    writer.close_lists(0)
    markdown, _ = htmlmd.convert(writer.out.text(), options.keep_data_uris)
    return Result(markdown, writer.title)
