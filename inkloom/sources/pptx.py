"""PPTX: slides in order, their shapes by position, tables, charts and notes."""

from __future__ import annotations

import posixpath

from inkloom.model import Options, Result
from inkloom.sources.markdown import Bounded, escape_cell, table
from inkloom.sources.ooxml import Element, Package, TooComplex, rels_of, target, tree

FIRST = -(2**63)
NO_TEXT = frozenset(("bodyPr", "lstStyle", "pPr", "rPr", "defRPr"))
UNSUPPORTED_CHART = "[unsupported chart]"
Item = tuple[int, int, str]


def paragraphs(body: Element | None) -> list[str]:
    """One text for each paragraph, breaks as line feeds."""
    out: list[str] = []

    def gather(n: Element, parts: list[str] | None) -> None:
        for k in n.kids:
            if k.name in NO_TEXT:
                continue
            if k.name == "p":
                own: list[str] = []
                gather(k, own)
                out.append("".join(own))
            elif parts is not None and k.name == "br":
                parts.append("\n")
            elif parts is not None and k.name == "t":
                parts.append(k.text)
            else:
                gather(k, parts)

    if body is not None:
        gather(body, None)
    return out


def body_text(body: Element | None) -> str:
    return "\n".join(paragraphs(body)).strip()


def _position(frame: Element | None) -> tuple[int, int]:
    off = frame.child("off") if frame is not None else None
    if off is None:
        return FIRST, FIRST
    try:
        return int(off.attr("y", "0")), int(off.attr("x", "0"))
    except ValueError:
        return FIRST, FIRST


def _placeholder(sp: Element) -> str | None:
    ph = sp.path("nvSpPr", "nvPr", "ph")
    return ph.attr("type") if ph is not None else None


class Deck:
    def __init__(self, pkg: Package, options: Options):
        self.pkg, self.options = pkg, options

    def part(self, name: str) -> Element:
        data = self.pkg.read(name)
        if data is None:
            raise ValueError(f"pptx: missing archive part {name!r}")
        return tree(data)

    def rels(self, name: str) -> dict[str, str]:
        data = self.pkg.read(name)
        return {} if data is None else {r.attr("Id"): r.attr("Target") for r in tree(data).all("Relationship")}

    def items(self, parent: Element, slide: str, rels: dict[str, str]) -> tuple[list[Item], str]:
        """Items of a shape tree - shapes, pictures, frames, groups, in this base order - and the first title."""
        out: list[Item] = []
        title = ""
        for sp in parent.all("sp"):
            text = body_text(sp.child("txBody"))
            if text:
                if _placeholder(sp) in ("title", "ctrTitle"):
                    line = text.replace("\n", " ")
                    title = title or line
                    text = "# " + line
                out.append((*_position(sp.path("spPr", "xfrm")), text))
        for pic in parent.all("pic"):
            about = pic.path("nvPicPr", "cNvPr")
            alt = (about.attr("descr") or about.attr("name")) if about is not None else ""
            blip = pic.path("blipFill", "blip")
            ref = rels.get(blip.attr("embed")) if blip is not None else None
            out.append((*_position(pic.path("spPr", "xfrm")), f"![{escape_cell(alt)}]({posixpath.basename(ref) if ref is not None else 'image'})"))
        for frame in parent.all("graphicFrame"):
            at = _position(frame.child("xfrm"))
            data = frame.path("graphic", "graphicData")
            grid = data.child("tbl") if data is not None else None
            chart = data.child("chart") if data is not None else None
            if grid is not None:
                text = table([[" ".join(paragraphs(tc.child("txBody"))) for tc in tr.all("tc")] for tr in grid.all("tr")])
                if text:
                    out.append((*at, text))
            elif chart is not None:
                out.append((*at, self.chart(slide, rels.get(chart.attr("id"), ""))))
        for group in parent.all("grpSp"):
            inner, inner_title = self.items(group, slide, rels)
            title = title or inner_title
            if inner:
                inner.sort(key=lambda i: i[:2])
                out.append((*_position(group.path("grpSpPr", "xfrm")), "\n\n".join(i[2] for i in inner)))
        return out, title

    def chart(self, slide: str, ref: str) -> str:
        if not ref:
            return UNSUPPORTED_CHART
        try:
            root = self.part(target(posixpath.dirname(slide), ref)).child("chart")
        except TooComplex:
            raise
        except ValueError:
            return UNSUPPORTED_CHART
        if root is None:
            return "### Chart"
        name = body_text(root.path("title", "tx", "rich"))
        heading = "### Chart" + (": " + name.replace("\n", " ") if name else "")
        area = root.child("plotArea")
        series = [n for n in area.walk() if n.name == "ser"] if area is not None else []
        if not series:
            return heading
        return heading + "\n\n" + table(chart_rows([(series_name(s), points(s.child("cat")), points(s.child("val"))) for s in series]))

    def slide(self, name: str) -> tuple[str, str]:
        root = self.part(name)
        rels = self.rels(rels_of(name))
        shapes = root.path("cSld", "spTree")
        items, title = self.items(shapes, name, rels) if shapes is not None else ([], "")
        items.sort(key=lambda i: i[:2])
        text = "".join(i[2] + "\n\n" for i in items)
        notes = self.notes(name, rels)
        return text + (f"### Notes:\n\n{notes}\n\n" if notes else ""), title

    def notes(self, slide: str, rels: dict[str, str]) -> str:
        # Of several notes pages the one of the lowest relationship id counts.
        ref = next((rels[k] for k in sorted(rels) if "notesSlide" in rels[k]), None)
        if ref is None:
            return ""
        try:
            shapes = self.part(target(posixpath.dirname(slide), ref)).path("cSld", "spTree")
        except TooComplex:
            raise
        except ValueError:
            return ""
        found = [(_placeholder(sp) == "body", body_text(sp.child("txBody"))) for sp in (shapes.walk() if shapes is not None else ()) if sp.name == "sp"]
        own = [t for body, t in found if body and t]
        return "\n\n".join(own or [t for _, t in found if t])


def _cache(ref: Element | None) -> dict[int, str]:
    out: dict[int, str] = {}
    for kind in ("strCache", "numCache"):
        cache = ref.child(kind) if ref is not None else None
        for pt in cache.all("pt") if cache is not None else ():
            v = pt.child("v")
            if pt.attr("idx").isdigit():
                out[int(pt.attr("idx"))] = v.text if v is not None else ""
    return out


def points(data: Element | None) -> dict[int, str]:
    """Index to text: of the string reference if it has any, else of the numeric one."""
    if data is None:
        return {}
    return _cache(data.child("strRef")) or _cache(data.child("numRef"))


def series_name(ser: Element) -> str:
    """The cached name; of several points the one of the lowest index."""
    names = _cache(ser.path("tx", "strRef"))
    return names[min(names)] if names else ""


def chart_rows(series: list[tuple[str, dict[int, str], dict[int, str]]]) -> list[list[str]]:
    """Header and a row for each index that is among the categories or any series' values."""
    cats = next((c for _, c, _ in series if c), {})
    index = sorted({*cats, *(i for _, _, v in series for i in v)})
    header = ["Category", *(name or f"Series {k}" for k, (name, _, _) in enumerate(series, 1))]
    return [header, *([cats.get(i, ""), *(v.get(i, "") for _, _, v in series)] for i in index)]


def convert(data: bytes, options: Options) -> Result:
    deck = Deck(Package(data, "pptx"), options)
    order = deck.part("ppt/presentation.xml").child("sldIdLst")
    rels = deck.rels("ppt/_rels/presentation.xml.rels")
    out = Bounded(options.max_result, "PPTX result")
    title = ""
    for no, entry in enumerate(order.all("sldId") if order is not None else (), 1):
        ref = rels.get(entry.attr("id"))
        if ref is None:
            continue
        text, own = deck.slide(target("ppt", ref))
        out.write(("\n" if no > 1 else "") + f"<!-- Slide number: {no} -->\n\n" + text)
        title = title or own
    return Result(out.text(), title)
