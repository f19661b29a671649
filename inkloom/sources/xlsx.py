"""XLSX: sheets in workbook order, cells as shown by their number formats."""

from __future__ import annotations

import datetime as dt
import posixpath
import re

from inkloom.model import Options, Result
from inkloom.sources.markdown import Bounded, table
from inkloom.sources.ooxml import Element, Package, target, tree

MAX_ROWS, MAX_CELLS = 100_000, 1_000_000
#: Built-in number formats by id. Fixed values.
BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "hh:mm", 21: "hh:mm:ss", 22: "m/d/yy hh:mm", 37: "#,##0;(#,##0)", 38: "#,##0;(#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;(#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@"}
QUOTED = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?:\$[^\]]*|[A-Za-z]+\d*|[<>=]+[^\]]*)\]')
DATE_PART = re.compile(r"\[h+\]|\[m+\]|\[s+\]|y+|m+|d+|h+|s+(?:\.0+)?|AM/PM|A/P", re.I)


class Budget(ValueError):
    """A workbook beyond the limits of rows or cells."""


def column_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def shown(value: str, code: str, since_1904: bool) -> str:
    """A number as its format shows it: general, integers, decimals, thousands, percent, scientific, dates, times."""
    try:
        number = float(value)
    except ValueError:
        return value
    sections = code.split(";")
    section = sections[1] if number < 0 and len(sections) > 1 and sections[1] else sections[2] if number == 0 and len(sections) > 2 else sections[0]
    bare = QUOTED.sub("", section)
    if not code or code.lower() == "general" or code == "@":
        return general(number, value)
    if re.search(r"[ymdhs]", re.sub(r"[eE][+-]", "", bare), re.I) and not re.search(r"[0#]", re.sub(r"s\.0+", "", bare, flags=re.I)):
        return date_text(number, section, since_1904)
    m = re.search(r"[#0?,]*\.?[#0?]*", "".join(re.findall(r"[#0?,.]+", bare)))
    digits = m[0] if m else ""
    if "e+" in bare.lower() or "e-" in bare.lower():
        mantissa = bare.lower().split("e")[0]
        places = len(mantissa.split(".")[1]) if "." in mantissa else 0
        text = f"{number:.{places}E}"
        return re.sub(r"E([+-])0*(\d{2,})$|E([+-])(\d)$", lambda k: f"E{k[1] or k[3]}{(k[2] or k[4]).zfill(2)}", text)
    if not digits:
        literal = re.sub(r'["\\]', "", section)
        return literal or general(number, value)
    scaled = abs(number) * (100 if "%" in bare else 1)
    whole, _, frac = digits.partition(".")
    text = f"{scaled:,.{len(frac)}f}" if "," in whole else f"{scaled:.{len(frac)}f}"
    if frac:
        least = len(frac) - (len(frac) - len(frac.rstrip("#?")))
        head, _, tail = text.partition(".")
        while len(tail) > least and tail.endswith("0"):
            tail = tail[:-1]
        text = f"{head}.{tail}" if tail else head
    sign = "-" if number < 0 and len(sections) < 2 and float(text.replace(",", "") or 0) else ""
    lead = re.match(r'^(?:"[^"]*"|\\.|\[\$[^\]]*\]|[^#0?.,"\\\[])*', section)[0]
    tail = section[len(lead) :]
    tail = re.sub(r"^[#0?.,]+", "", tail)
    clean = lambda s: re.sub(r"\[\$([^\]-]*)[^\]]*\]", r"\1", re.sub(r'"([^"]*)"', r"\1", re.sub(r"\\(.)", r"\1", re.sub(r"_.|\*.", "", s))))
    return sign + clean(re.sub(r"\[(?:[A-Za-z]+\d*|[<>=]+[^\]]*)\]", "", lead)) + text + clean(tail)


def general(number: float, raw: str) -> str:
    if number == int(number) and abs(number) < 1e15:
        return str(int(number))
    return repr(float(f"{number:.15g}")) if "e" in raw.lower() or len(raw) > 12 else raw


def date_text(number: float, code: str, since_1904: bool) -> str:
    base = dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 30)
    if not since_1904 and number < 60:
        base += dt.timedelta(days=1)
    try:
        when = base + dt.timedelta(seconds=round(number * 86400, 3))
    except OverflowError:
        return str(number)
    when += dt.timedelta(microseconds=500_000 if when.microsecond >= 500_000 and ".0" not in code else 0)
    half = bool(re.search("am/pm|a/p", code, re.I))
    parts = list(re.finditer(rf'"[^"]*"|\\.|{DATE_PART.pattern}|.', code, re.I | re.S))
    out: list[str] = []
    kinds = [p[0].lower().strip("[]")[:1] if DATE_PART.fullmatch(p[0]) else "" for p in parts]
    for i, p in enumerate(parts):
        t, low = p[0], p[0].lower()
        if not DATE_PART.fullmatch(t):
            out.append(t.strip('"') if t[:1] == '"' else t[1:] if t[:1] == "\\" else "" if t in "[]" else t)
            continue
        near = [k for k in kinds[:i] if k][-1:] + [k for k in kinds[i + 1 :] if k][:1]
        if low.startswith("y"):
            out.append(f"{when.year:04d}" if len(t) > 2 else f"{when.year % 100:02d}")
        elif low.startswith("m") and ("h" in near[:1] or near[-1:] == ["s"] and len(t) < 3):
            out.append(f"{when.minute:0{min(len(t), 2)}d}")
        elif low.startswith("m"):
            out.append({1: str(when.month), 2: f"{when.month:02d}", 3: when.strftime("%b"), 5: when.strftime("%B")[0]}.get(len(t), when.strftime("%B")))
        elif low.startswith("d"):
            out.append({1: str(when.day), 2: f"{when.day:02d}", 3: when.strftime("%a")}.get(len(t), when.strftime("%A")))
        elif low.startswith("[h"):
            out.append(str(int(number * 24 + 1e-9)))
        elif low.startswith("h"):
            hour = (when.hour - 1) % 12 + 1 if half else when.hour
            out.append(f"{hour:0{min(len(t), 2)}d}")
        elif low.startswith("s"):
            out.append(f"{when.second:0{min(len(t.split('.')[0]), 2)}d}" + (f"{when.microsecond / 1e6:.{len(t.split('.')[1])}f}"[1:] if "." in t else ""))
        elif low.startswith("["):
            out.append(str(int(number * (1440 if low[1] == "m" else 86400) + 1e-9)))
        else:
            out.append("AM" if when.hour < 12 else "PM")
    return "".join(out)


def _string(item: Element) -> str:
    """The text of a shared or inline string, phonetic runs aside."""
    return "".join(n.text if n.name == "t" else "".join(t.text for t in n.all("t")) if n.name == "r" else "" for n in item.kids)


def normalize_grid(rows: list[list[str]]) -> list[list[str]]:
    """Blank rows at the end and blank columns at the right dropped, ragged rows padded."""
    while rows and not any(c.strip() for c in rows[-1]):
        rows = rows[:-1]
    width = max((i + 1 for r in rows for i, c in enumerate(r) if c.strip()), default=0)
    return [r[:width] + [""] * (width - len(r)) for r in rows] if width else []


class Workbook:
    def __init__(self, data: bytes, options: Options):
        self.pkg = Package(data, "xlsx")
        limit = options.max_result
        share = max(1, limit // 4) if limit is not None else None
        self.row_budget = MAX_ROWS if share is None else min(MAX_ROWS, share)
        self.cell_budget = MAX_CELLS if share is None else min(MAX_CELLS, share)
        self.raw_budget = limit
        book = self._part("xl/workbook.xml")
        if book is None:
            raise ValueError("xlsx: missing xl/workbook.xml")
        rels = self._part("xl/_rels/workbook.xml.rels")
        where = {r.attr("Id"): r.attr("Target") for r in (rels.kids if rels is not None else ())}
        sheets = book.child("sheets")
        self.sheets = [(s.attr("name"), target("xl", where.get(s.attr("id"), ""))) for s in (sheets.all("sheet") if sheets is not None else ())]
        props = book.child("workbookPr")
        self.since_1904 = props is not None and props.attr("date1904").lower() in ("1", "true")
        shared = self._part("xl/sharedStrings.xml")
        self.strings = [_string(i) for i in shared.all("si")] if shared is not None else []
        styles = self._part("xl/styles.xml")
        own, self.formats = {}, []
        if styles is not None:
            for f in styles.path("numFmts").all("numFmt") if styles.child("numFmts") is not None else ():
                own[f.attr("numFmtId")] = f.attr("formatCode")
            for xf in styles.path("cellXfs").all("xf") if styles.child("cellXfs") is not None else ():
                n = xf.attr("numFmtId", "0")
                self.formats.append(own.get(n) or (BUILT_IN.get(int(n), "") if n.isdigit() else ""))

    def _part(self, name: str) -> Element | None:
        data = self.pkg.read(name)
        return tree(data) if data is not None else None

    def cell(self, c: Element) -> str:
        kind, v = c.attr("t"), c.child("v")
        text = v.text if v is not None else ""
        if kind == "s":
            return self.strings[int(text)] if text.isdigit() and int(text) < len(self.strings) else ""
        if kind == "inlineStr":
            inline = c.child("is")
            return _string(inline) if inline is not None else ""
        if kind == "b":
            return "TRUE" if text == "1" else "FALSE"
        if kind in ("str", "e", "d") or not text:
            return text
        style = c.attr("s", "0")
        code = self.formats[int(style)] if style.isdigit() and int(style) < len(self.formats) else ""
        return shown(text, code, self.since_1904)

    def rows(self, part: str) -> list[list[str]]:
        root = self._part(part)
        data = root.child("sheetData") if root is not None else None
        out: list[list[str]] = []
        raw = cells = 0
        for r in data.all("row") if data is not None else ():
            at = int(r.attr("r")) - 1 if r.attr("r").isdigit() else len(out)
            if at >= self.row_budget:
                if any(self.cell(c) for c in r.all("c")):
                    raise Budget(f"sheet exceeds {self.row_budget} rows")
                continue
            while len(out) < at:
                out.append([])
            row: list[str] = []
            for c in r.all("c"):
                col = column_index(c.attr("r")) if c.attr("r") else len(row)
                if col < len(row) or col > 16_384:
                    continue
                row.extend([""] * (col - len(row)))
                row.append(self.cell(c))
                raw += len(row[-1].encode())
            cells += len(row)
            if cells > self.cell_budget:
                raise Budget(f"sheet exceeds {self.cell_budget} cells")
            if self.raw_budget is not None and raw > self.raw_budget:
                raise Budget(f"sheet exceeds {self.raw_budget} bytes")
            out.append(row)
        return normalize_grid(out)


def convert(data: bytes, options: Options) -> Result:
    book = Workbook(data, options)
    out = Bounded(options.max_result, "XLSX result")
    for i, (name, part) in enumerate(book.sheets):
        if posixpath.basename(posixpath.dirname(part)) == "chartsheets":
            continue
        out.write(("\n" if i else "") + f"## {name}\n\n" + table(book.rows(part)))
    return Result(out.text())
