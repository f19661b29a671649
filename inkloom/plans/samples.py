"""Small documents of every format made from rows of tables, for queries and benchmarks that go through the converters."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

W = 'xmlns:w="urn:w" xmlns:r="urn:r" xmlns:a="urn:a" xmlns:wp="urn:wp" xmlns:m="urn:m"'
P = 'xmlns:p="urn:p" xmlns:a="urn:a" xmlns:r="urn:r" xmlns:c="urn:c"'


def made(df: DataFrame, key: str, build: Callable[..., bytes]) -> DataFrame:
    """(key, content): for each row the bytes that build makes of the row's other columns."""
    schema = T.StructType([df.schema[key], T.StructField("content", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([build(*r) for r in rows], pa.binary())], schema=arrow)

    return df.select(key, *[c for c in df.columns if c != key]).mapInArrow(run, schema)


def archive(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)  # a fixed date, so that equal rows give equal bytes
    return out.getvalue()


# --- DOCX


def docx(body: str, styles: str = "", numbering: str = "", rels: str = "", extra: dict | None = None) -> bytes:
    parts = {"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"}
    if styles:
        parts["word/styles.xml"] = f"<w:styles {W}>{styles}</w:styles>"
    if numbering:
        parts["word/numbering.xml"] = f"<w:numbering {W}>{numbering}</w:numbering>"
    if rels:
        parts["word/_rels/document.xml.rels"] = f"<Relationships>{rels}</Relationships>"
    return archive(parts | (extra or {}))


def para(text: str, props: str = "") -> str:
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"


def style(style_id: str, name: str, based_on: str = "", outline: int | None = None) -> str:
    base = f'<w:basedOn w:val="{based_on}"/>' if based_on else ""
    level = f'<w:pPr><w:outlineLvl w:val="{outline}"/></w:pPr>' if outline is not None else ""
    return f'<w:style w:type="paragraph" w:styleId="{style_id}"><w:name w:val="{name}"/>{base}{level}</w:style>'


def list_item(text: str, number: str, level: int = 0) -> str:
    return para(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>')


def table_cell(text: str, props: str = "") -> str:
    return f"<w:tc>{f'<w:tcPr>{props}</w:tcPr>' if props else ''}{para(text)}</w:tc>"


# --- PPTX


def pptx(slides: list[str], rels: list[str] | None = None, extra: dict | None = None) -> bytes:
    ids = "".join(f'<p:sldId id="{256 + i}" r:id="rId{i}"/>' for i in range(len(slides)))
    parts = {
        "[Content_Types].xml": "<Types/>",
        "ppt/presentation.xml": f"<p:presentation {P}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="slides/s{i}.xml"/>' for i in range(len(slides))) + "</Relationships>",
    }
    for i, s in enumerate(slides):
        parts[f"ppt/slides/s{i}.xml"] = f"<p:sld {P}><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>"
        if rels and rels[i]:
            parts[f"ppt/slides/_rels/s{i}.xml.rels"] = f"<Relationships>{rels[i]}</Relationships>"
    return archive(parts | (extra or {}))


def shape(text: str, y: int | None = None, x: int = 0, ph: str = "") -> str:
    at = f'<p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr>' if y is not None else "<p:spPr/>"
    kind = f'<p:nvSpPr><p:nvPr><p:ph type="{ph}"/></p:nvPr></p:nvSpPr>' if ph else "<p:nvSpPr><p:nvPr/></p:nvSpPr>"
    lines = "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in text.split("\n"))
    return f"<p:sp>{kind}{at}<p:txBody><a:bodyPr/>{lines}</p:txBody></p:sp>"


def slide_table(rows: list[list[str]], y: int) -> str:
    body = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{escape(c)}</a:t></a:r></a:p></a:txBody></a:tc>" for c in r) + "</a:tr>" for r in rows)
    return f'<p:graphicFrame><p:xfrm><a:off x="0" y="{y}"/></p:xfrm><a:graphic><a:graphicData><a:tbl>{body}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'


def chart_frame(rel: str, y: int) -> str:
    return f'<p:graphicFrame><p:xfrm><a:off x="0" y="{y}"/></p:xfrm><a:graphic><a:graphicData><c:chart r:id="{rel}"/></a:graphicData></a:graphic></p:graphicFrame>'


def chart(title: str, series: list[tuple[str, dict[int, str], dict[int, str]]]) -> str:
    def cache(kind: str, values: dict[int, str]) -> str:
        return f"<c:{kind}>" + "".join(f'<c:pt idx="{i}"><c:v>{escape(v)}</c:v></c:pt>' for i, v in values.items()) + f"</c:{kind}>"

    sers = "".join(f"<c:ser><c:tx><c:strRef>{cache('strCache', {0: n})}</c:strRef></c:tx><c:cat><c:strRef>{cache('strCache', c)}</c:strRef></c:cat><c:val><c:numRef>{cache('numCache', v)}</c:numRef></c:val></c:ser>" for n, c, v in series)
    return f"<c:chartSpace {P}><c:chart><c:title><c:tx><c:rich><a:p><a:r><a:t>{escape(title)}</a:t></a:r></a:p></c:rich></c:tx></c:title><c:plotArea><c:barChart>{sers}</c:barChart></c:plotArea></c:chart></c:chartSpace>"


def notes(text: str) -> str:
    return f"<p:notes {P}><p:cSld><p:spTree>{shape('7', ph='sldNum')}{shape(text, ph='body')}</p:spTree></p:cSld></p:notes>"


# --- XLSX


def xlsx(sheets: dict[str, str], strings: list[str] = (), styles: str = "") -> bytes:
    parts = {
        "[Content_Types].xml": "<Types/>",
        "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>",
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>",
    }
    if styles:
        parts["xl/styles.xml"] = f"<styleSheet>{styles}</styleSheet>"
    for i, rows in enumerate(sheets.values()):
        parts[f"xl/worksheets/s{i}.xml"] = f"<worksheet><sheetData>{rows}</sheetData></worksheet>"
    return archive(parts)


# --- DOC


def doc(pieces: list[tuple[str, bool]], encrypted: bool = False) -> bytes:
    """A Word binary document whose pieces are (text, one byte each)."""
    fib = bytearray(1024)
    struct.pack_into("<H", fib, 0, 0xA5EC)
    struct.pack_into("<H", fib, 10, 0x0200 | (0x0100 if encrypted else 0))
    struct.pack_into("<H", fib, 32, 14)
    struct.pack_into("<H", fib, 62, 22)
    total = sum(len(t) if small else len(t.encode("utf-16-le")) // 2 for t, small in pieces)
    struct.pack_into("<i", fib, 64 + 12, total)
    struct.pack_into("<H", fib, 64 + 88, 93)
    pair = 64 + 88 + 2 + 33 * 8
    text, bounds, table = bytearray(), [0], bytearray()
    for t, small in pieces:
        at = len(fib) + len(text)
        raw = t.encode("cp1252") if small else t.encode("utf-16-le")
        text += raw
        bounds.append(bounds[-1] + (len(raw) if small else len(raw) // 2))
        table += struct.pack("<HIH", 0, at * 2 | 0x40000000 if small else at, 0)
    plc = struct.pack(f"<{len(bounds)}I", *bounds) + table
    clx = b"\x01" + struct.pack("<H", 2) + b"\0\0" + b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", fib, pair, 0, len(clx))
    struct.pack_into("<i", fib, 64, len(fib) + len(text))
    return compound({"WordDocument": bytes(fib + text), "1Table": clx})


def compound(streams: dict[str, bytes]) -> bytes:
    """An OLE container with all streams in the normal sectors."""
    size, cutoff = 512, 0
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        first = len(sectors)
        n = max(1, -(-len(data) // size))
        for i in range(n):
            sectors.append(data[i * size : (i + 1) * size].ljust(size, b"\0"))
            fat.append(first + i + 1 if i + 1 < n else 0xFFFFFFFE)
        return first

    def entry(name: str, kind: int, start: int, length: int) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        e = bytearray(128)
        e[: len(raw)] = raw
        struct.pack_into("<HBB", e, 64, len(raw), kind, 1)
        struct.pack_into("<III", e, 68, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF)
        struct.pack_into("<IQ", e, 116, start, length)
        return bytes(e)

    entries = [entry("Root Entry", 5, 0xFFFFFFFE, 0)] + [entry(n, 2, put(d), len(d)) for n, d in streams.items()]
    folder = put(b"".join(entries))
    # The allocation table lists its own sectors too.
    per = size // 4
    n_fat = 1
    while n_fat * per < len(fat) + n_fat:
        n_fat += 1
    at = len(sectors)
    fat.extend([0xFFFFFFFD] * n_fat)
    fat.extend([0xFFFFFFFF] * (n_fat * per - len(fat)))
    raw_fat = b"".join(struct.pack("<I", x) for x in fat)
    sectors.extend(raw_fat[i * size : (i + 1) * size] for i in range(n_fat))
    header = bytearray(512)
    header[:8] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    struct.pack_into("<HHHHH", header, 24, 0x3E, 3, 0xFFFE, 9, 6)
    struct.pack_into("<IIII", header, 44, n_fat, folder, 0, cutoff)
    struct.pack_into("<IIII", header, 60, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    struct.pack_into("<109I", header, 76, *range(at, at + n_fat), *[0xFFFFFFFF] * (109 - n_fat))
    return bytes(header) + b"".join(sectors)


# --- PDF

LATIN_FONT = "<< /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >> >> >>"


def pdf_text(lines: list[str]) -> str:
    """A content stream that shows lines one below the other."""
    shown = [f"({x.replace(chr(92), chr(92) * 2).replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj" for x in lines]
    return "BT /F1 12 Tf 72 700 Td " + " 0 -20 Td ".join(shown) + " ET"


def pdf(pages: list[str], resources: str = LATIN_FONT, extra: str = "", flate: bool = False, objects: dict[int, bytes] | None = None) -> bytes:
    out = bytearray(b"%PDF-1.4\n")
    offsets = {}

    def obj(n: int, body: bytes) -> None:
        offsets[n] = len(out)
        out.extend(f"{n} 0 obj\n".encode() + body + b"\nendobj\n")

    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    obj(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    obj(2, f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /Resources {resources} >>".encode())
    for n, body in (objects or {}).items():
        obj(n, body)
    for i, content in enumerate(pages):
        data = content.encode("latin-1")
        data, f = (zlib.compress(data), "/Filter /FlateDecode ") if flate else (data, "")
        obj(10 + 2 * i, f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>".encode())
        obj(11 + 2 * i, f"<< {f}/Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream")
    out.extend(extra.encode("latin-1"))
    start = len(out)
    out.extend(b"xref\n0 1\n0000000000 65535 f \n" + b"".join(f"{n} 1\n{o:010d} 00000 n \n".encode() for n, o in offsets.items()))
    out.extend(f"trailer\n<< /Size 99 /Root 1 0 R >>\nstartxref\n{start}\n%%EOF".encode())
    return bytes(out)


def form_pdf(text: str) -> bytes:
    """One page that paints a form object, whose composite font has its Unicode only in a ToUnicode map."""
    cmap = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0020> <007E> <0020> endbfrange endcmap end"
    content = f"BT /F2 12 Tf 72 700 Td <{text.encode('utf-16-be').hex()}> Tj ET".encode()
    stream = lambda head, data: f"<< {head}/Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"
    objects = {
        3: stream("/Type /XObject /Subtype /Form /BBox [0 0 612 792] /Resources << /Font << /F2 4 0 R >> >> ", content),
        4: b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 6 0 R >>",
        5: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /X /DW 500 >>",
        6: stream("", cmap),
    }
    return pdf(["/Fm Do"], "<< /XObject << /Fm 3 0 R >> >>", objects=objects)
