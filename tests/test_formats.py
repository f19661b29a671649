import hashlib
import struct
import threading

import pytest
from builders import archive, doc, docx, para, pdf, pptx, shape, xlsx

from inkloom import model
from inkloom.model import ConversionFailed, Hints, InputTooLarge, Options, ResultTooLarge, Unsupported
from inkloom.sources import htmlmd, legacydoc, ooxml, pdfcrypt, pdftext, sniff, textenc
from inkloom.sources import xlsx as X
from inkloom.plans.samples import list_item, style, table_cell
from inkloom.sources.engine import FORMATS, Converter, Engine, default_engine
from inkloom.sources.pdf import OcrLimit

E = default_engine()


def md(data, **hints):
    return E.convert(data, Hints(**hints)).markdown


# --- engine and detection


def test_order_and_names():
    assert [c.name for c in E.ordered()] == ["docx", "doc", "pptx", "pdf", "xlsx", "csv", "zip", "html", "plaintext"]


def test_later_registration_shadows():
    e = Engine()
    e.register(Converter("first", lambda d, h, o: model.Result("1"), (".x",)), 0)
    e.register(Converter("second", lambda d, h, o: None, (".x",)), 0)
    assert e.convert(b"q", Hints(extension=".x")).converter == "first"  # the second declines
    e.register(Converter("third", lambda d, h, o: 1 / 0, (".x",)), 0)
    assert e.convert(b"q", Hints(extension=".x")).converter == "first"


def test_failures_are_gathered():
    e = Engine(with_builtins=False)
    e.register(Converter("bad", lambda d, h, o: 1 / 0, (".x",)), 0)
    with pytest.raises(ConversionFailed) as err:
        e.convert(b"\0\1", Hints(extension=".x"))
    assert err.value.attempts == [("bad", "division by zero")]
    assert str(err.value) == "conversion failed after 1 attempt(s):\n  bad: division by zero"
    with pytest.raises(Unsupported):
        e.convert(b"q", Hints(extension=".y"))


def test_declining_is_not_failing():
    e = Engine(with_builtins=False)
    e.register(Converter("no", lambda d, h, o: None, (".x",)), 0)
    with pytest.raises(Unsupported):
        e.convert(b"q", Hints(extension=".x"))


def test_own_converter_of_a_built_in_name():
    e = Engine()
    for c, p in FORMATS:
        e.register(c, p)
    e.register(Converter("zip", lambda d, h, o: model.Result("own"), (".zip",)), model.ARCHIVE)
    assert e.convert(archive({"a.txt": "x"}), Hints(extension=".zip")).markdown == "own\n"


def test_sniffing_reads_a_prefix():
    assert sniff.sniff(b'{"a": [' + b'"x", ' * 9000)[0] == "application/json" and sniff.sniff(b"[1, 2}" + b" " * 9000)[0] == "text/plain"
    assert sniff.sniff(b"{curly} text " * 900)[0] == "text/plain" and sniff.sniff(b'{"a": 1} x')[0] == "text/plain"
    late = archive({f"p{i}": "" for i in range(300)} | {"[Content_Types].xml": "<Types/>", "word/document.xml": "<x/>"})
    assert sniff.sniff(late)[1] == ".docx" and sniff.sniff(doc([("x", True)]))[0] == "application/msword"


def test_limits_stop_the_chain():
    e = Engine()
    e.register(Converter("small", lambda d, h, o: model.Result("x"), (".txt",), input_limit=2), 0)
    with pytest.raises(InputTooLarge):
        e.convert(b"abc", Hints(extension=".txt"))
    with pytest.raises(ResultTooLarge):
        E.convert(b"hello there", Hints(extension=".txt"), Options(max_result=4))
    with pytest.raises(ValueError):
        Options(max_result=0)


def test_can_convert_ignores_fallback():
    assert E.can_convert(Hints(extension=".PDF")) and E.can_convert(Hints(filename="a.docx")) and E.can_convert(Hints(mime_type="text/csv; x"))
    assert not E.can_convert(Hints(extension=".txt")) and not E.can_convert(Hints(charset="utf-8")) and not E.can_convert(Hints())


def test_guesses():
    book = xlsx({"S": "<row><c><v>1</v></c></row>"})
    g = sniff.guesses(book, Hints(extension=".zip"))
    assert [x.extension for x in g] == [".xlsx", ".zip"] and E.convert(book, Hints(extension=".zip")).converter == "xlsx"
    assert len(sniff.guesses(b"a,b\n", Hints(extension=".csv"))) == 1
    assert [x.mime_type for x in sniff.guesses(b"%PDF-1.4", Hints(extension=".csv"))] == ["text/csv", "application/pdf"]
    assert sniff.guesses(b"abc", Hints(charset="KOI8-R"))[0].charset == "koi8-r"
    for hints in (Hints(), Hints(extension=".xlsx"), Hints(mime_type="application/zip")):
        assert E.convert(book, hints).converter == "xlsx"
    with pytest.raises(Unsupported):
        E.convert(bytes(range(256)), Hints())


def test_charsets():
    assert textenc.detect("é".encode()) == "utf-8" and textenc.detect(b"\xff\xfea\0") == "utf-16le" and textenc.detect(b"\xfe\xff\0a") == "utf-16be"
    for name, text in (("shift_jis", "日本語のテキストです。新しい駅"), ("euc-jp", "日本語のテキストです。新しい駅"), ("gbk", "这是一个中文的文本文件"), ("euc-kr", "한국어 문장입니다 안녕하세요"), ("big5", "這是一個繁體中文的檔案")):
        data = text.encode(textenc.codec(name))
        assert textenc.decode(data, textenc.detect(data)) == text, name
    for name, text in (("windows-1250", "Zażółć gęślą jaźń, źdźbło i łąka"), ("iso-8859-2", "Příliš žluťoučký kůň úpěl ďábelské ódy"), ("koi8-r", "Съешь ещё этих мягких булок"), ("windows-1251", "Съешь ещё этих мягких булок"), ("iso-8859-7", "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία"), ("windows-1252", "Où est l’été à Besançon ? Là-bas.")):
        data = text.encode(textenc.codec(name))
        assert textenc.decode(data, textenc.detect(data)) == text, name
    table = "名前,年齢,住所\r\n佐藤太郎,30,東京\r\n三木英子,25,大阪\r\n髙橋淳,35,名古屋\r\n"
    assert textenc.decode(table.encode("cp932"), textenc.detect(table.encode("cp932"))) == table
    west = "größe naïve".encode("cp1252")
    assert textenc.decode(west, textenc.detect(west)) == "größe naïve"
    with pytest.raises(LookupError):
        textenc.decode(b"a", "no-such")
    assert textenc.decode_or_raw(b"a", "no-such") == "a"
    with pytest.raises(ResultTooLarge):
        textenc.decode(b"abcdef", "utf-8", 3)


# --- text formats


def test_csv():
    assert md(b"a;b\n1;2\n3\n4;5;6\n", extension=".csv") == "| a;b |\n| --- |\n| 1;2 |\n| 3 |\n| 4;5;6 |\n"
    assert md(b"a;b\n1;2\n", extension=".csv") == "| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    assert md(b"a,b\n1\n1,2,3\n", extension=".csv") == "| a | b |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |\n"
    assert md(b'a,b\n"x,""y""",2\n', extension=".csv") == '| a | b |\n| --- | --- |\n| x,"y" | 2 |\n'
    assert md(b"", extension=".csv") == ""


def test_html():
    page = """<html><head><title> A  page </title><style>p{}</style></head><body><h1>H</h1><p>x <b>bo<i>th</i></b> <a href="javascript:a()">no</a>
    <a href="/r">yes</a><br>next<p aria-hidden=" TRUE ">gone</p><ul><li>a<li>b<ol><li>c</ol></ul><pre><code>a|b
c</code></pre><blockquote>q</blockquote><p><del>old</del> <img src="data:image/png;base64,AAAA" alt="p"></p>
    <table><tr><th>N<th>V<tr><td>a|b<td>1</table><template>t</template><noscript>n</noscript><svg><text>s</text></svg></body></html>"""
    text, title = htmlmd.convert(page)
    assert title == "A page"
    assert text == "# H\n\nx **bo*th*** no [yes](/r)  \nnext\n\n- a\n- b\n\n  1. c\n\n```\na|b\nc\n```\n\n> q\n\n~~old~~ ![p](data:image/png;base64,...)\n\n| N    | V |\n|------|---|\n| a\\|b | 1 |"
    assert "AAAA" in htmlmd.convert(page, keep_data_uris=True)[0]


def test_html_unclosed_formatting():
    assert htmlmd.convert("<p>a <b>b<p>c</b> d")[0] == "a **b**\n\n**c** d"
    assert htmlmd.convert("")[0] == "" and htmlmd.convert("<!-- c --><p></p>")[0] == ""
    assert htmlmd.convert("<p>a * b_c [d]")[0] == "a \\* b_c \\[d\\]"


def test_charset_of_page():
    page = "<meta charset='windows-1251'><p>Привет".encode("cp1251")
    assert md(page, extension=".html", charset="utf-8").startswith("�") and "Привет" in md(page, extension=".html", charset="no-such")


def test_plain_text_takes_anything_with_a_charset():
    assert E.convert(b"\xcf\xf0\xe8", Hints(charset="windows-1251")).markdown == "При\n"


# --- office formats


def test_docx():
    styles = '<w:style w:type="paragraph" w:styleId="Kid"><w:name w:val="k"/><w:basedOn w:val="H2"/></w:style><w:style w:type="paragraph" w:styleId="H2"><w:name w:val="heading 2"/></w:style>'
    numbering = '<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num>'
    item = lambda text, level: para(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="5"/></w:numPr>')
    body = (
        para("Top", '<w:pStyle w:val="Title"/>') + para("Kid head", '<w:pStyle w:val="Kid"/>') + para("Out", '<w:outlineLvl w:val="2"/>')
        + item("a", 0) + item("b", 1) + item("c", 0)
        + '<w:p><w:r><w:rPr><w:b/><w:i w:val="0"/></w:rPr><w:t>bold</w:t></w:r><w:hyperlink r:id="rL"><w:r><w:t> link</w:t></w:r></w:hyperlink><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t> new</w:t></w:r></w:ins><w:r><w:noBreakHyphen/><w:tab/><w:t>&lt;x&gt;</w:t></w:r><m:oMath><m:r><m:t>E=m</m:t></m:r></m:oMath></w:p>'
        + '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>' + para("A") + "</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>" + para("hid") + "</w:tc><w:tc>" + para("x") + para("y") + "</w:tc></w:tr></w:tbl>"
        + '<w:p><w:r><w:drawing><wp:docPr descr="pic"/><a:blip r:embed="rI"/></w:drawing></w:r></w:p>'
    )
    rels = '<Relationship Id="rL" Target="https://e.org/" TargetMode="External"/><Relationship Id="rI" Target="media/i.png"/>'
    data = docx(body, styles, numbering, rels, {"word/media/i.png": b"\x89PNG"})
    res = E.convert(data, Hints(extension=".docx"))
    assert res.title == "Top"
    assert res.markdown == "# Top\n\n## Kid head\n\n### Out\n\n- a\n\n  1. b\n- c\n\n**bold** [link](https://e.org/) new- \\<x>E=m\n\n| A |          |\n|---|----------|\n|   | x<br />y |\n\n![pic](i.png)\n"
    assert "iVBORw==" in E.convert(data, Hints(), Options(keep_data_uris=True)).markdown
    # Ten styles are looked at; a number without definition makes bullets, an unknown one no list.
    chain = lambda n: "".join(style(f"S{i}", f"s{i}", f"S{i + 1}") for i in range(n)) + style(f"S{n}", "Heading\u00a02" if n > 20 else "heading  2")
    for n, want in ((9, "## x\n"), (10, "x\n")):
        assert md(docx(para("x", '<w:pStyle w:val="S0"/>'), chain(n)), extension=".docx") == want
    numbers = '<w:num w:numId="6"><w:abstractNumId w:val="9"/></w:num>'
    assert md(docx(list_item("x", "6") + list_item("y", "7"), numbering=numbers), extension=".docx") == "- x\n\ny\n"
    wide = md(docx("<w:tbl><w:tr>" + table_cell("A", '<w:gridSpan w:val="1500"/>') + "</w:tr></w:tbl>"), extension=".docx")
    assert wide.split("\n")[0].count("|") == 1501
    with pytest.raises(ConversionFailed):
        md(docx("<w:tbl><w:tr>" + table_cell("A", '<w:gridSpan w:val="99000000"/>') + "</w:tr></w:tbl>"), extension=".docx")
    with pytest.raises(ConversionFailed):
        E.convert(archive({"word/x.xml": "<x/>", "_rels/.rels": "<x/>"}), Hints(extension=".docx"))


def test_pptx():
    grid = '<p:graphicFrame><p:xfrm><a:off x="0" y="50"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>h</a:t></a:r></a:p></a:txBody></a:tc><a:tc/></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    chart = '<p:graphicFrame><p:xfrm><a:off x="0" y="60"/></p:xfrm><a:graphic><a:graphicData><c:chart r:id="rC"/></a:graphicData></a:graphic></p:graphicFrame>'
    group = '<p:grpSp><p:grpSpPr><a:xfrm><a:off x="0" y="5"/></a:xfrm></p:grpSpPr>' + shape("g2", 2) + shape("g1", 1) + "</p:grpSp>"
    pts = lambda kind, vals: f"<c:{kind}>" + "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in vals.items()) + f"</c:{kind}>"
    ser = f"<c:ser><c:tx><c:strRef>{pts('strCache', {0: 'S'})}</c:strRef></c:tx><c:cat><c:strRef>{pts('strCache', {0: 'q', 2: 'r'})}</c:strRef></c:cat><c:val><c:numRef>{pts('numCache', {0: 1, 1: 2})}</c:numRef></c:val></c:ser><c:ser><c:val><c:numRef>{pts('numCache', {1: 9})}</c:numRef></c:val></c:ser>"
    space = f'<c:chartSpace xmlns:c="urn:c" xmlns:a="urn:a"><c:chart><c:title><c:tx><c:rich><a:p><a:r><a:t>T</a:t></a:r></a:p></c:rich></c:tx></c:title><c:plotArea><c:barChart>{ser}</c:barChart></c:plotArea></c:chart></c:chartSpace>'
    notes = f'<p:notes xmlns:p="urn:p" xmlns:a="urn:a"><p:cSld><p:spTree>{shape("num", ph="sldNum")}{shape("the note", ph="body")}</p:spTree></p:cSld></p:notes>'
    data = pptx([shape("low", 30) + shape("My\nTitle", 1, ph="title") + group + shape("first") + grid + chart], ['<Relationship Id="rC" Target="../charts/c.xml"/><Relationship Id="rN" Target="../notesSlides/n.xml"/>'], {"ppt/charts/c.xml": space, "ppt/notesSlides/n.xml": notes})
    res = E.convert(data, Hints(extension=".pptx"))
    assert res.title == "My Title"
    assert res.markdown == "<!-- Slide number: 1 -->\n\nfirst\n\n# My Title\n\ng1\n\ng2\n\nlow\n\n| h |  |\n| --- | --- |\n\n### Chart: T\n\n| Category | S | Series 2 |\n| --- | --- | --- |\n| q | 1 |  |\n|  | 2 | 9 |\n| r |  |  |\n\n### Notes:\n\nthe note\n"


def test_xlsx():
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="10"/><xf numFmtId="164"/><xf numFmtId="4"/></cellXfs>'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" s="1"><v>0.125</v></c><c r="B3" s="2"><v>45292</v></c><c r="C3" s="3"><v>1234.5</v></c></row><row r="9"><c r="D9" t="inlineStr"><is><t> </t></is></c></row>'
    data = xlsx({"One": rows, "Empty": ""}, ["k|1", "v"], styles)
    assert md(data, extension=".xlsx") == "## One\n\n| k\\|1 |  | v |\n| --- | --- | --- |\n|  |  |  |\n| 12.50% | 2024-01-01 | 1,234.50 |\n\n## Empty\n"
    assert X.shown("3", "General", False) == "3" and X.shown("0.1", "", False) == "0.1" and X.shown("-5", "0.0;(0.0)", False) == "(5.0)"
    assert X.shown("1.5", "h:mm", False) == "12:00" and X.shown("12345", "0.00E+00", False) == "1.23E+04"
    with pytest.raises(ConversionFailed):  # a row budget is no RESULT_TOO_LARGE
        E.convert(xlsx({"S": "".join(f"<row><c><v>{i}</v></c></row>" for i in range(50))}), Hints(extension=".xlsx"), Options(max_result=40))


def test_archive_guards():
    with pytest.raises(ooxml.TooManyEntries):
        ooxml.preflight(archive({f"f{i}": "" for i in range(1025)}))
    with pytest.raises(ValueError):
        ooxml.preflight(b"PK")
    with pytest.raises(ooxml.TooComplex):
        ooxml.tree(b"<a>" * 300 + b"</a>" * 300)
    with pytest.raises(ValueError):
        ooxml.tree(b"<a><b></a>")


def test_doc():
    data = doc([("Caf\xe9 \x93q\x94\r".encode("latin-1").decode("cp1252"), True), ("\x13 HYPERLINK \"u\" \x14link\x15 \U0001f600\x0c", False)])
    assert md(data, extension=".doc") == "Café “q”\nlink 😀\n"
    with pytest.raises(ConversionFailed):
        E.convert(doc([("x", True)], encrypted=True), Hints(extension=".doc"))
    plc = lambda bounds, *fcs: struct.pack(f"<{len(bounds)}I", *bounds) + b"".join(struct.pack("<HIH", 0, fc, 0) for fc in fcs)
    assert legacydoc.pieces(plc([0, 4], 2048 * 2 | 0x40000000), 4) == [(0, 4, 2048, True)] and legacydoc.pieces(plc([5]), 0) == []
    for bad in (plc([0, 3], 0), plc([1, 9], 0), plc([0, 9], 2049 | 0x40000000), plc([0, 2, 2, 9], 0, 0, 0)):
        with pytest.raises(ValueError):
            legacydoc.pieces(bad, 4)
    assert legacydoc.visible("a\x07b\x1ec\x1fd\x0be") == "a\tb-cd\ne"


# --- PDF and OCR


def test_pdf_text():
    data = pdf(["BT /F1 12 Tf 72 700 Td (Hello) Tj 40 0 Td (world) Tj 0 -20 Td [(a) -20 (b) -900 (c)] TJ ET", "BT /F1 12 Tf 72 700 Td (p\\(2\\)) Tj ET"], flate=True)
    assert md(data, extension=".pdf") == "Hello world\nab c\n\np(2)\n"
    assert md(data.replace(b"startxref", b"startxxxx"), extension=".pdf") == "Hello world\nab c\n\np(2)\n"


def test_pdf_encrypted():
    """Opened by the empty password; the ciphers by their published vectors."""
    assert pdfcrypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    keys = pdfcrypt._round_keys(bytes(range(16)))
    assert pdfcrypt.aes_block(keys, bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")) == bytes.fromhex("00112233445566778899aabbccddeeff")
    owner, ident = b"o" * 32, b"i" * 16
    key = hashlib.md5(pdfcrypt.PAD + owner + struct.pack("<i", -4) + ident).digest()[:5]
    text = b"BT /F1 12 Tf 72 700 Td (secret page) Tj ET"
    own = hashlib.md5(key + b"\x0b\0\0" + b"\0\0").digest()[:10]
    for user, opens in ((pdfcrypt.rc4(key, pdfcrypt.PAD), True), (b"u" * 32, False)):
        lock = f"/Encrypt << /Filter /Standard /V 1 /R 2 /O <{owner.hex()}> /U <{user.hex()}> /P -4 >> /ID [<{ident.hex()}> <{ident.hex()}>] /Root".encode()
        data = pdf([text.decode()]).replace(text, pdfcrypt.rc4(own, text)).replace(b"/Root", lock)
        if opens:
            assert md(data, extension=".pdf") == "secret page\n"
        else:
            with pytest.raises(ConversionFailed, match="password"):
                md(data, extension=".pdf")


def test_pdf_warnings_and_ocr():
    scan = "<< /XObject << /I << /a 1 >> >> >>"
    data = pdf(["BI /W 1 ID x EI ", "BT /F1 9 Tf 10 10 Td (typed) Tj ET"])
    res = E.convert(data, Hints())
    assert [(w.code, w.location) for w in res.warnings] == [("incomplete", "page 1")] and "scan" in res.warnings[0].message and scan
    res = E.convert(data, Hints(), Options(ocr=lambda d, n: f"read {n}", marker="x"))
    assert res.markdown == "<!-- x: page 1 includes OCR text -->\n\nread 1\n\ntyped\n" and not res.warnings
    with pytest.raises(ConversionFailed) as err:
        E.convert(pdf(["BI /W 1 ID x EI "]), Hints())
    assert "1 warning(s) along the way" in str(err.value)
    with pytest.raises(pdftext.PdfError):
        pdftext.extract(b"nothing")


def test_ocr_budget_is_exact_between_threads():
    calls = []
    limit = OcrLimit(lambda d, n: calls.append(n) or "t", max_pages=4)
    refused = []

    def work(n):
        try:
            limit(b"", n)
        except Exception as e:
            refused.append(str(e))

    threads = [threading.Thread(target=work, args=(n,)) for n in range(32)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(calls) == 4 and sorted(map(bool, refused)) == [False] * 27 + [True]
    with pytest.raises(TimeoutError):
        OcrLimit(lambda d, n: __import__("time").sleep(2), per_page=0.05)(b"", 1)
    with pytest.raises(ValueError):
        Options(ocr_min_glyphs=5)
    assert Options(ocr_policy="thin").glyph_floor == 50


# --- archives


def test_zip():
    inner = archive({"a.txt": "x"})
    data = archive({"b.txt": "hi\n", ".hid": "h", "__MACOSX/x": "m", "d/in.zip": inner, "i.png": b"\x89PNG\r\n\x1a\n\0", "bad.docx": b"PK\x03\x04nope", "t.csv": "a,b\n1,2\n"})
    res = E.convert(data, Hints(extension=".zip"))
    assert res.markdown.startswith("## File: b.txt\n\nhi\n\n## File: bad.docx\n\n[conversion failed: ")
    assert res.markdown.endswith("## File: t.csv\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n")
    assert [(w.code, w.location) for w in res.warnings] == [("skipped", "d/in.zip"), ("skipped", "i.png"), ("incomplete", "bad.docx")]
    many = E.convert(archive({f"{i:03}.txt": "x" for i in range(70)}), Hints())
    assert many.markdown.count("## File") == 64 and many.markdown.endswith("skipped ...]\n") and many.warnings[-1].location == ""
    with pytest.raises(ConversionFailed):
        E.convert(archive({"x.png": b"\x89PNG\r\n\x1a\n"}), Hints())
    with pytest.raises(ConversionFailed):  # output overflow is the archive's failure, not RESULT_TOO_LARGE
        E.convert(archive({"a.txt": "x" * 500}), Hints(), Options(max_result=100))


def test_member_warnings_are_relocated():
    res = E.convert(archive({"p.pdf": pdf(["BI /W 1 ID x EI ", "BT /F1 9 Tf 10 10 Td (typed) Tj ET"])}), Hints())
    assert res.warnings[0].location == "p.pdf: page 1" and res.warnings[0].converter == "pdf"


def test_warning_bound():
    ws = model.add_warnings([], [model.Warn("c", "skipped", str(i), "m") for i in range(512)])
    assert len(ws) == 256 and ws[-1].message == model.SUPPRESSED and ws[-1].code == "incomplete" and ws[-1].location == ""
    assert model.Warn("c", "x", "l", "m").text() == "c: l: m" and model.Warn("", "x", "l", "m").text() == "m"
