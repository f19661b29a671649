"""Registered queries that go through the converters: documents of each format made from rows of tables, and the SQL of their Markdown.

A document is a customer with its orders, or a newspaper page: its size does not grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.model import ARCHIVE, SPECIFIC, Options, Result
from inkloom.plans import samples as M
from inkloom.plans.convert import convert, to_json_lines
from inkloom.plans.queries import _sql_normal, query, t
from inkloom.sources.engine import Converter
from inkloom.sources.pdf import SCANNED


def _customers(spark, d):
    """(c_custkey, name, segment, nation, orders): customers with their orders by key, a few dozen at most; nation has 25 rows.

    Rows are few bytes but each becomes a document, so the number of partitions is given and not left to their size.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").repartition(n, "c_custkey").groupBy("c_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total"), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")))).alias("orders"))
    nation = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    c = t(spark, d, "customer").repartition(n, "c_custkey").join(orders, "c_custkey", "left").join(F.broadcast(nation), "c_nationkey", "left")
    return c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "nation", F.coalesce("orders", F.array().cast(orders.schema["orders"].dataType)).alias("orders"))


_LF = "chr(10)"
_C = """c AS (SELECT c_custkey, c_name AS name, c_mktsegment AS segment, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey),
o AS (SELECT o_custkey AS c_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS total, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"""


def _lines(*parts: str) -> str:
    """SQL of lines one below the other."""
    return " || chr(10) || ".join(parts)


def _converted(spark, d, build, extension: str, options: Options | None = None, **more):
    return convert(M.made(_customers(spark, d), "c_custkey", build).withColumn("extension", F.lit(extension)), options, **more)


# --- DOCX ------------------------------------------------------------------------------------------------------------

DOCX_STYLES = M.style("Kid", "kid", "Mid") + M.style("Mid", "mid", "Heading2") + M.style("Top", "title") + M.style("Deep", "deep", "", 3)
DOCX_NUMBERS = '<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="6"><w:abstractNumId w:val="9"/></w:num>'
DOCX_RELS = '<Relationship Id="rL" Target="https://e.org/x" TargetMode="External"/><Relationship Id="rI" Target="media/i.png"/>'


SPAN = '<w:gridSpan w:val="2"/>'


def _docx(name, segment, nation, orders):
    run = "<w:r><w:rPr><w:b/><w:i w:val=\"0\"/></w:rPr><w:t>" + segment + "</w:t></w:r>"
    inline = f'<w:p>{run}<w:r><w:t> see </w:t></w:r><w:hyperlink r:id="rL"><w:r><w:t>home</w:t></w:r></w:hyperlink><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t> new</w:t></w:r></w:ins><w:r><w:noBreakHyphen/><w:t>end</w:t></w:r></w:p>'
    image = '<w:p><w:r><w:drawing><wp:docPr descr="pic"/><a:blip r:embed="rI"/></w:drawing></w:r></w:p>'
    rows = "".join(f"<w:tr>{M.table_cell(str(o['o_orderkey']))}{M.table_cell(o['o_orderpriority'])}{M.table_cell(o['total'])}</w:tr>" for o in orders)
    table = f"<w:tbl><w:tr>{M.table_cell('Order', SPAN)}{M.table_cell('Total')}</w:tr>{rows}<w:tr>{M.table_cell('hidden', '<w:vMerge/>')}{M.table_cell('all')}{M.table_cell(str(len(orders)))}</w:tr></w:tbl>"
    body = M.para(name, '<w:pStyle w:val="Top"/>') + M.para(f"Orders of {segment}", '<w:pStyle w:val="Kid"/>') + M.para("By outline", '<w:pStyle w:val="Deep"/>')
    body += M.list_item(f"nation {nation}", "5") + M.list_item("inner", "5", 1) + M.list_item("no definition", "6") + M.list_item("no number", "9") + inline + table + image
    return M.docx(body, DOCX_STYLES, DOCX_NUMBERS, DOCX_RELS, {"word/media/i.png": b"\x89PNG"})


@query(f"""WITH {_C}, w AS (SELECT c.*, count(o_orderkey) AS n, greatest(5, coalesce(max(length(o_orderkey::VARCHAR)), 0)) AS w1, greatest(3, coalesce(max(length(priority)), 0)) AS w2, greatest(5, coalesce(max(length(total)), 0), length(count(o_orderkey)::VARCHAR)) AS w3 FROM c LEFT JOIN o USING (c_custkey) GROUP BY ALL),
r AS (SELECT c_custkey, string_agg('| ' || rpad(o_orderkey::VARCHAR, w1::INT, ' ') || ' | ' || rpad(priority, w2::INT, ' ') || ' | ' || rpad(total, w3::INT, ' ') || ' |' || chr(10), '' ORDER BY o_orderkey) AS body FROM w JOIN o USING (c_custkey) GROUP BY 1)
SELECT w.c_custkey, {_lines("'# ' || name", "''", "'## Orders of ' || segment", "''", "'#### By outline'", "''", "'- nation ' || nation", "''", "'  1. inner'", "'- no definition'", "''", "'no number'", "''", "'**' || segment || '** see [home](https://e.org/x) new-end'", "''",
    "'| ' || rpad('Order', w1::INT, ' ') || ' | ' || rpad('', w2::INT, ' ') || ' | ' || rpad('Total', w3::INT, ' ') || ' |'", "'|' || repeat('-', w1::INT + 2) || '|' || repeat('-', w2::INT + 2) || '|' || repeat('-', w3::INT + 2) || '|'",
    "coalesce(body, '') || '| ' || rpad('', w1::INT, ' ') || ' | ' || rpad('all', w2::INT, ' ') || ' | ' || rpad(n::VARCHAR, w3::INT, ' ') || ' |'", "''", "'![pic](i.png)'", "''")} AS markdown, name AS title, 'docx' AS converter FROM w LEFT JOIN r USING (c_custkey)""")
def convert_docx(spark, d):
    """Style chains, outline levels, lists with and without definition, marks, links, tracked changes, spans, merges, images."""
    return _converted(spark, d, _docx, ".docx").select("c_custkey", "markdown", "title", "converter")


# --- XLSX ------------------------------------------------------------------------------------------------------------

XLSX_STYLES = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="2"/><xf numFmtId="164"/><xf numFmtId="3"/><xf numFmtId="9"/></cellXfs>'


def _xlsx(name, segment, nation, orders):
    import datetime as dt

    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>To|tal</t></is></c><c r="E1" t="b"><v>1</v></c></row>'
    rows = []
    for i, o in enumerate(orders, 3):
        serial = (dt.date.fromisoformat(o["day"]) - dt.date(1899, 12, 30)).days
        rows.append(f'<row r="{i}"><c r="A{i}" s="3"><v>{o["o_orderkey"]}</v></c><c r="B{i}" s="2"><v>{serial}</v></c><c r="C{i}" s="1"><v>{o["total"]}</v></c><c r="D{i}" s="4"><v>0.25</v></c></row>')
    blank = f'<row r="{len(orders) + 9}"><c r="H1" t="inlineStr"><is><t>  </t></is></c></row>'
    return M.xlsx({"Orders": head + "".join(rows) + blank, "Empty": "", "About": f'<row r="1"><c r="B1" t="inlineStr"><is><t>{name}</t></is></c></row>'}, ["Order", "Day"], XLSX_STYLES)


@query(f"""WITH {_C}, r AS (SELECT c_custkey, string_agg('| ' || format('{{:,}}', o_orderkey) || ' | ' || day || ' | ' || total || ' | 25% |  |' || chr(10), '' ORDER BY o_orderkey) AS body FROM o GROUP BY 1)
SELECT c_custkey, {_lines("'## Orders'", "''", "'| Order | Day | To' || chr(92) || '|tal |  | TRUE |'", "'| --- | --- | --- | --- | --- |'", "CASE WHEN body IS NULL THEN '' ELSE '|  |  |  |  |  |' || chr(10) || body END")} || {_lines("''", "'## Empty'", "''", "'## About'", "''", "'|  | ' || name || ' |'", "'| --- | --- |'", "''")} AS markdown, 'xlsx' AS converter FROM c LEFT JOIN r USING (c_custkey)""")
def convert_xlsx(spark, d):
    """Sheets in order, shared and inline strings, number formats, gaps, blank rows and columns at the end, an empty sheet."""
    return _converted(spark, d, _xlsx, ".xlsx").select("c_custkey", "markdown", "converter")


# --- PPTX ------------------------------------------------------------------------------------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _pptx(name, segment, nation, orders):
    from collections import Counter

    count = Counter(o["o_orderpriority"] for o in orders)
    cats = {i: p for i, p in enumerate(PRIORITIES) if count[p]}
    values = {i: str(count[p]) for i, p in enumerate(PRIORITIES) if count[p]}
    shapes = "".join(M.shape(f"order {o['o_orderkey']}", int(float(o["total"])), o["o_orderkey"]) for o in orders)
    group = '<p:grpSp><p:grpSpPr><a:xfrm><a:off x="0" y="-5"/></a:xfrm></p:grpSpPr>' + M.shape("in group, second", 9) + M.shape("in group, first", 1) + "</p:grpSp>"
    picture = '<p:pic><p:nvPicPr><p:cNvPr name="n" descr="a|b"/></p:nvPicPr><p:blipFill><a:blip r:embed="rI"/></p:blipFill><p:spPr><a:xfrm><a:off x="0" y="-9"/></a:xfrm></p:spPr></p:pic>'
    first = shapes + M.shape(name, -20, ph="title") + group + picture + M.shape("without place")
    second = M.chart_frame("rC", 60) + M.slide_table([["nation", "segment"], [nation or "", segment]], 50)
    return M.pptx([first, second], ['<Relationship Id="rI" Target="../media/i.png"/>', '<Relationship Id="rC" Target="../charts/c.xml"/><Relationship Id="rN" Target="../notesSlides/n.xml"/>'], {"ppt/charts/c.xml": M.chart("Priorities", [("Orders", cats, values), ("Shifted", {}, {i + 1: v for i, v in values.items()})]), "ppt/notesSlides/n.xml": M.notes("Note of " + segment)})


_PRIORITY_NO = "(left(priority, 1)::INT - 1)"


@query(f"""WITH {_C}, s AS (SELECT c_custkey, string_agg('order ' || o_orderkey || chr(10) || chr(10), '' ORDER BY trunc(total::DOUBLE), o_orderkey) AS shapes FROM o GROUP BY 1),
v AS (SELECT c_custkey, {_PRIORITY_NO} AS idx, any_value(priority) AS cat, count(*)::VARCHAR AS n FROM o GROUP BY 1, 2),
g AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(a.idx, b.idx + 1) AS idx, coalesce(a.cat, '') AS cat, coalesce(a.n, '') AS n, coalesce(b.n, '') AS m FROM v a FULL JOIN v b ON a.c_custkey = b.c_custkey AND a.idx = b.idx + 1),
h AS (SELECT c_custkey, string_agg('| ' || cat || ' | ' || n || ' | ' || m || ' |' || chr(10), '' ORDER BY idx) AS chart FROM g GROUP BY 1)
SELECT c.c_custkey, {_lines("'<!-- Slide number: 1 -->'", "''", "'without place'", "''", "'# ' || name", "''", "'![a' || chr(92) || '|b](i.png)'", "''", "'in group, first'", "''", "'in group, second'", "''", "coalesce(shapes, '')")} || {_lines("'<!-- Slide number: 2 -->'", "''", "'| nation | segment |'", "'| --- | --- |'", "'| ' || nation || ' | ' || segment || ' |'", "''", "'### Chart: Priorities'", "''", "'| Category | Orders | Shifted |'", "'| --- | --- | --- |'", "coalesce(chart, '')", "'### Notes:'", "''", "'Note of ' || segment", "''")} AS markdown, name AS title, 'pptx' AS converter
FROM c LEFT JOIN s USING (c_custkey) LEFT JOIN h USING (c_custkey)""")
def convert_pptx(spark, d):
    """Shapes by position, titles, groups, pictures, tables, charts as full outer joins of their points, notes."""
    return _converted(spark, d, _pptx, ".pptx").select("c_custkey", "markdown", "title", "converter")


# --- DOC -------------------------------------------------------------------------------------------------------------


def _doc(doc_id, text):
    link = '\x13 HYPERLINK "https://e.org" \x14the link\x15\r'
    return M.doc([(f"Page {doc_id} “quoted”\r", True), (link + text.replace("\n", "\r"), False)])


@query("SELECT doc_id, " + _sql_normal(r"'Page ' || doc_id || ' “quoted”' || chr(10) || 'the link' || chr(10) || regexp_replace(replace(replace(text, chr(10), chr(13)), chr(9), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')") + " AS markdown, 'doc' AS converter FROM documents WHERE text IS NOT NULL")
def convert_doc(spark, d):
    """Whole newspaper pages as Word binaries: a piece of one-byte and one of two-byte characters, a field, control characters."""
    docs = t(spark, d, "documents").where("text is not null").select("doc_id", F.col("doc_id").alias("no"), F.regexp_replace(F.replace("text", F.lit("\t"), F.lit(" ")), r"[\x0b\x0c\x07]", "").alias("text"))
    return convert(M.made(docs, "doc_id", _doc).withColumn("mime_type", F.lit("application/msword"))).select("doc_id", "markdown", "converter")


# --- PDF -------------------------------------------------------------------------------------------------------------


def _pdf(name, segment, nation, orders):
    return M.pdf([M.pdf_text([name, f"of ({nation})"]), "BI /W 1 ID x EI ", M.pdf_text([segment, *(f"order {o['o_orderkey']}" for o in orders)])], flate=True)


_ORDERS_BELOW = "coalesce((SELECT string_agg(chr(10) || 'order ' || o_orderkey, '' ORDER BY o_orderkey) FROM o WHERE o.c_custkey = c.c_custkey), '')"


@query(f"WITH {_C} SELECT c_custkey, name || chr(10) || 'of (' || nation || ')' || chr(10) || chr(10) || segment || {_ORDERS_BELOW} || chr(10) AS markdown, 'pdf' AS converter, 1::BIGINT AS n_warnings, 'incomplete page 2 {SCANNED}' AS warning FROM c")
def convert_pdf(spark, d):
    """Pages of text, and one that only paints an image and is warned of."""
    w = F.element_at("warnings", 1)
    return _converted(spark, d, _pdf, ".pdf").select("c_custkey", "markdown", "converter", F.size("warnings").cast("long").alias("n_warnings"), F.concat_ws(" ", w["code"], w["location"], w["message"]).alias("warning"))


@query(f"WITH {_C} SELECT c_custkey, name || chr(10) || 'of (' || nation || ')' || chr(10) || chr(10) || '<!-- scan: page 2 includes OCR text -->' || chr(10) || chr(10) || 'read 2' || chr(10) || chr(10) || segment || {_ORDERS_BELOW} || chr(10) AS markdown, 0::BIGINT AS n_warnings FROM c")
def convert_pdf_with_ocr(spark, d):
    """The same with an OCR engine, which is asked for the page without text only."""
    return _converted(spark, d, _pdf, ".pdf", Options(ocr=lambda data, page: f"read {page}", marker="scan")).select("c_custkey", "markdown", F.size("warnings").cast("long").alias("n_warnings"))


@query("SELECT c_custkey, c_name || ' of ' || c_mktsegment || chr(10) AS markdown, 'pdf' AS converter FROM customer")
def convert_pdf_forms(spark, d):
    """Text painted by a form object in a composite font, readable by its ToUnicode map alone; without any hint."""
    src = t(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" of "), "c_mktsegment").alias("text"))
    return convert(M.made(src, "c_custkey", M.form_pdf)).select("c_custkey", "markdown", "converter")


# --- HTML, CSV -------------------------------------------------------------------------------------------------------


def _html(name, segment, nation, orders):
    rows = "".join(f"<tr><td>{o['o_orderkey']}</td><td>{o['total']}" for o in orders)
    return (
        f"<!DOCTYPE html><html><head><title> {name}\n page </title><style>p {{}}</style></head><body><!-- c --><h2>{segment}</h2><ul><li>one<ul><li>two {nation}</ul></ul><pre><code>a  b\nc</code></pre><blockquote><p>q</p></blockquote>"
        f'<p><del>old</del> <em>e</em> <code>k</code> <a href="javascript:x()">bad</a> <a href="https://e.org/{segment}">ok</a> <img src="data:image/png;base64,AAAA" alt="p"><p hidden>gone</p><noscript>gone</noscript>'
        f"<table><tr><th>order<th>total{rows}</table><ol><li>x<li>y</ol><hr><p>a<br>b"
    ).encode()


@query(f"""WITH {_C}, w AS (SELECT c.*, greatest(5, coalesce(max(length(o_orderkey::VARCHAR)), 0)) AS w1, greatest(5, coalesce(max(length(total)), 0)) AS w2 FROM c LEFT JOIN o USING (c_custkey) GROUP BY ALL),
r AS (SELECT c_custkey, string_agg('| ' || rpad(o_orderkey::VARCHAR, w1::INT, ' ') || ' | ' || rpad(total, w2::INT, ' ') || ' |' || chr(10), '' ORDER BY o_orderkey) AS body FROM w JOIN o USING (c_custkey) GROUP BY 1)
SELECT w.c_custkey, {_lines("'## ' || segment", "''", "'- one'", "''", "'  - two ' || nation", "''", "'```'", "'a  b'", "'c'", "'```'", "''", "'> q'", "''", "'~~old~~ *e* `k` bad [ok](https://e.org/' || segment || ') ![p](data:image/png;base64,...)'", "''",
    "'| ' || rpad('order', w1::INT, ' ') || ' | ' || rpad('total', w2::INT, ' ') || ' |'", "'|' || repeat('-', w1::INT + 2) || '|' || repeat('-', w2::INT + 2) || '|'", "coalesce(body, '')", "'1. x'", "'2. y'", "''", "'* * *'", "''", "'a  '", "'b'", "''")} AS markdown, name || ' page' AS title FROM w LEFT JOIN r USING (c_custkey)""".replace("'a  '", "'a'"))
def convert_html_elements(spark, d):
    """Nested lists, code, quotes, marks, unsafe links, data URIs, hidden elements, tables with open tags."""
    return _converted(spark, d, _html, ".html").select("c_custkey", "markdown", "title")


def _sjis(name, segment, nation, orders):
    lines = ["名前,番号,価格", *(f'"{name}, 様",注文{o["o_orderkey"]},{o["total"]}円' for o in orders), "合計"]
    return "\r\n".join(lines).encode("cp932")


@query(f"""WITH {_C} SELECT c_custkey, '| 名前 | 番号 | 価格 |' || chr(10) || '| --- | --- | --- |' || chr(10) || coalesce((SELECT string_agg('| ' || name || ', 様 | 注文' || o_orderkey || ' | ' || total || '円 |' || chr(10), '' ORDER BY o_orderkey) FROM o WHERE o.c_custkey = c.c_custkey), '') || '| 合計 |  |  |' || chr(10) AS markdown FROM c""")
def convert_csv_shift_jis(spark, d):
    """CSV in Shift_JIS with quotes and a short row, its charset found by content."""
    return _converted(spark, d, _sjis, ".csv").select("c_custkey", "markdown")


# --- ZIP -------------------------------------------------------------------------------------------------------------


def _zip(name, segment, nation, orders):
    table = "order;total\n" + "".join(f"{o['o_orderkey']};{o['total']}\n" for o in orders)
    many = {f"notes/{o['o_orderkey']}.txt": f"{o['o_orderpriority']}  \n" for o in orders}
    return M.archive({"readme.txt": name, ".hidden": "h", "__MACOSX/x.txt": "m", "folder/": "", "inner/more.zip": M.archive({"a.txt": "x"}), "i.png": b"\x89PNG\r\n\x1a\n\0", "broken.pdf": "%PDF-1.4 nothing", "data/orders.csv": table, **many})


@query(f"""WITH {_C} SELECT c_custkey, '## File: readme.txt' || chr(10) || chr(10) || name || chr(10) || chr(10) || chr(10) || '## File: data/orders.csv' || chr(10) || chr(10) || '| order | total |' || chr(10) || '| --- | --- |' || chr(10) || coalesce((SELECT string_agg('| ' || o_orderkey || ' | ' || total || ' |' || chr(10), '' ORDER BY o_orderkey) FROM o WHERE o.c_custkey = c.c_custkey), '')
|| coalesce((SELECT string_agg(chr(10) || '## File: notes/' || o_orderkey || '.txt' || chr(10) || chr(10) || priority || chr(10), '' ORDER BY o_orderkey) FROM o WHERE o.c_custkey = c.c_custkey), '') AS markdown, 'skipped inner/more.zip,skipped i.png,incomplete broken.pdf' AS warned FROM c""".replace("|| chr(10) || chr(10) || chr(10) || '## File: data", "|| chr(10) || chr(10) || '## File: data"))
def convert_zip(spark, d):
    """Members by converter, silent and nested ones, one that is not supported, one that fails (its section left out here)."""
    out = _converted(spark, d, _zip, ".zip")
    kept = F.regexp_replace("markdown", r"\n## File: broken\.pdf\n\n\[conversion failed: [^\n]*\n  [^\n]*\]\n", "")
    return out.select("c_custkey", kept.alias("markdown"), F.array_join(F.transform("warnings", lambda w: F.concat_ws(" ", w["code"], w["location"])), ",").alias("warned"))


# --- the chain, limits, own converters ---------------------------------------------------------------------------------


@query("SELECT doc_id, " + _sql_normal("text") + " AS markdown, 'plaintext' AS converter FROM documents WHERE text IS NOT NULL")
def convert_misnamed(spark, d):
    """Texts named .docx: the hinted converter fails, the sniffed interpretation has its turn."""
    src = t(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.lit("x.docx").alias("filename"), F.lit(".docx").alias("extension"))
    return convert(src).select("doc_id", "markdown", "converter")


@query("SELECT doc_id, kind, CASE kind WHEN 'broken' THEN 'CONVERSION_FAILED' ELSE 'UNSUPPORTED_FORMAT' END AS code, CASE kind WHEN 'broken' THEN 'docx' ELSE '' END AS tried, kind = 'broken' AS counted FROM documents, (VALUES ('broken'), ('unknown'), ('declined')) k(kind)")
def convert_failures(spark, d):
    """Broken archives, bytes that no converter takes, streams whose only converter declines."""
    kinds = F.explode(F.array(F.lit("broken"), F.lit("unknown"), F.lit("declined"))).alias("kind")
    src = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), kinds)
    head = F.when(F.col("kind") == "broken", F.unhex(F.lit("504B0304"))).otherwise(F.unhex(F.lit("000102")))
    ext = F.when(F.col("kind") == "broken", ".docx").when(F.col("kind") == "declined", ".own").otherwise("")
    own = Converter("own", lambda data, hints, options: None, (".own",))
    out = convert(src.select("doc_id", "kind", F.concat(head, F.encode("text", "UTF-8")).alias("content"), ext.alias("extension")), extra=[(own, SPECIFIC)])
    return out.select("doc_id", "kind", F.col("error.code").alias("code"), F.array_join(F.transform("error.attempts", lambda a: a["converter"]), ",").alias("tried"), F.startswith("error.message", F.lit("conversion failed after 1 attempt(s):")).alias("counted"))


@query("SELECT doc_id, CASE WHEN greatest(octet_length(encode(text)), octet_length(encode(" + _sql_normal("text") + "))) > 900 THEN 'RESULT_TOO_LARGE' END AS code FROM documents WHERE text IS NOT NULL")
def convert_with_limit(spark, d):
    """A result limit, tested before and after normalisation."""
    src = t(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.lit(".txt").alias("extension"))
    return convert(src, Options(max_result=900)).select("doc_id", F.col("error.code").alias("code"))


@query("SELECT doc_id, 'INPUT_TOO_LARGE' AS code, 'xlsx' AS named FROM documents WHERE n_chars > 1000")
def convert_beyond_input_limit(spark, d):
    """Streams whose stated length is above the limit of a converter that takes them: an error, and the content is not looked at."""
    docs = t(spark, d, "documents").where("text is not null")
    src = docs.select("doc_id", F.when(F.col("n_chars") > 1000, 65 << 20).otherwise(10).cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"), F.lit(".xlsx").alias("extension"))
    out = convert(src).where("error.code = 'INPUT_TOO_LARGE'")
    return out.select("doc_id", F.col("error.code").alias("code"), F.regexp_extract("error.message", r"^(\w+):", 1).alias("named"))


def _shout(data, hints, options):
    return Result(data.decode().upper(), "own")


@query("SELECT c_custkey, upper(c_name) || chr(10) AS markdown, 'own' AS title, converter FROM customer, (VALUES ('csv'), ('zip')) k(converter)")
def convert_by_own_converters(spark, d):
    """Converters of the caller under the names of built-in ones: the later registration shadows."""
    own = [(Converter("csv", _shout, (".csv",), ("text/csv",)), SPECIFIC), (Converter("zip", _shout, (".zip",), ("application/zip",)), ARCHIVE)]
    src = t(spark, d, "customer").select("c_custkey", F.encode("c_name", "UTF-8").alias("content"), F.explode(F.array(F.lit(".csv"), F.lit(".zip"))).alias("extension"))
    return convert(src, extra=own).select("c_custkey", "markdown", "title", "converter")


@query("""SELECT '{"markdown":"' || c_name || '\\n","title":"","warnings":[]}' AS value FROM customer UNION ALL SELECT '{"error":{"code":"UNSUPPORTED_FORMAT","message":"unsupported format","attempts":[]}}' FROM customer""".replace("\\\\n", "\\n"))
def json_lines(spark, d):
    """Results and errors as JSON lines."""
    c = t(spark, d, "customer")
    src = c.select(F.encode("c_name", "UTF-8").alias("content"), F.lit(".txt").alias("extension")).unionByName(c.select(F.unhex(F.lit("000102")).alias("content"), F.lit("").alias("extension")))
    return to_json_lines(convert(src))
