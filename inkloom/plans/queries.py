"""Registered core queries: every operator over whole tables, and for those that SQL can express the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import hints as H
from inkloom.functions.normalize import normalized
from inkloom.functions.tables import escaped_cell, pipe_table
from inkloom.model import GENERIC, Options
from inkloom.operators import assembly as A
from inkloom.operators import registry as R
from inkloom.plans.convert import convert, to_json_lines
from inkloom.sources import textenc
from inkloom.sources.engine import FORMATS, PLAIN_TEXT
from inkloom.sources.pdf import NO_IMAGES, SCANNED
from inkloom.sources.sniff import EXT_MIME, MIME_EXT, ZIP_MIMES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- pieces of SQL -------------------------------------------------------------------------------------------------


def _sql_normal(x: str) -> str:
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[ \t]+(\n|\z)', '\1', 'g')"
    x = rf"trim(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = '' THEN '' ELSE {x} || chr(10) END"


_WS = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _sql_cell(x: str) -> str:
    x = rf"replace(regexp_replace(coalesce({x}, ''), '\r\n|\r|\n', ' ', 'g'), '|', '\|')"
    return rf"regexp_replace(regexp_replace({x}, '^{_WS}', ''), '{_WS}$', '')"


def _sql_map(x: str, values: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


_REGISTRY = "(VALUES " + ", ".join(f"('{c.name}', {p}, {i}, {_sql_list(c.extensions)}, {_sql_list(c.mime_prefixes)}, {'NULL::BIGINT' if c.input_limit is None else f'{c.input_limit}::BIGINT'}, {str(c.is_fallback).lower()})" for i, (c, p) in enumerate([(PLAIN_TEXT, GENERIC), *FORMATS])) + ") r(name, priority, seq, extensions, prefixes, input_limit, is_fallback)"
_EXT = r"coalesce(nullif(lower(extension), ''), nullif(lower(regexp_extract(coalesce(filename, ''), '(\.[^./]*)$', 1)), ''), '')"
_HINTED = f"""h0 AS (SELECT *, {_EXT} AS e0 FROM stream_info),
h1 AS (SELECT *, coalesce(nullif(mime_type, ''), nullif({_sql_map('e0', EXT_MIME, "''")}, ''), '') AS m FROM h0),
h AS (SELECT *, coalesce(nullif(e0, ''), nullif({_sql_map('lower(m)', MIME_EXT, "''")}, ''), '') AS e FROM h1)"""
_MATCH = "(list_contains(extensions, lower(e)) OR len(list_filter(prefixes, lambda p: starts_with(lower(m), p))) > 0)"
_TAKES = f"({_MATCH} OR (is_fallback AND coalesce(charset, '') <> ''))"


# --- normalisation, cells, tables (G, P) -----------------------------------------------------------------------------


@query("SELECT doc_id, " + _sql_normal("text") + " AS markdown FROM documents")
def normalize_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", normalized("text").alias("markdown"))


@query("SELECT result_id, " + _sql_normal("chr(10) || replace(replace(markdown, chr(10) || chr(10), ' ' || chr(9) || chr(13) || chr(10) || chr(13) || chr(10) || chr(10)), '. ', '.  ' || chr(13))") + " AS markdown FROM results")
def normalize_roughened_results(spark, d):
    """Results with line ends, blanks and blank lines of all kinds put in."""
    rough = F.concat(F.lit("\n"), F.replace(F.replace("markdown", F.lit("\n\n"), F.lit(" \t\r\n\r\n\n")), F.lit(". "), F.lit(".  \r")))
    return t(spark, d, "results").select("result_id", normalized(rough).alias("markdown"))


@query("SELECT doc_id, " + _sql_cell("text") + " AS cell FROM documents")
def escape_cell_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", escaped_cell("text").alias("cell"))


@query("SELECT '| n_nationkey | n_name | n_regionkey |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM nation")
def gfm_table_nation(spark, d):
    return pipe_table(t(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"])


@query("SELECT o_custkey, '| o_orderkey | o_orderpriority | o_totalprice |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderpriority || ' | ' || CAST(o_totalprice AS DECIMAL(18,2)) || ' |', chr(10) ORDER BY o_orderkey) || chr(10) AS markdown FROM orders GROUP BY 1")
def gfm_table_customer_orders(spark, d):
    """A table for each customer; a customer's orders are a few dozen, however many customers there are."""
    rows = t(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return pipe_table(rows, ["o_orderkey", "o_orderpriority", "o_totalprice"], ["o_orderkey"], keys=["o_custkey"])


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, '| order | day |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' |', chr(10) ORDER BY o_orderkey) || chr(10) AS md FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg('## ' || o_orderpriority || chr(10) || chr(10) || md, chr(10) ORDER BY o_orderpriority) AS markdown FROM s GROUP BY 1""")
def workbook_sheets(spark, d):
    """A workbook for each customer with a sheet for each priority, in order, a blank line between them."""
    rows = t(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    sheets = pipe_table(rows, ["o_orderkey", "day"], ["o_orderkey"], ["order", "day"], ["o_custkey", "o_orderpriority"], "table")
    return A.joined_parts(sheets, ["o_custkey"], A.sheet_section("o_orderpriority", "table"), "o_orderpriority", "\n")


@query("SELECT result_id, title, regexp_replace('data:text/plain;base64,' || coalesce(title, ''), '^(data:[^,]*,)[\\s\\S]*$', '\\1...') AS src FROM results")
def truncate_data_uris(spark, d):
    return t(spark, d, "results").select("result_id", "title", A.truncated_data_uri(F.concat(F.lit("data:text/plain;base64,"), F.coalesce("title", F.lit("")))).alias("src"))


# --- grids (C, X) ----------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row_no FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, row_no, string_split(line, ' ') AS cells FROM l), w AS (SELECT doc_id, len(cells) AS n FROM c WHERE row_no = 0)
SELECT doc_id, row_no::INT AS row_no, array_to_string(list_transform(range(n), lambda i: coalesce(cells[i + 1], '')), '|') AS cells FROM c JOIN w USING (doc_id)""")
def csv_fit_header_width(spark, d):
    """Lines as rows of words: each as wide as the document's first."""
    rows = t(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line")).select("doc_id", "row_no", F.split("line", " ").alias("cells"))
    return A.fitted_cells(rows, ["doc_id"]).select("doc_id", "row_no", F.array_join("cells", "|").alias("cells"))


@query("""WITH c AS (SELECT stream_id, u.row, u.col, u.text FROM stream_info, LATERAL (SELECT unnest([{'row': 0, 'col': 0, 'text': coalesce(mime_type, '')}, {'row': 0, 'col': 2, 'text': coalesce(extension, '')}, {'row': 2, 'col': 1, 'text': coalesce(charset, '')}, {'row': 3, 'col': 3, 'text': coalesce(url, '')}]) AS u)),
m AS (SELECT stream_id, max("row") AS rows, max("col") AS cols FROM c WHERE regexp_replace(text, '\\s+', '', 'g') <> '' GROUP BY 1),
g AS (SELECT stream_id, r.v AS "row", k.v AS col FROM m, LATERAL (SELECT unnest(range(m.rows + 1)) AS v) r, LATERAL (SELECT unnest(range(m.cols + 1)) AS v) k),
x AS (SELECT stream_id, "row", "col", max(text) AS text FROM c GROUP BY ALL)
SELECT g.stream_id, g."row"::INT AS "row", string_agg(coalesce(x.text, ''), '|' ORDER BY g.col) AS cells FROM g LEFT JOIN x ON x.stream_id = g.stream_id AND x."row" = g."row" AND x."col" = g.col GROUP BY 1, 2""")
def grid_pad_ragged(spark, d):
    """Hints as cells of a sheet with gaps: blank rows and columns at the end dropped, ragged rows padded."""
    at = [(0, 0, "mime_type"), (0, 2, "extension"), (2, 1, "charset"), (3, 3, "url")]
    cells = t(spark, d, "stream_info").select("stream_id", F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.coalesce(n, F.lit("")).alias("text")) for r, c, n in at])).alias("u")).select("stream_id", "u.*")
    return A.normalized_grid(cells, ["stream_id"]).select("stream_id", "row", F.array_join("cells", "|").alias("cells"))


# --- detection and registry (D, E, T) --------------------------------------------------------------------------------


@query("SELECT name AS converter, priority, (row_number() OVER (ORDER BY priority, seq DESC))::INT AS rank FROM " + _REGISTRY)
def registry_rank(spark, d):
    return R.ranked(R.registry(spark)).select(F.col("name").alias("converter"), "priority", "rank")


@query(f"WITH {_HINTED} SELECT stream_id, received_at, name AS converter, priority, rank FROM h, (SELECT *, (row_number() OVER (ORDER BY priority, seq DESC))::INT AS rank FROM {_REGISTRY}) WHERE {_TAKES}")
def candidate_converters(spark, d):
    streams = t(spark, d, "stream_info").withColumn("key", F.struct("stream_id", "received_at"))
    return R.candidates(streams, R.registry(spark), "key").select("key.*", "converter", "priority", "rank")


@query(f"WITH {_HINTED} SELECT stream_id, collection, received_at FROM h WHERE EXISTS (SELECT 1 FROM {_REGISTRY} WHERE NOT is_fallback AND {_MATCH})")
def can_convert_streams(spark, d):
    return R.can_convert(t(spark, d, "stream_info"), R.registry(spark)).select("stream_id", "collection", "received_at")


@query(f"WITH {_HINTED} SELECT stream_id, received_at FROM h WHERE NOT EXISTS (SELECT 1 FROM {_REGISTRY} WHERE {_TAKES})")
def unsupported_streams(spark, d):
    return R.unsupported(t(spark, d, "stream_info"), R.registry(spark)).select("stream_id", "received_at")


@query(f"WITH {_HINTED} SELECT stream_id, min(input_limit) AS input_limit FROM h LEFT JOIN {_REGISTRY} ON {_TAKES} GROUP BY 1")
def smallest_input_limit(spark, d):
    return R.smallest_limits(t(spark, d, "stream_info"), R.registry(spark), "stream_id")


@query(f"WITH {_HINTED} SELECT h.stream_id, received_at FROM h WHERE n_bytes <= (SELECT min(input_limit) FROM {_REGISTRY} WHERE {_TAKES})")
def streams_within_limit(spark, d):
    """Streams small enough for the strictest of their converters, by the size column alone."""
    streams = t(spark, d, "stream_info")
    return streams.join(R.smallest_limits(streams, R.registry(spark), "stream_id"), "stream_id").where("n_bytes <= input_limit").select("stream_id", "received_at")


@query("SELECT stream_id, received_at, " + _sql_map("lower(extension)", EXT_MIME, "''") + " AS mime_of_ext, " + _sql_map("lower(mime_type)", MIME_EXT, "''") + " AS ext_of_mime FROM stream_info")
def extension_and_mime(spark, d):
    return t(spark, d, "stream_info").select("stream_id", "received_at", H.mime_of_extension("extension").alias("mime_of_ext"), H.extension_of_mime("mime_type").alias("ext_of_mime"))


_TEXT_LIKE = "(lower(m) LIKE 'text/%' OR lower(m) LIKE 'application/xhtml%' OR lower(m) IN ('application/json', 'application/markdown', 'application/xml', 'application/csv') OR lower(m) LIKE '%+json' OR lower(m) LIKE '%+xml')"
_OOXML = "starts_with(m, 'application/vnd.openxmlformats-officedocument.')"


@query(f"WITH {_HINTED} SELECT stream_id, received_at, {_TEXT_LIKE} AS text_like, {_OOXML} AS ooxml, lower(m) IN {tuple(ZIP_MIMES)} AS zip FROM h")
def media_type_tests(spark, d):
    s = R.completed(t(spark, d, "stream_info"))
    return s.select("stream_id", "received_at", H.text_like("__mime").alias("text_like"), H.ooxml("__mime").alias("ooxml"), H.zip_type("__mime").alias("zip"))


_FOUND = "CASE WHEN converter IN ('html', 'csv', 'plaintext') THEN 'text/plain' WHEN converter = 'pdf' THEN 'application/pdf' ELSE 'application/zip' END"


@query(f"""WITH {_HINTED}, f AS (SELECT stream_id, max(converter) AS converter FROM results GROUP BY 1), g AS (SELECT h.*, {_FOUND} AS found FROM h JOIN f USING (stream_id))
SELECT stream_id, received_at, CASE WHEN m = '' OR lower(m) = found OR ({_OOXML} AND found = 'application/zip') OR ({_TEXT_LIKE} AND starts_with(found, 'text/')) THEN 1 ELSE 2 END AS n_guesses FROM g""")
def guess_counts(spark, d):
    """How many interpretations a stream gets when its content is of the kind that its converter reads."""
    found = t(spark, d, "results").groupBy("stream_id").agg(F.max("converter").alias("converter")).select("stream_id", F.expr(_FOUND).alias("found"))
    joined = R.completed(t(spark, d, "stream_info")).join(found, "stream_id")
    return joined.select("stream_id", "received_at", R.guess_count(joined, "found").alias("n_guesses"))


@query("SELECT stream_id, received_at, " + _sql_map("lower(trim(coalesce(charset, '')))", textenc.ALIASES, "lower(trim(coalesce(charset, '')))") + " AS charset FROM stream_info")
def charset_names(spark, d):
    return t(spark, d, "stream_info").select("stream_id", "received_at", H.canonical_charset("charset").alias("charset"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY received_at, n_bytes, coalesce(filename, ''), coalesce(charset, ''), coalesce(mime_type, ''), coalesce(extension, ''), coalesce(url, ''), coalesce(local_path, '')) AS n FROM stream_info)
SELECT a.stream_id, """ + ", ".join(f"coalesce(nullif(a.{n}, ''), nullif(b.{n}, ''), '') AS {n}" for n in ("mime_type", "extension", "charset", "filename")) + " FROM k a LEFT JOIN k b ON b.stream_id = a.stream_id AND b.n = 2 WHERE a.n = 1")
def hints_filled_from_repeat(spark, d):
    """A stream's first row, its empty hints filled from its second."""
    from pyspark.sql import Window

    names = ["mime_type", "extension", "charset", "filename"]
    order = ["received_at", "n_bytes", *[F.coalesce(c, F.lit("")) for c in ("filename", "charset", "mime_type", "extension", "url", "local_path")]]
    k = t(spark, d, "stream_info").select("stream_id", F.struct(*names).alias("h"), F.row_number().over(Window.partitionBy("stream_id").orderBy(*order)).alias("n"))
    both = k.where("n <= 2").groupBy("stream_id").agg(F.max_by("h", F.when(F.col("n") == 1, 1)).alias("a"), F.max_by("h", F.when(F.col("n") == 2, 1)).alias("b"))
    return both.select("stream_id", R.merged_hints("a", "b", names).alias("x")).select("stream_id", "x.*")


@query(r"SELECT stream_id, received_at, lower(regexp_extract(trim(coalesce(url, '')), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('', 'http', 'https', 'file', 'mailto') AS safe FROM stream_info")
def url_scheme_safe(spark, d):
    return t(spark, d, "stream_info").select("stream_id", "received_at", H.safe_link("url").alias("safe"))


# --- limits and errors (E, G) ----------------------------------------------------------------------------------------


@query("SELECT result_id, octet_length(encode(markdown)) AS n_bytes, CASE WHEN octet_length(encode(markdown)) > 4000 THEN 'RESULT_TOO_LARGE' END AS code FROM results")
def result_limit_status(spark, d):
    return t(spark, d, "results").select("result_id", F.octet_length("markdown").cast("long").alias("n_bytes"), A.result_status("markdown", 4000).alias("code"))


@query("SELECT stream_id, 'conversion failed after ' || count(*) || ' attempt(s):' || string_agg(chr(10) || '  ' || converter || ': ' || coalesce(error_code, ''), '' ORDER BY result_id) AS message FROM results WHERE error_code IS NOT NULL GROUP BY 1")
def failure_messages(spark, d):
    failed = t(spark, d, "results").where("error_code is not null").select("stream_id", F.col("result_id").alias("attempt_no"), "converter", F.col("error_code").alias("message"))
    return A.failure_text(failed, ["stream_id"])


# --- warnings (G, Z) -------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY seq, code, location NULLS FIRST, message) AS k FROM warnings)
SELECT result_id, count(*) AS n, string_agg(CASE WHEN k = 256 THEN 'incomplete||additional warnings suppressed' ELSE code || '|' || coalesce(location, '') || '|' || message END, chr(10) ORDER BY k) AS warnings FROM n WHERE k <= 256 GROUP BY 1""")
def warnings_cap_256(spark, d):
    out = A.bounded_warnings(t(spark, d, "warnings"), ["result_id"], "seq")
    line = F.transform("warnings", lambda w: F.concat_ws("|", w["code"], w["location"], w["message"]))
    return out.select("result_id", F.size("warnings").cast("long").alias("n"), F.array_join(line, "\n").alias("warnings"))


@query("SELECT result_id, seq, CASE WHEN coalesce(converter, '') = '' THEN message WHEN coalesce(location, '') = '' THEN converter || ': ' || message ELSE converter || ': ' || location || ': ' || message END AS text FROM warnings")
def warning_texts(spark, d):
    return t(spark, d, "warnings").select("result_id", "seq", A.warning_text().alias("text"))


@query("SELECT result_id, seq, CASE WHEN coalesce(location, '') = '' THEN collection ELSE collection || ': ' || location END AS location FROM warnings")
def relocate_warnings(spark, d):
    return t(spark, d, "warnings").select("result_id", "seq", A.relocated("location", "collection").alias("location"))


# --- archives (Z) ----------------------------------------------------------------------------------------------------

_BASE = r"regexp_replace(name, '^.*/', '')"
_SILENT = rf"(is_dir OR starts_with(name, '__MACOSX/') OR starts_with({_BASE}, '.'))"
_NESTED = rf"lower({_BASE}) LIKE '%.zip'"


@query(f"SELECT stream_id, entry_no, CASE WHEN {_SILENT} THEN 'silent' WHEN {_NESTED} THEN 'nested' WHEN encrypted THEN 'encrypted' WHEN coalesce(uncompressed_size, 0) > 10485760 THEN 'too large' ELSE 'member' END AS kind FROM zip_member")
def archive_member_kinds(spark, d):
    kind = F.when(F.expr(_SILENT.replace("starts_with", "startswith")), "silent").when(F.expr(_NESTED), "nested").when(F.col("encrypted"), "encrypted").when(F.coalesce("uncompressed_size", F.lit(0)) > 10485760, "too large").otherwise("member")
    return t(spark, d, "zip_member").select("stream_id", "entry_no", kind.alias("kind"))


@query(f"SELECT stream_id, string_agg(chr(10) || '## File: ' || name || chr(10) || chr(10) || coalesce(uncompressed_size, 0) || ' bytes' || chr(10), '' ORDER BY entry_no, name) AS markdown FROM zip_member WHERE NOT {_SILENT} GROUP BY 1")
def archive_sections(spark, d):
    members = t(spark, d, "zip_member").where(~F.expr(_SILENT.replace("starts_with", "startswith")))
    text = A.file_section("name", F.concat(F.coalesce("uncompressed_size", F.lit(0)).cast("string"), F.lit(" bytes")))
    return A.joined_parts(members.withColumn("at", F.struct("entry_no", "name")), ["stream_id"], text, "at", "")


@query("""WITH w AS (SELECT DISTINCT result_id, seq, code FROM warnings), n AS (SELECT *, coalesce(sum((code = 'incomplete')::INT) OVER (PARTITION BY result_id ORDER BY seq, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM w)
SELECT result_id, seq, code FROM n WHERE k < 64""")
def member_cap_64(spark, d):
    """Warnings in place of members: of a record there are at most 256, of which those of code 'incomplete' count."""
    rows = t(spark, d, "warnings").select("result_id", "seq", "code").distinct()
    return A.first_members(rows, ["result_id"], ["seq", "code"], F.col("code") == "incomplete", 64).select("result_id", "seq", "code")


@query("""WITH p AS (SELECT DISTINCT result_id, page_no, text FROM pdf_page), n AS (SELECT *, sum(coalesce(octet_length(encode(text)), 0)) OVER (PARTITION BY result_id ORDER BY page_no, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS bytes_so_far FROM p)
SELECT result_id, page_no, bytes_so_far::BIGINT AS bytes_so_far FROM n WHERE bytes_so_far <= 4000""")
def byte_budget_running(spark, d):
    pages = t(spark, d, "pdf_page").select("result_id", "page_no", "text").distinct()
    kept = A.within_budget(pages, ["result_id"], ["page_no", "text"], "text", 4000)
    return A.running_bytes(kept, ["result_id"], ["page_no", "text"], "text").select("result_id", "page_no", F.col("bytes_so_far").cast("long").alias("bytes_so_far"))


# --- pages (F, O) ----------------------------------------------------------------------------------------------------

_PAGES = "(SELECT result_id, page_no, max(coalesce(text, '')) AS text, max(coalesce(ocr_glyphs, 0)) AS ocr_glyphs, max(image_count) AS image_count, max(n_glyphs) AS n_glyphs FROM pdf_page GROUP BY 1, 2)"


@query(f"SELECT result_id, string_agg(CASE WHEN ocr_glyphs > 0 THEN '<!-- inkloom: page ' || page_no || ' includes OCR text -->' || chr(10) || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY page_no) AS markdown FROM {_PAGES} WHERE text <> '' GROUP BY 1")
def page_documents(spark, d):
    return A.page_documents(t(spark, d, "pdf_page"), ["result_id"])


def _pages(spark, d):
    return t(spark, d, "pdf_page").groupBy("result_id", "page_no").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("image_count").alias("image_count"), F.max("n_glyphs").alias("n_glyphs"), F.max(F.coalesce("ocr_glyphs", F.lit(0))).alias("ocr_glyphs"))


@query(f"SELECT result_id, page_no, CASE WHEN coalesce(image_count, 0) > 0 THEN '{SCANNED}' ELSE '{NO_IMAGES}' END AS message FROM {_PAGES} WHERE text = ''")
def page_warnings(spark, d):
    return _pages(spark, d).select("result_id", "page_no", A.page_warning(True).alias("message")).where("message is not null")


@query(f"SELECT result_id, page_no FROM {_PAGES} WHERE text = '' OR (coalesce(n_glyphs, 0) < 50 AND coalesce(image_count, 0) > 0)")
def page_select_thin(spark, d):
    return _pages(spark, d).where(A.thin_page(Options(ocr_policy="thin").glyph_floor)).select("result_id", "page_no")


@query(f"SELECT result_id, page_no, k AS ocr_no, k > 3 AS refused, k = 4 AS first_refusal FROM (SELECT *, (row_number() OVER (PARTITION BY result_id ORDER BY page_no))::INT AS k FROM {_PAGES} WHERE image_count > 0)")
def ocr_page_budget(spark, d):
    return A.ocr_budget(_pages(spark, d), ["result_id"], F.col("image_count") > 0, 3).select("result_id", "page_no", "ocr_no", "refused", "first_refusal")


# --- slides, charts, lookups (S, W) ----------------------------------------------------------------------------------


@query("""WITH b AS (SELECT doc_id, generate_subscripts(boxes, 1) - 1 AS seq, unnest(boxes) AS b FROM documents WHERE boxes IS NOT NULL)
SELECT doc_id, seq::INT AS seq, (row_number() OVER (PARTITION BY doc_id ORDER BY b.y0 NULLS FIRST, b.x0 NULLS FIRST, seq))::INT AS position FROM b""")
def reading_order(spark, d):
    """Boxes by position, as shapes on a slide are."""
    items = t(spark, d, "documents").select("doc_id", F.posexplode("boxes").alias("seq", "b")).select("doc_id", "seq", F.col("b.y0").alias("y"), F.col("b.x0").alias("x"))
    return A.reading_order(items, ["doc_id"]).select("doc_id", "seq", "position")


@query("""WITH v AS (SELECT c_nationkey AS idx, 'customers' AS s, count(*)::VARCHAR AS value FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey + 3, 'suppliers', count(*)::VARCHAR FROM supplier GROUP BY 1)
SELECT coalesce(c.idx, v.idx) AS idx, coalesce(any_value(c.n_name), '') AS category, coalesce(max(value) FILTER (s = 'customers'), '') AS customers, coalesce(max(value) FILTER (s = 'suppliers'), '') AS suppliers
FROM (SELECT n_nationkey AS idx, n_name FROM nation) c FULL JOIN v ON v.idx = c.idx GROUP BY 1""")
def chart_full_outer(spark, d):
    """Two series over nations, one of them shifted, so that both sides have points of their own."""
    cats = t(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("category"))
    a = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("idx")).agg(F.count("*").cast("string").alias("value")).withColumn("series_name", F.lit("customers"))
    b = t(spark, d, "supplier").groupBy((F.col("s_nationkey") + 3).alias("idx")).agg(F.count("*").cast("string").alias("value")).withColumn("series_name", F.lit("suppliers"))
    return A.chart_table(cats, a.unionByName(b), ["customers", "suppliers"])


_NAMES = ["Title", "heading 1", "Section", "Heading  7", "Body", "Outlined"]


@query(rf"""WITH RECURSIVE s AS (SELECT l_orderkey, 'S' || l_linenumber AS style_id, list_extract({_sql_list(_NAMES)}, (l_partkey % 6 + 1)::INT) AS name, CASE l_suppkey % 5 WHEN 0 THEN 'Heading3' WHEN 1 THEN '' ELSE 'S' || (l_linenumber + (l_suppkey % 3) - 1) END AS based_on, CASE WHEN l_partkey % 6 = 5 THEN l_suppkey % 11 ELSE -1 END AS lvl FROM lineitem),
u AS (SELECT l_orderkey, style_id, min(name) AS name, min(based_on) AS based_on, min(lvl) AS lvl FROM s GROUP BY 1, 2),
o AS (SELECT l_orderkey, style_id, based_on, CASE WHEN lower(name) = 'title' THEN 1 WHEN regexp_matches(lower(name), '^heading\s*[1-9]$') THEN right(name, 1)::INT WHEN lvl BETWEEN 0 AND 8 THEN lvl + 1 END AS own FROM u),
c AS (SELECT l_orderkey, style_id, own AS level, based_on AS nxt, 1 AS looked FROM o UNION ALL SELECT c.l_orderkey, c.style_id, CASE WHEN o.style_id IS NULL AND c.nxt = 'Heading3' THEN 3 ELSE o.own END, o.based_on, looked + 1 FROM c LEFT JOIN o ON o.style_id = c.nxt AND o.l_orderkey = c.l_orderkey WHERE c.level IS NULL AND coalesce(c.nxt, '') <> '' AND looked < 10)
SELECT l_orderkey, style_id, coalesce(max(level), 0)::INT AS level FROM c GROUP BY 1, 2""")
def style_chain(spark, d):
    """The lines of an order as its styles: chains, cycles, a base that is not there, outline levels."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("l_partkey") % 6 + 1).cast("int"))
    base = F.when(F.col("l_suppkey") % 5 == 0, "Heading3").when(F.col("l_suppkey") % 5 == 1, "").otherwise(F.concat(F.lit("S"), (F.col("l_linenumber") + F.col("l_suppkey") % 3 - 1).cast("int").cast("string")))
    level = F.when(F.col("l_partkey") % 6 == 5, F.col("l_suppkey") % 11).otherwise(-1)
    s = t(spark, d, "lineitem").groupBy("l_orderkey", F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("style_id")).agg(F.min(name).alias("name"), F.min(base).alias("based_on"), F.min(level).alias("outline_lvl"))
    return A.heading_levels(s, keys=("l_orderkey",))


@query("""WITH l AS (SELECT DISTINCT l_orderkey, (l_partkey % 4)::VARCHAR AS num_id, (l_suppkey % 3)::VARCHAR AS ilvl FROM lineitem),
n AS (SELECT l_orderkey, l_linenumber::VARCHAR AS num_id, min((l_linenumber % 2)::VARCHAR) AS abstract_id FROM lineitem GROUP BY 1, 2),
f AS (SELECT l_orderkey, (l_linenumber % 2)::VARCHAR AS abstract_id, '0' AS ilvl, min(CASE l_returnflag WHEN 'A' THEN 'bullet' WHEN 'N' THEN 'decimal' ELSE '' END) AS num_fmt FROM lineitem WHERE l_linenumber < 3 GROUP BY 1, 2)
SELECT l.l_orderkey, l.num_id, l.ilvl, CASE WHEN l.num_id = '0' OR n.num_id IS NULL THEN NULL WHEN coalesce(num_fmt, '') IN ('', 'bullet') THEN 'bullet' ELSE 'ordered' END AS kind
FROM l LEFT JOIN n ON n.l_orderkey = l.l_orderkey AND n.num_id = l.num_id LEFT JOIN f ON f.l_orderkey = l.l_orderkey AND f.abstract_id = n.abstract_id AND f.ilvl = l.ilvl""")
def list_kind(spark, d):
    """The lines of an order as its list paragraphs, numbers and levels, some of which are not defined."""
    s = t(spark, d, "lineitem").withColumn("abstract_id", (F.col("l_linenumber") % 2).cast("string"))
    paras = s.select("l_orderkey", (F.col("l_partkey") % 4).cast("string").alias("num_id"), (F.col("l_suppkey") % 3).cast("string").alias("ilvl")).distinct()
    numbers = s.groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("num_id")).agg(F.min("abstract_id").alias("abstract_id"))
    fmt = F.min(F.when(F.col("l_returnflag") == "A", "bullet").when(F.col("l_returnflag") == "N", "decimal").otherwise(""))
    levels = s.where("l_linenumber < 3").groupBy("l_orderkey", "abstract_id", F.lit("0").alias("ilvl")).agg(fmt.alias("num_fmt"))
    return A.list_kinds(paras, numbers, levels, ("l_orderkey",)).select("l_orderkey", "num_id", "ilvl", "kind")


@query("SELECT l.result_id, l.stream_id AS rel_id, r.href FROM results l LEFT JOIN (SELECT stream_id, min(url) AS href FROM stream_info WHERE url <> '' GROUP BY 1) r ON r.stream_id = l.stream_id")
def rel_lookup(spark, d):
    """Links to external targets: a result's stream is its relationship, the stream's url the target."""
    rels = t(spark, d, "stream_info").where("url <> ''").groupBy(F.col("stream_id").alias("id")).agg(F.min("url").alias("target")).withColumn("external", F.lit(True))
    return A.external_links(t(spark, d, "results").select("result_id", F.col("stream_id").alias("rel_id")), rels).select("result_id", "rel_id", "href")


# --- whole conversions -----------------------------------------------------------------------------------------------


@query("SELECT doc_id, " + _sql_normal("text") + " AS markdown, '' AS title, 'plaintext' AS converter FROM documents WHERE text IS NOT NULL")
def convert_plain_text(spark, d):
    """The engine over the documents as .txt streams."""
    src = t(spark, d, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.lit(".txt").alias("extension"))
    return convert(src).select("doc_id", "markdown", "title", "converter")


@query("SELECT o_custkey, '| key | status |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey) || chr(10) AS markdown, 'csv' AS converter FROM orders GROUP BY 1")
def convert_csv(spark, d):
    """The engine over one CSV stream for each customer."""
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(',"'), "o_orderstatus", F.lit('"'))
    text = t(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.lit("key,status\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\n")).alias("text"))
    return convert(text.select("o_custkey", F.encode("text", "UTF-8").alias("content"), F.lit(".csv").alias("extension"))).select("o_custkey", "markdown", "converter")


@query("""SELECT n_nationkey, '# ' || n_name || chr(10) || chr(10) || '**' || r_name || '** is the region' || chr(10) || chr(10) || '- key ' || n_nationkey || chr(10) || '- region ' || n_regionkey || chr(10) AS markdown, n_name AS title, 'html' AS converter FROM nation JOIN region ON r_regionkey = n_regionkey""")
def convert_html(spark, d):
    """The engine over one small page for each nation."""
    page = F.concat(F.lit("<!DOCTYPE html><html><head><title> "), "n_name", F.lit(" </title><script>x()</script></head><body><h1>"), "n_name", F.lit("</h1><p><b>"), "r_name", F.lit("</b> is\n the region<ul><li>key "), F.col("n_nationkey").cast("string"), F.lit("<li>region "), F.col("n_regionkey").cast("string"), F.lit("</ul><div hidden>no</div></body></html>"))
    src = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.encode(page, "UTF-8").alias("content"), F.lit("text/html").alias("mime_type"))
    return convert(src).select("n_nationkey", "markdown", "title", "converter")


@query()
def convert_zip_members(spark, d):
    """The engine over the raw members of archives, in many charsets; members without bytes are left out."""
    src = t(spark, d, "zip_member").where("content is not null").select("stream_id", "entry_no", "name", "content", H.extension_of("name").alias("extension"), F.element_at(F.split("name", "/"), -1).alias("filename"))
    return convert(src)


@query()
def json_lines_of_members(spark, d):
    return to_json_lines(convert_zip_members(spark, d))
