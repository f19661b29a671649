"""DataFrame operators on dirty input: nulls, empties, ties, repeats, empty tables, clashing column names."""

from pyspark.sql import functions as F

from inkloom.model import Hints, Options, Result
from inkloom.operators import assembly as A
from inkloom.operators import registry as R
from inkloom.plans.convert import convert, read_files, to_json_lines
from inkloom.sources.engine import Converter

STREAM = "id int, mime_type string, extension string, charset string, filename string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_registry(spark):
    reg = R.registry(spark)
    assert [r[0] for r in rows(R.ranked(reg).orderBy("rank"))] == ["docx", "doc", "pptx", "pdf", "xlsx", "csv", "zip", "html", "plaintext"]
    s = spark.createDataFrame([(1, None, ".PDF", None, None), (2, "", "", "", "a/b.CSV"), (3, None, None, "utf-8", None), (4, None, None, None, None), (5, "text/html; charset=x", None, None, None), (5, "text/html; charset=x", None, None, None)], STREAM)
    assert sorted(r[0] for r in rows(R.can_convert(s, reg))) == [1, 2, 5, 5]
    assert [r[0] for r in rows(R.unsupported(s, reg))] == [4]
    assert sorted((r[0], r[1]) for r in rows(R.candidates(s, reg, "id")) if r[0] in (2, 3)) == [(2, "csv"), (2, "plaintext"), (3, "plaintext")]
    mine = R.registry(spark, [(Converter("x", lambda d, h, o: None, (".pdf",), input_limit=5), 0)])
    assert dict(rows(R.smallest_limits(s, mine, "id")))[1] == 5
    assert rows(R.can_convert(s.where("false"), reg)) == []


def test_grid(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 2, 1, "b"), (1, 2, 1, "a"), (1, 5, 5, " "), (2, 0, 0, None)], "d int, row int, col int, text string")
    got = [(r["d"], r["row"], r["cells"]) for r in A.normalized_grid(cells, ["d"]).orderBy("row").collect()]
    assert got == [(1, 0, ["a", ""]), (1, 1, ["", ""]), (1, 2, ["", "b"])]
    fit = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c"]), (1, 2, ["d", "e", "f"]), (2, 0, [])], "d int, row_no int, cells array<string>")
    assert [r["cells"] for r in A.fitted_cells(fit, ["d"]).orderBy("d", "row_no").collect()] == [["a", "b"], ["c", ""], ["d", "e"], []]


def test_budgets(spark):
    p = spark.createDataFrame([(1, 1, "ab"), (1, 2, "é"), (1, 3, None), (1, 4, "x"), (1, 5, "y")], "d int, n int, t string")
    assert [r["n"] for r in A.within_budget(p, ["d"], ["n"], "t", 5).orderBy("n").collect()] == [1, 2, 3, 4]
    m = spark.createDataFrame([(1, i, i != 2) for i in range(6)], "d int, n int, ok boolean")
    assert [r["n"] for r in A.first_members(m, ["d"], ["n"], F.col("ok"), 3).orderBy("n").collect()] == [0, 1, 2, 3]


def test_warnings(spark):
    w = spark.createDataFrame([(1, i, "pdf", "skipped", f"page {i}", "m") for i in range(512)] + [(2, 0, "zip", "skipped", None, "m")], "d int, seq int, converter string, code string, location string, message string")
    got = {r["d"]: r["warnings"] for r in A.bounded_warnings(w, ["d"], "seq").collect()}
    assert len(got[1]) == 256 and got[1][-1]["location"] == "" and got[1][-1]["code"] == "incomplete" and got[1][0]["location"] == "page 0" and len(got[2]) == 1
    assert rows(spark.createDataFrame([("c", None, "m"), ("", "l", "m"), ("c", "l", None)], "converter string, location string, message string").select(A.warning_text())) == [("c: m",), ("m",), ("c: l: ",)]


def test_pages(spark):
    p = spark.createDataFrame([(1, 2, "b", 0, 9, 3), (1, 1, "a", 0, 0, 3), (1, 1, "a", 0, 0, 3), (1, 3, None, 1, 0, 0), (2, 1, "", None, None, None)], "d int, page_no int, text string, image_count int, ocr_glyphs int, n_glyphs int")
    assert rows(A.page_documents(p, ["d"])) == [(1, "a\n\n<!-- inkloom: page 2 includes OCR text -->\n\nb")]
    why = {(r[0], r[1]): r[2] for r in rows(p.distinct().select("d", "page_no", A.page_warning(False)))}
    assert "scan" in why[1, 3] and why[2, 1] is None and why[1, 1] is None
    assert sorted(r["page_no"] for r in p.where(A.thin_page(50)).collect()) == [1, 3]


def test_lookups(spark):
    s = spark.createDataFrame([("A", None, "B", -1), ("B", "Heading 3", "A", -1), ("C", None, "C", -1), ("D", "x", None, None)], "style_id string, name string, based_on string, outline_lvl int")
    assert dict(rows(A.heading_levels(s))) == {"A": 3, "B": 3, "C": 0, "D": 0}
    items = spark.createDataFrame([(1, 0, 5, 1), (1, 1, None, None), (1, 2, 5, 0), (1, 3, 5, 1)], "d int, seq int, y int, x int")
    assert [r["seq"] for r in A.reading_order(items, ["d"]).orderBy("position").collect()] == [1, 2, 0, 3]
    chart = A.chart_table(spark.createDataFrame([(0, "q"), (2, "r")], "idx int, category string"), spark.createDataFrame([(1, "s", "5")], "idx int, series_name string, value string"), ["s"])
    assert rows(chart.orderBy("idx")) == [(0, "q", ""), (1, "", "5"), (2, "r", "")]
    links = A.external_links(spark.createDataFrame([("1",), ("2",), (None,)], "rel_id string"), spark.createDataFrame([("1", "u", True), ("1", "u", True), ("2", "v", False)], "id string, target string, external boolean"))
    assert sorted(rows(links), key=str) == [("1", "u"), ("2", None), (None, None)]


def test_convert_rows(spark):
    src = spark.createDataFrame([(1, b"a  \n", ".txt", "old"), (1, b"a  \n", ".txt", "old"), (2, None, None, None), (3, b"\x00\x01\x02", None, "t"), (4, b"x,y\n1\n", ".CSV", "")], "id int, content binary, extension string, title string")
    got = sorted(convert(src).select("id", "markdown", "title", F.size("warnings"), "error.code", "converter").collect(), key=lambda r: r[0])
    assert [tuple(r) for r in got] == [(1, "a\n", "", 0, None, "plaintext")] * 2 + [(2, "", "", 0, None, "plaintext"), (3, None, "", 0, "UNSUPPORTED_FORMAT", None), (4, "| x | y |\n| --- | --- |\n| 1 |  |\n", "", 0, None, "csv")]
    assert convert(src.where("false")).count() == 0
    limited = {r.id: r.error.code for r in convert(src, Options(max_result=4)).where("error is not null").collect()}
    assert limited[4] == "RESULT_TOO_LARGE" and 1 not in limited
    assert {r.error.code for r in convert(src.where("id = 1"), Options(max_result=3)).collect()} == {"RESULT_TOO_LARGE"}  # tested before normalisation too
    lines = [r.value for r in to_json_lines(convert(src)).collect()]
    assert sum('"error"' in x for x in lines) == 1 and all('"warnings":[]' in x for x in lines if '"error"' not in x)


def test_own_converter(spark):
    def upper(data, hints, options):
        return Result(data.decode().upper())

    shout = Converter("shout", upper, (".txt",))
    src = spark.createDataFrame([(b"hi", ".txt")], "content binary, extension string")
    assert convert(src, extra=[(shout, 0)]).select("markdown", "converter").first()[:] == ("HI\n", "shout")


def test_files_and_stream(spark, tmp_path):
    from inkloom.streaming.ingest import convert_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one\r\n")
    (tmp_path / "in" / "b.html").write_bytes(b"<h1>T</h1>")
    assert {r.filename: r.markdown for r in convert(read_files(spark, str(tmp_path / "in")).withColumnRenamed("filename", "filename").withColumn("name", F.col("filename"))).withColumnRenamed("name", "filename").collect()} == {"a.txt": "one\n", "b.html": "# T\n"}
    plan = read_files(spark, str(tmp_path / "in"), 100)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,100)" in plan
    for _ in range(2):  # the second run finds nothing new
        convert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert sorted(r.markdown for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["# T\n", "one\n"]


def test_hint_fill():
    assert Hints(extension=".a").filled_from(Hints(extension=".b", charset="c")) == Hints(extension=".a", charset="c")
