"""The training-data operators over DataFrames: small fixtures and dirty rows."""

import os

import pytest
from pyspark.sql import functions as F

from inkloom.llm import boilerplate, confusions, leaks, lookalike, mojibake, quality, queries, scans, split, tokens, toxicity

DATA = "/root/testdata/sf0.001"
RESULTS = "result_id long, stream_id long, collection string, converter string, markdown string, title string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def results(spark, *given):
    return spark.createDataFrame([(i, i, "c", *g) for i, g in enumerate(given, 1)], RESULTS)


def test_p1(spark):
    df = results(spark, ("html", "shоuld be", "ok"), ("pdf", None, "ｒates"), ("csv", "", None), ("html", "Â£5 shоuld", None), ("docx", "plain", "plain"))
    scores = lookalike.bigram_scores(df, "markdown", "title")
    assert rows(lookalike.lookalike_fields(df, scores)) == [(1, "markdown"), (2, "title")]
    got = {r[0]: (r[1], r[2]) for r in lookalike.canonical_fields(df, "result_id", ["markdown", "title"], scores).collect()}
    assert got[1] == ("should be", "ok") and got[2] == (None, "rates") and got[3] == ("", None)
    assert rows(lookalike.lookalike_fields(df.where("false"), scores)) == []


def test_p2(spark):
    df = results(spark, ("html", "dÃ©cada", None), ("pdf", "dÃ©cada", None), ("csv", None, None), ("plaintext", "", None), ("html", "année", None))
    assert rows(mojibake.garbled_records(df)) == [(1,)]
    streams = spark.createDataFrame([(1, "utf-8"), (1, None), (2, "x")], "stream_id long, charset string")
    out = mojibake.restored_records(df, streams).collect()
    assert [(r["result_id"], r["markdown"], r["charset"]) for r in out] == [(1, "década", "utf-8")]


def test_p2_reads_all_text_streams(spark):
    """Text of ASCII alone may be garbled too: 16-bit and seven-bit charsets."""
    df = results(spark, ("plaintext", "The market.".encode("utf-16-le").decode("ascii") + "\n", None), ("csv", "新しい駅".encode("iso2022_jp").decode("ascii") + "\n", None), ("html", "d+AOk-cada\n", None), ("plaintext", "The market.\n", None), ("html", "", None), ("csv", None, None))
    assert rows(mojibake.garbled_records(df)) == [(1,), (2,), (3,)]
    streams = spark.createDataFrame([(1, "utf-8"), (2, None)], "stream_id long, charset string")
    assert rows(mojibake.restored_records(df, streams).select("result_id", "markdown")) == [(1, "The market.\n"), (2, "新しい駅\n"), (3, "década\n")]


def test_p3(spark):
    def page(n, extra):
        return f"[My Site](/)\n\n# Piece {n} of its kind\n\n" + f"This is paragraph {n} of the article and it is long enough to be read as prose, is it not? " * 4 + f"\n\n{extra}\n\n" + f"Another paragraph {n} follows here, and it too is long enough to count as prose for the test. " * 4 + "\n"

    df = results(spark, *[("html", page(n, "Sign up for our letter today."), f"Piece {n} of its kind | My Site") for n in range(1, 8)], ("html", None, "t"), ("html", "", None), ("pdf", page(9, "x"), None))
    streams = spark.createDataFrame([(i, f"https://my-site.example/{i}") for i in range(1, 9)] + [(1, None), (1, "")], "stream_id long, url string")
    found = boilerplate.furniture_lines(df, streams)
    got = {}
    for i, n in rows(found):
        got.setdefault(i, set()).add(n)
    assert set(got) == set(range(1, 8)) and all(v == {0, 1, 7} for v in got.values()), got
    bodies = {r["result_id"]: r for r in boilerplate.main_bodies(df, found).collect()}
    assert bodies[2]["headline"] == "Piece 2 of its kind" and "Sign up" not in bodies[2]["body"] and bodies[9]["body"] == ""
    assert rows(boilerplate.furniture_lines(df.where("false"), streams)) == []


def test_p4(spark):
    sound = "The delegates departed from the harbour before noon and the market was closed. " * 40
    text = "The delegates depar-\nted from the horbour before the ma=\nrket was well-\nknown to the c1erks of it.\n" + "The market was closed before noon.\n" * 9 + "The delegates departed."
    df = results(spark, ("html", sound + "well-known clerks", None), ("pdf", text + "\n\n— 3 —\n", None), ("pdf", text, None), ("pdf", None, None))
    warnings = spark.createDataFrame([(2, "pdf", "Page 001", "text comes from a scan"), (2, "pdf", "page 1", "text comes from a scan"), (3, "pdf", None, "text comes from a scan"), (3, "pdf", "page 1", "page produced no text")], "result_id long, converter string, location string, message string")
    pages = spark.createDataFrame([(2, 1, text + "\n\n— 3 —"), (2, 1, text + "\n\n— 3 —"), (2, 2, None)], "result_id long, page_no int, text string")
    parts = scans.scan_lines(df, warnings, pages)
    assert set(rows(parts["found"])) == set([(2, 1, "hyphen"), (2, 2, "hyphen"), (2, 2, "misread"), (2, 4, "misread"), (2, 16, "page_no")])
    assert scans.repaired(parts).first()["text"].startswith("The delegates departed from the harbour before the market was well-")
    assert rows(scans.scan_lines(df.where("false"), warnings, pages)["found"]) == []


def test_p4_anagram_hash_as_expression(spark):
    words = ["listen", "silent", "größe", "наши", "日本", "a", ""]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert {r[0]: r[1] for r in df.select("word", scans.anagram_column("word")).collect()} == {w: confusions.anagram_hash(w) for w in words}


def test_p4_words_with_several_misread_letters(spark):
    """One confusion twice in a word, digits at several places; what sound text has too is none; ranges of any length."""
    sound = "The flnished cotton was finished in room B12 of the mill. ".replace("flnished", "finished") * 40
    text = "The flnlshed c0tt0n came to room B12\nof the mill and it was finished there.\n" + "The mill was closed before noon.\n" * 9 + "It stayed there 0f course."
    df = results(spark, ("html", sound, None), ("pdf", text, None))
    warnings = spark.createDataFrame([(2, "pdf", "pages 1 - 900000", "text comes from a scan")], "result_id long, converter string, location string, message string")
    pages = spark.createDataFrame([(2, 1, text)], "result_id long, page_no int, text string")
    parts = scans.scan_lines(df, warnings, pages)
    assert rows(parts["found"]) == [(2, 1, "misread"), (2, 12, "misread")]
    assert {(r["word"], r["target"]) for r in parts["fixes"].collect()} == {("flnlshed", "finished"), ("c0tt0n", "cotton")}
    assert scans.repaired(parts).first()["text"].startswith("The finished cotton came to room B12 of the mill")
    only = df.withColumn("markdown", F.replace("markdown", F.lit("flnlshed c0tt0n"), F.lit("finished cotton")))
    assert rows(scans.scan_lines(only, warnings, pages)["found"]) == [(2, 12, "misread")]


def test_p5(spark):
    df = results(spark, ("csv", "| a | b |\n| --- | --- |\n" + "| 1 | 2 |\n" * 5, None), ("html", None, None), ("docx", "", None))
    words = spark.createDataFrame([("en", "the"), (None, None)], "lang string, word string")
    assert rows(quality.not_prose(df, quality.common_set(words))) == [(1, "table")]
    stats = {r["result_id"]: r for r in quality.text_statistics(df, {"the"}).collect()}
    assert stats[2]["n_words"] is None and stats[3]["n_words"] == 0 and stats[3]["text_class"] is None


def test_p6(spark):
    df = results(spark, ("html", "é" * 4000, None), ("html", "é" * 4000 + "x", None), ("html", None, None), ("html", "", None))
    assert rows(split.oversized(df)) == [(2,)]
    assert [r["n_bytes"] <= 8000 for r in split.split_pieces(df).collect()] == [True, True]


def test_p7(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    assert rows(tokens.token_ids(df)) == [(1, [31373, 995]), (2, []), (3, []), (3, [])]
    assert tokens.token_ids(df.where("false")).count() == 0


def test_p8(spark):
    item = "The ledger of the harbour lists nine crates under the old tannery yet only four were ever sold to the keeper and what remains must be counted twice by the clerk of the town"
    docs = spark.createDataFrame([(1, "Some words come first. " + item.replace("harbour", "horbour").replace(" under", "\nun-\nder").upper() + " Other words."), (2, "Nothing of it here."), (3, None), (4, ""), (5, " ".join(item.split()[:9]) + " and then something else entirely follows on")], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, item)], "item_id long, text string")
    assert rows(leaks.leaked_items(docs, items)) == [(10, 1), (13, 1)]
    assert rows(leaks.leaked_items(docs, items.where("false"))) == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_p8_recall_against_brute_force(spark):
    """At least 0.9 of what verification of every item against every whole document accepts."""
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/eval_items.parquet")
    known = [(r[0], r[1]) for r in items.where("text is not null").select("item_id", "text").collect()]
    texts = {i: t for b in leaks._columns(docs).toArrow().to_batches() for i, t in zip(b.column(0).to_pylist(), leaks.page_texts(b), strict=True)}
    want = leaks.brute_force(texts, known)
    got = set(rows(leaks.leaked_items(docs, items)))
    assert len(got & want) >= 0.9 * len(want)


def test_p8_badly_read(spark):
    """A run whose words nearly all are an edit off, the rare ones too, is found as verification accepts it."""
    item = "Yesterday gardeners planted kumquat hedges behind limestone chapels whereupon magpies attacked wandering pilgrims besides quarrelling fishmongers throughout Pembroke village market squares although constables promptly restored order without bloodshed anywhere"
    words = item.split()
    misread = " ".join(w if i % 3 == 0 else w[:3] + "x" + w[4:] for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, "Some words come first. " + misread + " Other words."), (2, "The gardeners planted hedges; the constables restored order.")], "doc_id long, text string")
    items = spark.createDataFrame([(10, item)], "item_id long, text string")
    assert rows(leaks.leaked_items(docs, items)) == [(10, 1)]


def test_p9(spark):
    good, bad = "The market opens on Monday near the bridge. ", "You are a worthless swine and a brute, sir. "
    docs = spark.createDataFrame([(i, (good * 3 + (bad if i % 5 == 0 else "") + f"Number {i} passed by. "), "s") for i in range(200)] + [(900, None, None), (901, "", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 200, 2)] + [(4, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    pages = toxicity.window_table(docs)
    assert toxicity.corpus_counts(pages, ["swine", toxicity.windows("worthless swine")[0][0], "no such"]).get("no such") is None
    model = toxicity.fit(pages, labels)
    scores = toxicity.toxicity_scores(pages, model)
    found = {r["doc_id"] for r in scores.where("toxic").collect()}
    assert found == {i for i in range(0, 200, 5)}
    rates = {r["source"]: r for r in toxicity.source_rates(scores).collect()}
    assert rates["s"]["n_toxic"] == 40 and rates[None]["rate"] == 0.0
    none = toxicity.toxicity_scores(pages, toxicity.fit(pages, labels.where("toxic = 0")))
    assert none.where("toxic").count() == 0 and toxicity.window_table(docs.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0
