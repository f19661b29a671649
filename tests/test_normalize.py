from itertools import product

from pyspark.sql import functions as F

from inkloom.functions.normalize import normalized
from inkloom.functions.tables import escaped_cell, pipe_table
from inkloom.sources.markdown import escape_cell, normalize, table


def plain(s: str) -> str:
    lines = [x.rstrip(" \t") for x in s.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    s = "\n".join(lines)
    while "\n\n\n" in s:
        s = s.replace("\n\n\n", "\n\n")
    s = s.strip("\n")
    return s + "\n" if s else ""


def test_every_short_string(spark):
    texts = ["".join(p) for n in range(7) for p in product("a \t\n\r", repeat=n)]
    assert len(texts) == 19531
    df = spark.createDataFrame([(x,) for x in texts], "s string").select("s", normalized("s").alias("m"))
    for s, m in df.collect():
        assert m == plain(s) == normalize(s), repr(s)


def test_null_and_indentation(spark):
    df = spark.createDataFrame([(None,), ("  a\n",), ("",), (" \n\t",)], "s string").select(normalized("s").alias("m"))
    assert [r.m for r in df.collect()] == [None, "  a\n", "", ""]


def test_cells_and_tables(spark):
    cells = ["a|b", " x\r\ny ", None, "", "\u00a0z\u3000"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(escaped_cell("c")).collect()]
    assert got == ["a\\|b", "x y", "", "", "z"] == [escape_cell(c or "") for c in cells]
    assert table([]) == "" == table([[]])
    assert table([["a"], ["b", "c"]]) == "| a |  |\n| --- | --- |\n| b | c |\n"
    df = spark.createDataFrame([(2, "y"), (1, None), (2, "x")], "k int, v string")
    assert pipe_table(df, ["k", "v"], ["k"]).first()[0] == "| k | v |\n| --- | --- |\n| 1 |  |\n| 2 | x |\n| 2 | y |\n"
    assert pipe_table(df.where("false"), ["k", "v"], ["k"]).first()[0] == ""
    assert pipe_table(df.withColumn("entry", F.lit(1)).withColumn("line", F.lit(2)), ["k"], ["k"]).count() == 1
