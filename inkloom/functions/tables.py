"""Pipe tables and cells as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\s\u0085   -     　]+"


def escaped_cell(text: Column | str) -> Column:
    """Line ends as blanks, pipes escaped, white space trimmed. Null gives ''."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n|\r|\n", " "), r"\|", r"\\|")
    return F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", "")


def table_row(cells: list[Column | str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[escaped_cell(c) for c in cells]), F.lit(" |"))


def rule_row(width: int) -> str:
    return "| " + " | ".join(["---"] * width) + " |"


def pipe_table(df: DataFrame, columns: list[str], order_by: list[str], header: list[str] | None = None, keys: list[str] | None = None, name: str = "markdown") -> DataFrame:
    """One table for each group of keys (or of the whole df), rows in the given order, header first.

    A group is one document's table, which must fit a task as the document itself does; without rows there is
    no table, and without keys and rows an empty text. Nulls are empty cells; ties of order_by are
    resolved by the rows' text.
    """
    head = "| " + " | ".join(header or columns) + " |\n" + rule_row(len(columns)) + "\n"
    rows = df.select(*(keys or []), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)], table_row([F.col(c).cast("string") for c in columns]).alias("line")).alias("entry"))
    lines = F.transform(F.sort_array(F.collect_list("entry")), lambda e: e["line"])
    text = F.when(F.size(lines) > 0, F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return rows.groupBy(*(keys or [])).agg(text.alias(name))
