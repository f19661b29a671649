"""Markdown normalisation and limits as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column | str) -> Column:
    """LF line ends, no trailing blanks, at most one blank line in a row, exactly one final LF; '' if blank.

    Indentation of the first kept line survives. Null gives null.
    """
    c = F.col(text) if isinstance(text, str) else text
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+(?=\n|$(?![\s\S]))", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"^\n+|\n+$(?![\s\S])", "")
    return F.when(c == "", F.lit("")).when(c.isNotNull(), F.concat(c, F.lit("\n")))
