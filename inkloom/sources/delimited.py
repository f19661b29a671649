"""CSV and its kin."""

from __future__ import annotations

import csv
import io

from inkloom.model import Hints, Options, Result, ResultTooLarge
from inkloom.sources import textenc
from inkloom.sources.markdown import table

DELIMITERS = ",;\t|"
SAMPLE_ROWS = 10

csv.field_size_limit(2**31 - 1)


def rows(text: str, delimiter: str):
    """Records with quotes taken leniently; blank lines are none."""
    return (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=False) if r)


def sniff_delimiter(text: str) -> str:
    """The delimiter by which the first records have the most, and all the same number of, columns; the comma wins ties."""
    best, most = ",", 1
    for d in DELIMITERS:
        widths = []
        try:
            for r in rows(text, d):
                widths.append(len(r))
                if len(widths) == SAMPLE_ROWS:
                    break
        except csv.Error:
            continue
        if widths and len(set(widths)) == 1 and widths[0] > most:
            best, most = d, widths[0]
    return best


def fitted(grid: list[list[str]]) -> list[list[str]]:
    """All rows as wide as the first: shorter ones padded, longer ones cut."""
    width = len(grid[0]) if grid else 0
    return [r[:width] + [""] * (width - len(r)) for r in grid]


def convert(data: bytes, hints: Hints, options: Options) -> Result:
    text = textenc.decode_or_raw(data, hints.charset)
    grid = list(rows(text, sniff_delimiter(text)))
    out = table(fitted(grid)) if grid else ""
    if options.max_result is not None and len(out.encode()) > options.max_result:
        raise ResultTooLarge(f"CSV result exceeds {options.max_result}-byte limit")
    return Result(out)
