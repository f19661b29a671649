"""Markdown building for single documents: normalisation, tables, bounded writing."""

from __future__ import annotations

import re
from collections.abc import Sequence

from inkloom.model import ResultTooLarge

_TRAILING = re.compile(r"[ \t]+(?=\n|\Z)")
_MANY = re.compile(r"\n{3,}")


def normalize(text: str) -> str:
    """As functions.normalize.normalized, for one document."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _MANY.sub("\n\n", _TRAILING.sub("", text)).strip("\n")
    return text + "\n" if text else ""


def escape_cell(text: str) -> str:
    return re.sub(r"\r\n|\r|\n", " ", text).replace("|", "\\|").strip()


def table(rows: Sequence[Sequence[str]]) -> str:
    """A pipe table as wide as its widest row; '' without rows or columns."""
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    lines = []
    for i, row in enumerate(rows):
        lines.append("| " + " | ".join([escape_cell(c) for c in row] + [""] * (width - len(row))) + " |")
        if not i:
            lines.append("| " + " | ".join(["---"] * width) + " |")
    return "\n".join(lines) + "\n"


class Bounded:
    """Text parts up to a limit in bytes; the write that would pass it keeps nothing and raises."""

    def __init__(self, limit: int | None, what: str = "result"):
        self.parts: list[str] = []
        self.size, self.limit, self.what = 0, limit, what

    def write(self, text: str) -> None:
        size = len(text.encode("utf-8", "surrogatepass"))
        if self.limit is not None and self.size + size > self.limit:
            raise ResultTooLarge(f"{self.what} exceeds {self.limit}-byte limit")
        self.parts.append(text)
        self.size += size

    def text(self) -> str:
        return "".join(self.parts)
