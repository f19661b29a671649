"""Reading order of scanned newspaper pages: lines sorted into columns by their boxes, lines run together split."""

from __future__ import annotations

import re

BREAK = "-=~¬­‐‑"
GUTTER = 40
SPLITS = (" | ", "  ")
RULE = re.compile(r"^[\W_]*$")


def _split_line(line: str, width: int) -> tuple[str, str]:
    """The two parts of a line that runs over two columns, each at most about width letters."""
    for sign in SPLITS:
        if sign in line:
            at = min((m.start() for m in re.finditer(re.escape(sign), line)), key=lambda p: abs(2 * p - len(line)) if p <= width + 2 else 10_000)
            return line[:at].rstrip(" |"), line[at + len(sign) :].lstrip(" |")
    at = line.rfind(" ", max(0, len(line) - width - 1), width + 1)
    if at <= 0:
        at = line.find(" ", len(line) // 2)
    return (line[:at], line[at + 1 :]) if at > 0 else (line, "")


def reading_order(text: str, x0: list[int] | None, x1: list[int] | None, y0: list[int] | None, n_columns: int | None) -> list[str]:
    """The text's lines in reading order. Without usable boxes the order given is kept."""
    lines = text.split("\n")
    n = len(lines)
    if not x0 or len(x0) != n or not n_columns or n_columns < 2 or None in x0 or None in x1 or None in y0:
        return lines
    left = min(x0)
    right = max(x1)
    pitch = (right - left + GUTTER) / n_columns
    starts = sorted(x0)
    gaps = [b - a for a, b in zip(starts, starts[1:]) if b - a > 100]
    if not gaps:
        # All lines begin at one place: one column in use, or two that run together.
        lengths = sorted(b - a for a, b in zip(x0, x1))
        if lengths[len(lengths) // 2] < 1.25 * (pitch - GUTTER):
            return lines
    elif abs(min(gaps) / pitch - round(min(gaps) / pitch)) > 0.2:
        pitch = min(gaps)
    column = max(80.0, pitch - GUTTER)
    single = [len(line) for line, a, b in zip(lines, x0, x1) if b - a <= 1.2 * column]
    width = max(single, default=0) or max(map(len, lines)) // 2
    placed: list[tuple[int, int, int, str]] = []
    for i, line in enumerate(lines):
        col = round((x0[i] - left) / pitch)
        if i and x1[i] - x0[i] > 1.2 * column and len(line) > 0.5 * width:
            a, b = _split_line(line, width)
            placed.append((col, y0[i], i, a))
            if b:
                placed.append((col + 1, y0[i], i, b))
        else:
            placed.append((col if i else -1, y0[i], i, line))
    placed.sort()
    return [p[3] for p in placed]


def running_text(lines: list[str]) -> str:
    """Lines joined by blanks, words broken at line ends put together, rules and ornaments left out."""
    out: list[str] = []
    for line in lines:
        line = line.strip(" |")
        if not line or RULE.match(line):
            continue
        if out and out[-1][-1:] in BREAK and len(out[-1]) > 1 and out[-1][-2].isalpha() and line[0].isalpha():
            out[-1] = out[-1][:-1] + line
        else:
            out.append(line)
    return " ".join(out)
