"""Problem 6: cutting oversized Markdown into pieces at natural boundaries.

Method: lexical cohesion. Around each candidate boundary the words of the block before are compared
with those of the block after (cosine); the depth of the valley in that curve marks a change
of topic. A piece ends at the deepest valley in the last part of its size window, at the strongest kind
of boundary there is (block, line, sentence, word, character), and the next piece begins with the
last bytes of the one before.

Defined results: null or empty text gives no piece; text of at most the limit is one piece; limits
count bytes of UTF-8 and no character is split. Pieces without their overlap, joined, give the text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.llm.common import map_rows

WORD = re.compile(r"\w+")
#: Kinds of boundary, the strongest first: ends of blocks, lines, sentences, words.
KINDS = [re.compile(r"\n{2,}"), re.compile(r"\n"), re.compile(r"[.!?…][\"'”’»)]*\s+|[。！？]"), re.compile(r"\s+")]


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    if len(b) < len(a):
        a, b = b, a
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def _valley_depths(text: str, cuts: list[int], span: int) -> list[float]:
    """How much less alike the words around each cut are than around the cuts beside it."""
    first = max(0, cuts[0] - span)
    found = [(m.start() + first, m[0]) for m in WORD.finditer(text[first : cuts[-1] + span].lower())]
    starts, words = [p for p, _ in found], [w for _, w in found]
    alike = []
    for c in cuts:
        at = bisect_left(starts, c)
        alike.append(_cosine(Counter(words[bisect_left(starts, c - span) : at]), Counter(words[at : bisect_left(starts, c + span)])))
    depths = []
    for i, s in enumerate(alike):
        left = right = s
        for j in range(i - 1, -1, -1):
            if alike[j] < left:
                break
            left = alike[j]
        for j in range(i + 1, len(alike)):
            if alike[j] < right:
                break
            right = alike[j]
        depths.append(left - s + right - s)
    return depths


def _byte_offsets(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.zeros(len(code) + 1, np.int64)
    np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), out=out[1:])
    return out


def _fit(offsets: np.ndarray | None, start: int, size: int, n: int) -> int:
    """The last character position whose byte offset is at most size bytes after start."""
    if offsets is None:
        return min(n, start + size)
    return int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1


def pieces_of(text: str, limit: int = 8000, overlap: int = 400, span: int = 600) -> Iterator[tuple[int, int, int]]:
    """(begin, core, end) in characters: the piece is text[begin:end], of which text[begin:core] is the overlap."""
    if limit < 8 or overlap >= limit // 2:
        raise ValueError("the limit must be at least 8 bytes and the overlap less than half of it")
    n = len(text)
    if not n:
        return
    offsets = None if text.isascii() else _byte_offsets(text)
    begin = core = 0
    while True:
        end = _fit(offsets, begin, limit, n)
        if end >= n:
            yield begin, core, n
            return
        # A piece is at least half full, so that the number of pieces stays near the least.
        least = max(core + 1, _fit(offsets, begin, limit // 2, n))
        for kind in KINDS:
            cuts = [m.end() for m in kind.finditer(text, least, end) if m.end() <= end]
            # A match that only ends because the window does may go on behind it.
            cuts = [c for c in cuts if c < n]
            if cuts:
                break
        if cuts:
            depths = _valley_depths(text, cuts, span)
            end = cuts[max(range(len(cuts)), key=lambda i: (depths[i], cuts[i]))]
        yield begin, core, end
        core = end
        if offsets is None:
            begin = max(0, end - overlap)
        else:
            begin = int(np.searchsorted(offsets, offsets[end] - overlap))
        # The overlap begins with a whole word where there is one near.
        space = re.compile(r"\s\S").search(text, begin, min(core, begin + 80))
        if space and begin and not text[begin - 1].isspace() and space.start() + 1 < core:
            begin = space.start() + 1


def split_pieces(df: DataFrame, id_col: str = "result_id", text_col: str = "markdown", limit: int = 8000, overlap: int = 400) -> DataFrame:
    """Pieces (id, piece_no from 0, overlap_bytes, n_bytes, piece) of all texts above the limit."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("piece_no", T.IntegerType()), T.StructField("overlap_bytes", T.IntegerType()), T.StructField("n_bytes", T.IntegerType()), T.StructField("piece", T.StringType())])

    def make():
        def cut(key, text):
            for i, (begin, core, end) in enumerate(pieces_of(text, limit, overlap)):
                piece = text[begin:end]
                yield key, i, len(text[begin:core].encode()), len(piece.encode()), piece

        return cut

    return map_rows(df.where(F.octet_length(text_col) > limit).select(id_col, text_col), make, schema)


def oversized(df: DataFrame, id_col: str = "result_id", text_col: str = "markdown", limit: int = 8000, overlap: int = 400) -> DataFrame:
    """Ids of the records that had to be cut: those with a second piece."""
    return split_pieces(df, id_col, text_col, limit, overlap).where("piece_no = 1").select(id_col)
