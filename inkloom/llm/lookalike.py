"""Problem 1: text that looks alike but is coded differently, brought to one consistent form.

Method: compatibility normalisation of those characters that look like usual ones (full and half width forms,
ligatures, mathematical letters, unusual spaces and hyphens), composition of combining marks, deletion
of characters without a look, then for tokens with letters of several scripts a lattice of look-alikes
searched with Viterbi under character bigram scores of each script. Bigrams are counted over the
whole corpus; the table is bounded by the square of the letters of three alphabets.

Unlike plain NFKC nothing that looks different is touched: superscripts, fractions, ordinal signs,
typographic quotes and dashes stay, as do words written wholly in another script.

Defined results: null stays null, empty stays empty; neither is ever a case.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.llm import mojibake
from inkloom.llm.common import map_rows

#: Look-alike letters of Latin, Cyrillic and Greek, each line one shape. Fixed values.
SHAPES = """
a а α
c с ϲ
e е
h һ
i і ι
j ј
k к κ
l ӏ
o о ο
p р ρ
q ԛ
s ѕ
u υ
v ν ѵ
w ԝ ω
x х χ
y у γ
A А Α
B В Β
C С Ϲ
E Е Ε
H Н Η
I І Ι Ӏ
J Ј
K К Κ
M М Μ
N Ν
O О Ο
P Р Ρ
S Ѕ
T Т Τ
X Х Χ
Y У Υ
Z Ζ
ï ї
ë ё
""".split("\n")

#: Without any look: deleted. Joiners, marks of direction, invisible operators, soft hyphen, variation selectors.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff"
SPACES = "   -   　"
#: Hyphens and the non-breaking hyphen, and single compatibility characters with the look of usual ones.
SINGLES = {"‐": "-", "‑": "-", "⁃": "-", "ʼ": "’", "․": ".", ";": ";", "·": "·", "`": "`", "K": "K", "Å": "Å", "Ω": "Ω", "∕": "/", "∶": ":", "ǉ": "lj", "ǌ": "nj", "Ǉ": "LJ", "Ǌ": "NJ", "ǈ": "Lj", "ǋ": "Nj", "ǳ": "dz", "Ǳ": "DZ", "ǲ": "Dz", "Ĳ": "IJ", "ĳ": "ij", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž"}
#: Ranges whose compatibility form has the same look: roman numerals, letterlike, ligatures, full and half width, mathematical.
COMPAT = "Ⅰ-ⅿ℀-℁℅-℆ℊ-ℕℙ-ℝℤℨℬ-ℱℳ-ℸﬀ-ﬆﬓ-ﬗ！-ﾟ￠-￦\U0001d400-\U0001d7ff豈-﫿⼀-⿕㏠-㏾"
SUSPECT = re.compile(f"[{IGNORABLE}{SPACES}{''.join(SINGLES)}{COMPAT}̀-゙゚ͯ]")
DELETE = re.compile(f"[{IGNORABLE}]")
BLANK = re.compile(f"[{SPACES}]")
FOLD = re.compile(f"[{''.join(SINGLES)}{COMPAT}]+")
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ԯ"
TOKEN = re.compile(f"[{LETTERS}]+")
LATIN = re.compile("[A-Za-zÀ-ɏ]")
OTHER = re.compile("[Ͱ-ϿЀ-ԯ]")
CYRILLIC_ODD = re.compile("[ѕіјһӏԛԝѵЅІЈӀї]")
NUMERIC = "¹²³½¼¾ªº"

LATIN_SCRIPT, CYRILLIC, GREEK = 0, 1, 2
LIMIT = 0x530


def script(ch: str) -> int:
    o = ord(ch)
    return LATIN_SCRIPT if o < 0x370 else GREEK if o < 0x400 else CYRILLIC


@functools.cache
def options() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in SHAPES:
        shape = line.split()
        for ch in shape:
            out[ch] = shape
    return out


class Scores:
    """Log-probabilities of letter pairs within a script; unseen pairs get a floor."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        totals: dict[str, int] = {}
        for (a, _), n in counts.items():
            totals[a] = totals.get(a, 0) + n
        self.pairs = {k: math.log((n + 0.05) / (totals[k[0]] + 5)) for k, n in counts.items()}
        self.floor = math.log(0.05 / 500)

    def __call__(self, a: str, b: str) -> float:
        return self.pairs.get((a.lower(), b.lower()), self.floor)


SWITCH = -25.0
SWAP = -0.5


def best_reading(token: str, scores: Scores) -> str:
    """The most likely reading of a token: Viterbi over each letter's look-alikes."""
    shapes = options()
    columns = [shapes.get(ch, [ch]) for ch in token]
    paths: dict[str, tuple[float, str]] = {}
    for i, column in enumerate(columns):
        new: dict[str, tuple[float, str]] = {}
        for ch in column:
            cost = 0.0 if ch == token[i] else SWAP
            if not paths:
                new[ch] = (cost + scores("", ch), ch)
                continue
            best = None
            for prev, (total, text) in paths.items():
                step = scores(prev, ch) if script(prev) == script(ch) else SWITCH
                if best is None or total + step > best[0]:
                    best = (total + step, text)
            new[ch] = (best[0] + cost, best[1] + ch)
        paths = new
    return max(paths.values())[1]


def _mark_free(text: str) -> str:
    """Compatibility forms, spaces, ignorables and combining marks in their usual coding."""
    if not SUSPECT.search(text):
        return text
    text = BLANK.sub(" ", DELETE.sub("", text))
    text = FOLD.sub(lambda m: "".join(SINGLES.get(c) or unicodedata.normalize("NFKC", c) for c in m[0]), text)
    return unicodedata.normalize("NFC", text)


def canonical(text: str | None, scores: Scores) -> str | None:
    """The one consistent form of a text."""
    if not text or text.isascii():
        return text
    text = _mark_free(text)
    if not OTHER.search(text):
        return text
    n_latin, n_other = len(LATIN.findall(text)), len(OTHER.findall(text))
    mostly_latin = n_latin > n_other
    shapes = options()

    def token(m: re.Match) -> str:
        tok = m[0]
        if tok.isascii() or not OTHER.search(tok):
            # A Latin word among Cyrillic ones may be made of look-alikes altogether.
            if mostly_latin or not all(c in shapes for c in tok) or len(tok) > 3:
                return tok
            a, b = text[max(0, m.start() - 2) : m.start()], text[m.end() : m.end() + 2]
            if not (OTHER.search(a) or OTHER.search(b)) or len(tok) > 1 and not re.fullmatch("[a-z]+|[A-Z][a-z]*", tok):
                return tok
            new = "".join(next((c for c in shapes[x] if script(c) == CYRILLIC), x) for x in tok)
            return new if all(script(c) == CYRILLIC for c in new) and not CYRILLIC_ODD.search(new) and len(tok) == 1 and tok in "acoyABCKOoy" and OTHER.search(a) and OTHER.search(b) else tok
        scripts = {script(c) for c in tok}
        if len(scripts) > 1:
            new = best_reading(tok, scores)
            return new if len({script(c) for c in new}) == 1 else tok
        # A whole word of another script made only of look-alikes, in a line that is otherwise Latin.
        if not all(c in shapes and any(script(x) == LATIN_SCRIPT for x in shapes[c]) for c in tok):
            return tok
        new = "".join(next(x for x in shapes[c] if script(x) == LATIN_SCRIPT) for c in tok)
        if scripts == {GREEK} and len(tok) == 1 and tok not in "οΟΑΒΕΖΗΙΚΜΝΡΤΥΧ":
            return tok
        if CYRILLIC_ODD.search(tok) and (mostly_latin or len(tok) > 1):
            return new
        around = text[max(0, m.start() - 40) : m.start()] + text[m.end() : m.end() + 40]
        if mostly_latin and len(LATIN.findall(around)) > len(OTHER.findall(around)) * 2:
            return new
        return tok

    return TOKEN.sub(token, text)


def _bigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of adjacent letters, packed in one integer; small letters, Latin, Greek and Cyrillic only."""
    total = np.zeros(LIMIT * LIMIT, np.int64)

    def count(texts: list[str]) -> None:
        code = np.frombuffer("\n".join(texts).lower().encode("utf-32-le"), np.uint32)
        code = np.where((code < LIMIT) & (code > 96), code, 0).astype(np.int32)
        keep = (code[:-1] > 0) & (code[1:] > 0)
        total[:] += np.bincount((code[:-1] * LIMIT + code[1:])[keep], minlength=LIMIT * LIMIT)

    for batch in batches:
        for col in batch.columns:
            texts = [t for t in col.to_pylist() if t]
            part, size = [], 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size > 4_000_000:
                    count(part)
                    part, size = [], 0
            if part:
                count(part)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["pair", "n"])


def bigram_scores(df: DataFrame, *text_cols: str) -> Scores:
    """Letter pair scores from all rows; at most LIMIT squared pairs reach the driver, in practice a few thousand."""
    out = df.select(*text_cols).mapInArrow(_bigram_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = {}
    for pair, n in out.collect():
        a, b = chr(pair // LIMIT), chr(pair % LIMIT)
        if a.isalpha() and b.isalpha() and script(a) == script(b):
            counts[a, b] = n
    return Scores(counts)


def _not_plain(col: str):
    return F.col(col).rlike(r"[^\x00-\x7f]")


def canonical_fields(df: DataFrame, id_col: str, text_cols: list[str], scores: Scores) -> DataFrame:
    """The rows with the named fields in consistent form; other columns are not carried."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(c, T.StringType()) for c in text_cols]])
    return map_rows(df.select(id_col, *text_cols), lambda: lambda key, *texts: [(key, *[canonical(t, scores) for t in texts])], schema)


def lookalike_fields(results: DataFrame, scores: Scores) -> DataFrame:
    """(result_id, field_name) of the fields whose consistent form differs, garbled records aside.

    Records garbled by a wrong charset (problem 2: converters html, csv and plaintext) are no cases; they are
    tested here row by row, so no second scan or join is needed.
    """
    schema = T.StructType([T.StructField("result_id", results.schema["result_id"].dataType), T.StructField("field_name", T.StringType())])
    text_kinds = ("html", "csv", "plaintext")

    def make():
        def row(key, converter, markdown, title):
            hit = [name for name, t in (("markdown", markdown), ("title", title)) if t and canonical(t, scores) != t]
            if hit and not (converter in text_kinds and mojibake.is_garbled(markdown)):
                for name in hit:
                    yield key, name

        return row

    suspects = results.where(_not_plain("markdown") | _not_plain("title"))
    return map_rows(suspects.select("result_id", "converter", "markdown", "title"), make, schema)
