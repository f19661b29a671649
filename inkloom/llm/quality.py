"""Problem 5: statistics of each text and its class: prose, list, table or junk.

Method: tables show as delimiters that stand in the same columns of consecutive lines (pipes, tabs, semicolons, wide
gaps), lists as marks, as runs of short lines of like form, or by the periodicity of indentation and the autocorrelation of
line lengths where few words are common ones; junk as lines without readable words (letters, vowels), as matter that repeats
few words, or as words of which hardly any are common ones of one language. A text
is of a class when more than half of its characters, page furniture aside, stand in such lines.

Defined results: null Markdown gives null statistics and no class; empty or blank Markdown gives zero counts and
no class; a text with exactly half of its characters in one class is prose.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.llm import mojibake
from inkloom.llm import pageparts as P
from inkloom.llm.common import map_rows

WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
CJK = re.compile("[぀-ヿ㐀-鿿ｦ-ﾟ]")
KANA = re.compile("[぀-ヿ]")
MARK = re.compile(r"\s*(?:[-*+•·–‣◦▪]|\(?\d{1,3}[.):]|\(?[a-zA-Zа-яА-Я][.)]|\(?[ivxIVX]{1,4}[.)]|\[[ xX]\])\s+\S")
END_MARK = re.compile(r"[.!?。！？…][\"'”’»“)\]]*$")
GAP = re.compile(r"\S(\s{2,}|\t+)(?=\S)")
FENCE = re.compile(r"^\s*(?:```|~~~)")
CODE = re.compile(r"[{};]\s*$|^\s*(?:def|class|import|from|return|function|var|let|const|public|private|static|void|int|if|for|while|else|elif|try|except|#include|package|using|select|insert)\b.*[({:;=]|=>|->|\(\)|\w\(.*\)|[=!<>]=|^\s*[#/]{2}\s|</?\w+[^>]*>|^\s*[})\]]+;?\s*$|\w+\s*[+*/-]?=\s*\S", re.I)
BLOB = re.compile(r"^\s*(?:[A-Za-z0-9+/=_-]{24,}|(?:[0-9a-fA-F]{2,}[ :-]?){6,}|(?:\S*[0-9a-fA-F]{8,}\S*\s*)+)\s*$")
VOWELS = re.compile("[aeiouyäöüáàâãéèêëíìîïóòôõúùûąęaeiouyаеёиоуыэюяіїєαεηιουω]", re.I)
#: Text of no language, such as filling text, holds a smaller share of the common words of any single language than this.
LANGUAGE_COMMON = 0.08
BULLET = re.compile(r"\s*(?:[-*+•·–‣◦▪]|\(?\d{1,3}[.):]|\[[ xX]\])\s+\S")
NOT_LETTERS = " 0123456789.,;:!?()[]{}\"'’“”«»-–—|/\\+*=<>#$%&@^~_`"
COUNTED_VOWELS = "aeiouyáéíóúàèùâêôäöüãõаеёиоуыэюя"
LETTERS = re.compile(r"[^\W\d_]+")
#: Entries of lists hold a smaller share of common words than this; verse and dialogue, which may be indented, a larger one.
LIST_COMMON = 0.1


def _readable(line: str) -> bool:
    """Whether a line reads as language: letters in words with vowels, not a blob, not a repeated filling."""
    s = line.strip()
    if not s:
        return True
    if not s.isascii() and len(s.encode()) > 2.2 * len(s) and len(CJK.findall(s)) * 2 > len(s):
        return True
    visible = len(s) - s.count(" ") - s.count("\t")
    if len(s) - sum(map(s.count, NOT_LETTERS)) - s.count("\t") < 0.5 * visible and sum(map(str.isalpha, s)) < 0.5 * visible:
        return False
    words = WORD.findall(s)
    if not words:
        return False
    if BLOB.match(s):
        return False
    long = [w for w in words if len(w) >= 4]
    with_vowel = sum(1 for w in long if VOWELS.search(w) and not re.search(r"[b-df-hj-np-tv-xzбвгджзклмнпрстфхцчшщ]{5,}", w, re.I))
    if long and with_vowel < 0.6 * len(long):
        return False
    return True


def _looks_code(lines: list[str]) -> bool:
    """Consecutive lines of which most have the signs of program code."""
    hits = sum(bool(CODE.search(x)) for x in lines)
    return len(lines) >= 3 and hits * 2 > len(lines) and sum(bool(END_MARK.search(x.rstrip())) for x in lines) * 4 < len(lines)


def _aligned(lines: list[str]) -> bool:
    """Vertical delimiter alignment: gaps of consecutive lines that end at the same columns, or equal delimiter counts."""
    if len(lines) < 2:
        return False
    for d in ("|", "\t", ";", ","):
        counts = [x.count(d) for x in lines]
        if min(counts) >= (1 if d in "|\t" else 2):
            common, n = Counter(counts).most_common(1)[0]
            if n >= 0.7 * len(lines):
                cells = [c for x in lines for c in x.split(d)]
                # Prose with commas has long cells that go on with a space.
                if d not in ",;" or sum(len(c) for c in cells) <= 24 * len(cells) and (d == ";" or sum(c.startswith(" ") for c in cells) * 2 < len(cells) or sum(any(ch.isdigit() for ch in c) for c in cells) * 4 > len(cells)):
                    if d != ";" or sum(c.startswith(" ") for c in cells) * 2 < len(cells) or common >= 3:
                        return True
    starts = [{m.end() for m in GAP.finditer(x)} for x in lines]
    if sum(bool(s) for s in starts) < 0.6 * len(lines):
        return False
    columns = Counter(c for s in starts for c in s)
    return bool(columns) and columns.most_common(1)[0][1] >= 0.5 * len(lines)


def _autocorrelation(lengths: list[int]) -> float:
    """Of line lengths at the best small lag; high for lists and tables with a rhythm."""
    n = len(lengths)
    if n < 6:
        return 0.0
    mean = sum(lengths) / n
    dev = [x - mean for x in lengths]
    var = sum(d * d for d in dev)
    if var <= n * 4:
        return 1.0
    return max(sum(dev[i] * dev[i + lag] for i in range(n - lag)) / var for lag in (1, 2, 3, 4) if lag < n)


def _indentation_period(lines: list[str]) -> float:
    """How well the indentation of lines repeats at the best small lag, 0 to 1; 0 where all stand at one place."""
    n = len(lines)
    indents = [len(x) - len(x.lstrip()) for x in (y.expandtabs(4) for y in lines)]
    if n < 4 or len(set(indents)) < 2:
        return 0.0
    return max((sum(indents[i] == indents[i + lag] for i in range(n - lag)) / (n - lag) for lag in (2, 3, 4) if 2 * lag <= n), default=0.0)


def _word_ratios(lines: list[str], common: set[str]) -> tuple[float, float | None]:
    """Share of letters that stand in words, and of common words among these; null where the text parts no words or no common ones are given."""
    text = " ".join(lines)
    words = WORD.findall(text)
    visible = len(text) - sum(map(text.count, " \t"))
    share = sum(map(len, words)) / visible if visible else 0.0
    if not common or not words or CJK.search(text):
        return share, None
    return share, sum(w.lower() in common for w in words) / len(words)


class CommonWords(set):
    """Frequent words of all languages, and those of each."""

    def __init__(self, by_language: dict[str, set[str]]):
        super().__init__(w for ws in by_language.values() for w in ws)
        self.languages = list(by_language.values())

    def __reduce__(self):
        return CommonWords, ({str(i): ws for i, ws in enumerate(self.languages)},)


def _of_no_language(words: list[str], text: str, common: set[str]) -> bool:
    """Whether hardly any of a text's words are common ones of one language; false where words are not parted or none are given."""
    if not common:
        return False
    known = [w for w in words if w in common]
    least = LANGUAGE_COMMON * len(words)
    if len(known) >= least and any(sum(w in ws for w in known) >= least for ws in getattr(common, "languages", [common])):
        return False
    return text.isascii() or len(CJK.findall(text)) * 4 <= len(text)


def _rhythmic_list(lines: list[str], common: set[str]) -> bool:
    """Entries in a rhythm of indentation or of line lengths, in words but with few of those that join sentences."""
    stripped = [x.strip() for x in lines]
    n = len(lines)
    if n < 4 or sum(bool(END_MARK.search(x)) for x in stripped) * 5 > n:
        return False
    period = _indentation_period(lines) >= 0.85
    # Wrapped prose has lines of nearly one length: only a rhythm of long and short ones counts.
    lengths = [len(x) for x in stripped]
    rhythm = n >= 6 and sum(x < 0.6 * max(lengths) for x in lengths) * 4 >= n and _autocorrelation(lengths) >= 0.5
    if not period and not rhythm:
        return False
    in_words, known = _word_ratios(stripped, common)
    return in_words >= 0.5 and known is not None and known < LIST_COMMON


def _plainly_prose(lines: list[str]) -> bool:
    """A cheap sufficient test: words of letters with vowels, ending as sentences end, without columns or marks."""
    text = " ".join(lines)
    if len(text) < 60 or "|" in text or "\t" in text or "  " in text or not END_MARK.search(text[-8:].rstrip()) or BULLET.match(text):
        return False
    if len(lines) > 1 and MARK.match(lines[1]):
        return False
    words = text.lower().split()
    n, low = len(words), text.lower()
    other = sum(map(low.count, NOT_LETTERS))
    letters = len(text) - other
    if letters < 0.68 * len(text):
        return False
    if not text.isascii() and len(text.encode()) > 2.2 * len(text):
        return True
    return 2.2 * n < letters < 9 * n and 0.27 * letters < sum(map(low.count, COUNTED_VOWELS)) < 0.65 * letters and len(set(words)) * 4 > n


def _kind_of_block(lines: list[str], common: set[str]) -> str | None:
    """list, table, junk or None for one block of lines without blank lines between."""
    n = len(lines)
    stripped = [x.strip() for x in lines]
    if P.HEADING.match(lines[0]) and n == 1:
        return "head"
    if all(P.TABLE_ROW.match(x) for x in lines):
        bare = " ".join(re.sub(r"[|:\-\s]+", " ", x) for x in lines)
        return "table" if bare.strip() else "junk"
    if _plainly_prose(lines):
        return None
    bad = sum(len(x) for x in stripped if not _readable(x))
    total = sum(map(len, stripped))
    if n >= 2 and _aligned(lines):
        dense = sum(ch.isalnum() or ch.isspace() for x in stripped for ch in x)
        if dense > 0.55 * total:
            blobs = sum(bool(BLOB.match(x)) or bool(re.search(r"0x[0-9a-f]{4,}|[0-9a-f]{20,}", x)) for x in stripped)
            if blobs * 2 < n:
                return "table"
    if bad * 2 > total:
        return "junk"
    if _looks_code(lines):
        return "junk"
    marks = sum(bool((MARK if n > 2 else BULLET).match(x)) for x in lines)
    if marks * 2 > n and marks >= 1:
        return "list"
    if n >= 4 and len(set(stripped)) * 3 <= n:
        return "junk"  # the same few lines again and again
    if _rhythmic_list(lines, common):
        return "list"
    return None


def _unmarked_list(lines: list[str], common: set[str]) -> bool:
    """Short lines of like form, each by itself: no sentence goes on from one to the next."""
    n = len(lines)
    if n < 4:
        return False
    s = [x.strip() for x in lines]
    lengths = [len(x) for x in s]
    mean = sum(lengths) / n
    upper = sum(x[:1].isupper() or x[:1].isdigit() for x in s)
    lower = sum(x[:1].islower() for x in s)
    if mean > 48:
        return _rhythmic_list(lines, common)
    ends = sum(bool(END_MARK.search(x)) for x in s)
    commas = sum(x.endswith((",", ";", ":", "-", "–", "—")) for x in s)
    if commas * 5 > n or ends * 5 > n:
        return False
    widest = max(lengths)
    # Wrapped prose has lines nearly as wide as the widest; verse and dialogue have end marks or commas.
    full = sum(x >= 0.8 * widest for x in lengths)
    if upper >= 0.9 * n and (full < 0.75 * n or mean < 22):
        return True
    words = sum(len(x.split()) for x in s) / n
    return lower >= 0.9 * n and words <= 4 and full < 0.75 * n and mean < 30


def text_class(markdown: str | None, converter: str | None, common: set[str], restored: bool = False) -> str | None:
    """'list', 'table' or 'junk' when more than half of a text is that, else None.

    restored: the text was garbled, and what it was may not be had in full; that few of its words are known proves nothing.
    """
    if not markdown or not markdown.strip():
        return None
    if converter == "html":
        kept = [(x.no, x.text) for x in P.page_lines(markdown) if x.verdict != 1]
        lines, last = [], None
        for no, t in kept:
            if last is not None and no > last + 1:
                lines.append("")
            lines.append(t)
            last = no
    else:
        lines = markdown.split("\n")
    sizes: Counter = Counter()
    block: list[str] = []
    fenced = False
    prose_like: list[list[str]] = []

    def close() -> None:
        if not block:
            return
        size = sum(len(x.strip()) for x in block)
        kind = _kind_of_block(block, common)
        if kind is None:
            prose_like.append(list(block))
        elif kind != "head":
            sizes[kind] += size
        sizes["all"] += size
        block.clear()

    for line in lines:
        if FENCE.match(line):
            close()
            fenced = not fenced
            continue
        if fenced:
            sizes["junk"] += len(line.strip())
            sizes["all"] += len(line.strip())
        elif not line.strip():
            close()
        elif line.startswith("<!--") and line.rstrip().endswith("-->") or converter == "zip" and line.startswith("## File: "):
            close()
        elif P.HEADING.match(line):
            close()
            sizes["all"] += len(line)
        else:
            block.append(line)
    close()
    if not sizes["all"]:
        return None
    # Entries parted by blank lines, and unmarked lists, are told from prose by all such blocks together.
    listed = [_unmarked_list(b, common) for b in prose_like]
    single = [b[0] for b in prose_like if len(b) == 1]
    if len(single) >= 4 and _unmarked_list(single, common):
        sizes["list"] += sum(len(x.strip()) for x in single)
        listed = [y or len(b) == 1 for b, y in zip(prose_like, listed, strict=True)]
    sizes["list"] += sum(len(x.strip()) for b, y in zip(prose_like, listed, strict=True) if y and len(b) > 1 for x in b)
    prose = "\n".join("\n".join(b) for b, y in zip(prose_like, listed, strict=True) if not y)
    words = LETTERS.findall(prose.lower())
    if len(words) >= 20:
        different = set(words)
        if len(different) <= max(3, min(12, 0.06 * len(words))) or not restored and _of_no_language(words, prose, common):
            sizes["junk"] += len(prose)
    kind, size = max(((k, sizes[k]) for k in ("list", "table", "junk")), key=lambda x: x[1])
    if size * 2 <= sizes["all"]:
        return None
    if kind == "junk" and not markdown.isascii() and mojibake.is_garbled(markdown):
        # Garbled prose is prose: judged by the text it was, or kept when that is lost.
        was = mojibake.restore(markdown)
        return None if was == markdown or mojibake.is_garbled(was) else text_class(was, converter, common, True)
    return kind


STATS = [("n_words", T.IntegerType()), ("mean_word_length", T.DoubleType()), ("symbol_ratio", T.DoubleType()), ("end_mark_share", T.DoubleType()), ("common_word_share", T.DoubleType()), ("aligned_share", T.DoubleType()), ("length_autocorrelation", T.DoubleType())]


def statistics(markdown: str | None, common: set[str]) -> tuple:
    """The values of STATS for one text; nulls for null."""
    if markdown is None:
        return (None,) * len(STATS)
    words = WORD.findall(markdown)
    japanese = len(CJK.findall(markdown))
    lines = [x for x in markdown.split("\n") if x.strip()]
    visible = len(re.sub(r"\s+", "", markdown))
    symbols = len(re.findall(r"[^\w\s]", markdown))
    known = sum(1 for w in words if w.lower() in common)
    n = len(words)
    aligned = sum(1 for a, b in zip(lines, lines[1:], strict=False) if _aligned([a, b]))
    return (
        n,
        sum(map(len, words)) / n if n else 0.0,
        symbols / visible if visible else 0.0,
        sum(bool(END_MARK.search(x.rstrip())) for x in lines) / len(lines) if lines else 0.0,
        known / n if n and not japanese * 2 > visible else 0.0,
        aligned / (len(lines) - 1) if len(lines) > 1 else 0.0,
        _autocorrelation([len(x) for x in lines]),
    )


def common_set(common_words: DataFrame, most: int = 10_000) -> set[str]:
    """The frequent words; the table is fixed and small, which is checked."""
    words = common_words.where("word is not null").select("lang", "word").distinct().limit(most + 1).collect()
    if len(words) > most:
        raise ValueError(f"more than {most} common words")
    by_language: dict[str, set[str]] = {}
    for lang, word in words:
        by_language.setdefault(lang or "", set()).add(word.lower())
    return CommonWords(by_language)


def text_statistics(results: DataFrame, common: set[str]) -> DataFrame:
    """result_id with the statistics and the class ('prose' when it is none of the others)."""
    schema = T.StructType([T.StructField("result_id", T.LongType()), *[T.StructField(n, t) for n, t in STATS], T.StructField("text_class", T.StringType())])

    def make():
        def row(key, converter, markdown):
            kind = text_class(markdown, converter, common)
            yield key, *statistics(markdown, common), kind or ("prose" if markdown and markdown.strip() else None)

        return row

    return map_rows(results.select("result_id", "converter", "markdown"), make, schema)


def not_prose(results: DataFrame, common: set[str]) -> DataFrame:
    """(result_id, text_class) of the records whose Markdown is not natural prose."""
    schema = T.StructType([T.StructField("result_id", T.LongType()), T.StructField("text_class", T.StringType())])

    def make():
        def row(key, converter, markdown):
            kind = text_class(markdown, converter, common)
            if kind:
                yield key, kind

        return row

    filled = results.where(F.col("markdown").isNotNull() & (F.col("markdown") != "")).select("result_id", "converter", "markdown")
    return map_rows(filled, make, schema)
