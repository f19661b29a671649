"""Problem 4: noise of scanned pages - broken words, misread letters, running heads and feet, page numbers.

Method: words of the scanned pages that are rare in sound text are joined in SQL with frequent ones whose anagram
hash (a sum over letters, so independent of order) differs by the hash of a known confusion, once or twice; candidates
are verified letter by letter and ranked by frequency. Words with digits among their letters are misread unless sound
text has them too. Heads and feet are the lines at page edges that return
on other pages of the record (confusable letters being equal), repeat its title, or stand across a
sentence that runs over the page's end. A line end is a hyphenation when the joined word is better
attested than the compound.

Which pages are scanned is read from the warnings' locations and the marker comments; page limits come from
pdf_page (line counts only) and the markers.

Defined results: records without scanned pages, null or empty Markdown give nothing; repeated warnings
and pages count once; locations in ranges, padded or abbreviated are understood, others ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from operator import ne

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.llm.common import map_rows, scratch_path
from inkloom.llm.confusions import CONFUSIONS, SHARE_BITS, anagram_hash, skeleton

MARKER = re.compile(r"^<!--.*\bpage (\d+) includes OCR text.*-->\s*$")
TOKEN = re.compile(r"[^\W_]+")
COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
BROKEN = re.compile(r"([^\W_]+)([-¬~=­‐‑])$")
PAGE_NO = re.compile(r"^[\W_]*(?:(?:page|p|pg|seite|s|página|pagina|pág|стр|no)\.?\s*)?(?:[\doOlIi]{1,5}|[ivxlcj]{1,7}|[IVXLC]{1,7})(?:\s*(?:of|/|von|de|sur|из)\s*[\dolI]{1,5})?[\W_]*$", re.I)
NUMBERED = re.compile(r"^\d{1,4}\s{2,}\S.*[^.!?]$|^\S.*[^\s.!?]\s{2,}\d{1,4}$")
END = re.compile(r"[.!?:;…][\"'”’»)]*$")
MONTH = re.compile(r",\s*(?:january|february|march|april|may|june|july|august|september|october|november|december)\b.*$", re.I)

#: Names of two parts parted by a slash, and imprints.
IMPRINT = re.compile(r"^[^\W\d_][^.!?]* / [A-ZÀ-Þ][^\s.!?]+$|^Pr[il1]n[tf][ec]d for \S|^C[oa]p[yv] \d+\. ")
#: A number or a closing month in a line that ends with a stop.
DATED = re.compile(r"\d|, [^\W\d_]\w+\.$")

#: A word is suspect when sound text has it less often than this share of what the scans would make one expect.
RARE_SHARE = 0.05
#: A target must be this much more frequent in sound text than the suspect is in scans, for equal amounts of text.
TARGET_RATIO = 3.0


def scanned_records(results: DataFrame, warnings: DataFrame, pages: DataFrame) -> DataFrame:
    """PDF records with at least one scanned page: Markdown, title, ranges of scanned page numbers, line counts of pages."""
    loc = F.lower(F.trim("location"))
    span = F.regexp_extract(loc, r"p(?:ages?|p?\.)\s*0*(\d{1,6})\s*(?:-|–|to)\s*0*(\d{1,6})", 1).try_cast("int")
    upto = F.regexp_extract(loc, r"p(?:ages?|p?\.)\s*0*(\d{1,6})\s*(?:-|–|to)\s*0*(\d{1,6})", 2).try_cast("int")
    one = F.regexp_extract(loc, r"^p(?:ages?|p?\.)\s*0*(\d{1,6})$", 1).try_cast("int")
    numbers = F.when(span.isNotNull() & (upto >= span), F.struct(span.alias("first"), upto.alias("last"))).when(one.isNotNull(), F.struct(one.alias("first"), one.alias("last")))
    scan = warnings.where("converter = 'pdf' and location is not null").where(F.lower("message").rlike("scan|image|ocr|glyphs were read"))
    named = scan.select("result_id", numbers.alias("pages")).where("pages is not null").groupBy("result_id").agg(F.collect_set("pages").alias("named"))
    filled = F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0
    trimmed = F.regexp_replace("text", r"^\n+|\s+$", "")
    counts = (
        pages.where("text is not null and page_no is not null").where(filled)
        .groupBy("result_id", "page_no").agg(F.max(F.size(F.split(trimmed, "\n"))).alias("n_lines"))
        .groupBy("result_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "n_lines"))).alias("page_lines"))
    )
    pdf = results.where("converter = 'pdf' and markdown is not null and markdown <> ''").select("result_id", "markdown", "title")
    joined = pdf.join(named, "result_id", "left").where(F.col("named").isNotNull() | F.col("markdown").rlike(r"(?m)^<!--[^\n]*\bpage \d+ includes OCR text"))
    return joined.join(counts, "result_id", "left")


def page_spans(lines: list[str], counts: list[tuple[int, int]] | None) -> list[tuple[int, int, int]]:
    """(page number, first line, line behind the last) by markers and, between them, by the pages' line counts."""
    marks = [(i, int(m[1])) for i, x in enumerate(lines) if (m := MARKER.match(x))]
    if not counts:
        return [(n, i + 1, marks[k + 1][0] if k + 1 < len(marks) else len(lines)) for k, (i, n) in enumerate(marks)] or [(1, 0, len(lines))]
    at_mark = dict(marks)
    where = {n: i for i, n in marks}
    out, at = [], 0
    end = len(lines)
    while end and not lines[end - 1].strip():
        end -= 1
    for n, size in counts:
        if n in where:
            at = where[n] + 1
        while at < end and not lines[at].strip():
            at += 1
        if at >= end:
            break
        while at in at_mark and at_mark[at] != n:
            at += 1
            while at < end and not lines[at].strip():
                at += 1
        stop = min(at + size, end)
        for i in range(at, stop):
            if i in at_mark:
                stop = i
                break
        if stop > at:
            out.append((n, at, stop))
        at = stop
    if out and at < end and out[-1][0] == counts[-1][0]:
        out[-1] = (out[-1][0], out[-1][1], end)
    return out


def _key(line: str) -> str:
    line = MONTH.sub("", line.strip())
    return re.sub(r"\s+", " ", re.sub(r"[\d]+", " ", skeleton(re.sub(r"\d+", " ", line)))).strip()


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > max(2, len(a) // 8):
        return False
    n = len(a)
    if n == len(b):
        return sum(map(ne, a, b)) <= 0.15 * n
    head = len(os.path.commonprefix((a, b)))
    return head + len(os.path.commonprefix((a[head:][::-1], b[head:][::-1]))) >= 0.85 * max(n, len(b))


def furniture(lines: list[str], spans: list[tuple[int, int, int]], scanned: set[int], title: str | None) -> dict[int, str]:
    """Line index to 'header' or 'page_no' on scanned pages."""
    filled = {n: [i for i in range(a, b) if lines[i].strip()] for n, a, b in spans}
    own = _key(title or "")
    edge: dict[int, list[int]] = {n: list(dict.fromkeys(ix[:2] + ix[-2:])) for n, ix in filled.items()}
    keys: dict[int, str] = {i: _key(lines[i]) for ix in edge.values() for i in ix}
    on_pages: dict[str, set[int]] = {}
    for n, ix in edge.items():
        for i in ix:
            k = keys[i]
            if len(k) >= 4:
                same = k if k in on_pages else next((o for o in on_pages if _alike(o, k)), k)
                keys[i] = same
                on_pages.setdefault(same, set()).add(n)
    repeated = {k for k, p in on_pages.items() if len(p) > 1}
    order = [n for n, *_ in spans]
    found: dict[int, str] = {}

    def of_title(k: str) -> bool:
        return len(own) >= 8 and len(k) >= 8 and (_alike(k, own) or k.startswith(own) and len(k) - len(own) < 4 or own.startswith(k) and len(k) > 0.7 * len(own))

    def certain(i: int) -> str | None:
        s = lines[i].strip()
        if PAGE_NO.match(s):
            return "page_no"
        k = keys.get(i)
        if k is None:
            k = _key(s)
        if NUMBERED.match(s) or IMPRINT.match(s) or of_title(k):
            return "header"
        if END.search(s) and not DATED.search(s):
            return None  # ends as a sentence does
        if k in repeated and len(k) >= 6:
            return "header"
        part = next((r for r in repeated if len(k) >= 10 and (r.startswith(k + " ") or k.startswith(r + " ") and len(r) >= 10)), None)
        if part:
            return "header"
        letters = [c for c in s if c.isalpha()]
        if len(letters) >= 8 and sum(c.isupper() or c == "l" for c in letters) >= 0.92 * len(letters) and not END.search(s) and not capital_text:
            return "header"
        return None

    body = [lines[i] for ix in filled.values() for i in ix[2:-2]]
    capital_text = bool(body) and sum(x.isupper() for x in body) * 2 > len(body)
    for at, n in enumerate(order):
        if n not in scanned:
            continue
        ix = list(filled[n])
        while ix and len(ix) > 1 and (kind := certain(ix[0])):
            found[ix.pop(0)] = kind
        while ix and len(ix) > 1 and (kind := certain(ix[-1])):
            found[ix.pop()] = kind
        if len(ix) == 1 and (kind := certain(ix[0])) and (kind == "page_no" or len(filled[n]) > 1):
            found[ix.pop()] = kind
    # Lines that are no part of a paragraph: they stop where the next word would still have had room, or stand
    # across a sentence running over the page's end.
    left = {n: [i for i in filled[n] if i not in found] for n in order}
    wide = {n: max((len(lines[i].rstrip()) for i in ix), default=0) for n, ix in left.items()}

    def flows(a: int, b: int, width: int) -> bool:
        """Whether line b can go on the sentence of line a: a is not ended and full."""
        x, y = lines[a].strip(), lines[b].strip()
        return not END.search(x) and len(x) + 1 + len(y.split(" ", 1)[0]) > width

    for at, n in enumerate(order):
        if n not in scanned or len(left[n]) < 3:
            continue
        width = wide[n]
        before = left[order[at - 1]][-1] if at and left[order[at - 1]] else None
        after = left[order[at + 1]][0] if at + 1 < len(order) and left[order[at + 1]] else None
        first, second = left[n][0], left[n][1]
        s = lines[first].strip()
        if s[:1].isupper() and not END.search(s) and not BROKEN.search(s) and not flows(first, second, width):
            if before is None or not flows(before, first, wide[order[at - 1]]) or lines[second].strip()[:1].islower():
                found[first] = "header"
        last, prior = left[n][-1], left[n][-2]
        s = lines[last].strip()
        if last == second and first in found or not s[:1].isupper() or END.search(s) or BROKEN.search(s):
            continue
        if after is not None:
            if not flows(last, after, width) and (_like_head(s) or len(s) < 0.7 * width) or not END.search(lines[prior].strip()) and lines[after].strip()[:1].islower() and not flows(prior, last, width):
                found[last] = "header"
        elif (last - 1 not in left[n] or not END.search(lines[prior].strip()) and not flows(prior, last, width)) and _like_head(s):
            found[last] = "header"
    return found


def _like_head(s: str) -> bool:
    words = TOKEN.findall(s)
    long = [w for w in words if len(w) > 3]
    return 1 <= len(words) <= 12 and (bool(re.search(r" [/|] ", s)) or len(long) >= 2 and sum(w[:1].isupper() for w in long) >= 0.7 * len(long) or s.startswith(("Printed", "Copy", "Prlnt")))


class Record:
    """A record's scanned lines: furniture by line index, and the body lines in reading order."""

    def __init__(self, markdown: str, title: str | None, named, page_lines):
        self.lines = markdown.split("\n")
        counts = [(p["page_no"], p["n_lines"]) for p in page_lines] if page_lines else None
        self.spans = page_spans(self.lines, counts)
        ranges = [(r["first"], r["last"]) for r in named or ()]
        self.scanned = {n for n, *_ in self.spans if any(a <= n <= b for a, b in ranges)} | {int(m[1]) for x in self.lines if (m := MARKER.match(x))}
        self.found = furniture(self.lines, self.spans, self.scanned, title)
        self.body = [(n, i) for n, a, b in self.spans for i in range(a, b) if self.lines[i].strip() and i not in self.found and not MARKER.match(self.lines[i])]


def _sound_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a partition; words of up to 64 letters, longer ones are no words."""
    words: Counter = Counter()
    for batch in batches:
        for md in batch.column(0).to_pylist():
            low = md.lower()
            words.update(TOKEN.findall(low))
            if "-" in low:
                words.update(COMPOUND.findall(low))
    keep = [(w, n) for w, n in words.items() if 1 < len(w) <= 64 and not w.isdigit()]
    if keep:
        w, n = zip(*keep, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n, pa.int64())], names=["word", "clean"])


def lexicon(results: DataFrame, rows: DataFrame) -> DataFrame:
    """(word, clean, scan): counts in sound text (all converters but pdf) and on the lines of scanned pages."""
    sound = results.where("converter <> 'pdf' and markdown is not null").select("markdown").mapInArrow(_sound_counts, "word string, clean long")
    scans = rows.where("kind in ('word', 'compound', 'mixed') and length(word) between 2 and 64").groupBy("word").agg(F.count("*").alias("scan"))
    both = sound.select("word", "clean", F.lit(0).cast("long").alias("scan")).unionByName(scans.select("word", F.lit(0).cast("long").alias("clean"), "scan"))
    return both.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan"))


def anagram_column(word: str) -> Column:
    """The anagram hash of a word as an expression."""
    letters = F.filter(F.split(word, ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda total, x: total + F.xxhash64(x).bitwiseAND(F.lit(SHARE_BITS)))


def corrections(words: DataFrame) -> DataFrame:
    """(word, target): suspect words and the frequent words that they are misreadings of, the best ranked one each."""
    all_clean, all_scan = words.agg(F.sum("clean"), F.sum("scan")).first()
    scale = (all_clean or 0) / max(all_scan or 0, 1)
    base = words.where("length(word) between 3 and 64 and word not like '%-%'").withColumn("expected", F.col("scan") * F.lit(float(scale)))
    suspect = base.where(f"scan > 0 and clean <= {RARE_SHARE} * expected").select("word", "expected", "scan", anagram_column("word").alias("hash"))
    target = base.where("clean + scan >= 3").select(F.col("word").alias("target"), F.greatest("clean", F.col("expected")).alias("weight"), anagram_column("word").alias("target_hash"))
    # A few dozen confusions, of which only those that the word can have are tried.
    known = F.array(*[F.struct(F.lit(t).alias("print"), F.lit(g).alias("misread"), F.lit(anagram_hash(t) - anagram_hash(g)).alias("diff")) for t, g in CONFUSIONS])
    # The same letter is often misread again in a word: each confusion is tried once, and twice where it occurs twice.
    applied = suspect.withColumn("c", F.explode(F.filter(known, lambda c: F.instr(F.col("word"), c["misread"]) > 0))).select("word", "expected", "hash", "c.*")
    occurs = F.size(F.split("word", F.concat(F.lit("\\Q"), "misread", F.lit("\\E")), -1)) - 1
    times = F.explode(F.when((occurs > 1) & (F.length("word") >= TWICE_LENGTH), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    tried = applied.withColumn("times", times).select("word", "expected", "print", "misread", "times", (F.col("hash") + F.col("times") * F.col("diff")).alias("target_hash"))
    hit = tried.join(target, "target_hash").where(f"weight >= {TARGET_RATIO} * expected")
    swap = "concat(substring({0}, 1, {1} - 1), print, substring({0}, {1} + length(misread)))"
    places = "filter(sequence(1, length({0})), {1} -> substring({0}, {1}, length(misread)) = misread)"
    once = F.expr(f"exists({places.format('word', 'i')}, i -> {swap.format('word', 'i')} = target)")
    # Of two places the later is replaced first, so that the earlier keeps its position.
    twice = F.expr(f"exists({places.format('word', 'i')}, i -> exists({places.format('word', 'j')}, j -> j + length(misread) <= i and concat(substring(word, 1, j - 1), print, substring(word, j + length(misread), i - j - length(misread)), print, substring(word, i + length(misread))) = target))")
    return hit.where(F.when(F.col("times") == 1, once).otherwise(twice)).groupBy("word").agg(F.max_by("target", F.struct(-F.col("times"), "weight", "target")).alias("target"))


#: Digits among the letters of one word, or a capital U in place of "ll": misread unless sound text has the word.
MIXED = re.compile(r"^[^\W\d_][^\W_]*[0-9][^\W_]*$|^[0-9][^\W\d_](?=(?:[0-9]*[^\W\d_]){2})[^\W_]*$|^0[^\W\d_]{1,2}$|^[^\W\d_]*[a-zß-ÿ]U[a-zß-ÿ]*$")
#: Words of at least so many letters may have one confusion twice.
TWICE_LENGTH = 6


def _line_rows():
    """Rows of a record: sure lines, words to be looked up, and line ends to be decided."""

    def row(key, markdown, title, named, page_lines):
        rec = Record(markdown, title, named, page_lines)
        for i, kind in rec.found.items():
            yield key, i + 1, kind, None, None, None, None, None
        broken_at: dict[int, str] = {}
        for at, (n, i) in enumerate(rec.body):
            line = rec.lines[i].rstrip()
            tokens = TOKEN.findall(line)
            m = BROKEN.search(line)
            head = broken_at.get(i)
            if head is not None:
                tokens = tokens[1:]
            if m and tokens:
                tokens = tokens[:-1]
            if m:
                nxt = rec.body[at + 1] if at + 1 < len(rec.body) else None
                rest = TOKEN.match(rec.lines[nxt[1]].lstrip()) if nxt else None
                if rest:
                    broken_at[nxt[1]] = m[1]
                    rest_line = nxt[1] + 1 if nxt[0] in rec.scanned else None
                    if n in rec.scanned or rest_line:
                        yield key, i + 1 if n in rec.scanned else None, "broken", (m[1] + rest[0]).lower(), m[1].lower(), rest[0].lower(), rest_line, m[2]
                elif n in rec.scanned:
                    yield key, i + 1, "broken", m[1].lower(), m[1].lower(), "", None, m[2]
            if n in rec.scanned:
                for tok in set(tokens):
                    if MIXED.match(tok) and not tok.isdigit():
                        yield key, i + 1, "mixed", tok.lower() if "U" not in tok[1:] or not tok.isalpha() else tok, None, None, None, None
                    elif len(tok) > 1 and not tok.isdigit():
                        yield key, i + 1, "word", tok.lower(), None, None, None, None
                if "-" in line:
                    for tok in COMPOUND.findall(line.lower()):
                        yield key, i + 1, "compound", tok, None, None, None, None

    return row


ROWS = T.StructType([T.StructField(n, t) for n, t in (("result_id", T.LongType()), ("line_no", T.IntegerType()), ("kind", T.StringType()), ("word", T.StringType()), ("head", T.StringType()), ("tail", T.StringType()), ("tail_line", T.IntegerType()), ("sign", T.StringType()))])


def scan_lines(results: DataFrame, warnings: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """The lines with noise ('found') and the word corrections ('fixes') that they rest on."""
    spark = results.sparkSession
    records = scanned_records(results, warnings, pages)
    row_path, lex_path = scratch_path(spark, "p4-rows"), scratch_path(spark, "p4-words")
    map_rows(records.select("result_id", "markdown", "title", "named", "page_lines"), _line_rows, ROWS).write.parquet(row_path)
    rows = spark.read.parquet(row_path)
    lexicon(results, rows).write.parquet(lex_path)
    words = spark.read.parquet(lex_path)
    broken = rows.where("kind = 'broken'").withColumn("compound", F.concat_ws("-", "head", "tail"))
    count = words.select("word", (F.col("clean") + F.col("scan")).alias("n"))
    known = (
        broken.join(count, "word", "left").withColumnRenamed("n", "n_joined")
        .join(count.withColumnsRenamed({"word": "compound", "n": "n_compound"}), "compound", "left")
        .join(count.withColumnsRenamed({"word": "head", "n": "n_head"}), "head", "left")
        .join(count.withColumnsRenamed({"word": "tail", "n": "n_tail"}), "tail", "left")
        .na.fill(0, ["n_joined", "n_compound", "n_head", "n_tail"])
    )
    own_hyphen = F.expr("tail <> '' and (n_compound > n_joined or n_joined = 0 and n_head >= 5 and n_tail >= 5 and length(head) > 3 and length(tail) > 3 and n_compound > 0)")
    hyphens = known.where(~own_hyphen)
    # Joined words take part in the search for misreadings as whole words do.
    fresh = hyphens.where("n_joined = 0 and tail <> ''").groupBy("word").agg(F.count("*").alias("more"))
    lex = words.join(fresh, "word", "full").select("word", F.coalesce("clean", F.lit(0)).alias("clean"), (F.coalesce("scan", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("scan"))
    fix_path = scratch_path(spark, "p4-fixes")
    corrections(lex).write.parquet(fix_path)
    fixes = spark.read.parquet(fix_path)
    wrong = rows.where("kind = 'word'").join(fixes, "word")
    n_clean, n_scan = words.agg(F.sum("clean"), F.sum("scan")).first()
    sound = words.where(F.col("clean") > RARE_SHARE * (n_clean or 0) / max(n_scan or 0, 1) * F.col("scan")).select("word")
    mixed = rows.where("kind = 'mixed'").join(sound, "word", "left_anti")
    # In a broken word the misread letter is before or behind the break.
    first_diff = F.expr("aggregate(sequence(1, length(word)), cast(0 as int), (a, i) -> if(a = 0 and substring(word, i, 1) <> substring(target, i, 1), i, a))")
    split = hyphens.join(fixes, "word").withColumn("at", first_diff)
    split_line = F.when(F.col("at") <= F.length("head"), F.col("line_no")).otherwise(F.col("tail_line"))
    # A part with a digit among its letters is misread whatever the word is.
    digit = hyphens.select("result_id", F.explode(F.array(F.struct(F.col("line_no").alias("line_no"), F.col("head").alias("part")), F.struct(F.col("tail_line").alias("line_no"), F.col("tail").alias("part")))).alias("x")).where("x.part rlike '[a-zß-ÿ][0-9]|[0-9][a-zß-ÿ]{2}'").select("result_id", "x.line_no", F.lit("misread").alias("noise"))
    found = (
        rows.where("kind in ('header', 'page_no')").select("result_id", "line_no", F.col("kind").alias("noise"))
        .unionByName(mixed.select("result_id", "line_no", F.lit("misread").alias("noise")))
        .unionByName(hyphens.where("line_no is not null").select("result_id", "line_no", F.lit("hyphen").alias("noise")))
        .unionByName(wrong.select("result_id", "line_no", F.lit("misread").alias("noise")))
        .unionByName(split.select("result_id", split_line.alias("line_no"), F.lit("misread").alias("noise")))
        .unionByName(digit)
        .where("line_no is not null").distinct()
    )
    return {"found": found, "fixes": fixes, "records": records, "words": rows.where("kind in ('word', 'mixed')")}


def repaired(parts: dict[str, DataFrame]) -> DataFrame:
    """(result_id, text): the record in continuous paragraphs, furniture left out, words joined and corrected."""
    used = parts["words"].join(parts["fixes"], "word").select("result_id", "word", "target").distinct()
    fixes = used.groupBy("result_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "target"))).alias("fixes"))
    noise = parts["found"].groupBy("result_id").agg(F.collect_list(F.struct("line_no", "noise")).alias("noise"))
    data = parts["records"].join(noise, "result_id", "left").join(fixes, "result_id", "left").select("result_id", "markdown", "title", "named", "page_lines", "noise", "fixes")
    schema = T.StructType([T.StructField("result_id", T.LongType()), T.StructField("text", T.StringType())])

    def make():
        def fix(tok: re.Match, table: dict[str, str]) -> str:
            new = table.get(tok[0].lower())
            if not new:
                return tok[0]
            return new.upper() if tok[0].isupper() else new[:1].upper() + new[1:] if tok[0][:1].isupper() else new

        def row(key, markdown, title, named, page_lines, noise, table):
            table = dict(table or {})
            by_line: dict[int, set[str]] = {}
            for x in noise or ():
                by_line.setdefault(x["line_no"], set()).add(x["noise"])
            rec = Record(markdown, title, named, page_lines)
            page_of = {i: n for n, a, b in rec.spans for i in range(a, b)}
            out, run, glue = [], "", False
            pending_blank = False
            last_page = None
            for i, line in enumerate(rec.lines):
                marks = by_line.get(i + 1, ())
                if MARKER.match(line) or "header" in marks or "page_no" in marks:
                    continue
                if not line.strip():
                    pending_blank = True
                    continue
                page = page_of.get(i)
                text = line.strip() if page in rec.scanned else line.rstrip()
                if page in rec.scanned and table:
                    text = TOKEN.sub(lambda m: fix(m, table), text)
                goes_on = glue or bool(run) and page != last_page and not END.search(run) and text[:1].islower()
                if run and pending_blank and not goes_on:
                    out.append(run)
                    run = ""
                run = run + text if glue else f"{run} {text}" if run else text
                glue = "hyphen" in marks
                if glue:
                    run = run[:-1]
                pending_blank, last_page = False, page
            if run:
                out.append(run)
            yield key, "\n\n".join(out)

        return row

    return map_rows(data, make, schema)
