"""Problem 2: text that was decoded with the wrong charset.

Method: the garbled sequences of UTF-8 read by any single-byte charset, and by those that read bytes in pairs, are
computed beforehand and put into one multi-pattern automaton; a match is verified by coding the span back. For
single-byte text read by another single-byte charset the garbled letters of all pairs are computed too, but proper text
may hold them: they count only in a context that gives them away - a symbol, control or foreign letter inside a
word, a capital between small letters, or a run of them. Only matched spans are replaced; mixed correct text
stays as it is. Where several pairs explain the letters equally well, the stream's declared charset decides.
Text of seven-bit charsets (ISO-2022, HZ, UTF-7) and UTF-16 or UTF-32 read byte by byte may be garbled to ASCII alone: shift
sequences and nulls give it away, and a span counts if its bytes decode to plausible text.

Defined results: null and empty texts are unaffected. A replacement character is always a case and
cannot be restored; it stays. Text garbled twice is restored in rounds.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections import Counter

#: Charsets by which text is wrongly decoded, one byte to a character.
SINGLE = ["cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "iso8859-5", "koi8-r", "cp437", "cp850", "cp866", "mac_roman"]
#: Charsets in which text was really coded, one byte to a character.
TRUE_SINGLE = ["cp1252", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "iso8859-5", "koi8-r", "cp437", "cp850", "cp866", "mac_roman"]
#: Charsets of Japanese text.
TRUE_DOUBLE = ["euc_jp", "shift_jis"]
#: Charsets by which UTF-8 bytes are read in pairs.
DOUBLE = ["shift_jis", "euc_jp", "gbk", "big5", "euc_kr"]

#: The letters of the languages that may be restored. Fixed values.
ALPHABETS = {
    "west": "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœŒ",
    "pl": "ĄĆĘŁŃÓŚŹŻąćęłńóśźż",
    "ru": "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдеёжзийклмнопрстуфхцчшщъыьэюя",
}
#: Marks that are garbled together with letters. Fixed values.
MARKS = "£€§°²³½¼¾«»“”„‘’–—…•·©®¿¡º"


@functools.cache
def to_byte(charset: str) -> dict[str, int]:
    """Character to byte; bytes without a character count as the control of the same number."""
    out = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, b)
    if charset == "cp1252":
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


@functools.cache
def from_byte(charset: str) -> dict[int, str]:
    return {b: c for c, b in reversed(to_byte(charset).items())}


def _utf8_units() -> list[bytes]:
    """All beginnings of UTF-8 sequences that decide: both bytes of two, the first two of three."""
    two = [bytes([a, b]) for a in range(0xC2, 0xDA) for b in range(0x80, 0xC0)]
    three = [bytes([a, b]) for a in range(0xE0, 0xF0) for b in range(0xA0 if a == 0xE0 else 0x80, 0xC0)]
    four = [bytes([0xF0, b]) for b in range(0x90, 0xC0)]
    return two + three + four


#: What garbled UTF-8 is restored to: letters of Latin, Greek and Cyrillic, punctuation, signs, Japanese.
PLAUSIBLE = re.compile("[\u00a0-\u017f\u02c6-\u02dd\u0300-\u030c\u0391-\u03ce\u0401-\u0451\u2010-\u203a\u20ac\u2116\u2122\u2190-\u2193\u2202-\u2265\u3000-\u30ff\u4e00-\u9fff\uff01-\uff9f\ufb00-\ufb06\ufeff\ufffd\U0001f300-\U0001faff]")
CYRILLIC = re.compile("[Ѐ-џґҐ]+")

#: In single-byte readings these second characters also follow a capital in proper text: quotes, dashes and the like.
COMMON_AFTER = set("«»“”„‘’–—…• °º·ё…›‹‚Ё№©®™")


#: One sign of each block of 64 that shares its first two bytes: Japanese marks and kana.
WIDE_FIRST = range(0x3000, 0x3100, 0x40)


@functools.cache
def _double_units(charset: str) -> frozenset[str]:
    """Two-character beginnings of UTF-8 text of letters and kana as the charset reads it in pairs of bytes.

    Chinese signs stand beside kana in Japanese text and are found with them. A letter of two bytes gives one sign: it is a unit together with the sign of a following one, or with the
    ASCII letter beside it. Signs of three bytes straddle pairs: the first two bytes of one, its last with the next one's first.
    """
    out: set[str] = set()

    def read(raw: bytes) -> str | None:
        try:
            text = raw.decode(charset)
        except UnicodeDecodeError:
            return None
        return text if len(text) == 2 and not text.isascii() else None

    two = [ch.encode() for ch in sorted({c for a in ALPHABETS.values() for c in a}) if len(ch.encode()) == 2]
    cyrillic = [c for c in two if c[0] in (0xD0, 0xD1)]
    for a in cyrillic:
        out.update(filter(None, (read(a + b) for b in cyrillic)))
    for a in two:
        if a not in cyrillic:
            ascii_letters = "abcdefghijklmnopqrstuvwxyz"
            out.update(filter(None, (read(x) for c in ascii_letters for x in (a + c.encode(), c.encode() + a))))
    for a in {chr(c).encode()[:2] for c in WIDE_FIRST}:
        for last in range(0x80, 0xC0):
            out.update(filter(None, (read(a + bytes([last, lead])) for lead in (0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEF))))
    return frozenset(out)


def _double_span(text: str, start: int, charset: str) -> tuple[int, int, str] | None:
    """The garbled stretch around a matched unit and what it was, if coding it back gives UTF-8."""

    def raw(ch: str) -> bytes | None:
        try:
            return ch.encode(charset)
        except UnicodeEncodeError:
            return None

    if text[start] > "\x7f" and not raw(text[start]):
        return None
    a = start
    while a and text[a - 1] > "\x7f" and raw(text[a - 1]):
        a -= 1
    b = start
    while b < len(text) and text[b] > "\x7f" and raw(text[b]):
        b += 1
    b = max(b, start + 1) if text[start] > "\x7f" else b
    if text[start] <= "\x7f":  # the unit begins with an ASCII letter
        a = start + 1
        b = a
        while b < len(text) and text[b] > "\x7f" and raw(text[b]):
            b += 1
    # Sound signs may stand at either side: the longest stretch that is UTF-8 counts.
    for i in range(a, min(start + 2, b)):
        for j in range(b, max(i, b - 3), -1):
            data = b"".join(raw(ch) for ch in text[i:j])
            for tail in (1, 0):
                # The last byte of a sign may have gone together with the ASCII character behind it.
                if tail and not (j < len(text) and (more := raw(text[j])) and j == b):
                    continue
                whole = data + (more if tail else b"")
                try:
                    was = whole.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if was and all(PLAUSIBLE.match(c) for c in was if c > "\x7f") and (len(was) > 1 or was.isalpha()) and was != text[i : j + tail]:
                    return i, j + tail, was
    return None


@functools.cache
def automaton():
    """Garbled two-character beginnings of UTF-8 sequences, with the charsets that give them."""
    import ahocorasick

    found: dict[str, list[tuple[str, int]]] = {}
    for charset in SINGLE:
        table = from_byte(charset)
        for unit in _utf8_units():
            size = 2 if unit[0] < 0xE0 else 3 if unit[0] < 0xF0 else 4
            found.setdefault(table[unit[0]] + table[unit[1]], []).append((charset, size))
    for charset in DOUBLE:
        for text in _double_units(charset):
            found.setdefault(text, []).append((charset, 0))
    out = ahocorasick.Automaton()
    for text, hits in found.items():
        out.add_word(text, (text, hits))
    out.make_automaton()
    return out


#: Characters at which a garbled sequence may begin; texts without any are not searched.
@functools.cache
def screen():
    firsts = {from_byte(c)[b] for c in SINGLE for b in range(0xC2, 0xF5)}
    others = set("ăĂčČŕŔůŮőŐěĚřŘďĎťňŇĺĹľĽűŰşŞţŢđĐ≤▓∑╖╗╜í") | {chr(c) for c in range(0x80, 0xA0)} | {"�"} | set(garbled_letters())
    doubles = {ch for c in DOUBLE for unit in _double_units(c) for ch in unit if ch > "\x7f"}
    return re.compile("[" + re.escape("".join(sorted(firsts | others | doubles))) + "]")


@functools.cache
def garbled_letters() -> dict[str, list[tuple[str, str, str, str]]]:
    """Garbled character to (true charset, charset used, restored character, alphabet), over all pairs."""
    out: dict[str, list[tuple[str, str, str, str]]] = {}
    for true in TRUE_SINGLE:
        for used in SINGLE:
            if true == used or {true, used} <= {"cp1252", "latin-1", "iso8859-15"}:
                continue
            back = from_byte(used)
            for name, letters in ALPHABETS.items():
                for ch in letters:
                    b = to_byte(true).get(ch)
                    if b is not None and back[b] != ch:
                        out.setdefault(back[b], []).append((true, used, ch, name))
    return out


LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
SYMBOLS = "\u0080-\u009f¢¤¥¦§¨¬¯±´¶·¸×÷ˆ˜ˇ˘˙˛˝˚‚„†‡•‰™∂∆∏∑√∞∫≈≠≤≥◊¡£©®ª«»º°μπΩ⌠⌡⌐∙∩≡─-■ΓΣΦΘδφεατσⁿ₧ƒ£¿µ"
#: A symbol between letters, or before small letters at a word's beginning, or a Greek letter among Latin ones.
IN_WORD = re.compile(f"[{LATIN}][{SYMBOLS}]+[a-zß-öø-ɏ]")
AT_START = re.compile(f"(?<![^\\s(\"'>\\[#*_-])[\u0080-\u009fŽ¢¤¦§¨¬¯´¶¸ˆ˜‡‰™∂∏∑√∞∫≈≠≤≥◊─-■ΓΣΦΘδφεατσⁿ₧ƒ][a-z]{{2,}}")
#: A capital with a mark between small letters.
CAPITAL_INSIDE = re.compile("[a-zß-öø-ÿ][À-ÖØ-ÞŠŽŒŸŚŤŹŁĽŞŻĄĆĘŃÐ][a-zß-öø-ÿ]")
#: Letters of none of the languages, signs in a bullet's or exponent's place, and an accent in English "not".
FOREIGN = re.compile("[a-zA-ZÀ-ÿ][ăĂčČŕŔůŮőŐěĚřŘďĎťňŇĺĹľĽűŰşŞţŢđĐ]|[ăĂčČŕŔůŮőŐěĚřŘďĎťňŇĺĹľĽűŰşŞţŢđĐ][a-zÀ-ÿ]|[ŔČŮ] [a-z]|m[≤▓] |(?<=[\\w)] )[∑╖╗╜▓](?= [\\w\\[])|[a-z]nít\\b")
ACCENT_RUN = re.compile("[À-ÿ]{4,}")
MIXED = re.compile("[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]")
WORD_CHARS = re.compile("[^\\s|()\\[\\]\"]+")
#: Letters of other scripts that look like Latin ones: a word mixing only these is no charset matter. Fixed values.
ALIKE = set("аеосрхуіјѕһԁԛԝАВЕКМНОРСТХУІЈЅвкмнтгпαονρκιυωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")
SYMBOL_RUN = re.compile("[\u0080-ÿ]{4,}")
SIGNS = re.compile("[\u0080-¿×÷]")
CYR_INVERTED = re.compile("(?<![Ѐ-ӿ])[а-яё][А-ЯЁ]{3,}|(?<![А-ЯЁ])[а-яё]+[А-ЯЁ][а-яё]+[А-ЯЁ]")
CYR_BOX = re.compile("[Ѐ-ӿ][─-■√≈≤≥°·ўЎїЇєЄ]+[Ѐ-ӿ]|[─-■]{2}[Ѐ-ӿ]")
BOX_RUN = re.compile("[─-■ΐ-ω⌐¬½¼¡«»░▒▓±≥≤⌠⌡÷≈°∙·√ⁿ²₧ƒªº¿ÇüéâäàåçêëèïîìÄÅÉæÆôöòûùÿÖÜ¢£¥áíóúñÑµ∞]{5,}")


class Found:
    """A text's garbled sequences: spans (start, end, restored text or None)."""

    __slots__ = ("pairs", "spans", "strong")

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, str | None]] = []
        self.pairs: Counter = Counter()
        self.strong = False


#: The more frequent of the letters, and letters and signs that restored text is likely to hold. Fixed values.
FREQUENT = set("äöüßéèàêçáíóñãõąęłżśćńабвгдежзийклмнопрстуфхцчшыьэюя" + MARKS)
LIKELY = re.compile("[" + "".join(ALPHABETS.values()) + MARKS + "\u00a0\u3000-\u30ff\u4e00-\u9fff\uff01-\uff9f]")


LONE_SIGN = re.compile(r"(?<![^\x00-\x7f])[^\x00-\x7f](?![^\x00-\x7f])")


def _utf8_spans(text: str, found: Found, declared: str | None = None) -> None:
    readings: dict[int, list[tuple[str, int, str]]] = {}
    votes: Counter = Counter()
    wide: list[tuple[int, str]] = []
    for end, (_, hits) in automaton().iter(text):
        start = end - 1
        for charset, size in hits:
            if not size:
                wide.append((start, charset))
                continue
            back = to_byte(charset)
            raw = [back.get(ch) for ch in text[start : start + size]]
            if len(raw) < size or None in raw:
                continue
            try:
                ch = bytes(raw).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if PLAUSIBLE.match(ch):
                readings.setdefault(start, []).append((charset, size, ch))
                votes[charset] += 4 if ch in FREQUENT else 3 if LIKELY.match(ch) else 1
    # One wrong reading is usual for a text: where several explain a sequence, the one that explains most counts.
    rank = {c: (-n, c != declared, SINGLE.index(c)) for c, n in votes.items()}
    last = -1
    runs: list[tuple[int, int, str, str, bool, bool]] = []
    for start in sorted(readings):
        if start < last:
            continue
        charset, size, ch = min(readings[start], key=lambda r: rank[r[0]])
        # Letters of one Cyrillic word stand in proper text too.
        beside = text[max(0, start - 1) : start] + text[start + size : start + size + 1]
        plain = (size > 2 or charset != "cp1251") and bool(CYRILLIC.fullmatch(text, start, start + size)) and not (size == 2 and re.search("[a-z]", beside) and not ALIKE.issuperset(text[start : start + 2]))
        runs.append((start, start + size, charset, ch, size == 2 and text[start + 1] in COMMON_AFTER, plain))
        last = start + size
    sure = [not r[5] for r in runs]
    for step in (1, -1):  # such a word beside a sure sequence of the same reading belongs to it
        for i in range(len(runs))[::step]:
            j = i - step
            if not sure[i] and 0 <= j < len(runs) and sure[j] and runs[j][2] == runs[i][2] and runs[min(i, j)][1] == runs[max(i, j)][0]:
                sure[i] = True
    often = Counter(r[2] for r, ok in zip(runs, sure, strict=True) if ok)
    # Look-alikes beside Latin letters, too, belong to a reading that is clear elsewhere in the text.
    runs = [r for r, ok in zip(runs, sure, strict=True) if ok or r[1] - r[0] == 2 and often[r[2]] > 1 and re.search("[a-z]", text[max(0, r[0] - 1) : r[0]] + text[r[1] : r[1] + 1])]
    for i, (start, end, charset, ch, weak, _) in enumerate(runs):
        joined = i and runs[i - 1][1] == start or i + 1 < len(runs) and runs[i + 1][0] == end
        if charset == "cp1251" and not joined and (weak or not ("Ѐ" <= ch <= "ӿ")) and text[start] in "РС":
            continue
        if weak and not joined and charset != "cp1251":
            # In capitals with a quote or dash behind: proper text unless a small letter stands before.
            before = text[start - 1] if start else " "
            if text[start] == "Ã" and before.isupper() or text[start] in "ÀÁÃÓÔÕÉÊÍÚÇÑÄÖÜß" and not before.islower() and not (before.isspace() and text[start + 1] == "\xa0") and end < len(text) and not text[end].islower():
                continue
        found.spans.append((start, end, ch))
        found.pairs["utf-8", charset] += 1
        found.strong = True
    last = -1
    taken = {a for a, *_ in found.spans}
    for start, charset in wide:
        if start < last or taken and not taken.isdisjoint(range(start - 1, start + 3)):
            continue
        span = _double_span(text, start, charset)
        if span and span[0] >= last:
            found.spans.append(span)
            found.pairs["utf-8", charset] += 1
            found.strong = True
            last = span[1]
    for charset in {c for t, c in found.pairs if t == "utf-8" and c in DOUBLE}:
        # A letter by itself, such as a French à, is one sign between blanks.
        for m in LONE_SIGN.finditer(text):
            span = _double_span(text, m.start(), charset)
            if span and span[0] == m.start() and span[1] <= m.end() + 1 and not any(a <= span[0] < b for a, b, _ in found.spans):
                found.spans.append(span)


#: What charsets of 16 bits hold: kana and their marks, Chinese signs, syllables of Korean, wide forms.
WIDE = re.compile("[\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff01-\uff9f]")
KANA = re.compile("[\u3041-\u30ff]")
#: Text of seven-bit charsets as it is read by any other, what is missing before it, and the codecs. Escape sequences of ISO-2022
#: tell by themselves; those whose escape character was lost, and those of HZ, count if they end as they should and decode.
SHIFTED = [
    (re.compile(r"\x1b(?:\$[@AB]|\$\([CD]|\(I)[!-~\x1b]*?(?:\x1b\([BJ]|(?=[^!-~\x1b]|\Z))"), "", ("iso2022_jp_ext", "iso2022_jp_2")),
    (re.compile(r"\x1b\$\)C"), "", ("iso2022_kr",)),
    (re.compile(r"\x0e(?:[!-~]{2})+\x0f"), "\x1b$)C", ("iso2022_kr",)),
    (re.compile(r"(?<!\x1b)\$B(?:[!-~]{2})+?(?:\([BJ]|(?![!-~]{2}))"), "\x1b", ("iso2022_jp",)),
    (re.compile(r"~\{(?=[!-W])(?:[!-w][!-~])+~\}"), "", ("hz",)),
]
#: A unit of UTF-7; inside longer stretches of its alphabet, such as encoded bytes, none begins.
UTF7 = re.compile(r"(?<![A-Za-z0-9+/=]{24})\+([A-Za-z0-9/][A-Za-z0-9+/]{2,})(?![A-Za-z0-9+/=])-?")


def _shifted_spans(text: str, found: Found) -> None:
    """Text of seven-bit charsets, which all others read as ASCII."""
    if "\x1b" in text or "\x0e" in text or "$B" in text or "~{" in text:
        for pattern, missing, named in SHIFTED:
            for m in pattern.finditer(text):
                if missing == "\x1b" and m[0][-2] != "(":
                    continue
                whole = f"\x1b{m[0][:-2]}\x1b{m[0][-2:]}" if missing == "\x1b" else missing + m[0]
                was, used = None, named[0]
                for codec in named:
                    try:
                        was, used = whole.encode("ascii").decode(codec), codec
                        break
                    except UnicodeDecodeError:
                        continue
                if m[0][0] != "\x1b" and not (was and all(WIDE.match(c) or len(was) > 2 and CYRILLIC.match(c) for c in was)):
                    continue
                if missing == "\x1b" and not KANA.search(was):
                    continue
                found.spans.append((*m.span(), was))
                found.pairs[used, "ascii"] += 1
    if "+" in text:
        units = []
        for m in UTF7.finditer(text):
            try:
                was = m[0].encode("ascii").decode("utf-7")
            except UnicodeDecodeError:
                continue
            if was and all(LIKELY.match(c) or c > "\uffff" and PLAUSIBLE.match(c) for c in was):
                # Three capitals may be an abbreviation after a plus, and any short word may read as Chinese signs.
                before, behind = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1] if m[0][-1] == "-" else ""
                if any(map(WIDE.match, was)) or max(was) > "\uffff":
                    sure = len(was) > 1 and bool(KANA.search(was))
                else:
                    sure = len(m[1]) > 3 or not m[1].isupper() or was in FREQUENT and before.islower() and behind.islower()
                    if not sure and before.isalnum() and not before.islower() and not behind.isalpha():
                        continue
                units.append((*m.span(), was, sure))
        if any(sure for *_, sure in units):
            found.spans.extend(u[:3] for u in units)
            found.pairs["utf-7", "ascii"] += len(units)


def _null_spans(text: str, found: Found, declared: str | None) -> None:
    """UTF-16 and UTF-32 read byte by byte: nulls between the characters, which no sound text holds."""
    back = to_byte(declared or "cp1252")
    data = [ord(c) if c < "\x80" else back.get(c, ord(c) if c < "\u0100" else -1) for c in text]
    spans: list[tuple[int, int, str, str]] = []
    for codec, size in (("utf-16-le", 2), ("utf-16-be", 2), ("utf-32-le", 4), ("utf-32-be", 4)):
        for first in range(size):
            run: list[str] = []
            gap = kana = 0  # wide signs since the last one that is sure, and the kana among them
            for at in range(first, len(data) + size, size):
                part = data[at : at + size]
                number = int.from_bytes(bytes(part), "little" if codec.endswith("le") else "big") if len(part) == size and min(part) >= 0 else 0
                ch = chr(number) if number < 0x110000 else "\0"
                if 0xD800 <= number < 0xE000 and run:
                    run.append(ch)
                    gap += gap > 0
                elif ch in "\t\n\ufeff" or run and ch in MARKS or " " <= ch <= "~" or ch < "\u0500" and PLAUSIBLE.match(ch):
                    # Sound letters in pairs look like Chinese signs: without kana a row of them before or between is no part.
                    if kana * 5 < gap and (gap > 3 or gap == len(run)):
                        spans.append((at - size * len(run), at - size * gap, "".join(run[: len(run) - gap]), codec))
                        run = []
                    run.append(ch)
                    gap = kana = 0
                elif WIDE.match(ch) or PLAUSIBLE.match(ch):
                    run.append(ch)
                    gap, kana = gap + 1, kana + bool(KANA.match(ch))
                else:
                    keep = len(run) - gap * (kana * 5 < gap)
                    spans.append((at - size * len(run), at - size * (len(run) - keep), "".join(run[:keep]), codec))
                    run, gap, kana = [], 0, 0
    taken = bytearray(len(text))
    # A reading that is off by a byte loses the blanks and line ends.
    for a, b, was, codec in sorted(spans, key=lambda s: (-len(s[2]) - 3 * len(re.findall("[ \n\ufeff]", s[2])), s[0])):
        if len(was) > 2 and "\0" in text[a:b] and not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            found.spans.append((a, b, was.lstrip("\ufeff").encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")))
            found.pairs[codec, declared or "cp1252"] += 1


def _single_byte_pair(tokens: list[str], declared: str | None = None) -> tuple[str, str, str] | None:
    """The pair and alphabet that turn most of the given words into words of one alphabet."""
    table = garbled_letters()
    votes: Counter = Counter()
    for tok in tokens:
        foreign = [ch for ch in tok if ord(ch) >= 128 and ch in table]
        if not foreign:
            continue
        options = None
        for ch in set(foreign):
            here = {(t, u, a) for t, u, _, a in table[ch]}
            options = here if options is None else options & here
        for o in options or ():
            swap = {ch: next(c for t, u, c, a in table[ch] if (t, u, a) == o) for ch in set(foreign)}
            new = "".join(swap.get(ch, ch) for ch in tok)
            votes[o] += 3 if new.islower() or new.istitle() or new.isupper() else 1
    if not votes:
        return None
    best = max(votes.values())
    rank = {c: i for i, c in enumerate(TRUE_SINGLE)}
    used = {c: i for i, c in enumerate(SINGLE)}
    return min((o for o, n in votes.items() if n == best), key=lambda o: (o[1] != declared, rank[o[0]], used[o[1]]))


def charset_named(name: str | None) -> str | None:
    """The charset among SINGLE that a stream declares, by whatever name."""
    try:
        return next((c for c in SINGLE if codecs.lookup(c).name == codecs.lookup(name.strip()).name), None) if name and name.strip() else None
    except LookupError:
        return None


def find(text: str | None, declared: str | None = None) -> Found:
    """All garbled sequences of a text; declared is the charset that its stream names."""
    found = Found()
    if not text:
        return found
    _shifted_spans(text, found)
    if "\0" in text:
        _null_spans(text, found, declared)
    found.strong = bool(found.spans)
    if text.isascii() or not screen().search(text):
        return found
    if "�" in text:
        found.strong = True
        found.pairs["lost", "lost"] += text.count("�")
    _utf8_spans(text, found, declared)
    taken = bytearray(len(text))
    for a, b, _ in found.spans:
        taken[a:b] = b"\1" * (b - a)
    suspects: list[tuple[int, int]] = []
    for pattern in (IN_WORD, AT_START, CAPITAL_INSIDE, FOREIGN, CYR_INVERTED, CYR_BOX):
        for m in pattern.finditer(text):
            if not any(taken[m.start() : m.end()]):
                suspects.append(m.span())
    for m in ACCENT_RUN.finditer(text):
        if not any(taken[m.start() : m.end()]) and not m[0].isupper():
            suspects.append(m.span())
    for m in SYMBOL_RUN.finditer(text):
        if not any(taken[m.start() : m.end()]) and len(SIGNS.findall(m[0])) >= 2 and any(c.isalpha() for c in m[0]):
            suspects.append(m.span())
    for m in BOX_RUN.finditer(text):
        if not any(taken[m.start() : m.end()]) and len(set(m[0])) > 2 and not m[0].isalpha():
            suspects.append(m.span())
    for m in MIXED.finditer(text):
        if any(taken[m.start() : m.end()]):
            continue
        a = max(text.rfind(" ", 0, m.start()), text.rfind("\n", 0, m.start())) + 1
        word = WORD_CHARS.match(text, a)
        if word and len(re.findall("[Ѐ-ӿ]", word[0])) > len(re.findall(f"[{LATIN}]", word[0])) and not re.search("[b-df-nq-wzD-GI-LNQRSU-WYZ]", word[0]):
            continue
        if word and any("Ѐ" <= ch <= "ӿ" and ch not in ALIKE for ch in word[0]) and re.search("[a-z][Ѐ-ӿ]|[Ѐ-ӿ][a-z]", word[0]):
            suspects.append(m.span())
    if suspects:
        found.strong = True
        words = []
        for a, b in suspects:
            a = max(text.rfind(" ", 0, a + 1), text.rfind("\n", 0, a + 1)) + 1
            w = WORD_CHARS.search(text, a)
            if w:
                words.append((w.start(), w.end()))
        pair = _single_byte_pair([text[a:b] for a, b in words], declared)
        if pair:
            true, used, name = pair
            found.pairs[true, used] += len(words)
            table = {g: next((c for t, u, c, n in opts if (t, u) == (true, used) and n == name), None) for g, opts in garbled_letters().items()}
            bad_lines = {text.count("\n", 0, a) for a, _ in words}
            at = 0
            for no, line in enumerate(text.split("\n")):
                if no in bad_lines:
                    # Within a line that has clear cases, its other letters of the pair are taken as garbled too.
                    for i, ch in enumerate(line):
                        if ord(ch) >= 128 and (c := table.get(ch)) and not taken[at + i]:
                            found.spans.append((at + i, at + i + 1, c))
                at += len(line) + 1
        else:
            found.spans.extend((a, b, None) for a, b in suspects)
    return found


def is_garbled(text: str | None) -> bool:
    return find(text).strong


def _whole_double(text: str) -> str | None:
    """Japanese text read as single bytes, restored run by run."""
    for true in TRUE_DOUBLE:
        def back(m, true=true):
            raw = bytes(to_byte("cp1252")[c] for c in m[0]) if all(c in to_byte("cp1252") for c in m[0]) else b""
            try:
                out = raw.decode(true)
            except UnicodeDecodeError:
                return m[0]
            return out if any("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in out) else m[0]

        new = re.sub("[\u0080-ÿŒ-˜–-™€]{2,}", back, text)
        if new != text and len(re.findall("[぀-ヿ一-鿿]", new)) > 4:
            return new
    return None


def restore(text: str | None, declared: str | None = None, rounds: int = 3) -> str | None:
    """The original text wherever it can still be had; unmatched text is left untouched."""
    for _ in range(rounds):
        if not text:
            return text
        runs = SYMBOL_RUN.findall(text)
        if sum(map(len, runs)) > 40 and (japanese := _whole_double(text)):
            return japanese
        found = find(text, declared)
        spans = sorted(s for s in found.spans if s[2] is not None)
        if not spans:
            return text
        out, at = [], 0
        for a, b, new in spans:
            if a >= at:
                out += [text[at:a], new]
                at = b
        out.append(text[at:])
        text = "".join(out)
    return text


TEXT_CONVERTERS = ("html", "csv", "plaintext")


def text_results(results):
    """All results of text streams; ASCII too may be garbled."""
    from pyspark.sql import functions as F

    return results.where(F.col("converter").isin(*TEXT_CONVERTERS))


def garbled_records(results):
    """(result_id) of the text results whose Markdown holds a garbled sequence."""
    from pyspark.sql import types as T

    from inkloom.llm.common import map_rows

    schema = T.StructType([T.StructField("result_id", results.schema["result_id"].dataType)])
    return map_rows(text_results(results).select("result_id", "markdown"), lambda: lambda key, text: [(key,)] if is_garbled(text) else [], schema)


def restored_records(results, streams):
    """(result_id, charset, pair, n_spans, markdown): affected records with the stream's charset and the restored text."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from inkloom.llm.common import map_rows

    charset = streams.groupBy("stream_id").agg(F.max("charset").alias("charset"))
    schema = T.StructType([T.StructField("result_id", T.LongType()), T.StructField("charset", T.StringType()), T.StructField("pair", T.StringType()), T.StructField("n_spans", T.IntegerType()), T.StructField("markdown", T.StringType())])

    def row(key, declared, text):
        used = charset_named(declared)
        found = find(text, used)
        if found.strong:
            pair = min(found.pairs, key=lambda p: (-found.pairs[p], p)) if found.pairs else ("", "")
            yield key, declared, " read as ".join(pair), len(found.spans), restore(text, used)

    joined = text_results(results).join(charset, "stream_id", "left").select("result_id", "charset", "markdown")
    return map_rows(joined, lambda: row, schema)
