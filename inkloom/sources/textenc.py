"""Charset detection and decoding."""

from __future__ import annotations

import codecs
import re

#: Names of charsets that stand for another. Fixed values.
ALIASES = {"cp932": "shift_jis", "ms932": "shift_jis", "ms_kanji": "shift_jis", "sjis": "shift_jis", "windows-31j": "shift_jis", "cp936": "gbk", "cp950": "big5", "cp949": "euc-kr", "cp1252": "windows-1252", "latin1": "windows-1252", "iso-8859-1": "windows-1252", "iso8859-1": "windows-1252", "utf8": "utf-8", "ascii": "utf-8", "us-ascii": "utf-8", "": "utf-8", "macintosh": "mac_roman", "ibm437": "cp437"}
#: Multi-byte charsets in the order in which ties are resolved. Fixed values.
MULTI_BYTE = ["shift_jis", "euc-jp", "euc-kr", "big5", "gbk", "gb18030"]
#: Python codecs that also know the vendor extensions of a charset.
WIDER = {"shift_jis": "cp932", "euc-kr": "cp949", "big5": "cp950", "windows-1252": "cp1252"}
CJK = re.compile("[⺀-鿿豈-﫿＀-￯]")
KANA_HANGUL = re.compile("[぀-ヿ가-힯]")
#: Very frequent signs of each language in its charset; proper text has some of them. Fixed values.
FREQUENT = {"gbk": "的一是不了在人有我他这个中大来上国文本件为到说们", "gb18030": "的一是不了在人有我他这个中大来上国文本件为到说们", "big5": "的一是不了在人有我他這個中大來上國文本件為到說們"}
BOMS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")]


def canonical(name: str) -> str:
    name = name.strip().lower()
    return ALIASES.get(name, name)


def codec(name: str) -> str | None:
    """The Python codec of a charset name, or None."""
    name = canonical(name)
    name = WIDER.get(name, name)
    try:
        return codecs.lookup(name).name
    except LookupError:
        return None


def _lenient_1252(data: bytes) -> str:
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data) if any(b in data for b in b"\x81\x8d\x8f\x90\x9d") else data.decode("cp1252")


def detect(prefix: bytes) -> str:
    """BOM, then valid UTF-8, then a multi-byte charset that decodes cleanly to CJK text, then a single-byte one."""
    for bom, name in BOMS:
        if prefix.startswith(bom):
            return name
    for cut in range(4):  # a prefix may end inside a character
        try:
            prefix[: len(prefix) - cut if len(prefix) >= 8192 else len(prefix)].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    best: tuple[float, int, str] | None = None
    for rank, name in enumerate(MULTI_BYTE):
        try:
            # The vendor's further Hangul, which nearly any pairs of bytes make, are no sign of Korean.
            text = codecs.getincrementaldecoder("euc_kr" if name == "euc-kr" else codec(name))("strict").decode(prefix, final=len(prefix) < 8192)
        except UnicodeDecodeError:
            continue
        found = len(CJK.findall(text)) + len(KANA_HANGUL.findall(text))
        if not CJK.search(text):
            continue
        runs = re.findall("[A-Za-z]?[^\x00-\x7f]+[A-Za-z]?", text)
        if 2 * sum(r[0].isascii() or r[-1].isascii() for r in runs) > len(runs):
            continue  # single signs among Latin letters: accents of a single-byte charset
        # Common signs speak for a charset; half-width kana and private signs against it.
        odd = len(re.findall("[｡-ﾟ-]", text)) + len(re.findall("[^\x00-\x7f⺀-鿿가-힯豈-﫿＀-￯　-〿]", text))
        script = len(KANA_HANGUL.findall(text))
        if name == "euc-kr" and 2 * script < len(CJK.findall(text)):
            continue  # Korean is mainly Hangul
        common = sum(map(text.count, FREQUENT.get(name, "")))
        score = (3 * common + found + 2 * len(KANA_HANGUL.findall(text)) - 3 * odd) / max(1, len(text))
        if best is None or score > best[0] + 1e-9:
            best = (score, rank, name)
    if best and best[0] > 0:
        return best[2]
    return single_byte(prefix)


#: Single-byte charsets and the letters, beyond ASCII, of languages written in them; the order resolves ties. Fixed values.
LETTERS = {
    "windows-1252": ["äöüß", "àâæçéèêëîïôœùûüÿ", "áéíñóúü", "ãáâàçéêíóôõú", "åäöøæé", "àèéìîòù"],
    "windows-1250": ["ąćęłńóśźż", "áčďéěíňóřšťúůýž", "áéíóöőúüű", "ăâîșțşţ", "čćđšž"],
    "iso-8859-2": ["ąćęłńóśźż", "áčďéěíňóřšťúůýž", "áéíóöőúüű", "ăâîşţ", "čćđšž"],
    "windows-1251": ["абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ"],
    "koi8-r": ["абвгдеёжзийклмнопрстуфхцчшщъыьэюя"],
    "iso-8859-5": ["абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїє"],
    "iso-8859-7": ["αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋ"],
}
#: Marks that speak neither for nor against a charset.
NEUTRAL = re.compile("[\u2010-\u203a\u20ac\xa0-\xbf№™]")


def single_byte(data: bytes) -> str:
    """The charset in whose reading most letters belong to one language's alphabet, small ones inside words."""
    best, name = 0.0, "windows-1252"
    for charset, alphabets in LETTERS.items():
        text = _lenient_1252(data) if charset == "windows-1252" else data.decode(codec(charset), "replace")
        high = [m for m in re.finditer("[^\x00-\x7f]", text) if not NEUTRAL.match(m[0])]
        if not high:
            continue
        for letters in alphabets:
            score = 0.0
            for m in high:
                ch, before = m[0], text[m.start() - 1 : m.start()]
                if ch.lower() not in letters:
                    score -= 1
                elif ch.islower():
                    # Cyrillic and Greek words hold no ASCII letters.
                    score += 1 if letters[0] < "\u0370" or not (before.isascii() and before.isalpha()) else -1
                else:
                    score += 0.5 if not before.islower() else -1
            score /= len(high)
            if score > best + 1e-9:
                best, name = score, charset
    return name


def decode(data: bytes, charset: str, limit: int | None = None) -> str:
    """Text of the bytes; a UTF-8 BOM is dropped, UTF-16 obeys its own. LookupError for an unknown charset."""
    from inkloom.model import ResultTooLarge

    name = canonical(charset)
    if name in ("utf-16", "utf-16le", "utf-16be"):
        order = "utf-16-be" if data[:2] == b"\xfe\xff" or name == "utf-16be" and data[:2] != b"\xff\xfe" else "utf-16-le"
        text = data[2 if data[:2] in (b"\xff\xfe", b"\xfe\xff") else 0 :].decode(order, "replace")
    elif name == "utf-8":
        text = data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    elif name == "windows-1252":
        text = _lenient_1252(data)
    else:
        found = codec(name)
        if found is None:
            raise LookupError(f"unknown charset {charset!r}")
        text = data.decode(found, "replace")
    if limit is not None and len(text.encode("utf-8", "replace")) > limit:
        raise ResultTooLarge("decoded text exceeds the size limit")
    return text


def decode_or_raw(data: bytes, charset: str) -> str:
    """As decode, but an unknown charset gives the bytes read as UTF-8."""
    try:
        return decode(data, charset)
    except LookupError:
        return data.decode("utf-8", "replace")
