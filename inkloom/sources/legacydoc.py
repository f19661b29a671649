"""DOC: the text of a Word binary document by its piece table."""

from __future__ import annotations

import struct

from inkloom.model import ARCHIVE_BYTES, InputTooLarge, Options, Result
from inkloom.sources.markdown import Bounded

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
WORD_MAGIC, ENCRYPTED, WHICH_TABLE, COMPRESSED, ADDRESS = 0xA5EC, 0x0100, 0x0200, 0x40000000, 0x3FFFFFFF
MAX_PIECES, MAX_FIELDS, CLX_PAIR = 262_144, 1_024, 33
END_OF_CHAIN, FREE = 0xFFFFFFFE, 0xFFFFFFFF
#: Marks in the text stream and what they become; None ends nothing and shows nothing. Fixed values.
FIELD_BEGIN, FIELD_SEPARATOR, FIELD_END = "\x13", "\x14", "\x15"
MARKS = {"\r": "\n", "\n": "\n", "\x0b": "\n", "\x0e": "\n", "\x0c": "\n\n", "\x07": "\t", "\t": "\t", "\x1e": "-"}


class Compound:
    """The streams of an OLE container."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("doc: not an OLE container")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift > shift:
            raise ValueError("doc: bad sector size")
        self.size, self.mini = 1 << shift, 1 << mini_shift
        first_dir, self.cutoff = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0]
        first_mini, _, first_difat, n_difat = struct.unpack_from("<IIII", data, 60)
        difat = list(struct.unpack_from("<109I", data, 76))
        at = first_difat
        for _ in range(min(n_difat, len(data) // self.size + 1)):
            if at >= END_OF_CHAIN:
                break
            block = struct.unpack(f"<{self.size // 4}I", self._sector(at))
            difat += block[:-1]
            at = block[-1]
        self.fat: list[int] = []
        for s in difat:
            if s < END_OF_CHAIN - 2:
                self.fat += struct.unpack(f"<{self.size // 4}I", self._sector(s))
        raw = self._chain(first_mini, self.fat, self._sector) if first_mini < END_OF_CHAIN else b""
        self.mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw))
        folder = self._chain(first_dir, self.fat, self._sector)
        self.entries = {}
        root = None
        for i in range(len(folder) // 128):
            e = folder[i * 128 : i * 128 + 128]
            length, kind = struct.unpack_from("<H", e, 64)[0], e[66]
            name = e[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            start, size = struct.unpack_from("<IQ", e, 116)
            if kind == 5 and root is None:
                root = (start, size)
            elif kind == 2:
                self.entries.setdefault(name.lower(), (start, size & 0xFFFFFFFF if shift == 9 else size))
        self.mini_data = self._chain(root[0], self.fat, self._sector)[: root[1]] if root and root[0] < END_OF_CHAIN else b""

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        block = self.data[at : at + self.size]
        if not block:
            raise ValueError("doc: sector outside the file")
        return block.ljust(self.size, b"\0")

    def _chain(self, first: int, table: list[int], sector) -> bytes:
        parts, at = [], first
        while at < END_OF_CHAIN:
            if at >= len(table) or len(parts) > len(table):
                raise ValueError("doc: broken sector chain")
            parts.append(sector(at))
            at = table[at]
        return b"".join(parts)

    def stream(self, name: str) -> bytes | None:
        found = self.entries.get(name.lower())
        if found is None:
            return None
        start, size = found
        if size < self.cutoff:
            return self._chain(start, self.mini_fat, lambda n: self.mini_data[n * self.mini : (n + 1) * self.mini].ljust(self.mini, b"\0"))[:size]
        return self._chain(start, self.fat, self._sector)[:size]


def _at(fmt: str, data: bytes, at: int) -> int:
    if at < 0 or at + struct.calcsize(fmt) > len(data):
        raise ValueError("doc: structure outside its stream")
    return struct.unpack_from(fmt, data, at)[0]


def read_fib(word: bytes) -> tuple[int, int, int, int, str]:
    """(bytes that count, characters of the main text, offset and size of the CLX, table stream)."""
    if _at("<H", word, 0) != WORD_MAGIC:
        raise ValueError("doc: not a Word document")
    flags = _at("<H", word, 10)
    if flags & ENCRYPTED:
        raise ValueError("doc: encrypted documents are not supported")
    at = 32
    at += 2 + 2 * _at("<H", word, at)
    longs = at + 2
    n_longs = _at("<H", word, at)
    if n_longs < 4:
        raise ValueError("doc: too few counters")
    meaningful, main = _at("<i", word, longs), _at("<i", word, longs + 12)
    at = longs + 4 * n_longs
    if _at("<H", word, at) <= CLX_PAIR:
        raise ValueError("doc: no piece table")
    pair = at + 2 + 8 * CLX_PAIR
    if main < 0 or meaningful < 0:
        raise ValueError("doc: negative sizes")
    return meaningful, main, _at("<I", word, pair), _at("<I", word, pair + 4), "1Table" if flags & WHICH_TABLE else "0Table"


def find_pieces(clx: bytes) -> bytes:
    """The piece table behind any number of property blocks."""
    at = 0
    while at < len(clx):
        if clx[at] == 1:
            at += 3 + _at("<H", clx, at + 1)
        elif clx[at] == 2:
            size = _at("<I", clx, at + 1)
            if at + 5 + size > len(clx):
                break
            return clx[at + 5 : at + 5 + size]
        else:
            break
    raise ValueError("doc: piece table not found")


def pieces(plc: bytes, main: int) -> list[tuple[int, int, int, bool]]:
    """(first character, end, byte offset, one byte each) clipped to the main text."""
    if len(plc) < 4 or (len(plc) - 4) % 12:
        raise ValueError("doc: bad piece table size")
    n = (len(plc) - 4) // 12
    if n > MAX_PIECES:
        raise ValueError(f"doc: more than {MAX_PIECES} pieces")
    if not main:
        return []
    bounds = struct.unpack_from(f"<{n + 1}I", plc)
    if bounds[0] != 0:
        raise ValueError(f"doc: the first piece begins at character {bounds[0]}")
    if bounds[-1] < main:
        raise ValueError(f"doc: the pieces end at character {bounds[-1]}, the main text at {main}")
    out = []
    for i in range(n):
        if bounds[i] >= bounds[i + 1]:
            raise ValueError(f"doc: piece {i} has no characters")
        if bounds[i] >= main:
            break
        fc = _at("<I", plc, 4 * (n + 1) + 8 * i + 2)
        small = bool(fc & COMPRESSED)
        where = fc & ADDRESS
        if small:
            if where % 2:
                raise ValueError(f"doc: piece {i} of one-byte characters at an odd offset")
            where //= 2
        out.append((bounds[i], min(bounds[i + 1], main), where, small))
    return out


def _narrow(data: bytes) -> str:
    return "".join(bytes([b]).decode("cp1252", "ignore") if 0x80 <= b <= 0x9F else chr(b) for b in data) if any(0x80 <= b <= 0x9F for b in data) else data.decode("latin-1")


def visible(text: str) -> str:
    """Field instructions hidden and results shown, marks turned into text, other controls dropped."""
    out: list[str] = []
    fields: list[bool] = []  # whether the instruction part is open
    hidden = 0
    for ch in text:
        if ch == FIELD_BEGIN:
            if len(fields) >= MAX_FIELDS:
                raise ValueError("doc: fields nested too deeply")
            fields.append(True)
            hidden += 1
        elif ch == FIELD_SEPARATOR:
            if fields and fields[-1]:
                fields[-1] = False
                hidden -= 1
        elif ch == FIELD_END:
            if fields and fields.pop():
                hidden -= 1
        elif not hidden:
            if ch in MARKS:
                out.append(MARKS[ch])
            elif ch >= " " and ch != "\x7f":
                out.append(ch)
    return "".join(out)


def convert(data: bytes, options: Options) -> Result:
    if len(data) > ARCHIVE_BYTES:
        raise InputTooLarge(f"doc file is {len(data)} bytes; limit is {ARCHIVE_BYTES}")
    box = Compound(data)
    word = box.stream("WordDocument")
    if word is None:
        raise ValueError("doc: no WordDocument stream")
    meaningful, main, at, size, table_name = read_fib(word)
    table = box.stream(table_name)
    if table is None or at + size > len(table):
        raise ValueError("doc: piece table outside its stream")
    raw: list[bytes] = []
    for first, end, where, small in pieces(find_pieces(table[at : at + size]), main):
        n = (end - first) * (1 if small else 2)
        if where + n > min(len(word), meaningful or len(word)):
            raise ValueError("doc: piece outside the document")
        part = word[where : where + n]
        raw.append(_narrow(part).encode("utf-16-le", "surrogatepass") if small else part)
    # Surrogates may be parted by a piece's end, so all pieces are decoded together.
    text = b"".join(raw).decode("utf-16-le", "replace")
    out = Bounded(options.max_result, "DOC result")
    out.write(visible(text))
    return Result(out.text())
