"""Office archives: guarded opening, guarded part reads, XML trees without namespaces."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
import zlib
from xml.etree import ElementTree as ET

from inkloom.model import ARCHIVE_BYTES, MIB, InputTooLarge

#: Limits of an Office archive. Fixed values.
MAX_ENTRIES, PART_BYTES, TOTAL_BYTES = 1024, 16 * MIB, 128 * MIB
MAX_ELEMENTS, MAX_ATTRIBUTES, MAX_DEPTH = 500_000, 1_000_000, 256
ENCRYPTED = 0x1


class TooComplex(ValueError):
    """XML beyond the limits of elements, attributes or depth."""


class TooManyEntries(ValueError):
    def __init__(self, count: int, limit: int):
        self.count, self.limit = count, limit
        super().__init__(f"archive contains {count} entries; limit is {limit}")


def preflight(data: bytes, limit: int = MAX_ENTRIES) -> int:
    """Counts the real directory headers before anything is built from them; the advertised count alone is not trusted."""
    at = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    if at < 0:
        raise ValueError("not a zip archive: no end of central directory")
    count, size, offset = struct.unpack_from("<HII", data, at + 10)
    if (count == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF) and at >= 20 and data[at - 20 : at - 16] == b"PK\x06\x07":
        where = struct.unpack_from("<Q", data, at - 12)[0]
        if data[where : where + 4] != b"PK\x06\x06":
            raise ValueError("not a zip archive: broken ZIP64 directory")
        count, size, offset = struct.unpack_from("<QQQ", data, where + 32)
        end = where
    else:
        end = at
    if count > limit:
        raise TooManyEntries(count, limit)
    # Data before the archive shifts all offsets alike.
    start = end - size if 0 <= end - size and data[end - size : end - size + 4] == b"PK\x01\x02" else offset
    seen = 0
    while start + 46 <= len(data) and data[start : start + 4] == b"PK\x01\x02":
        seen += 1
        if seen > limit:
            raise TooManyEntries(seen, limit)
        name, extra, comment = struct.unpack_from("<HHH", data, start + 28)
        start += 46 + name + extra + comment
    return seen


def read_bounded(archive: zipfile.ZipFile, info: zipfile.ZipInfo, most: int) -> bytes:
    """A member's bytes, not more than most and one; what its header claims is not trusted."""
    with archive.open(info) as f:
        return f.read(most + 1)


class Package:
    def __init__(self, data: bytes, what: str):
        if len(data) > ARCHIVE_BYTES:
            raise InputTooLarge(f"{what} archive is {len(data)} bytes; limit is {ARCHIVE_BYTES}")
        preflight(data)
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ValueError(f"{what}: not a zip archive: {e}") from e
        infos = self.zip.infolist()
        if len(infos) > MAX_ENTRIES:
            raise TooManyEntries(len(infos), MAX_ENTRIES)
        total = 0
        for i in infos:
            if i.flag_bits & ENCRYPTED:
                raise ValueError("encrypted archives are not supported")
            if i.file_size > PART_BYTES:
                raise ValueError(f"part {i.filename!r} exceeds {PART_BYTES} bytes")
            total += i.file_size
        if total > TOTAL_BYTES:
            raise ValueError(f"parts exceed {TOTAL_BYTES} bytes")
        self.first = {}
        for i in infos:
            self.first.setdefault(i.filename.replace("\\", "/"), i)
        self.used = 0

    def read(self, name: str) -> bytes | None:
        """A part's bytes, None if there is none; all reads together stay below the total."""
        info = self.first.get(posixpath.normpath(name).lstrip("/"))
        if info is None:
            return None
        try:
            data = read_bounded(self.zip, info, min(PART_BYTES, TOTAL_BYTES - self.used))
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as e:
            raise ValueError(f"part {name!r}: {e}") from e
        self.used += len(data)
        if len(data) > PART_BYTES or self.used > TOTAL_BYTES:
            raise ValueError(f"part {name!r} exceeds the decompression limit")
        return data


class Element:
    """An XML element by local names only."""

    __slots__ = ("attrs", "kids", "name", "text")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.text = name, attrs, ""
        self.kids: list[Element] = []

    def child(self, name: str) -> Element | None:
        return next((k for k in self.kids if k.name == name), None)

    def path(self, *names: str) -> Element | None:
        at: Element | None = self
        for n in names:
            at = at.child(n) if at is not None else None
        return at

    def all(self, name: str) -> list[Element]:
        return [k for k in self.kids if k.name == name]

    def attr(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))

    def runs(self) -> str:
        return "".join(n.text for n in self.walk() if n.name == "t")


def local(name: str) -> str:
    return name.rpartition("}")[2]


def tree(data: bytes) -> Element:
    """The element tree; ValueError when malformed, TooComplex beyond the limits."""
    root: Element | None = None
    stack: list[Element] = []
    elements = attributes = 0
    parser = ET.XMLPullParser(("start", "end"))
    try:
        for at in range(0, len(data), 65_536):
            parser.feed(data[at : at + 65_536])
            for kind, e in parser.read_events():
                if kind == "start":
                    elements += 1
                    attributes += len(e.attrib)
                    if elements > MAX_ELEMENTS or attributes > MAX_ATTRIBUTES or len(stack) >= MAX_DEPTH:
                        raise TooComplex("XML exceeds the complexity limits")
                    new = Element(local(e.tag), {local(k): v for k, v in sorted(e.attrib.items(), key=lambda kv: kv[0][:1] == "{")})  # of equal local names the one with a namespace counts
                    if stack:
                        stack[-1].kids.append(new)
                    else:
                        root = new
                    stack.append(new)
                else:
                    stack.pop().text = e.text or ""
                    e.clear()
        parser.close()
    except ET.ParseError as e:
        raise ValueError(f"malformed XML: {e}") from e
    if root is None:
        raise ValueError("malformed XML: no element")
    return root


def target(base: str, ref: str) -> str:
    """A relationship's target seen from the part's folder."""
    return ref[1:] if ref.startswith("/") else posixpath.normpath(posixpath.join(base, ref))


def rels_of(part: str) -> str:
    return posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
