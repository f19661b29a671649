"""Media types from names and content, and the guesses by which a stream is tried."""

from __future__ import annotations

import io
import json
import mimetypes
import re
import struct
import zipfile

from inkloom.model import SNIFF_BYTES, Hints
from inkloom.sources import textenc

_OOXML = "application/vnd.openxmlformats-officedocument."
#: Extension to media type. Fixed values.
EXT_MIME = {
    ".doc": "application/msword", ".docx": _OOXML + "wordprocessingml.document", ".xlsx": _OOXML + "spreadsheetml.sheet", ".pptx": _OOXML + "presentationml.presentation",
    ".pdf": "application/pdf", ".csv": "text/csv", ".html": "text/html", ".htm": "text/html", ".txt": "text/plain", ".text": "text/plain", ".md": "text/markdown",
    ".markdown": "text/markdown", ".json": "application/json", ".jsonl": "application/json", ".xml": "text/xml", ".zip": "application/zip",
}
MIME_EXT: dict[str, str] = {}
for _ext, _mime in EXT_MIME.items():
    MIME_EXT.setdefault(_mime, _ext)
ZIP_MIMES = ("application/zip", "application/x-zip", "application/x-zip-compressed")
MIME_ALIASES = {"application/x-pdf": "application/pdf", "application/x-zip-compressed": "application/zip", "application/x-zip": "application/zip", "application/xml": "text/xml", "application/xhtml+xml": "text/html", "application/csv": "text/csv", "application/vnd.ms-word": "application/msword"}


def mime_of_extension(ext: str) -> str:
    return EXT_MIME.get(ext) or (mimetypes.guess_type("x" + ext)[0] or "")


def extension_of_mime(mime: str) -> str:
    return MIME_EXT.get(mime) or (mimetypes.guess_extension(mime) or "")


def is_text_like(mime: str) -> bool:
    m = mime.lower()
    return m.startswith(("text/", "application/xhtml")) or m in ("application/json", "application/markdown", "application/xml", "application/csv") or m.endswith(("+json", "+xml"))


def is_ooxml(mime: str) -> bool:
    return mime.startswith(_OOXML)


def is_zip(mime: str) -> bool:
    return mime.lower() in ZIP_MIMES


def sniff(data: bytes) -> tuple[str, str, tuple[str, ...]]:
    """(media type, extension, parents) by content; the parents are the more general types it also is."""
    head = data[:SNIFF_BYTES]
    if not head:
        return "text/plain", ".txt", ()
    if head.startswith(b"%PDF-"):
        return "application/pdf", ".pdf", ()
    if head.startswith(b"PK\x03\x04") or head.startswith(b"PK\x05\x06"):
        return _zip_kind(data)
    if head.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        return ("application/msword", ".doc", ("application/x-ole-storage",)) if b"W\0o\0r\0d\0D\0o\0c\0" in _ole_directory(data) else ("application/x-ole-storage", "", ())
    if b"%PDF-" in head[:1024]:
        return "application/pdf", ".pdf", ()
    for magic, mime, ext in ((b"\x89PNG\r\n\x1a\n", "image/png", ".png"), (b"\xff\xd8\xff", "image/jpeg", ".jpg"), (b"GIF8", "image/gif", ".gif"), (b"\x1f\x8b", "application/gzip", ".gz"), (b"{\\rtf", "text/rtf", ".rtf")):
        if head.startswith(magic):
            return mime, ext, ()
    if not head.startswith((b"\xff\xfe", b"\xfe\xff")) and _binary(head):
        return "application/octet-stream", "", ()
    low = head.lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if low.startswith((b"<!doctype html", b"<html", b"<head", b"<body", b"<script", b"<title", b"<table", b"<div", b"<h1", b"<p>", b"<!--")):
        return "text/html", ".html", ("text/plain",)
    if low.startswith(b"<?xml"):
        return ("text/html", ".html", ("text/plain",)) if b"<html" in low else ("text/xml", ".xml", ("text/plain",))
    if low[:1] in b"{[" and low[:1] and _json(head, len(data) > len(head)):
        return "application/json", ".json", ("text/plain",)
    return "text/plain", ".txt", ()


def _binary(head: bytes) -> bool:
    return any(b < 9 or 14 <= b < 27 or 28 <= b < 32 or b == 11 for b in head)


def _ole_directory(data: bytes) -> bytes:
    """The first directory entries of a compound file, which its header points to."""
    if len(data) < 52:
        return b""
    shift, first = struct.unpack_from("<H", data, 30)[0], struct.unpack_from("<I", data, 48)[0]
    at = (first + 1) << min(shift, 16)
    return data[at : at + 4096]


#: A piece of JSON: white space, a mark, a string, a number or a word.
JSON_PIECE = re.compile(r'[ \t\r\n]+|[{}\[\],:]|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null')


def _json(head: bytes, goes_on: bool) -> bool:
    """Whether the beginning of a text is JSON; where the text goes on, its last piece may be cut and brackets open."""
    if not goes_on:
        try:
            json.loads(head.decode("utf-8-sig"))
        except ValueError:
            return False
        return True
    text = head.decode("utf-8", "ignore").lstrip("\ufeff")
    at, open_marks, before = 0, [], ""
    while at < len(text):
        m = JSON_PIECE.match(text, at)
        if not m or m.end() == at:
            return len(text) - at < len(text) // 2 and text[at] in '"-tfn0123456789'  # the piece that the prefix cuts
        piece, at = m[0], m.end()
        if piece.isspace():
            continue
        if piece in "}]":
            if not open_marks or open_marks.pop() != {"}": "{", "]": "["}[piece] or before in (",", ":"):
                return False
        elif piece in ",:":
            if before in ("", ",", ":", "{", "["):
                return False
        else:
            if before not in ("", ",", ":", "{", "["):
                return False
            if piece in "{[":
                open_marks.append(piece)
        before = piece
    return True


def _zip_kind(data: bytes) -> tuple[str, str, tuple[str, ...]]:
    names: list[str] = []
    try:
        names = [i.filename for i in zipfile.ZipFile(io.BytesIO(data)).infolist()]
    except Exception:  # an archive that is cut short still tells its first names
        at = 0
        while len(names) < 20 and data[at : at + 4] == b"PK\x03\x04" and at + 30 <= len(data):
            size, n, extra = struct.unpack_from("<I4xHH", data, at + 18)
            names.append(data[at + 30 : at + 30 + n].decode("utf-8", "replace"))
            at += 30 + n + extra + size
    for part, ext in (("word/", ".docx"), ("xl/", ".xlsx"), ("ppt/", ".pptx")):
        if any(n.startswith(part) for n in names) and ("[Content_Types].xml" in names or "_rels/.rels" in names or len(names) > 1):
            return EXT_MIME[ext], ext, ("application/zip",)
    return "application/zip", ".zip", ()


def guesses(data: bytes, base: Hints) -> list[Hints]:
    """One or two interpretations, in the order in which they are tried."""
    ext = base.extension.lower()
    mime = base.mime_type
    if ext and not mime:
        mime = mime_of_extension(ext)
    if mime and not ext:
        ext = extension_of_mime(mime)
    hinted = base.but(extension=ext, mime_type=mime)
    found, found_ext, parents = sniff(data)
    sniffed = Hints(found, found_ext, "", base.filename, base.local_path, base.url)
    prefix = data[:SNIFF_BYTES]

    def with_charset(g: Hints) -> Hints:
        if base.charset:
            return g.but(charset=base.charset.lower())
        if not g.charset and is_text_like(g.mime_type) and prefix:
            return g.but(charset=textenc.detect(prefix))
        return g

    if is_zip(mime) and is_ooxml(found):
        return [with_charset(sniffed), with_charset(hinted)]
    plain = mime.split(";")[0].strip().lower()
    agree = (
        not mime
        or mime.lower() == found.lower()
        or plain == found
        or MIME_ALIASES.get(plain) == found
        or is_ooxml(mime) and (found == "application/zip" or "application/zip" in parents)
        or is_text_like(mime) and found.startswith("text/")
    )
    return [with_charset(hinted.filled_from(sniffed))] if agree else [with_charset(hinted), with_charset(sniffed)]
