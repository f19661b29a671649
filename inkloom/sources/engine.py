"""The attempt chain for one document: guesses by registrations, the first success counts."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from dataclasses import dataclass

from inkloom import model
from inkloom.model import ARCHIVE, ARCHIVE_BYTES, GENERIC, SPECIFIC, ConversionFailed, Hints, InputTooLarge, NestedArchive, Options, Result, ResultTooLarge, Unsupported
from inkloom.sources import archive, delimited, docx, htmlmd, legacydoc, pdf, pptx, sniff, textenc, xlsx
from inkloom.sources.markdown import normalize

_OOXML = "application/vnd.openxmlformats-officedocument."


@dataclass(frozen=True)
class Converter:
    """A format: its name, what it accepts, and convert(data, hints, options), which may return None to decline."""

    name: str
    convert: Callable[[bytes, Hints, Options], Result | None]
    extensions: tuple[str, ...] = ()
    mime_prefixes: tuple[str, ...] = ()
    input_limit: int | None = None
    is_fallback: bool = False
    accepts: Callable[[Hints], bool] | None = None
    #: Whether convert also gets the engine, for parts that are documents themselves, and whether it is inside an archive.
    wants_engine: bool = False

    def takes(self, hints: Hints) -> bool:
        return self.accepts(hints) if self.accepts else hints.matches(self.extensions, self.mime_prefixes)


def _html(data: bytes, hints: Hints, options: Options) -> Result:
    import re

    charset = hints.charset
    if not charset or textenc.codec(charset) is None:
        m = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", data[:1024], re.I)
        declared = m[1].decode("ascii") if m else ""
        charset = declared if declared and textenc.codec(declared) else textenc.detect(data[: model.SNIFF_BYTES])
    markdown, title = htmlmd.convert(textenc.decode(data, charset), options.keep_data_uris)
    return Result(markdown, title)


def _plain(data: bytes, hints: Hints, options: Options) -> Result:
    try:
        return Result(textenc.decode(data, hints.charset, options.max_result))
    except LookupError:
        return Result(data.decode("utf-8", "replace"))


PLAIN_EXTENSIONS = (".txt", ".text", ".md", ".markdown", ".json", ".jsonl")
PLAIN_PREFIXES = ("text/", "application/json", "application/markdown")


def _plain_takes(hints: Hints) -> bool:
    return bool(hints.charset) or hints.matches(PLAIN_EXTENSIONS, PLAIN_PREFIXES)


PLAIN_TEXT = Converter("plaintext", _plain, PLAIN_EXTENSIONS, PLAIN_PREFIXES, is_fallback=True, accepts=_plain_takes)


class Engine:
    """A registry of converters. Lower priority is tried first; among equals the one registered last."""

    def __init__(self, with_builtins: bool = True):
        self.registered: list[tuple[int, int, Converter]] = []
        if with_builtins:
            self.register(PLAIN_TEXT, GENERIC)

    def register(self, converter: Converter, priority: int) -> Engine:
        self.registered.append((priority, -len(self.registered), converter))
        return self

    def ordered(self) -> list[Converter]:
        return [c for *_, c in sorted(self.registered, key=lambda r: r[:2])]

    def can_convert(self, hints: Hints) -> bool:
        """By hints alone; the plain-text fallback does not count."""
        hints = _with_extension(hints)
        return any(not c.is_fallback and c.takes(hints) for c in self.ordered())

    def input_limit(self, guesses: list[Hints]) -> int | None:
        """The smallest limit of the converters that accept any of the guesses."""
        return min((c.input_limit for c in self.ordered() if c.input_limit and any(c.takes(g) for g in guesses)), default=None)

    def convert(self, data: bytes, hints: Hints, options: Options | None = None, inside_archive: bool = False) -> Result:
        options = options or Options()
        attempts: list[tuple[str, str]] = []
        for guess in sniff.guesses(data, hints):
            for c in self.ordered():
                if not c.takes(guess):
                    continue
                try:
                    if c.input_limit and len(data) > c.input_limit:
                        raise InputTooLarge(f"{c.name}: input is {len(data)} bytes; limit is {c.input_limit}")
                    found = c.convert(data, guess, options, self, inside_archive) if c.wants_engine else c.convert(data, guess, options)
                    if found is None:
                        continue
                    _check(found.markdown, options)
                    found.markdown = normalize(found.markdown)
                    _check(found.markdown, options)
                except (InputTooLarge, ResultTooLarge):
                    raise
                except NestedArchive as e:
                    if inside_archive:
                        raise
                    attempts.append((c.name, str(e)))
                except Exception as e:  # any failure of a converter gives the next one its turn
                    attempts.append((c.name, str(e) or type(e).__name__))
                else:
                    found.converter = c.name
                    return found
        if attempts:
            raise ConversionFailed(attempts)
        raise Unsupported("unsupported format")

    def convert_file(self, path: str, options: Options | None = None) -> Result:
        base = os.path.basename(path)
        with open(path, "rb") as f:
            data = f.read()
        return self.convert(data, Hints(extension=os.path.splitext(base)[1].lower(), filename=base, local_path=os.path.abspath(path)), options)


def _with_extension(hints: Hints) -> Hints:
    ext = hints.extension.lower() or os.path.splitext(hints.filename)[1].lower()
    mime = hints.mime_type or sniff.mime_of_extension(ext)
    return hints.but(extension=ext or sniff.extension_of_mime(mime), mime_type=mime)


def _check(markdown: str, options: Options) -> None:
    if options.max_result is not None and (n := len(markdown.encode("utf-8", "replace"))) > options.max_result:
        raise ResultTooLarge(f"result is {n} bytes; limit is {options.max_result}")


def _simple(fn):
    return lambda data, hints, options: fn(data, options)


#: The formats in the order of their registration, with priorities. Fixed values.
FORMATS: list[tuple[Converter, int]] = [
    (Converter("html", _html, (".html", ".htm", ".xhtml"), ("text/html", "application/xhtml")), GENERIC),
    (Converter("csv", lambda d, h, o: delimited.convert(d, h, o), (".csv",), ("text/csv", "application/csv")), SPECIFIC),
    (Converter("xlsx", _simple(xlsx.convert), (".xlsx", ".xlsm"), (_OOXML + "spreadsheetml",), ARCHIVE_BYTES), SPECIFIC),
    (Converter("pdf", _simple(pdf.convert), (".pdf",), ("application/pdf", "application/x-pdf")), SPECIFIC),
    (Converter("pptx", _simple(pptx.convert), (".pptx",), (_OOXML + "presentationml",), ARCHIVE_BYTES), SPECIFIC),
    (Converter("doc", _simple(legacydoc.convert), (".doc",), ("application/msword", "application/vnd.ms-word", "application/x-ole-storage"), ARCHIVE_BYTES), SPECIFIC),
    (Converter("docx", _simple(docx.convert), (".docx",), (_OOXML + "wordprocessingml",), ARCHIVE_BYTES), SPECIFIC),
    (Converter("zip", lambda d, h, o, engine, inside: archive.convert(d, o, engine, inside), (".zip",), sniff.ZIP_MIMES, ARCHIVE_BYTES, wants_engine=True), ARCHIVE),
]


@functools.cache
def default_engine() -> Engine:
    """All formats; built once per process."""
    engine = Engine()
    for converter, priority in FORMATS:
        engine.register(converter, priority)
    return engine


def error_code(error: Exception) -> str:
    if isinstance(error, Unsupported):
        return model.UNSUPPORTED_FORMAT
    if isinstance(error, InputTooLarge):
        return model.INPUT_TOO_LARGE
    if isinstance(error, ResultTooLarge):
        return model.RESULT_TOO_LARGE
    return model.CONVERSION_FAILED if isinstance(error, ConversionFailed) else model.INTERNAL
