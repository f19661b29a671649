"""Schemas, codes, limits and errors shared by the converters and the DataFrame operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

S = T.StringType()

HINTS = T.StructType([T.StructField(n, S) for n in ("mime_type", "extension", "charset", "filename", "local_path", "url")])
WARNING = T.StructType([T.StructField(n, S) for n in ("converter", "code", "location", "message")])
ATTEMPT = T.StructType([T.StructField("converter", S), T.StructField("message", S)])
ERROR = T.StructType([T.StructField("code", S), T.StructField("message", S), T.StructField("attempts", T.ArrayType(ATTEMPT))])
RESULT = T.StructType([T.StructField("markdown", S), T.StructField("title", S), T.StructField("warnings", T.ArrayType(WARNING)), T.StructField("error", ERROR), T.StructField("converter", S)])

#: Priorities: lower is tried first.
SPECIFIC, ARCHIVE, GENERIC = 0, 50, 100

#: Codes of warnings and errors. Fixed values.
INCOMPLETE, SKIPPED = "incomplete", "skipped"
UNSUPPORTED_FORMAT, INPUT_TOO_LARGE, RESULT_TOO_LARGE, CONVERSION_FAILED, INTERNAL = "UNSUPPORTED_FORMAT", "INPUT_TOO_LARGE", "RESULT_TOO_LARGE", "CONVERSION_FAILED", "INTERNAL"

#: Limits. Fixed values.
MAX_WARNINGS = 256
SNIFF_BYTES = 8192
MIB = 1024 * 1024
ARCHIVE_BYTES = 64 * MIB
SUPPRESSED = "additional warnings suppressed"


class Unsupported(Exception):
    """No converter accepts the input."""


class InputTooLarge(Exception):
    """The input exceeds a size limit; no other converter is tried."""


class ResultTooLarge(Exception):
    """The result exceeds the caller's limit; no other converter is tried."""


class NestedArchive(Exception):
    """An archive inside an archive."""


class ConversionFailed(Exception):
    """Every accepting converter failed."""

    def __init__(self, attempts: list[tuple[str, str]]):
        self.attempts = attempts
        lines = [f"conversion failed after {len(attempts)} attempt(s):", *(f"  {c}: {m}" for c, m in attempts)]
        super().__init__("\n".join(lines) if attempts else "conversion failed")


@dataclass(frozen=True)
class Hints:
    """What is known of a stream; empty means unknown."""

    mime_type: str = ""
    extension: str = ""
    charset: str = ""
    filename: str = ""
    local_path: str = ""
    url: str = ""

    @classmethod
    def of(cls, row) -> Hints:
        get = (lambda n: row.get(n)) if isinstance(row, dict) else (lambda n: getattr(row, n, None))
        return cls(*[(get(n) or "") if row is not None else "" for n in HINTS.names])

    def filled_from(self, other: Hints) -> Hints:
        return Hints(*[getattr(self, n) or getattr(other, n) for n in HINTS.names])

    def matches(self, extensions: tuple[str, ...], prefixes: tuple[str, ...]) -> bool:
        mime = self.mime_type.lower()
        return self.extension.lower() in extensions or any(mime.startswith(p) for p in prefixes)

    def but(self, **changes: str) -> Hints:
        return replace(self, **changes)


@dataclass
class Warn:
    converter: str
    code: str
    location: str
    message: str

    def text(self) -> str:
        return ": ".join(x for x in (self.converter, self.location if self.converter else "", self.message) if x)


@dataclass
class Result:
    markdown: str
    title: str = ""
    warnings: list[Warn] = field(default_factory=list)
    converter: str = ""


def add_warnings(have: list[Warn], more: list[Warn]) -> list[Warn]:
    """Appends up to the bound; what would be the last one becomes the note that more were suppressed."""
    for w in more:
        if len(have) >= MAX_WARNINGS:
            break
        have.append(Warn(w.converter, INCOMPLETE, "", SUPPRESSED) if len(have) == MAX_WARNINGS - 1 else w)
    return have


@dataclass(frozen=True)
class Options:
    """keep_data_uris: whole data URIs in images; max_result: bytes of Markdown; marker: tool name in page comments."""

    keep_data_uris: bool = False
    max_result: int | None = None
    marker: str = "inkloom"
    ocr: object | None = None
    ocr_policy: str = "textless"
    ocr_min_glyphs: int = 0

    def __post_init__(self) -> None:
        if self.max_result is not None and self.max_result <= 0:
            raise ValueError("the result limit must be positive")
        if self.ocr_policy not in ("textless", "thin", "images"):
            raise ValueError(f"unknown OCR policy {self.ocr_policy!r}")
        if self.ocr_min_glyphs and self.ocr_policy != "thin":
            raise ValueError("a glyph floor needs the policy 'thin'")

    @property
    def glyph_floor(self) -> int:
        """Pages with fewer glyphs count as thin; 50 unless set."""
        return (self.ocr_min_glyphs or 50) if self.ocr_policy == "thin" else 0

    def tightened(self, limit: int) -> Options:
        return replace(self, max_result=min(limit, self.max_result or limit))
