"""Hints, media types and guesses as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.sources import textenc
from inkloom.sources.sniff import EXT_MIME, MIME_EXT, ZIP_MIMES


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def filled(*values: Column | str) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(F.col(v) if isinstance(v, str) else v, F.lit("")) for v in values], F.lit(""))


def extension_of(filename: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(filename) if isinstance(filename, str) else filename, F.lit("")), r"(\.[^./]*)$", 1))


def mime_of_extension(ext: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_map(EXT_MIME), F.lower(F.col(ext) if isinstance(ext, str) else ext)), F.lit(""))


def extension_of_mime(mime: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_map(MIME_EXT), F.lower(F.col(mime) if isinstance(mime, str) else mime)), F.lit(""))


def text_like(mime: Column | str) -> Column:
    m = F.lower(F.col(mime) if isinstance(mime, str) else mime)
    return m.startswith("text/") | m.startswith("application/xhtml") | m.isin("application/json", "application/markdown", "application/xml", "application/csv") | m.endswith("+json") | m.endswith("+xml")


def ooxml(mime: Column | str) -> Column:
    return (F.col(mime) if isinstance(mime, str) else mime).startswith("application/vnd.openxmlformats-officedocument.")


def zip_type(mime: Column | str) -> Column:
    return F.lower(F.col(mime) if isinstance(mime, str) else mime).isin(*ZIP_MIMES)


def canonical_charset(charset: Column | str) -> Column:
    """A charset's usual name; unknown names pass through in small letters, null and '' are utf-8."""
    c = F.lower(F.trim(F.coalesce(F.col(charset) if isinstance(charset, str) else charset, F.lit(""))))
    return F.coalesce(F.try_element_at(_map(textenc.ALIASES), c), c)


def accepts(mime: Column | str, ext: Column | str, extensions: Column, prefixes: Column) -> Column:
    """The extension is listed, or the media type begins with a listed prefix; capitals make no difference."""
    m = F.lower(F.coalesce(F.col(mime) if isinstance(mime, str) else mime, F.lit("")))
    e = F.lower(F.coalesce(F.col(ext) if isinstance(ext, str) else ext, F.lit("")))
    return F.array_contains(extensions, e) | F.exists(prefixes, lambda p: F.startswith(m, p))


def safe_link(href: Column | str) -> Column:
    """Empty and relative links and those of http, https, file and mailto."""
    h = F.trim(F.coalesce(F.col(href) if isinstance(href, str) else href, F.lit("")))
    scheme = F.lower(F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return scheme.isin("", "http", "https", "file", "mailto")
