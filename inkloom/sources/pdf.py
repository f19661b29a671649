"""PDF to Markdown: pages in order, what was lost on them as warnings, and the seam for an OCR engine."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from inkloom.model import INCOMPLETE, Options, Result, Warn, add_warnings
from inkloom.sources.markdown import Bounded
from inkloom.sources.pdftext import Page, extract

#: Texts of errors and warnings. Fixed values.
NO_TEXT = "no extractable text; the PDF may be scanned images or use unsupported fonts"
PAGE_NO_TEXT = "page produced no text"
SCANNED = PAGE_NO_TEXT + ", and paints images: it is a scan, which an OCR engine can read"
NO_IMAGES = PAGE_NO_TEXT + ", and paints no images: its text may be vector outlines, which needs a renderer rather than OCR"


class OcrRefused(Exception):
    """The OCR budget is used up; only the first refusal carries a message."""


class OcrLimit:
    """An OCR engine - a callable of (document bytes, page number) giving text - within a budget.

    max_pages, per_page and total (seconds); 0 is no bound. Safe to share between threads.
    """

    def __init__(self, engine: Callable[[bytes, int], str], max_pages: int = 0, per_page: float = 0, total: float = 0):
        self.engine, self.max_pages, self.per_page, self.total = engine, max_pages, per_page, total
        self.lock, self.used, self.told, self.began = threading.Lock(), 0, False, None

    def _refuse(self, why: str) -> None:
        first, self.told = not self.told, True
        raise OcrRefused(why if first else "")

    def __call__(self, data: bytes, page: int) -> str:
        with self.lock:
            self.began = self.began or time.monotonic()
            if self.max_pages and self.used >= self.max_pages:
                self._refuse(f"OCR page budget of {self.max_pages} is used up")
            left = self.total - (time.monotonic() - self.began) if self.total else 0
            if self.total and left <= 0:
                self._refuse(f"OCR time budget of {self.total:g} s is used up")
            self.used += 1
        most = min(x for x in (self.per_page, left) if x) if self.per_page or self.total else 0
        if not most:
            return self.engine(data, page)
        box: list = []

        def work() -> None:
            try:
                box.append((True, self.engine(data, page)))
            except Exception as e:  # handed to the caller below
                box.append((False, e))

        t = threading.Thread(target=work, daemon=True)
        t.start()
        t.join(most)
        if not box:
            raise TimeoutError(f"OCR of a page took more than {most:g} s")
        ok, value = box[0]
        if not ok:
            raise value
        return value


def selected(page: Page, options: Options) -> bool:
    """Whether OCR is to read the page: by policy textless, thin (fewer glyphs than the floor and an image) or any image."""
    textless = not page.text()
    if options.ocr_policy == "images":
        return page.image_count > 0
    if options.ocr_policy == "thin":
        return textless or page.n_glyphs < options.glyph_floor and page.image_count > 0
    return textless


def assemble(pages: list[Page], options: Options, ocr_failed: set[int], warnings: list[Warn]) -> Result:
    out = Bounded(options.max_result, "PDF result")
    for page in pages:
        text = page.text()
        if not text:
            why = None if page.number in ocr_failed else SCANNED if page.image_count else NO_IMAGES if options.ocr else None
            if why:
                add_warnings(warnings, [Warn("pdf", INCOMPLETE, f"page {page.number}", why)])
            continue
        if out.size:
            out.write("\n\n")
        if page.ocr_glyphs:
            out.write(f"<!-- {options.marker}: page {page.number} includes OCR text -->\n\n")
        out.write(text)
    if not out.text().strip():
        raise ValueError(f"{NO_TEXT}; {len(warnings)} warning(s) along the way, the first: {warnings[0].text()}" if warnings else NO_TEXT)
    return Result(out.text(), "", warnings)


def convert(data: bytes, options: Options) -> Result:
    pages = extract(data)
    warnings: list[Warn] = []
    failed: set[int] = set()
    for page in pages:
        add_warnings(warnings, [Warn("pdf", INCOMPLETE, f"page {page.number}", p) for p in page.problems])
        if options.ocr and selected(page, options):
            try:
                text = options.ocr(data, page.number)
            except Exception as e:
                failed.add(page.number)
                if str(e):
                    add_warnings(warnings, [Warn("pdf", INCOMPLETE, f"page {page.number}", f"ocr: {e}")])
                continue
            if text and text.strip():
                page.ocr_glyphs = sum(not c.isspace() for c in text)
                page.given = text.strip() if not page.text() else page.text() + "\n" + text.strip()
    return assemble(pages, options, failed, warnings)
