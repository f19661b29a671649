"""Fixtures made in code: office archives, a Word binary document, PDFs."""

from inkloom.plans.samples import archive, compound, doc, docx, form_pdf, para, pdf, pptx, shape, xlsx  # noqa: F401
