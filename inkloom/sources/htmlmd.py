"""HTML to Markdown: what is hidden or unsafe goes, the rest is rendered as CommonMark with tables."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from inkloom.sources.htmltree import HEADINGS, Node, parse

DROPPED = frozenset(("script", "style", "template", "noscript", "svg"))
SAFE_SCHEMES = ("", "http", "https", "file", "mailto")
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 h7 h8 h9 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul #document".split())
STRONG, EMPHASIS, STRUCK, CODE = frozenset(("strong", "b")), frozenset(("em", "i")), frozenset(("del", "s", "strike")), frozenset(("code", "kbd", "samp", "tt", "var"))
SPACE = re.compile(r"[ \t\n\r\f]+")
DEEP_HEADING = re.compile(r"h([1-9])$")


def _hidden(n: Node) -> bool:
    return n.tag in DROPPED or "hidden" in n.attrs or n.attrs.get("aria-hidden", "").strip().lower() == "true"


def _safe(href: str) -> bool:
    if not href.strip():
        return True
    try:
        return urlsplit(href.strip()).scheme.lower() in SAFE_SCHEMES
    except ValueError:
        return False


def sanitize(root: Node, keep_data_uris: bool) -> str:
    """Drops and rewrites nodes in place; returns the title, the first that is not empty."""
    title = ""

    def clean(parent: Node) -> None:
        nonlocal title
        i = 0
        while i < len(parent.kids):
            n = parent.kids[i]
            if n.tag == "title" and not title:
                title = " ".join(n.content().split())
            if n.tag and _hidden(n):
                del parent.kids[i]
                continue
            if n.tag == "a" and "href" in n.attrs and not _safe(n.attrs["href"]):
                # The children take the link's place and are not visited: known behaviour that is kept.
                for k in n.kids:
                    k.parent = parent
                parent.kids[i : i + 1] = n.kids
                i += len(n.kids)
                continue
            if n.tag == "img" and not keep_data_uris:
                src = n.attrs.get("src", "")
                if src.startswith("data:") and "," in src:
                    n.attrs["src"] = src.split(",", 1)[0] + ",..."
            clean(n)
            i += 1

    clean(root)
    return title


def _escape(text: str) -> str:
    """Characters that would be read as Markdown, in running text."""
    text = re.sub(r"([\\`*\[\]])", r"\\\1", text)
    text = re.sub(r"(?<![^\W_])_|_(?![^\W_])", r"\\_", text)
    return re.sub(r"<(?=[a-zA-Z/!?])", r"\\<", text)


def _block_start(text: str) -> str:
    """A paragraph that would begin as another block is escaped."""
    text = re.sub(r"^(#{1,6})(?=\s|$)", r"\\\1", text)
    text = re.sub(r"^([-+>])(?=\s|$)", r"\\\1", text)
    return re.sub(r"^(\d{1,9})([.)])(?=\s|$)", r"\1\\\2", text)


def _wrap(mark: str, text: str) -> str:
    core = text.strip()
    if not core:
        return text
    lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    return f"{lead}{mark}{core}{mark}{tail}"


class Renderer:
    def inline(self, nodes: list[Node], bold: bool = False, slanted: bool = False) -> str:
        out: list[str] = []
        for n in nodes:
            if not n.tag:
                out.append(_escape(SPACE.sub(" ", n.text)))
            elif n.tag == "br":
                out.append("  \n")
            elif n.tag in STRONG:
                inner = self.inline(n.kids, True, slanted)
                out.append(inner if bold else _wrap("**", inner))
            elif n.tag in EMPHASIS:
                inner = self.inline(n.kids, bold, True)
                out.append(inner if slanted else _wrap("*", inner))
            elif n.tag in STRUCK:
                out.append(_wrap("~~", self.inline(n.kids, bold, slanted)))
            elif n.tag in CODE:
                out.append(self.code_span(n.content()))
            elif n.tag == "a":
                out.append(self.link(n, bold, slanted))
            elif n.tag == "img":
                out.append(self.image(n))
            elif n.tag == "input" and n.attrs.get("type") == "checkbox":
                out.append("[x] " if "checked" in n.attrs else "[ ] ")
            elif n.tag in BLOCKS:
                out.append(" " + self.inline(n.kids, bold, slanted) + " ")
            elif n.tag not in ("title", "head", "meta", "link", "base"):
                out.append(self.inline(n.kids, bold, slanted))
        # One blank between words, none about line breaks.
        text = re.sub(r"[ \t]{2,}(?!\n)", " ", "".join(out))
        return re.sub(r"\n[ \t]+", "\n", text)

    def code_span(self, text: str) -> str:
        text = text.replace("\n", " ")
        if not text.strip():
            return ""
        fence = "`" * (max(map(len, re.findall("`+", text)), default=0) + 1)
        pad = " " if text.startswith("`") or text.endswith("`") else ""
        return f"{fence}{pad}{text}{pad}{fence}"

    def link(self, n: Node, bold: bool, slanted: bool) -> str:
        inner = self.inline(n.kids, bold, slanted)
        href = n.attrs.get("href", "").strip()
        text = " ".join(inner.split())
        if not text:
            return inner
        if "href" not in n.attrs:
            return inner
        title = n.attrs.get("title", "").strip()
        target = re.sub(r"[ \n]", "%20", href).replace("(", "\\(").replace(")", "\\)")
        lead, tail = " " * inner[:1].isspace(), " " * inner[-1:].isspace()
        quoted = ' "' + title.replace('"', '\\"') + '"' if title else ""
        return f"{lead}[{text}]({target}{quoted}){tail}"

    def image(self, n: Node) -> str:
        src = n.attrs.get("src", "").strip()
        if not src:
            return ""
        alt = " ".join(n.attrs.get("alt", "").split()).replace("[", "\\[").replace("]", "\\]")
        title = n.attrs.get("title", "").strip()
        return f"![{alt}]({src}" + (f' "{title}"' if title else "") + ")"

    def blocks(self, n: Node) -> list[str]:
        """The rendered blocks of a node's children."""
        out: list[str] = []
        run: list[Node] = []

        def flush() -> None:
            if run:
                text = self.inline(run).strip()
                if text:
                    out.append(_block_start(text))
                run.clear()

        for k in n.kids:
            if k.tag in BLOCKS:
                flush()
                out.extend(self.block(k))
            elif k.tag and k.tag not in ("title", "head") and any(d.tag in BLOCKS for d in k.walk() if d is not k):
                flush()
                out.extend(self.blocks(k))
            else:
                run.append(k)
        flush()
        return out

    def block(self, n: Node) -> list[str]:
        tag = n.tag
        deep = DEEP_HEADING.match(tag)
        if tag in HEADINGS or deep:
            text = " ".join(self.inline(n.kids).split())
            return [f"{'#' * int(deep[1])} {text}"] if text else []
        if tag == "hr":
            return ["* * *"]
        if tag == "pre":
            return self.fenced(n)
        if tag == "blockquote":
            inner = "\n\n".join(self.blocks(n))
            return ["\n".join(f"> {x}" if x else ">" for x in inner.split("\n"))] if inner else []
        if tag in ("ul", "ol", "menu", "dir"):
            text = self.list(n)
            return [text] if text else []
        if tag == "table":
            return self.table(n)
        if tag == "dl":
            return [b for k in n.kids for b in (self.blocks(k) if k.tag else [])]
        return self.blocks(n)

    def fenced(self, n: Node) -> list[str]:
        text = n.content().removeprefix("\n").rstrip("\n")
        if not text.strip():
            return []
        code = n.find("code")
        lang = next((c.split("-", 1)[1] for c in (code.attrs.get("class", "") if code else "").split() if c.startswith(("language-", "lang-"))), "")
        fence = "`" * max(3, max(map(len, re.findall("`+", text)), default=0) + 1)
        return [f"{fence}{lang}\n{text}\n{fence}"]

    def list(self, n: Node) -> str:
        ordered = n.tag == "ol"
        number = int(n.attrs["start"]) if n.attrs.get("start", "").lstrip("-").isdigit() else 1
        items: list[list[str]] = []
        for k in n.kids:
            if k.tag == "li":
                items.append(self.blocks(k))
            elif k.tag in ("ul", "ol"):
                (items[-1] if items else items.append([]) or items[-1]).append(self.list(k))
        loose = any(sum(not re.match(r"(?:[-*+]|\d+\.) ", b) for b in item) > 1 for item in items)
        out = []
        for item in items:
            mark = f"{number}. " if ordered else "- "
            number += 1
            body = "\n\n".join(item)
            lines = body.split("\n")
            pad = " " * len(mark)
            out.append(mark + "\n".join([lines[0], *(pad + x if x else "" for x in lines[1:])]))
        return ("\n\n" if loose else "\n").join(out)

    def table(self, n: Node) -> list[str]:
        rows: list[list[str]] = []
        for tr in n.walk():
            if tr.tag == "tr" and self._owner(tr) is n:
                row: list[str] = []
                for c in tr.kids:
                    if c.tag in ("td", "th"):
                        text = "<br />".join(" ".join(x.split()) for x in self.cell(c).split("\n") if x.strip())
                        row.append(text.replace("|", "\\|"))
                        span = c.attrs.get("colspan", "")
                        row.extend([""] * (min(int(span), 1000) - 1 if span.isdigit() and int(span) > 1 else 0))
                if row:
                    rows.append(row)
        before = [b for k in n.kids if k.tag == "caption" for b in self.blocks(k)]
        if not rows or not any(any(c for c in r) for r in rows):
            return before
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        sizes = [max(1, *(len(r[i]) for r in rows)) for i in range(width)]
        lines = ["| " + " | ".join(c.ljust(s) for c, s in zip(r, sizes, strict=True)) + " |" for r in rows]
        lines.insert(1, "|" + "|".join("-" * (s + 2) for s in sizes) + "|")
        return [*before, "\n".join(lines)]

    def _owner(self, tr: Node) -> Node | None:
        p = tr.parent
        while p is not None and p.tag != "table":
            p = p.parent
        return p

    def cell(self, c: Node) -> str:
        blocks = self.blocks(c)
        return "\n".join(b.replace("  \n", "\n") for b in blocks)


def convert(text: str, keep_data_uris: bool = False) -> tuple[str, str]:
    """(Markdown, title) of an HTML text."""
    root = parse(text)
    title = sanitize(root, keep_data_uris)
    body = root.find("body") or root
    return "\n\n".join(Renderer().blocks(body)), title
