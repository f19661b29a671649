"""Blocks of a Markdown page: what each line is by its own form, and the page's zones around the headline."""

from __future__ import annotations

import re
from typing import NamedTuple

HEADING = re.compile(r"#{1,6}\s+(.*)")
LIST_ITEM = re.compile(r"\s*(?:[-*+•·–]|\d{1,3}[.)]|[a-zа-я][.)]|\(\d+\))\s+(.*)")
LINK = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")
TABLE_ROW = re.compile(r"\s*\|.*\|\s*$")
CHECKBOX = re.compile(r"\s*[-*] \[[ xX]\]\s")
SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’»“)\]]*$")
SENTENCE_INSIDE = re.compile(r"[.!?。！？][\"”»]?(?:\s|$)")
SITE_LINK = re.compile(r"^\[[^\]]*\]\((?:/|https?://[^/)]*/?)\)$")
#: Links inside the site: to a numbered item, or to a section.
ITEM_LINK = re.compile(r"\]\((?:https?://[^/)]*)?/\d+\)")
SECTION_LINK = re.compile(r"\]\((?:https?://[^/)]*)?/[^/\d)][^/)]*\)")
BAR = re.compile(r"\s[|·»>/•—–]\s|\s{2,}")
TAGS = re.compile(r"^(?:[\w ]{2,12}:\s*)?#?[^\s#,.]+(?:\s+[^\s#,.]+)?(?:(?:,\s*|\s+)#?[^\s#,.]+)*$")
COPYRIGHT = re.compile(r"^(?:©|\(c\)|\(C\)|&copy;|Copyright)\s", re.I)


class Line(NamedTuple):
    """A non-blank line: its number from 1, its text, its block's number and kind, the block's score and its path.

    verdict: 1 furniture, 0 body, 2 to be decided by how the line repeats over pages. path: where and of what shape
    the block is, without its words, as tags and classes would tell it.
    """

    no: int
    text: str
    block: int
    kind: str
    verdict: int
    path: str


YEAR_OR_DEGREE = re.compile(r"(?<=[©)] )\d{4}\b|\d+(?=°)")
#: A stop before a number belongs to an abbreviation.
FIRST_SENTENCE = re.compile(r".{24,}?(?:[.!?]+(?=\s+\D|\s*$)|[。！？])|.+", re.S)


def signature(line: str) -> str:
    """A line's first sentence without marks, link targets and case: what repeats from page to page."""
    line = LINK.sub(r"\1", line)
    line = YEAR_OR_DEGREE.sub("0", line.casefold())
    line = re.sub(r"[*_#>|·\[\]]+", " ", line).strip(" -+•–—\t")
    return re.sub(r"\s+", " ", FIRST_SENTENCE.match(line)[0] if line else "").strip(" :.!")


def _plain(text: str) -> str:
    return LINK.sub(r"\1", text) if "](" in text else text


def _kind(lines: list[str]) -> str:
    first = lines[0]
    if HEADING.match(first):
        return "heading"
    if first.lstrip().startswith(">"):
        return "quote"
    if "|" in first and all(TABLE_ROW.match(x) for x in lines):
        return "table"
    if CHECKBOX.match(first):
        return "checks"
    if sum(bool(LIST_ITEM.match(x)) for x in lines) * 2 > len(lines):
        return "list"
    return "text"


def _prose(lines: list[str]) -> bool:
    """Sentences of an article: long enough, ending as sentences do, not mainly links."""
    text = " ".join(lines)
    plain = _plain(text)
    size = len(plain)
    if not plain.isascii() and len(plain.encode()) > 2.2 * size:
        size *= 3  # a Chinese or Japanese sign counts as three letters
    return size >= 70 and bool(SENTENCE_END.search(plain.rstrip())) and _link_share(lines) < 0.5 and not _is_bar(plain)


def _is_bar(text: str) -> bool:
    """Items parted by bars, dots or slashes."""
    return text.count(" | ") > 1 or text.count(" · ") > 1 or text.count(" / ") > 1


def _link_share(lines: list[str]) -> float:
    """The part of the visible text that is link text."""
    text = " ".join(lines)
    if "](" not in text:
        return 0.0
    return sum(len(m[1]) for m in LINK.finditer(text)) / max(1, len(_plain(text).strip(" *+-")))


def _shape(lines: list[str], kind: str, site_words: tuple[str, ...]) -> str:
    """A block's shape: kind and level, share and targets of its links, bars, sentence ends, size."""
    text = "\n".join(lines)
    level = len(text) - len(text.lstrip("#")) if kind == "heading" else 0
    links = f"{int(3.99 * min(1.0, _link_share(lines)))}" if "](" in text else "-"
    targets = ("i" if ITEM_LINK.search(text) else "") + ("s" if SECTION_LINK.search(text) else "") + ("h" if SITE_LINK.match(lines[0]) else "")
    marks = ("b" if _is_bar(text) else "") + ("e" if SENTENCE_END.search(lines[-1].rstrip()) else "") + ("m" if SENTENCE_INSIDE.search(LINK.sub("", lines[0])) else "") + ("c" if COPYRIGHT.match(lines[0]) else "") + ("w" if _has_site(lines, site_words) else "")
    size = sum(len(text) >= n for n in (25, 60, 90, 160, 320))
    return f"{kind}{level}/{links}{targets}/{marks}/{size}/{min(len(lines), 4)}"


def page_lines(markdown: str, site_words: tuple[str, ...] = (), title: str | None = None) -> list[Line]:
    """All non-blank lines of a web page's Markdown with a verdict from form and place."""
    blocks: list[list[tuple[int, str]]] = []
    open_block: list[tuple[int, str]] = []
    for no, line in enumerate(markdown.split("\n"), 1):
        if line.strip():
            if open_block and HEADING.match(line):
                blocks.append(open_block)
                open_block = []
            open_block.append((no, line))
            if HEADING.match(line):
                blocks.append(open_block)
                open_block = []
        elif open_block:
            blocks.append(open_block)
            open_block = []
    if open_block:
        blocks.append(open_block)
    kinds = [_kind([t for _, t in b]) for b in blocks]
    texts = [[t for _, t in b] for b in blocks]
    prose = [k in ("text", "quote") and _prose(t) for k, t in zip(kinds, texts, strict=True)]

    def related(i: int) -> bool:
        """A list, bar or line that mainly links to other items or sections of the site."""
        joined = "\n".join(texts[i])
        if "](" not in joined:
            return False
        if kinds[i] == "text" and SENTENCE_INSIDE.search(LINK.sub("", joined)):
            return False  # sentences beside the link
        return (len(ITEM_LINK.findall(joined)) + len(SECTION_LINK.findall(joined))) > 0 and _link_share(texts[i]) > 0.5

    # The headline: the first heading that the article follows, else the start of its first prose.
    start = None
    want = signature(title or "")
    for i, k in enumerate(kinds):
        if k == "heading" and i + 1 < len(blocks) and not related(i + 1):
            start = i
            break
        if prose[i] and k == "text" and not _notice(texts[i], i, kinds):
            break
    if start is None:
        heads = [i for i, k in enumerate(kinds) if k == "heading"]
        same = [i for i in heads if want and signature(HEADING.match(texts[i][0])[1])[:20] in want]
        start = same[0] if same else next((i for i, p in enumerate(prose) if p), heads[0] if heads else 0)
    # The end: the last block that is body by its own form.
    last = start
    verdicts: list[int] = []
    for i, k in enumerate(kinds):
        if i < start:
            verdicts.append(1)
        elif i == start:
            verdicts.append(0)
        elif k in ("checks",) or COPYRIGHT.match(texts[i][0]):
            verdicts.append(1)
        elif related(i):
            verdicts.append(1)
        elif prose[i] or k == "quote":
            verdicts.append(0 if k == "quote" and not _has_site(texts[i], site_words) else 4)
        elif k == "heading":
            after = i + 1
            verdicts.append(1 if after < len(blocks) and (related(after) or kinds[after] == "heading") else 2)
        elif k in ("list", "table"):
            verdicts.append(2)
        else:
            verdicts.append(3)
    for i, v in enumerate(verdicts):
        if v in (0, 4) and not NOTICE.search(texts[i][0]) or v == 2 and kinds[i] in ("list", "table") and i > start:
            last = max(last, i)
    out: list[Line] = []
    for i, b in enumerate(blocks):
        v, k = verdicts[i], kinds[i]
        if v == 3:
            # Short text: a byline right below the headline, else a line of the site.
            if i == start + 1 and len(b) == 1 and len(b[0][1]) <= 60 and not _is_bar(b[0][1]) and not SITE_LINK.match(b[0][1]):
                v = 2
            elif i < last and (SENTENCE_INSIDE.search(LINK.sub("", texts[i][0])) or len(texts[i][0]) >= 90 and not _is_bar(texts[i][0])) and not _has_site(texts[i], site_words):
                v = 2
            elif i > last or _has_site(texts[i], site_words) or len(b) < 4 and not SENTENCE_END.search(texts[i][-1].rstrip()):
                v = 1
            else:
                v = 2
        elif v == 4:
            v = 2
        elif v == 2 and k == "heading" and i > last:  # a heading that no body follows
            v = 1
        zone = "before" if i < start else "head" if i == start else "next" if i == start + 1 else "in" if i <= last else "after"
        follows = "" if k != "heading" or i + 1 >= len(blocks) else "r" if related(i + 1) else "h" if kinds[i + 1] == "heading" else ""
        path = f"{zone}{follows}/{_shape(texts[i], k, site_words)}"
        for no, t in b:
            out.append(Line(no, t, i, k, v, path))
    return out


NOTICE = re.compile(r"cookie|クッキー|privacy|datenschutz|confidentialit|privacidad|prywatno|partners", re.I)


def _notice(lines: list[str], i: int, kinds: list[str]) -> bool:
    """Prose at the very top that is a notice about cookies and the like, with the article's heading still to come."""
    return bool(NOTICE.search(" ".join(lines))) and "heading" in kinds[i:]


def _has_site(lines: list[str], site_words: tuple[str, ...]) -> bool:
    if not site_words:
        return False
    low = " ".join(lines).casefold()
    return len(low) < 160 and all(w in low for w in site_words)


def headline(lines: list[Line]) -> str | None:
    """The page's own headline: the heading at the start of its body."""
    first = next((x for x in lines if x.verdict != 1), None)
    return HEADING.match(first.text)[1].strip() if first and first.kind == "heading" else None


SEPARATOR = re.compile(r"\s+(?:[-–—|·»>/•]|::)\s+|\s*[|»]\s*|:\s+")


def title_has_more(title: str | None, head: str | None, site_words: tuple[str, ...] = ()) -> bool:
    """Whether a title holds more than the headline, such as the site's name."""
    if not title or not title.strip():
        return False
    t = " ".join(title.casefold().split())
    h = " ".join(re.sub(r"[*_`]", "", _plain(head or "")).casefold().split())
    if h and t == h:
        return False
    if h and len(h) > 3 and h in t:
        rest = (t[: t.index(h)] + " " + t[t.index(h) + len(h) :]).strip()
        return bool(re.search(r"\w", rest))
    parts = SEPARATOR.split(t)
    return len(parts) > 1 and bool(site_words) and any(all(w in p for w in site_words) for p in (parts[0], parts[-1]))


def site_words_of(host: str | None) -> tuple[str, ...]:
    """The words of a site's name as its host has them; numbers and top-level parts aside."""
    if not host:
        return ()
    name = host.casefold().removeprefix("www.").split(".")[0]
    return tuple(w for w in re.split(r"[-_\d]+", name) if len(w) > 1)
