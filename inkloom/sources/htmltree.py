"""A small HTML tree builder: implied end tags, misnested formatting carried on, tables kept in order."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Starting one of these ends an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements beyond which an end tag or an implied end does not reach.
SCOPE = frozenset("html table td th caption button object template body".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
#: start tag: (tags that it ends, tags that stop the search)
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
RAW = frozenset(("script", "style"))


class Node:
    """An element, or a text when its tag is empty; comments are never built."""

    __slots__ = ("attrs", "kids", "parent", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.kids: list[Node] = []
        self.parent: Node | None = None

    def add(self, kid: Node) -> Node:
        kid.parent = self
        self.kids.append(kid)
        return kid

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def content(self) -> str:
        return "".join(n.text for n in self.walk() if not n.tag)


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open: list[Node] = [self.root]
        #: Formatting elements that are still in force, outermost first; None marks a cell's beginning.
        self.active: list[Node | None] = []

    def _in_scope(self, tag: str, stops=SCOPE) -> bool:
        for n in reversed(self.open):
            if n.tag == tag:
                return True
            if n.tag in stops:
                return False
        return False

    def _pop_to(self, tag: str) -> None:
        while len(self.open) > 1:
            if self.open.pop().tag == tag:
                return

    def _reopen(self) -> None:
        """Formatting cut off by the end of a block goes on in the next one."""
        last = len(self.active)
        while last and self.active[last - 1] is not None and self.active[last - 1] not in self.open:
            last -= 1
        for i in range(last, len(self.active)):
            old = self.active[i]
            if old is None:
                continue
            new = self.open[-1].add(Node(old.tag, dict(old.attrs)))
            self.open.append(new)
            self.active[i] = new

    def handle_starttag(self, tag: str, attrs) -> None:
        values: dict[str, str] = {}
        for k, v in attrs:
            values.setdefault(k, v or "")
        if tag in ("html", "body", "head"):
            if not any(n.tag == tag for n in self.open) and not (tag == "body" and self.root.find("body")):
                if tag == "body":
                    self._pop_to("head") if self._in_scope("head", frozenset()) else None
                self.open.append(self.open[-1].add(Node(tag, values)))
            return
        if tag not in HEAD_ONLY and any(n.tag == "head" for n in self.open):
            self._pop_to("head")
        if tag in CLOSES_P and self._in_scope("p"):
            self._pop_to("p")
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            for n in reversed(self.open):
                if n.tag in ends:
                    self._leave(n)
                    break
                if n.tag in stops or n.tag in SCOPE - {"td", "th"} and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                    break
        if tag == "a":
            for n in [n for n in self.active if n is not None and n.tag == "a"]:
                self.handle_endtag("a")
                if n in self.active:
                    self.active.remove(n)
                break
        if tag in FORMATTING or tag not in CLOSES_P and tag not in IMPLIED and tag not in HEAD_ONLY and tag not in ("caption", "colgroup", "col", "table"):
            self._reopen()
        node = self.open[-1].add(Node(tag, values))
        if tag in VOID:
            return
        self.open.append(node)
        if tag in FORMATTING:
            self.active.append(node)
        elif tag in ("td", "th", "caption"):
            self.active.append(None)

    def _leave(self, node: Node) -> None:
        while len(self.open) > 1:
            n = self.open.pop()
            if n.tag in ("td", "th", "caption"):
                while self.active and self.active.pop() is not None:
                    pass
            if n is node:
                return

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in ("html", "body"):
            return
        if tag == "p" and not self._in_scope("p"):
            self.handle_starttag("p", [])
        if tag in FORMATTING:
            node = next((n for n in reversed(self.active) if n is not None and n.tag == tag), None)
            if node is None:
                return
            self.active.remove(node)
            if node in self.open and not any(n.tag in SCOPE for n in self.open[self.open.index(node) + 1 :]):
                # Blocks opened inside stay open, formatting opened inside is taken up again.
                at = self.open.index(node)
                inner = self.open[at + 1 :]
                del self.open[at:]
                blocks = [n for n in inner if n.tag not in FORMATTING]
                if blocks:
                    self.open.extend(blocks)
            return
        if tag in HEADINGS:
            top = next((n for n in reversed(self.open) if n.tag in HEADINGS or n.tag in SCOPE), None)
            if top is not None and top.tag in HEADINGS:
                self._leave(top)
            return
        node = None
        stops = frozenset(("table", "html")) if tag in IMPLIED or tag in ("table", "caption") else SCOPE
        for n in reversed(self.open):
            if n.tag == tag:
                node = n
                break
            if n.tag in stops and n.tag != tag:
                break
        if node is not None:
            self._leave(node)

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.tag in ("table", "tbody", "thead", "tfoot", "tr", "#document", "html", "head") and not data.strip():
            return
        if top.tag == "head":
            self._pop_to("head")
        if data.strip() and top.tag not in RAW and top.tag != "title":
            self._reopen()
        self.open[-1].add(Node("", text=data))


def parse(text: str) -> Node:
    builder = Builder()
    builder.feed(text)
    builder.close()
    return builder.root
