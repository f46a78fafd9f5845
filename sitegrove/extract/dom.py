"""A small element tree over the standard library's html and expat parsers."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

#: Elements without content, and those that an element ends when it starts inside of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody", "tfoot"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "body": ("head",),
} | {t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
_SCOPES = frozenset(("table", "ul", "ol", "dl", "select", "template", "svg", "body", "html"))
_HEAD_ONLY = frozenset("base link meta noscript script style template title".split())


class Node:
    """An element, a comment (tag '#comment') or a processing instruction (tag '?name')."""

    __slots__ = ("tag", "attrs", "parent", "children", "text", "start", "open_end", "end", "in_head")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, text: str = "", start: int = 0):
        self.tag, self.attrs, self.parent, self.text, self.start, self.open_end, self.end = tag, attrs, parent, text, start, start, start
        self.children: list[Node] = []
        self.in_head = False

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def tokens(self, name: str) -> list[str]:
        return (self.attrs.get(name) or "").lower().split()

    def path(self) -> str:
        names, node = [], self
        while node is not None and node.tag != "#document":
            names.append(node.tag)
            node = node.parent
        return "/" + "/".join(reversed(names))

    def content(self) -> str:
        """All text inside, in document order."""
        return self.text + "".join(c.content() for c in self.children if not c.tag.startswith(("#comment", "?"))) if self.children else self.text

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))


class _Html(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("#document", {}, None)
        self.lines = [0]
        for line in source.splitlines(keepends=True):
            self.lines.append(self.lines[-1] + len(line))
        self.source, self.seen_body = source, False

    def _at(self) -> int:
        line, column = self.getpos()
        return min(self.lines[min(line - 1, len(self.lines) - 1)] + column, len(self.source))

    def _open(self, tag: str, attrs: list[tuple[str, str | None]], closed: bool) -> None:
        ends = _CLOSES.get(tag, ())
        node = self.top
        while ends and node.parent is not None and node.tag not in _SCOPES:
            if node.tag in ends:
                node.end = self._at()
                self.top = node.parent
                break
            node = node.parent
        pairs: dict[str, str] = {}
        for name, value in attrs:
            pairs.setdefault(name, "" if value is None else value)
        new = Node(tag, pairs, self.top, "", self._at())
        if tag not in _HEAD_ONLY and tag not in ("html", "head"):
            self.seen_body = True
        new.in_head = not self.seen_body
        self.top.children.append(new)
        new.open_end = new.end = new.start + len(self.get_starttag_text() or "")
        if tag not in VOID and not closed:
            self.top = new

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        inside_svg = tag == "svg" or any(n.tag in ("svg", "math") for n in self._up())
        self._open(tag, attrs, inside_svg or tag in VOID)

    def _up(self) -> Iterator[Node]:
        node = self.top
        while node is not None:
            yield node
            node = node.parent

    def handle_endtag(self, tag):
        for node in self._up():
            if node.tag == tag:
                at = self._at()
                for inner in self._up():
                    inner.end = at
                    if inner is node:
                        break
                close = self.source.find(">", at)
                node.end = close + 1 if close >= 0 else len(self.source)
                self.top = node.parent or self.root
                return

    def handle_data(self, data):
        self.top.children.append(Node("#text", {}, self.top, data, self._at()))

    def handle_comment(self, data):
        self.top.children.append(Node("#comment", {}, self.top, data, self._at()))

    def handle_pi(self, data):
        self.top.children.append(Node("?" + data.split(None, 1)[0].rstrip("?") if data.strip() else "?", {}, self.top, data, self._at()))


def parse_html(text: str) -> Node:
    """A tree with the end tags that markup may omit; unclosed elements end with their parent."""
    parser = _Html(text)
    try:
        parser.feed(text)
        parser.close()
    except (AssertionError, ValueError, RecursionError):
        pass
    for node in parser._up():
        node.end = len(text)
    return parser.root


def parse_xml(text: str) -> Node:
    """A tree of what expat reads up to the first error, with names as written."""
    root = top = Node("#document", {}, None)
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True

    def start(name, attrs):
        nonlocal top
        node = Node(name, dict(attrs), top)
        top.children.append(node)
        top = node

    def end(_):
        nonlocal top
        top = top.parent

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: top.children.append(Node("#text", {}, top, data))
    parser.CommentHandler = lambda data: top.children.append(Node("#comment", {}, top, data))
    parser.ProcessingInstructionHandler = lambda target, data: top.children.append(Node("?" + target, {}, top, data))
    try:
        parser.Parse(text.lstrip("﻿").encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, ValueError):
        pass
    return root
