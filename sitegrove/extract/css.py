"""Relations of Css: a scanner over rules and declarations."""

from __future__ import annotations

import re
from collections.abc import Iterator

from sitegrove.extract.edges import Edge

_SKIP = r"/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"
_PART = re.compile(rf"({_SKIP})|(url\(\s*(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[^\"'()]*)\s*\))|([{{}};])", re.S | re.I)
_URL = re.compile(r"\burl\(\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([^\"'()]*?))\s*\)", re.S | re.I)
_FILTER = re.compile(r"\bsrc=(?:'([^']*)'|\"([^\"]*)\"|([^'\",)]+))", re.I)
_FORMAT = re.compile(r"^\s*format\(\s*['\"]?([^'\")]*)['\"]?\s*\)", re.I)
_IMPORT = re.compile(r"@import\s*(?:url\(\s*(?:'([^']*)'|\"([^\"]*)\"|([^'\")]*?))\s*\)|'([^']*)'|\"([^\"]*)\")\s*(.*)$", re.S | re.I)
_COMMENT_URL = re.compile(r"[@#]\s*(sourceMappingURL|sourceURL)=\s*(\S+)")
#: Properties whose urls are images, as they are; and those that may have a vendor prefix.
IMAGE_PROPERTIES = frozenset("content cursor _cursor background background-image _background _background-image filter +filter -webkit-filter".split())
PREFIXED_IMAGE_PROPERTIES = frozenset("border-image border-image-source mask mask-image mask-image-source mask-box-image mask-box-image-source".split())


def holds_images(property_: str) -> bool:
    """Whether the urls in a property's value are images."""
    return property_ in IMAGE_PROPERTIES or re.sub(r"^-[a-z]+-", "", property_) in PREFIXED_IMAGE_PROPERTIES


def declarations(text: str) -> Iterator[tuple[str, tuple[str, ...], str]]:
    """(kind, enclosing preludes, body): comments, at-rules without block, declarations and preludes as they come."""
    stack: list[str] = []
    start = 0
    for m in _PART.finditer(text):
        if m.group(1) and m.group(1).startswith("/*"):
            yield "comment", tuple(stack), m.group(1)
            continue
        if not m.group(3):
            continue
        body = re.sub(r"/\*.*?\*/", "", text[start : m.start()], flags=re.S).strip()
        if m.group(3) == "{":
            yield "prelude", tuple(stack), body
            stack.append(body)
        elif body:
            yield ("statement" if body.startswith("@") else "declaration"), tuple(stack), body
        if m.group(3) == "}" and stack:
            stack.pop()
        start = m.end()
    rest = re.sub(r"/\*.*?\*/", "", text[start:], flags=re.S).strip()
    if rest:
        yield ("statement" if rest.startswith("@") else "declaration"), tuple(stack), rest


def url_tokens(value: str) -> list[str]:
    """The urls of a value, without quotes and backslashes."""
    return [re.sub(r"\\(.)", r"\1", next((g for g in m.groups() if g is not None), "")).strip() for m in _URL.finditer(value)]


def parse_import(rule: str) -> tuple[str, str | None] | None:
    """(url, media) of an @import rule."""
    m = _IMPORT.match(rule.strip().rstrip(";"))
    if m is None:
        return None
    url = next((g for g in m.groups()[:5] if g is not None), "")
    return url, m.group(6).strip() or None


def extract_css(text: str) -> list[Edge]:
    out: list[Edge] = []
    for kind, around, body in declarations(text):
        if kind == "comment":
            for name, url in _COMMENT_URL.findall(body[2:-2]):
                out.append(Edge("CssSourceMappingUrl", url, "SourceMap") if name == "sourceMappingURL" else Edge("CssSourceUrl", url))
        elif kind == "statement":
            parsed = parse_import(body)
            if parsed and not around:
                out.append(Edge("CssImport", parsed[0], "Css", media=parsed[1]))
        elif kind == "declaration":
            name, _, value = body.partition(":")
            name = name.strip().lower()
            if name in ("filter", "-ms-filter"):
                for i, m in enumerate(_FILTER.finditer(value)):
                    out.append(Edge("CssAlphaImageLoader", next(g for g in m.groups() if g is not None), props={"tokenNumber": str(i)}))
            if name == "behavior":
                out.extend(Edge("CssBehavior", url, "Htc") for url in url_tokens(value) if not url.startswith("#"))
            elif name == "src" and around and around[-1].lower().startswith("@font-face"):
                for i, m in enumerate(_URL.finditer(value)):
                    format_ = _FORMAT.match(value[m.end() :])
                    out.append(Edge("CssFontFaceSrc", url_tokens(m.group())[0], "Font", props={"tokenNumber": str(i)} | ({"format": format_.group(1)} if format_ else {})))
            elif holds_images(name):
                out.extend(Edge("CssImage", url, "Image", props={"tokenNumber": str(i), "propertyName": name}) for i, url in enumerate(url_tokens(value)) if not url.startswith("#"))
    return out


def count_rules(text: str) -> int:
    """Selectors of all style rules, those in at-rules included."""
    total = 0
    for kind, around, body in declarations(text):
        if kind == "prelude" and not body.startswith("@") and not any("keyframes" in a.lower() for a in around):
            total += len(split_selectors(body))
    return total


def split_selectors(selector: str) -> list[str]:
    """The parts between commas outside of brackets and strings."""
    out, depth, start, quote = [], 0, 0, ""
    for i, c in enumerate(selector):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(selector[start:i].strip())
            start = i + 1
    return [s for s in [*out, selector[start:].strip()] if s]


#: Pseudo classes that depend on the user or the state of a page, and pseudo elements.
DYNAMIC_PSEUDO = "active any checked default empty enabled focus focus-visible focus-within fullscreen hover in-range indeterminate invalid link optional out-of-range read-only read-write scope target valid visited"
PSEUDO_ELEMENTS = "after backdrop before cue first-letter first-line grammar-error marker placeholder selection slotted spelling-error"
_DYNAMIC = re.compile(rf"::?-\w+-[\w-]+|::?(?:{'|'.join(sorted([*DYNAMIC_PSEUDO.split(), *PSEUDO_ELEMENTS.split()], key=len, reverse=True))})(?![\w-])(?:\([^)]*\))?", re.I)


def strip_dynamic(selector: str) -> str:
    """A selector without the pseudo classes and elements that a static page cannot match."""
    return _DYNAMIC.sub("", selector)
