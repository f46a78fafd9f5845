"""Matching of css selectors against an element tree: compounds, the four combinators, attributes, :not, :first-child ..."""

from __future__ import annotations

import re

from sitegrove.extract.css import split_selectors, strip_dynamic
from sitegrove.extract.dom import Node

_PART = re.compile(
    r"\s*([>+~])\s*|(\s+)|\*|(?:([\w-]+|[^\x00-\x7f]+)+)|#([\w-]+)|\.((?:[\w-]|\\.)+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*([is])?\s*)?\]|:(not|is|where|matches)\(((?:[^()]|\([^()]*\))*)\)|:([\w-]+)(?:\(([^)]*)\))?"
)


class Unsupported(ValueError):
    """A selector that cannot be matched against a tree."""


def _elements(node: Node | None) -> list[Node]:
    return [c for c in node.children if not c.tag.startswith(("#", "?"))] if node is not None else []


def _attribute(value: str | None, operator: str | None, wanted: str, ignore_case: bool) -> bool:
    if value is None:
        return False
    if operator is None:
        return True
    if ignore_case:
        value, wanted = value.lower(), wanted.lower()
    return {
        "=": value == wanted, "~=": wanted in value.split(), "|=": value == wanted or value.startswith(wanted + "-"), "^=": bool(wanted) and value.startswith(wanted), "$=": bool(wanted) and value.endswith(wanted), "*=": bool(wanted) and wanted in value,
    }[operator]


def parse(selector: str) -> list[tuple[str, list[tuple]]]:
    """A complex selector as (combinator before, tests) from left to right."""
    out: list[tuple[str, list[tuple]]] = [("", [])]
    at, selector = 0, selector.strip()
    while at < len(selector):
        m = _PART.match(selector, at)
        if m is None or m.end() == at:
            raise Unsupported(selector)
        text, at = m.group(), m.end()
        if m.group(1) or m.group(2):
            out.append((m.group(1) or " ", []))
        elif text == "*":
            out[-1][1].append(("any",))
        elif m.group(4):
            out[-1][1].append(("id", m.group(4)))
        elif m.group(5):
            out[-1][1].append(("class", m.group(5).replace("\\", "")))
        elif m.group(6):
            out[-1][1].append(("attr", m.group(6).lower(), m.group(7), next((g for g in m.group(8, 9, 10) if g is not None), ""), m.group(11) == "i"))
        elif m.group(12):
            out[-1][1].append(("not" if m.group(12) == "not" else "is", [parse(s) for s in split_selectors(m.group(13))]))
        elif m.group(14):
            out[-1][1].append(("pseudo", m.group(14).lower(), m.group(15)))
        else:
            out[-1][1].append(("tag", text.lower()))
    if any(not tests for _, tests in out):
        raise Unsupported(selector)
    return out


def _nth(expression: str | None, position: int) -> bool:
    text = (expression or "").replace(" ", "").lower()
    m = re.match(r"^(?:(odd|even)|([+-]?\d+)|([+-]?\d*)n([+-]\d+)?)$", text)
    if not m:
        raise Unsupported(text)
    a, b = (2, 1 if m.group(1) == "odd" else 0) if m.group(1) else (0, int(m.group(2))) if m.group(2) else (int(m.group(3) + "1") if m.group(3) in ("", "+", "-") else int(m.group(3)), int(m.group(4) or 0))
    return position == b if a == 0 else (position - b) % a == 0 and (position - b) // a >= 0


def _test(node: Node, test: tuple) -> bool:
    kind = test[0]
    if kind == "any":
        return True
    if kind == "tag":
        return node.tag.lower() == test[1]
    if kind == "id":
        return node.get("id") == test[1]
    if kind == "class":
        return test[1] in (node.get("class") or "").split()
    if kind == "attr":
        return _attribute(node.get(test[1]), test[2], test[3], test[4])
    if kind in ("not", "is"):
        return any(_matches(node, s, len(s) - 1) for s in test[1]) != (kind == "not")
    siblings = _elements(node.parent)
    if test[1] == "root":
        return node.parent is None or node.parent.tag == "#document"
    if test[1] == "empty":
        return not any(c.tag != "#comment" for c in node.children)
    if test[1] in ("first-child", "last-child", "only-child", "nth-child", "nth-last-child"):
        i = next(k for k, s in enumerate(siblings) if s is node)
        return {"first-child": i == 0, "last-child": i == len(siblings) - 1, "only-child": len(siblings) == 1}.get(test[1], False) or (test[1] == "nth-child" and _nth(test[2], i + 1)) or (test[1] == "nth-last-child" and _nth(test[2], len(siblings) - i))
    raise Unsupported(test[1])


def _matches(node: Node, parts: list[tuple[str, list[tuple]]], i: int) -> bool:
    combinator, tests = parts[i]
    if not all(_test(node, t) for t in tests):
        return False
    if i == 0:
        return True
    if combinator in (">", " "):
        up = node.parent
        while up is not None and up.tag != "#document":
            if _matches(up, parts, i - 1):
                return True
            if combinator == ">":
                return False
            up = up.parent
        return False
    before = []
    for s in _elements(node.parent):
        if s is node:
            break
        before.append(s)
    return any(_matches(s, parts, i - 1) for s in (before[-1:] if combinator == "+" else before))


def matches(node: Node, selector: str, static: bool = True) -> bool:
    """Whether any part of a selector list matches; with `static`, pseudo classes that a page cannot show are ignored."""
    for part in split_selectors(selector):
        part = strip_dynamic(part).strip() if static else part
        try:
            parts = parse(part) if part else None
            if parts and _matches(node, parts, len(parts) - 1):
                return True
        except Unsupported:
            continue
    return False


def specificity(selector: str) -> tuple[int, int, int]:
    """Ids; classes, attributes and pseudo classes; tags."""
    a = b = c = 0
    try:
        for _, tests in parse(selector):
            for t in tests:
                if t[0] in ("not", "is"):
                    inner = max((_sum(s) for s in t[1]), default=(0, 0, 0))
                    a, b, c = a + inner[0], b + inner[1], c + inner[2]
                a, b, c = a + (t[0] == "id"), b + (t[0] in ("class", "attr", "pseudo")), c + (t[0] == "tag")
    except Unsupported:
        pass
    return a, b, c


def _sum(parts: list[tuple[str, list[tuple]]]) -> tuple[int, int, int]:
    tests = [t for _, ts in parts for t in ts]
    return sum(t[0] == "id" for t in tests), sum(t[0] in ("class", "attr", "pseudo") for t in tests), sum(t[0] == "tag" for t in tests)
