"""Relations of JavaScript, by patterns over tokens."""

from __future__ import annotations

import re

from sitegrove.extract.edges import Edge

_TOKEN = re.compile(
    r"(?P<comment>/\*.*?\*/|//[^\n\r\u2028\u2029]*)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<template>`(?:[^`\\]|\\.)*`)|(?P<name>[\w$]+)|(?P<space>\s+)|(?P<slash>/)|(?P<mark>[^\s\w$])", re.S
)
_REGEX = re.compile(r"/(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[\w$]*")
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
_COMMENT_URL = re.compile(r"[@#]\s*(sourceMappingURL|sourceURL)=\s*(\S+)")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}


def string_value(literal: str) -> str:
    """The value of a string literal."""
    return _ESCAPE.sub(lambda m: chr(min(int(m.group(1) or m.group(2) or m.group(3), 16), 0x10FFFF)) if m.group(4) is None else _PLAIN.get(m.group(4), m.group(4)), literal[1:-1])


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, value) without white space."""
    return [t for t in all_tokens(text) if t[0] != "space"]


def all_tokens(text: str) -> list[tuple[str, str]]:
    """(kind, value) of the whole text; regular expressions are told from division by the token before."""
    out: list[tuple[str, str]] = []
    at = 0
    last: tuple[str, str] = ("mark", ";")
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, value = m.lastgroup, m.group()
        if kind == "slash":
            operand = last[0] in ("string", "template") or (last[0] == "name" and last[1] not in _BEFORE_REGEX) or last[1] in (")", "]", "}")
            r = None if operand else _REGEX.match(text, at)
            kind, value = ("regex", r.group()) if r else ("mark", "/")
        at += len(value)
        out.append((kind, value))
        if kind not in ("space", "comment"):
            last = (kind, value)
    return out


def compressed(text: str) -> str:
    """The script without comments and with the least white space that keeps its lines and words apart."""
    out: list[str] = []
    gap = ""
    for kind, value in all_tokens(text):
        if kind in ("space", "comment") and not value.startswith("/*!"):
            gap = "\n" if "\n" in value or "\r" in value or gap == "\n" else " "
            continue
        before = out[-1][-1] if out else ""
        if gap and out:
            words = (before.isalnum() or before in "_$") and (value[0].isalnum() or value[0] in "_$")
            signs = (before in "+-/" and value[0] in "+-/") or (before == "<" and value[0] == "!")
            if words or signs or (gap == "\n" and before not in "{;,([" and value[0] not in "};,)]"):
                out.append(gap)
        out.append(value)
        gap = ""
    return "".join(out)


def is_url(specifier: str) -> bool:
    """Whether a module specifier is a url and not a bare name."""
    return re.match(r"^(?:\.{0,2}/|[a-z][a-z0-9+.\-]*:)", specifier, re.I) is not None


def extract_javascript(text: str) -> list[Edge]:
    found = tokens(text)
    code = [t for t in found if t[0] != "comment"]
    out: list[Edge] = []
    for i, (kind, value) in enumerate(code):
        after = [v for _, v in code[i + 1 : i + 4]]
        before = [v for _, v in code[max(0, i - 8) : i]]
        if kind == "name" and value == "import" and before[-1:] != ["."]:
            if after[:1] == ["("]:
                if len(code) > i + 3 and code[i + 2][0] == "string" and after[2:3] in ([")"], [","]) and is_url(string_value(code[i + 2][1])):
                    out.append(Edge("JavaScriptDynamicImport", string_value(code[i + 2][1]), "JavaScript"))
            elif after[:1] != ["."]:
                source = _source(code, i + 1)
                if source is not None and is_url(source):
                    out.append(Edge("JavaScriptImport", source, "JavaScript"))
        elif kind == "name" and value == "export" and after[:1] and after[0] in ("*", "{"):
            source = _source(code, i + 1)
            if source is not None and is_url(source):
                out.append(Edge("JavaScriptExport", source, "JavaScript"))
        elif kind == "name" and value == "importScripts" and after[:1] == ["("] and (before[-1:] != ["."] or before[-2:-1] == ["self"]):
            for k, v in code[i + 2 :]:
                if k == "string":
                    out.append(Edge("JavaScriptImportScripts", string_value(v), "JavaScript"))
                elif v != ",":
                    break
        elif kind == "name" and value == "Worker" and before[-1:] == ["new"] and after[:1] == ["("] and len(code) > i + 2 and code[i + 2][0] == "string":
            out.append(Edge("JavaScriptWebWorker", string_value(code[i + 2][1]), "JavaScript"))
        elif kind == "name" and value == "register" and before[-4:] == ["navigator", ".", "serviceWorker", "."] and after[:1] == ["("] and len(code) > i + 2 and code[i + 2][0] == "string":
            out.append(Edge("JavaScriptServiceWorkerRegistration", string_value(code[i + 2][1]), "JavaScript"))
        elif kind == "name" and value == "addModule" and before[-1:] == ["."] and after[:1] == ["("] and len(code) > i + 2 and code[i + 2][0] == "string":
            if before[-2:-1] == ["audioWorklet"] or (before[-2:-1] and before[-2] in ("paintWorklet", "layoutWorklet", "animationWorklet") and before[-4:-2] == ["CSS", "."]):
                out.append(Edge("JavaScriptWorklet", string_value(code[i + 2][1]), "JavaScript"))
        elif kind == "string" and after == [".", "toString", "("] and len(code) > i + 5 and code[i + 4][0] == "string" and string_value(code[i + 4][1]) == "url" and code[i + 5][1] == ")":
            out.append(Edge("JavaScriptStaticUrl", string_value(value)))
    lead = next((i for i, t in enumerate(found) if t[0] != "comment"), len(found))
    trail = next((len(found) - i for i, t in enumerate(reversed(found)) if t[0] != "comment"), 0)
    for i, (kind, value) in enumerate(found):
        if kind == "comment" and (i < lead or i >= trail):
            for name, url in _COMMENT_URL.findall(value.removeprefix("//").removesuffix("*/")):
                out.append(Edge("JavaScriptSourceMappingUrl", url, "SourceMap") if name == "sourceMappingURL" else Edge("JavaScriptSourceUrl", url))
    return out


def _source(code: list[tuple[str, str]], i: int) -> str | None:
    """The module specifier of an import or export whose clause begins at token `i`."""
    if i < len(code) and code[i][0] == "string":
        return string_value(code[i][1])
    depth = 0
    for j in range(i, len(code)):
        kind, value = code[j]
        depth += (value == "{") - (value == "}")
        if value in ("(", ";", "=", ")") or (kind == "string" and depth == 0):
            return None
        if kind == "name" and value == "from" and depth == 0 and j + 1 < len(code) and code[j + 1][0] == "string":
            return string_value(code[j + 1][1])
    return None
