"""Json (RFC 8259) and well-formed XML 1.0, by the C parsers of the standard library."""

from __future__ import annotations

import json
import re
from xml.parsers import expat

_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
_TOKEN = re.compile(rf"[ \t\n\r]*(?:({_STRING})|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|([\[\]{{}},:])|($))")


def _constant(name: str) -> None:
    raise ValueError(name)


#: Values stay text: conversion is not needed, and very long integers would be refused.
_DECODER = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=_constant)


def accepts_json(text: str) -> bool:
    """Whether `text` is one Json value between white space; a byte order mark is not part of the grammar."""
    try:
        _DECODER.decode(text)
        return True
    except RecursionError:
        return _nested_json(text)
    except ValueError:
        return False


def _nested_json(text: str) -> bool:
    """The same without recursion, for nesting that is too deep for the decoder."""
    open_, at, state = [], 0, "value"
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            return False
        at, mark = m.end(), m.group(3)
        if m.group(4) is not None:
            return state == "end" and not open_
        if m.group(1) is not None and state in ("key", "key or close"):
            state = "colon"
        elif (m.group(1) or m.group(2)) is not None and state in ("value", "value or close"):
            state = "end"
        elif mark == ":" and state == "colon":
            state = "value"
        elif mark in ("[", "{") and mark and state in ("value", "value or close"):
            open_.append(mark)
            state = "value or close" if mark == "[" else "key or close"
        elif mark == "," and state == "end" and open_:
            state = "value" if open_[-1] == "[" else "key"
        elif mark == "]" and open_ and open_[-1] == "[" and state in ("end", "value or close"):
            open_.pop()
            state = "end"
        elif mark == "}" and open_ and open_[-1] == "{" and state in ("end", "key or close"):
            open_.pop()
            state = "end"
        else:
            return False


def accepts_xml(text: str) -> bool:
    """Whether `text` is a well-formed XML 1.0 document; a declared encoding doesn't matter as the text is decoded."""
    parser = expat.ParserCreate("utf-8")
    try:
        parser.Parse(text.encode("utf-8", "surrogatepass"), True)
        return True
    except (expat.ExpatError, ValueError):
        return False
