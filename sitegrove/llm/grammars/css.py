"""Style sheets that need no error recovery (CSS Syntax Level 3, Selectors Level 4, nesting).

Every block, string, comment and url must be closed, every rule must have a well-formed selector list or at-rule
prelude, and every declaration a name, a colon and a balanced value. Property grammars are not applied.
"""

from __future__ import annotations

import re
import sys

_IDENT = r"(?:--|-?(?:[A-Za-z_\u0080-\U0010ffff]|\\[^\n\r\f]))(?:[\w\-\u0080-\U0010ffff]|\\[^\n\r\f])*"
_NEWLINE = r"(?:\r\n|[\n\r\f])"
_STRING = rf"\"(?:[^\"\\\n\r\f]|\\{_NEWLINE}|\\[^\n\r\f])*\"|'(?:[^'\\\n\r\f]|\\{_NEWLINE}|\\[^\n\r\f])*'"
_URL = r"[uU][rR][lL]\([ \t\n\r\f]*(?![ \t\n\r\f\"'])(?:[^\"'()\\ \t\n\r\f\x00-\x08\x0b\x0e-\x1f\x7f]|\\[^\n\r\f])*[ \t\n\r\f]*\)"
_TOKEN = re.compile(
    rf"(?P<space>(?:[ \t\n\r\f]+|/\*(?:[^*]|\*(?!/))*\*/)+)|(?P<string>{_STRING})|(?P<url>{_URL})|(?P<range>[uU]\+[0-9a-fA-F?]{{1,6}}(?:-[0-9a-fA-F]{{1,6}})?)|(?P<func>{_IDENT}\()|(?P<at>@{_IDENT})|(?P<cdo><!--|-->)|(?P<ident>{_IDENT})"
    rf"|(?P<num>[+\-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+\-]?[0-9]+)?(?:%|{_IDENT})?)|(?P<hash>#(?:[\w\-\u0080-\U0010ffff]|\\[^\n\r\f])+)|(?P<open>[({{\[])|(?P<close>[)}}\]])|(?P<bad>[\"'\\])|(?P<delim>.)",
    re.S,
)
#: Whole plain declarations and plain selectors in one step; whatever doesn't match goes through the tokens.
_WORD = r"(?:#[\w\-]++|[\w.%\-]++)"
_PLAIN_DECLARATION = re.compile(rf"[ \t\n\r\f]*+[A-Za-z\-][\w\-]*+[ \t\n\r\f]*+:[ \t\n\r\f]*+{_WORD}(?:[ \t\n\r\f]*+,?[ \t\n\r\f]*+{_WORD})*+[ \t\n\r\f]*+(?:;|(?=\}}))")
_NAMES = r"[.#]?[A-Za-z][\w\-]*+(?:[.#][A-Za-z][\w\-]*+)*+"
_PLAIN_SELECTOR = re.compile(rf"[ \t\n\r\f]*+{_NAMES}(?:[ \t\n\r\f]*+[ >+~,][ \t\n\r\f]*+{_NAMES})*+[ \t\n\r\f]*+\{{")
_CLOSER = {"(": ")", "[": "]", "{": "}"}
#: At-rules whose block holds rules, whose block holds declarations (some with rules beside them), and those without a block.
RULE_BLOCKS = {"media", "supports", "layer", "container", "scope", "starting-style", "document", "-moz-document", "keyframes", "-webkit-keyframes", "-moz-keyframes", "-o-keyframes", "font-feature-values"}
DECLARATION_BLOCKS = {"font-face", "page", "counter-style", "property", "viewport", "-ms-viewport", "font-palette-values", "position-try", "view-transition", "color-profile"}
STATEMENTS = {"import", "charset", "namespace"}
#: Pseudo-classes and functions whose argument is a selector list.
SELECTOR_ARGUMENTS = {"not", "is", "where", "has", "matches", "-webkit-any", "-moz-any", "host", "host-context", "slotted", "cue", "current"}


class Bad(Exception):
    """The text isn't a style sheet without error recovery."""


def accepts_css(text: str) -> bool:
    """Whether the sheet needs no error recovery. Nesting of any depth is followed; Python's frames live on the heap."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 10_000 + 20 * len(text)))
    if text.startswith("﻿"):
        text = text[1:]
    try:
        _Sheet(text).rules(0, True, False)
        return True
    except Bad:
        return False
    finally:
        sys.setrecursionlimit(limit)


class _Sheet:
    def __init__(self, text: str):
        self.text, self.at, self.size = text, 0, len(text)

    def take(self) -> tuple[str, str]:
        """The next token, or ('end', '')."""
        if self.at >= self.size:
            return "end", ""
        m = _TOKEN.match(self.text, self.at)
        kind, value = m.lastgroup, m.group()
        if kind == "bad" or (value == "/" and self.text.startswith("/*", self.at)):
            raise Bad
        if kind == "func" and value[:4].lower() == "url(" and len(value) == 4:
            rest = _TOKEN.match(self.text, m.end())
            while rest and rest.lastgroup == "space":
                rest = _TOKEN.match(self.text, rest.end())
            if not rest or rest.lastgroup != "string":
                raise Bad
        self.at = m.end()
        return kind, value

    def until(self, stops: str) -> tuple[list[tuple[str, str]], str]:
        """Tokens with balanced brackets up to a token of `stops` outside of them, which is taken too, or the end ('')."""
        out: list[tuple[str, str]] = []
        open_: list[str] = []
        while True:
            kind, value = self.take()
            if kind == "end":
                if open_:
                    raise Bad
                return out, ""
            if not open_ and kind in ("delim", "open", "close") and value in stops:
                return out, value
            if kind == "func":
                open_.append(")")
            elif kind == "open":
                open_.append(_CLOSER[value])
            elif kind == "close":
                if not open_ or open_.pop() != value:
                    raise Bad
            out.append((kind, value))

    def skip(self) -> None:
        while self.at < self.size:
            m = _TOKEN.match(self.text, self.at)
            if m.lastgroup != "space":
                return
            self.at = m.end()

    def rules(self, depth: int, top: bool, keyframes: bool) -> None:
        while True:
            self.skip()
            if self.at >= self.size:
                if top:
                    return
                raise Bad
            char = self.text[self.at]
            if char == "}":
                if top:
                    raise Bad
                self.at += 1
                return
            if char == "@":
                self.at_rule(depth, nested=False)
                continue
            if top and self.text.startswith(("<!--", "-->"), self.at):
                self.at += 4 if char == "<" else 3
                continue
            m = None if keyframes else _PLAIN_SELECTOR.match(self.text, self.at)
            if m:
                self.at = m.end()
            else:
                prelude, stop = self.until("{;}")
                if stop != "{":
                    raise Bad
                if keyframes:
                    keyframe_selectors(prelude)
                else:
                    selectors(prelude, relative=False)
            self.declarations(depth + 1)

    def at_rule(self, depth: int, nested: bool) -> None:
        _, name = self.take()
        if not name.startswith("@") or len(name) < 2:
            raise Bad
        name = name[1:].lower()
        prelude, stop = self.until("{;}")
        if any(kind in ("at", "cdo") for kind, _ in prelude) or any(kind == "delim" and value in "$`" for kind, value in prelude):
            raise Bad
        words = [t for t in prelude if t[0] != "space"]
        if stop == ";":
            if name in DECLARATION_BLOCKS or (name in RULE_BLOCKS and name != "layer") or (not words and name in STATEMENTS):
                raise Bad
            if name == "charset" and [k for k, _ in words] != ["string"]:
                raise Bad
            if name in ("import", "namespace") and not any(k in ("string", "url") or (k == "func" and v.lower() in ("url(", "src(")) for k, v in words):
                raise Bad
            return
        if stop != "{" or name in STATEMENTS:
            raise Bad
        if name in ("media", "supports", "container", "scope", "page", "font-face") or "keyframes" in name:
            self.conditions(name, words)
        if name in RULE_BLOCKS:
            if nested and "keyframes" not in name:
                self.declarations(depth + 1)
            else:
                self.rules(depth + 1, False, "keyframes" in name)
        else:
            self.declarations(depth + 1)

    @staticmethod
    def conditions(name: str, words: list[tuple[str, str]]) -> None:
        if "keyframes" in name and (len(words) != 1 or words[0][0] not in ("ident", "string")):
            raise Bad
        if name == "font-face" and words:
            raise Bad
        if name in ("supports", "container") and not words:
            raise Bad
        if name == "media" and words:
            if words[0][1] == "," or words[-1][1] == "," or any(a[1] == b[1] == "," for a, b in zip(words, words[1:])):
                raise Bad
            depth = 0
            for kind, value in words:
                depth += (kind == "func" or value == "(") - (value == ")")
                if depth == 0 and kind in ("delim", "string", "num", "hash", "open") and value not in ",(":
                    raise Bad

    def declarations(self, depth: int) -> None:
        """The inside of a block up to its closing brace: declarations, at-rules and nested rules."""
        plain, text = _PLAIN_DECLARATION.match, self.text
        while True:
            m = plain(text, self.at)
            if m:
                self.at = m.end()
                continue
            self.skip()
            if self.at >= self.size:
                raise Bad
            char = text[self.at]
            if char == "}":
                self.at += 1
                return
            if char == ";":
                self.at += 1
                continue
            if char == "@":
                self.at_rule(depth, nested=True)
                continue
            start = self.at
            if self.declaration():
                continue
            self.at = start
            prelude, stop = self.until("{;}")
            if stop != "{":
                raise Bad
            selectors(prelude, relative=True)
            self.declarations(depth + 1)

    def declaration(self) -> bool:
        """Takes one declaration with its end; False if what follows is a nested rule instead."""
        kind, name = self.take()
        if kind != "ident":
            return False
        self.skip()
        kind, value = self.take()
        if value != ":":
            return False
        custom = name.startswith("--")
        if custom:
            value_tokens, stop = self.until(";}")
        else:
            value_tokens, stop = self.until("{;}")
            if stop == "{":
                return False
        if not stop:
            raise Bad
        if stop == "}":
            self.at -= 1
        words = [t for t in value_tokens if t[0] != "space"]
        if custom:
            if any(k == "delim" and v == "!" for k, v in words[:-2]):
                raise Bad
            return True
        if len(words) >= 2 and words[-2] == ("delim", "!"):
            if words[-1][1].lower() != "important":
                raise Bad
            words = words[:-2]
        if not words:
            raise Bad
        depth = 0
        legacy = name.lower() in ("filter", "-ms-filter") and words[0][1].lower() == "progid"
        for kind, value in words:
            depth += (kind in ("func", "open")) - (kind == "close")
            if kind in ("at", "cdo") or (kind == "delim" and value in "!$`" or value == ";"):
                raise Bad
            if depth == 0 and not legacy and kind == "delim" and value not in ",/+-":
                raise Bad
            if value == "{":
                raise Bad
        if words[0][1] == "," or words[-1][1] == ",":
            raise Bad
        return True


def keyframe_selectors(tokens: list[tuple[str, str]]) -> None:
    words = [t for t in tokens if t[0] != "space"]
    if len(words) % 2 == 0:
        raise Bad
    for i, (kind, value) in enumerate(words):
        if i % 2:
            if value != ",":
                raise Bad
        elif not (kind == "num" and value.endswith("%")) and value.lower() not in ("from", "to"):
            raise Bad


def selectors(tokens: list[tuple[str, str]], relative: bool) -> None:
    """Raises Bad unless the tokens are a non-empty, comma-separated list of complex selectors."""
    i, n = 0, len(tokens)
    while True:
        i = _complex(tokens, i, n, relative)
        if i >= n:
            return
        i += 1  # the comma


def _complex(tokens: list[tuple[str, str]], i: int, n: int, relative: bool) -> int:
    """One complex selector from `i`; returns the place of the comma or the end."""
    compound = combinator = False
    any_compound = False
    while i < n:
        kind, value = tokens[i]
        if kind == "space":
            compound = False
            i += 1
        elif value == ",":
            break
        elif kind == "delim" and value in ">+~":
            if combinator or (not any_compound and not relative):
                raise Bad
            combinator, compound = True, False
            i += 1
        elif value == "|" and i + 1 < n and tokens[i + 1][1] == "|" and any_compound and not combinator:
            combinator, compound = True, False
            i += 2
        else:
            i = _simple(tokens, i, n, compound)
            compound = any_compound = True
            combinator = False
    if not any_compound or combinator:
        raise Bad
    return i


def _simple(tokens: list[tuple[str, str]], i: int, n: int, compound: bool) -> int:
    kind, value = tokens[i]
    following = tokens[i + 1] if i + 1 < n else ("end", "")
    if kind == "ident" or value == "*":
        if compound and not (i and tokens[i - 1][1] in ("|", "&")):
            raise Bad
        if following[1] == "|" and i + 2 < n and (tokens[i + 2][0] == "ident" or tokens[i + 2][1] == "*"):
            return i + 3
        return i + 1
    if value == "|" and following[0] == "ident":
        return i + 2
    if kind == "hash":
        if not re.match(rf"#{_IDENT}$", value):
            raise Bad
        return i + 1
    if value == "&":
        return i + 1
    if value == ".":
        if following[0] != "ident":
            raise Bad
        return i + 2
    if value == "[":
        end = _closing(tokens, i, n)
        _attribute([t for t in tokens[i + 1 : end] if t[0] != "space"])
        return end + 1
    if value == ":":
        i += 1
        if following[1] == ":":
            i += 1
        kind, value = tokens[i] if i < n else ("end", "")
        if kind == "ident":
            return i + 1
        if kind != "func":
            raise Bad
        end = _closing(tokens, i, n)
        inside = tokens[i + 1 : end]
        name = value[:-1].lower()
        if name in SELECTOR_ARGUMENTS:
            selectors(inside, relative=name == "has")
        elif name.startswith("nth-"):
            if not re.match(r"(?i)\s*(?:odd|even|[+-]?\d+|[+-]?\d*n(?:\s*[+-]\s*\d+)?)\s*(?:of\b.*)?$", "".join(" " if k == "space" else v for k, v in inside), re.S):
                raise Bad
        elif not any(k != "space" for k, _ in inside):
            raise Bad
        return end + 1
    raise Bad


def _closing(tokens: list[tuple[str, str]], i: int, n: int) -> int:
    depth = 0
    for j in range(i, n):
        kind = tokens[j][0]
        depth += (kind in ("func", "open")) - (kind == "close")
        if not depth:
            return j
    raise Bad


def _attribute(words: list[tuple[str, str]]) -> None:
    kinds = [k if k in ("ident", "string", "num") else v for k, v in words]
    if len(kinds) >= 3 and kinds[1] == "|" and kinds[0] in ("ident", "*") and kinds[2] == "ident":
        kinds = kinds[2:]
    elif kinds[:1] == ["|"]:
        kinds = kinds[1:]
    if kinds == ["ident"]:
        return
    if kinds[:1] != ["ident"]:
        raise Bad
    kinds = kinds[1:]
    if kinds[:1] and kinds[0] in ("~", "|", "^", "$", "*"):
        kinds = kinds[1:]
    if kinds[:1] != ["="] or len(kinds) < 2 or kinds[1] not in ("ident", "string") or kinds[2:] not in ([], ["ident"]):
        raise Bad
