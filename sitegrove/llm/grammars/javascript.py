"""ECMAScript 2022: whether a text is a script or a module.

A recursive-descent recogniser over tokens that are read on demand, so the parser decides whether `/` starts a regular
expression. It builds no tree: expressions return flags that say what they may still become (a target, a pattern, the
parameters of an arrow function). Early errors that a text can show by itself are kept: strict-mode words, doubled
lexical names, targets of assignments, labels, private names, exports of unknown names, regular expression syntax.
"""

from __future__ import annotations

import re
import sys

_SPACE = re.compile(r"(?:[ \t\v\f\u00a0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000\n\r\u2028\u2029]+|//[^\n\r\u2028\u2029]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)*")
_LINE = re.compile(r"[\n\r\u2028\u2029]")
_NUMBER = r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:0|[1-9](?:_?[0-9])*)n|(?:(?:0|[1-9](?:_?[0-9])*)\.?(?:(?<=\.)[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+\-]?[0-9](?:_?[0-9])*)?)"
_TOKEN = re.compile(
    r"([A-Za-z_$][\w$]*)"
    r"|(\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|\.(?![0-9])|[{}()\[\];,<>+\-*/%&|^!~?:=`])"
    rf"|(0[0-9]+(?:\.[0-9]*)?|{_NUMBER})"
    r"|(#?(?:[\w$\u200c\u200d]|\\u\{[0-9a-fA-F]+\}|\\u[0-9a-fA-F]{4})+)"
)
_REGEX = re.compile(r"/(?![*/])((?:[^\\/\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+)/([\w$]*)")
_TEMPLATE = re.compile(r"((?:[^`\\$]|\\[\s\S]|\$(?!\{))*)(`|\$\{)")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{0*(?:10|[0-9a-fA-F])?[0-9a-fA-F]{1,4}\}))")
_OCTAL_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:0[0-9]|[1-9])")
_UNICODE_ESCAPE = re.compile(r"\\u(?:\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4}))")

#: Most frames of the parser that one character can open.
FRAMES = 40

# Token types
NAME, STRING, PUNCTUATOR, NUMBER, PRIVATE, REGEX, END = range(7)
#: Reserved words, words reserved in strict code, assignment operators and binary precedences of ECMAScript.
RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
STRICT_RESERVED = frozenset("implements interface let package private protected public static yield".split())
ASSIGNMENTS = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}

# What an expression may become: a simple target, an assignment pattern, a binding, a name; what it holds: a cover
# initializer (`{a = 1}`, which only a pattern may keep), `target = default`, a parenthesis, an arrow function or
# assignment (no operand), an optional chain, a bare `??` or `||`/`&&`, a unary operator, a call to super-like import.
TARGET, PATTERN, BINDING, IDENT, COVER, DEFAULT, PAREN, LOW, OPTIONAL, NULLISH, LOGICAL, UNARY = (1 << i for i in range(12))


class Bad(Exception):
    """Not a script or module."""


class _Scope:
    __slots__ = ("lexical", "var", "function", "names", "catch", "functions")

    def __init__(self, function: bool, names: set | None = None):
        self.lexical: set[str] = set()
        self.var: set[str] = set()
        self.function = function
        self.names = names or set()
        self.catch: set[str] = set()
        self.functions: set[str] = set()


def accepts_javascript(text: str) -> bool:
    """Whether `text` is a script or a module of ECMAScript 2022. Nesting of any depth is followed: Python's own frames live
    on the heap, about 2.5 KB a level, so the limit on their number is set beyond what the text can need."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 10_000 + FRAMES * len(text)))
    try:
        for module in (False, True):
            try:
                Parser(text, module).program()
                return True
            except Bad:
                if not module and not re.search(r"\b(?:import|export|await)\b", text):
                    return False
        return False
    finally:
        sys.setrecursionlimit(limit)


class Parser:
    def __init__(self, text: str, module: bool):
        self.s, self.n, self.module, self.strict = text, len(text), module, module
        self.asyncs = module  # await is an operator here
        self.generator = self.function = False
        self.no_suspending = False  # within parameters and static blocks: no yield, no await
        self.loop = self.switch = 0
        self.labels: list[tuple[str, bool]] = []
        self.method = self.constructor = False  # super.x, super()
        self.new_target = False
        self.field = False  # in a class field or static block: no arguments
        self.no_in = False
        self.scopes = [_Scope(True)]
        self.private: list[tuple[dict[str, str], list[str]]] = []
        self.exported: set[str] = set()
        self.exported_names: list[str] = []
        self.cover_await = False
        self.e = 0
        if text.startswith("#!"):
            m = _LINE.search(text)
            self.e = m.start() if m else self.n
        self.next()

    # Tokens

    def next(self) -> None:
        start = self.e
        self.last = start
        at = _SPACE.match(self.s, start).end()
        self.nl = at > start and _LINE.search(self.s, start, at) is not None
        self.p = at
        if at >= self.n:
            self.t, self.v, self.e = END, "", at
            return
        m = _TOKEN.match(self.s, at)
        if m is None:
            raise Bad
        kind = m.lastindex
        self.v, self.e = m.group(), m.end()
        self.escaped = False
        if kind == 3:
            self.t = PUNCTUATOR
            if not self.module and self.v == "<" and self.s.startswith("<!--", at) or (not self.module and self.v == "--" and self.s.startswith("-->", at) and (self.nl or not self.s[:start].strip())):
                m = _LINE.search(self.s, at)
                self.e = m.start() if m else self.n
                newline = self.nl
                self.next()
                self.nl, self.last = self.nl or newline, start
        elif kind == 1:
            self.t = NAME
            if self.e < self.n and (self.s[self.e] in "\\\u200c\u200d"):
                self._long_name(at)
            elif not self.v.isascii() and not self.v.replace("$", "_").isidentifier():
                raise Bad
        elif kind == 2:
            self.t = STRING
            if "\\" in self.v:
                if _BAD_ESCAPE.search(self.v) or (self.strict and _OCTAL_ESCAPE.search(self.v)):
                    raise Bad
        elif kind == 4:
            self.t = NUMBER
            v = self.v
            if v[0] == "0" and len(v) > 1 and v[1].isdigit():
                if self.strict or (v.strip("01234567") == "" and "." in v):
                    raise Bad
                if "." in v and v.split(".")[0].strip("01234567") == "":
                    raise Bad
            if self.e < self.n and (self.s[self.e].isalnum() or self.s[self.e] in "_$\\"):
                raise Bad
        else:
            self._long_name(at)

    def _long_name(self, at: int) -> None:
        m = re.compile(r"#?(?:[\w$\u200c\u200d]|\\u\{[0-9a-fA-F]+\}|\\u[0-9a-fA-F]{4})+").match(self.s, at)
        if m is None:
            raise Bad
        raw = m.group()
        self.e = m.end()
        self.escaped = "\\" in raw
        name = _UNICODE_ESCAPE.sub(lambda x: chr(min(int(x.group(1) or x.group(2), 16), 0x10FFFF)), raw)
        private = name.startswith("#")
        body = name[private:]
        if not body.replace("$", "_").replace("\u200c", "_").replace("\u200d", "_").isidentifier() or body[0] in "\u200c\u200d":
            raise Bad
        self.t, self.v = (PRIVATE if private else NAME), name

    def take(self, value: str) -> bool:
        if self.v == value and (self.t == PUNCTUATOR or (self.t == NAME and not self.escaped)):
            self.next()
            return True
        return False

    def need(self, value: str) -> None:
        if self.v != value or self.t not in (PUNCTUATOR, NAME) or (self.t == NAME and self.escaped):
            raise Bad
        self.next()

    def word(self, value: str) -> bool:
        return self.t == NAME and self.v == value and not self.escaped

    def is_(self, value: str) -> bool:
        return self.t == PUNCTUATOR and self.v == value

    def semicolon(self) -> None:
        if self.t == PUNCTUATOR and self.v == ";":
            self.next()
        elif not (self.nl or self.t == END or (self.t == PUNCTUATOR and self.v == "}")):
            raise Bad

    def peek(self) -> tuple[int, str, bool]:
        """Type, value and newline-before of the token after this one."""
        saved = self.save()
        try:
            self.next()
            return self.t, self.v, self.nl
        except Bad:
            return END, "", False
        finally:
            self.restore(saved)

    def save(self) -> tuple:
        return self.t, self.v, self.nl, self.p, self.e, self.last, getattr(self, "escaped", False)

    def restore(self, saved: tuple) -> None:
        self.t, self.v, self.nl, self.p, self.e, self.last, self.escaped = saved

    # Names

    def check_name(self, name: str, binding: bool) -> None:
        if name in RESERVED:
            raise Bad
        if self.strict and (name in STRICT_RESERVED or (binding and name in ("eval", "arguments"))):
            raise Bad
        if name == "yield" and (self.generator or self.strict):
            raise Bad
        if name == "await" and (self.asyncs or self.module):
            raise Bad
        if name == "arguments" and self.field and not binding:
            raise Bad

    def lexical(self, name: str, function: bool = False) -> None:
        scope = self.scopes[-1]
        if scope.function and function and len(self.scopes) and not (self.module and len(self.scopes) == 1):
            if name in scope.lexical:
                raise Bad
            scope.var.add(name)
            return
        if name in scope.lexical:
            if not (function and not self.strict and name in scope.functions):
                raise Bad
        elif name in scope.var or name in scope.names or name in scope.catch:
            raise Bad
        scope.lexical.add(name)
        if function:
            scope.functions.add(name)
        else:
            scope.functions.discard(name)

    def var(self, name: str) -> None:
        for scope in reversed(self.scopes):
            if name in scope.lexical:
                raise Bad
            scope.var.add(name)
            if scope.function:
                return

    def binding(self, names: list[str]) -> None:
        """A binding identifier or pattern; its names are added to `names`."""
        if self.t == NAME:
            self.check_name(self.v, True)
            names.append(self.v)
            self.next()
        elif self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                rest = self.take("...")
                self.binding(names)
                if not rest:
                    self.default()
                if rest:
                    self.need("]")
                    return
                if not self.is_("]"):
                    self.need(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    if self.t != NAME:
                        raise Bad
                    self.binding(names)
                    self.need("}")
                    return
                if self.is_("["):
                    self.next()
                    self.inside(self.assignment_pure)
                    self.need("]")
                    self.need(":")
                    self.binding(names)
                elif self.t in (STRING, NUMBER):
                    self.next()
                    self.need(":")
                    self.binding(names)
                elif self.t == NAME:
                    name, escaped = self.v, self.escaped
                    self.next()
                    if self.take(":"):
                        self.binding(names)
                    else:
                        self.check_name(name, True)
                        names.append(name)
                else:
                    raise Bad
                self.default()
                if not self.is_("}"):
                    self.need(",")
        else:
            raise Bad

    def default(self) -> None:
        if self.take("="):
            self.inside(self.assignment_pure)

    def inside(self, f):
        """f() where `in` is an operator."""
        kept, self.no_in = self.no_in, False
        out = f()
        self.no_in = kept
        return out

    # Statements

    def program(self) -> None:
        self.directives()
        while self.t != END:
            self.item(top=True)
        if self.module:
            scope = self.scopes[0]
            for name in self.exported_names:
                if name not in scope.lexical and name not in scope.var:
                    raise Bad

    def directives(self) -> bool:
        """Reads the directive prologue; True if it holds "use strict"."""
        found = False
        while self.t == STRING:
            saved, literal = self.save(), self.v
            self.next()
            if not (self.is_(";") or self.is_("}") or self.t == END or (self.nl and not (self.t == PUNCTUATOR and self.v in "([`.,+-*/%?&|^<>=!" or self.t == PUNCTUATOR and self.v not in (";", "}", "{", "++", "--", "!", "~") or self.t == NAME and self.v in ("in", "instanceof")))):
                self.restore(saved)
                return found
            if literal[1:-1] == "use strict":
                found = self.strict = True
            self.semicolon()
        return found

    def item(self, top: bool = False) -> None:
        """A statement or declaration."""
        if self.t == NAME and not self.escaped:
            v = self.v
            if v == "function":
                self.function_declaration(False)
                return
            if v == "class":
                self.next()
                self.class_(declaration=True)
                return
            if v == "const" or (v == "let" and self.let_declares()):
                self.next()
                self.variables("let" if v == "let" else "const")
                self.semicolon()
                return
            if v == "async":
                t, w, nl = self.peek()
                if t == NAME and w == "function" and not nl:
                    self.next()
                    self.function_declaration(True)
                    return
            if v == "import":
                t, w, _ = self.peek()
                if not (t == PUNCTUATOR and w in "(."):
                    if not (top and self.module):
                        raise Bad
                    self.import_()
                    return
            if v == "export":
                if not (top and self.module):
                    raise Bad
                self.export()
                return
        self.statement()

    def let_declares(self) -> bool:
        t, v, _ = self.peek()
        return (t == NAME and v not in ("in", "instanceof", "of") or t == NAME and v == "of") or (t == PUNCTUATOR and v in ("[", "{"))

    def block(self, scope: _Scope | None = None) -> None:
        self.need("{")
        self.scopes.append(scope or _Scope(False))
        while not self.is_("}"):
            if self.t == END:
                raise Bad
            self.item()
        self.scopes.pop()
        self.next()

    def statement(self) -> None:
        t, v = self.t, self.v
        if t == PUNCTUATOR:
            if v == "{":
                self.block()
                return
            if v == ";":
                self.next()
                return
        elif t == NAME and not self.escaped:
            handler = _STATEMENTS.get(v)
            if handler is not None:
                handler(self)
                return
            if v in ("function", "class", "export", "const", "enum"):
                raise Bad
            if v == "let" and (self.strict or self.peek()[1] == "["):
                raise Bad
            if v == "import" and not (self.peek()[1] in ("(", ".")):
                raise Bad
            following = self.peek()
            if v == "async" and following[0] == NAME and following[1] == "function" and not following[2]:
                raise Bad
            if following[0] == PUNCTUATOR and following[1] == ":" and v not in RESERVED:
                self.labelled()
                return
        elif t == NAME and self.peek()[1] == ":":
            self.labelled()
            return
        self.expression_pure()
        self.semicolon()

    def labelled(self) -> None:
        name = self.v
        self.check_name(name, False)
        if any(name == label for label, _ in self.labels):
            raise Bad
        self.next()
        self.next()
        # a run of labels before a loop all belong to the loop
        ahead = self.save()
        depth = 0
        while self.t == NAME and self.v not in RESERVED and self.peek()[1] == ":":
            self.next()
            self.next()
            depth += 1
        loop = self.t == NAME and self.v in ("for", "while", "do")
        self.restore(ahead)
        self.labels.append((name, loop))
        if self.word("function"):
            if self.strict or self.peek()[1] == "*":
                raise Bad
            self.function_declaration(False)
        else:
            self.statement()
        self.labels.pop()

    def body(self) -> None:
        """The statement of an if or else, which may be a function in sloppy code."""
        if self.word("function") and not self.strict:
            if self.peek()[1] == "*":
                raise Bad
            self.scopes.append(_Scope(False))
            self.function_declaration(False)
            self.scopes.pop()
        else:
            self.statement()

    def parenthesised(self) -> None:
        self.need("(")
        self.inside(self.expression_pure)
        self.need(")")

    def s_var(self) -> None:
        self.next()
        self.variables("var")
        self.semicolon()

    def s_if(self) -> None:
        self.next()
        self.parenthesised()
        self.body()
        if self.word("else"):
            self.next()
            self.body()

    def looped(self) -> None:
        self.loop += 1
        self.statement()
        self.loop -= 1

    def s_while(self) -> None:
        self.next()
        self.parenthesised()
        self.looped()

    def s_do(self) -> None:
        self.next()
        self.looped()
        self.need("while")
        self.parenthesised()
        self.take(";")

    def s_for(self) -> None:
        self.next()
        waiting = False
        if self.word("await"):
            if not self.asyncs or self.no_suspending:
                raise Bad
            waiting = True
            self.next()
        self.need("(")
        self.scopes.append(_Scope(False))
        if self.is_(";"):
            if waiting:
                raise Bad
            self.for_rest()
        elif self.word("var") or self.word("const") or (self.word("let") and self.for_let()):
            kind = self.v
            self.next()
            self.no_in = True
            single, initialised, plain = self.variables(kind, head=True)
            self.no_in = False
            if single and (self.word("of") or self.word("in")) and not (initialised and (self.strict or kind != "var" or self.v == "of" or not plain)):
                if self.v == "in":
                    if waiting:
                        raise Bad
                    self.next()
                    self.expression_pure()
                else:
                    self.next()
                    self.assignment_pure()
                self.need(")")
                self.looped()
            else:
                if waiting or self.missing:
                    raise Bad
                self.for_rest()
        else:
            is_let, is_async = self.word("let"), self.word("async") and self.peek()[1] == "of"
            self.no_in = True
            flags = self.expression()
            self.no_in = False
            if self.word("of") or self.word("in"):
                if not flags & (TARGET | PATTERN) or flags & (DEFAULT | OPTIONAL) or (self.v == "of" and (is_let or (is_async and not waiting))) or (waiting and self.v == "in"):
                    raise Bad
                if flags & PATTERN and flags & PAREN:
                    raise Bad
                of = self.v == "of"
                self.next()
                if of:
                    self.assignment_pure()
                else:
                    self.expression_pure()
                self.need(")")
                self.looped()
            else:
                if waiting or flags & COVER:
                    raise Bad
                self.for_rest()
        self.scopes.pop()

    def for_let(self) -> bool:
        t, v, _ = self.peek()
        if t == NAME and v == "of":  # `let of of xs` and `let of = 1` declare `of`
            saved = self.save()
            self.next()
            t, v, _ = self.peek()
            self.restore(saved)
            return v in ("of", "in", "=", ";", ",")
        return (t == NAME and v not in ("in", "instanceof")) or (t == PUNCTUATOR and v in ("[", "{"))

    def for_rest(self) -> None:
        self.need(";")
        if not self.is_(";"):
            self.expression_pure()
        self.need(";")
        if not self.is_(")"):
            self.expression_pure()
        self.need(")")
        self.looped()

    def variables(self, kind: str, head: bool = False) -> tuple[bool, bool, bool]:
        """The declarators; whether there is one, with an initializer, and a plain name."""
        count, initialised, plain = 0, False, True
        self.missing = False
        while True:
            names: list[str] = []
            plain = self.t == NAME
            if kind != "var" and self.word("let"):
                raise Bad
            self.binding(names)
            for name in names:
                if kind == "var":
                    self.var(name)
                else:
                    if name == "let":
                        raise Bad
                    self.lexical(name)
            if kind != "var" and len(set(names)) < len(names):
                raise Bad
            count += 1
            initialised = False
            if self.take("="):
                initialised = True
                self.assignment_pure()
            elif not plain or kind == "const":
                self.missing = True
                if not head:
                    raise Bad
            if not self.take(","):
                return count == 1, initialised, plain

    def s_jump(self) -> None:
        kind = self.v
        self.next()
        if self.t == NAME and not self.nl and self.v not in RESERVED:
            if not any(name == self.v and (loop or kind == "break") for name, loop in self.labels):
                raise Bad
            self.next()
        elif not (self.loop or (kind == "break" and self.switch)):
            raise Bad
        self.semicolon()

    def s_return(self) -> None:
        if not self.function:
            raise Bad
        self.next()
        if not (self.nl or self.t == END or self.is_(";") or self.is_("}")):
            self.expression_pure()
        self.semicolon()

    def s_throw(self) -> None:
        self.next()
        if self.nl:
            raise Bad
        self.expression_pure()
        self.semicolon()

    def s_with(self) -> None:
        if self.strict:
            raise Bad
        self.next()
        self.parenthesised()
        self.statement()

    def s_debugger(self) -> None:
        self.next()
        self.semicolon()

    def s_switch(self) -> None:
        self.next()
        self.parenthesised()
        self.need("{")
        self.scopes.append(_Scope(False))
        self.switch += 1
        default = False
        while not self.take("}"):
            if self.take("default"):
                if default:
                    raise Bad
                default = True
            else:
                self.need("case")
                self.expression_pure()
            self.need(":")
            while not (self.is_("}") or self.word("case") or self.word("default")):
                if self.t == END:
                    raise Bad
                self.item()
        self.switch -= 1
        self.scopes.pop()

    def s_try(self) -> None:
        self.next()
        self.block()
        ended = False
        if self.take("catch"):
            ended = True
            scope = _Scope(False)
            if self.take("("):
                names: list[str] = []
                simple = self.t == NAME
                self.binding(names)
                if len(set(names)) < len(names):
                    raise Bad
                self.need(")")
                scope.catch = set(names)
                if not simple:
                    scope.lexical = set()
            self.block(scope)
        if self.take("finally"):
            ended = True
            self.block()
        if not ended:
            raise Bad

    # Modules

    def module_name(self) -> tuple[str, bool]:
        """An import or export name: a word or a string; whether it may be a local name."""
        if self.t not in (NAME, STRING):
            raise Bad
        name, word = self.v, self.t == NAME
        self.next()
        return (name if word else name[1:-1]), word

    def source(self) -> None:
        if self.t != STRING:
            raise Bad
        self.next()

    def import_(self) -> None:
        self.next()
        if self.t == STRING:
            self.next()
            self.semicolon()
            return
        if self.t == NAME:
            self.import_name(self.v)
            self.next()
            if not self.take(","):
                self.need("from")
                self.source()
                self.semicolon()
                return
        if self.take("*"):
            self.need("as")
            if self.t != NAME:
                raise Bad
            self.import_name(self.v)
            self.next()
        else:
            self.need("{")
            while not self.take("}"):
                name, word = self.module_name()
                if self.word("as"):
                    self.next()
                    if self.t != NAME:
                        raise Bad
                    name, word = self.v, True
                    self.next()
                if not word:
                    raise Bad
                self.import_name(name)
                if not self.is_("}"):
                    self.need(",")
        self.need("from")
        self.source()
        self.semicolon()

    def import_name(self, name: str) -> None:
        self.check_name(name, True)
        self.lexical(name)

    def export_name(self, name: str) -> None:
        if name in self.exported:
            raise Bad
        self.exported.add(name)

    def export(self) -> None:
        self.next()
        if self.take("*"):
            if self.word("as"):
                self.next()
                self.export_name(self.module_name()[0])
            self.need("from")
            self.source()
            self.semicolon()
        elif self.take("{"):
            local: list[tuple[str, bool]] = []
            while not self.take("}"):
                name, word = self.module_name()
                local.append((name, word))
                if self.word("as"):
                    self.next()
                    name = self.module_name()[0]
                self.export_name(name)
                if not self.is_("}"):
                    self.need(",")
            if self.word("from"):
                self.next()
                self.source()
            else:
                for name, word in local:
                    if not word:
                        raise Bad
                    self.check_name(name, False)
                    self.exported_names.append(name)
            self.semicolon()
        elif self.take("default"):
            self.export_name("default")
            if self.word("function"):
                self.function_declaration(False, unnamed=True)
            elif self.word("async") and self.peek()[1] == "function" and not self.peek()[2]:
                self.next()
                self.function_declaration(True, unnamed=True)
            elif self.word("class"):
                self.next()
                self.class_(declaration=True, unnamed=True)
            else:
                self.assignment_pure()
                self.semicolon()
        else:
            before = set(self.scopes[0].lexical), set(self.scopes[0].var)
            if self.word("var"):
                self.statement()
            elif self.word("let") or self.word("const") or self.word("class") or self.word("function") or self.word("async"):
                if self.word("async") and self.peek()[1] != "function":
                    raise Bad
                self.item()
            else:
                raise Bad
            for name in (self.scopes[0].lexical - before[0]) | (self.scopes[0].var - before[1]):
                self.export_name(name)

    # Functions and classes

    def function_declaration(self, is_async: bool, unnamed: bool = False) -> None:
        self.next()
        generator = self.take("*")
        if self.t == NAME:
            self.check_name(self.v, True)
            self.lexical(self.v, function=True)
            name = self.v
            self.next()
        elif unnamed:
            name = None
        else:
            raise Bad
        self.function_rest(is_async, generator, name)

    def function_rest(self, is_async: bool, generator: bool, name: str | None = None, method: bool = False, constructor: bool = False, arity: int | None = None) -> None:
        """Parameters and body of a function that isn't an arrow."""
        kept = self.asyncs, self.generator, self.function, self.loop, self.switch, self.labels, self.method, self.constructor, self.new_target, self.field, self.strict, self.no_in, self.no_suspending
        self.no_suspending = True
        self.asyncs, self.generator, self.function, self.loop, self.switch, self.labels = is_async, generator, True, 0, 0, []
        self.method, self.constructor, self.new_target, self.field, self.no_in = method, constructor, True, False, False
        self.need("(")
        names: list[str] = []
        simple, count, rest = True, 0, False
        while not self.is_(")"):
            count += 1
            if self.take("..."):
                simple, rest = False, True
                self.binding(names)
                break
            if self.t != NAME:
                simple = False
            self.binding(names)
            if self.is_("="):
                simple = False
                self.next()
                self.assignment_pure()
            if not self.is_(")"):
                self.need(",")
        if arity is not None and (count != arity or (arity == 1 and rest)):
            raise Bad
        self.no_suspending = False
        self.need_body(names, simple, method, name)
        strict = self.strict
        (self.asyncs, self.generator, self.function, self.loop, self.switch, self.labels, self.method, self.constructor, self.new_target, self.field, self.strict, self.no_in, self.no_suspending) = kept
        self.after_body(strict)

    def need_body(self, names: list[str], simple: bool, unique: bool, name: str | None = None, arrow: bool = False) -> None:
        """`)` (unless an arrow's) and the braces of a function."""
        if not arrow:
            self.need(")")
        if not self.is_("{"):
            raise Bad
        strict = self.strict
        self.scopes.append(_Scope(True, set(names)))
        self.next()
        if self.directives() and not simple:
            raise Bad
        if self.strict and not strict:
            for word in [*names, *([name] if name else [])]:
                self.check_name(word, True)
        if (self.strict or unique or not simple) and len(set(names)) < len(names):
            raise Bad
        while not self.is_("}"):
            if self.t == END:
                raise Bad
            self.item()
        self.scopes.pop()

    def after_body(self, strict: bool) -> None:
        """The closing brace; the token after it is read in the outer strictness."""
        self.next()

    def class_(self, declaration: bool, unnamed: bool = False) -> None:
        strict, self.strict = self.strict, True
        if self.t == NAME and self.v != "extends":
            self.check_name(self.v, True)
            if declaration:
                self.lexical(self.v)
            self.next()
        elif declaration and not unnamed:
            raise Bad
        heritage = self.take("extends")
        if heritage:
            if self.left_hand() & COVER:
                raise Bad
        declared: dict[str, str] = {}
        used: list[str] = []
        self.need("{")
        self.private.append((declared, used))
        constructor = False
        while not self.is_("}"):
            if self.take(";"):
                continue
            constructor |= self.element(heritage, declared, constructor)
        self.private.pop()
        for name in used:
            if name not in declared:
                if not self.private:
                    raise Bad
                self.private[-1][1].append(name)
        self.strict = strict
        self.next()

    def element(self, heritage: bool, declared: dict[str, str], had_constructor: bool) -> bool:
        """A class element; True for the constructor."""
        static = is_async = generator = False
        kind = ""
        if self.word("static"):
            following = self.peek()
            if following[0] == PUNCTUATOR and following[1] == "{":
                self.next()
                self.static_block()
                return False
            if not (following[0] == PUNCTUATOR and following[1] in ("(", "=", ";", "}")):
                static = True
                self.next()
        if self.word("async"):
            following = self.peek()
            if not (following[0] == PUNCTUATOR and following[1] in ("(", "=", ";", "}")) and not following[2]:
                is_async = True
                self.next()
        if self.take("*"):
            generator = True
        elif not is_async and (self.word("get") or self.word("set")):
            following = self.peek()
            if not (following[0] == PUNCTUATOR and following[1] in ("(", "=", ";", "}")) and following[0] != END and not (following[0] == PUNCTUATOR and following[1] == "*"):
                kind = self.v
                self.next()
        t, v = self.t, self.v
        name = self.property_name(private=True)
        if t == PRIVATE:
            if v == "#constructor":
                raise Bad
            state = (kind or "plain") + (" static" if static else "")
            if v in declared and not ({declared[v], state} in ({"get", "set"}, {"get static", "set static"})):
                raise Bad
            declared[v] = "both" if v in declared else state
        if self.is_("("):
            is_constructor = name == "constructor" and not static and t != PRIVATE
            if is_constructor and (had_constructor or is_async or generator or kind):
                raise Bad
            if static and name == "prototype":
                raise Bad
            self.function_rest(is_async, generator, method=True, constructor=is_constructor and heritage, arity={"get": 0, "set": 1}.get(kind))
            return is_constructor
        if is_async or generator or kind or name == "constructor" or (static and name == "prototype"):
            raise Bad
        kept = self.field, self.method, self.new_target, self.asyncs, self.generator, self.constructor
        self.field, self.method, self.new_target, self.asyncs, self.generator, self.constructor = True, True, True, False, False, False
        if self.take("="):
            self.inside(self.assignment_pure)
        self.field, self.method, self.new_target, self.asyncs, self.generator, self.constructor = kept
        self.semicolon()
        return False

    def static_block(self) -> None:
        kept = self.field, self.method, self.new_target, self.asyncs, self.generator, self.constructor, self.function, self.loop, self.switch, self.labels, self.no_suspending
        self.field, self.method, self.new_target, self.asyncs, self.generator, self.constructor, self.function, self.loop, self.switch, self.labels, self.no_suspending = True, True, True, True, False, False, False, 0, 0, [], True
        self.need("{")
        self.scopes.append(_Scope(True))
        while not self.is_("}"):
            if self.t == END:
                raise Bad
            self.item()
        self.scopes.pop()
        self.field, self.method, self.new_target, self.asyncs, self.generator, self.constructor, self.function, self.loop, self.switch, self.labels, self.no_suspending = kept
        self.next()

    def property_name(self, private: bool = False) -> str | None:
        """The name if it is known before running."""
        t, v = self.t, self.v
        if t in (NAME, NUMBER) or (private and t == PRIVATE):
            self.next()
            return v
        if t == STRING:
            self.next()
            return v[1:-1]
        if t == PUNCTUATOR and v == "[":
            self.next()
            self.inside(self.assignment_pure)
            self.need("]")
            return None
        raise Bad

    # Expressions

    def expression(self) -> int:
        flags = self.assignment()
        if self.is_(","):
            if flags & COVER:
                raise Bad
            while self.take(","):
                self.assignment_pure()
            return LOW
        return flags

    def expression_pure(self) -> None:
        if self.expression() & COVER:
            raise Bad

    def assignment_pure(self) -> None:
        if self.assignment() & COVER:
            raise Bad

    def assignment(self) -> int:
        if self.t == NAME and not self.escaped:
            v = self.v
            if v == "yield" and self.generator:
                if self.no_suspending:
                    raise Bad
                self.yield_()
                return LOW
            if v == "async":
                following = self.peek()
                if following[0] == NAME and not following[2] and following[1] not in ("function", "in", "instanceof", "of"):
                    saved = self.save()
                    self.next()
                    name = self.v
                    self.next()
                    if self.is_("=>") and not self.nl:
                        if name == "await":
                            raise Bad
                        self.check_name(name, True)
                        self.arrow([name], True, True)
                        return LOW
                    self.restore(saved)
        start_names = self.names_start()
        flags = self.conditional()
        if self.t == PUNCTUATOR:
            v = self.v
            if v == "=>" and not self.nl and flags & IDENT and not flags & PAREN:
                name = self.s[start_names : self.last]
                if not name.isascii() or "\\" in name:
                    name = _UNICODE_ESCAPE.sub(lambda x: chr(min(int(x.group(1) or x.group(2), 16), 0x10FFFF)), name)
                self.check_name(name, True)
                self.arrow([name], True, False)
                return LOW
            if v in ASSIGNMENTS:
                if v == "=":
                    if flags & PATTERN and not flags & PAREN:
                        pass
                    elif not flags & TARGET:
                        raise Bad
                elif not flags & TARGET:
                    raise Bad
                if flags & OPTIONAL:
                    raise Bad
                self.next()
                self.assignment_pure()
                return LOW | (DEFAULT | (flags & (BINDING | TARGET | PATTERN) if v == "=" else 0))
        return flags

    def names_start(self) -> int:
        return self.p

    def yield_(self) -> None:
        self.next()
        if self.nl:
            return
        if self.take("*"):
            self.assignment_pure()
        elif not (self.t == END or (self.t == PUNCTUATOR and self.v in (")", "]", "}", ",", ";", ":")) or (self.t == NAME and self.v in ("in", "of"))):
            self.operand_start()
            self.assignment_pure()

    def operand_start(self) -> None:
        """Nothing to do: a regular expression is read where the operand is parsed."""

    def arrow(self, names: list[str], simple: bool, is_async: bool) -> None:
        """`=>` and the body."""
        if len(set(names)) < len(names):
            raise Bad
        kept = self.asyncs, self.generator, self.function, self.loop, self.switch, self.labels, self.strict, self.no_in, self.no_suspending
        no_in = self.no_in
        self.asyncs, self.generator = is_async or (self.asyncs and self.module and not self.function and is_async), False
        self.no_suspending = False
        self.next()
        if self.is_("{"):
            self.function, self.loop, self.switch, self.labels, self.no_in = True, 0, 0, [], False
            self.need_body(names, simple, True, arrow=True)
            self.asyncs, self.generator, self.function, self.loop, self.switch, self.labels, self.strict, self.no_in, self.no_suspending = kept
            self.next()
        else:
            self.scopes.append(_Scope(True, set(names)))
            module_await = kept[0] and not kept[2] and self.module
            if module_await:
                self.asyncs = True if is_async else False
            self.no_in = no_in
            self.assignment_pure()
            self.scopes.pop()
            self.asyncs, self.generator, self.function, self.loop, self.switch, self.labels, self.strict, self.no_in, self.no_suspending = kept

    def conditional(self) -> int:
        flags = self.binary(0)
        if self.t == PUNCTUATOR and self.v == "?":
            if flags & COVER or flags & LOW:
                raise Bad
            self.next()
            self.inside(self.assignment_pure)
            self.need(":")
            self.assignment_pure()
            return 0
        return flags

    def binary(self, least: int) -> int:
        if self.t == PRIVATE:
            self.use_private()
            self.next()
            if not self.word("in") or self.no_in or least >= 8:
                raise Bad
            flags = 0
        else:
            flags = self.unary()
        while True:
            t, v = self.t, self.v
            if t != PUNCTUATOR and not (t == NAME and v in ("in", "instanceof") and not self.escaped):
                return flags
            power = BINARY.get(v)
            if power is None or power <= least or (v == "in" and self.no_in):
                return flags
            if flags & (COVER | LOW):
                raise Bad
            if v == "**" and flags & UNARY:
                raise Bad
            if v == "??" and flags & LOGICAL or v in ("||", "&&") and flags & NULLISH:
                raise Bad
            self.next()
            right = self.binary(power - 1 if v == "**" else power)
            if right & (COVER | LOW):
                raise Bad
            if v == "??":
                if right & LOGICAL:
                    raise Bad
                flags = NULLISH
            elif v in ("||", "&&"):
                if right & NULLISH:
                    raise Bad
                flags = LOGICAL
            else:
                flags = 0

    def unary(self) -> int:
        t, v = self.t, self.v
        if t == PUNCTUATOR and v in ("!", "~", "+", "-"):
            self.next()
            if self.unary() & (COVER | LOW):
                raise Bad
            return UNARY
        if t == PUNCTUATOR and v in ("++", "--"):
            self.next()
            flags = self.unary()
            if not flags & TARGET or flags & (OPTIONAL | LOW):
                raise Bad
            return 0
        if t == NAME and not self.escaped:
            if v in ("typeof", "void", "delete"):
                self.next()
                private = len(self.private)
                start = self.p
                flags = self.unary()
                if flags & (COVER | LOW):
                    raise Bad
                if v == "delete" and self.strict and flags & IDENT:
                    raise Bad
                if v == "delete" and private and re.search(r"\.\s*#[\w$]+\)*$", self.s[start : self.last]):
                    raise Bad
                return UNARY
            if v == "await" and self.asyncs:
                if self.no_suspending:
                    raise Bad
                self.next()
                if self.unary() & (COVER | LOW):
                    raise Bad
                return UNARY
        flags = self.left_hand()
        if self.t == PUNCTUATOR and self.v in ("++", "--") and not self.nl:
            if not flags & TARGET or flags & (OPTIONAL | LOW):
                raise Bad
            self.next()
            return 0
        return flags

    def use_private(self) -> None:
        if not self.private:
            raise Bad
        self.private[-1][1].append(self.v)

    def left_hand(self) -> int:
        start_async = self.word("async")
        if self.word("new"):
            flags = self.new()
        elif self.word("super"):
            self.next()
            if self.is_("("):
                if not self.constructor:
                    raise Bad
            elif not (self.is_(".") or self.is_("[")) or not self.method:
                raise Bad
            flags = 0
        elif self.word("import"):
            self.next()
            if self.take("."):
                if not self.word("meta") or not self.module:
                    raise Bad
                self.next()
            else:
                self.need("(")
                self.inside(self.assignment_pure)
                self.need(")")
            flags = 0
        else:
            flags = self.primary()
        if flags & LOW and not flags & PAREN:
            return flags
        return self.chain(flags, True, start_async)

    def chain(self, flags: int, calls: bool, start_async: bool = False) -> int:
        optional = 0
        while True:
            if self.t != PUNCTUATOR:
                return flags
            v = self.v
            if v == ".":
                if flags & COVER:
                    raise Bad
                self.next()
                if self.t == PRIVATE:
                    self.use_private()
                elif self.t != NAME:
                    raise Bad
                self.next()
                flags = TARGET | optional
            elif v == "[":
                if flags & COVER:
                    raise Bad
                self.next()
                self.inside(self.expression_pure)
                self.need("]")
                flags = TARGET | optional
            elif v == "(":
                if not calls:
                    return flags
                if flags & COVER:
                    raise Bad
                newline = self.nl
                if start_async and flags & IDENT and not newline:
                    arrow, names, simple = self.arguments(True)
                    if self.is_("=>") and not self.nl:
                        if not arrow or "await" in names:
                            raise Bad
                        self.arrow(names, simple, True)
                        return LOW
                    if arrow is None or self.pending:
                        raise Bad
                else:
                    self.arguments(False)
                start_async = False
                flags = optional
            elif v == "`":
                if flags & COVER or optional:
                    raise Bad
                self.template(tagged=True)
                flags = 0
            elif v == "?.":
                if flags & COVER or not calls:
                    raise Bad
                optional = OPTIONAL
                self.next()
                if self.is_("("):
                    self.arguments(False)
                    flags = optional
                elif self.is_("["):
                    self.next()
                    self.inside(self.expression_pure)
                    self.need("]")
                    flags = TARGET | optional
                elif self.t == PRIVATE:
                    self.use_private()
                    self.next()
                    flags = TARGET | optional
                elif self.t == NAME:
                    self.next()
                    flags = TARGET | optional
                else:
                    raise Bad
            else:
                return flags
            start_async = False

    def arguments(self, maybe_arrow: bool):
        """The arguments of a call. For `async (...)` whether they may be parameters, their names, and whether they are simple."""
        kept, self.no_in = self.no_in, False
        start = self.p
        self.next()
        binding, cover, simple = True, False, True
        while not self.is_(")"):
            rest = self.take("...")
            flags = self.assignment()
            if flags & COVER:
                cover = True
                if not maybe_arrow:
                    raise Bad
            if not flags & BINDING or (rest and flags & DEFAULT) or flags & PAREN:
                binding = False
            if not flags & IDENT or rest:
                simple = False
            if not self.is_(")"):
                self.need(",")
                if rest:
                    binding = False
        self.no_in = kept
        end = self.p
        self.next()
        if not maybe_arrow:
            return None
        self.pending = cover
        names = self.reread(start, end) if binding and self.is_("=>") else []
        return binding, names, simple

    def reread(self, start: int, end: int) -> list[str]:
        """The bound names of arrow parameters between these places, read again as a binding list."""
        saved = self.save()
        self.e = start + 1
        self.next()
        names: list[str] = []
        while self.p < end:
            self.take("...")
            self.binding(names)
            self.default()
            if self.p < end:
                self.need(",")
        self.restore(saved)
        return names

    def new(self) -> int:
        self.next()
        if self.take("."):
            if not self.word("target") or not (self.new_target or self.function and self.new_target):
                raise Bad
            self.next()
            return 0
        if self.word("new"):
            flags = self.new()
        elif self.word("import"):
            if self.peek()[1] != ".":
                raise Bad
            self.next()
            self.next()
            self.need("meta")
            flags = 0
        elif self.word("super"):
            if not self.method:
                raise Bad
            self.next()
            if not (self.is_(".") or self.is_("[")):
                raise Bad
            flags = 0
        else:
            flags = self.primary()
            if flags & LOW and not flags & PAREN:
                raise Bad
        flags = self.chain(flags, False)
        if flags & COVER:
            raise Bad
        if self.is_("("):
            self.arguments(False)
        return 0

    def template(self, tagged: bool = False) -> None:
        at = self.e
        while True:
            m = _TEMPLATE.match(self.s, at)
            if m is None:
                raise Bad
            if not tagged and "\\" in m.group(1) and (_BAD_ESCAPE.search(m.group(1)) or _OCTAL_ESCAPE.search(m.group(1))):
                raise Bad
            self.e = m.end()
            if m.group(2) == "`":
                self.next()
                return
            self.next()
            self.inside(self.expression_pure)
            if not self.is_("}"):
                raise Bad
            at = self.p + 1

    def primary(self) -> int:
        t, v = self.t, self.v
        if t == NAME:
            if not self.escaped:
                if v == "function":
                    return self.function_expression(False)
                if v == "class":
                    self.next()
                    self.class_(declaration=False)
                    return 0
                if v in ("this", "null", "true", "false"):
                    self.next()
                    return 0
                if v == "async":
                    following = self.peek()
                    if following[0] == NAME and following[1] == "function" and not following[2]:
                        self.next()
                        return self.function_expression(True)
            self.check_name(v, False)
            self.next()
            if self.strict and v in ("eval", "arguments"):
                return IDENT
            return TARGET | IDENT | BINDING
        if t in (NUMBER, STRING):
            self.next()
            return 0
        if t == PUNCTUATOR:
            if v == "(":
                return self.cover()
            if v == "[":
                return self.array()
            if v == "{":
                return self.object()
            if v == "`":
                self.template()
                return 0
            if v in ("/", "/="):
                m = _REGEX.match(self.s, self.p)
                if m is None or not regular(m.group(1), m.group(2)):
                    raise Bad
                self.e = m.end()
                self.next()
                return 0
        raise Bad

    def function_expression(self, is_async: bool) -> int:
        self.next()
        generator = self.take("*")
        name = None
        if self.t == NAME:
            name = self.v
            if name in RESERVED or (self.strict and (name in STRICT_RESERVED or name in ("eval", "arguments"))) or (name == "yield" and (generator or self.strict)) or (name == "await" and (is_async or self.module)):
                raise Bad
            self.next()
        self.function_rest(is_async, generator, name)
        return 0

    def cover(self) -> int:
        """A parenthesis: an expression, or the parameters of an arrow function."""
        start = self.p
        kept, self.no_in = self.no_in, False
        self.next()
        binding, only_arrow, cover, simple, count, flags = True, False, False, True, 0, 0
        while not self.is_(")"):
            if self.take("..."):
                only_arrow, simple = True, False
                self.binding([])
                if not self.is_(")"):
                    raise Bad
                break
            flags = self.assignment()
            count += 1
            cover |= bool(flags & COVER)
            binding &= bool(flags & BINDING) and not flags & PAREN
            simple &= bool(flags & IDENT)
            if self.is_(")"):
                break
            self.need(",")
            if self.is_(")"):
                only_arrow = True
        self.no_in = kept
        end = self.p
        self.next()
        if self.is_("=>") and not self.nl:
            if not binding:
                raise Bad
            names = self.reread(start, end)
            self.arrow(names, simple, False)
            return LOW
        if only_arrow or cover or not count:
            raise Bad
        if count > 1:
            return PAREN
        return (flags & (TARGET | IDENT | OPTIONAL if not flags & (LOW | DEFAULT) else 0)) | (PATTERN if flags & PATTERN and not flags & DEFAULT else 0) | PAREN

    def array(self) -> int:
        kept, self.no_in = self.no_in, False
        self.next()
        pattern, binding, cover = True, True, 0
        while not self.is_("]"):
            if self.take(","):
                continue
            rest = self.take("...")
            flags = self.assignment()
            cover |= flags & COVER
            if not self.element_flags(flags, rest):
                pattern = False
            if not flags & BINDING or flags & PAREN:
                binding = False
            if not self.is_("]"):
                self.need(",")
                if rest:
                    pattern = False
        self.no_in = kept
        self.next()
        if not pattern and cover:
            raise Bad
        return cover | (PATTERN if pattern else 0) | (BINDING if pattern and binding else 0)

    @staticmethod
    def element_flags(flags: int, rest: bool) -> bool:
        """Whether an element or value may be part of an assignment pattern."""
        if flags & OPTIONAL and not flags & DEFAULT:
            return False
        if flags & DEFAULT:
            return not rest and bool(flags & (TARGET | PATTERN))
        if flags & PATTERN and flags & PAREN:
            return False
        return bool(flags & (TARGET | PATTERN)) and not flags & LOW

    def object(self) -> int:
        kept, self.no_in = self.no_in, False
        self.next()
        pattern, binding, cover, proto = True, True, 0, 0
        while not self.is_("}"):
            if self.take("..."):
                flags = self.assignment()
                if flags & COVER:
                    raise Bad
                if not flags & TARGET or flags & (DEFAULT | OPTIONAL | LOW):
                    pattern = False
                if not flags & IDENT or flags & PAREN:
                    binding = False
                if not self.is_("}"):
                    self.need(",")
                    pattern = False
                continue
            is_async = generator = False
            kind = ""
            if self.word("async"):
                following = self.peek()
                if not (following[0] == PUNCTUATOR and following[1] in ("(", ",", ":", "}", "=")) and not following[2]:
                    is_async = True
                    self.next()
            if self.take("*"):
                generator = True
            elif not is_async and (self.word("get") or self.word("set")):
                following = self.peek()
                if not (following[0] == PUNCTUATOR and following[1] in ("(", ",", ":", "}", "=", "*")):
                    kind = self.v
                    self.next()
            t, v, escaped = self.t, self.v, getattr(self, "escaped", False)
            name = self.property_name()
            if self.is_("("):
                self.function_rest(is_async, generator, method=True, arity={"get": 0, "set": 1}.get(kind))
                pattern = binding = False
            elif is_async or generator or kind:
                raise Bad
            elif self.take(":"):
                if name == "__proto__":
                    proto += 1
                flags = self.assignment()
                cover |= flags & COVER
                pattern &= self.element_flags(flags, False)
                binding &= bool(flags & BINDING) and not flags & PAREN
            else:
                if t != NAME:
                    raise Bad
                self.check_name(v, False)
                if self.strict and v in ("eval", "arguments"):
                    pattern = binding = False
                if self.is_("="):
                    self.next()
                    self.assignment_pure()
                    cover = COVER
            if not self.is_("}"):
                self.need(",")
        self.no_in = kept
        self.next()
        if proto > 1:
            if not self.is_("=") or not pattern:
                raise Bad
        if not pattern and cover:
            raise Bad
        return cover | (PATTERN if pattern else 0) | (BINDING if pattern and binding else 0)


_STATEMENTS = {
    "var": Parser.s_var, "if": Parser.s_if, "for": Parser.s_for, "while": Parser.s_while, "do": Parser.s_do, "break": Parser.s_jump, "continue": Parser.s_jump, "return": Parser.s_return,
    "throw": Parser.s_throw, "with": Parser.s_with, "debugger": Parser.s_debugger, "switch": Parser.s_switch, "try": Parser.s_try,
}

_ATOM = re.compile(r"\\(?:[dDsSwWbBfnrtv0]|c[A-Za-z]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|k<[^>]+>|[pP]\{[\w=]+\}|[1-9][0-9]*|.)|\[\^?(?:[^\]\\]|\\.)*\]|\((?:\?(?:[:=!]|<[=!]|<([^>]*)>))?|[\s\S]", re.S)
_QUANTIFIER = re.compile(r"(?:[*+?]|\{([0-9]+)(?:(,)([0-9]*))?\})\??")


def regular(pattern: str, flags: str) -> bool:
    """Whether a regular expression literal is well formed: groups, quantifiers, ranges and flags."""
    if len(set(flags)) < len(flags) or not set(flags) <= set("dgimsuy"):
        return False
    unicode, depth, at, groups = "u" in flags, [], 0, set()
    can_repeat = False
    while at < len(pattern):
        m = _QUANTIFIER.match(pattern, at)
        if m and (pattern[at] != "{" or m):
            if not can_repeat:
                return False
            if m.group(3) and int(m.group(3)) < int(m.group(1)):
                return False
            at, can_repeat = m.end(), False
            continue
        m = _ATOM.match(pattern, at)
        atom, at = m.group(), m.end()
        if atom[0] == "(":
            if atom == "(" and pattern.startswith("?", at):
                return False
            if m.group(1) is not None:
                if m.group(1) in groups or not m.group(1).replace("$", "_").isidentifier():
                    return False
                groups.add(m.group(1))
            depth.append(atom)
            can_repeat = False
        elif atom == ")":
            if not depth:
                return False
            opened = depth.pop()
            can_repeat = not opened.startswith("(?<=") and not opened.startswith("(?<!") and not (unicode and opened in ("(?=", "(?!"))
        elif atom in ("|", "^", "$"):
            can_repeat = False
        elif atom in ("\\b", "\\B"):
            can_repeat = False
        else:
            if atom == "[" or (unicode and atom in ("{", "}", "]")):
                return False
            if atom[0] == "[" and _bad_range(atom):
                return False
            if unicode and atom[0] == "\\" and len(atom) == 2 and atom[1].isalpha() and atom[1] not in "dDsSwWfnrtv":
                return False
            can_repeat = True
    return not depth


_CLASS_ATOM = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]+)\}|(.))|([\s\S])")


def _bad_range(atom: str) -> bool:
    inside = atom[1:-1].removeprefix("^")
    parts: list[int | None] = []
    for m in _CLASS_ATOM.finditer(inside):
        code = m.group(1) or m.group(2) or m.group(3)
        if code:
            parts.append(int(code, 16))
        elif m.group(4):
            parts.append(None if m.group(4) in "dDsSwWpP" or m.group(4).isdigit() else ord({"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "b": "\b"}.get(m.group(4), m.group(4))))
        else:
            parts.append(ord(m.group(5)) if m.group(5) != "-" else -1)
    i = 0
    while i + 2 < len(parts):
        if parts[i + 1] == -1 and parts[i] is not None and parts[i + 2] is not None:
            low, high = (45 if x == -1 else x for x in (parts[i], parts[i + 2]))
            if low > high:
                return True
            i += 3
        else:
            i += 1
    return False
