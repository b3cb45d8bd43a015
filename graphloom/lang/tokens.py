"""A token scanner for brace languages."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, string, number, mark
    text: str
    line: int
    start: int
    end: int


_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$]*")
_NUMBER = re.compile(r"\d[\w.]*")
_MARK = re.compile(r"=>|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\?\.|:=|<-|\+\+|--|[-+*/%]=|.", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\n\\])*\]|[^/\n\\\[])+/[a-z]*")
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^<>") | {"=>", "==", "===", "!=", "!==", "&&", "||", "??", "return", "typeof", "case"}


def scan(text: str, go: bool = False) -> list[Token]:
    """Tokens without comments and white space; a template is one string."""
    out: list[Token] = []
    i, n, line = 0, len(text), 1
    while i < n:
        c = text[i]
        if c == "\n":
            line += 1
            i += 1
        elif c.isspace():
            i += 1
        elif text.startswith("//", i):
            end = text.find("\n", i)
            i = n if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            line += text.count("\n", i, end)
            i = end
        elif c in "\"'`":
            end = _string_end(text, i, raw=go and c == "`")
            out.append(Token("string", text[i:end], line, i, end))
            line += text.count("\n", i, end)
            i = end
        elif m := _NAME.match(text, i):
            out.append(Token("name", m[0], line, i, m.end()))
            i = m.end()
        elif m := _NUMBER.match(text, i):
            out.append(Token("number", m[0], line, i, m.end()))
            i = m.end()
        elif not go and c == "/" and (not out or out[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(text, i)):
            out.append(Token("string", m[0], line, i, m.end()))
            i = m.end()
        else:
            m = _MARK.match(text, i)
            out.append(Token("mark", m[0], line, i, m.end()))
            i = m.end()
    return out


def _string_end(text: str, i: int, raw: bool) -> int:
    quote, j = text[i], i + 1
    while j < len(text):
        c = text[j]
        if c == "\\" and not raw:
            j += 2
        elif c == quote:
            return j + 1
        elif c == "\n" and quote != "`":
            return j
        elif quote == "`" and not raw and text.startswith("${", j):
            depth, j = 1, j + 2
            while j < len(text) and depth:
                if text[j] in "\"'`":
                    j = _string_end(text, j, False)
                    continue
                depth += {"{": 1, "}": -1}.get(text[j], 0)
                j += 1
        else:
            j += 1
    return len(text)


_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def match(tokens: list[Token], i: int) -> int:
    """The place of the bracket that closes the one at i; the end if none does."""
    depth = 0
    for j in range(i, len(tokens)):
        if tokens[j].kind == "mark":
            if tokens[j].text in _OPEN:
                depth += 1
            elif tokens[j].text in _CLOSE:
                depth -= 1
                if not depth:
                    return j
    return len(tokens) - 1


def unquote(token: Token) -> str:
    return token.text[1:-1]


def nesting(tokens: list[Token], keywords: set[str]) -> int:
    """How deep blocks of the keywords stand in each other."""
    deepest, stack, pending = 0, [], False
    for t in tokens:
        if t.kind == "name" and t.text in keywords:
            pending = True
        elif t.text == "{" and t.kind == "mark":
            stack.append(pending)
            pending = False
            deepest = max(deepest, sum(stack))
        elif t.text == "}" and t.kind == "mark" and stack:
            stack.pop()
        elif t.text == ";" and t.kind == "mark":
            pending = False
    return deepest
