"""Lexical measures of Rust sources."""

from __future__ import annotations

import re

from graphloom.lang.tokens import nesting, scan

BLOCKS = {"if", "for", "while", "loop", "match"}


def stripped(text: str) -> str:
    """The text without comments, and with empty strings; lifetimes are no strings."""
    text = re.sub(r'(?s)\br(#*)".*?"\1', '""', text)
    out, i = [], 0
    while i < len(text):
        if text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif text.startswith("/*", i):
            depth, i = 1, i + 2  # block comments nest
            while i < len(text) and depth:
                step = {"/*": 1, "*/": -1}.get(text[i : i + 2], 0)
                depth += step
                i += 2 if step else 1
        elif text[i] == '"':
            m = re.compile(r'"(?:\\.|[^"\\])*"?', re.S).match(text, i)
            out.append('""')
            i = m.end()
        elif m := re.compile(r"'(?:\\[^']*|[^'\\])'").match(text, i):
            out.append("' '")
            i = m.end()
        elif text[i] == "'":
            i += 1  # a lifetime
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def functions(text: str) -> int:
    return len(re.findall(r"\bfn\s+[A-Za-z_]\w*", stripped(text)))


def depth(text: str) -> int:
    return nesting(scan(stripped(text).replace("' '", "0")), BLOCKS)
