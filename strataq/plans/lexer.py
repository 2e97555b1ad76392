"""Tokens of the statement language."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, text, number, op, symbol, param
    text: str

    def is_(self, *words: str) -> bool:
        return self.kind == "word" and self.text.upper() in words


_TOKEN = re.compile(
    r"""\s+|--[^\n]*
    |(?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")
    |(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<param>\$\d+|[:@][A-Za-z_]\w*)
    |(?P<word>[A-Za-z_][\w.\-]*)
    |(?P<op><>|!=|<=|>=|==|=|<|>)
    |(?P<symbol>[(),;*])""",
    re.X,
)


def lex(statement: str) -> list[Token]:
    """Tokens without spaces; a character that starts none raises ValueError."""
    out, at = [], 0
    while at < len(statement):
        m = _TOKEN.match(statement, at)
        if not m:
            raise ValueError(f"unexpected {statement[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            text = m[m.lastgroup]
            if m.lastgroup == "text":
                text = text[1:-1].replace(text[0] * 2, text[0])
            out.append(Token(m.lastgroup, text))
    return out
