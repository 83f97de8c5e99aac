"""Tokens and statements of step programs, shared by the translator and by the analysis of programs."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Token:
    kind: str  # name, num, str, ref (&name), macro (%name), op
    text: str
    start: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower()

    @property
    def value(self) -> str:
        """A string without its quotes."""
        return self.text[1:-1].replace(self.text[0] * 2, self.text[0]) if self.kind == "str" else self.text


@dataclass(frozen=True)
class Statement:
    text: str
    tokens: tuple[Token, ...]
    line: int

    @property
    def head(self) -> str:
        return self.tokens[0].low if self.tokens else ""


_LEX = re.compile(
    r"""(?P<space>\s+)|(?P<comment>/\*.*?(?:\*/|\Z))|(?P<str>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)"""
    r"""|(?P<macro>%\w+)|(?P<ref>&+\w+\.?)|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|\^=|~=|<>|\|\||\*\*|.)""",
    re.S,
)


def tokens(code: str) -> list[Token]:
    """Tokens without space and block comments."""
    return [Token(m.lastgroup, m[0], m.start(), m.end()) for m in _LEX.finditer(code) if m.lastgroup not in ("space", "comment")]


def statements(code: str) -> list[Statement]:
    """Statements without their semicolons; a semicolon inside quotes or a block comment ends none, and a statement that
    begins with a star, or a percent sign and a star, is a comment."""
    out, held = [], []
    for t in [*tokens(code), Token("op", ";", len(code), len(code))]:
        if t.text != ";" or t.kind != "op":
            held.append(t)
            continue
        starred = held and held[0].kind == "op" and held[0].text.lstrip("%").startswith("*") or len(held) > 1 and held[0].text == "%" and held[1].text.startswith("*")
        if held and not starred:
            text = "".join((" " if a and a.end < b.start else "") + b.text for a, b in zip([None, *held], held))
            out.append(Statement(text, tuple(held), code.count("\n", 0, held[0].start) + 1))
        held = []
    return out


def name_at(items: tuple[Token, ...], at: int) -> tuple[str, int]:
    """A table name that starts at a token, parts and macro references joined as written; and the place after it."""
    first = at
    while at < len(items) and (items[at].kind in ("name", "ref", "num") or items[at].text == ".") and (at == first or items[at].start == items[at - 1].end):
        at += 1
    return "".join(t.text for t in items[first:at]).lower().rstrip("."), at


def closing(items: tuple[Token, ...], at: int) -> int:
    """The place of the bracket that closes the one at a place; the end if none does."""
    depth = 0
    for i in range(at, len(items)):
        depth += (items[i].text == "(") - (items[i].text == ")")
        if not depth:
            return i
    return len(items)
