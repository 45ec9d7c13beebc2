"""One tokenizer for the texts of datasheets and pages: numbers, words, and single signs with their places."""

from __future__ import annotations

import re
from typing import NamedTuple

#: A number with one decimal sign, a run of letters, a run of dots, or any other sign but white space.
PIECE = re.compile(r"\d+(?:[.,]\d+)?|[^\W\d_]+|\.{2,}|\S")


class Token(NamedTuple):
    text: str  # in lower case
    start: int
    end: int

    @property
    def is_number(self) -> bool:
        return self.text[0].isdigit()


def tokens(text: str) -> list[Token]:
    return [Token(m[0].casefold(), m.start(), m.end()) for m in PIECE.finditer(text)]


def word_at(text: str, place: int) -> bool:
    """Is there a letter, digit or underscore at a place?"""
    return 0 <= place < len(text) and (text[place].isalnum() or text[place] == "_")


def codes(text: str, joints: str, least: int = 1) -> list[tuple[str, int, int]]:
    """Runs of ASCII letters and digits, parts of `least` characters or more in front, joined by single `joints`: text, start, end.

    A run that touches another ASCII letter or digit is none; what follows a double joint is a run of its own."""
    out: list[tuple[str, int, int]] = []
    at, size = 0, len(text)
    while at < size:
        if not plain(text[at]):
            at += 1
            continue
        start = at
        while at < size and (plain(text[at]) or text[at] in joints and at + 1 < size and plain(text[at + 1])):
            at += 1
        first = next((k for k in range(start, at) if text[k] in joints), at)
        if first - start >= least:
            out.append((text[start:at], start, at))
        elif first < at:  # the first part is too short: go on behind its joint
            at = first + 1
    return out


def plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def mixed(code: str) -> bool:
    """Does a code have both letters and digits?"""
    return any(c.isalpha() for c in code) and any(c.isdigit() for c in code)
