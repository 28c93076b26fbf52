"""What the hand-written parsers share."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Tokens that are read at once.
AHEAD = 64


class Broken(Exception):
    """The text does not follow the grammar."""


class Cursor:
    """A list of tokens and the place in it. A token is its text, or the class of a name or literal.

    `more` reads on: a generator that appends to the list, so that a text that
    breaks the grammar early is not read to its end. What it raises stays raised.
    """

    def __init__(self, tokens: list[str], more: Iterator[None] | None = None) -> None:
        self.toks, self.more = tokens, more
        self.broken: Broken | None = None
        self.i = 0
        self.reach(0)
        self.t = tokens[0]

    def reach(self, i: int) -> None:
        """Reads on until there is a token number `i`, or the end."""
        if self.broken is not None:
            raise self.broken
        try:
            while self.more is not None and len(self.toks) <= i:
                if next(self.more, self) is self:
                    self.more = None
        except Broken as e:
            self.broken = e
            raise

    def step(self) -> str:
        old = self.t
        i = self.i = self.i + 1
        try:
            self.t = self.toks[i]
        except IndexError:
            self.reach(i)
            if i >= len(self.toks):
                raise Broken("end") from None
            self.t = self.toks[i]
        return old

    def peek(self, n: int = 1) -> str:
        j = self.i + n
        if j >= len(self.toks):
            self.reach(j)
        return self.toks[j] if j < len(self.toks) else "EOF"

    def back(self, i: int) -> None:
        self.i = i
        self.t = self.toks[i]

    def fail(self, what: str = "") -> None:
        raise Broken(f"token {self.i} {self.t!r} {what}")

    def need(self, t: str) -> None:
        if self.t != t:
            self.fail(f"needs {t}")
        self.step()

    def take(self, t: str) -> bool:
        if self.t == t:
            self.step()
            return True
        return False

    def attempt(self, f) -> bool:
        """Whether `f` succeeds; the place is restored if not."""
        at = self.i
        try:
            f()
            return True
        except Broken:
            self.back(at)
            return False


def master(*parts: tuple[str, str]) -> re.Pattern[str]:
    return re.compile("|".join(f"(?P<{n}>{p})" for n, p in parts), re.S)
