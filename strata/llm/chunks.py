"""Cached encoding of texts that are cut where the tokenizer would cut them anyway."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: White space other than blank and line feed, and neighbouring white space, decide how a pattern groups it.
RARE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]")
NEIGHBOURS = ("  ", "\n\n", " \n", "\n ")


class Cache:
    """Piece to encoded bytes, in two generations: when the young one is full it becomes the old one, and what is still
    in use moves over again. So memory is bounded and nothing is ever wrong, only encoded once more."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], most: int = 300_000) -> None:
        self.encode, self.most = encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ready(self, pieces: set[str]) -> dict[str, bytes]:
        """A dictionary that holds all these pieces."""
        if len(self.young) + len(pieces) > self.most and self.young:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for p in pieces.difference(young):
            if (b := old.get(p)) is None:
                new.append(p)
            else:
                young[p] = b
        if new:
            young.update(zip(new, self.encode(new), strict=True))
        return young


def plain(text: str) -> bool:
    """Whether every white space character stands alone and is a blank or a line feed."""
    return not any(x in text for x in NEIGHBOURS) and not RARE.search(text)


#: A longer text is handled in portions, each but the first of which begins with a blank.
PORTION = 2_000_000


def portions(text: str, size: int | None = None) -> Iterable[str]:
    """Cuts before blanks about every ``size`` characters; one portion if there is no blank."""
    size = size or PORTION
    at = 0
    while len(text) - at > size:
        cut = text.rfind(" ", at + 1, at + size)
        if cut < 0 and (cut := text.find(" ", at + size)) < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def groups(texts: list[str], rows: int = 256, size: int = 500_000) -> Iterable[tuple[int, int]]:
    """Ranges of texts of bounded number and length (a longer text stands alone)."""
    at = total = 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= rows or total + len(t) > size):
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)
