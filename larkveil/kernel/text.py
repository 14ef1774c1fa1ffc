"""Projections of a text that keep track of where each character came from."""

from __future__ import annotations

import functools
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right


class Aligned:
    """A projection: its text, and for each character the start and end of what it stands for."""

    def __init__(self, text: str, starts: array, ends: array):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]

    def place(self, start: int, end: int) -> tuple[int, int]:
        """Where a span of the text stands in the projection."""
        return bisect_right(self.ends, start), bisect_left(self.starts, end)




@functools.cache
def _touched() -> re.Pattern[str]:
    """Format characters and spaces other than the plain one."""
    own = [c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) in ("Cf", "Zs")]
    return re.compile("[" + "".join(map(re.escape, own)) + "]")


def normalized(text: str) -> Aligned | None:
    """Without invisible format characters, with plain spaces and composed letters; None if nothing changes."""
    if text.isascii() or (unicodedata.is_normalized("NFC", text) and not _touched().search(text)):
        return None
    out: list[str] = []
    starts, ends = array("l"), array("l")
    i, n = 0, len(text)
    while i < n:
        c, j = text[i], i + 1
        if ord(c) < 128 and (j == n or ord(text[j]) < 128):  # most of a text: a plain character before a plain one
            out.append(c)
        else:
            kind = unicodedata.category(c)
            if kind == "Cf":
                i = j
                continue
            while j < n and unicodedata.combining(text[j]):
                j += 1
            out.append(" " if kind == "Zs" else unicodedata.normalize("NFC", text[i:j]))
        k = len(out[-1])
        starts.extend([i] * k)
        ends.extend([j] * k)
        i = j
    joined = "".join(out)
    return None if joined == text else Aligned(joined, starts, ends)


def one_spaced(text: str) -> Aligned:
    """Every run of white space as one space, which stands for the run's first character."""
    parts, at = [], array("l")
    for m in re.finditer(r"\s+|\S+", text):
        run = m[0]
        if run[0].isspace():
            parts.append(" ")
            at.append(m.start())
        else:
            parts.append(run)
            at.extend(range(m.start(), m.end()))
    return Aligned("".join(parts), at, array("l", (i + 1 for i in at)))


def digits_of(text: str) -> Aligned:
    at = array("l", (i for i, c in enumerate(text) if c.isdigit()))
    return Aligned("".join(text[i] for i in at), at, array("l", (i + 1 for i in at)))


def same(value: str) -> str:
    """The form under which two mentions are one value."""
    return " ".join(unicodedata.normalize("NFKC", value).casefold().split())


def lower(text: str) -> str:
    """Lower case that keeps every character's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def plain_umlauts(value: str) -> str:
    return value.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss")
