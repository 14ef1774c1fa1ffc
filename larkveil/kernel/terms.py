"""Whole-word search for many terms at once: leftmost, then longest, without overlaps."""

from __future__ import annotations

import re
from collections.abc import Iterable

from larkveil.kernel.text import lower


def _heads(heads: set[str]) -> str:
    """A pattern for any of some short strings, branching by character."""
    by_first: dict[str, set[str]] = {}
    for h in heads:
        by_first.setdefault(h[0], set()).add(h[1:])
    return "|".join(re.escape(c) + ("" if "" in rest else f"(?:{_heads(rest)})") for c, rest in sorted(by_first.items()))


class TermFinder:
    """Terms by their first characters; at each word start the lengths that occur there are tried, longest first."""

    HEAD = 3

    def __init__(self, terms: Iterable[tuple[str, object]], genitive: Iterable[object] = ()):
        """terms: (term, what it stands for), a later equal term wins. genitive: what may have an s after it."""
        self.what: dict[str, object] = {folded: w for t, w in terms if (folded := lower(t))}
        self.genitive = set(genitive)
        lengths: dict[str, set[int]] = {}
        for t in self.what:
            lengths.setdefault(t[: self.HEAD], set()).add(len(t))
        self.lengths = {h: sorted(x, reverse=True) for h, x in lengths.items()}
        # where a word begins as some term does
        self.starts = re.compile(r"(?<![^\W_])(?:" + _heads(set(lengths)) + ")") if self.what else None
        self.heads = sorted({len(h) for h in lengths}, reverse=True)

    def single_words(self) -> bool:
        """Whether every term is one run of letters, so that no two can overlap."""
        return all(t.isalpha() for t in self.what)

    def find_at(self, text: str, low: str, starts: Iterable[int]) -> list[tuple[int, int, object]]:
        """The terms that begin at some word starts; ``low``: the text in lower case. For terms that are single words."""
        own = self.lengths
        return [(i, *hit) for i in starts if (low[i : i + 3] in own or low[i : i + 2] in own or low[i : i + 1] in own) and (hit := self._at(text, low, i))]

    def find(self, text: str) -> list[tuple[int, int, object]]:
        low, out, free = lower(text), [], 0
        for m in self.starts.finditer(low) if self.what else ():
            i = m.start()
            if i >= free and not (i and text[i - 1].isalnum()) and (hit := self._at(text, low, i)):
                out.append((i, *hit))
                free = hit[0]
        return out

    def _at(self, text: str, low: str, i: int) -> tuple[int, object] | None:
        best: tuple[int, object] | None = None
        longest = 0
        for h in self.heads:
            for length in self.lengths.get(low[i : i + h], ()) if i + h <= len(low) else ():
                if h < self.HEAD and length != h or length <= longest:
                    continue
                what = self.what.get(low[i : i + length])
                end = None if what is None or i + length > len(text) else self._end(text, low, i + length, what)
                if end is not None:
                    best, longest = (end, what), length
                    break
        return best

    def _end(self, text: str, low: str, at: int, what: object) -> int | None:
        free = lambda i: i >= len(text) or not text[i].isalnum()
        if free(at):
            return at
        if what in self.genitive and low[at] == "s" and free(at + 1):
            return at + 1
        return None
