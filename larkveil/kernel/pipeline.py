"""From a text to findings, tokens, leaks and back."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from larkveil.kernel.hits import Entity, Hit
from larkveil.kernel.link import correlate, settle
from larkveil.kernel.recognize import Context, Dictionaries, Known, Patterns
from larkveil.kernel.structured import Structured
from larkveil.kernel.text import digits_of, normalized, one_spaced, same
from larkveil.plans.catalog import PERSON_LABEL, Settings

# --- Fixed values: formats of tokens ---
TOKEN = r"<([A-Z][A-Z_]*?)_(\d{3,})>"
TOKEN_OR_MARK = r"<[A-Z][A-Z_]*?_(?:\d{3,}|REDACTED)>"
LENIENT_TOKEN = (
    r"(?<![\w>])(?=[`\"'<])(?P<quote>[`\"'])?(?P<bracket><)?(?P<name>[A-Za-z][A-Za-z_]*?_\d{3,})(?(bracket)>)(?(quote)(?P=quote))(?!\w)"
)
GENDERS = ("female", "male")
LEAST_FUZZY, LEAST_DIGITS = 4, 6
KEPT_RESULTS = 256
# --- End of fixed values ---

_TOKEN, _TOKEN_OR_MARK, _LENIENT = map(re.compile, (TOKEN, TOKEN_OR_MARK, LENIENT_TOKEN))


class RestoreError(ValueError):
    """A token that the session doesn't know, or an unknown mode."""


@dataclass
class Report:
    hits: list[Hit]
    entities: dict[str, Entity]
    by_stage: dict[str, int]


@dataclass
class Assignment:
    token: str
    cls: str
    entity: str | None
    spans: list[tuple[int, int]]
    attrs: dict[str, str]


@dataclass
class Entry:
    """What a token stands for; forms in the order they occurred."""

    cls: str
    value: str
    forms: list[str] = field(default_factory=list)
    attrs: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True, order=True)
class Leak:
    kind: str
    cls: str
    start: int
    end: int


class Detector:
    """All stages for one configuration; made once for each Python worker."""

    def __init__(self, settings: Settings, extra: Iterable[Callable[[str, list[Hit]], list[Hit]]] = ()):
        self.settings = settings
        self.structured, self.patterns, self.dictionaries, self.context = (kind(settings) for kind in (Structured, Patterns, Dictionaries, Context))
        self.extra = list(extra)

    def detect(self, text: str, known: Known | None = None, uncovered: Iterable[Hit] = ()) -> Report:
        """All findings; ``uncovered``: what shows only once others are replaced (see ``uncovered``)."""
        aligned = normalized(text)
        own = aligned.text if aligned else text
        hits: list[Hit] = []
        by_stage: dict[str, int] = {}
        stages = [("session", lambda t, _: known.find(t))] if known and known.forms else []
        stages += [("structured", lambda t, _: self.structured.find(t)), ("pattern", lambda t, _: self.patterns.find(t)), ("dictionary", lambda t, _: self.dictionaries.find(t)), ("context", self.context.find)]
        stages += [(getattr(f, "__name__", "extra"), f) for f in self.extra]
        for name, stage in stages:
            new = stage(own, hits)
            by_stage[name] = len(new)
            hits = hits + new
        for h in uncovered:
            more = h.moved(0)
            if aligned:
                for x in (more, *more.parts):
                    x.start, x.end = aligned.place(x.start, x.end)
            hits = [*hits, more]
        entities = correlate(own, hits)
        # correlation may have raised a confidence, so weak findings go only now
        kept = settle([h for h in hits if h.conf >= self.settings.min_confidence], self.settings)
        if aligned:
            for h in kept:
                for x in (h, *h.parts):
                    x.start, x.end = aligned.span(x.start, x.end)
            for e in entities.values():
                e.spans = [aligned.span(*s) for s in e.spans]
        return Report(kept, entities, by_stage)


def rewrite(text: str, report: Report, settings: Settings, counters: dict[str, int]) -> tuple[str, list[Assignment]]:
    """Tokens in place of findings; counters by label go on from what is given."""
    changes, assigned = replacements(text, report, settings, counters)
    return replaced(text, changes), assigned


def replaced(text: str, changes: Sequence[tuple[int, int, str]]) -> str:
    pieces, at = [], 0
    for start, end, new in changes:
        pieces += [text[at:start], new]
        at = end
    return "".join([*pieces, text[at:]])


def uncovered(changes: Sequence[tuple[int, int, str]], found: Iterable[Hit]) -> list[Hit]:
    """Findings in a rewritten text that touch no replacement, at their places in the text that it was made from.

    A pattern may take in a neighbour's characters (a card number and the address after it) and then be no valid value;
    once the neighbour is replaced, the value shows.
    """
    gaps, at, by = [], 0, 0
    for start, end, new in changes:
        gaps.append((at, start - by, by))
        at = start - by + len(new)
        by = end - at
    gaps.append((at, float("inf"), by))
    begins = [g[0] for g in gaps]
    out = []
    for h in found:
        _, end, by = gaps[max(0, bisect_right(begins, h.start) - 1)]
        if h.end <= end:
            out.append(h.moved(by))
    return out


def replacements(text: str, report: Report, settings: Settings, counters: dict[str, int]) -> tuple[list[tuple[int, int, str]], list[Assignment]]:
    """Start, end and new text of each finding that is replaced, in order, and the tokens given."""
    reserved: dict[str, set[int]] = {}
    for m in _TOKEN.finditer(text):
        label, _, gender = m[1].rpartition("_")
        base = PERSON_LABEL if label == PERSON_LABEL and gender.lower() in GENDERS else m[1]
        reserved.setdefault(base, set()).add(int(m[2]))

    def key(h: Hit) -> object:
        return h.entity or (h.cls, same(text[h.start : h.end]))

    known: dict[object, str] = {}
    for h in report.hits:
        if "token" in h.attrs:
            known.setdefault(key(h), h.attrs["token"])
    given: dict[object, Assignment] = {}
    changes = []
    for h in report.hits:  # in order and without overlaps
        cls = settings.classes[h.cls]
        if cls.policy == "ignore":
            continue
        if cls.policy == "redact":
            new = f"<{cls.name}_REDACTED>"
        else:
            k = key(h)
            if k not in given:
                entity = report.entities.get(h.entity or "")
                attrs = h.attrs | (entity.attrs if entity else {})
                if k in known:
                    token, attrs = known[k], attrs | {"reused": "true"}
                else:
                    number = counters.get(cls.label, 0) + 1
                    while number in reserved.get(cls.label, ()):
                        number += 1
                    counters[cls.label] = number
                    gender = f"_{attrs['gender'].upper()}" if cls.label == PERSON_LABEL and attrs.get("gender") in GENDERS else ""
                    token = f"<{cls.label}{gender}_{number:03d}>"
                given[k] = Assignment(token, h.cls, h.entity, [], attrs)
            given[k].spans.append((h.start, h.end))
            new = given[k].token
        changes.append((h.start, h.end, new))
    return changes, list(given.values())


def _places(text: str, value: str, views: dict) -> set[tuple[int, int]]:
    """Where a value still stands, also with other spaces or other groups of digits."""
    if len(value) < LEAST_FUZZY:
        return {m.span() for m in re.finditer(rf"(?<!\w){re.escape(value)}(?!\w)", text)} if value else set()
    digits = "".join(c for c in value if c.isdigit())

    def search(needle: str, where: str, as_word: bool) -> Iterable[tuple[int, int]]:
        before = r"(?<![^\W_])" if as_word and needle[:1].isalnum() else ""
        after = r"s?(?![^\W_])" if as_word and needle[-1:].isalnum() else ""
        return (m.span() for m in re.finditer(f"(?i){before}{re.escape(needle)}{after}", where) if m.end() > m.start())

    out = set(search(value, text, not digits))
    spaced = views.get("spaced") or views.setdefault("spaced", one_spaced(text))
    needle = " ".join(re.split(r"\s+", value)).strip()
    if needle:
        out |= {spaced.span(*s) for s in search(needle, spaced.text, not digits)}
    if len(digits) >= LEAST_DIGITS:
        only = views.get("digits") or views.setdefault("digits", digits_of(text))
        out |= {only.span(*s) for s in search(digits, only.text, False)}
    return out


def union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one; spans that touch stay apart."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def residue(text: str, detector: Detector, known: Known | None = None, hits: Iterable[Hit] | None = None) -> list[Hit]:
    """Findings of a rewritten text (``hits``, if known) outside its tokens."""
    tokens = [m.span() for m in _TOKEN_OR_MARK.finditer(text)]
    out = []
    for h in detector.detect(text, known).hits if hits is None else hits:
        cls = detector.settings.classes.get(h.cls)
        if not (cls and cls.policy == "ignore") and not any(s <= h.start and h.end <= e for s, e in tokens):
            out.append(h)
    return out


def leaks(text: str, entries: Mapping[str, Entry], detector: Detector, known: Known | None = None, left: Iterable[Hit] | None = None) -> list[Leak]:
    """What a rewritten text still tells: findings outside tokens (``left``, if known), values of the session, unknown tokens."""
    found = [Leak("residual_finding", h.cls, h.start, h.end) for h in (residue(text, detector, known) if left is None else left)]
    views: dict = {}
    for entry in entries.values():
        spans: set[tuple[int, int]] = set()
        for value in {entry.value, *entry.forms}:
            spans |= _places(text, value, views)
        found += [Leak("original_value", entry.cls, *s) for s in union(spans)]
    found += [Leak("unknown_token", "", *m.span()) for m in _TOKEN.finditer(text) if m[0] not in entries]
    return list(dict.fromkeys(found))


def restore(text: str, entries: Mapping[str, Entry], mode: str = "strict") -> tuple[str, int, list[str]]:
    """Text with values, how many tokens were replaced, unknown tokens (lenient; strict raises)."""
    if mode not in ("strict", "lenient"):
        raise RestoreError(f"unknown restore mode: {mode}")
    seen: dict[str, int] = {}
    unknown: dict[str, None] = {}

    def put(m: re.Match[str]) -> str:
        token = m[0] if mode == "strict" else f"<{m['name'].upper()}>"
        entry = entries.get(token)
        if entry is None:
            if mode == "strict":
                raise RestoreError(f"unknown token: {token}")
            unknown[token] = None
            return m[0]
        n = seen[token] = seen.get(token, 0) + 1
        return entry.forms[n - 1] if n <= len(entry.forms) else entry.value

    out = (_TOKEN if mode == "strict" else _LENIENT).sub(put, text)
    return out, sum(seen.values()), list(unknown)


class Session:
    """Texts of one conversation in order: tokens and counters go on; a text that leaks changes nothing."""

    def __init__(self, detector: Detector, entries: dict[str, Entry] | None = None, counters: dict[str, int] | None = None):
        self.detector, self.entries, self.counters = detector, entries or {}, counters or {}
        self._known: Known | None = None
        self._done: dict[str, str] = {}

    def known(self) -> Known:
        if self._known is None:
            forms: dict[str, tuple[str, str]] = {}
            for token, e in self.entries.items():
                for f in (e.value, *e.forms):
                    forms.setdefault(f, (e.cls, token))
            self._known = Known(forms, self.detector.settings)
        return self._known

    def pseudonymize(self, text: str) -> tuple[str | None, list[Leak]]:
        """The rewritten text, or None and its leaks."""
        if text in self._done:  # checked when it was first made; used again, it is the youngest
            self._done[text] = self._done.pop(text)
            return self._done[text], []
        known, more, before = self.known(), [], -1
        while True:
            counters = dict(self.counters)
            report = self.detector.detect(text, known, more)
            changes, assigned = replacements(text, report, self.detector.settings, counters)
            out = replaced(text, changes)
            # a text that nothing was replaced in is the one just searched
            left = residue(out, self.detector, known, None if changes else report.hits)
            size = sum(end - start for start, end, _ in changes)
            new = uncovered(changes, left)
            if not new or size <= before:  # a further round has to replace more of the text
                break
            before = size
            more += new
        entries = dict(self.entries)
        for a in assigned:
            forms = [text[s:e] for s, e in a.spans]
            old = entries.get(a.token)
            entries[a.token] = Entry(old.cls, old.value, old.forms + forms, old.attrs) if old else Entry(a.cls, forms[0], forms, a.attrs)
        bad = leaks(out, entries, self.detector, known, left)
        if bad:
            return None, bad
        if assigned:
            self._known = None
        self.entries, self.counters = entries, counters
        self._done[text] = out
        if len(self._done) > KEPT_RESULTS:
            del self._done[next(iter(self._done))]
        return out, []

    def pseudonymize_all(self, texts: Iterable[str]) -> tuple[list[str] | None, list[Leak]]:
        """The rewritten texts in order; if one leaks, None and its leaks, and the session is as it was before the first."""
        before = self.entries, self.counters, self._known, dict(self._done)
        out = []
        for text in texts:
            new, bad = self.pseudonymize(text)
            if new is None:
                self.entries, self.counters, self._known, self._done = before
                return None, bad
            out.append(new)
        return out, []
