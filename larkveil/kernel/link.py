"""Findings of one text that are the same thing become entities; overlaps are settled."""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict

from larkveil.kernel.hits import STAGES, Entity, Hit
from larkveil.kernel.text import plain_umlauts, same
from larkveil.plans.catalog import Settings

# --- Fixed values ---
KEYED_BY_DIGITS = ("PHONE", "MOBILE_PHONE", "FAX", "IBAN", "CREDIT_CARD", "BANK_ACCOUNT")
PERSONS = ("PERSON_FULL_NAME", "PERSON_LAST_NAME", "PERSON_FIRST_NAME")
PERSON_LEAST, PROMOTED, HASH_CHARS = 0.5, 0.9, 16
# --- End of fixed values ---


def key_of(cls: str, raw: str) -> str:
    return "".join(c for c in raw if c.isdigit()) if cls in KEYED_BY_DIGITS else same(raw)


class _Group:
    __slots__ = ("cls", "key", "hits")

    def __init__(self, cls: str, key: str):
        self.cls, self.key, self.hits = cls, key, []

    def first_last(self) -> tuple[str | None, str | None]:
        """First and last name that the key tells."""
        if self.cls == "PERSON_FIRST_NAME":
            return self.key, None
        names = self.key.split() if self.cls == "PERSON_FULL_NAME" else [self.key]
        return (names[0] if len(names) > 1 else None), (names[-1] if names else None)


def _merge_persons(groups: list[_Group]) -> list[_Group]:
    """Bare names and initials join the only person of the text that they fit."""
    people = [g for g in groups if g.cls in PERSONS and max(h.conf for h in g.hits) >= PERSON_LEAST]
    merged: set[int] = set()
    for g in groups:
        if g.cls == "PERSON_LAST_NAME":
            fits = lambda first, last: last == g.key  # noqa: E731, B023
        elif g.cls == "PERSON_FIRST_NAME":
            fits = lambda first, last: first == g.key  # noqa: E731, B023
        elif g.cls == "PERSON_INITIALS" and (letters := "".join(c for c in g.key if c.isalpha())):
            fits = lambda first, last: bool(first and last) and first[0] + last[0] == letters  # noqa: E731, B023
        else:
            continue
        targets = [p for p in people if p is not g and id(p) not in merged and fits(*p.first_last())]
        if len(targets) == 1:
            for h in g.hits:
                h.conf = max(h.conf, PROMOTED)
            targets[0].hits += g.hits
            merged.add(id(g))
    return [g for g in groups if id(g) not in merged]


def _merge_ids(groups: list[_Group]) -> list[_Group]:
    """A generic id joins the only other group with its key."""
    left = list(groups)
    for g in [g for g in groups if g.cls == "GENERIC_ID"]:
        others = [o for o in left if o is not g and o.key == g.key]
        if len(others) == 1:
            others[0].hits += g.hits
            left.remove(g)
    return left


def correlate(text: str, hits: list[Hit]) -> dict[str, Entity]:
    """Sets entity, confidence and attributes of the findings and gives the entities."""
    by_key: dict[tuple[str, str], _Group] = {}
    for h in sorted(hits, key=lambda h: (h.start, h.end)):
        where = h.cls, key_of(h.cls, text[h.start : h.end])
        by_key.setdefault(where, _Group(*where)).hits.append(h)
    groups = _merge_ids(_merge_persons(list(by_key.values())))
    groups.sort(key=lambda g: min(h.start for h in g.hits))
    entities: dict[str, Entity] = {}
    last_names: list[tuple[str, str]] = []
    for n, g in enumerate(groups, 1):
        e = Entity(f"e{n}", g.cls, hashlib.sha256(g.key.encode()).hexdigest()[:HASH_CHARS], sorted({(h.start, h.end) for h in g.hits}))
        entities[e.id] = e
        told = {name: {h.attrs[name] for h in g.hits if name in h.attrs} for name in ("gender", "token")}
        shared = {name: next(iter(v)) for name, v in told.items() if len(v) == 1}
        torn = len(told["gender"]) > 1
        e.attrs = ({"gender_conflict": "true"} if torn else {}) | shared
        for h in g.hits:
            h.entity = e.id
            if torn:
                h.attrs.pop("gender", None)
            h.attrs |= e.attrs
        if g.cls in PERSONS and (last := g.first_last()[1]):
            last_names.append((plain_umlauts(last), e.id))
    for h in hits:
        if h.cls != "EMAIL":
            continue
        for p in h.parts:
            if p.cls == "PERSON_USERNAME":
                local = plain_umlauts(same(text[p.start : p.end]))
                fits = {i for last, i in last_names if last in local}
                if len(fits) == 1:
                    h.attrs["linked_entity"] = fits.pop()
                    break
    return entities


def settle(hits: list[Hit], settings: Settings) -> list[Hit]:
    """Findings without overlaps: the stronger stays, of the weaker stays what isn't covered."""
    order = {s: len(STAGES) - i for i, s in enumerate(STAGES)}

    def strength(h: Hit) -> tuple:
        c = settings.classes.get(h.cls)
        return "token" in h.attrs, c.priority if c else 0, h.size, order.get(h.stage, 0), -h.start

    def weaker(new: Hit, old: Hit) -> bool:
        if old.holds(new):
            if "token" in new.attrs:
                if old.size > new.size:
                    return True
            elif old.stage == "structured":
                return True
        return strength(new) <= strength(old)

    heap: list[tuple[int, int, int, Hit]] = []
    count = 0

    def wait(h: Hit) -> None:
        nonlocal count
        heapq.heappush(heap, (h.start, -h.size, count, h))
        count += 1

    def rest(h: Hit, cover: Hit) -> None:
        for s, e in ((h.start, min(h.end, cover.start)), (max(h.start, cover.end), h.end)):
            if s < e:
                wait(h.with_span(s, e))

    for h in hits:
        wait(h)
    kept: list[Hit] = []
    while heap:
        new = heapq.heappop(heap)[-1]
        at = next((i for i, k in enumerate(kept) if k.meets(new)), None)
        if at is None:
            kept.append(new)
        elif weaker(new, kept[at]):
            rest(new, kept[at])
        else:
            rest(kept.pop(at), new)
            wait(new)
    return sorted(kept, key=lambda h: h.start)


def counts(hits: list[Hit]) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for h in hits:
        out[h.cls] += 1
    return dict(out)
