"""One finding, and the order among findings."""

from __future__ import annotations

from dataclasses import dataclass, field

STAGES = ("session", "structured", "pattern", "dictionary", "context", "correlation")


@dataclass(slots=True)
class Hit:
    start: int
    end: int
    cls: str
    stage: str
    conf: float
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list[Hit] = field(default_factory=list)
    entity: str | None = None

    @property
    def size(self) -> int:
        return self.end - self.start

    def meets(self, other: Hit) -> bool:
        return self.start < other.end and other.start < self.end

    def holds(self, other: Hit) -> bool:
        return self.start <= other.start and other.end <= self.end

    def with_span(self, start: int, end: int) -> Hit:
        """What is left of a finding: a fresh one of the same class."""
        return Hit(start, end, self.cls, self.stage, self.conf)

    def moved(self, by: int) -> Hit:
        """The same finding elsewhere, of no entity yet."""
        attrs = {k: v for k, v in self.attrs.items() if k != "linked_entity"}
        return Hit(self.start + by, self.end + by, self.cls, self.stage, self.conf, attrs, [p.moved(by) for p in self.parts])


@dataclass(slots=True)
class Entity:
    id: str
    cls: str
    norm: str
    spans: list[tuple[int, int]]
    attrs: dict[str, str] = field(default_factory=dict)
