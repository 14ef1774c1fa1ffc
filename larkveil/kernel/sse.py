"""Server-sent events of a chat answer, restored while they arrive."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from larkveil.kernel.bodies import mapped

# --- Fixed values ---
BETWEEN_EVENTS = rb"\r?\n\r?\n"
MAY_BE_TOKEN = r"(?:<[^>\s]{0,80}|[A-Z][A-Z_]{0,72}(?:_\d{0,2})?)$"
# --- End of fixed values ---


def events(buffer: bytes) -> tuple[list[tuple[str | None, str, bytes]], bytes]:
    """(name, data, raw bytes) of each whole event, and what is left over."""
    out, at = [], 0
    for m in re.finditer(BETWEEN_EVENTS, buffer):
        block, raw = buffer[at : m.start()], buffer[at : m.end()]
        at = m.end()
        if not block.strip():
            continue
        name, data = None, []
        for line in block.decode("utf-8", "replace").split("\n"):
            field, colon, value = line.rstrip("\r").partition(":")
            if colon and field == "event":
                name = value.strip()
            elif colon and field == "data":
                data.append(value[1:] if value[:1] == " " else value)
        out.append((name, "\n".join(data), raw))
    return out, buffer[at:]


def event(name: str, payload: dict) -> bytes:
    return f"event: {name}\ndata: {json.dumps(payload, separators=(',', ':'), ensure_ascii=False)}\n\n".encode()


def _delta(index: int, kind: str, field: str, value: str) -> bytes:
    return event("content_block_delta", {"type": "content_block_delta", "index": index, "delta": {"type": kind, field: value}})


class StreamRestorer:
    """Keeps back what may be the start of a token; tool inputs wait until their block is whole."""

    def __init__(self, change: Callable[[str], str], state: dict | None = None):
        self.change = change
        state = state or {}
        self.buffer: bytes = state.get("buffer", b"")
        self.held: dict[int, str] = dict(state.get("held", {}))
        self.inputs: dict[int, str] = dict(state.get("inputs", {}))

    def state(self) -> dict:
        return {"buffer": self.buffer, "held": self.held, "inputs": self.inputs}

    def feed(self, chunk: bytes) -> bytes:
        found, self.buffer = events(self.buffer + chunk)
        return b"".join(part for e in found for part in self._passed(*e))

    def finish(self) -> bytes:
        """The rest of a stream that ends here."""
        parts = [p for i in sorted(self.held) for p in self._text(i)] + [p for i in sorted(self.inputs) for p in self._input(i)]
        rest, self.buffer = self.buffer, b""
        return b"".join([*parts, rest])

    def _passed(self, name: str | None, data: str, raw: bytes) -> Iterator[bytes]:
        try:
            payload = json.loads(data)
        except ValueError:
            payload = None
        index = payload.get("index") if isinstance(payload, dict) else None
        kind = (name or payload.get("type")) if isinstance(index, int) else None
        if kind == "content_block_stop":
            yield from self._text(index)
            yield from self._input(index)
        elif kind == "content_block_delta" and isinstance(delta := payload.get("delta"), dict):
            if delta.get("type") == "text_delta" and isinstance(delta.get("text"), str):
                text = self.held.pop(index, "") + delta["text"]
                m = re.search(MAY_BE_TOKEN, text)
                cut = m.start() if m else len(text)
                if text[cut:]:
                    self.held[index] = text[cut:]
                if text[:cut]:
                    yield _delta(index, "text_delta", "text", self.change(text[:cut]))
                return
            if delta.get("type") == "input_json_delta" and isinstance(delta.get("partial_json"), str):
                self.inputs[index] = self.inputs.get(index, "") + delta["partial_json"]
                return
        yield raw

    def _text(self, index: int) -> Iterator[bytes]:
        if text := self.held.pop(index, ""):
            yield _delta(index, "text_delta", "text", self.change(text))

    def _input(self, index: int) -> Iterator[bytes]:
        if whole := self.inputs.pop(index, ""):
            try:
                new = json.dumps(mapped(json.loads(whole), self.change), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                new = self.change(whole)
            yield _delta(index, "input_json_delta", "partial_json", new)
