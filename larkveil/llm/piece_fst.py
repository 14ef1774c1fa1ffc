"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file and composed with each input:

* the normaliser, a trie of replacement rules (given ones and those of the model's character map), which
  apply leftmost-longest; spaces become ``▁``, one ``▁`` is put in front, spaces too many go if the model
  says so;
* the pieces: a trie whose states are walked along the text; a final state is an arc of the lattice, with
  the piece's id and its weight in the tropical semiring (minimum, plus). For a unigram model a piece weighs
  its negative log score. For a BPE model pieces weigh 0 and the lattice is composed with an acceptor of
  pairs: two pieces may follow each other (weight 0) only if merging their joined text gives exactly these
  two, else the weight is infinite. The merges of a text give the one path of finite weight, because merges
  on both sides of a border that is never merged across don't depend on each other;
* the byte fallback: a character that no piece covers goes through one arc for each of its bytes.

The result is the shortest path of the composition: for unigrams by relaxing arcs from left to right (the
lattice has no cycles), for BPE best first. A state of the composition is a position and the piece that ends
there; for BPE only one piece can end a finite path at a position, for unigrams the piece doesn't matter, so
positions will do.
The pair acceptor is far too large to be written out (pieces squared), so its arcs are made on demand and
kept. The lattice of a text falls apart at borders that no piece crosses; these are found when the model is
compiled, and paths of the parts between them are kept, at most ``KEEP`` for each Python worker, which
changes the speed only.

Decoding joins the pieces' bytes, undoes ``▁`` and drops the one space put in front.

Runs as ``mapInArrow``: rows are independent, nothing is shuffled, memory is one Arrow batch and the store.
Defined results: null text gives null ids and null decoded text; empty text gives no ids; control strings in
a text are ordinary text; texts of any length are encoded whole; repeated rows are encoded each; an empty
table gives an empty table; other columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from heapq import heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Kept paths of parts for each worker; some 300 bytes each.
KEEP = 300_000
#: Rows that are held as Python objects at a time.
ROWS = 256
INFINITE = float("inf")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[i : i + n]
            i += n


def charsmap(data: bytes) -> dict[str, str]:
    """The rules of a model's compiled character map: a double array of byte strings, then their replacements.

    A unit has its offset to its children in the upper bits, whether a value hangs there, and its label.
    """
    size = struct.unpack_from("<I", data)[0]
    units = struct.unpack_from(f"<{size // 4}I", data, 4)
    blob, rules = data[4 + size :], {}
    offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
    stack = [(offset(units[0]), b"")] if units else []
    while stack:
        at, key = stack.pop()
        for c in range(1, 256):
            to = at ^ c
            if to < len(units) and units[to] & 0x800000FF == c:
                below = to ^ offset(units[to])
                if units[to] >> 8 & 1:
                    begin = units[below] & 0x7FFFFFFF
                    rules[(key + bytes([c])).decode("utf-8", "replace")] = blob[begin : blob.index(b"\0", begin)].decode()
                stack.append((below, key + bytes([c])))
    return rules


class Trie:
    """Entries by their characters: a state is a dictionary of the states that follow, with the output at "" if it is final."""

    def __init__(self, entries: dict[str, object]):
        self.root: dict = {}
        for key, value in entries.items():
            state = self.root
            for c in key:
                state = state.setdefault(c, {})
            state[""] = value

    def ends(self, text: str, i: int) -> list[int]:
        """Where the entries end that begin at i, shortest first."""
        state, found, n = self.root, [], len(text)
        while i < n:
            c = text[i]
            if c not in state:
                break
            state = state[c]
            i += 1
            if "" in state:
                found.append(i)
        return found

    def longest(self, text: str, i: int) -> tuple[int, object]:
        """Where the longest entry at i ends, and its output; (i, None) if there is none."""
        ends = self.ends(text, i)
        if not ends:
            return i, None
        state = self.root
        for c in text[i : ends[-1]]:
            state = state[c]
        return ends[-1], state[""]


class PieceTransducer:
    def __init__(self, path: str, rules: dict[str, str] | None = None):
        """``rules``: replacements of the normaliser besides those of white space."""
        self.pieces: list[tuple[str, float, int]] = []
        self.unigram, self.dummy_prefix, self.fewer_spaces = True, True, True
        mapped: dict[str, str] = {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    x = dict(_fields(value))
                    self.pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, b"\0" * 4))[0], x.get(3, NORMAL)))
                elif number == 2:
                    self.unigram = dict(_fields(value)).get(3, 1) == 1
                elif number == 3:
                    x = dict(_fields(value))
                    self.dummy_prefix = bool(x.get(3, 1))
                    self.fewer_spaces = bool(x.get(4, 1))
                    mapped = charsmap(x[2]) if x.get(2) else {}
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER, UNUSED)}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        self.score = {p: self.pieces[i][1] for p, i in self.ids.items()}
        self.penalty = 10.0 - min(self.score.values(), default=0.0)
        self.rules = mapped | (rules or {})
        self._normaliser = Trie(self.rules)
        self._begins = re.compile("[" + "".join(map(re.escape, sorted({k[0] for k in self.rules}))) + "]") if self.rules else None
        self._trie = Trie(self.ids)
        self._joined = {p[i - 1 : i + 1] for p in self.ids for i in range(1, len(p))}
        self._parts = re.compile(self._borders())
        levels = {x: i for i, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self._rank = {p: levels[x] for p, x in self.score.items()}
        self._splits: dict[str, tuple[str, str] | None] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._store: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._bytes = [self._piece_bytes(p, kind) for p, _, kind in self.pieces]

    def _borders(self) -> str:
        """A pattern for parts between borders that no piece crosses (spaces not yet replaced)."""
        if any((x[1] == SPACE and x[0] != SPACE) or " " in x for x in self._joined):
            return r"(?s).+"
        inside = {c for x in self._joined for c in x}
        alone = "".join(map(re.escape, (c for c in "\n\t\r" if c not in inside)))
        return f" *[^ {alone}]+| +" + (f"|[{alone}]" if alone else "")

    def _piece_bytes(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, piece.replace(SPACE, " ").encode())

    def normalize(self, text: str) -> str:
        """Without the replacement of spaces, which ``_path`` does part by part; a ``▁`` of the text is as good as a space."""
        if self._begins:
            out, i = [], 0
            while m := self._begins.search(text, i):
                end, new = self._normaliser.longest(text, m.start())
                out += [text[i : m.start()], text[m.start()] if new is None else new]
                i = end if end > m.start() else m.start() + 1
            text = "".join([*out, text[i:]])
        text = text.replace(SPACE, " ")
        if self.fewer_spaces:
            text = re.sub(" {2,}", " ", text).strip(" ")
        return (" " + text) if self.dummy_prefix and text else text

    def _merge_once(self, parts: list[str]) -> list[str] | None:
        """The best pair merged, of equals the leftmost."""
        best = min(((self._rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self._rank), default=None)
        if best is None:
            return None
        i = best[1]
        return [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge gives a piece in the end; none if merging its text doesn't give it."""
        if piece not in self._splits:
            parts, before = list(piece), list(piece)
            while len(parts) > 1 and (merged := self._merge_once(parts)) is not None:
                before, parts = parts, merged
            self._splits[piece] = tuple(before) if len(parts) == 1 else None
        return self._splits[piece]

    def _follows(self, a: str, b: str) -> bool:
        """Whether the acceptor of pairs lets b follow a; a may be empty.

        The merges that made the two are undone, latest first; a border that a merge of the parts
        beside it would have crossed earlier is no border.
        """
        known = self._pairs.get((a, b))
        if known is not None:
            return known
        if len(self._pairs) >= KEEP:
            self._pairs.clear()
        rank, ok = self._rank, len(b) == 1 or self._last_merge(b) is not None
        left, right, limit = a, b, float("inf")
        while ok and a:
            if rank.get(left + right, limit) < limit:
                ok = False
                break
            x, y = rank.get(left, -1) if len(left) > 1 else -1, rank.get(right, -1) if len(right) > 1 else -1
            if x > y:
                limit, left = x, self._last_merge(left)[1]
            elif y >= 0:
                limit, right = y + 1, self._last_merge(right)[0]
            else:
                break
        self._pairs[a, b] = ok
        return ok

    def _ends(self, text: str, i: int) -> list[int]:
        """Where the arcs end that leave position i, shortest first; a character without a piece goes through its bytes."""
        found = self._trie.ends(text, i)
        if not found or found[0] > i + 1:
            found.insert(0, i + 1)
        return found

    def shortest(self, text: str) -> list[str]:
        """The pieces on the shortest path of the composition."""
        last = self._relaxed(text) if self.unigram else self._best_first(text)
        found, n = [], len(text)
        while n:
            found.append(last[n])
            n -= len(last[n])
        return found[::-1]

    def _relaxed(self, text: str) -> list[str]:
        """The last piece of the shortest path to each position, by relaxing arcs from left to right; of equals the earlier border."""
        n, score = len(text), self.score
        cost, last = [0.0] + [INFINITE] * n, [""] * (n + 1)
        for i in range(n):
            for j in self._ends(text, i):
                piece = text[i:j]
                there = cost[i] + (-score[piece] if piece in score else self.penalty)
                if there < cost[j]:
                    cost[j], last[j] = there, piece
        return last

    def _best_first(self, text: str) -> list[str]:
        """The same where arcs weigh 0 or are infinite: states in the order of cost, of equals the furthest, until the end is reached.

        An arc's weight is looked up when its turn comes, so most of the composition is never made.
        """
        n, last, pairs, follows = len(text), [""] * (len(text) + 1), self._pairs, self._follows
        queue, wide = [], n + 1  # arcs as -(end * wide + begin): finite costs are all 0
        begin = 0
        while True:
            for end in self._ends(text, begin):
                if not last[end]:
                    heappush(queue, -(end * wide + begin))
            while True:
                end, at = divmod(-heappop(queue), wide)
                if last[end]:
                    continue
                pair = (last[at], text[at:end])
                ok = pairs.get(pair)
                if ok or ok is None and follows(*pair):
                    break
            last[end] = pair[1]
            if end == n:
                return last
            begin = end

    def _part(self, part: str) -> bytes:
        """The kept path of a part, or a new one. Of two stores the older is dropped when the younger is full; what is asked for stays."""
        path = self._older.get(part)
        if path is None:
            path = self._path(part)
        if len(part) <= 40:
            if len(self._store) >= KEEP // 2:
                self._older, self._store = self._store, {}
            self._store[part] = path
        return path

    def _path(self, part: str) -> bytes:
        """Ids on the shortest path of one part, which is cut once more where no piece joins two characters."""
        text, joined = part.replace(" ", SPACE), self._joined
        cuts = [i for i, x in enumerate(map(add, text, text[1:]), 1) if x not in joined]
        if cuts:
            return b"".join(self._store.get(own) or self._part(own) for own in (part[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])))
        ids: list[int] = []
        for piece in self.shortest(text):
            i = self.ids.get(piece)
            if i is not None:
                ids.append(i)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        kept, new = self._store.get, self._part
        return b"".join([kept(part) or new(part) for part in self._parts.findall(self.normalize(text))])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


_LOADED: dict[str, PieceTransducer] = {}


def transducer(path: str) -> PieceTransducer:
    """The compiled model of a path, once for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceTransducer(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` as array<int> column ``ids`` (replaced if it's there).

    ``decoded`` adds what decoding the ids gives, in the same pass.
    """
    kept = [c for c in docs.columns if c.lower() not in (ids.lower(), (decoded or ids).lower())]
    schema = T.StructType([*docs.select(kept).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.StringType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for b in _slices(batches):
            coded = [None if (t := x.as_py()) is None else machine.encode_bytes(t) for x in b.column(b.schema.get_field_index(text))]
            out = _with_lists(b, ids, kept, coded)
            if decoded:
                texts = [None if c is None else machine.decode(np.frombuffer(c, "<u4").tolist()) for c in coded]
                out = out.append_column(decoded, pa.array(texts, pa.string()))
            yield out

    return docs.mapInArrow(run, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, len(b), ROWS):
            yield b.slice(i, ROWS)


def _with_lists(batch: pa.RecordBatch, name: str, kept: list[str], coded: list[bytes | None]) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(c or b"") // 4 for c in coded])
    values = pa.array(np.frombuffer(b"".join(c for c in coded if c), "<i4"))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([c is None for c in coded], pa.bool_()))
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in kept), lists], names=[*kept, name])


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids`` as column ``text`` (replaced if it's there)."""
    kept = [c for c in rows.columns if c.lower() != text.lower()]
    schema = T.StructType([*rows.select(kept).schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for b in _slices(batches):
            lists = b.column(b.schema.get_field_index(ids))
            texts = pa.array([None if x is None else machine.decode(x) for x in _lists(lists)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in kept), texts], names=[*kept, text])

    return rows.mapInArrow(run, schema)


def _lists(column: pa.Array) -> Iterator[list[int] | None]:
    """The lists of a column one by one, so that Python numbers of one row exist at a time."""
    valid, offsets = column.is_valid().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield values[offsets[i] : offsets[i + 1]].tolist() if valid[i] else None
