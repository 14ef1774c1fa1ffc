"""Lexical retrieval packing: windows filled with BM25 neighbours of a seed document.

A document's ids are cut into full windows and a tail. Full windows are sequences as they are.
Tails are dealt to shards of about ``SHARD`` documents. Each shard builds an inverted index over
its documents' terms (token ids, of the whole text) with BM25 weights, whose document frequencies
and mean length are counted over all documents before. Starting from a seed, the
unused neighbours with the best scores fill the seed's window one after the other; the one that
crosses its end is cut there, its rest opens the next window and it is the next seed. Where no
neighbour shares a weighted term, the unused document with the smallest id follows. So a shard has
at most one window that isn't full, and that one is cut into sequences of powers of two, which
need no padding.

Related documents are dealt to one shard: each document draws ``DRAWS`` of its terms by weighted
minima (the rarer a term is in the corpus the likelier; two documents draw alike as often as their
weighted term sets overlap), all documents are ordered by what they drew, and the order is cut at
quantiles of a sample of one row in ``SAMPLED``. The last 16 bits of a place are a row counter, so
neither a hot key nor copies make a shard large: a large group fills shards next to each other. A
seed's candidates are the unused documents of its shard; a neighbour that drew other terms, or that
a quantile cuts off, isn't met. A shard is what one task holds: tails (at most a window each) and
terms of ``SHARD`` documents; other windows travel as checksums only.

Defined results: null text counts as empty and has the end id alone; repeated rows are packed
each; ties in score go to the smaller document id (nulls last), then to the earlier row; an empty
table gives no pieces; other columns are left out.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkveil.llm.common import cut, lean

WINDOW = 1024
END_ID = 0
SHARD = 512
K1, B = 1.2, 0.75
#: Ids have 16 bits. Terms drawn for a document's place, the power of their weight, and rows for each one that is sampled.
TERMS, DRAWS, POWER, SAMPLED = 1 << 16, 3, 2, 16

_ENCODERS: dict = {}


def encoder(ranks: str, pattern: str, special: dict[str, int] | None = None):
    """The encoder of a file of byte-pair ranks, once for each Python worker; special: strings that are one id."""
    own = (ranks, *sorted((special or {}).items()))
    if own not in _ENCODERS:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[own] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens=special or {})
    return _ENCODERS[own]


def _coded(docs: DataFrame, key: str, text: str, ranks: str, pattern: str, special: dict[str, int] | None = None) -> DataFrame:
    """tie, key, n (ids with the end id), full (checksums), tail, terms (ids and counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = partial(encoder(ranks, pattern, special).encode, allowed_special="all"), None
        for b in batches:
            keys = b.column(0).to_pylist()
            if at is None and keys:
                at = zlib.crc32(str(keys[0]).encode())
            rows: list[list] = [[], [], [], [], []]
            for x in b.column(1):
                ids = np.array([*encode(x.as_py() or ""), END_ID], "<u4")
                full = len(ids) // WINDOW
                sums = [zlib.crc32(ids[i * WINDOW : (i + 1) * WINDOW].tobytes()) for i in range(full)]
                terms, counts = np.unique(ids[:-1], return_counts=True)
                at += 1
                for column, value in zip(rows, (at % TERMS, len(ids), np.array(sums, "<u4").tobytes(), ids[full * WINDOW :].astype("<u2").tobytes(), np.stack([terms, np.minimum(counts, 65535)]).astype("<u2").tobytes())):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            tie, *rest = (pa.array(r, k) for r, k in zip(rows, kinds))
            yield pa.RecordBatch.from_arrays([tie, b.column(0), *rest], names=["tie", key, "n", "full", "tail", "terms"])

    fields = [T.StructField("tie", T.LongType()), docs.schema[key], T.StructField("n", T.LongType())]
    schema = T.StructType([*fields, *(T.StructField(c, T.BinaryType()) for c in ("full", "tail", "terms"))])
    return docs.select(key, text).mapInArrow(lean(run), schema)


def _terms(packed: bytes) -> np.ndarray:
    """Two rows: a document's terms and their counts."""
    return np.frombuffer(packed, "<u2").reshape(2, -1).astype(np.int64)


def weights(n: int, df: np.ndarray) -> np.ndarray:
    """BM25's weight of terms that df of n documents have; one that half of them have weighs nothing."""
    return np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))


def statistics(coded: DataFrame) -> tuple[int, float, np.ndarray]:
    """Number of documents, their mean length, and the number of documents with each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(TERMS, np.int64)
        for b in batches:
            for x in b.column(0):
                df[_terms(x.as_py())[0]] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], names=["term", "df"])

    n, length = coded.agg(F.count("*"), F.sum(F.col("n") - 1)).first()
    counted = coded.select("terms").mapInArrow(lean(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term at most
    df = np.zeros(TERMS, np.int64)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    return n, (length or 0) / max(1, n), df


def drawing(n: int, df: np.ndarray) -> np.ndarray:
    """What each term costs in each draw; the cheapest is drawn, terms that no two documents share never."""
    draws = np.random.default_rng(20_240_609).exponential(size=(DRAWS, TERMS))
    with np.errstate(divide="ignore"):
        return draws / np.where(df > 1, weights(n, df) ** POWER, 0)


def place(costs: np.ndarray, terms: np.ndarray, tie: int) -> int:
    """Where a document stands in the order that shards are cut from."""
    out = 0
    for own in costs[:, terms]:
        at = int(own.argmin()) if len(own) else 0
        out = out << 16 | (int(terms[at]) if len(own) and np.isfinite(own[at]) else TERMS - 1)
    return (out << 16 | tie) - (1 << 63)


def _dealt(coded: DataFrame, shards: int, n: int, df: np.ndarray) -> DataFrame:
    """``coded`` with shard in place of tie."""
    if shards == 1:
        return coded.withColumn("tie", F.lit(0).cast("long")).withColumnRenamed("tie", "shard")
    costs = coded.sparkSession.sparkContext.broadcast(drawing(n, df))

    def places(b: pa.RecordBatch) -> np.ndarray:
        columns = (b.column(b.schema.get_field_index(c)) for c in ("terms", "tie"))
        return np.array([place(costs.value, _terms(x.as_py())[0], t.as_py()) for x, t in zip(*columns)], np.int64)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places(b))], names=["place"])

    some = coded.where(F.pmod(F.xxhash64("terms", "tie"), F.lit(SAMPLED)) == 0).select("terms", "tie")
    sampled = np.sort(some.mapInArrow(lean(sample), "place long").toArrow().column("place").to_numpy())
    bounds = coded.sparkSession.sparkContext.broadcast(sampled[[len(sampled) * i // shards for i in range(1, shards)]] if len(sampled) else sampled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = np.searchsorted(bounds.value, places(b), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *b.columns[1:]], names=["shard", *b.schema.names[1:]])

    return coded.mapInArrow(lean(run), T.StructType([T.StructField("shard", T.LongType()), *coded.schema.fields[1:]]))


class Index:
    """BM25 postings of a shard's documents, weighted by the statistics of the corpus, or of these documents if there are none."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], corpus: tuple[int, float, np.ndarray] | None = None):
        self.n = len(terms)
        self.terms = terms
        lengths = np.array([c.sum() for c in counts], float)
        doc = np.repeat(np.arange(self.n), [len(t) for t in terms])
        term = np.concatenate([*terms, np.empty(0, np.int64)]).astype(np.int64)
        tf = np.concatenate([*counts, np.empty(0)]).astype(float)
        top = int(term.max(initial=0)) + 1
        total, mean, df = corpus or (self.n, lengths.mean() if self.n else 1.0, np.bincount(term, minlength=top))
        idf = weights(total, df)
        norm = K1 * (1 - B + B * lengths / max(1.0, mean))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        order = np.argsort(term, kind="stable")
        order = order[idf[term[order]] > 0]
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(top + 1))

    def scores(self, seed: int) -> np.ndarray:
        t = self.terms[seed]
        first, size = self.start[t], self.start[t + 1] - self.start[t]
        total = int(size.sum())
        if not total:
            return np.zeros(self.n)
        at = np.arange(total) + np.repeat(first - (np.cumsum(size) - size), size)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def chain(index: Index, sizes: list[int], window: int = WINDOW) -> Iterator[int]:
    """The order in which documents follow each other; sizes: of their tails."""
    unused = np.array([s > 0 for s in sizes], bool)
    left = int(unused.sum())
    if not left:
        return
    seed = int(np.argmax(unused))
    unused[seed] = False
    left -= 1
    yield seed
    room = window - sizes[seed]
    while left:
        scores = np.where(unused, index.scores(seed), -1.0)
        for d in np.argsort(-scores, kind="stable")[:left]:  # equal scores, and those without: in order of ids
            d = int(d)
            unused[d] = False
            left -= 1
            yield d
            room -= sizes[d]
            if room <= 0:
                room += window
                seed = d
                break


def _packed(key: str, ids: bool, corpus):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "n"], kind="stable", na_position="last").reset_index(drop=True)
        tails = [np.frombuffer(x, "<u2") for x in pdf["tail"]]
        terms = [_terms(x) for x in pdf["terms"]]
        index = Index([t[0] for t in terms], [t[1] for t in terms], corpus.value)
        out: list[tuple] = []
        sequence = int(pdf["shard"].iloc[0]) << 32
        for i, sums in enumerate(pdf["full"]):
            for w, crc in enumerate(np.frombuffer(sums, "<u4").tolist()):
                out.append((i, w * WINDOW, WINDOW, crc, sequence, 0, None))
                sequence += 1
        pieces: list[tuple[int, int, int]] = []  # document, from, to in its tail, in order
        room = WINDOW
        for d in chain(index, [len(t) for t in tails]):
            at = 0
            while at < len(tails[d]):
                take = min(room, len(tails[d]) - at)
                pieces.append((d, at, at + take))
                at += take
                room = room - take or WINDOW
        rest = (WINDOW - room) % WINDOW
        total = sum(len(t) for t in tails)
        ends = [WINDOW] * (total // WINDOW) + [1 << k for k in range(WINDOW.bit_length() - 1, -1, -1) if rest >> k & 1]
        offset = 0
        for d, a, b in pieces:
            while a < b:
                take = min(b - a, ends[0] - offset)
                part = tails[d][a : a + take]
                start = int(pdf["n"].iloc[d]) - len(tails[d]) + a
                out.append((d, start, take, zlib.crc32(part.astype("<u4").tobytes()), sequence, offset, part.tobytes() if ids else None))
                a, offset = a + take, offset + take
                if offset == ends[0]:
                    ends.pop(0)
                    sequence, offset = sequence + 1, 0
        which, start, length, crc, seq, off, own = map(list, zip(*out))
        frame = {key: pdf[key].iloc[which].reset_index(drop=True), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": pdf["n"].iloc[which].reset_index(drop=True), "sequence_id": seq, "offset": off}
        return pd.DataFrame(frame | ({"tail_ids": own} if ids else {}))

    return run


def pack(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", shard: int = SHARD, ids: bool = False, special: dict[str, int] | None = None) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``special`` are strings that the vocabulary has as one id; without it they are ordinary text.
    ``ids`` adds ``tail_ids``: the piece's ids (16 bit) where it isn't a full window of its document.
    """
    coded = cut(_coded(docs, key, text, ranks, pattern, special))
    corpus = statistics(coded)
    dealt = _dealt(coded, max(1, math.ceil(corpus[0] / shard)), corpus[0], corpus[2])
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.LongType()) for c in names), *([T.StructField("tail_ids", T.BinaryType())] if ids else [])])
    return dealt.groupBy("shard").applyInPandas(_packed(key, ids, docs.sparkSession.sparkContext.broadcast(corpus)), schema)
