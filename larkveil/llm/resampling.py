"""Quality filter by importance resampling over hashed n-grams.

Two generative models over hashed n-grams are counted: the raw model over all documents, the
target model over a bounded sample of rows that are labelled good. A document's log importance
weight is the sum of its n-grams' log ratios of target to raw probability. Documents are drawn
without replacement by Gumbel top-k: each key is the log weight plus a standard Gumbel number that
depends on the row's key and a seed, and the k highest stay.

The method was published for chunks of one length; here documents have 1 to 20,000 words, and the
plain sum ranks long clean texts below short junk as soon as some of their words are missing in
the sample. So the weight is that of a chunk of ``CHUNK`` n-grams of the document: the sum divided
by the document's n-grams (and ``SHRINK`` neutral ones, which keep very short texts near 0), times
``CHUNK``. ``chunk=None`` gives the plain sum. The README has both forms' figures.

``share`` is the part of all rows that is drawn, so k = round(share * rows). Without it the share
is the one that the labelled sample has of good rows: as many are drawn as there are good ones by
that estimate. No weight is compared with a cut, and weights of bad rows are never looked at.

n-grams are single tokens (runs of letters and digits, runs of other signs) and pairs of
neighbours; a pair of equal tokens counts as one n-gram "=", so texts that repeat a word are seen
whatever the word is. Pairs and tokens are hashed into ``BUCKETS`` buckets. The target model is
smoothed towards the raw one (``PRIOR`` of its size), which bounds each ratio from below.

Texts are read in Arrow batches and hashed by array arithmetic; counts are added up to at most a
row for each bucket and task before the shuffle; the driver sees the two models (2 * BUCKETS
numbers), the labelled sample (``SAMPLE`` ids) and histograms of the keys (``BINS`` numbers),
whatever the input's size. The k-th key is found by refining a histogram, so there is no sort of
all rows.

Defined results: null or empty texts have no n-grams and weight 0; without good labelled rows
every weight is 0, and without labelled rows everything is kept; of several labels of a document
the smallest counts; null labels don't count; repeated rows have equal keys and go or stay
together; rows that tie with the k-th key stay; columns log_ratio and draw_key of the input are
replaced; a share of 0 gives no rows, of 1 all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkveil.llm.common import cut, lean

BUCKETS = 16_384
#: At most so many labelled rows are used: those with the smallest hashes of their ids.
SAMPLE = 20_000
PRIOR = 0.05
SHRINK = 10
CHUNK = 50
SEED = 20_24
BINS = 4_096

_FACTOR = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]
#: 0 white space, 1 letters and digits (every byte beyond ASCII), 2 other signs
_KIND = np.array([1 if c >= 128 or chr(c).isalnum() else 0 if chr(c) in " \t\n\r\x0b\x0c" else 2 for c in range(256)], np.uint8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's factor and of its inverse modulo 2**64, kept for the next batch."""
    if len(_POWERS[0]) < n:
        for i, factor in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 19), factor, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some texts, and which text each belongs to.

    A token's hash is a difference of running sums over the bytes of all texts, moved back to where
    the token begins, so nothing is done token by token.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    n = len(data)
    power, inverse = _powers(n)
    kind = _KIND[data]
    borders = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start, end = np.concatenate([[0], borders]), np.concatenate([borders, [n]])
    own = kind[start] != 0
    start, end = start[own], end[own]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    token = _mix((sums[end] - sums[start]) * inverse[start])
    text = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, "right")
    beside = np.flatnonzero(text[1:] == text[:-1])
    a, b = token[beside], token[beside + 1]
    pair = np.where(a == b, np.uint64(1), _mix(a * np.uint64(3) + b))
    return (np.concatenate([token, pair]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([text, text[beside]])


def _batches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of some hundred kilobytes of text."""
    for b in batches:
        column = b.column(b.schema.get_field_index(text))
        at, size, own = 0, 0, []
        for i, x in enumerate(column):
            own.append(x.as_py())
            size += len(own[-1] or "")
            if size > 200_000 or i + 1 == len(b):
                yield b.slice(at, len(own)), own
                at, size, own = i + 1, 0, []


def labelled_sample(labels: DataFrame, key: str = "doc_id", label: str = "quality", most: int = SAMPLE) -> DataFrame:
    """(key, good): a bounded sample of the labelled rows."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("good"))
    return rows.orderBy(F.xxhash64(key), key).limit(most)


@dataclass(frozen=True)
class Models:
    """Log ratios by bucket, and the share of the labelled sample's rows that is good (1 without labels)."""

    ratios: np.ndarray
    good: float

    def weights(self, texts: list[str | None], chunk: int | None = CHUNK) -> np.ndarray:
        """Log importance weights of some texts."""
        gram, row = ngrams(texts)
        total = np.bincount(row, self.ratios[gram], len(texts))
        return total if chunk is None else chunk * total / (np.bincount(row, minlength=len(texts)) + SHRINK)

    def weighed(self, docs: DataFrame, text: str = "text", out: str = "log_ratio", chunk: int | None = CHUNK) -> DataFrame:
        """``docs`` with the weights of ``text`` as column ``out`` (replaced if it's there)."""
        kept = [c for c in docs.columns if c.lower() != out.lower()]
        schema = T.StructType([*docs.select(kept).schema.fields, T.StructField(out, T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, texts in _batches(batches, text):
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in kept), pa.array(self.weights(texts, chunk))], names=[*kept, out])

        return docs.select(kept).mapInArrow(lean(run), schema)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Models:
    """Both models, and the share of good rows."""
    labelled = {r[key]: r["good"] == 1 for r in labelled_sample(labels, key, label).collect()}  # at most SAMPLE
    wanted = frozenset(i for i, g in labelled.items() if g)
    share = len(wanted) / len(labelled) if labelled else 1.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, liked = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b, texts in _batches(batches, text):
            gram, row = ngrams(texts)
            mark = np.array([k in wanted for k in b.column(b.schema.get_field_index(key)).to_pylist()], bool)
            seen += np.bincount(gram, minlength=BUCKETS)
            liked += np.bincount(gram[mark[row]], minlength=BUCKETS)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some]), pa.array(liked[some])], names=["gram", "n", "good"])

    counted = docs.select(key, text).mapInArrow(lean(count), "gram long, n long, good long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counted.collect():  # at most BUCKETS rows
        raw[r["gram"]], target[r["gram"]] = r["n"], r["good"]
    return Models(np.array(log_ratios(raw, target)), share)


def log_ratios(raw: list[int], target: list[int]) -> list[float]:
    """Log of target to raw probability of each bucket; 0 where neither model has counts."""
    all_raw, all_target = sum(raw), sum(target)
    if not all_target:
        return [0.0] * len(raw)
    prior = PRIOR * all_target
    return [math.log((t + prior * r / all_raw) / (all_target + prior) * all_raw / r) if r else 0.0 for r, t in zip(raw, target)]


def gumbel_key(weight: Column, key: str, seed: int | Column = SEED) -> Column:
    """The weight plus a standard Gumbel number."""
    unit = (F.pmod(F.xxhash64(F.col(key), F.lit(seed) if isinstance(seed, int) else seed), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    return weight - F.log(-F.log(unit))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest of a column, by histograms that are refined until one value is left."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    above = 0  # how many lie over the range looked at
    while low < high:
        width = (high - low) / BINS
        if low + width <= low:
            break
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).cast("int").alias("bin")
        inside = values.where((F.col(column) >= low) & (F.col(column) <= high))
        counts = {r["bin"]: (r["n"], r["a"], r["b"]) for r in inside.groupBy(bin_).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()}
        for b in sorted(counts, reverse=True):
            n, first, last = counts[b]
            if above + n >= k:
                low, high = first, last
                break
            above += n
        if k - above == 1:
            return high
    return low


def resample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", with_text: bool = True,
    share: float | None = None, chunk: int | None = CHUNK, seed: int = SEED,
) -> DataFrame:
    """The rows that are drawn, with log_ratio and draw_key; without texts and other columns if not ``with_text``."""
    models = fit(docs, labels, key, text, label)
    part = models.good if share is None else share
    marked = lambda rows: rows.withColumn("draw_key", gumbel_key(F.col("log_ratio"), key, seed))
    scored = marked(models.weighed(docs.drop("draw_key"), text, chunk=chunk))
    light = models.weighed(docs.select(key, text), text, chunk=chunk).select(key, "log_ratio")
    if part >= 1:
        return scored if with_text else marked(light)
    keys = cut(marked(light))
    k = round(part * keys.count())
    if not k:
        return (scored if with_text else keys).limit(0)
    return (scored if with_text else keys).where(F.col("draw_key") >= kth_largest(keys, "draw_key", k))
