"""Exact top-k by inner product: a ball tree for each shard, searched by branch and bound.

Vectors are dealt to shards of at most ``SHARD_BYTES``. A shard's tree halves its vectors along the
direction of greatest spread down to leaves. A node has a centre c and a radius r, and along the
centre's direction the range and the greatest distance from it, so no vector in it can score more
than the smaller of ``q.c + |q| r`` and of the bound of the cone: the greatest part along the
direction plus |q's rest| * |greatest rest|. Nodes are taken in the order of their bounds. A node is
passed over by the queries whose current k-th score is above its bound (equal bounds are searched,
because ties go to smaller ids). Trees are built once, written to the shared folder as one row a
shard, and read by every block of queries.

Queries go to all tasks in blocks of at most ``BLOCK`` rows and ``BLOCK_BYTES``. A block's k-th
scores are shared: one shard in ``WAVE`` is searched first, its k-th scores travel with the block to
the others, and a task carries them on from shard to shard. Each task returns at most k rows a
query, and a window ranks them. A block's results are written before the next begins and its
broadcast is destroyed, so what driver and tasks hold is one block; there is no join.

Scores are integers. Products that doubles can't hold exactly are computed in whole numbers of any
size, leaf by leaf, in the same search.

How much a tree can pass over is up to the vectors: on clustered ones it passes most products over
(tests/llm), on independent directions in 64 dimensions (as in the given table) no bound of a ball or
cone of more than one vector is below the k-th score, and all products are computed.

Defined results: vectors that are null, or hold a null, NaN or infinite component, take no part; a
component beyond a long's range counts as that range's end; scores beyond it are ranked by their
true value and returned as its end; vectors of another length than the query's are no candidates;
rows with the query's id are the query's own; of rows with one id the first by vector is the query,
and a candidate's id is returned once, with its best score; fewer candidates than k give fewer rows;
an empty table gives none; other columns are left out.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkveil.llm.common import cut, lean

LEAF, BLOCK, WAVE = 32, 8_192, 8
#: A shard's and a block's vectors, as doubles.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 32 << 20
EXACT = 2.0**53
LONG = (1 << 63) - 1
#: Scores as bytes that sort as the scores do: a sum of products of longs is far below 2**191.
KEY_BYTES, KEY_ZERO = 24, 1 << 191


def whole(vector: Column, scale: float = 256.0) -> Column:
    """Each component x as floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


def valid(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


class BallTree:
    """Nodes as arrays, children of node i at child[i] and child[i] + 1 (0: a leaf); vectors in the order of leaves."""

    FIELDS = ("ids", "x", "centre", "radius", "along", "rest", "first", "last", "child")

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order, spans, child = np.arange(len(x)), [(0, len(x))], [0]
        at = 0
        while at < len(spans):
            a, b = spans[at]
            if b - a > LEAF:
                points = x[order[a:b]]
                apart = points - points.mean(axis=0)
                far = np.einsum("ij,ij->i", apart, apart)
                if far.max() > 0:
                    side = apart @ apart[int(far.argmax())]
                    order[a:b] = order[a:b][np.argsort(side, kind="stable")]
                    half = (a + b) // 2
                    child[at] = len(spans)
                    spans += [(a, half), (half, b)]
                    child += [0, 0]
            at += 1
        self.ids, self.x = ids[order], x[order]
        self.child = np.array(child)
        self.first, self.last = (np.array(c) for c in zip(*spans))
        nodes = [self._measured(self.x[a:b]) for a, b in spans]
        self.centre, self.radius, self.along, self.rest = (np.array(c) for c in zip(*nodes))

    @staticmethod
    def _measured(points: np.ndarray) -> tuple:
        """Centre, radius, range along the centre's direction, greatest distance from that line."""
        centre = points.mean(axis=0)
        apart = points - centre
        length = float(np.linalg.norm(centre))
        along = points @ (centre / length) if length else np.zeros(len(points))
        rest = np.einsum("ij,ij->i", points, points) - along**2
        return centre, math.sqrt(np.einsum("ij,ij->i", apart, apart).max()), (along.min(), along.max()), math.sqrt(max(0.0, rest.max()))

    def bounds(self, q: np.ndarray, norms: np.ndarray, n: int) -> np.ndarray:
        """What no vector of node n can score more than, for each query; rounding errors are allowed for."""
        centre, radius, (low, high), rest = self.centre[n], self.radius[n], self.along[n], self.rest[n]
        length = np.linalg.norm(centre)
        on = q @ centre
        ball = on + norms * radius
        if length:
            part = on / length
            cone = np.maximum(part * low, part * high) + np.sqrt(np.maximum(0.0, norms**2 - part**2)) * rest
            ball = np.minimum(ball, cone)
        return ball + 1e-6 * norms * (length + radius) + 1e-6

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpack(cls, packed: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(packed)) as saved:
            for f in cls.FIELDS:
                setattr(tree, f, saved[f])
        return tree


class Search:
    """The k best of each query so far; ids and scores sorted by score, then id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None, wide: bool = False):
        """``wide``: scores may be beyond what doubles hold exactly."""
        self.ids, self.q, self.k, self.wide = ids, q, k, wide
        self.norms = np.sqrt(np.einsum("ij,ij->i", q, q))
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids] if wide else []
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.least = np.full(len(ids), -np.inf) if least is None else least.astype(float)
        self.products = 0  # how many were computed

    def kth(self) -> np.ndarray:
        return np.maximum(self.least, self.scores[:, -1])

    def add(self, who: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.products += len(who) * len(ids)
        if self.wide:
            return self._add_wide(who, ids, x)
        scores = np.where(ids[None, :] == self.ids[who, None], -np.inf, self.q[who] @ x.T)
        better = (scores >= self.kth()[who, None]).any(axis=1) & (scores > -np.inf).any(axis=1)
        who, scores = who[better], scores[better]
        if not len(who):
            return
        s = np.hstack([self.scores[who], scores])
        i = np.hstack([self.found[who], np.where(scores > -np.inf, np.broadcast_to(ids, scores.shape), np.iinfo(np.int64).max)])
        order = np.lexsort((-s, i), axis=1)  # an id's best score first; its others go
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        s[:, 1:][i[:, 1:] == i[:, :-1]] = -np.inf
        i[s == -np.inf] = np.iinfo(np.int64).max
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[who], self.found[who] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def _add_wide(self, who: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        narrow = np.abs(x).max(initial=0) * np.abs(self.q[who]).max(initial=0) * x.shape[1] < EXACT
        whole_ = lambda a: np.array([[int(c) for c in row] for row in a], object).reshape(a.shape)
        scores = self.q[who] @ x.T if narrow else whole_(self.q[who]) @ whole_(x).T
        for w, row in zip(who.tolist(), scores):
            own: dict[int, int] = {i: s for s, i in self.best[w]}
            for i, s in zip(ids.tolist(), row):
                if i != self.ids[w]:
                    own[i] = max(int(s), own.get(i, int(s)))
            self.best[w] = sorted(((s, i) for i, s in own.items()), key=lambda p: (-p[0], p[1]))[: self.k]
            if len(self.best[w]) == self.k:
                self.scores[w, -1] = float(self.best[w][-1][0]) - 1e-9 * abs(float(self.best[w][-1][0]))

    def shard(self, tree: BallTree) -> None:
        """Branch and bound over one shard's tree."""
        if not len(tree.ids) or not len(self.ids):
            return
        heap = [(-math.inf, 0)]
        while heap:
            _, n = heapq.heappop(heap)
            b = tree.bounds(self.q, self.norms, n)
            who = np.flatnonzero(b >= self.kth())
            if not len(who):
                continue
            if c := int(tree.child[n]):
                for child in (c, c + 1):
                    heapq.heappush(heap, (-float(tree.bounds(self.q[who], self.norms[who], child).max()), child))
            else:
                own = slice(tree.first[n], tree.last[n])
                self.add(who, tree.ids[own], tree.x[own])

    def rows(self) -> Iterator[tuple[int, int, int]]:
        """(query, id, score)."""
        if self.wide:
            yield from ((q, i, s) for q, best in zip(self.ids.tolist(), self.best) for s, i in best)
        else:
            who, at = np.nonzero(self.scores > -np.inf)
            yield from zip(self.ids[who].tolist(), self.found[who, at].tolist(), map(int, self.scores[who, at]))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of one length, at most ``SHARD_BYTES`` of them."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for b in batches:
        for ids, x in by_length(b.column(0).to_numpy(zero_copy_only=False), [b.column(1)]):
            n, most = x.shape[1], max(LEAF, SHARD_BYTES // (8 * max(1, x.shape[1])))
            for i in range(0, len(ids), most):
                held.setdefault(n, []).append((ids[i : i + most], x[i : i + most]))
                if sum(len(a) for a, _ in held[n]) >= most:
                    yield tuple(map(np.concatenate, zip(*held.pop(n))))
    for parts in held.values():
        yield tuple(map(np.concatenate, zip(*parts)))


def by_length(ids: np.ndarray, lists: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matrices of the vectors of one length."""
    lengths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in lists])
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists])
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        yield ids[own], values[starts[own][:, None] + np.arange(n)]


def trees(rows: DataFrame) -> DataFrame:
    """dim, wave (0: searched first), tree of each shard of (vec_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches):
            wave = int(int(ids.min()) * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) % WAVE
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([min(wave, 1)], pa.int32()), pa.array([BallTree(ids, x).pack()], pa.binary())], names=["dim", "wave", "tree"])

    return rows.mapInArrow(lean(run), "dim int, wave int, tree binary")


def _searched(shards: DataFrame, block, k: int, wide: bool) -> DataFrame:
    """query_id, vec_id, score, key: the k best of each query in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {n: Search(ids, q, k, least, wide) for n, (ids, q, least) in block.value.items()}
        for b in batches:
            for n, packed in zip(b.column(0).to_pylist(), b.column(1)):
                if n in searches:
                    searches[n].shard(BallTree.unpack(packed.as_py()))
        for s in searches.values():
            rows = list(s.rows())
            for i in range(0, len(rows), 10_000):
                q, v, score = zip(*rows[i : i + 10_000])
                keys = [(x + KEY_ZERO).to_bytes(KEY_BYTES, "big") if wide else None for x in score]
                cells = ((q, pa.int64()), (v, pa.int64()), ([max(-LONG - 1, min(LONG, x)) for x in score], pa.int64()), (keys, pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cells], names=["query_id", "vec_id", "score", "key"])

    return shards.select("dim", "tree").mapInArrow(lean(run), "query_id long, vec_id long, score long, key binary")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, an id once."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("key").alias("key"), F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("key").desc(), F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(queries: DataFrame, number: int, k: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and k-th scores so far of one block's queries, by length; at most some ``BLOCK_BYTES``."""
    table = queries.where(F.col("block") == number).select("vec_id", "v").toArrow().combine_chunks()
    if not table.num_rows:
        return {}
    ids = table.column("vec_id").to_numpy()
    return {x.shape[1]: (own, x, np.full(len(own), -np.inf)) for own, x in by_length(ids, table.column("v").chunks)}


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best."""
    spark = vectors.sparkSession
    fine = vectors.where(valid(F.col(vector)) & F.col(key).isNotNull())
    picked = lambda rows: rows.select(F.col(key).cast("long").alias("vec_id"), whole(F.col(vector)).alias("v"))
    rows = picked(fine)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), most.alias("most")).first()
    if not size["n"]:
        return empty
    dim = max(1, size["dim"])
    wide = size["most"] ** 2 * dim >= EXACT
    m = fine.where(is_query).select(key).distinct().count()
    blocks = math.ceil(m / max(1, min(block, BLOCK_BYTES // (8 * dim))))
    if not blocks:
        return empty
    queries = picked(fine.where(is_query)).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = cut(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(size["n"] * dim * 8 / (4 * SHARD_BYTES)))
    shards = cut(trees(rows.repartition(parts, "vec_id")))
    found = []
    for i in range(blocks):  # as many turns as there are blocks of queries
        own = _block(queries, i, k)
        for wave in (0, 1) if own else ():
            sent = spark.sparkContext.broadcast(own)
            out = cut(_searched(shards.where(F.col("wave") == wave), sent, k, wide))
            sent.destroy()
            found.append(out)
            if wave == 0 and not wide:
                least = {r["query_id"]: r["score"] for r in _ranked(out, k).where(F.col("rank") == k).collect()}  # a row a query at most
                own = {n: (ids, x, np.array([least.get(j, -np.inf) for j in ids.tolist()], float)) for n, (ids, x, _) in own.items()}
    if not found:
        return empty
    every = found[0]
    for x in found[1:]:
        every = every.unionAll(x)
    return _ranked(every, k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
