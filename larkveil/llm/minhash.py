"""Near-duplicate groups by b-bit MinHash, with exact links.

A document's set is its distinct five-word shingles. Two documents are linked if the intersection
of their sets is at least ``percent`` percent of the union; groups are the components.

1. Each set gets ``MINIMA`` minima. A band's minima together are a bucket key; of the minima
   the low ``BITS`` bits are kept, packed as bit planes. Equal sets are one node from here on.
2. Documents that share a bucket are candidates. Bands are as long as ``MISS`` allows: with 48
   bands of 8 rows a pair at 85 percent shares none with a probability of 3e-7, with 64 bands of 6
   rows a pair at 80 percent with one of 4e-9.
3. Of each bucket the node with the most copies is the hub; a node's anchor is the hub with the
   most copies of all its buckets. Every node is compared with its anchor on whole sets.
4. Nodes of one anchor: let D be the difference (symmetric) of a node's set from the anchor's.
   Two nodes' sets differ by |D1| + |D2| - 2 |D1 and D2|, so whether they are linked follows from
   the Ds alone. If both are linked with the anchor they are in one group already. Else the Ds
   must overlap by a known number, and a prefix filter (all D in one order, what the anchor lacks
   first) leaves only pairs that share one of the first elements; these are compared by sizes and
   packed bits (as in step 5) where they meet, and only those alike enough become rows. So a group
   of thousands of variants of one text costs about a row each, not a row for each pair.
5. Nodes of different anchors that share a bucket, and are of sizes that linked sets can have, are
   compared by their packed bits where they meet: the rate of equal bits, corrected for equal bits
   by chance, estimates the similarity; pairs whose estimate is at most 5 standard deviations short
   are compared on whole sets. So texts that share a passage only never become pairs.
6. The links' components are found by stars (see components.py).

Sets are 64-bit hashes; whole sets are made again from the texts of candidates only. Tables that
grow are written to the shared folder or joined by shuffles; nothing of all documents reaches the
driver. Ids of candidates are broadcast only if they were counted to be few.

Defined results: null and empty texts, and texts of white space, have the empty set, are linked
with nothing and kept; fewer than five words are one shingle, the whole sequence; repeated rows
are linked like any equal texts; of rows with one id but different texts the one with the smallest
digest stands for the id; rows with a null id have a null component and are kept; other columns
pass through ``near_dedup`` untouched. Ids of other types than whole numbers: each row is linked by its
own text, and a group has its smallest id that isn't null. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkveil.llm.common import cut, discard, fresh_name, lean
from larkveil.llm.components import components

WORDS, PERCENT = 5, 85
MINIMA, BITS = 384, 2
PLANE = MINIMA // 64
#: Probability that a pair right at the limit shares no bucket, at most.
MISS = 1e-6
#: Nodes less like their hub than this percentage are their own anchor.
NEAR = 40
#: Ids that may be broadcast, with a digest of 16 bytes: some 60 MB as a hash table at most.
BROADCAST_IDS = 1_000_000

_M = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20_240_607)
_A = (_rng.integers(0, 2**31, MINIMA, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)
_x64 = xxhash.xxh3_64_intdigest


def band_rows(percent: int) -> int:
    """The most minima a band can have so that bands miss a pair at this percentage by ``MISS`` at most."""
    return max(r for r in range(1, MINIMA + 1) if MINIMA % r == 0 and (r == 1 or (1 - (percent / 100) ** r) ** (MINIMA // r) <= MISS))


def least_estimate(percent: int) -> float:
    """5 standard deviations of the estimate below the limit."""
    p = 2.0**-BITS + (1 - 2.0**-BITS) * percent / 100
    return percent / 100 - 5 * (p * (1 - p) / MINIMA) ** 0.5 / (1 - 2.0**-BITS)


def delta(percent: int) -> float:
    """Share of the two sizes by which linked sets can differ."""
    return (100 - percent) / (100 + percent)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted. Words are runs without ASCII white space, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n < WORDS:
        return np.array([_x64(b" ".join(words))] if n else [], "<u8")
    w = np.fromiter(map(_x64, words), "<u8", n)
    h = w[: n - WORDS + 1].copy()
    for k in range(1, WORDS):
        h = h * _M + w[k : n - WORDS + 1 + k]
    return np.unique(_mix(h))


def minima(own: np.ndarray) -> np.ndarray:
    low = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(out, (low[i : i + 512, None] * _A + _B).min(axis=0), out=out)
    return out


def bands(m: np.ndarray, rows: int) -> np.ndarray:
    h = np.arange(1, MINIMA // rows + 1, dtype=np.uint64) * _M
    for row in m.reshape(-1, rows).T.astype(np.uint64):
        h = _mix(h * _M + row)
    return h.view(np.int64)


def planes(m: np.ndarray) -> np.ndarray:
    return np.concatenate([np.packbits((m >> np.uint32(j) & np.uint32(1)).astype(bool)).view("<i8") for j in range(BITS)])


def estimate(a: Column, b: Column) -> Column:
    """The similarity that two packed signatures tell, corrected for bits that agree by chance."""
    differ = None
    for w in range(PLANE):
        word = F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))
        for j in range(1, BITS):
            word = word.bitwiseOR(F.get(a, F.lit(w + j * PLANE)).bitwiseXOR(F.get(b, F.lit(w + j * PLANE))))
        differ = F.bit_count(word) if differ is None else differ + F.bit_count(word)
    chance = 2.0**-BITS
    return ((MINIMA - differ) / float(MINIMA) - chance) / (1 - chance)


def signatures(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """id, n, digest, bands, planes of each row."""
    rows = band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.slice(i, 1024)
                n, digest, keys, bits = [], [], [], []
                for x in part.column(1):
                    own = shingles(x.as_py())
                    n.append(len(own))
                    digest.append(xxhash.xxh3_128_digest(own.tobytes()))
                    m = minima(own) if len(own) else None
                    keys.append(None if m is None else bands(m, rows))
                    bits.append(None if m is None else planes(m))
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "digest", "bands", "planes"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(lean(run), "id long, n long, digest binary, bands array<long>, planes array<long>")


def whole_sets(docs: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """id, set (bytes) of the documents in ``ids`` (id, digest)."""
    few = ids.count() <= BROADCAST_IDS
    own = fresh_name(docs.columns, "id")
    wanted = ids.select(F.col("id").alias(own), "digest")
    picked = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).join(F.broadcast(wanted) if few else wanted, F.col("id") == F.col(own)).select("id", "digest", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1024):
                part, out = b.slice(i, 1024), {}
                for key_, digest, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    own_ = shingles(x.as_py())
                    if xxhash.xxh3_128_digest(own_.tobytes()) == digest:
                        out[key_] = own_.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["id", "set"])

    return picked.mapInArrow(lean(run), "id long, set binary").dropDuplicates(["id"])


def _compared(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b, n_a, n_b, linked, difference (what b has and a lacks first), of rows a, b, set_a, set_b. b is the anchor of a or any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                sizes_a, sizes_b, linked, like, diff = [], [], [], [], []
                for x, y in zip(part.column(2), part.column(3)):
                    p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                    added, lacking = np.setdiff1d(p, q, True), np.setdiff1d(q, p, True)
                    common = len(p) - len(added)
                    union = len(p) + len(q) - common
                    sizes_a.append(len(p))
                    sizes_b.append(len(q))
                    linked.append(100 * common >= percent * union)
                    near = 100 * common >= NEAR * union
                    like.append(near)
                    # an element's place in the common order: those that the anchor lacks come first
                    diff.append(np.concatenate([added, lacking]).view(np.int64) if near else None)
                arrays = [pa.array(sizes_a, pa.int64()), pa.array(sizes_b, pa.int64()), pa.array(linked, pa.bool_()), pa.array(like, pa.bool_()), pa.array(diff, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["a", "b", "n_a", "n_b", "linked", "near", "diff"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(lean(run), "a long, b long, n_a long, n_b long, linked boolean, near boolean, diff array<long>")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(a, "a").join(b, "b")


def _among(anchored: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of one anchor, at least one of which isn't linked with it (step 4)."""
    apart_at_most = delta(percent)
    d = F.size("diff")
    half = F.floor(d * (1 - apart_at_most) / 2 - 1e-9).cast("int") + 1  # overlap with a node that isn't linked with the anchor, at least
    weak = F.greatest(F.lit(1), F.ceil((d - apart_at_most * (F.col("n_a") + F.col("n_b"))) / (1 + apart_at_most) - 1e-9).cast("int"))
    near = anchored.where("near AND a <> b").join(nodes.select(F.col("id").alias("a"), "planes"), "a")
    rows = near.select(F.col("b").alias("anchor"), "a", "n_a", "linked", "diff", "planes", F.greatest(F.lit(0), d - half + 1).alias("index"), (d - weak + 1).alias("probe"))

    def first(side: str, how_many: str, name: str) -> DataFrame:
        cells = F.posexplode(F.slice("diff", F.lit(1), F.col(how_many))).alias(f"at_{name}", "e")
        own = rows.where(side).select("anchor", F.col("a").alias(name), F.col("n_a").alias(f"m_{name}"), F.size("diff").alias(f"s_{name}"), F.col("planes").alias(f"p_{name}"), cells)
        return own.alias(f"of_{name}")

    # what this pair must share, and so how far from the end its first shared element stands at least
    share = F.greatest(F.lit(1), F.ceil((F.col("s_x") + F.col("s_y") - apart_at_most * (F.col("m_x") + F.col("m_y"))) / 2 - 1e-9))
    early = (F.col("at_x") + share <= F.col("s_x")) & (F.col("at_y") + share <= F.col("s_y"))
    sizes = 100 * F.least("m_x", "m_y") >= percent * F.greatest("m_x", "m_y")
    alike = estimate(F.col("p_x"), F.col("p_y")) >= least_estimate(percent)
    meet = F.expr("of_x.anchor = of_y.anchor AND of_x.e = of_y.e AND x <> y")
    met = first("NOT linked", "probe", "x").join(first("true", "index", "y"), meet & early & sizes & alike)
    pairs = met.select(F.col("of_x.anchor").alias("anchor"), "x", "y").distinct()
    x = rows.select("anchor", F.col("a").alias("x"), F.col("n_a").alias("n_x"), F.col("diff").alias("d_x"))
    y = rows.select("anchor", F.col("a").alias("y"), F.col("n_a").alias("n_y"), F.col("diff").alias("d_y"))
    both = pairs.join(x, ["anchor", "x"]).join(y, ["anchor", "y"])
    apart = F.size("d_x") + F.size("d_y") - 2 * F.size(F.array_intersect("d_x", "d_y"))
    total = F.col("n_x") + F.col("n_y")
    # common = (total - apart) / 2 and union = (total + apart) / 2
    return both.where(100 * (total - apart) >= percent * (total + apart)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _across(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket but different anchors whose packed bits are alike enough (step 5).

    Rows meet by bucket and class of size (linked sets differ by one class at most) and are compared in the join itself, so only
    pairs that are alike enough ever become rows.
    """
    main = members.groupBy("bucket").agg(F.max(F.struct("copies", (-F.col("id")).alias("minus"), "anchor")).alias("top"), F.min("anchor").alias("low"), F.max("anchor").alias("high"))
    mixed = main.where("low <> high").select("bucket", F.col("top.anchor").alias("main"))
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    size = F.floor(F.log(F.col("n").cast("double")) / step).alias("size")
    own = members.join(mixed, "bucket").select("bucket", "id", "anchor", "main").join(nodes.select("id", "n", "planes"), "id")
    left = own.where("anchor <> main").select("bucket", size, F.col("id").alias("a"), F.col("anchor").alias("anchor_a"), F.col("n").alias("s_a"), F.col("planes").alias("p_a"))
    right = own.select(
        "bucket", F.explode(F.array(size - 1, size, size + 1)).alias("size"), F.col("id").alias("b"), F.col("anchor").alias("anchor_b"), (F.col("anchor") == F.col("main")).alias("is_main"),
        F.col("n").alias("s_b"), F.col("planes").alias("p_b"),
    )
    x, y = left.alias("x"), right.alias("y")
    meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.size") == F.col("y.size")) & F.expr("anchor_a <> anchor_b AND (is_main OR a < b)")
    sizes = 100 * F.least("s_a", "s_b") >= percent * F.greatest("s_a", "s_b")
    alike = estimate(F.col("p_a"), F.col("p_b")) >= least_estimate(percent)
    return x.join(y, meet & sizes & alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _numbered(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """``near_duplicates`` for ids that aren't whole numbers: rows are numbered, written, and get their groups' smallest id in the end."""
    number = fresh_name([key, text], "row")
    rows = cut(docs.select(F.monotonically_increasing_id().alias(number), key, text))
    found = near_duplicates(rows, number, text, percent).join(rows.select(number, key), number)
    least = found.groupBy("component_id").agg(F.min(key).alias("least"))
    out = found.join(least, "component_id").select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        return _numbered(docs, key, text, percent)
    rows = cut(signatures(docs, key, text, percent))
    own = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("digest").alias("digest"))
    sets_of = rows.select("digest", "n", "bands", "planes").where("n > 0")
    grouped = own.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    first = sets_of.groupBy("digest").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("planes").alias("planes"))
    nodes = cut(grouped.join(first, "digest"))  # id: the smallest of the documents with this set
    dealt = nodes.select("id", "copies", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("size"), F.max(F.struct("copies", (-F.col("id")).alias("minus"))).alias("hub")).where("size > 1")
    met = cut(dealt.join(shared.select("bucket", "hub"), "bucket"))
    anchor = met.groupBy("id").agg(F.max("hub").alias("hub")).select(F.col("id").alias("a"), (-F.col("hub.minus")).alias("b"))
    candidates = cut(anchor.join(nodes.select(F.col("id").alias("a"), "digest"), "a"))
    sets = cut(whole_sets(docs, key, text, candidates.select(F.col("a").alias("id"), "digest")))
    anchored = cut(_compared(_with_sets(candidates.where("a <> b").select("a", "b"), sets), percent))
    starred = anchored.where("linked").select("a", "b")
    near = anchored.where("near").select(F.col("a").alias("id"), F.col("b").alias("near"))
    members = met.join(near, "id", "left").select("bucket", "id", "copies", F.coalesce("near", "id").alias("anchor"))
    across = cut(_across(members, nodes, percent))
    checked = _compared(_with_sets(across, sets), percent).where("linked").select("a", "b")
    links = starred.unionAll(_among(anchored, nodes, percent)).unionAll(checked)
    groups = cut(components(links).join(nodes.select("id", "digest"), "id").select("digest", "component"))
    discard(met, candidates, sets, anchored, across)
    alone = nodes.select("digest", "id")
    labels = alone.join(groups, "digest", "left").select("digest", F.coalesce("component", "id").alias("component"))
    by_id = own.join(labels, "digest", "left").select("id", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", "n").join(by_id, "id", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that aren't the first of their group."""
    gone = cut(near_duplicates(docs, key, text, percent).where("NOT kept").select(F.col(key).alias("gone")).distinct())
    few = gone.count() <= BROADCAST_IDS
    name = fresh_name(docs.columns, "gone")
    gone = gone.withColumnRenamed("gone", name)
    return docs.join(F.broadcast(gone) if few else gone, F.col(key) == F.col(name), "left_anti")
