
import random
from collections import Counter

import numpy as np
import pytest

from larkveil.llm import minhash, packing
from larkveil.llm import queries as Q
from tests.llm.test_operators import SF, frame, words


def groups(rows, percent):
    """The smallest id of each row's group by brute force."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    top = {i: i for i in sets}
    for _ in range(len(rows)):
        changed = False
        for i in sets:
            for j in sets:
                if sets[i] and top[i] < top[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    top[j], changed = top[i], True
        if not changed:
            break
    return top


def test_the_near_duplicates_stage_links_from_80_percent(spark):
    import corpus_pipeline as C

    rng = random.Random(80)
    rows = []
    for i in range(25):
        w = words(rng, 120, 10_000)
        rows.append((10 * i, " ".join(w)))
        for j in range(1, 4):  # two edits cost ten of 116 shingles: 0.84; three: 0.77
            v = list(w)
            for at in rng.sample(range(8, 112, 8), j):
                v[at] = f"e{i}x{j}x{at}"
            rows.append((10 * i + j, " ".join(v)))
    at80, at85 = ({i for i, c in groups(rows, p).items() if i == c} for p in (80, 85))
    assert at80 < at85
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars long")
    assert {r["doc_id"] for r in C.near_duplicates(spark, docs, SF).collect()} == at80
    assert {r["doc_id"] for r in minhash.near_dedup(frame(spark, rows)).collect()} == at85


@pytest.mark.parametrize("percent, rows", [(85, 8), (80, 6)])
def test_bands_follow_from_the_percentage(percent, rows):
    assert minhash.band_rows(percent) == rows and (1 - (percent / 100) ** rows) ** (minhash.MINIMA // rows) < 1e-6


def test_related_documents_meet_in_one_shard(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, 40, 300))) for i in range(1000)]
    for i in range(1000, 1200, 2):  # pairs that share some rare words, far from each other in the table
        rare = [f"{rng.randrange(10**9)}" for _ in range(12)]
        rows += [(i + j, " ".join([*words(rng, 20, 300), *rare])) for j in (0, 1)]
    rows += [(5000 + i, "one text that many rows hold, over and over") for i in range(700)]
    rng.shuffle(rows)
    out = packing.pack(frame(spark, rows), Q.tokenizer("byte_bpe_50k.tiktoken"), Q.split_pattern(), shard=64).collect()
    shards: dict = {}
    for r in out:
        shards.setdefault(r["doc_id"], set()).add(r["sequence_id"] >> 32)
    assert len(shards) == len(rows) and all(len(x) == 1 for x in shards.values())
    assert sum(shards[i] == shards[i + 1] for i in range(1000, 1200, 2)) >= 60  # 73; by chance 4
    sizes = Counter(next(iter(x)) for x in shards.values())
    assert max(sizes.values()) <= 4 * 64 and len(sizes) >= len(rows) / 64 / 2


def test_statistics_are_those_of_the_corpus(spark):
    rows = [(i, f"same {i % 7} " * (i % 5)) for i in range(300)]
    docs = frame(spark, rows).repartition(5)
    n, mean, df = packing.statistics(packing._coded(docs, "doc_id", "text", Q.tokenizer("byte_bpe_50k.tiktoken"), Q.split_pattern()))
    encode = packing.encoder(Q.tokenizer("byte_bpe_50k.tiktoken"), Q.split_pattern()).encode_ordinary
    coded = [encode(t) for _, t in rows]
    assert n == 300 and abs(mean - sum(map(len, coded)) / 300) < 1e-9
    assert {t: df[t] for t in np.flatnonzero(df)} == Counter(t for c in coded for t in set(c))
    # a shard of one related pair weighs terms by all documents, not by the two
    pair = [np.array([5, 9])] * 2
    counts = [np.array([1, 1])] * 2
    assert not packing.Index(pair, counts).scores(0).any()
    own = np.zeros(packing.TERMS, np.int64)
    own[[5, 9]] = 2
    assert packing.Index(pair, counts, (1000, 2.0, own)).scores(0).min() > 1


def test_op9_gives_the_ids_of_the_library_at_its_defaults(spark, tmp_path):
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer("byte_bpe_50k.json"))
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>b\n<|endoftext|> ", "<|endoftext", "plain, it's 12 é中", " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    coded = packing.encoder(Q.tokenizer("byte_bpe_50k.tiktoken"), Q.split_pattern(), Q.special_tokens("byte_bpe_50k.json"))
    for x in texts:
        assert coded.encode(x, allowed_special="all") == t.encode(x, add_special_tokens=False).ids
    got = Q.op9_packing(spark, str(tmp_path)).collect()
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        own = [r for r in got if r["doc_id"] == i]
        assert {r["doc_tokens"] for r in own} == {len(ids)}
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_the_lines_stage_drops_repeated_lines_in_every_host(spark):
    import corpus_pipeline as C

    def page(h, i):
        planted = [f"line on one in {n}" for n in (10, 25, 50) if i % n == 0]
        return "\n".join([f"own {h} {i}", *planted, *(["on four pages"] if i < 4 else [])])

    rows = [(1000 * h + i, page(h, i), f"host{h}", 0) for h in range(4) for i in range(400 + 50 * h)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in C.lines(spark, docs, SF).collect()}
    assert len(out) == len(rows)
    for i, text, _, _ in rows:
        assert out[i].split("\n") == [x for x in text.split("\n") if not x.startswith("line on")]
