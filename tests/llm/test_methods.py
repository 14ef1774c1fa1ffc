"""That each operator does its work by its method: what changes when a parameter of the method does, and brute force for its parts."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkveil.llm import ball_tree, line_dedup, resampling, surrogates, tag_paths
from tests.llm.test_operators import SF, frame, words

# --- 2 ---


def brute_lines(rows, ratio, least):
    """Cleaned texts by pages over the host's pages."""
    pages = Counter(h for _, _, h in rows)
    lines = Counter((h, x.strip(" ")) for _, t, h in rows if t is not None for x in {y.strip(" ") for y in t.split("\n")} if x)
    bad = {k for k, n in lines.items() if n >= least and n / pages[k[0]] > ratio}
    return sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in bad)) for i, t, h in rows)


@pytest.mark.parametrize("ratio, least", [(0.1, 2), (0.3, 2), (0.3, 1)])
def test_lines_by_pages_over_the_hosts_pages(spark, ratio, least):
    rng = random.Random(2)
    rows = [(i, "\n".join(f"{rng.choice(['', ' '])}line {min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randint(0, 6))), rng.choice(["a", "a", "b", "c"])) for i in range(60)]
    rows += [(100 + i, "copy one\ncopy two", "a") for i in range(9)] + [(200, None, "b"), (201, "", "b"), (202, "only here", "d"), (203, "same\nsame", "e"), (204, "x", "e")]
    out = line_dedup.line_dedup(frame(spark, rows), max_ratio=ratio, min_pages=least).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == brute_lines([(*r,) for r in rows], ratio, least)


def test_null_hosts_and_hosts_of_addresses(spark):
    rows = [(1, "a\nb", None), (2, "a\nc", None), (3, "a", "x")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == {1: ("b", 1), 2: ("c", 1), 3: ("a", 0)}
    urls = [("https://user@Www.Site.org:8080/p?q#f", "www.site.org"), ("//cdn.x/", "cdn.x"), ("mailto:a@b", None), ("", None), (None, None), ("http://a.b?c", "a.b")]
    out = spark.createDataFrame([(u,) for u, _ in urls], "u string").select(line_dedup.url_host(F.col("u"))).collect()
    assert [r[0] for r in out] == [h for _, h in urls]


# --- 3 ---


def test_numbers_are_permuted_without_fixed_points():
    for n in range(2, 200):
        out = [surrogates.moved(x, n, b"seed") for x in range(n)]
        assert sorted(out) == list(range(n)) and all(x != y for x, y in enumerate(out))
    assert surrogates.moved(0, 1, b"seed") == 0 and 0 <= surrogates.moved(5, 10**40, b"seed") < 10**40


KINDS = {
    "IP": [f"192.168.{a}.{b}" for a in range(0, 256, 5) for b in range(0, 256, 7)] + ["8.8.8.8", "1.2.3.4", "224.0.0.1", "0.0.0.0"],
    "CARD": [f"4{i:04d}77777773333" for i in range(700)] + ["4111111111111111", "5500000000000004"],
    "PHONE": [f"+4930{i:04d}" for i in range(900)] + ["2125550199", "2125560199", "0301234567"],
    "EMAIL": [f"{a}{b}@x.de" for a in "abcdefgh" for b in "abcdefghijklm"] + ["محمد@شركة.com", "שלום@דוגמה.co.il", "홍길동@회사.kr", "a@mail.example.com", "x" * 70 + "@b.de"],
    "SECRET": ["".join(x) for x in itertools.product("abg1", repeat=5)] + ["******", "!!!???###", "§§§§§§", "sk-abcdef1234567890", "ß" * 6, "y" * 3000],
    "SSN": [f"{i:09d}" for i in range(500)],
    "IBAN": [f"DE{surrogates._iban_check('DE', f'{i:018d}'):02d}{i:018d}" for i in range(300)] + ["GB00ABCD12345612345678"],
    "INITIAL": list("abcdefghijklmnopqrstuvwxyz"),
}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_draws_are_distinct_and_keep_the_shape(kind):
    values = KINDS[kind]
    out = [surrogates.draw_normal(kind, v, b"k", 0) for v in values]
    assert len(set(out)) == len(values) and not any(a == b for a, b in zip(values, out))
    odd = [v for v, o in zip(values, out) if surrogates.shape(kind, v) != surrogates.shape(kind, o)]
    assert odd in ([], ["§§§§§§", "ß" * 6])  # alone in their shapes
    assert out != [surrogates.draw_normal(kind, v, b"other", 0) for v in values]


def test_a_full_network_and_bare_repeats_lose_every_value(spark):
    hosts = [f"192.168.{a}.{b}" for a in range(0, 256) for b in range(0, 256, 4)]
    rows = [(i, " ".join(hosts[i::32])) for i in range(32)]
    rows += [(100, "password: ******"), (101, "mail محمد@شركة.com or שלום@דוגמה.co.il or 홍길동@회사.kr or ผู้ใช้@บริษัท.th"), (102, "token: !!!???###")]
    rows += [(103, "Frau Anna Keller kam. Keller sagte: Anna Keller ist da. Dr. Anna"), (104, "Dr. Anna Keller-Berg, Kellers Haus"), (105, "Herr Anna Keller"), (106, "KELLER")]
    out = {r["doc_id"]: r["text"] for r in surrogates.surrogate(frame(spark, rows)).collect()}
    new = [x for i in range(32) for x in out[i].split()]
    assert len(set(new)) == len(hosts) and all(re.fullmatch(r"192\.168\.\d+\.\d+", x) for x in new) and not any(a == b for i in range(32) for a, b in zip(hosts[i::32], out[i].split()))
    assert "***" not in out[100] and "???" not in out[102] and re.fullmatch(r"password: \S{6,}", out[100])
    assert not re.search("محمد|شركة|שלום|דוגמה|홍길동|회사|ผู้ใช้|บริษัท", out[101]) and out[101].count("@") == 4
    m = re.fullmatch(r"Frau (\w+) (\w+) kam\. (\w+) sagte: (\w+) (\w+) ist da\. Dr\. (\w+)", out[103])
    assert m[1] == m[4] == m[6] and m[2] == m[3] == m[5] and {m[1], m[2]}.isdisjoint({"Anna", "Keller"})
    assert out[104].startswith(f"Dr. {m[1]} {m[2]}-") and out[104].endswith(f"{m[2]}s Haus") and out[105] == f"Herr {m[1]} {m[2]}" and out[106] == "KELLER"


@pytest.mark.parametrize(
    "text, left",
    [
        ("Frau Dr. Anna Keller, ja", "Anna Keller"), ("Dr. J. Smith", "J Smith"), ("Mr O'Brien", "Brien"), ("Frau Müller-Lüdenscheidt", "Müller Lüdenscheidt"),
        ("Mr John Fitzgerald Kennedy", "John Fitzgerald Kennedy"), ("Frau von der Leyen", "Leyen"), ("4111111111111111 123", "4111111111111111"),
        ("A@B.DE.", "A@B"), ("x" * 70 + "@b.de", "xx"),
    ],
)
def test_whole_values_are_found(text, left):
    out, n = surrogates.replace(text, b"k", {})
    assert n and not any(re.search(rf"(?<!\w){re.escape(x)}(?!\w)", out) for x in left.split())


def test_gender_is_what_all_documents_tell(spark):
    rows = [(1, "Frau Maria Stein"), (2, "Dr. Maria Stein"), (3, "Herr Kim Berg"), (4, "Frau Kim Berg"), (5, "Herr Paul Maria Stein")]
    values = {(r["kind"], r["value"]): (r["gender"], r["mixed"]) for r in surrogates.entities(frame(spark, rows)).collect()}
    assert values["NAME", "kim"] == ("", True) and values["NAME", "stein"] == ("", False) and values["NAME", "paul"] == ("m", False) and values["NAME", "maria"] == ("", True)
    out = {r["doc_id"]: r["text"].split() for r in surrogates.surrogate(frame(spark, rows)).collect()}
    assert out[1][1:] == out[2][1:] and out[3][1:] == out[4][1:] and out[5][2:] == out[1][1:]


def test_the_key_is_the_sessions(spark):
    rows = frame(spark, [(1, "a@b.de")]).withColumn("N_Replaced", F.lit("x"))
    first = surrogates.surrogate(rows).first()
    spark.conf.set(surrogates.KEY_SETTING, "one more")
    try:
        assert surrogates.surrogate(rows).first()["text"] != first["text"] and first["n_replaced"] == 1
    finally:
        spark.conf.unset(surrogates.KEY_SETTING)


# --- 4 ---


def clustered(rng, n=2000, dim=32, of=20):
    centres = rng.normal(size=(of, dim))
    return np.floor(256 * (centres[rng.integers(0, of, n)] + 0.03 * rng.normal(size=(n, dim))))


def test_the_tree_passes_over_what_can_not_be_best():
    rng = np.random.default_rng(5)
    x, ids = clustered(rng), np.arange(2000)
    tree = ball_tree.BallTree.unpack(ball_tree.BallTree(ids, x).pack())
    q = x[::50]
    s = ball_tree.Search(ids[::50], q, 5)
    s.shard(tree)
    products = q @ x.T
    np.put_along_axis(products, ids[::50][:, None], -np.inf, 1)
    for i in range(len(q)):
        best = np.lexsort((ids, -products[i]))[:5]
        assert s.found[i].tolist() == best.tolist() and s.scores[i].tolist() == products[i][best].tolist()
    assert s.products < 0.5 * products.size
    given = ball_tree.Search(ids[::50], q, 5, least=s.scores[:, -1])  # a k-th score that others share
    given.shard(tree)
    assert np.array_equal(given.found, s.found) and given.products < 0.7 * s.products
    for n in range(len(tree.first)):  # no bound is below a product
        own = tree.x[tree.first[n] : tree.last[n]]
        assert (tree.bounds(s.q, s.norms, n) >= (q @ own.T).max(axis=1)).all()


def test_repeated_ids_and_huge_components(spark):
    rows = [(0, [1.0, 1.0]), (1, [2.0, 2.0]), (1, [2.0, 2.0]), (1, [3.0, 0.0]), (2, [1.0, 0.5]), (3, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ball_tree.top_k(df, F.col("vec_id") == 0, 3).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in out) == [(1, 1, 4 * 65536), (2, 2, 98304), (3, 3, 65536)]
    huge = spark.createDataFrame([*rows, (7, [1e300, 1e300]), (8, [1e300, 1.0]), (9, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    out = ball_tree.top_k(huge, F.col("vec_id").isin(0, 7), 20).collect()
    got = {q: [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 7)}
    top = 2**63 - 1
    assert got[0] == [(7, top), (8, top), (1, 4 * 65536), (2, 98304), (3, 65536), (9, -top - 1)]
    assert got[7] == [(8, top), (1, top), (0, top), (2, top), (3, top), (9, -top - 1)]


# --- 5 ---

PARAGRAPH = "<p>Paragraph number {}, with some marks. It goes on, as texts do; and it ends here, at last.</p>"
BODY = "".join(PARAGRAPH.format(i) for i in range(4))


def lines_of(html, **how):
    return tag_paths.extract(html, **how).split("\n")


def test_ratios_decide():
    page = f"<div class=text><h2>Head</h2>{BODY}<ul><li>one<li>two</ul>{BODY}</div><div class=more><p>Rights, all.</p><p>More, of it.</p></div>"
    whole = lines_of(page, threshold=1.2)
    assert whole[0] == "Head" and len(whole) == 11 and whole[5:7] == ["one", "two"]
    assert len(lines_of(page, threshold=-10)) == 13 and lines_of(page, threshold=9) == [""]
    flat = tag_paths.scores(tag_paths.read(page).blocks, (1.0,))
    assert flat != tag_paths.scores(tag_paths.read(page).blocks)
    counts = {len(lines_of(page, threshold=t / 10, kernel=k)) for t in range(0, 40) for k in (tag_paths.KERNEL, (1.0,), (1.0,) * 5)}
    assert len(counts) >= 3
    differ = [t for t in range(0, 400) if lines_of(page, threshold=t / 100) != lines_of(page, threshold=t / 100, kernel=(1.0,) * 5)]
    assert differ


def test_ratios_and_scores_by_brute_force():
    page = f'<nav><a>x, y</a></nav><div class=a>{BODY}<p>see <a href="#">this, here</a></p><ul><li>one<li><a>two</a></ul></div><table><tr><td>cell, one<td>two</table>'
    found = tag_paths.read(page).blocks
    paths = [e.path for e, _, _ in found]
    marks = [len(re.findall(r"[.,;:!?]", t)) for _, t, _ in found]
    for p in set(paths):
        own = [i for i, x in enumerate(paths) if x == p]
        n = sum(len(found[i][1]) for i in own)
        ratio = n / len(own) * (1 + sum(marks[i] for i in own) / len(own)) * (1 - sum(found[i][2] for i in own) / n)
        assert math.isclose(tag_paths.ratios(found)[p], max(0, ratio))
    raw = [tag_paths.ratios(found)[p] for p in paths]
    fused = []
    for i in range(len(raw)):
        w = {j: math.exp(-((i - j) ** 2) / 2) for j in range(len(raw)) if abs(i - j) <= tag_paths.REACH}
        fused.append(math.sqrt(raw[i] * sum(raw[j] * x for j, x in w.items()) / sum(w.values())))
    score, deviation = tag_paths.scores(found)
    assert math.isclose(deviation, np.std(fused)) and all(math.isclose(score[p], np.mean([f for f, x in zip(fused, paths) if x == p])) for p in paths)


@pytest.mark.parametrize(
    "html, paragraphs, also, without",
    [
        (f'<div class="layout-sidebar"><article><h1>T</h1>{BODY}</article></div>', 4, "T", "x"),
        (f'<div class="content has-sidebar"><h1>T</h1>{BODY}</div><div class=sidebar><p>Side, it is short.</p></div>', 4, "T", "Side"),
        (f'<article>{BODY}<div class="market-share"><p>The share, it rose.</p></div><h2 id=related-work>Work</h2><p id="notice-1">Note this, please.</p></article>', 4, "share, it|Work|Note", "x"),
        (f'<article><section id="social-history">{BODY}</section></article>', 4, "", "x"),
        (f'<div class=post>{BODY}</div><div class="comments">{BODY * 3}</div>', 4, "", "x"),
        (f'<main>{BODY}<div id="reader-comments">{BODY}</div></main>', 4, "", "x"),
        (f"<div class=widget>{BODY}</div>", 4, "", "x"),
        (f'<article>{BODY}<div class="ad-box"><p>Buy, now. Buy more, and more.</p></div>{BODY}<div class="cookie-banner">Cookies, many.</div></article>', 8, "", "Buy|Cookies"),
        (f'<main class="page no-header"><header><h1>T</h1>by me</header>{BODY}</main><footer>{BODY}</footer><aside>{BODY}</aside><form>{BODY}</form>', 4, "T", "by me"),
        (f'{BODY}<p title="a > b <i>">attr, ok</p><script>var x="</p>, no.";</script><!-- no, no -->', 4, "attr, ok", "var|no, no"),
    ],
)
def test_pages_of_other_makes(html, paragraphs, also, without):
    text = tag_paths.extract(html)
    assert text.count("Paragraph number") == paragraphs and all(x in text for x in also.split("|")) and not any(x in text.replace("texts", "") for x in without.split("|") if x != "x")


def test_pages_through_spark_and_deep_ones(spark):
    rows = [(1, "u", None, "t"), (2, "u", "", "t"), (3, None, "<p>a,&nbsp; b", "t"), (3, None, "<p>a,&nbsp; b", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    out = tag_paths.extract_text(df).collect()
    assert sorted((r["page_id"], r["url"], r["text"]) for r in out if r["url"]) == [(1, "u", ""), (2, "u", "")] and [r["text"] for r in out if not r["url"]] == ["a, b"] * 2
    assert tag_paths.extract_text(df.limit(0)).count() == 0
    for html, n in (("<div class=a>" * 20000 + "x, y.", 5), ('<div "' * 5000, 0), ("<div><p>a, b.</p></div>" * 5000, 5 * 5000 + 4999), ("</b></p>" * 9999 + "a", 1), ("<!-- " * 9999 + "a", 0), ("<script>" + "a, b. " * 999, 0)):
        assert len(tag_paths.extract(html)) == n


# --- 8 ---


def brute_weights(texts, good, chunk):
    """Log weights by counting n-gram by n-gram."""
    grams = []
    for t in texts:
        gram, row = resampling.ngrams([t])
        grams.append(gram.tolist())
    raw, target = Counter(itertools.chain(*grams)), Counter(itertools.chain(*(g for g, x in zip(grams, good) if x)))
    n, m = sum(raw.values()), sum(target.values())
    prior = resampling.PRIOR * m
    ratio = {g: math.log((target[g] + prior * c / n) / (m + prior) / (c / n)) for g, c in raw.items()}
    return [sum(ratio[g] for g in own) * (1 if chunk is None else chunk / (len(own) + resampling.SHRINK)) for own in grams]


@pytest.mark.parametrize("chunk", [None, 50])
def test_weights_by_brute_force(spark, chunk):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, rng.randint(0, 50), 30 if i % 3 else 90))) for i in range(60)] + [(60, None), (61, ""), (62, "long, long " * 20_000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "doc_id long, quality int")
    models = resampling.fit(frame(spark, rows), labels)
    expected = brute_weights([t or "" for _, t in rows], [i % 3 > 0 and i < 40 for i, _ in rows], chunk)
    got = {r["doc_id"]: r["log_ratio"] for r in models.weighed(frame(spark, rows), chunk=chunk).collect()}
    assert all(math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-9) for (i, _), w in zip(rows, expected)) and got[60] == got[61] == 0
    assert math.isclose(models.good, 26 / 40)


def test_rows_are_drawn_as_often_as_their_weights_say(spark):
    """First draws are proportional to the weights, second ones to what is left: the frequencies of Gumbel top-k over many seeds."""
    weights = [2.0, 1.0, 0.0, 0.0, -1.0]
    rows = spark.createDataFrame([(i, w, s) for s in range(3000) for i, w in enumerate(weights)], "doc_id long, w double, seed int")
    keyed = rows.withColumn("key", resampling.gumbel_key(F.col("w"), "doc_id", F.col("seed")))
    ranked = keyed.selectExpr("doc_id", "row_number() OVER (PARTITION BY seed ORDER BY key DESC) AS n").where("n <= 2").groupBy("doc_id", "n").count().collect()
    got = {(r["doc_id"], r["n"]): r["count"] / 3000 for r in ranked}
    p = np.exp(weights) / np.exp(weights).sum()
    for i in range(5):
        second = sum(p[j] * p[i] / (1 - p[j]) for j in range(5) if j != i)
        assert abs(got[i, 1] - p[i]) < 0.03 and abs(got[i, 2] - second) < 0.03


def test_share_and_seed_decide_how_many_and_which(spark):
    rows = frame(spark, [(i, f"word{i % 7} of text {i % 3}") for i in range(400)]).withColumn("Draw_Key", F.lit("x")).withColumn("LOG_RATIO", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    picked = lambda **how: {r["doc_id"] for r in resampling.resample(rows, labels, **how).collect()}
    assert len(picked()) == 300 and len(picked(share=0.25)) == 100 and len(picked(share=0.0)) == 0 and len(picked(share=1.0)) == 400
    assert picked(share=0.25) != picked(share=0.25, seed=5) and picked(share=0.25) == picked(share=0.25)
    same = frame(spark, [(1, "a b c")] * 30 + [(2, "d e f")] * 30)
    assert resampling.resample(same, labels, share=0.5).count() in (30, 60)  # equal rows go or stay together


def test_no_weight_is_compared_with_a_cut(spark):
    """With weights that hardly differ the draw is near to uniform, whatever the labels."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = resampling.resample(docs, labels, share=0.5, chunk=0).select("doc_id").collect()
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert 0.2 < len(bad & {r["doc_id"] for r in kept}) / len(bad) < 0.8


# --- 1 ---


def field(n, value):
    return bytes([n << 3 | 2]) + varint(len(value)) + value


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def double_array(rules):
    """A compiled character map of one-byte keys, laid out by hand: the root's children from 256 on, each with its value behind it."""
    units, blob = [0] * 1024, b""
    units[0] = 256 << 10
    for i, (key, new) in enumerate(sorted(rules.items())):
        to = 256 ^ ord(key)
        leaf = 512 + i
        units[to] = (to ^ leaf) << 10 | 1 << 8 | ord(key)
        units[leaf] = len(blob) | 1 << 31
        blob += new.encode() + b"\0"
    body = np.array(units, "<u4").tobytes()
    return np.array([len(body)], "<u4").tobytes() + body + blob


def model(tmp_path, pieces, unigram=True, normaliser=b"\x18\x01\x20\x00"):
    from larkveil.llm import piece_fst

    rows = [field(1, field(1, t.encode()) + b"\x15" + np.float32(s).tobytes() + bytes([0x18, k])) for t, s, k in pieces]
    (tmp_path / "m").write_bytes(b"".join(rows) + field(2, b"\x18" + bytes([1 if unigram else 2])) + field(3, normaliser))
    return piece_fst.PieceTransducer(str(tmp_path / "m"))


def test_a_compiled_character_map_is_a_normaliser(tmp_path):
    from larkveil.llm import piece_fst

    rules = {"A": "a", "B": "bb", "\t": " ", "x": ""}
    assert piece_fst.charsmap(double_array(rules)) == rules
    normaliser = field(2, double_array(rules)) + b"\x18\x01\x20\x01"
    m = model(tmp_path, [("<unk>", 0, 2), ("▁", -2, 1), ("a", -1, 1), ("b", -1, 1), ("bb", -1.5, 1), ("▁a", -1, 1)], normaliser=normaliser)
    assert m.normalize("  A\t\tBx ") == " a bb" and m.encode("  A\t\tBx ") == [5, 1, 4] and m.encode("x") == [] and m.encode(" ") == []


def test_shortest_paths_by_brute_force(tmp_path):
    rng = random.Random(1)
    vocabulary = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(25)} | {"a", "b", "▁"})
    scores = {p: -rng.randint(1, 40) / 4 for p in vocabulary}
    m = model(tmp_path, [("<unk>", 0, 2), *((p, s, 1) for p, s in scores.items())])

    def paths(t):
        if not t:
            yield ()
        for n in range(1, len(t) + 1):
            if t[:n] in scores:
                yield from ((t[:n], *rest) for rest in paths(t[n:]))

    for _ in range(100):
        text = "".join(rng.choice("ab▁") for _ in range(rng.randint(1, 9)))
        best = min(-sum(scores[p] for p in path) for path in paths(text))
        own = m.shortest(text)
        assert "".join(own) == text and math.isclose(-sum(scores[p] for p in own), best)


def test_merges_by_brute_force(tmp_path):
    rng = random.Random(2)
    letters = "abc"
    vocabulary = list(letters)
    while len(vocabulary) < 30:
        p = rng.choice(vocabulary) + rng.choice(vocabulary)
        if p not in vocabulary:
            vocabulary.append(p)
    rank = {p: i for i, p in enumerate(vocabulary)}
    m = model(tmp_path, [("<unk>", 0, 2), *((p, -float(i), 1) for p, i in rank.items())], unigram=False)
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
        parts = list(text)
        while len(parts) > 1:
            pairs = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert m.shortest(text) == parts


def test_the_store_is_bounded(tmp_path, monkeypatch):
    from larkveil.llm import piece_fst

    monkeypatch.setattr(piece_fst, "KEEP", 100)
    m = model(tmp_path, [("<unk>", 0, 2), ("▁", -1, 1), *((c, -1, 1) for c in "abcdefgh")])
    rng = random.Random(3)
    for i in range(300):
        m.encode("".join(rng.choice("abcdefgh中文字") for _ in range(60)) if i % 2 else " ".join(words(rng, 20, 10_000)))
        assert len(m._store) + len(m._older) <= 100


# --- 7 ---


def test_ids_of_any_type(spark):
    from larkveil.llm import minhash

    rows = [("b", "one two three four five six"), ("a", "One two three\tfour five six"), ("z", "other words than those of the rest"), (None, "one two three four five six"), ("n", None), ("b", "one two three four five six")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r["doc_id"] or "", r["n_shingles"], r["component_id"] or "", r["kept"]) for r in out) == [
        ("", 2, "", True), ("a", 2, "a", True), ("b", 2, "a", False), ("b", 2, "a", False), ("n", 0, "n", True), ("z", 3, "z", True),
    ]
    left = minhash.near_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(r["doc_id"] or "" for r in left) == ["", "a", "n", "z"]


# --- written tables ---


def test_written_tables_are_deleted(spark):
    import os

    from larkveil.llm import common, minhash

    kept = common.cut(spark.range(3))
    minhash.near_dedup(frame(spark, [(1, "a b c"), (2, "a b c")])).collect()
    held = [p for p in common._WRITTEN if os.path.isdir(p.removeprefix("file://"))]
    assert held == common._WRITTEN and len(held) > 1
    common.release(spark, kept)
    assert common._WRITTEN == [kept._larkveil_path] and kept.count() == 3
    common.discard(kept, spark.range(1))
    assert not common._WRITTEN


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from larkveil.llm import common

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


# --- 6 ---


@pytest.mark.parametrize("kind", ["long", "string"])
def test_the_next_row_with_sampled_boundaries(spark, monkeypatch, kind):
    from larkveil.llm import merkle

    monkeypatch.setattr(merkle, "FINE_RANGES", 4)
    rng = random.Random(3)
    ids = [i if kind == "long" else f"k{i:06d}" for i in rng.sample(range(100_000), 400)] + [None]
    rows = [(i, f"t{n} " * rng.randint(1, 30)) for n, i in enumerate(ids)] + [(ids[0], "dup")] * 5
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    out = merkle.with_next(df, "doc_id", "text", "n", chars_per_range=20)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else ids[0], r[1]))
    expected = sorted(((k, t, n) for (k, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1])), key=repr)
    assert sorted(((r["doc_id"], r["text"], r["n"]) for r in out.collect()), key=repr) == expected


# --- the pipeline's stages on odd rows ---


@pytest.mark.parametrize("name", ["quality", "lines", "near_duplicates", "private_data", "packing"])
def test_stages_on_odd_rows(spark, name):
    import corpus_pipeline as C

    odd = "doc_id long, text string, lang string, source string, n_chars long, log_ratio string, draw_key string, n_lines string, n_replaced string, shard string, id string, digest string, host string, line string, anchor string"
    more = ["x"] * 10
    rows = [
        (1, None, "en", "s", 7, *more), (2, "", "en", None, 7, *more), (None, "one two three four five six", None, "s", None, *more), (3, "one two three four five six", "en", "s", 7, *more),
        (3, "one two three four five six", "en", "s", 7, *more), (4, "word " * 30_000, "en", "s", 7, *more), (5, "mail a@b.de\n\nmail a@b.de", "en", "t", 7, *more),
    ]
    docs = spark.createDataFrame(rows, odd)
    stage = dict(C.STAGES)[name]
    out = stage(spark, docs, SF)
    got = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, None} and sum(r["length"] for r in got if r["doc_id"] == 1) == 1
        assert stage(spark, docs.limit(0), SF).count() == 0
        return
    assert out.columns == docs.columns and all(r["shard"] == "x" and (r["n_chars"] is None if r["text"] is None else r["n_chars"] == len(r["text"])) for r in got)
    assert sorted(str(r["doc_id"]) for r in got if r["text"] in (None, "")) == ["1", "2"]
    if name == "near_duplicates":
        assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "3", "4", "5", "None"]
    elif name != "quality":
        assert len(got) == len(rows) and (name != "private_data" or "a@b" not in next(r["text"] for r in got if r["doc_id"] == 5))
    assert stage(spark, docs.limit(0), SF).count() == 0
