"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

A text is cut at line feeds into paragraphs and each paragraph into leaves: runs of up to four
words that end early at the end of a sentence. The leaves of a paragraph joined give it back, so
nothing of the text is left out. A paragraph's hash covers its whole text; paragraphs are grouped
into sections where a paragraph's own hash says so (one in eight on average, so a change moves no
boundary but those it touches), a section's hash covers its paragraphs' hashes, and the root the
sections'.

A fingerprint is one string of four parts between ``|``:
``root | section hashes | paragraph hashes, each with its number of leaves after a colon | leaf hashes``.
Roots test equality. Differing section and paragraph hashes tell where two texts differ
(``changed_paragraphs``). The share of common leaves is the likeness (``likeness``).

Only DataFrame functions are used. The fingerprint of a row needs that row alone.

Defined results: null text counts as empty; the empty text has one empty paragraph and no leaf;
equal texts have equal fingerprints; two texts without leaves are alike to 1 if their roots are
equal, else 0; repeated rows each get their own result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkveil.llm.common import fresh_name

#: A run of up to four words; the end of a sentence ends it; or spaces that nothing precedes.
LEAF = r"(?:[^ .!?]+ +){0,3}(?:[^ .!?]*[.!?]+|[^ .!?]+) *| +"
#: A paragraph whose hash begins so is the last of its section.
LAST_OF_SECTION = "[01]"


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as column ``out``."""
    pars, hashes = (fresh_name(df.columns, x) for x in ("paragraphs", "hashes"))
    split = F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
        lambda p: F.struct(
            F.substring(F.sha2(p, 256), 1, 16).alias("hash"),
            F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda w: F.substring(F.md5(w), 1, 8)).alias("leaves"),
        ),
    )
    df = df.withColumn(pars, split).withColumn(hashes, F.col(pars)["hash"])
    chained = F.array_join(F.transform(hashes, lambda h: F.concat(h, F.when(F.substring(h, 1, 1).isin("0", "1"), F.lit("\n")).otherwise(F.lit(" ")))), "")
    sections = F.transform(F.split(chained, "\n"), lambda s: F.substring(F.sha2(s, 256), 1, 16))
    listed = F.array_join(sections, " ")
    fp = F.concat_ws(
        "|",
        F.substring(F.sha2(listed, 256), 1, 32),
        listed,
        F.array_join(F.transform(pars, lambda p: F.concat(p["hash"], F.lit(":"), F.size(p["leaves"]).cast("string"))), " "),
        F.array_join(F.flatten(F.col(pars)["leaves"]), " "),
    )
    return df.withColumn(out, fp).drop(pars, hashes)


def _part(fp: Column, n: int) -> Column:
    return F.split_part(fp, F.lit("|"), F.lit(n))


def root(fp: Column) -> Column:
    return _part(fp, 1)


def likeness(a: Column, b: Column) -> Column:
    """Twice the common leaves by the leaves of both, each leaf counted once in a text."""
    x, y = (F.array_distinct(F.filter(F.split(_part(fp, 4), " "), lambda w: w != "")) for fp in (a, b))
    both = F.size(x) + F.size(y)
    return (
        F.when(root(a) == root(b), F.lit(1.0))
        .when(both == 0, F.lit(0.0))
        .otherwise(2.0 * F.size(F.array_intersect(x, y)) / both)
    )


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Positions, from 0, of the paragraphs of ``a`` that ``b`` doesn't have; null if the roots are equal."""
    hashes = lambda fp: F.transform(F.split(_part(fp, 3), " "), lambda p: F.substring(p, 1, 16))
    marked = F.transform(hashes(a), lambda h, i: F.when(F.array_contains(hashes(b), h), F.lit(-1)).otherwise(i))
    return F.when(root(a) != root(b), F.filter(marked, lambda i: i >= 0))


#: Up to so many ranges they have ``chars_per_range`` characters; beyond, ``WIDE`` times as many, whatever their number.
FINE_RANGES, WIDE = 4096, 16
#: Sampled keys for each range, where boundaries come from a sample.
SAMPLED = 16


def _bounds(docs: DataFrame, key: str, n: int, rows: int) -> list:
    """About n - 1 distinct keys that divide the rows evenly."""
    if n <= FINE_RANGES:
        found = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    else:
        part = max(1, rows // (SAMPLED * n))
        some = docs.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(part)) == 0)).select(key).toArrow().column(0).to_pylist()
        some.sort()
        found = [some[len(some) * i // n] for i in range(1, n)] if some else []
    return sorted({b for b in found if b is not None})


def with_next(docs: DataFrame, key: str, text: str, out: str, chars_per_range: int = 4_000_000) -> DataFrame:
    """``docs`` (key, text) with the text of the row that follows by key, after the last row the first, as ``out``.

    Rows are ordered by key (nulls first), then text. They are dealt to ranges of keys of about
    equal numbers, whose boundaries come from percentiles or, for many ranges, from a sample of
    keys; a window runs inside each range. The last row of a range gets its follower from a copy of
    the next range's first row that is added to the range before the only shuffle. So no task sees
    more than one range, and one hot key is the only thing that can make a range large. The number
    of ranges grows with the input: the driver has some keys for each 64 million characters.
    """
    size = docs.agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"), F.max(key).alias("top")).first()
    if not size["n"]:
        return docs.select(key, text).withColumn(out, F.lit(None).cast("string"))
    chars = size["chars"] or 0
    n = max(1, min(size["n"], max(min(FINE_RANGES, math.ceil(chars / chars_per_range)), math.ceil(chars / (WIDE * chars_per_range)))))
    bounds = _bounds(docs, key, n, size["n"]) if n > 1 and size["top"] is not None else []
    # two levels of boundaries, so that a row is compared with about 2 * sqrt(n) of them
    step = max(1, math.isqrt(n))
    if bounds:
        kind = docs.schema[key].dataType
        whole = isinstance(kind, T.IntegralType)
        lit = lambda xs: F.lit(np.array(xs, "int64")) if whole else F.array(*[F.lit(x).cast(kind) for x in xs])
        above = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col(key)))
        which = above(lit(bounds[::step]))
        inner = F.slice(lit(bounds), F.greatest(which - 1, F.lit(0)) * step + 1, F.lit(step))
        number = F.when(F.col(key).isNull() | (which == 0), F.lit(0)).otherwise((which - 1) * step + above(inner))
    else:
        number = F.lit(0)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), number.cast("int").alias("r"))
    found = rows.where("k IS NOT NULL").groupBy("r").agg(F.min("k").alias("k")).toArrow().to_pydict()  # as many rows as ranges
    firsts = sorted(zip(found["r"], found["k"]))
    has_null = bool(rows.where("k IS NULL").limit(1).count())
    ranges = [r for r, _ in firsts]
    first_of = dict(firsts)
    if has_null and 0 not in ranges:
        ranges.insert(0, 0)
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    wanted = [(ranges[i - 1], None if (has_null and r == 0) else first_of[r]) for i, r in enumerate(ranges)]
    heads = spark.createDataFrame(wanted, f"to int, k {kind}")
    copies = rows.join(F.broadcast(heads), rows["k"].eqNullSafe(heads["k"])).select(rows["k"], "t", F.col("to").alias("r"), F.lit(True).alias("copy"))
    every = rows.withColumn("copy", F.lit(False)).unionByName(copies)
    follower = F.expr("lead(struct(t)) OVER (PARTITION BY r ORDER BY copy, k NULLS FIRST, t NULLS FIRST)")
    return every.withColumn("n", follower).where("NOT copy").select(F.col("k").alias(key), F.col("t").alias(text), F.col("n")["t"].alias(out))


def edited(text: Column, follower: Column) -> Column:
    """The last floor(n / 2) characters replaced by the follower's first as many, or all it has."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(follower, F.lit(1), half))


def merkle_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how like each other they and the next text's are."""
    rows = with_next(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)), key, text, "follower")
    rows = rows.withColumn("edit", edited(F.col(text), F.col("follower")))
    rows = with_fingerprint(rows, text, "fingerprint")
    rows = with_fingerprint(rows, "edit", "edited_fingerprint")
    rows = with_fingerprint(rows, "follower", "next_fingerprint")
    a, e, n = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return rows.select(
        key,
        F.length(text).cast("long").alias("n_chars"),
        F.sha2("edit", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(a, e).alias("near_edited"),
        likeness(a, n).alias("near_next"),
    )


def _oracle_fp(col: str) -> str:
    """DuckDB SQL for the fingerprint of a text column."""
    pars = f"string_split({col}, chr(10))"
    hashes = f"list_transform({pars}, lambda p: substr(sha256(p), 1, 16))"
    chained = f"array_to_string(list_transform({hashes}, lambda h: h || CASE WHEN h[1] IN ('0', '1') THEN chr(10) ELSE ' ' END), '')"
    listed = f"array_to_string(list_transform(string_split({chained}, chr(10)), lambda s: substr(sha256(s), 1, 16)), ' ')"
    leaves = f"regexp_extract_all(p, '{LEAF}')"
    return (
        f"substr(sha256({listed}), 1, 32) || '|' || {listed} || '|' || "
        f"array_to_string(list_transform({pars}, lambda p: substr(sha256(p), 1, 16) || ':' || len({leaves})), ' ') || '|' || "
        f"array_to_string(flatten(list_transform({pars}, lambda p: list_transform({leaves}, lambda w: substr(md5(w), 1, 8)))), ' ')"
    )


def _oracle_near(a: str, b: str) -> str:
    x, y = (f"list_distinct(list_filter(string_split(split_part({c}, '|', 4), ' '), lambda w: w <> ''))" for c in (a, b))
    return f"CASE WHEN split_part({a}, '|', 1) = split_part({b}, '|', 1) THEN 1.0 WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS follower FROM d
      WINDOW w AS (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(follower, 1, length(text) // 2) AS edit FROM o),
f AS (SELECT doc_id, text, edit, {_oracle_fp("text")} AS fp, {_oracle_fp("edit")} AS efp, {_oracle_fp("follower")} AS nfp FROM e)
SELECT doc_id, length(text) AS n_chars, sha256(edit) AS edited_sha256, fp AS fingerprint, efp AS edited_fingerprint,
  CAST({_oracle_near("fp", "efp")} AS DOUBLE) AS near_edited, CAST({_oracle_near("fp", "nfp")} AS DOUBLE) AS near_next
FROM f
"""
