"""Site-relative line frequency: lines that stand on too many pages of one host are dropped.

For every host the number of pages that hold a line is divided by the host's number of pages. A
line whose share exceeds ``max_ratio`` and that stands on ``min_pages`` pages at least is
boilerplate of that host, and every occurrence of it there goes. ``min_pages`` is 2: a line of one
page isn't repeated, however few pages its host has.

The host is a column (``documents`` names it ``source``); ``url_host`` gives it from an address.

With ``copies_once`` pages of one host with equal texts count as one page, in both numbers. The
corpus pipeline, whose ratio is far lower, uses it: there a page that was crawled a thousand times
would make its own lines boilerplate, and the step after this one would find nothing left of it.

Only DataFrame functions are used. The text itself is never shuffled: lines travel as 64-bit
hashes, counted in each task before the shuffle by (host, line), so a hot host's rows aren't
gathered. What comes back to the pages is one array of hashes for each host. That array is short: a
page has ``m`` lines on average, so at most ``m / max_ratio`` lines can exceed the ratio. The table
of hosts is broadcast if it was counted to be small, else it is joined by a shuffle in which the
pages of a hot host are salted.

Defined results: null text stays null and has no lines, but its page counts in the host's total;
empty text stays empty; blank lines are kept and never counted; lines are equal if they are but for
spaces around them; a line that a page repeats counts once; a null host is a host of its own;
repeated rows are pages each (but for ``copies_once``); columns besides host and text pass through
untouched, n_lines and n_dropped are replaced; an empty table gives an empty table. ``n_lines``
counts the lines of a text (0 for null), ``n_dropped`` those that went.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkveil.llm.common import cut, fresh_name

#: Hashes of boilerplate lines that may be broadcast: 8 bytes each, so 4 MB at most.
BROADCAST_LINES = 500_000
#: Share of a host's pages that boilerplate exceeds, and pages that it stands on at least.
MAX_RATIO, MIN_PAGES = 0.1, 2


def _lines(text):
    return F.split(text, "\n")


def _key(line):
    return F.xxhash64(F.trim(line))


def url_host(url: Column) -> Column:
    """The host of an address in lower case, null if it has none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, line, pages, share) of each line that exceeds the ratio; line is a hash."""
    lines = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.length(F.trim(x)) > 0), _key))
    page = pages.select(F.col(host).alias("host"), F.xxhash64(text).alias("content"), F.col(text).isNull().alias("none"), lines.alias("lines"))
    if copies_once:
        total = page.where("NOT none").select("host", "content").distinct()
        seen = page.select("host", "content", F.explode("lines").alias("line")).distinct()
    else:
        total, seen = page, page.select("host", F.explode("lines").alias("line"))
    often = seen.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    total = total.groupBy("host").agg(F.count("*").alias("total"))
    joined = often.alias("a").join(total.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")))
    share = F.col("pages") / F.col("total")
    return joined.select("a.host", "line", "pages", share.alias("share")).where(share > max_ratio)


def line_dedup(
    pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False,
    broadcast_lines: int = BROADCAST_LINES, salts: int = 32,
) -> DataFrame:
    """``pages`` with the cleaned text in place, and n_lines and n_dropped (see the module's docstring)."""
    bad = cut(boilerplate(pages, host, text, max_ratio, min_pages, copies_once).groupBy("host").agg(F.collect_set("line").alias("lines")))
    few = (bad.agg(F.sum(F.size("lines"))).first()[0] or 0) <= broadcast_lines
    key, lines, salt = (fresh_name(pages.columns, x) for x in ("host", "lines", "salt"))
    bad = bad.select(F.col("host").alias(key), F.col("lines").alias(lines))
    if few:
        joined = pages.join(F.broadcast(bad), F.col(host).eqNullSafe(F.col(key)), "left")
    else:
        spread = bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        # a page's own content picks its salt, so a hot host is dealt to many tasks
        salted = pages.withColumn(salt + "p", F.pmod(F.xxhash64(text), F.lit(salts)).cast("int"))
        joined = salted.join(spread, F.col(host).eqNullSafe(F.col(key)) & (F.col(salt + "p") == F.col(salt)), "left").drop(salt, salt + "p")
    kept = F.filter(_lines(F.col(text)), lambda x: ~F.coalesce(F.array_contains(F.col(lines), _key(x)), F.lit(False)) | (F.length(F.trim(x)) == 0))
    clean = F.when(F.col(lines).isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    total = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(_lines(F.col(text))))
    left = F.when(F.col(text).isNull(), F.lit(0)).when(F.col(lines).isNull(), total).otherwise(F.size(kept))
    out = {text: clean, "n_lines": total.cast("long"), "n_dropped": (total - left).cast("long")}
    return joined.withColumns(out).drop(key, lines)


ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, d.page, CAST(u.i AS BIGINT) AS i, string_split(text, chr(10))[u.i] AS line
  FROM (SELECT *, row_number() OVER () AS page FROM documents WHERE text IS NOT NULL) d,
       LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i) u),
total AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
often AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT page) AS pages FROM l WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
bad AS (SELECT o.source, o.line FROM often o JOIN total t ON o.source IS NOT DISTINCT FROM t.source
        WHERE pages >= {MIN_PAGES} AND pages / total > {MAX_RATIO}),
marked AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.line)
SELECT doc_id, source, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
FROM marked GROUP BY page, doc_id, source
UNION ALL SELECT doc_id, source, NULL, 0, 0 FROM documents WHERE text IS NULL
"""
