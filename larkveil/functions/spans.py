"""Native search for spans: positions in characters (code points), from DataFrame functions alone.

``regexp_instr`` counts UTF-16 units and gives one place only, so positions come from lengths: the
text between matches (``split``) and the matches (``regexp_extract_all``) alternate, and running
sums of their lengths are the starts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A finding, as all operators hold it.
FINDING = "struct<start:int,end:int,cls:string,stage:string,conf:double,entity:string,attrs:map<string,string>,parts:array<struct<start:int,end:int,cls:string,conf:double>>>"


def find_spans(text: Column, pattern: str, prefix_group: bool = False) -> Column:
    """array<struct<start,end,value>> of all matches of a Java pattern that never matches nothing.

    With ``prefix_group`` the pattern is ``(prefix)(value)`` and the value's span is given.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    first = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if prefix_group else None
    gaps = F.split(text, pattern, -1)
    cells = F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("value")))
    if prefix_group:
        cells = F.zip_with(cells, first, lambda c, p: F.struct(c["gap"].alias("gap"), c["size"].alias("size"), c["value"].alias("value"), F.length(p).alias("skip")))
    cells = F.filter(cells, lambda c: c["value"].isNotNull())
    empty = "cast(array() as array<struct<start:int,end:int,value:string>>)"
    state = F.struct(F.lit(0).alias("at"), F.expr(empty).alias("out"))

    def step(s: Column, c: Column) -> Column:
        begin = s["at"] + c["gap"]
        end = begin + c["size"]
        skip = c["skip"] if prefix_group else F.lit(0)
        span = F.struct((begin + skip).alias("start"), end.alias("end"), F.substr(c["value"], skip + 1).alias("value"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    return F.aggregate(cells, state, step, lambda s: s["out"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def original_span(starts: Column, ends: Column, start: Column, end: Column) -> Column:
    """The span in the text that a normalised text came from."""
    return F.struct(F.get(starts, start).alias("start"), F.get(ends, end - 1).alias("end"))


def one_spaced(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


def plain_umlauts(text: Column) -> Column:
    out = text
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ascii_key(text: Column) -> Column:
    """The key under which two mentions are one value, exact for ASCII texts (others: kernel/text.py)."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def pairs(text: Column, separator: str, offset: int = 0) -> Column:
    """array<struct<key,value,key_start,value_start>> of ``a=b`` items between separators; blank items are left out."""
    items = F.split(text, separator, -1)
    empty = "cast(array() as array<struct<key:string,value:string,key_start:int,value_start:int>>)"
    state = F.struct(F.lit(offset).alias("at"), F.expr(empty).alias("out"))

    def step(s: Column, x: Column) -> Column:
        bare = F.trim(x)
        lead = F.length(x) - F.length(F.ltrim(x))
        key = F.substring_index(bare, "=", 1)
        has = F.contains(bare, F.lit("="))
        begin = s["at"] + lead
        value_at = begin + F.length(key) + F.when(has, 1).otherwise(0)
        cell = F.struct(key.alias("key"), F.when(has, F.substr(bare, F.length(key) + 2)).otherwise("").alias("value"), begin.alias("key_start"), value_at.alias("value_start"))
        out = F.when(bare == "", s["out"]).otherwise(F.concat(s["out"], F.array(cell)))
        return F.struct((s["at"] + F.length(x) + F.lit(len(separator))).alias("at"), out.alias("out"))

    return F.aggregate(items, state, step, lambda s: s["out"])
