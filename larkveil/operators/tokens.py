"""Tokens as relations: numbering, rewriting, restoring, looking for leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkveil.functions.spans import digits_of, one_spaced

TOKEN = r"<[A-Z][A-Z_]*?_\d{3,}>"
TOKEN_OR_MARK = r"<[A-Z][A-Z_]*?_(?:\d{3,}|REDACTED)>"
#: The lenient form without conditionals: one alternative for each quote and bracket.
LENIENT = (
    r"(?<![\w>])(?:" + "|".join(f"{q}<[A-Za-z][A-Za-z_]*?_\\d{{3,}}>{q}(?!\\w)|{q}[A-Za-z][A-Za-z_]*?_\\d{{3,}}{q}(?!\\w)" for q in "`\"'") + r"|<[A-Za-z][A-Za-z_]*?_\d{3,}>(?!\w))"
)


def reserved_numbers(text: Column) -> Column:
    """array<struct<label,number>> of token literals that a text already has; labels without a person's gender."""
    labels = F.regexp_extract_all(text, F.lit(r"<([A-Z][A-Z_]*?)_(\d{3,})>"), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(r"<([A-Z][A-Z_]*?)_(\d{3,})>"), F.lit(2))
    return F.array_distinct(F.zip_with(labels, numbers, lambda x, n: F.struct(F.regexp_replace(x, "^PERSON_(?:FEMALE|MALE)$", "PERSON").alias("label"), n.cast("int").alias("number"))))


def assign_tokens(found: DataFrame, reserved: DataFrame | None = None, counters: DataFrame | None = None) -> DataFrame:
    """One token for each entity of a doc.

    ``found``: doc, start, entity, label, gender of what is to be tokenized. ``reserved``: doc, label,
    numbers (array). ``counters``: doc, label, last. Numbers go up in the order of first places,
    from the last counter, over the reserved ones.
    """
    first = found.groupBy("doc", "label", "entity").agg(F.min("start").alias("start"), F.max("gender").alias("gender"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("doc", "label").orderBy("start", "entity")))
    no_numbers, zero = F.expr("cast(array() as array<int>)"), F.lit(0)
    ranked = ranked.join(reserved.withColumnRenamed("numbers", "_taken"), ["doc", "label"], "left") if reserved is not None else ranked.withColumn("_taken", no_numbers)
    ranked = ranked.join(counters.withColumnRenamed("last", "_last"), ["doc", "label"], "left") if counters is not None else ranked.withColumn("_last", zero)
    taken, last = F.coalesce("_taken", no_numbers), F.coalesce("_last", zero)
    free = F.array_except(F.sequence(last + 1, last + F.col("k") + F.size(taken)), taken)
    number = F.element_at(free, F.col("k"))
    gender = F.when((F.col("label") == "PERSON") & F.col("gender").isin("female", "male"), F.concat(F.lit("_"), F.upper("gender"))).otherwise("")
    return ranked.select("doc", "label", "entity", "start", number.alias("number"), F.concat(F.lit("<"), F.col("label"), gender, F.lit("_"), F.format_string("%03d", number), F.lit(">")).alias("token"))


def rewrite(docs: DataFrame, replacements: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """Texts with replacements (key, start, end, new) put in; spans don't overlap."""
    lists = replacements.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("_r"))
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    step = lambda s, r: F.struct(r["end"].alias("at"), F.concat(s["out"], F.array(F.substr(F.col(text), s["at"] + 1, r["start"] - s["at"]), r["new"])).alias("out"))
    done = F.aggregate("_r", state, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(F.col(text), s["at"] + 1)))
    joined = docs.join(lists, key, "left")
    return joined.withColumn(text, F.when(F.col("_r").isNull(), F.col(text)).otherwise(done)).drop("_r")


def restore(answers: DataFrame, mapping: DataFrame, keys: list[str], doc: str = "doc", text: str = "text", mode: str = "strict") -> DataFrame:
    """Texts with values: the k-th mention of a token gets its k-th form, later ones the value.

    ``answers``: doc and the keys that name a session; ``mapping``: keys, token, value, forms (array).
    Adds restored (count) and unknown (tokens, distinct, in order). Strict raises at an unknown token.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"unknown restore mode: {mode}")
    pattern = TOKEN if mode == "strict" else LENIENT
    cells = answers.select(doc, *keys, F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    rows = cells.select(doc, *keys, F.posexplode(F.arrays_zip("g", "m")).alias("pos", "c")).select(doc, *keys, "pos", F.col("c.g").alias("gap"), F.col("c.m").alias("raw"))
    bare = F.concat(F.lit("<"), F.upper(F.regexp_extract("raw", r"[A-Za-z][A-Za-z_]*_\d{3,}", 0)), F.lit(">"))
    rows = rows.withColumn("token", F.when(F.col("raw").isNotNull(), bare))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(doc, "token").orderBy("pos")))
    known = rows.join(mapping, [*keys, "token"], "left")
    value = F.coalesce(F.try_element_at("forms", F.col("k")), "value")
    if mode == "strict":
        value = F.when(F.col("raw").isNull(), "").when(value.isNull(), F.raise_error(F.concat(F.lit("unknown token: "), F.col("token")))).otherwise(value)
    else:
        value = F.coalesce(value, "raw", F.lit(""))
    missing = F.col("raw").isNotNull() & F.col("value").isNull()
    cell = F.struct("pos", F.concat("gap", value).alias("piece"), F.when(missing, F.col("token")).alias("missing"), (F.col("raw").isNotNull() & F.col("value").isNotNull()).cast("int").alias("hit"))
    out = known.select(doc, cell.alias("c")).groupBy(doc).agg(F.array_sort(F.collect_list("c")).alias("c"))
    return out.select(
        doc,
        F.array_join("c.piece", "").alias(text),
        F.aggregate("c", F.lit(0), lambda s, c: s + c["hit"]).alias("restored"),
        F.array_distinct(F.filter("c.missing", lambda x: x.isNotNull())).alias("unknown"),
    )


def value_leaks(texts: DataFrame, entries: DataFrame, key: str = "session") -> DataFrame:
    """(doc, cls, value) of session values that a text still holds; the test alone, places: kernel/pipeline.py.

    Values of under four characters count as whole words; others without regard to case and to the
    length of white space; values with six digits and more also with other groups of digits.
    """
    value, text = F.col("value"), F.col("text")
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    digits = digits_of(value)
    word_start = F.when(value.rlike(r"^[\p{L}\p{N}]"), r"(?<![\p{L}\p{N}])").otherwise("")
    word_end = F.when(value.rlike(r"[\p{L}\p{N}]$"), r"s?(?![\p{L}\p{N}])").otherwise("")
    short = F.regexp(text, F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)")))
    spaced = F.lower(F.trim(one_spaced(value)))
    as_word = F.regexp(one_spaced(text), F.concat(F.lit("(?iU)"), word_start, F.lit(r"\Q"), F.trim(one_spaced(value)), F.lit(r"\E"), word_end))
    anywhere = F.contains(F.lower(one_spaced(text)), spaced)
    grouped = (F.length(digits) >= 6) & F.contains(digits_of(text), digits)
    hit = F.when(value == "", False).when(F.length(value) < 4, short).when(F.length(digits) == 0, as_word).otherwise(anywhere | grouped)
    return texts.join(entries, key).where(hit).select("doc", "cls", "value").distinct()


def unknown_tokens(texts: DataFrame, entries: DataFrame, key: str = "session") -> DataFrame:
    """(doc, token) of numbered tokens that the session doesn't have."""
    found = texts.select("doc", key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("token"))
    return found.join(entries.select(key, "token"), [key, "token"], "left_anti").select("doc", "token")
