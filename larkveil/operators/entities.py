"""Correlation as relations. A finding row: doc, seq, start, end, cls, key, conf, gender, token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkveil.kernel.link import HASH_CHARS, KEYED_BY_DIGITS, PERSON_LEAST, PERSONS, PROMOTED


def key_column(cls: Column, value: Column) -> Column:
    """The key of a finding; exact for ASCII values, as kernel/text.py's same() for others."""
    from larkveil.functions.spans import ascii_key, digits_of

    return F.when(cls.isin(*KEYED_BY_DIGITS), digits_of(value)).otherwise(ascii_key(value))


def groups(found: DataFrame) -> DataFrame:
    """doc, cls, key, first (start, end, seq), conf (best), first_name, last_name, n."""
    g = found.groupBy("doc", "cls", "key").agg(F.min(F.struct("start", "end", "seq")).alias("first"), F.max("conf").alias("conf"), F.count("*").alias("n"))
    names = F.split("key", " ")
    full, many = F.col("cls") == "PERSON_FULL_NAME", F.size(names) > 1
    first = F.when(full & many, F.element_at(names, 1)).when(F.col("cls") == "PERSON_FIRST_NAME", F.col("key"))
    last = F.when(full, F.element_at(names, -1)).when(F.col("cls") == "PERSON_LAST_NAME", F.col("key"))
    return g.withColumns({"first_name": first, "last_name": last})


def person_links(g: DataFrame) -> DataFrame:
    """doc, cls, key of a group and to_cls, to_key of the only person group that it joins."""
    people = g.where(F.col("cls").isin(*PERSONS) & (F.col("conf") >= PERSON_LEAST))
    p = people.select("doc", F.col("cls").alias("to_cls"), F.col("key").alias("to_key"), F.col("first_name").alias("pf"), F.col("last_name").alias("pl"))
    other = (F.col("cls") != F.col("to_cls")) | (F.col("key") != F.col("to_key"))
    by_last = g.where("cls = 'PERSON_LAST_NAME'").join(p.withColumn("on", F.col("pl")), "doc").where(F.col("key") == F.col("on"))
    by_first = g.where("cls = 'PERSON_FIRST_NAME'").join(p.withColumn("on", F.col("pf")), "doc").where(F.col("key") == F.col("on"))
    initials = F.concat(F.substring("pf", 1, 1), F.substring("pl", 1, 1))
    by_initials = g.where("cls = 'PERSON_INITIALS'").withColumn("letters", F.regexp_replace("key", r"[^\p{L}]", "")).join(p.withColumn("on", initials), "doc").where((F.col("letters") == F.col("on")) & (F.col("letters") != ""))
    columns = ["doc", "cls", "key", "to_cls", "to_key"]
    every = by_last.where(other).select(columns).unionAll(by_first.where(other).select(columns)).unionAll(by_initials.select(columns))
    n = F.count("*").over(Window.partitionBy("doc", "cls", "key"))
    return every.withColumn("n", n).where("n = 1").drop("n")


def generic_links(g: DataFrame) -> DataFrame:
    """Groups of generic ids and the only other group with their key."""
    o = g.select("doc", "key", F.col("cls").alias("to_cls"))
    met = g.where("cls = 'GENERIC_ID'").join(o, ["doc", "key"]).where("to_cls <> 'GENERIC_ID'")
    n = F.count("*").over(Window.partitionBy("doc", "key"))
    return met.withColumn("n", n).where("n = 1").select("doc", "cls", "key", "to_cls", F.col("key").alias("to_key"))


def correlate(found: DataFrame) -> DataFrame:
    """Finding rows with entity, conf (raised for merged names), gender and gender_conflict of the entity."""
    g = groups(found)
    persons = person_links(g)
    left = g.join(persons.select("doc", "cls", "key"), ["doc", "cls", "key"], "left_anti")
    links = persons.withColumn("raised", F.lit(True)).unionAll(generic_links(left).withColumn("raised", F.lit(False)))
    moved = found.join(links, ["doc", "cls", "key"], "left")
    group = F.struct(F.coalesce("to_cls", "cls").alias("cls"), F.coalesce("to_key", "key").alias("key"))
    raised = F.when(F.coalesce("raised", F.lit(False)), F.greatest("conf", F.lit(PROMOTED))).otherwise(F.col("conf"))
    moved = moved.withColumn("group", group).withColumn("conf", raised).drop("to_cls", "to_key", "raised")
    # entities are numbered by the first start of all their findings; of equal starts by the group's own first finding
    own = g.select("doc", F.struct(F.col("cls"), F.col("key")).alias("group"), F.col("first").alias("own_first"))
    starts = moved.groupBy("doc", "group").agg(F.min("start").alias("start"), F.collect_set("gender").alias("genders"), F.collect_set("token").alias("tokens"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("start", "own_first"))
    one = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))
    entities = starts.join(own, ["doc", "group"]).select(
        "doc", "group", F.concat(F.lit("e"), number.cast("string")).alias("entity"), one("genders").alias("entity_gender"), (F.size("genders") > 1).alias("gender_conflict"), one("tokens").alias("entity_token")
    )
    return moved.join(entities, ["doc", "group"]).select(
        "doc", "seq", "start", "end", "cls", "key", "conf", "entity", F.col("group.cls").alias("entity_cls"),
        F.substring(F.sha2("group.key", 256), 1, HASH_CHARS).alias("norm"), F.col("entity_gender").alias("gender"), "gender_conflict", F.col("entity_token").alias("token"),
    )


def link_mails(mails: DataFrame, people: DataFrame) -> DataFrame:
    """mails (doc, seq, local) and the only person (doc, entity, last) whose name is in the local part."""
    from larkveil.functions.spans import plain_umlauts

    met = mails.join(people, "doc").where(F.contains(plain_umlauts(F.lower("local")), plain_umlauts(F.lower("last"))))
    return met.groupBy("doc", "seq").agg(F.collect_set("entity").alias("e")).where(F.size("e") == 1).select("doc", "seq", F.element_at("e", 1).alias("linked_entity"))
