"""Spans as relations: union, containment, what lies outside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union_spans(spans: DataFrame, *keys: str) -> DataFrame:
    """Overlapping (start, end) of a key as one; spans that touch stay apart (gaps and islands)."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.distinct().withColumn("_new", F.when(F.col("start") < before, 0).otherwise(1))
    numbered = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def drop_contained(spans: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Spans that lie in no span of a smaller seq of the same key that is itself kept.

    A span inside a dropped one lies inside the one that dropped it, so all earlier spans may be asked.
    """
    a, b = spans.alias("a"), spans.alias("b")
    inside = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{seq}") < F.col(f"a.{seq}")) & (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end"))
    return a.join(b, inside, "left_anti")


def outside(found: DataFrame, covers: DataFrame, key: str) -> DataFrame:
    """Findings that lie in no covering span of their key."""
    a, b = found.alias("a"), covers.alias("b")
    inside = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end"))
    return a.join(b, inside, "left_anti")
