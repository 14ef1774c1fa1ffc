"""The corpus pipeline: quality filter, line dedup, near-dedup, surrogates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``
with their decisions applied: rejected rows are gone, texts are changed in place and ``n_chars``
counts what is left.

Defined results, in every stage: null texts stay null (n_chars null) and rows with them stay, but that
packing takes them as empty; empty texts stay; rows with null ids stay; repeated rows go or stay together in
quality, are pages each in lines, are one document in near_duplicates (which keeps one id, all its rows);
an empty table gives an empty table; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkveil.llm import line_dedup, minhash, packing, resampling, surrogates
from larkveil.llm.common import cut, release, ship, table, written
from larkveil.llm.queries import special_tokens, split_pattern, tokenizer


#: Near copies have this share of their word shingles in common, in percent; op7's own limit is higher.
NEAR_COPIES = 80
#: Boilerplate lines stand on more than this share of a host's contents, and on so many of them at least. On sf0.1 (hosts of
#: about 500) the ten lines that all hosts repeat have shares of 0.008 to 0.13, all but 265 of 76,759 lines one content a host.
LINE_RATIO, LINE_PAGES = 0.005, 5


def _like(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars counted anew."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _like(resampling.resample(docs, table(spark, sf_dir, "labels")), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(line_dedup.line_dedup(docs, max_ratio=LINE_RATIO, min_pages=LINE_PAGES, copies_once=True), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _like(minhash.near_dedup(docs, percent=NEAR_COPIES), docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _like(surrogates.surrogate(docs), docs)


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.tiktoken"), split_pattern(), special=special_tokens("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("private_data", private_data), ("packing", packing_)]

#: Hash functions, minima and byte-pair merges have no equal in DuckDB; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = table(spark, sf_dir, "documents"), written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            release(spark, docs, since=begun)  # a stage's own tables and its input aren't read any more
    return docs
