"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkveil.llm import ball_tree, chat_format, line_dedup, merkle, minhash, packing, piece_fst, resampling, surrogates, tag_paths
from larkveil.llm.common import ship, table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; it is installed beside the library on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back (``▁`` counts as a space)."""
    model = tokenizer("piece_bpe_32k.model")
    both = piece_fst.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded="decoded")
    same = F.col("decoded").eqNullSafe(F.replace(F.col("text"), F.lit(piece_fst.SPACE), F.lit(" ")))
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("same"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", "n_lines", "n_dropped")


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tag_paths.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_report(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are drawn; those that the filter rejects aren't returned."""
    drawn = resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), with_text=False)
    return drawn.select("doc_id", "log_ratio", "draw_key")


def split_pattern() -> str:
    """How the byte-level vocabulary splits texts before its merges."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def special_tokens(name: str) -> dict[str, int]:
    """The strings that a tokenizer's file has as one id."""
    with open(tokenizer(name), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), split_pattern(), special=special_tokens("byte_bpe_50k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql(
        "SELECT -1L AS conv_id, t AS turn, r AS role, c AS text FROM VALUES (0L, 'user', :c), (1L, 'assistant', :c) AS v(t, r, c)",
        args={"c": chat_format.CONTROL},
    )
    parts = rows.unionByName(own).withColumn("parts", chat_format.text_part(F.col("text")))
    return chat_format.digests(chat_format.format_chat(parts))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_line_dedup, op3_surrogates, op4_ball_tree, op5_tag_paths, op6_merkle_fingerprints, op7_minhash, op8_resampling, op9_packing, op10_chat_format)}
ORACLES = {"op4_ball_tree": ball_tree.ORACLE, "op2_line_dedup": line_dedup.ORACLE, "op6_merkle_fingerprints": merkle.ORACLE, "op10_chat_format": chat_format.ORACLE}


def queries() -> dict:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
