"""Texts, term lists and settings from files; reports and audit rows to files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkveil.plans.catalog import Settings, SettingsError, layered

#: Columns of an audit row: never a value, only names and numbers.
AUDIT = "event string, session string, path string, counts map<string,bigint>, token_count bigint, new_tokens bigint, reused_tokens bigint, fields bigint, leakage string, streaming boolean, restored_count bigint, unknown_token_count bigint, mode string, sessions bigint, exc_type string, stage string, duration_ms bigint"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path and whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """One row a term: trimmed, without blank lines and # lines."""
    term = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return spark.read.text(path).select(term.alias("term")).where((F.col("term") != "") & ~F.col("term").startswith("#"))


def terms(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A term list for the settings; such lists are small configuration, not data."""
    return tuple(dict.fromkeys(r["term"] for r in read_terms(spark, path).collect()))


def read_settings(spark: SparkSession, *paths: str, env: dict[str, str] | None = None) -> Settings:
    """Settings from JSON or YAML files, later ones over earlier ones; ``files`` of a dictionary are term lists."""
    layers = []
    for path in paths:
        raw = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        if path.endswith((".yaml", ".yml")):
            import yaml

            layer = yaml.safe_load(raw) or {}
        else:
            layer = json.loads(raw)
        if not isinstance(layer, dict):
            raise SettingsError(f"{path} isn't a mapping")
        base = path.rsplit("/", 1)[0] if "/" in path else "."
        for key in ("dictionaries", "word_lists"):
            for name, given in (layer.get(key) or {}).items():
                if isinstance(given, dict):
                    more = [t for f in given.get("files", ()) for t in terms(spark, f if "/" in f[:1] or ":" in f else f"{base}/{f}")]
                    layer[key][name] = [*given.get("terms", ()), *more]
        layers.append(layer)
    return layered(*layers, env=env)


def audit_rows(spark: SparkSession, *rows: dict) -> DataFrame:
    """Audit rows from dicts with some of AUDIT's columns; others are null. event must be one of six kinds."""
    names = [c.split()[0] for c in AUDIT.split(", ")]
    for r in rows:
        if r.get("event") not in ("pseudonymize", "session_pseudonymize", "proxy_request", "restore", "vault_purge", "error"):
            raise ValueError(f"unknown audit event: {r.get('event')}")
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], AUDIT).withColumn("ts", F.current_timestamp())


def audit_of(pseudonymized: DataFrame, key: str = "doc_id", tokens: str | None = None) -> DataFrame:
    """An audit row for each text: status and numbers of tokens (from column ``tokens``, else from the mapping), no value."""
    return pseudonymized.select(
        F.lit("pseudonymize").alias("event"),
        F.col(key).cast("string").alias("session"),
        F.when(F.col("status") == "ok", F.col(tokens) if tokens else F.size("mapping")).otherwise(0).cast("long").alias("token_count"),
        F.col("status").alias("leakage"),
    )


def append_audit(rows: DataFrame, path: str | None) -> None:
    """JSON lines, appended; nothing is written where the path is null."""
    if path is not None:
        rows.write.mode("append").json(path)


def report(counts: DataFrame) -> DataFrame:
    """counts (cls, n) as one JSON row with sorted keys."""
    entries = F.array_sort(F.collect_list(F.struct("cls", "n")))
    return counts.agg(F.to_json(F.map_from_entries(entries)).alias("report"))
