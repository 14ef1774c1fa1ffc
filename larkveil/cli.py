"""Command line: pseudonymize, restore, validate, classes, vault list, vault purge.

Exit codes: 0 done, 1 an error, 2 something was found or withheld. Texts are read with one row a
file; rewritten texts and the vault's tables are written as Parquet or JSON by Spark. Rows whose
text leaked are not written, nor are their mappings.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from larkveil.operators import detect as D
from larkveil.operators import pseudonymize as P
from larkveil.operators import tokens as K
from larkveil.plans.catalog import SettingsError
from larkveil.plans.shipping import ship
from larkveil.sources import files, vault


def _settings(spark, args):
    return files.read_settings(spark, *(args.config or []))


def pseudonymize(spark, args) -> int:
    """Texts to <out>/texts, the encrypted mapping to <out>/mappings and <out>/forms, sessions to <out>/sessions."""
    settings = _settings(spark, args)
    key = vault.load_or_create_key(args.key)
    done = P.pseudonymize(files.read_texts(spark, args.input), settings).withColumn("session_id", F.sha2(F.col("path"), 256))
    # results with fresh nonces are written once; all that follows reads what was written, and that holds sealed values only
    sealed = done.withColumn("n_tokens", F.size("mapping")).withColumn("mapping", _sealed(key)).drop("leaks")
    staged = f"{args.out}/staged"
    try:
        sealed.write.mode("errorifexists").parquet(staged)
        rows = spark.read.parquet(staged)
        clean = rows.where("status = 'ok'")
        clean.select("path", "session_id", "text").write.parquet(f"{args.out}/texts")
        entries = clean.select("session_id", F.explode("mapping").alias("m"))
        entries.select("session_id", "m.token", "m.data_class", "m.sealed", "m.attributes").write.parquet(f"{args.out}/mappings")
        forms = entries.select("session_id", F.col("m.token").alias("token"), F.posexplode("m.forms").alias("ordinal", "sealed"))
        forms.write.parquet(f"{args.out}/forms")
        sessions = clean.select(F.col("session_id").alias("id"), F.current_timestamp().alias("created_at"), F.lit("").alias("doc_sha256"), F.lit(settings.fingerprint()).alias("config_hash"), F.col("path").alias("external_key"))
        sessions.write.parquet(f"{args.out}/sessions")
        files.append_audit(files.audit_of(rows, "session_id", "n_tokens"), settings.audit_path)
        failed = rows.where("status <> 'ok'").count()
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if failed:
        print(f"{failed} texts were withheld: they would have leaked", file=sys.stderr)
    return 2 if failed else 0


def _sealed(key: bytes):
    """The mapping column with sealed values and forms."""
    place = lambda m, *more: F.concat_ws("|", F.col("session_id"), m["token"], *more)
    forms = lambda m: F.transform(m["forms"], lambda f, i: vault.seal(f, key, place(m, i.cast("string"))))
    return F.transform("mapping", lambda m: F.struct(m["token"].alias("token"), m["cls"].alias("data_class"), vault.seal(m["value"], key, place(m)).alias("sealed"), forms(m).alias("forms"), m["attrs"].alias("attributes")))


def restore(spark, args) -> int:
    """Answers (JSON lines: doc, session_id, text) with values, to <out>."""
    entries = vault.load(spark.read.parquet(f"{args.vault}/mappings"), spark.read.parquet(f"{args.vault}/forms"), vault.load_or_create_key(args.key))
    answers = spark.read.schema("doc string, session_id string, text string").json(args.input)
    K.restore(answers, entries, ["session_id"], mode=args.mode).write.json(args.out)
    return 0


def validate(spark, args) -> int:
    """Counts of what is found, by class; 2 if there is anything."""
    counts = D.counts_by_class(D.findings(D.detect(files.read_texts(spark, args.input), _settings(spark, args)), "path")).orderBy("cls")
    rows = counts.collect()  # at most one row a class
    print(files.report(counts).first()[0] if args.format == "json" else "\n".join(f"{r['cls']}: {r['n']}" for r in rows))
    return 2 if rows else 0


def classes(spark, args) -> int:
    for c in _settings(spark, args).classes.values():
        print(f"{c.name}\t{c.policy}\t{c.priority}")
    return 0


def vault_command(spark, args) -> int:
    sessions, mappings, forms = (spark.read.parquet(f"{args.vault}/{t}") for t in ("sessions", "mappings", "forms"))
    if args.action == "list":
        vault.list_sessions(sessions, mappings).show(args.limit, truncate=False)
        return 0
    gone = vault.older_than(sessions, args.days) if args.days is not None else sessions.where(F.col("id") == args.session).select("id")
    for name, table in zip(("sessions", "mappings", "forms"), vault.purge(sessions, mappings, forms, gone)):
        table.write.mode("errorifexists").parquet(f"{args.out}/{name}")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="larkveil", description=__doc__.split("\n")[0])
    sub = top.add_subparsers(required=True)

    def command(name, run, *options):
        p = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        p.set_defaults(run=run)
        p.add_argument("--config", action="append")
        for flags, kw in options:
            p.add_argument(flags, **kw)

    need = {"required": True}
    command("pseudonymize", pseudonymize, ("--input", need), ("--out", need), ("--key", need))
    command("restore", restore, ("--input", need), ("--vault", need), ("--key", need), ("--out", need), ("--mode", {"default": "strict", "choices": ("strict", "lenient")}))
    command("validate", validate, ("--input", need), ("--format", {"default": "text", "choices": ("text", "json")}))
    command("classes", classes)
    command("vault", vault_command, ("action", {"choices": ("list", "purge")}), ("--vault", need), ("--out", {}), ("--session", {}), ("--days", {"type": int}), ("--limit", {"type": int, "default": 1000}))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("larkveil").getOrCreate()
    ship(spark)
    try:
        return args.run(spark, args)
    except (SettingsError, vault.VaultError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
