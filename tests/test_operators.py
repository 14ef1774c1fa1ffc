"""Operators over DataFrames that the queries' literal relations don't reach."""

import pytest
from pyspark.sql import functions as F

from larkveil.functions.spans import find_spans
from larkveil.functions.validators import VALIDATORS
from larkveil.kernel import checks
from larkveil.operators import detect as D
from larkveil.operators import pseudonymize as P
from larkveil.operators import tokens as K
from larkveil.plans.relations import CHUNKS, PROBES, STREAM_MAPPING
from larkveil.sources import files, vault


@pytest.mark.parametrize("name", sorted(PROBES))
def test_columns_and_kernel_agree(spark, name):
    rows = spark.sql(PROBES[name]).select("value", F.coalesce(VALIDATORS[name](F.col("value")), F.lit(False)).alias("v")).collect()
    assert {r["value"]: r["v"] for r in rows} == {r["value"]: bool(checks.VALIDATORS[name](r["value"])) for r in rows}


def test_spans_count_characters(spark):
    df = spark.createDataFrame([("a😀b12 c345",), ("",), (None,)], "t string")
    out = [r[0] for r in df.select(find_spans(F.col("t"), r"\d+")).collect()]
    assert [(s["start"], s["end"], s["value"]) for s in out[0]] == [(3, 5, "12"), (7, 10, "345")]
    assert out[1] == [] and out[2] is None
    (g,) = df.limit(1).select(find_spans(F.col("t"), r"([a-z] ?)(\d+)", True)).first()
    assert [(s["start"], s["end"], s["value"]) for s in g] == [(3, 5, "12"), (7, 10, "345")]


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "mail a@b.de"), (3, "mail a@b.de")], "doc_id long, text string")
    assert D.findings(D.detect(df)).count() == 2
    out = {(r["doc_id"], r["text"], r["status"]) for r in P.pseudonymize(df).collect()}
    assert out == {(1, None, "ok"), (2, "", "ok"), (3, "mail <EMAIL_001>", "ok")}
    assert D.detect(df.limit(0)).count() == 0


def test_leaking_texts_are_withheld(spark):
    df = spark.createDataFrame([(1, "a@b.de and <EMAIL_007>")], "doc_id long, text string")
    r = P.pseudonymize(df).first()
    assert r["status"] == "failed" and r["text"] is None and r["mapping"] == [] and {x["kind"] for x in r["leaks"]} == {"unknown_token"}


def test_strict_restore_raises(spark):
    answers = spark.createDataFrame([(1, "s", "<A_001>")], "doc int, session string, text string")
    mapping = spark.createDataFrame([("t", "<A_001>", "x", ["x"])], "session string, token string, value string, forms array<string>")
    with pytest.raises(Exception, match="unknown token"):
        K.restore(answers, mapping, ["session"]).collect()


def test_vault(spark, tmp_path):
    path = str(tmp_path / "k" / "key")
    key = vault.load_or_create_key(path)
    assert vault.load_or_create_key(path) == key
    (tmp_path / "k" / "key").chmod(0o644)
    with pytest.raises(vault.VaultError):
        vault.load_or_create_key(path)
    e = spark.createDataFrame([("s", "<A_001>", "A", "geheim", ["geheim"], {"a": "b"})], "session_id string, token string, data_class string, value string, forms array<string>, attributes map<string,string>")
    mappings, forms = vault.store(e, key)
    mappings.write.parquet(str(tmp_path / "m"))
    assert b"geheim" not in b"".join(p.read_bytes() for p in (tmp_path / "m").glob("*.parquet"))
    moved = spark.read.parquet(str(tmp_path / "m")).withColumn("token", F.lit("<A_002>"))
    with pytest.raises(Exception, match="doesn't open"):
        vault.load(moved, forms, key).collect()
    sessions = spark.createDataFrame([("s", None, "", "h", "ext")], vault.SESSIONS)
    keys = spark.createDataFrame([("ext", "x", None, "h"), ("new", "y", None, "h")], "external_key string, id string, created_at timestamp, config_hash string")
    assert sorted(r["id"] for r in vault.get_or_create(sessions, keys).collect()) == ["s", "y"]
    assert vault.delete_tokens(mappings, mappings).count() == 0
    assert vault.known_forms(vault.load(mappings, forms, key)).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "terms.txt").write_text(" Acme \n# no\n\nBeta\n")
    (tmp_path / "s.json").write_text('{"dictionaries": {"CUSTOMER_NAME": {"files": ["terms.txt"], "terms": ["Own"]}}}')
    s = files.read_settings(spark, str(tmp_path / "s.json"))
    assert s.dictionaries["CUSTOMER_NAME"] == ("Own", "Acme", "Beta")
    assert files.read_texts(spark, str(tmp_path / "terms.txt")).first()["text"].startswith(" Acme")
    rows = files.audit_rows(spark, {"event": "restore", "restored_count": 2, "mode": "strict"})
    files.append_audit(rows, str(tmp_path / "audit"))
    files.append_audit(rows, str(tmp_path / "audit"))
    files.append_audit(rows, None)
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    with pytest.raises(ValueError):
        files.audit_rows(spark, {"event": "other"})
    counts = spark.createDataFrame([("B", 1), ("A", 2)], "cls string, n long")
    assert files.report(counts).first()[0] == '{"A":2,"B":1}'


def test_streams_with_state(spark, tmp_path):
    from larkveil.streaming.conversations import pseudonymize_stream
    from larkveil.streaming.events import restore_stream

    spark.createDataFrame([("s", 1, "KELLER again"), ("s", 0, "Frau Keller"), ("t", 0, "Herr Roth")], "session string, turn long, text string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, turn long, text string").json(str(tmp_path / "in"))
    q = pseudonymize_stream(stream).writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["session"], r["turn"]): r["text"] for r in spark.table("turns").collect()}
    assert got == {("s", 0): "Frau <PERSON_FEMALE_001>", ("s", 1): "<PERSON_FEMALE_001> again", ("t", 0): "Herr <PERSON_MALE_001>"}

    spark.createDataFrame([*(c for c in CHUNKS if c[0] == "cut"), ("cut", 999, None)], "stream_id string, seq long, chunk binary").coalesce(1).write.parquet(str(tmp_path / "b"))
    stream = spark.readStream.schema("stream_id string, seq long, chunk binary").parquet(str(tmp_path / "b"))
    q = restore_stream(stream, STREAM_MAPPING).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = b"".join(bytes(r["out"]) for r in spark.table("chunks").orderBy("seq").collect()).decode()
    assert "Keller" in out and "k@firma.de" in out and "_001" not in out


def test_command_line(spark, tmp_path, capsys):
    from larkveil import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Frau Keller, a@firma.de")
    (tmp_path / "in" / "b.txt").write_text("unknown <EMAIL_009>, b@firma.de")
    out, key = str(tmp_path / "out"), str(tmp_path / "key")
    assert cli.main(["validate", "--input", str(tmp_path / "in"), "--format", "json"]) == 2
    assert capsys.readouterr().out.strip() == '{"EMAIL":2,"PERSON_LAST_NAME":1,"SALUTATION":1}'
    assert cli.main(["pseudonymize", "--input", str(tmp_path / "in"), "--out", out, "--key", key]) == 2
    row = spark.read.parquet(f"{out}/texts").first()
    assert row["text"] == "Frau <PERSON_FEMALE_001>, <EMAIL_001>" and spark.read.parquet(f"{out}/mappings").count() == 2
    spark.createDataFrame([("1", row["session_id"], "to <EMAIL_001>")], "doc string, session_id string, text string").write.json(str(tmp_path / "answers"))
    assert cli.main(["restore", "--input", str(tmp_path / "answers"), "--vault", out, "--key", key, "--out", str(tmp_path / "back")]) == 0
    assert spark.read.json(str(tmp_path / "back")).first()["text"] == "to a@firma.de"
    assert cli.main(["vault", "purge", "--vault", out, "--session", row["session_id"], "--out", str(tmp_path / "left")]) == 0
    assert spark.read.parquet(str(tmp_path / "left" / "mappings")).count() == 0
    assert cli.main(["classes"]) == 0 and len(capsys.readouterr().out.strip().split("\n")) == 140
    (tmp_path / "bad.json").write_text('{"nope": 1}')
    assert cli.main(["classes", "--config", str(tmp_path / "bad.json")]) == 1
