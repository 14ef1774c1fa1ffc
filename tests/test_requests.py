"""Requests, sessions, the vault's safety, and what the planted relations don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from larkveil.kernel.pipeline import Detector, Session
from larkveil.operators import pseudonymize as P
from larkveil.operators import requests as Q
from larkveil.plans.catalog import Settings
from larkveil.sources import vault


def body(*texts, **more):
    return json.dumps({"messages": [{"role": "user", "content": t} for t in texts]} | more)


def test_a_request_that_leaks_changes_nothing():
    session = Session(Detector(Settings()))
    assert session.pseudonymize_all(["an a@mail.example.com"])[0] == ["an <EMAIL_001>"]
    before = dict(session.entries), dict(session.counters)
    out, bad = session.pseudonymize_all(["neu b@mail.example.com", "von <EMAIL_099>"])
    assert out is None and [x.kind for x in bad] == ["unknown_token"] and (session.entries, session.counters) == before
    assert session.pseudonymize_all(["neu c@mail.example.com", "alt a@mail.example.com"])[0] == ["neu <EMAIL_002>", "alt <EMAIL_001>"]


def test_requests_of_odd_rows(spark):
    rows = [("s", 1, body("an a@mail.example.com")), ("s", 1, body("an a@mail.example.com")), ("s", 2, None), (None, 3, body("x")), ("", 4, body("x")), ("t", 5, body()), ("t", 6, "{}"), ("t", 7, "17")]
    done = Q.pseudonymize_requests(spark.createDataFrame(rows, "session_key string, id long, body string"))
    out = sorted(done.collect(), key=lambda r: (r["id"], r["new_tokens"]))
    assert [(r["id"], r["status"], r["fields"], r["new_tokens"], r["reused_tokens"]) for r in out] == [(1, 200, 1, 0, 0), (1, 200, 1, 1, 0), (2, 422, 0, 0, 0), (3, 400, 0, 0, 0), (4, 400, 0, 0, 0), (5, 200, 0, 0, 0), (6, 200, 0, 0, 0), (7, 422, 0, 0, 0)]
    assert all((r["body"] is None) == (r["status"] != 200) for r in out)
    assert Q.pseudonymize_requests(done.select("session_key", "id", "body").limit(0)).count() == 0


def test_notice_stands_once_and_system_can_stay(spark):
    rows = [("s", 1, body("an a@mail.example.com", system="von b@mail.example.com")), ("s", 2, body("x"))]
    df = spark.createDataFrame(rows, "session_key string, id long, body string")
    out = {r["id"]: json.loads(r["body"]) for r in Q.pseudonymize_requests(df, system=False, notice=True).collect()}
    content = out[1]["messages"][0]["content"]
    assert len(content) == 2 and content[1]["text"] == "an <EMAIL_001>" and out[1]["system"] == "von b@mail.example.com"
    again = spark.createDataFrame([("s", 1, json.dumps(out[1]))], "session_key string, id long, body string")
    texts = json.loads(Q.pseudonymize_requests(again, system=False, notice=True).first()["body"] or "null")
    assert texts is None or len(texts["messages"][0]["content"]) == 2


def test_session_keys_come_from_user_header_or_default(spark):
    user = "01234567-89ab-cdef-0123-456789abcdef"
    rows = [
        (1, {}, body(metadata={"user_id": json.dumps({"session_id": " abc "})})), (2, {}, body(metadata={"user_id": f"user_1_session_{user}"})), (3, {"X-Session-Key": "own"}, body()),
        (4, None, None), (5, {"x-session-key": " "}, "[]"),
    ]
    df = spark.createDataFrame(rows, "id int, headers map<string,string>, body string")
    assert {r["id"]: r["session_key"] for r in Q.with_session_key(df, headers="headers").collect()} == {1: "abc", 2: user, 3: "own", 4: "default", 5: "default"}


def test_long_sessions_are_walked_through_in_order(spark):
    rows = [(s, t, f"an m{t % 7}@mail.example.com") for s in (1, None) for t in range(1300)]
    out = P.conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    by = {(r["conv_id"], r["turn"]): r["text"] for r in out}
    assert len(out) == 2600 and all(by[s, t] == f"an <EMAIL_{t % 7 + 1:03d}>" for s, t, _ in rows)


def test_streams_end_with_a_null_or_their_last_chunk(spark):
    delta = lambda t: f'event: content_block_delta\ndata: {{"type":"content_block_delta","index":0,"delta":{{"type":"text_delta","text":"{t}"}}}}\n\n'.encode()
    rows = [("s", "a", 0, delta("von <EMA")), ("s", "a", 1, delta("IL_001> und <EM")), ("s", "a", 2, None), ("x", "b", 0, delta("<EMAIL_001> <EM")), ("s", "c", 0, None)]
    mapping = spark.createDataFrame([("s", [("<EMAIL_001>", "EMAIL", "a@b.de", ["a@b.de"], {})])], f"session_key string, mapping array<{P.ENTRY}>")
    out = Q.restore_streams(spark.createDataFrame(rows, "session_key string, stream_id string, seq long, chunk binary"), mapping).collect()
    text = {s: "".join(json.loads(line[6:])["delta"]["text"] for r in sorted(out, key=lambda r: r["seq"]) if r["stream_id"] == s for line in bytes(r["out"]).decode().split("\n") if line.startswith("data: ")) for s in "abc"}
    assert text == {"a": "von a@b.de und <EM", "b": "<EMAIL_001> <EM", "c": ""} and len(out) == 5


def test_plans_do_not_show_the_key(spark, capsys):
    key = bytes(range(100, 132))
    sealed = spark.range(1).select(vault.seal(F.lit("v"), key, F.lit("p")).alias("s"))
    sealed.select(vault.unseal(F.col("s"), key, F.lit("p"))).explain(True)
    shown = capsys.readouterr().out.lower()
    assert "aes_encrypt" in shown and key.hex() not in shown


def test_saved_tables_are_in_buckets(spark, tmp_path):
    table = spark.createDataFrame([(f"s{i}", f"<A_{i:03d}>", b"x") for i in range(600)], "session_id string, token string, sealed binary")
    vault.save(table, f"{tmp_path}/t")
    folders = [p for p in (tmp_path / "t").iterdir() if p.name.startswith("bucket=")]
    assert len(folders) <= vault.BUCKETS and vault.read(spark, f"{tmp_path}/t").count() == 600
    assert [r["token"] for r in vault.read(spark, f"{tmp_path}/t", "s7").collect()] == ["<A_007>"]


def test_sessions_exist_and_settings_change(spark):
    sessions = spark.createDataFrame([("i", "k", "f1"), ("j", "l", "f2")], "id string, external_key string, config_hash string")
    assert vault.exists(sessions, "k") and not vault.exists(sessions, "z")
    assert [r["id"] for r in vault.changed_settings(sessions, "f1").collect()] == ["j"]


def test_audit_rows_of_requests(spark):
    rows = [("s", 1, body("an a@mail.example.com", stream=True)), ("s", 2, "no"), ("s", 3, body("von <EMAIL_099>"))]
    done = Q.pseudonymize_requests(spark.createDataFrame(rows, "session_key string, id long, body string"))
    got = sorted((r["event"], r["leakage"], r["session"], r["token_count"], r["new_tokens"], r["streaming"]) for r in Q.audit_of_requests(done).collect() if r["leakage"] != "failed")
    assert got == [("proxy_request", "ok", "s", 1, None, True), ("proxy_request", "rejected", "-", 0, None, False), ("session_pseudonymize", "ok", "s", None, 1, None)]
    assert [r["leak_classes"] for r in done.where("leakage = 'failed'").collect()] == [[]]


@pytest.mark.parametrize("mode", ["ok", "fails"])
def test_staged_rows_are_gone_whatever_happens(spark, tmp_path, mode, monkeypatch):
    from larkveil import cli
    from larkveil.sources import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("an a@mail.example.com", encoding="utf-8")
    if mode == "fails":
        monkeypatch.setattr(files, "append_audit", lambda *a: (_ for _ in ()).throw(ValueError("no")))
    args = ["pseudonymize", "--input", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--key", str(tmp_path / "key")]
    assert cli.main(args) == (0 if mode == "ok" else 1)
    assert not (tmp_path / "out" / "staged").exists()
    key = vault.load_or_create_key(str(tmp_path / "key"))
    entries = vault.load(spark.read.parquet(f"{tmp_path}/out/mappings"), spark.read.parquet(f"{tmp_path}/out/forms"), key).collect()
    assert [(e["token"], e["value"], e["forms"]) for e in entries] == [("<EMAIL_001>", "a@mail.example.com", ["a@mail.example.com"])]


def test_own_stages_and_environment(spark):
    from larkveil.kernel.hits import Hit
    from larkveil.operators import detect as D
    from larkveil.plans.catalog import SettingsError, layered

    def shouted(text, before):
        at = text.find("HEY")
        return [Hit(at, at + 3, "PERSON_ALIAS", "shouted", 0.9)] if at >= 0 else []

    out = D.detect(spark.createDataFrame([(1, "so HEY da")], "doc_id long, text string"), extra=[shouted]).first()
    assert [(f["start"], f["cls"], f["stage"]) for f in out["findings"]] == [(3, "PERSON_ALIAS", "shouted")] and out["by_stage"]["shouted"] == 1
    s = layered({"vault": {"path": "/v", "key_file": "/k"}}, env={"LARKVEIL_VAULT": "/w", "LARKVEIL_AUDIT": "/a", "LARKVEIL_RESTORE_MODE": "lenient"})
    assert (s.vault_path, s.key_path, s.audit_path, s.restore_mode) == ("/w", "/k", "/a", "lenient")
    with pytest.raises(SettingsError):
        layered({"vault": {"path": " "}})
    with pytest.raises(SettingsError):
        layered({}, env={"LARKVEIL_RESTORE_MODE": "odd"})
