"""The registered queries: each applies an operator to the tables or to a small literal relation, with SQL to compare."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkveil.functions import spans as S
from larkveil.functions import validators as V
from larkveil.functions import web as W
from larkveil.operators import detect as D
from larkveil.operators import entities as E
from larkveil.operators import intervals as I
from larkveil.operators import pseudonymize as P
from larkveil.operators import requests as Q
from larkveil.operators import tokens as K
from larkveil.plans import planted as L
from larkveil.plans import relations as R
from larkveil.plans.catalog import Settings
from larkveil.sources import files, vault
from larkveil.streaming.events import restore_chunks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- spans and validators over whole tables ---

MAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
MAIL_RE2 = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
IPV4 = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
CARD = r"(?U)\b(?:\d[ -]?){13,19}\b"
FQDN = r"(?U)\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,}[A-Za-z]{2,}\b"


def _spans(rows: DataFrame, key: str, text: str, pattern: str, needs: str) -> DataFrame:
    """Spans of a pattern; rows that can't have one are left out before the costly part."""
    found = rows.where(F.col(text).rlike(needs)).select(key, F.explode(S.find_spans(F.col(text), pattern)).alias("s"))
    return found.select(key, F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.value").alias("value"))


@query(R.spans_sql("documents", "doc_id", "text", MAIL_RE2))
def email_spans(spark, sf_dir):
    return _spans(table(spark, sf_dir, "documents"), "doc_id", "text", MAIL, "@")


@query(R.spans_sql("documents", "doc_id", "text", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"))
def ipv4_spans(spark, sf_dir):
    return _spans(table(spark, sf_dir, "documents"), "doc_id", "text", IPV4, r"\d\.\d")


@query(R.spans_sql("pages", "page_id", "html", r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,}[A-Za-z]{2,}\b", f"value_ok(value) = 1", extra=R.FQDN_OK))
def fqdn_spans(spark, sf_dir):
    found = _spans(table(spark, sf_dir, "pages"), "page_id", "html", r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,}[A-Za-z]{2,}\b".replace(r"\b", R.JAVA_ASCII_B), r"[A-Za-z0-9]\.[A-Za-z]")
    return found.where(V.fqdn(F.col("value")))


@query(f"SELECT doc_id, start, rtrim(value, ' -') AS value, {R.luhn_sql('value')} AS valid FROM ({R.spans_sql('documents', 'doc_id', 'text', R.CARD_RE2)})")
def card_luhn(spark, sf_dir):
    """Numbers of cards; the pattern may end in a separator, which RE2 sees in fewer places, so values go without."""
    found = _spans(table(spark, sf_dir, "documents"), "doc_id", "text", CARD, r"\d[ -]?\d")
    return found.select("doc_id", "start", F.rtrim(F.col("value"), F.lit(" -")).alias("value"), V.luhn(F.col("value")).alias("valid"))


@query(f"SELECT {R.ip_scope_sql('value')} AS scope, count(*) AS n FROM ({R.spans_sql('documents', 'doc_id', 'text', R.IPV4_RE2)}) GROUP BY 1")
def ip_scope_counts(spark, sf_dir):
    return ipv4_spans(spark, sf_dir).groupBy(V.ipv4_scope(F.col("value")).alias("scope")).agg(F.count("*").alias("n"))


def _probe(name):
    def run(spark, sf_dir):
        return spark.sql(R.PROBES[name]).select("value", F.coalesce(V.VALIDATORS[name](F.col("value")), F.lit(False)).alias("valid"))

    run.__name__ = f"valid_{name}"
    return run


for _name in R.PROBES:
    query(f"SELECT value, coalesce({R.VALID_SQL[_name]}, FALSE) AS valid FROM ({R.PROBES[_name]})")(_probe(_name))


@query(
    "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, "
    "nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query FROM pages"
)
def url_parts(spark, sf_dir):
    part = lambda p: F.coalesce(F.try_parse_url("url", F.lit(p)), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", part("HOST").alias("host"), part("PATH").alias("path"), F.try_parse_url("url", F.lit("QUERY")).alias("query"))


@query(
    "SELECT page_id, split_part(p, '=', 1) AS key, CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) ELSE '' END AS value "
    "FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS p FROM pages) WHERE p <> ''"
)
def query_pairs(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(S.pairs(F.try_parse_url("url", F.lit("QUERY")), "&")).alias("p"))
    return found.select("page_id", "p.key", "p.value")


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(f"SELECT page_id, CASE WHEN {_HOST} = 'example.org' OR ends_with({_HOST}, '.example.org') THEN 'CUSTOMER_DOMAIN' WHEN regexp_matches({_HOST}, '[.](local|internal|corp|lan)$') THEN 'INTERNAL_DOMAIN' ELSE 'FQDN' END AS cls FROM pages")
def host_classes(spark, sf_dir):
    host = F.try_parse_url("url", F.lit("HOST"))
    return table(spark, sf_dir, "pages").select("page_id", W.host_class(host, F.lit("FQDN"), customer=["example.org"]).alias("cls"))


@query("SELECT page_id, CASE WHEN contains(" + _HOST + ", '.') THEN 'URL' ELSE 'INTERNAL_URL' END AS cls FROM pages")
def url_classes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", W.url_class(F.col("url")).alias("cls"))


@query(R.NAMED_SQL)
def named_values(spark, sf_dir):
    """Cookie, query and standard names, web tokens."""
    v = F.col("value")
    return spark.sql(R.NAMED).select("value", W.cookie_class(v).alias("cookie"), W.query_secret(v).alias("secret"), W.is_standard(v).alias("standard"), W.is_web_token(v).alias("web_token"))


@query(
    f"SELECT doc_id, start, coalesce(regexp_matches(substr(text, CAST(greatest(1, start - 39) AS BIGINT), CAST(least(40, start) AS BIGINT)), '(?i)(^|[^A-Za-z0-9])(the|und|de)($|[^A-Za-z0-9])'), FALSE) AS near "
    f"FROM ({R.spans_sql('documents', 'doc_id', 'text', R.IPV4_RE2)}) JOIN documents USING (doc_id)"
)
def context_gate(spark, sf_dir):
    """Whether one of some words stands in the forty characters before each address."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\d\.\d"))
    found = docs.select("doc_id", "text", F.explode(S.find_spans(F.col("text"), IPV4)).alias("s"))
    return found.select("doc_id", F.col("s.start").cast("long").alias("start"), W.has_word(F.col("text"), F.col("s.start"), ["the", "und", "de"]).alias("near"))


# --- the whole detector over whole tables ---


def _found(spark, sf_dir, name="documents", key="doc_id", text="text"):
    return D.findings(D.detect(table(spark, sf_dir, name).select(key, text), text=text), key)


@query()
def findings_documents(spark, sf_dir):
    return _found(spark, sf_dir).select("doc_id", "seq", "start", "end", "cls", "stage", "conf", "entity", F.to_json("attrs").alias("attrs"), F.to_json("parts").alias("parts"))


_CARD_OK = R.luhn_sql("value")
_COUNTED = (
    f"SELECT 'EMAIL' AS cls, doc_id FROM ({R.spans_sql('documents', 'doc_id', 'text', MAIL_RE2)}) "
    f"UNION ALL SELECT upper({R.ip_scope_sql('value')}) || '_IP', doc_id FROM ({R.spans_sql('documents', 'doc_id', 'text', R.IPV4_RE2)}) WHERE {R.ip_scope_sql('value')} IS NOT NULL "
    f"UNION ALL SELECT 'CREDIT_CARD', doc_id FROM ({R.spans_sql('documents', 'doc_id', 'text', R.CARD_RE2)}) WHERE {_CARD_OK} "
    f"UNION ALL SELECT 'AWS_ACCESS_KEY', doc_id FROM ({R.spans_sql('documents', 'doc_id', 'text', R.AWS_RE2)})"
)


@query(f"SELECT cls, count(*) AS n FROM ({_COUNTED}) GROUP BY cls")
def counts_by_class(spark, sf_dir):
    return D.counts_by_class(_found(spark, sf_dir))


@query(f"SELECT d.lang, f.cls, count(*) AS n FROM ({_COUNTED}) f JOIN documents d USING (doc_id) GROUP BY 1, 2")
def findings_per_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = D.detect(docs.select("doc_id", "lang", "text")).select("lang", F.explode("findings.cls").alias("cls"))
    return found.groupBy("lang", "cls").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN cls = 'AWS_ACCESS_KEY' THEN 'redact' ELSE 'tokenize' END AS policy, count(*) AS n FROM ({_COUNTED}) GROUP BY 1")
def counts_by_policy(spark, sf_dir):
    return D.with_policy(_found(spark, sf_dir), D.classes_table(spark)).groupBy("policy").agg(F.count("*").alias("n"))


@query()
def counts_by_stage(spark, sf_dir):
    return D.counts_by_stage(D.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query()
def findings_pages(spark, sf_dir):
    return D.counts_by_class(_found(spark, sf_dir, "pages", "page_id", "html"))


# --- planted values over the whole table of suppliers ---


def _texts(spark, sf_dir, cases):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(L.texts_sql(cases))


def _planted(cases):
    def run(spark, sf_dir):
        found = D.detect(_texts(spark, sf_dir, cases)).select("k", "rule", F.explode("findings").alias("f"))
        return found.select("k", "rule", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"), "f.cls", F.round(F.col("f.conf") * 100).cast("long").alias("percent"), "f.stage")

    return run


def _planted_tokens(cases):
    def run(spark, sf_dir):
        return P.pseudonymize(_texts(spark, sf_dir, cases)).select("k", "rule", "text", "status")

    return run


for _name, _cases in L.CASES.items():
    for _made, _sql in ((_planted(_cases), L.spans_sql(_cases)), (_planted_tokens(_cases), L.tokens_sql(_cases))):
        _made.__name__ = f"planted_{_name}" + ("_tokens" if _sql == L.tokens_sql(_cases) else "")
        query(_sql)(_made)


def _suppliers(spark, sf_dir, sql):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(sql)


@query(L.addresses_sql())
def planted_scopes(spark, sf_dir):
    """Addresses of both versions and near misses, native."""
    return _suppliers(spark, sf_dir, L.addresses_sql()).select("k", "n", "value", V.ip_scope(F.col("value")).alias("scope"))


@query(L.spans_sql(L.WORD_CASES))
def planted_words(spark, sf_dir):
    """Words of one's own dictionaries: the longest, whole words, any case, genitives, hosts."""
    found = D.detect(_texts(spark, sf_dir, L.WORD_CASES), replace(Settings(), dictionaries=L.OWN_WORDS)).select("k", "rule", F.explode("findings").alias("f"))
    return found.select("k", "rule", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"), "f.cls", F.round(F.col("f.conf") * 100).cast("long").alias("percent"), "f.stage")


@query(L.turn_tokens_sql())
def planted_sessions(spark, sf_dir):
    """Tokens that go on through the turns of a session."""
    return P.conversations(_suppliers(spark, sf_dir, L.turns_sql()))


@query(L.leaks_sql())
def planted_leaks(spark, sf_dir):
    """What rewritten texts would still tell; they are withheld."""
    done = P.pseudonymize(_suppliers(spark, sf_dir, L.texts_sql(L.LEAKING))).where("status = 'failed' AND text IS NULL")
    return done.select("k", "rule", F.explode("leaks").alias("x")).select("k", "rule", "x.kind", "x.cls", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))


@query(L.request_texts_sql())
def planted_request_texts(spark, sf_dir):
    return R.request_texts(_suppliers(spark, sf_dir, L.requests_sql()).where("id % 8 < 2"))


def _requests(spark, sf_dir):
    return Q.with_session_key(_suppliers(spark, sf_dir, L.requests_sql()))


@query(L.session_keys_sql())
def planted_session_keys(spark, sf_dir):
    return _requests(spark, sf_dir).select("id", "session_key")


@query(L.answers_sql())
def planted_requests(spark, sf_dir):
    """Requests rewritten with their session's tokens: statuses, bodies, counts."""
    return Q.pseudonymize_requests(_requests(spark, sf_dir)).select("id", "status", "body", "fields", "new_tokens", "reused_tokens", "leakage", "streaming")


@query(L.audits_sql())
def planted_audits(spark, sf_dir):
    rows = Q.audit_of_requests(Q.pseudonymize_requests(_requests(spark, sf_dir)))
    return rows.groupBy("event", "leakage").agg(F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("fields", "new_tokens", "reused_tokens")))


def _mapping(spark, sf_dir):
    return Q.session_mapping(Q.pseudonymize_requests(_requests(spark, sf_dir)))


@query(L.restored_sql())
def planted_responses(spark, sf_dir):
    """Responses restored with what their session's requests were rewritten with."""
    return Q.restore_responses(_suppliers(spark, sf_dir, L.responses_sql()), _mapping(spark, sf_dir))


@query(L.streamed_sql())
def planted_streams(spark, sf_dir):
    """Answer streams in chunks of 41 bytes, each restored with its own session's mapping; the text of their deltas."""
    raw = _suppliers(spark, sf_dir, L.stream_sql()).withColumn("bytes", F.encode("text", "UTF-8"))
    chunks = raw.select("session_key", "stream_id", F.explode(F.sequence(F.lit(0), F.ceil(F.length("bytes") / 41).cast("int") - 1)).alias("seq"), "bytes")
    chunks = chunks.select("session_key", "stream_id", F.col("seq").cast("long").alias("seq"), F.substring("bytes", F.col("seq") * 41 + 1, F.lit(41)).alias("chunk"))
    whole = Q.restore_streams(chunks, _mapping(spark, sf_dir)).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "out"))).alias("parts"))
    text = F.decode(F.aggregate("parts", F.encode(F.lit(""), "UTF-8"), lambda a, p: F.concat(a, p["out"])), "UTF-8")
    return whole.select("stream_id", F.array_join(F.regexp_extract_all(text, F.lit('"text":"([^"]*)"'), F.lit(1)), "").alias("text"))


def _pseudonymized(spark, sf_dir):
    return P.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def pseudonymize_documents(spark, sf_dir):
    return _pseudonymized(spark, sf_dir).select("doc_id", "text", "status", F.size("mapping").cast("long").alias("n_tokens"), F.size("leaks").cast("long").alias("n_leaks"))


@query(f"SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({R.spans_sql('documents', 'doc_id', 'text', R.AWS_RE2)}))")
def restore_round_trip(spark, sf_dir):
    """Texts rewritten and restored; those with redactions can't come back and are left out."""
    done = _pseudonymized(spark, sf_dir).where("status = 'ok' AND NOT coalesce(text RLIKE '<[A-Z_]+_REDACTED>', false)")
    return P.restore_texts(done).select("doc_id", "text")


@query("SELECT conv_id, turn, text, 'ok' AS status FROM conversations")
def conversation_tokens(spark, sf_dir):
    """Every turn of every conversation; the tables' conversations hold no value, so texts stay."""
    return P.conversations(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text", "status")


@query()
def conversation_literal(spark, sf_dir):
    return P.conversations(spark.sql(R.TURNS)).withColumn("n_tokens", F.col("n_tokens"))


@query("SELECT 'ok' AS leakage, count(*) AS n FROM documents")
def audit_totals(spark, sf_dir):
    return files.audit_of(_pseudonymized(spark, sf_dir)).groupBy("leakage").agg(F.count("*").alias("n"))


# --- relations: spans ---


@query(R.UNION_SQL)
def interval_union(spark, sf_dir):
    return I.union_spans(spark.sql(R.SPANS).select("doc", "start", "end"), "doc")


@query(R.CONTAINED_SQL)
def drop_contained(spark, sf_dir):
    return I.drop_contained(spark.sql(R.SPANS), "doc").select("doc", "seq", "start", "end")


@query(R.OUTSIDE_SQL)
def residual_outside_tokens(spark, sf_dir):
    return I.outside(spark.sql(R.SPANS), spark.sql(R.COVERS), "doc").select("doc", "seq", "start", "end")


# --- relations: entities ---


def _literal_findings(spark):
    rows = spark.sql(R.FINDINGS)
    return rows.withColumn("key", E.key_column(F.col("cls"), F.col("value")))


@query(R.GROUPS_SQL)
def entity_groups(spark, sf_dir):
    g = E.groups(_literal_findings(spark))
    return g.select("doc", "cls", "key", F.col("first.start").alias("start"), "conf", "n")


@query(R.PERSON_LINKS_SQL)
def person_links(spark, sf_dir):
    return E.person_links(E.groups(_literal_findings(spark)))


@query(R.GENERIC_LINKS_SQL)
def generic_id_links(spark, sf_dir):
    return E.generic_links(E.groups(_literal_findings(spark)))


@query(R.ENTITIES_SQL)
def entity_numbers(spark, sf_dir):
    out = E.correlate(_literal_findings(spark))
    return out.select("doc", "seq", "entity", "entity_cls", "norm", "conf", "gender", "gender_conflict")


@query(R.MAIL_LINK_SQL)
def mail_links(spark, sf_dir):
    return E.link_mails(spark.sql(R.MAILS), spark.sql(R.PEOPLE))


# --- relations: tokens ---


@query(R.NUMBERING_SQL)
def token_numbering(spark, sf_dir):
    found, reserved, counters = (spark.sql(x) for x in (R.TO_TOKENIZE, R.RESERVED, R.COUNTERS))
    return K.assign_tokens(found, reserved, counters).select("doc", "label", "entity", F.col("number").cast("long").alias("number"), "token")


@query(R.RESERVED_SQL)
def reserved_literals(spark, sf_dir):
    found = spark.sql(R.TOKEN_TEXTS).select("doc", F.explode(K.reserved_numbers(F.col("text"))).alias("r"))
    return found.select("doc", "r.label", F.col("r.number").cast("long").alias("number"))


@query(R.REWRITE_SQL)
def rewrite_texts(spark, sf_dir):
    return K.rewrite(spark.sql(R.REWRITE_TEXTS), spark.sql(R.REPLACEMENTS)).select("doc", "text")


@query(R.RESTORE_SQL)
def restore_forms(spark, sf_dir):
    out = K.restore(spark.sql(R.ANSWERS), spark.sql(R.MAPPING), ["session"], mode="lenient")
    return out.select("doc", "text", F.col("restored").cast("long").alias("restored"))


@query(R.LEAKS_SQL)
def leaked_values(spark, sf_dir):
    return K.value_leaks(spark.sql(R.LEAK_TEXTS), spark.sql(R.LEAK_VALUES)).select("doc", "value")


@query(R.UNKNOWN_SQL)
def unknown_tokens(spark, sf_dir):
    return K.unknown_tokens(spark.sql(R.ANSWERS), spark.sql(R.MAPPING))


# --- relations: the vault ---

KEY = bytes(range(32))


@query(R.SESSIONS_SQL)
def session_list(spark, sf_dir):
    return vault.list_sessions(spark.sql(R.SESSIONS), spark.sql(R.VAULT_MAPPINGS)).select("id", "token_count")


@query(R.COUNTERS_SQL)
def max_counters(spark, sf_dir):
    return vault.max_counters(spark.sql(R.VAULT_MAPPINGS)).withColumn("last", F.col("last").cast("long"))


@query("SELECT id FROM (" + R.SESSIONS + ") WHERE created_at < TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 30 DAY")
def older_sessions(spark, sf_dir):
    return vault.older_than(spark.sql(R.SESSIONS), 30, F.lit("2024-03-01 00:00:00").cast("timestamp"))


@query(
    "SELECT s.id, (SELECT count(*) FROM (" + R.VAULT_MAPPINGS + ") m WHERE m.session_id = s.id) AS tokens FROM (" + R.SESSIONS + ") s WHERE NOT s.created_at < TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 30 DAY"
)
def purge_old(spark, sf_dir):
    sessions, mappings = spark.sql(R.SESSIONS), spark.sql(R.VAULT_MAPPINGS)
    forms = mappings.select("session_id", "token")
    gone = vault.older_than(sessions, 30, F.lit("2024-03-01 00:00:00").cast("timestamp"))
    left, own, _ = vault.purge(sessions, mappings, forms, gone)
    return vault.list_sessions(left, own).select("id", F.col("token_count").alias("tokens"))


@query(R.ENTRIES_SQL)
def vault_round_trip(spark, sf_dir):
    mappings, forms = vault.store(spark.sql(R.ENTRIES).withColumn("attributes", F.create_map(F.lit("a"), F.lit("b"))), KEY)
    return vault.load(mappings, forms, KEY).select("session_id", "token", "data_class", "value", F.array_join("forms", "/").alias("forms"))


@query("SELECT session_id, token, CAST(i AS BIGINT) AS ordinal, form FROM (VALUES ('s1', '<A_001>', 0, 'x'), ('s1', '<A_001>', 1, 'y'), ('s1', '<A_001>', 2, 'z'), ('s2', '<A_001>', 0, 'q')) AS t(session_id, token, i, form)")
def append_forms(spark, sf_dir):
    start = spark.sql("SELECT 's1' AS session_id, '<A_001>' AS token, 'A' AS data_class, 'x' AS value, array('x', 'y') AS forms").withColumn("attributes", F.create_map(F.lit("a"), F.lit("b")))
    _, forms = vault.store(start, KEY)
    more = spark.sql("SELECT * FROM VALUES ('s1', '<A_001>', array('z')), ('s2', '<A_001>', array('q')) AS t(session_id, token, forms)")
    place = F.concat_ws("|", "session_id", "token", F.col("ordinal").cast("string"))
    return vault.append_forms(forms, more, KEY).select("session_id", "token", F.col("ordinal").cast("long").alias("ordinal"), vault.unseal(F.col("sealed"), KEY, place).alias("form"))


@query("SELECT a.session_id, a.token FROM (" + R.ENTRIES_PLAIN + ") a JOIN (" + R.ENTRIES_CHANGED + ") b ON a.session_id = b.session_id AND a.token = b.token WHERE a.value <> b.value")
def vault_conflicts(spark, sf_dir):
    return vault.conflicts(spark.sql(R.ENTRIES_PLAIN), spark.sql(R.ENTRIES_CHANGED))


# --- texts, terms, bodies, streams ---


@query("SELECT name, category, policy, CAST(priority AS INTEGER) AS priority, label FROM (VALUES " + R.catalog_values() + ") AS t(name, category, policy, priority, label)")
def class_catalog(spark, sf_dir):
    return D.classes_table(spark).select("name", "category", "policy", "priority", "label")


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS w FROM documents) WHERE lower(w) IN ('idiot', 'clown', 'moron', 'the') GROUP BY doc_id")
def term_counts(spark, sf_dir):
    """Whole-word terms, as a broadcast join of words with the term list (one-word terms)."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    listed = spark.createDataFrame([("idiot",), ("clown",), ("moron",), ("the",)], "term string")
    return words.join(F.broadcast(listed), F.lower("w") == F.col("term")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def normalized_texts(spark, sf_dir):
    return R.normalized(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text")


@query()
def request_texts(spark, sf_dir):
    return R.request_texts(spark.createDataFrame(R.REQUESTS, "id long, body string"))


@query()
def event_stream(spark, sf_dir):
    chunks = spark.createDataFrame(R.CHUNKS, "stream_id string, seq long, chunk binary")
    return restore_chunks(chunks, R.STREAM_MAPPING).select("stream_id", F.col("out").cast("string").alias("out"))


@query("SELECT id, key FROM (VALUES (1, 'abc'), (2, '01234567-89ab-cdef-0123-456789abcdef'), (3, 'own'), (4, 'default')) AS t(id, key)")
def session_keys(spark, sf_dir):
    """Native: the id in the user's JSON, else the id in the user's name, else the header, else the default."""
    rows = spark.createDataFrame(R.KEY_ROWS, "id int, user_id string, header string")
    own = F.nullif(F.trim(F.get_json_object("user_id", "$.session_id")), F.lit(""))
    named = F.nullif(F.regexp_extract("user_id", "session_([0-9a-f-]{36})", 1), F.lit(""))
    return rows.select("id", F.coalesce(own, named, F.nullif(F.trim("header"), F.lit("")), F.lit("default")).alias("key"))
