"""Chat requests, responses and answer streams as tables: rewritten with their session's tokens, and restored.

A request is a row (session key, order, body). Its texts are rewritten in the body's order with the tokens of its
session, all or none: a body whose texts would leak is withheld and changes nothing in its session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkveil.kernel import bodies
from larkveil.kernel.pipeline import Entry, Session, restore
from larkveil.kernel.sse import StreamRestorer
from larkveil.operators.pseudonymize import ENTRY, entry_row, in_sessions
from larkveil.plans.catalog import Settings

# --- Fixed values: statuses and kinds of errors ---
OK, BAD_KEY, REFUSED = 200, 400, 422
# --- End of fixed values ---

SESSION = "session_key"


def with_session_key(requests: DataFrame, body: str = "body", headers: str | None = None, strategy: str = "metadata", header: str = "x-session-key", default: str = "default") -> DataFrame:
    """``requests`` with session_key; ``headers`` is a map column. A body that is no JSON object gets the header's key or the default."""
    kept = [c for c in requests.columns if c.lower() != SESSION]
    schema = T.StructType([*requests.select(kept).schema.fields, T.StructField(SESSION, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = [dict(x or ()) for x in b.column(b.schema.get_field_index(headers)).to_pylist()] if headers else [{}] * len(b)
            keys = [bodies.session_key(h, bodies.parse(x), strategy, header, default) for h, x in zip(given, b.column(b.schema.get_field_index(body)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in kept), pa.array(keys, pa.string())], names=[*kept, SESSION])

    return requests.select(kept).mapInArrow(run, schema)


def pseudonymize_requests(requests: DataFrame, order: str = "id", body: str = "body", settings: Settings | None = None, system: bool = True, notice: bool = False) -> DataFrame:
    """Requests (session_key, order, body) rewritten.

    session_key, order, status, body (null unless status is 200), error, fields (texts), new_tokens, reused_tokens, leakage (ok, failed,
    rejected), leak_classes (sorted), streaming, mapping (the entries that this request made or used). 400: the session key has an
    unusable form; 422: the body is no JSON object, or it would leak.
    """
    types = {
        "status": "int", body: "string", "error": "string", "fields": "bigint", "new_tokens": "bigint", "reused_tokens": "bigint", "leakage": "string",
        "leak_classes": "array<string>", "streaming": "boolean", "mapping": f"array<{ENTRY}>",
    }
    schema = T.StructType([requests.schema[SESSION], requests.schema[order], *(T.StructField(n, T._parse_datatype_string(t)) for n, t in types.items())])

    def step(row: dict, state: Session) -> tuple:
        key = (row[SESSION], row[order])
        parsed = bodies.parse(row[body])
        if parsed is None:
            return *key, REFUSED, None, "rejected: the body is no JSON object", 0, 0, 0, "rejected", [], False, []
        streaming = parsed.get("stream") is True
        if not bodies.is_session_key(row[SESSION] or ""):
            return *key, BAD_KEY, None, "session: the key has an unusable form", 0, 0, 0, "rejected", [], streaming, []
        places = bodies.texts(parsed, system)
        if places and notice and bodies.with_notice(parsed):
            places = bodies.texts(parsed, system)
        known = {t: len(e.forms) for t, e in state.entries.items()}
        new, bad = state.pseudonymize_all([t for _, t in places])
        if new is None:
            classes = sorted({x.cls for x in bad if x.cls})
            return *key, REFUSED, None, f"leak: {len(bad)} potential leaks ({', '.join(classes) or 'none'})", len(places), 0, 0, "failed", classes, streaming, []
        for (path, _), text in zip(places, new):
            bodies.put(parsed, path, text)
        used = {t: e for t, e in state.entries.items() if len(e.forms) != known.get(t)}
        made = sum(t not in known for t in used)
        written = json.dumps(parsed, ensure_ascii=False, separators=(",", ":"))
        return *key, OK, written, None, len(places), made, len(used) - made, "ok", [], streaming, [entry_row(t, e) for t, e in used.items()]

    return in_sessions(requests.select(SESSION, order, body), SESSION, [order, body], step, schema, settings or Settings())


def audit_of_requests(done: DataFrame, path: str = "/v1/messages") -> DataFrame:
    """A proxy_request and, where the session was used, a session_pseudonymize row for each request; names and numbers only."""
    own = done.select(
        F.col(SESSION).alias("session"), "fields", "new_tokens", "reused_tokens", "leakage", "streaming",
        F.explode(F.when(F.col("leakage") == "rejected", F.array(F.lit("proxy_request"))).otherwise(F.array(F.lit("proxy_request"), F.lit("session_pseudonymize")))).alias("event"),
    )
    request = F.col("event") == "proxy_request"
    return own.select(
        "event",
        F.when(request & (F.col("leakage") == "rejected"), F.lit("-")).otherwise(F.col("session")).alias("session"),
        F.when(request, F.lit(path)).alias("path"),
        F.when(request, F.col("fields")).alias("fields"),
        F.when(request, F.col("new_tokens") + F.col("reused_tokens")).alias("token_count"),
        F.when(~request, F.col("new_tokens")).alias("new_tokens"),
        F.when(~request, F.col("reused_tokens")).alias("reused_tokens"),
        "leakage",
        F.when(request, F.col("streaming")).alias("streaming"),
    )


def session_mapping(done: DataFrame) -> DataFrame:
    """session_key, mapping: each token's last state in its session, for restoring. One row a session."""
    entry = done.select(SESSION, F.explode("mapping").alias("m"))
    last = entry.groupBy(SESSION, F.col("m.token").alias("token")).agg(F.max_by("m", F.size("m.forms")).alias("m"))
    return last.groupBy(SESSION).agg(F.collect_list("m").alias("mapping"))


def _entries(mapping) -> dict[str, Entry]:
    return {m["token"]: Entry(m["cls"], m["value"], m["forms"]) for m in mapping or ()}


def restore_responses(responses: DataFrame, mapping: DataFrame, body: str = "body") -> DataFrame:
    """Responses (session_key, body, ...) with texts and tool inputs restored from their session's mapping; unknown tokens stay."""
    joined = responses.join(mapping.select(SESSION, F.col("mapping").alias("__mapping")), SESSION, "left")
    names = responses.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, given in zip(b.column(b.schema.get_field_index(body)).to_pylist(), b.column(b.schema.get_field_index("__mapping")).to_pylist()):
                entries = _entries(given)
                new = bodies.restore_response(raw or "", lambda t: restore(t, entries, "lenient")[0])  # noqa: B023
                out.append(raw if new is None else new)
            columns = {n: b.column(b.schema.get_field_index(n)) for n in names} | {body: pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.select(*names, "__mapping").mapInArrow(run, responses.schema)


def restore_streams(chunks: DataFrame, mapping: DataFrame, stream: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Chunks (session_key, stream, seq, chunk) of answer streams with their session's values: stream, seq, out.

    A null chunk ends its stream; the last chunk of a stream gets what is left over. Chunks are walked through in order, a task
    holds one stream's open events. The mapping travels with the first chunk of a stream only.
    """
    last, first = F.lead(seq).over(_by(stream, seq)).isNull(), F.lag(seq).over(_by(stream, seq)).isNull()
    marked = chunks.select(SESSION, stream, seq, chunk, last.alias("__last"), first.alias("__first"))
    begins = marked.where("__first").join(mapping.select(SESSION, F.col("mapping").alias("__mapping")), SESSION, "left")
    rest = marked.where("NOT __first").withColumn("__mapping", F.lit(None).cast(mapping.schema["mapping"].dataType))
    dealt = begins.unionByName(rest).repartition(stream).sortWithinPartitions(stream, seq)
    schema = T.StructType([chunks.schema[stream], chunks.schema[seq], T.StructField("out", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = StreamRestorer(str)
        for whole in batches:
            for at in range(0, len(whole), 500):
                out = []
                for r in whole.slice(at, 500).to_pylist():
                    if r["__first"]:
                        entries = _entries(r["__mapping"])
                        machine = StreamRestorer(lambda t, e=entries: restore(t, e, "lenient")[0])
                    made = b"" if r[chunk] is None else machine.feed(bytes(r[chunk]))
                    out.append((r[stream], r[seq], made + (machine.finish() if r["__last"] or r[chunk] is None else b"")))
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], whole.schema.field(stream).type), pa.array(columns[1], whole.schema.field(seq).type), pa.array(columns[2], pa.binary())], names=schema.names)

    return dealt.select(stream, seq, chunk, "__last", "__first", "__mapping").mapInArrow(run, schema)


def _by(stream: str, seq: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(stream).orderBy(seq)
