"""Whole texts and conversations: rewritten, checked, with their mappings. What leaks is withheld."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkveil.kernel.pipeline import Entry, Session, restore
from larkveil.operators.detect import arrow_type, detector, spread
from larkveil.plans.catalog import Settings

ENTRY = "struct<token:string,cls:string,value:string,forms:array<string>,attrs:map<string,string>>"
LEAK = "struct<kind:string,cls:string,start:int,end:int>"


def entry_row(token: str, e: Entry) -> dict:
    return {"token": token, "cls": e.cls, "value": e.value, "forms": e.forms, "attrs": list(e.attrs.items())}


def pseudonymize(docs: DataFrame, settings: Settings | None = None, text: str = "text") -> DataFrame:
    """Each row as a session of its own: status (ok, failed), the rewritten text (null if failed), mapping, leaks.

    Null text gives status ok, null text and no mapping.
    """
    settings = settings or Settings()
    kept = [f for f in docs.schema.fields if f.name != text]
    types = {text: "string", "status": "string", "mapping": f"array<{ENTRY}>", "leaks": f"array<{LEAK}>"}
    schema = T.StructType([*kept, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in types.items())])

    kinds = {n: arrow_type(t) for n, t in types.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = detector(settings)
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                rows: dict[str, list] = {n: [] for n in types}
                for x in b.column(b.schema.get_field_index(text)):
                    session = Session(machine)
                    out, bad = (None, []) if x.as_py() is None else session.pseudonymize(x.as_py())
                    rows[text].append(out)
                    rows["status"].append("failed" if bad else "ok")
                    rows["mapping"].append([entry_row(t, e) for t, e in session.entries.items()])
                    rows["leaks"].append([{"kind": y.kind, "cls": y.cls, "start": y.start, "end": y.end} for y in bad])
                own = [b.column(b.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, kinds[n]) for n, v in rows.items())], names=[*(f.name for f in kept), *types])

    return spread(docs).mapInArrow(run, schema)


def in_sessions(rows: DataFrame, session: str, order: list[str], step: Callable[[dict, Session], tuple], schema: T.StructType, settings: Settings) -> DataFrame:
    """``step(row, session)`` for each row of each session in order, as rows of ``schema``.

    Rows are dealt by session and sorted by it; a task walks through its rows with one running session, so what it
    holds is a slice of rows and that session's tokens, however many rows a session has. Null sessions are rows of
    their own session.
    """
    dealt = rows.repartition(session).sortWithinPartitions(F.col(session).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order))
    kinds = [arrow_type(f.dataType.simpleString()) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key, state = detector(settings), object(), None
        for whole in batches:
            for at in range(0, len(whole), 500):
                out = []
                for row in whole.slice(at, 500).to_pylist():
                    if row[session] != key:
                        key, state = row[session], Session(machine)
                    out.append(step(row, state))
                columns = zip(*out) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    return dealt.mapInArrow(run, schema)


def conversations(turns: DataFrame, settings: Settings | None = None, session: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Turns of each session in order, with tokens that go on: session, turn, text, status, n_tokens (of the session so far)."""
    schema = T.StructType([turns.schema[session], turns.schema[turn], T.StructField(text, T.StringType()), T.StructField("status", T.StringType()), T.StructField("n_tokens", T.LongType())])

    def step(row: dict, state: Session) -> tuple:
        out, bad = (None, []) if row[text] is None else state.pseudonymize(row[text])
        return row[session], row[turn], out, "failed" if bad else "ok", len(state.entries)

    return in_sessions(turns.select(session, turn, text), session, [turn, text], step, schema, settings or Settings())


def restore_texts(pseudonymized: DataFrame, text: str = "text", mode: str = "strict", key: str = "doc_id") -> DataFrame:
    """Texts beside their own mapping, restored: key, text, restored, unknown."""
    schema = T.StructType([pseudonymized.schema[key], T.StructField(text, T.StringType()), T.StructField("restored", T.LongType()), T.StructField("unknown", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value, mapping in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                entries = {m["token"]: Entry(m["cls"], m["value"], m["forms"]) for m in mapping or ()}
                out.append((None, 0, []) if value is None else restore(value, entries, mode))
            texts, n, unknown = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(unknown, pa.list_(pa.string()))], names=schema.names)

    return pseudonymized.select(key, text, "mapping").mapInArrow(run, schema)
