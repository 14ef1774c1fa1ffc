"""Conversations as a stream: tokens and counters are state of the session's key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from larkveil.kernel.pipeline import Entry, Session
from larkveil.operators.detect import detector
from larkveil.plans.catalog import Settings

OUT = "session string, turn long, text string, status string"
#: A session whose state wasn't touched for so long is forgotten.
TTL_MS = 30 * 24 * 3600 * 1000


class Pseudonymizer(StatefulProcessor):
    """Rows of one session: session, turn, text. Order inside a micro-batch is by turn."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "token string", "entry string", TTL_MS)
        self.counters = handle.getMapState("counters", "label string", "last int", TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        entries = {k[0]: Entry(**json.loads(v[0])) for k, v in self.entries.iterator()}
        session = Session(detector(self.settings), entries, {k[0]: v[0] for k, v in self.counters.iterator()})
        out = []
        for r in pd.concat(list(rows)).sort_values(["turn", "text"], kind="stable").itertuples(index=False):
            text, bad = (None, []) if r.text is None else session.pseudonymize(r.text)
            out.append((str(key[0]), int(r.turn), text, "failed" if bad else "ok"))
        for token, e in session.entries.items():
            self.entries.updateValue((token,), (json.dumps({"cls": e.cls, "value": e.value, "forms": e.forms, "attrs": e.attrs}, ensure_ascii=False),))
        for label, last in session.counters.items():
            self.counters.updateValue((label,), (last,))
        yield pd.DataFrame(out, columns=["session", "turn", "text", "status"])

    def close(self) -> None:
        pass


def pseudonymize_stream(turns: DataFrame, settings: Settings | None = None) -> DataFrame:
    """A stream of (session, turn, text) to (session, turn, text, status)."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = StructType.fromDDL(OUT)
    return turns.groupBy("session").transformWithStateInPandas(Pseudonymizer(settings or Settings()), schema, "append", "ProcessingTime")
