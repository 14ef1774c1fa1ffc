"""Answer streams: chunks of server-sent events, restored with the session's mapping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from larkveil.kernel.pipeline import Entry, restore
from larkveil.kernel.sse import StreamRestorer

OUT = "stream_id string, seq long, out binary"
#: The state of a stream that nothing came for so long is forgotten.
TTL_MS = 24 * 3600 * 1000


def _changer(mapping: dict[str, tuple]):
    entries = {t: Entry("", v, list(f)) for t, (v, f) in mapping.items()}
    return lambda text: restore(text, entries, "lenient")[0]


def restore_chunks(chunks: DataFrame, mapping: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """stream_id, out: each stream (stream_id, seq, chunk) restored whole, in the order of seq.

    ``mapping``: token to (value, forms) of the session that the streams belong to.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        machine = StreamRestorer(_changer(mapping))
        parts = [machine.feed(bytes(c)) for c in pdf.sort_values("seq")["chunk"]]
        return pd.DataFrame({"stream_id": [pdf["stream_id"].iloc[0]], "out": [b"".join([*parts, machine.finish()])]})

    return chunks.groupBy("stream_id").applyInPandas(run, "stream_id string, out binary")


class Restorer(StatefulProcessor):
    """State: the unread bytes, texts kept back and tool inputs by block. A null chunk ends a stream."""

    def __init__(self, mapping: dict[str, tuple[str, list[str]]]):
        self.mapping = mapping

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getValueState("buffer", "b binary", TTL_MS)
        self.held = handle.getMapState("held", "i int", "t string", TTL_MS)
        self.inputs = handle.getMapState("inputs", "i int", "t string", TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = {
            "buffer": bytes(self.buffer.get()[0]) if self.buffer.exists() else b"",
            "held": {k[0]: v[0] for k, v in self.held.iterator()},
            "inputs": {k[0]: v[0] for k, v in self.inputs.iterator()},
        }
        machine, out, ended = StreamRestorer(_changer(self.mapping), state), [], False
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            ended = r.chunk is None
            out.append((str(key[0]), int(r.seq), machine.finish() if ended else machine.feed(bytes(r.chunk))))
        if ended:  # nothing of a finished stream stays
            self.buffer.clear()
            self.held.clear()
            self.inputs.clear()
            yield pd.DataFrame(out, columns=["stream_id", "seq", "out"])
            return
        self.buffer.update((machine.buffer,))
        for store, now in ((self.held, machine.held), (self.inputs, machine.inputs)):
            for k in [k[0] for k in store.keys()]:
                if k not in now:
                    store.removeKey((k,))
            for k, v in now.items():
                store.updateValue((k,), (v,))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "out"])

    def close(self) -> None:
        pass


def restore_stream(chunks: DataFrame, mapping: dict[str, tuple[str, list[str]]]) -> DataFrame:
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return chunks.groupBy("stream_id").transformWithStateInPandas(Restorer(mapping), StructType.fromDDL(OUT), "append", "ProcessingTime")
