"""Detection as an operator: documents in, findings out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkveil.kernel.hits import Entity, Hit
from larkveil.kernel.pipeline import Detector
from larkveil.plans.catalog import Settings

PART = "struct<start:int,end:int,cls:string,conf:double>"
FINDINGS = f"array<struct<start:int,end:int,cls:string,stage:string,conf:double,entity:string,attrs:map<string,string>,parts:array<{PART}>>>"
ENTITIES = "array<struct<id:string,cls:string,norm:string,spans:array<struct<start:int,end:int>>,attrs:map<string,string>>>"

_DETECTORS: dict[str, Detector] = {}


def detector(settings: Settings) -> Detector:
    """The detector of these settings, once for each Python worker."""
    mark = settings.fingerprint()
    if mark not in _DETECTORS:
        _DETECTORS[mark] = Detector(settings)
    return _DETECTORS[mark]


#: Inputs that are estimated to have fewer bytes for each core than this are dealt to all cores.
SMALL_SHARE = 16 << 20


def spread(docs: DataFrame) -> DataFrame:
    """A small input over all cores: its few files or row groups would keep few of them busy. Large scans stay as they are, without a shuffle."""
    plan = getattr(docs, "_jdf", None)  # none on Spark Connect
    if plan is None:
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * SMALL_SHARE else docs


def hit_row(h: Hit) -> dict:
    parts = [{"start": p.start, "end": p.end, "cls": p.cls, "conf": p.conf} for p in h.parts]
    return {"start": h.start, "end": h.end, "cls": h.cls, "stage": h.stage, "conf": h.conf, "entity": h.entity, "attrs": list(h.attrs.items()), "parts": parts}


def entity_row(e: Entity) -> dict:
    return {"id": e.id, "cls": e.cls, "norm": e.norm, "spans": [{"start": s, "end": t} for s, t in e.spans], "attrs": list(e.attrs.items())}


def arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T._parse_datatype_string(ddl))


def detect(docs: DataFrame, settings: Settings | None = None, text: str = "text", extra: Sequence[Callable[[str, list[Hit]], list[Hit]]] = ()) -> DataFrame:
    """``docs`` with findings, entities and by_stage (how many each stage found); null text has none.

    ``extra``: stages of one's own after all others: from a text and what was found so far to what is new.
    """
    settings = settings or Settings()
    types = {"findings": FINDINGS, "entities": ENTITIES, "by_stage": "map<string,int>"}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in types.items())])

    kinds = {n: arrow_type(t) for n, t in types.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Detector(settings, extra) if extra else detector(settings)
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.slice(at, 500)
                found, entities, stages = [], [], []
                for x in b.column(b.schema.get_field_index(text)):
                    r = machine.detect(x.as_py() or "")
                    found.append([hit_row(h) for h in r.hits])
                    entities.append([entity_row(e) for e in r.entities.values()])
                    stages.append(list(r.by_stage.items()))
                new = [pa.array(v, kinds[n]) for n, v in (("findings", found), ("entities", entities), ("by_stage", stages))]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *types])

    return spread(docs).mapInArrow(run, schema)


def findings(detected: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a finding, with its place in the text's order."""
    return detected.select(key, F.posexplode("findings").alias("seq", "f")).select(key, "seq", "f.*")


def counts_by_class(found: DataFrame) -> DataFrame:
    return found.groupBy("cls").agg(F.count("*").alias("n"))


def counts_by_stage(detected: DataFrame) -> DataFrame:
    return detected.select(F.explode("by_stage").alias("stage", "n")).groupBy("stage").agg(F.sum("n").alias("n"))


def with_policy(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Findings with category, policy, priority and label; a class that isn't in the table is to be tokenized."""
    joined = found.join(F.broadcast(classes), found["cls"] == classes["name"], "left").drop("name")
    return joined.withColumn("policy", F.coalesce("policy", F.lit("tokenize")))


def classes_table(spark, settings: Settings | None = None) -> DataFrame:
    """The catalogue as a dimension: some hundred rows."""
    rows = [(c.name, c.category, c.policy, c.priority, c.label, c.enabled) for c in (settings or Settings()).classes.values()]
    return spark.createDataFrame(rows, "name string, category string, policy string, priority int, label string, enabled boolean")
