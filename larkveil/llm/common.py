"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkveil.plans import shipping

#: Rows in an Arrow batch: texts can be long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1_000

#: Tables that ``cut`` has written in this process.
_WRITTEN: list[str] = []


def ship(spark: SparkSession) -> None:
    """The package on the executors, and batches of texts of a moderate size unless the session sets its own."""
    shipping.ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A kernel that hands freed memory back at the end of its task: Python workers live on for later tasks."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return leaner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) a fresh folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir isn't set: it has to name a folder that driver and executors share")
    fresh = tempfile.mkdtemp(prefix="larkveil-shared-")
    atexit.register(shutil.rmtree, fresh, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{fresh}")
    return f"file://{fresh}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and what was
    computed once (random order, Python results) stays the same for every later reader.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkveil-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larkveil_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    _WRITTEN.remove(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` has written and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_larkveil_path", None)
        if path in _WRITTEN:
            _delete(df.sparkSession, path)


def written() -> int:
    """How many tables ``cut`` has written that are still there."""
    return len(_WRITTEN)


def release(spark: SparkSession, *but: DataFrame, since: int = 0) -> None:
    """Delete what ``cut`` has written in this process, or written since a number of tables, but for some of them.

    Results that weren't written yet can't be read after it.
    """
    kept = {getattr(df, "_larkveil_path", None) for df in but}
    for path in [p for p in _WRITTEN[since:] if p not in kept]:
        _delete(spark, path)


def fresh_name(taken: Iterable[str], stem: str) -> str:
    """A column name that doesn't clash (Spark compares names without case)."""
    low = {c.lower() for c in taken}
    name = f"__{stem}"
    while name.lower() in low:
        name += "_"
    return name
