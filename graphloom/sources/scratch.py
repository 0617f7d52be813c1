"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a parquet table and reading it
back. Such a table survives the loss of executors, keeps column statistics (a
small one can still be broadcast by the optimizer) and is deleted as soon as the
operator has a newer one.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset on one machine, a
    temporary folder of this process. A cluster must name one: no folder of a single
    machine is shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="graphloom-")
    return "file://" + _own_dirs[app]


class Scratch:
    """The tables of one operator run; drop(df) deletes one that is no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def spill(self, df: DataFrame) -> DataFrame:
        out, path = spill(df, with_path=True)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        held = self.paths.pop(id(df), None)
        if held:
            drop_scratch(self.spark, held[1])


_written: list[tuple[SparkSession, str]] = []


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


_held: list[int] = []
_lock = threading.Lock()
_before: list[str] = []


@contextmanager
def _small_batches(spark: SparkSession, rows: int | None):
    """The session's batch size is the least that the writes now running ask for; the last one
    to end puts back what was set before. It changes no result, only memory."""
    if not rows:
        yield
        return

    def settle() -> None:
        own = int(_before[0])
        spark.conf.set(_BATCH, str(min([*_held, *([own] if own > 0 else [])])) if _held else _before[0])

    with _lock:
        if not _held:
            _before[:] = [spark.conf.get(_BATCH)]
        _held.append(rows)
        settle()
    try:
        yield
    finally:
        with _lock:
            _held.remove(rows)
            settle()


def spill(df: DataFrame, with_path: bool = False, batch_rows: int | None = None):
    """Write `df` to the shared folder and read it back. Empty tables keep their schema.
    batch_rows: rows that go to a Python worker at once while it is written; fewer for long
    texts, of which a worker and its executor hold several copies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    with _small_batches(spark, batch_rows):
        df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    return (out, path) if with_path else out


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch table through Hadoop's file system, wherever it lies."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        try:
            drop_scratch(spark, path)
        except Exception:  # the session may be gone
            pass
