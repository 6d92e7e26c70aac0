"""Tables written once and read again: the shared folder, lineage cut through it, tables kept by what they are made from, and their release."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process by application, to be released.
_MADE: dict[str, list[str]] = {}
#: Those that are kept.
_KEPT: set[str] = set()
#: Whether an execution's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _base(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local master may use a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    path = f"{_base(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _written(df: DataFrame, path: str) -> None:
    """Writes the rows. What was shuffled for them goes at once, as the table stands for it."""
    conf = df.sparkSession.conf
    was = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, was)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes the shared tables that were written inside; kept ones stay. For steps whose result is written before the end."""
    before = set(_MADE.get(spark.sparkContext.applicationId, []))
    yield
    own = _MADE.get(spark.sparkContext.applicationId, [])
    for path in [p for p in own if p not in before and p not in _KEPT]:
        store, at = _store(spark, path)
        store.delete(at, True)
        own.remove(path)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder, so that what follows neither repeats nor loses their making."""
    path = shared_folder(df.sparkSession, name)
    _written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    """Spark's own view of a store, and the path in it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def kept_table(spark: SparkSession, name: str, sources: list[str], settings: object, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of this name, sources and settings: read where it has been written whole, else made and written.

    Its key holds each source file's path, size and time of change, so changed sources make another table; `settings` are
    what else the rows depend on. A run that dies while writing leaves no mark of success and is made again; of two runs
    that write at once the later one to end finds the table there and reads it. Tables that were shared for its making alone
    are deleted when it is written.
    """
    files = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(s).select("path", "length", "modificationTime") for s in sources]
    listed = sorted(str(tuple(r)) for f in files for r in f.collect())  # a row a file of the sources
    key = hashlib.sha256(repr((name, settings, listed)).encode()).hexdigest()[:32]
    path = f"{_base(spark)}/{name}-{key}"
    store, at = _store(spark, path)
    _, mark = _store(spark, f"{path}/_SUCCESS")
    if not store.exists(mark):
        made = f"{path}.{uuid.uuid4().hex}"
        with passing(spark):
            _written(make(), made)
        store, draft = _store(spark, made)
        if store.exists(mark):
            store.delete(draft, True)
        else:
            store.delete(at, True)
            store.rename(draft, at)
    own = _MADE.setdefault(spark.sparkContext.applicationId, [])
    if path not in own:
        own.append(path)
    _KEPT.add(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that this process has written or kept for this application; frames that read them are of no use then. Returns how many."""
    gone = 0
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        store, at = _store(spark, path)
        gone += bool(store.delete(at, True))
    return gone
