"""Session helpers: shared folders, output columns, memory-mapped blobs and Arrow chunking.

Every Python operator here has the same edges: a null text is the empty text, null ids pass
through, and extra columns of the input are ignored because only named columns are selected.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python worker; a longer single text is handled alone.
CHUNK_BYTES = 1_000_000
#: Rows of an Arrow batch.
ROWS = 1000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder, as a URI, under the cluster's spark.checkpoint.dir; where it is unset, only a local master gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage through a table in the shared folder, so a lost executor costs a re-read only."""
    path = f"{shared_dir(df.sparkSession, name)}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_blob(uri: str, arrays: dict[str, np.ndarray | Callable[[], np.ndarray] | tuple[np.dtype, Iterator[np.ndarray]]]) -> int:
    """Writes named arrays as one flat file (64-byte aligned, directory at the end); atomic by rename.

    An array may be a type and an iterator of its parts, which are written as they come, or a function that gives it
    after those before it are written.
    """
    names, at = [], 0
    system, path = _filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(tmp) as out:
        for name, a in arrays.items():
            a = a() if callable(a) else a
            kind, parts = a if isinstance(a, tuple) else (a.dtype, [a])
            first, count = at, 0
            for part in parts:
                raw = np.ascontiguousarray(part, kind)
                out.write(memoryview(raw).cast("B") if raw.nbytes else b"")
                count, at = count + len(raw), at + raw.nbytes
            names.append(f"{name}:{np.dtype(kind).str}:{count}:{first}")
            pad = -at % 64
            out.write(b"\0" * pad)
            at += pad
        tail = ",".join(names).encode()
        out.write(tail + len(tail).to_bytes(8, "little"))
    system.move(tmp, path)
    return at


def map_blob(uri: str) -> dict[str, np.ndarray]:
    """Memory-maps a file of write_blob. A store without local paths is copied to an unlinked local file first."""
    if uri.startswith("file:"):
        path = "/" + uri[5:].lstrip("/")
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
    else:
        system, path = _filesystem(uri)
        with tempfile.TemporaryFile() as local, system.open_input_stream(path) as src:
            while block := src.read(8 << 20):
                local.write(block)
            local.flush()
            raw = np.asarray(np.memmap(local, np.uint8, "r"))
    n = int.from_bytes(raw[-8:].tobytes(), "little")
    out = {}
    for item in raw[len(raw) - 8 - n : len(raw) - 8].tobytes().decode().split(","):
        name, kind, count, at = item.rsplit(":", 3)
        dtype = np.dtype(kind)
        out[name] = raw[int(at) : int(at) + int(count) * dtype.itemsize].view(dtype)
    return out


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about `most` bytes of text; nulls in the text become empty."""
    import pyarrow.compute as pc

    for batch in batches:
        k = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(k), "").cast(pa.large_string())
        batch = batch.set_column(k, column, text)
        sizes = np.asarray(pc.binary_length(text.cast(pa.large_binary())), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Hands freed memory back to the system, as an idle worker of a finished stage would keep it from the next one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array without nulls, and its offsets from 0."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ROWS rows, so that batches of long texts stay small on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id, parts: int = 5):
    """crc32 of the id's decimal text, modulo `parts`; a null id counts as remainder 0 of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, most: int = 100_000) -> DataFrame:
    """rows joined with a table of one row a key, which says in `weight` how many rows have it, out of `total` at most.

    Keys with more than a `most`th of the total are fewer than `most` and are sent to the rows where these lie; the others are
    dealt by the key. So no task gets the rows of a frequent key.
    """
    limit = max(1000, total // most)
    heavy, light = table.filter(F.col(weight) > limit), table.filter(F.col(weight) <= limit)
    frequent = rows.join(F.broadcast(heavy), key)
    return frequent.unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))


def least_hashes(df: DataFrame, h: str, rows: int) -> DataFrame:
    """Rows of df among which the `rows` of least 64-bit hash are, about four times as many, so that tasks hold back the rest.

    A table of few distinct hashes may give fewer rows than asked, none at worst.
    """
    n = df.count()
    if n <= 4 * rows:
        return df
    return df.filter(F.col(h) < -(1 << 63) + int((1 << 64) * (4 * rows / n)))
