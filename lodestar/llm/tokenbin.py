"""Token-ID output: flat little-endian unsigned integer files with uint64 document offsets, memory-mapped on reading.

Ids take two bytes where the vocabulary fits and four otherwise.

Rows go out in ascending doc_id (nulls first; rows of one doc_id by the hash of their text). Each range
partition writes one file of ids with its own offsets; a partition's base in the whole stream is the
prefix sum of the id counts before it, so no task needs another's data. Ids are written as they are made; a
task holds a chunk of texts and two numbers a document. Files appear by rename, so a
task that runs again after a lost executor replaces its own file with equal bytes.

Edges: a null text is the empty text, which leaves the end id alone; a very long text is a chunk of its own; repeated rows are all written;
an empty table writes no file; further input columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.pieces import Encoder, class_table, read_table
from lodestar.llm.shared import map_blob, raw_text, shared_dir, text_chunks, write_blob

#: Ids handled at once when a file is read back.
READ_IDS = 1 << 20

_WORKER: dict[str, Encoder] = {}


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _encoder(path: str, table: bytes) -> Encoder:
    """The tokenizers library, asked once for each distinct piece a worker meets."""
    if path not in _WORKER:
        t = _library(path)
        special = {a.content: i for i, a in t.get_added_tokens_decoder().items()}
        _WORKER[path] = Encoder(read_table(table), lambda pieces: [e.ids for e in t.encode_batch_fast(pieces, add_special_tokens=False)], special)
    return _WORKER[path]


def write_tokens(df: DataFrame, path: str, out: str, text: str = "text", end_id: int = 0) -> list[tuple[int, str, int, int]]:
    """Writes all texts under the folder `out`. Returns (part, file, documents, ids) of each file in stream order."""
    library = _library(path)
    table = class_table(library)
    kind = np.dtype("<u2" if max(library.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, table)
        part = TaskContext.get().partitionId()
        sizes, docs, nulls = [], [], []

        def encoded() -> Iterator[np.ndarray]:
            """The ids, a chunk of texts at a time; ids and sizes of the documents are kept for the end of the file."""
            for batch in text_chunks(batches):
                flat, off = encoder(*raw_text(batch.column("text")))
                n = batch.num_rows
                own = np.full(len(flat) + n, end_id, kind)
                own[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(off))] = flat
                sizes.append(np.diff(off) + 1)
                column = batch.column("doc_id")
                docs.append(np.asarray(column.fill_null(0), "<i8"))
                nulls.append(np.asarray(column.is_null().to_numpy(zero_copy_only=False), np.uint8))
                yield own

        ids = encoded()
        first = next(ids, None)
        if first is None:
            return
        offsets = lambda: np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
        uri = f"{out}/part-{part:06d}.tokens"
        write_blob(uri, {"ids": (kind, chain([first], ids)), "offsets": offsets, "doc_id": lambda: np.concatenate(docs), "null_id": lambda: np.concatenate(nulls)})
        size = np.concatenate(sizes)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [uri], "docs": [len(size)], "ids": [int(size.sum())]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    ordered = df.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    # One row a file comes back: the count of partitions bounds it, not the count of documents.
    return sorted((r.part, r.file, r.docs, r.ids) for r in ordered.mapInArrow(run, "part int, file string, docs long, ids long").collect())


def read_tokens(spark: SparkSession, files: list[tuple[int, str, int, int]], with_ids: bool = False) -> DataFrame:
    """Reads files of write_tokens: doc_id, start (ids before the document), n_tokens, ids_crc32, and the ids if asked."""
    base, rows = 0, []
    for part, uri, _, n in files:
        rows.append((part, uri, base))
        base += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                f = map_blob(uri)
                off, docs, nulls, ids = f["offsets"].astype(np.int64), f["doc_id"], f["null_id"], f["ids"]
                at = 0
                while at < len(docs):
                    to = max(at + 1, int(np.searchsorted(off, off[at] + READ_IDS, "right")) - 1)
                    bounds = off[at : to + 1]
                    own = ids[bounds[0] : bounds[-1]].astype("<u4")
                    crc = [zlib.crc32(own[a:b]) for a, b in zip((bounds[:-1] - bounds[0]).tolist(), (bounds[1:] - bounds[0]).tolist(), strict=True)]
                    columns = [pa.array(docs[at:to], pa.int64(), mask=nulls[at:to].astype(bool)), pa.array(first + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(own, pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                    at = to

    table = spark.createDataFrame(rows, "part int, file string, base long")
    if rows:
        table = table.repartitionByRange(len(rows), "part")
    return table.select("file", "base").mapInArrow(run, schema)


def token_files(df: DataFrame, path: str, text: str = "text", end_id: int = 0) -> DataFrame:
    """Writes to a new folder of the cluster's shared store and reads it back."""
    files = write_tokens(df, path, shared_dir(df.sparkSession, "tokens"), text, end_id)
    return read_tokens(df.sparkSession, files)
