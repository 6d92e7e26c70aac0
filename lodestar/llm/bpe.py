"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes a token sequence for each distinct piece. A sequence is the exact BPE
result when every token stands for itself and every adjacent pair is compatible, that is, encoding
the two tokens' joined bytes gives the two tokens back; a vectorised walk down both tokens' merge
trees tests all pairs of a batch at once. Only pieces with a failing pair are merged exactly.

Edges: a null text encodes as the empty text (no ids); rows repeat as they come; special strings of
the tokenizer file become their own id; a null id passes through; an empty table gives no rows; a very long
text is a chunk of its own; encode() and decode() keep further columns, digests() ignores them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.pieces import Encoder, class_table, read_table
from lodestar.llm.shared import raw_text, text_chunks


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Merges:
    """A byte-level BPE vocabulary. Tokens are numbered by rank: bytes first, then merges in order."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        vocab, pairs = model["model"]["vocab"], model["model"]["merges"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in pairs]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        names = [*letters, *(a + b for a, b in pairs)]
        rank = {c: i for i, c in enumerate(letters)}
        self.left, self.right = np.arange(len(names)), np.arange(len(names))
        self.merge: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(pairs, 256):
            i, j = rank[a], rank[b]
            rank.setdefault(a + b, k)
            self.left[k], self.right[k] = i, j
            self.merge.setdefault((i, j), k)
        self.id = np.array([vocab[n] for n in names], np.int32)
        self.bytes = [bytes(back[c] for c in n) for n in names]
        self.rank = {self.bytes[k]: k for k in reversed(range(len(names)))}
        keys = np.array([i << 32 | j for i, j in self.merge], np.uint64)
        order = np.argsort(keys)
        self._keys, self._made = keys[order], np.array(list(self.merge.values()))[order]
        self.longest: dict[bytes, int] = {}
        for b in self.bytes:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 1), len(b))
        self._known: dict[int, bool] = {}

    def made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or a number past all ranks."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._made[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the boundary between tokens a and b, by undoing merges on both sides, latest first."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.zeros(len(a), bool)
        limit = np.full(len(a), 1 << 40)
        live = np.arange(len(a))
        while len(live):
            x, y, bound = a[live], b[live], limit[live]
            keep = self.made(x, y) >= bound
            live, x, y, bound = live[keep], x[keep], y[keep], bound[keep]
            undo_x, undo_y = x >= 256, y >= 256
            done = ~undo_x & ~undo_y
            # The later of the two merges is undone; of equal ones, the right one, as merging goes from the left.
            go_x = undo_x & (~undo_y | (x > y))
            go_y = undo_y & ~go_x
            ok[live[done]] = True
            limit[live] = np.where(go_x, np.minimum(bound, x), np.where(go_y, np.minimum(bound, y + 1), bound))
            a[live] = np.where(go_x, self.right[x], x)
            b[live] = np.where(go_y, self.left[y], y)
            live = live[~done]
        return ok

    def propose(self, raw: bytes) -> list[int]:
        out, at, n, rank, longest = [], 0, len(raw), self.rank, self.longest
        while at < n:
            to = min(n, at + longest.get(raw[at : at + 2], 1))
            while to > at + 1 and raw[at:to] not in rank:
                to -= 1
            out.append(rank[raw[at:to]])
            at = to
        return out

    def exact(self, raw: bytes) -> list[int]:
        """Merges of lowest rank, leftmost first, over a linked list and a heap: n log n for any length."""
        n = len(raw)
        tok, prev, after = list(raw), list(range(-1, n - 1)), list(range(1, n + 1))
        merge = self.merge
        tok = [self.rank[bytes([b])] for b in tok]
        heap = [(m, i, tok[i], tok[i + 1]) for i in range(n - 1) if (m := merge.get((tok[i], tok[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, x, y = heapq.heappop(heap)
            j = after[i]
            if tok[i] != x or j >= n or tok[j] != y:
                continue
            tok[i], tok[j] = m, -1
            after[i] = k = after[j]
            if k < n:
                prev[k] = i
                if (r := merge.get((m, tok[k]))) is not None:
                    heapq.heappush(heap, (r, i, m, tok[k]))
            p = prev[i]
            if p >= 0 and (r := merge.get((tok[p], m))) is not None:
                heapq.heappush(heap, (r, p, tok[p], m))
        return [t for t in tok if t >= 0]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of distinct pieces: proposals, one vectorised test of all their pairs, exact merging of the failing."""
        raws = [p.encode() for p in pieces]
        out = [self.propose(r) for r in raws]
        size = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for x in out for t in x), np.int64, int(size.sum()))
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(out)), size)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            key = flat[inner] << 32 | flat[inner + 1]
            pair, back = np.unique(key, return_inverse=True)
            bad = ~self.compatible(pair >> 32, pair & 0xFFFFFFFF)[back]
            for k in np.unique(owner[inner[bad]]).tolist():
                out[k] = self.exact(raws[k])
        ids = self.id
        return [ids[x].tolist() for x in out]


_WORKER: dict[str, object] = {}


def _encoder(path: str, table: bytes) -> tuple[Encoder, list[str], list[bytes]]:
    """One encoder, with its memo, for all tasks of a worker."""
    if path not in _WORKER:
        m = Merges(path)
        count = max([*m.id.tolist(), *m.special.values()]) + 1
        raw = [b""] * count
        for k, i in enumerate(m.id.tolist()):
            raw[i] = m.bytes[k]
        for s, i in m.special.items():
            raw[i] = s.encode()
        _WORKER[path] = Encoder(read_table(table), m.encode, m.special), [str(i) for i in range(count)], raw
    return _WORKER[path]  # type: ignore[return-value]


def _table(path: str) -> bytes:
    from tokenizers import Tokenizer

    return class_table(Tokenizer.from_file(path))


def _others(df: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.col(text).alias("text")), keep


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the token ids of each text as an array<int> column; all columns stay. An existing column `into` is replaced."""
    table = _table(path)
    df = df.drop(into) if into in df.columns and into != text else df
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _, _ = _encoder(path, table)
        for batch in batches:
            for part in text_chunks(iter([batch.append_column("\0text", batch.column(text))]), "\0text"):
                flat, off = encoder(*raw_text(part.column("\0text")))
                ids = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), ids], names=names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids; bytes that are not UTF-8 become U+FFFD. Null ids decode to the empty text."""
    table = _table(path)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, raw = _encoder(path, table)
        for batch in batches:
            texts = [b"".join([raw[i] for i in x or ()]).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, in one pass that keeps ids inside the worker."""
    table = _table(path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names, raw = _encoder(path, table)
        for part in text_chunks(batches):
            flat, off = encoder(*raw_text(part.column("text")))
            ids, back = [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                own = flat[a:b].tolist()
                ids.append(hashlib.sha256(",".join([names[i] for i in own]).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([raw[i] for i in own]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, schema)
