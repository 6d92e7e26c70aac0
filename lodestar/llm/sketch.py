"""Bottom-k fingerprints of word shingles.

A fingerprint is the k smallest distinct 64-bit hashes of a text's five-word shingles (lower-cased A-Z,
ASCII white space between words) with the set's size where it is at most k. Fingerprints of parts merge into that
of the whole by keeping the k smallest of both. From two fingerprints follow the estimated resemblance
(Jaccard), the containment of one in the other and the count of distinct shingles.

Edges: a null text is the empty text, whose fingerprint is empty; a text of one to four words has one
shingle of all its words; a very long text is shingled whole; two empty fingerprints resemble each other by 1, an
empty and another by 0. Null ids come first and equal ids follow each other by text hash; rows equal in both are
neighbours in any order, which changes no column. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import raw_text, text_chunks
from lodestar.llm.words import split_words, windows

#: Hashes kept by a fingerprint; the standard error of a resemblance is about 1/(2 sqrt(k)) at most.
K = 256
SHINGLE = 5


def sketches(data: np.ndarray, offsets: np.ndarray, k: int = K) -> list[np.ndarray]:
    """The fingerprint of each text: sorted distinct hashes, k at most."""
    h, doc, _, _ = split_words(data, offsets)
    s, owner = windows(h, doc, SHINGLE)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    return [bottom(s[a:b], k) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes. Repeated small hashes may push past one partial sort, so the rest is sorted only then."""
    if len(hashes) > 4 * k:
        least = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(least) >= k:
            return least[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's k smallest hashes that both have; exact while neither set exceeds k."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = np.concatenate([a, b])
    both.sort()
    twice = np.zeros(len(both), bool)
    twice[1:] = both[1:] == both[:-1]
    union = both[~twice]
    if len(a) >= k or len(b) >= k:
        # Beyond its own largest hash a full fingerprint says nothing.
        limit = min([x[-1] for x in (a, b) if len(x) >= k])
        union = union[union <= limit][:k]
    top = union[-1]
    return float(np.count_nonzero(twice & (both <= top)) / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated count of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; an empty a is contained in anything."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct(a, k) + distinct(b, k))
    return min(1.0, shared / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s or ""), ">u8").astype(np.uint64)


def fingerprint(df: DataFrame, text: str = "text", into: str = "fingerprint", k: int = K) -> DataFrame:
    """doc_id and the hex fingerprint of each row's text, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            own = [to_text(s) for s in sketches(*raw_text(part.column("text")), k)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own, pa.string())], names=["doc_id", into])

    return df.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, {into} string")


def merge_by(df: DataFrame, keys: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint a group: each task first merges its own rows, so at most one row a task and key is shuffled, in k hashes."""
    schema = df.select(*keys, column).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*keys, column]), strict=True):
                a = from_text(row[-1])
                held[row[:-1]] = merge(held[row[:-1]], a, k) if row[:-1] in held else bottom(a, k)
        rows = [(*key, to_text(a)) for key, a in held.items()]
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows])

    part = df.select(*keys, column)
    return part.mapInArrow(run, schema).repartition(*keys).mapInArrow(run, schema)


def _range_of(place: Column, tie: Column, marks: list[int]) -> Column:
    """The range of an id among sorted bounds; a bound that stands there more than once is a frequent id, whose rows are cut in as many ranges by their text hash.

    The bounds are two constant arrays, every so many of them and all, so that the plan does not grow with their number.
    """
    if not marks:
        return F.lit(0)
    step = max(1, int(len(marks) ** 0.5))
    constant = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    ends, every = marks[step - 1 :: step], constant(marks)

    def count(below) -> Column:
        blocks = F.size(F.filter(constant(ends), below)) if ends else F.lit(0)
        return F.element_at(F.transform(F.array(blocks), lambda b: b * step + F.size(F.filter(F.slice(every, b * step + 1, step), below))), 1)

    under = count(lambda m: m < place)
    upto = count(lambda m: m <= place)
    share = tie.cast("double") / 2.0**64 + 0.5
    return F.element_at(F.transform(F.array(F.struct(under.alias("a"), upto.alias("b"))), lambda x: F.when(x["b"] - x["a"] < 2, x["b"]).otherwise(x["a"] + 1 + F.least(F.floor(share * (x["b"] - x["a"])), x["b"] - x["a"] - 1))), 1).cast("int")


def neighbours(df: DataFrame, text: str = "text", share: int = 4, k: int = K) -> DataFrame:
    """Compares each text with its edited form and with the next text, ascending doc_id (nulls first, then by text hash).

    The edited text replaces the last floor(n/share) code points by as many first ones, or all, of the next
    document; after the last comes the first. Rows are dealt by ranges of doc_id and read in order. The
    first row of a range is also sent, marked, to the range before it, so no task sees more than its range
    and one row. Only the least key of each range meets in the driver: one small row a partition.
    """
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    key = F.struct("doc_id", "tie")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Bounds from quantiles of ids only; they set the balance of the ranges, not the result.
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    marks = rows.select(F.percentile_approx(place, [i / parts for i in range(1, parts)] or [0.5], 2000)).first()[0] or []
    rows = rows.withColumn("part", _range_of(place, F.col("tie"), sorted(marks)))
    least = sorted((r.part, r.k.doc_id, r.k.tie) for r in rows.groupBy("part").agg(F.min(key).alias("k")).collect())
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not least:
        return spark.createDataFrame([], out)
    # Where each range's first row is also needed: by the range before, and the very first by the last.
    ahead = spark.createDataFrame([(p, d, t, least[i - 1][0]) for i, (p, d, t) in enumerate(least)], "part int, first long, least long, slot int")
    own = rows.select(F.col("part").alias("slot"), F.lit(0).alias("later"), "doc_id", "tie", "text")
    first = rows.join(F.broadcast(ahead), (rows.part == ahead.part) & rows.doc_id.eqNullSafe(ahead["first"]) & (rows.tie == ahead.least))
    first = first.select(ahead.slot, F.lit(1).alias("later"), rows.doc_id, rows.tie, rows.text).dropDuplicates(["slot"])
    dealt = own.unionByName(first).repartitionById(len(marks) + 1, "slot").sortWithinPartitions("later", "doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row seen: its id, text and sketch
        for batch in text_chunks(batches):
            found = sketches(*raw_text(batch.column("text")), k)
            later, ids, texts = (batch.column(c).to_pylist() for c in ("later", "doc_id", "text"))
            ready = []
            for i, t in enumerate(texts):
                if held is not None:
                    ready.append((held, t, found[i]))
                held = None if later[i] else (ids[i], t, found[i])
            if ready:
                edited = []
                for (_, t, _), after, _ in ready:
                    cut = len(t) // share
                    edited.append(t[: len(t) - cut] + after[:cut] if cut else t)
                made: list[np.ndarray] = []
                for part in text_chunks(iter([pa.RecordBatch.from_arrays([pa.array(edited, pa.large_string())], names=["text"])])):
                    made += sketches(*raw_text(part.column("text")), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([h[0] for h, _, _ in ready], pa.int64()),
                        pa.array([len(h[1]) for h, _, _ in ready], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([to_text(h[2]) for h, _, _ in ready], pa.string()),
                        pa.array([to_text(m) for m in made], pa.string()),
                        pa.array([resemblance(h[2], m, k) for (h, _, _), m in zip(ready, made, strict=True)], pa.float64()),
                        pa.array([resemblance(h[2], f, k) for h, _, f in ready], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return dealt.mapInArrow(run, out)


__all__ = ["bottom", "containment", "distinct", "fingerprint", "from_text", "merge", "merge_by", "neighbours", "resemblance", "sketches", "to_text"]
