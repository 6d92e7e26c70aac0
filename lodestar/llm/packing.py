"""Best-fit packing of token sequences by a linear grouping scheme over the histogram of lengths.

Lengths are whole numbers up to the capacity, so the corpus is packed as a histogram of at most `capacity` counts, the only
thing that reaches the driver. There, items longer than an eighth of a sequence are sorted and cut into groups of equally
many; each group's lengths are rounded up to its greatest, which leaves few sizes. Configurations of such sizes are
optimised by column generation (a simplex over the groups, priced by a knapsack), rounded down, and the groups' actual items
are put into the slots: their real lengths leave more room. What rounding left over and then all small items, longest first,
go where they fit best. Three shares are tried and the plan of fewest sequences is taken: a low share pays where items of
a third to a half of a sequence have to be matched, a high one where there are enough items to fill what is left. Sequences
that are alike stand together as ranges, so the plan is a table whose size depends on the lengths and groups only, not on the
number of documents.

Spark does the rest: one pass encodes all texts, cuts them into pieces and numbers each piece among its task's pieces of
that length; counts by task and length, summed up in order of the tasks, turn these into numbers among all pieces of a
length; the plan's table gives each number its sequence and offset. Tasks are numbered by the partitions of the written
table, so a task that runs again after a lost executor writes the same rows.

Edges: a null text is the empty text, of the end id alone; a very long text is cut into many pieces, all but the first of
full length; repeated rows are each packed; an empty table gives no rows; a null id passes through; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.pieces import class_table
from lodestar.llm.shared import checkpointed, raw_text, text_chunks
from lodestar.llm.tokenbin import _encoder, _library

CAPACITY, GROUPS = 2048, 128
#: Items of at most the capacity by one of these are small.
SHARES = (8, 4, 2)
#: The simplex ends when it is proven within this share of the optimum, or after so many steps; each plan on the way is valid.
SLACK, STEPS = 2e-4, 600


def _priced(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest worth: how many of each size, by a knapsack on the number of items."""
    best, choice = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        new, took = best.copy(), np.full(capacity + 1, -1)
        for k in np.flatnonzero(worth > 0).tolist():
            s = sizes[k]
            more = best[: capacity + 1 - s] + worth[k]
            up = more > new[s:] + 1e-12
            new[s:][up] = more[up]
            took[s:][up] = k
        if (took < 0).all():
            break
        best = new
        choice.append(took)
    out, left = np.zeros(len(sizes), np.int64), capacity
    for took in reversed(choice):
        if took[left] >= 0:
            out[took[left]] += 1
            left -= sizes[took[left]]
    return float(worth @ out), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each size) and how often each is used, so that the fewest sequences meet the demand."""
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    use = inverse @ demand
    for _ in range(STEPS):
        worth, column = _priced(sizes, inverse.sum(0), capacity)
        if worth <= 1 + 1e-9 or use.sum() * (1 - 1 / worth) < SLACK * max(1.0, use.sum()):
            break  # no plan has fewer than the used sequences by the greatest worth
        change = inverse @ column
        ratio = np.where(change > 1e-9, np.maximum(use, 0) / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        use = use - ratio[out] * change
        use[out] = ratio[out]
        columns[:, out] = column
        row = inverse[out] / change[out]
        inverse = inverse - np.outer(change, row)
        inverse[out] = row
    return [(columns[:, k].astype(np.int64), float(use[k])) for k in range(n)]


class _Room:
    """Ranges of alike sequences by the room they have left, and the table of what was put where."""

    def __init__(self, capacity: int):
        self.capacity, self.made, self.rows = capacity, 0, []
        self.free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.some = np.zeros(capacity + 1, bool)

    def open(self, count: int) -> int:
        self.made += count
        return self.made - count

    def leave(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.free[room].append((first, count))
            self.some[room] = True

    def put(self, length: int, item: int, count: int) -> None:
        """Best fit of `count` items of one length: into the least room that holds one, as many as go there."""
        while count:
            room = length + int(self.some[length:].argmax())
            if not self.some[room]:
                new = -(-count // (self.capacity // length))
                self.leave(self.capacity, self.open(new), new)
                continue
            first, many = self.free[room].pop()
            each = min(room // length, count)
            use = min(many, count // each)
            self.rows.append((length, item, use * each, first, each, self.capacity - room))
            self.leave(room - each * length, first, use)
            self.leave(room, first + use, many - use)
            self.some[room] = bool(self.free[room])
            item, count = item + use * each, count - use * each


def plan(counts: np.ndarray, groups: int = GROUPS) -> tuple[int, np.ndarray]:
    """Packs counts[length] items of each length. Returns the number of sequences and a table with rows (length, first item,
    items, first sequence, items a sequence, offset): item `first + k` goes to sequence `first sequence + k // each`, at
    `offset + k % each * length`."""
    best = None
    for share in SHARES:
        found = grouped(counts, (len(counts) - 1) // share, groups)
        best = found if best is None or found[0] < best[0] else best
        if best[0] * (len(counts) - 1) < np.arange(len(counts)) @ counts + len(counts) - 1:
            break  # no packing has fewer
    return best


def grouped(counts: np.ndarray, small: int, groups: int) -> tuple[int, np.ndarray]:
    """A plan by linear grouping of the items longer than `small`."""
    capacity = len(counts) - 1
    room = _Room(capacity)
    if counts[capacity]:
        room.rows.append((capacity, 0, int(counts[capacity]), room.open(int(counts[capacity])), 1, 0))
    lengths = [n for n in range(capacity - 1, 0, -1) if counts[n]]
    large = [n for n in lengths if n > small]
    total = int(sum(counts[n] for n in large))
    groups = min(groups, total)
    cuts = [-(-total * k // groups) for k in range(1, groups + 1)] if groups else []
    sorts: list[list[list[int]]] = [[]]  # of each group: [length, first item, items], longest first
    passed = 0
    for n in large:
        item = 0
        while item < counts[n]:
            if passed == cuts[len(sorts) - 1]:
                sorts.append([])
            take = min(int(counts[n]) - item, cuts[len(sorts) - 1] - passed)
            sorts[-1].append([n, item, take])
            item, passed = item + take, passed + take
    by_size: dict[int, list[list[int]]] = {}
    for own in sorts if large else []:
        by_size.setdefault(own[0][0], []).extend(own)  # groups of one greatest length are one size
    sizes = np.array(list(by_size), np.int64)
    queues = list(by_size.values())
    if large:
        demand = np.array([sum(x[2] for x in own) for own in queues], float)
        for column, used in configurations(sizes, demand, capacity):
            many = int(used + 1e-6)
            many = min([many, *(sum(x[2] for x in queues[k]) // int(column[k]) for k in np.flatnonzero(column))])
            if not many or not column.any():
                continue
            ranges = [(room.open(many), many, 0)]
            for k in np.repeat(np.arange(len(sizes)), column).tolist():
                after = []
                for first, left, fill in ranges:
                    while left:
                        length, item, items = queues[k][0]
                        use = min(left, items)
                        room.rows.append((length, item, use, first, 1, fill))
                        after.append((first, use, fill + length))
                        first, left = first + use, left - use
                        if use == items:
                            queues[k].pop(0)
                        else:
                            queues[k][0] = [length, item + use, items - use]
                ranges = after
            for first, count, fill in ranges:
                room.leave(capacity - fill, first, count)
    for length, item, items in sorted((x for own in queues for x in own), reverse=True):
        room.put(length, item, items)
    for n in lengths:
        if n <= small:
            room.put(n, 0, int(counts[n]))
    table = np.array(room.rows, np.int64).reshape(-1, 6)
    return room.made, table[np.lexsort((table[:, 1], table[:, 0]))]


def pieces(df: DataFrame, path: str, text: str = "text", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, ids of every piece of every text; part and nth: its task and its number among that task's pieces of the length."""
    table = class_table(_library(path))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"][: 7 + with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, table)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in text_chunks(batches):
            flat, off = encoder(*raw_text(batch.column("text")))
            docs = batch.num_rows
            own = np.full(len(flat) + docs, end_id, "<u4")
            own[np.arange(len(flat)) + np.repeat(np.arange(docs), np.diff(off))] = flat
            size = np.diff(off) + 1
            begin = np.cumsum(size) - size
            cuts = -(-size // capacity)
            doc = np.repeat(np.arange(docs), cuts)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            head = (size - capacity * (cuts - 1))[doc]
            start = np.where(k == 0, 0, head + (k - 1) * capacity)
            length = np.where(k == 0, head, capacity)
            at = begin[doc] + start
            crc = [zlib.crc32(own[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            nth = np.empty(len(doc), np.int64)
            nth[order] = seen[ranked] + np.arange(len(doc)) - np.searchsorted(ranked, ranked)
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(k, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(own)), pa.int32()), pa.array(own.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, schema)


def place(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to the pieces of a written table, in place of part and nth."""
    spark = cut.sparkSession
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = checkpointed(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        histogram[r.length] = r.n
    table = spark.sparkContext.broadcast(plan(histogram, groups)[1])
    keep = [f for f in cut.schema.names if f not in ("part", "nth")]
    schema = cut.select(*keep).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, items, sequence, each, offset = table.value.T
        starts = np.searchsorted(length, np.arange(capacity + 2))
        for batch in batches:
            own, item = batch.column("length").to_numpy(), batch.column("item").to_numpy()
            row = np.zeros(len(own), np.int64)
            for n in np.unique(own).tolist():
                of = own == n
                row[of] = starts[n] + np.searchsorted(first[starts[n] : starts[n + 1]], item[of], "right") - 1
            k = item - first[row]
            found = [pa.array(sequence[row] + k // each[row]), pa.array(offset[row] + k % each[row] * own)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], names=schema.names)

    numbered = cut.join(bases.drop("n"), ["part", "length"])
    return numbered.select(*keep, (F.col("base") + F.col("nth")).alias("item")).mapInArrow(run, schema)


def pack(df: DataFrame, path: str, text: str = "text", end_id: int = 0, capacity: int = CAPACITY, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """Every piece of every text with its sequence and its offset there."""
    return place(checkpointed(pieces(df, path, text, end_id, capacity, with_ids), "pieces"), capacity, groups)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and the offsets of its pieces, from a packing with ids. A group holds at most one sequence's tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("offsets"))
