"""Bootstrap resamples of a fixed size: draws of n pages out of n, and sums of weighted rows over all resamples at once.

A draw is a number of a counter-based generator, so any task makes any draw again. Draws are dealt in two levels: every draw of
a resample picks a page number, of which only its block of BLOCK pages counts, which leaves one count a block and resample;
inside a block, as many second draws pick the pages. So each resample has exactly n draws, and no draw is shuffled.

A page's draws move as bits: for each resample as many ones as it draws the page, and a zero. As a page is drawn once on
average, that is two bits a resample, a quarter of a byte each and less than a byte compresses to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.tables import shared_table
from lodestar.operators.windows import ordered_ranks

#: Pages of a block.
BLOCK = 1024
#: Modulus, multipliers and salts of the generator.
PRIME, BY_SAMPLE, BY_DRAW, BY_SALT, MIX = 2147483647, 73856093, 19349663, 83492791, 73244475
COARSE, FINE = 1, 3
#: Second draws of a block are numbered from block * APART on.
APART = 1 << 16
#: Draws of a resample that a task counts by block before it sends the counts, and how many of them are made at once.
STRETCH, STEP = 1 << 24, 1 << 14
#: Rows that are summed at once.
STRIP = 512
#: Keys whose partial sums are joined at once.
KEYS = 64


def _rest(x, by: int):
    """x % by, by a division, which numpy does for many numbers at once where it does not for the remainder."""
    return x - x // by * by


def _rest_of_prime(x: np.ndarray) -> np.ndarray:
    """x % PRIME of numbers below 2**62: as PRIME is a power of two less one, digits of that base are added, without a division."""
    for _ in range(2):
        x = (x & PRIME) + (x >> 31)
    x[x == PRIME] = 0
    return x


def _mixed(sample, draw: np.ndarray, salt: int) -> np.ndarray:
    x = _rest_of_prime(sample * BY_SAMPLE + draw * BY_DRAW + salt * BY_SALT)
    for _ in range(2):
        x = _rest_of_prime((x ^ (x >> 16)) * MIX)
    return x ^ (x >> 16)


def digit(sample: np.ndarray, draw: np.ndarray, salt: int, below: int) -> np.ndarray:
    """62 even bits of (sample, draw, salt), as a number below the given one; made for STEP draws at once, which stay near the core."""
    out = np.empty(len(draw), np.int64)
    for k in range(0, len(draw), STEP):
        i, d = sample[k : k + STEP] if np.ndim(sample) else sample, draw[k : k + STEP]
        out[k : k + STEP] = _rest(_mixed(i, d, salt) * (PRIME + 1) + _mixed(i, d, salt + 1), below)
    return out


def digit_sql(sample: str, draw: str, salt: int) -> str:
    """The same number in SQL."""

    def mixed(s: int) -> str:
        x = f"(({sample})::bigint * {BY_SAMPLE} + ({draw})::bigint * {BY_DRAW} + {s * BY_SALT}) % {PRIME}"
        for _ in range(2):
            x = f"list_transform([{x}], lambda x: xor(x, x >> 16) * {MIX} % {PRIME})[1]"
        return f"list_transform([{x}], lambda x: xor(x, x >> 16))[1]"

    return f"({mixed(salt)} * {PRIME + 1} + {mixed(salt + 1)})"


def packed(counts: np.ndarray) -> list[bytes]:
    """Rows of counts as bits: each count as so many ones and a zero; a row's last byte is filled with ones, so it has a zero for each count."""
    if not counts.size:
        return [b""] * len(counts)
    zero = np.cumsum(counts, 1, dtype=np.int64) + np.arange(counts.shape[1])
    size = (zero[:, -1] + 8) // 8
    start = np.cumsum(size) - size
    bits = np.ones(8 * int(size.sum()), np.uint8)
    bits[zero + 8 * start[:, None]] = 0
    raw = np.packbits(bits).tobytes()
    return [raw[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def counts_of(rows: list[bytes], samples: int) -> np.ndarray:
    """The counts of packed() rows: the gaps between their zeros."""
    size = np.array([len(r) for r in rows], np.int64)
    zero = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(rows), np.uint8)) == 0).reshape(len(rows), samples)
    return np.diff(zero, axis=1, prepend=8 * (np.cumsum(size) - size)[:, None] - 1) - 1


def draws(pages: DataFrame, samples: int) -> DataFrame:
    """pages: one distinct column. Adds `draws`: a byte for each resample, how often it draws the page; a resample has as many draws as there are pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = counts_of(batch.column("draws").to_pylist(), samples)
            if counts.max(initial=0) > 255:
                raise OverflowError("a page is drawn more than 255 times")
            yield batch.set_column(1, "draws", pa.array([r.tobytes() for r in counts.astype(np.uint8)], pa.binary()))

    made = packed_draws(pages, samples)
    return made.mapInArrow(run, made.schema).hint("merge")


def packed_draws(pages: DataFrame, samples: int) -> DataFrame:
    """The same with the draws of a page as packed() bits."""
    spark, name = pages.sparkSession, pages.columns[0]
    numbered = shared_table(ordered_ranks(pages, [], [F.asc(name)], "\1no"), "numbered").select(name, (F.col("\1no") - 1).cast("long").alias("\1no"))
    n = numbered.count()
    stretches, blocks = -(-n // STRETCH), -(-n // BLOCK)

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                i, first = at // stretches, at % stretches * STRETCH
                out = np.zeros(blocks, np.int64)
                for k in range(first, min(n, first + STRETCH), 16 * STEP):
                    got = digit(np.int64(i + 1), np.arange(k, min(n, first + STRETCH, k + 16 * STEP)), COARSE, n)
                    out += np.bincount(got // BLOCK, minlength=blocks)
                own = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), i)), pa.array(out[own])], names=["block", "i", "n"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = spark.range(0, samples * stretches, 1, max(1, min(samples * stretches, parts)))
    each = each.mapInArrow(coarse, "block long, i long, n long").groupBy("block", "i").agg(F.sum("n").alias("n"))
    counts = each.groupBy("block").agg(F.collect_list(F.struct("i", "n")).alias("counts"))  # one entry a resample
    # A block's pages, at most BLOCK, meet its counts before the draws are made, so the draws themselves do not move for it.
    laid = numbered.groupBy(F.floor(F.col("\1no") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("\1no", name))).alias("\1pages"))
    # Blocks are few bytes and long work: they are dealt to a fixed number of tasks, which the engine does not join.
    both = laid.join(counts, "block").select("block", F.col(f"\1pages.{name}").alias("pages"), "counts").repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, pages_, own in zip(batch.column("block").to_pylist(), batch.column("pages"), batch.column("counts"), strict=True):
                size = len(pages_.values)
                i, many = (own.values.field(c).to_numpy() for c in ("i", "n"))
                sample = np.repeat(i, many)
                place = np.arange(len(sample)) - np.repeat(np.cumsum(many) - many, many)
                got = digit(sample + 1, b * APART + place, FINE, size)
                values = packed(np.bincount(got * samples + sample, minlength=size * samples).reshape(size, samples))
                yield pa.RecordBatch.from_arrays([pages_.values, pa.array(values, pa.binary())], names=[name, "draws"])

    # Their size shows only once they are made, so they are never sent whole.
    return both.mapInArrow(run, f"`{name}` {dict(pages.dtypes)[name]}, draws binary").hint("merge")


def draws_sql(pages: str, samples: int) -> str:
    """CTEs that end in drawn(page_id, i, n), from a select of distinct page_id."""
    return f"""pg as materialized (select page_id, row_number() over (order by page_id) - 1 as no, count(*) over () as pages from ({pages})),
coarse as materialized (select i, ({digit_sql("i", "k", COARSE)} % pages) // {BLOCK} as block, pages, count(*) as c from (select unnest(range(1, {samples} + 1)) as i), (select pages, unnest(range(pages)) as k from (select any_value(pages) as pages from pg)) group by 1, 2, 3),
fine as (select i, block * {BLOCK} + {digit_sql("i", f"block * {APART} + j", FINE)} % least({BLOCK}, pages - block * {BLOCK}) as no from (select *, unnest(range(c)) as j from coarse)),
drawn as materialized (select page_id, i, count(*) as n from fine join pg using (no) group by 1, 2)"""


class Run:
    """Sums over a stretch of sorted rows of one key: products with the draws, bounds of a number, and which parts each resample holds.

    Parts that may go on beyond the stretch, its first and last one, are kept with the resamples that hold them; those between are counted.
    """

    def __init__(self, sums, low, high, inner, first, last):
        self.sums, self.low, self.high, self.inner, self.first, self.last = sums, low, high, inner, first, last

    def then(self, other: Run) -> Run:
        """This stretch and the one that follows it."""
        ends = [x for x in (self.first, self.last, other.first, other.last) if x is not None]
        merged = []
        for part, held in ends:
            if merged and merged[-1][0] == part:
                merged[-1] = (part, merged[-1][1] | held)
            else:
                merged.append((part, held))
        inner = self.inner + other.inner + sum((held.astype(np.int64) for _, held in merged[1:-1]), np.zeros_like(self.inner))
        return Run(self.sums + other.sums, np.minimum(self.low, other.low), np.maximum(self.high, other.high), inner, merged[0], merged[-1] if len(merged) > 1 else None)

    def parts(self) -> np.ndarray:
        """How many parts each resample holds; a null part is none."""
        return self.inner + sum(x[1].astype(np.int64) for x in (self.first, self.last) if x is not None and x[0] is not None)


_PARTIAL = "stretch int, sums binary, low binary, high binary, inner binary, first string, first_held binary, last string, last_held binary"
#: Bounds where a resample holds no number.
NONE = np.iinfo(np.int32).max


def _runs(batch: pa.RecordBatch, key: str, part: str, number: str, features: list[str], samples: int, bits: bool) -> Iterator[tuple[object, Run]]:
    """The stretches of equal keys of a sorted batch."""
    raw = batch.column("draws").to_pylist()
    drawn = counts_of(raw, samples) if bits else np.frombuffer(b"".join(raw), np.uint8).reshape(-1, samples)
    x = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
    keys, parts = batch.column(key).to_pylist(), batch.column(part).to_pylist()
    there = batch.column(number).is_valid().to_numpy(zero_copy_only=False)
    value = batch.column(number).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
    held = drawn > 0
    known = held & there[:, None]
    low, high = (np.where(known, value[:, None], np.int32(none)) for none in (NONE, -NONE))
    new = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
    for a, b in zip(new, [*new[1:], len(keys)], strict=True):
        cuts = [a, *(k for k in range(a + 1, b) if parts[k] != parts[k - 1])]
        have = np.logical_or.reduceat(held[a:b], np.array(cuts) - a)
        counted = np.array([parts[k] is not None for k in cuts])[1:-1, None]
        inner = (have[1:-1] & counted).sum(0)
        yield keys[a], Run(x[:, a:b] @ drawn[a:b].astype(float), low[a:b].min(0), high[a:b].max(0), inner, (parts[a], have[0]), (parts[b - 1], have[-1]) if len(cuts) > 1 else None)


def summed(rows: DataFrame, key: str, part: str, number: str, features: list[str] | dict[str, str], samples: int, bits: bool = False) -> DataFrame:
    """(i, key, each feature's sum weighted by the draws, parts, low, high) of each resample that draws a row of the key.

    rows has `draws`, as bytes or as packed() bits, a long key, a string part, a whole number and features, or columns of
    which the given texts make the features after the rows have moved. They are sorted into ranges whose splitters are
    sampled, so a frequent key spans many tasks; each task sends on one row of vectors a key, and a key's rows, at most as
    many as there are tasks, are joined in order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("\1tie", F.xxhash64("draws")).repartitionByRange(parts, key, part, "\1tie").sortWithinPartitions(key, part).drop("\1tie")
    if isinstance(features, dict):
        ordered, features = ordered.select(key, part, number, "draws", *(F.expr(v).cast("double").alias(k) for k, v in features.items())), list(features)
    count = len(features)

    def row(at: object, stretch: int, r: Run) -> pa.RecordBatch:
        edge = lambda e: (None, None) if e is None else (e[0], np.packbits(e[1]).tobytes())
        values = [at, stretch, r.sums.tobytes(), r.low.astype("<i4").tobytes(), r.high.astype("<i4").tobytes(), r.inner.astype("<i8").tobytes(), *edge(r.first), *edge(r.last)]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.string(), pa.binary(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[key, *(c.split()[0] for c in _PARTIAL.split(", "))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, at, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            strips = (batch.slice(k, STRIP) for k in range(0, batch.num_rows, STRIP))
            for k, r in (run for strip in strips for run in _runs(strip, key, part, number, features, samples, bits)):
                if held is not None and k == at:
                    held = held.then(r)
                    continue
                if held is not None:
                    yield row(at, stretch, held)
                at, held = k, r
        if held is not None:
            yield row(at, stretch, held)

    marks = lambda x: np.unpackbits(np.frombuffer(x, np.uint8), count=samples).astype(bool)

    def whole(table: pa.Table) -> pa.Table:
        runs: dict[object, Run] = {}
        for r in sorted(table.to_pylist(), key=lambda r: r["stretch"]):
            own = Run(np.frombuffer(r["sums"], float).reshape(count, samples), *(np.frombuffer(r[c], "<i4") for c in ("low", "high")), np.frombuffer(r["inner"], "<i8"), (r["first"], marks(r["first_held"])), (r["last"], marks(r["last_held"])) if r["last_held"] else None)
            runs[r[key]] = runs[r[key]].then(own) if r[key] in runs else own
        drawn = [np.flatnonzero((h.first[1] | (h.last[1] if h.last else False)) | (h.inner > 0)) for h in runs.values()]
        joined = lambda pick: np.concatenate([pick(h)[d] for h, d in zip(runs.values(), drawn, strict=True)])
        bound = lambda v: pa.array(v, mask=np.abs(v) == NONE)
        columns = [pa.array(np.concatenate(drawn) + 1), pa.array(np.repeat(np.array(list(runs), np.int64), [len(d) for d in drawn])), *(pa.array(joined(lambda h, k=k: h.sums[k])) for k in range(count)), pa.array(joined(Run.parts)), *(bound(joined(lambda h, c=c: getattr(h, c).astype(np.int64))) for c in ("low", "high"))]
        return pa.Table.from_arrays(columns, names=["i", key, *features, "parts", "low", "high"])

    sent = ordered.mapInArrow(partial, f"{key} long, {_PARTIAL}")
    # A group has few keys, and a row a key and, for keys that span tasks, a row more a task.
    return sent.groupBy(F.floor(F.col(key) / KEYS)).applyInArrow(whole, f"i long, {key} long, {', '.join(f'{f} double' for f in features)}, parts long, low long, high long")


def percentiles(rows: DataFrame, keys: list[str], values: dict[str, list[float]], top: tuple[str, int]) -> DataFrame:
    """(keys, a column `value_k` for each value's k-th share, n, top): interpolated percentiles of each key's rows, at most as many as there
    are resamples, and how many have at most top[1] in the column top[0]. keys are a long and then strings.

    The rows of the first key lie together in a task, sorted; each task goes through them a stretch at a time.
    """
    names = [f"{v}_{k}" for v, shares in values.items() for k in range(len(shares))]

    def done(table: pa.Table) -> pa.RecordBatch:
        codes = [table.column(keys[0]).to_numpy(), *(table.column(k).combine_chunks().dictionary_encode().indices.to_numpy() for k in keys[1:])]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
        first = np.flatnonzero(new)
        size, group = np.diff(first, append=table.num_rows), np.cumsum(new) - 1
        out = [table.column(k).take(pa.array(first)).combine_chunks() for k in keys]
        for v, shares in values.items():
            x = table.column(v).to_numpy().astype(float)
            x = x[np.lexsort((x, group))]
            for share in shares:
                at = (size - 1) * share
                low, high = np.floor(at), np.ceil(at)
                a, b = x[first + low.astype(np.int64)], x[first + high.astype(np.int64)]
                out.append(pa.array(np.where((low == high) | (a == b), a, (high - at) * a + (at - low) * b)))
        return pa.RecordBatch.from_arrays([*out, pa.array(size), pa.array(np.add.reduceat((table.column(top[0]).to_numpy() <= top[1]).astype(np.int64), first))], names=[*keys, *names, "n", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = held.column(keys[0]).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield done(held)

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{n} double" for n in names), "n long", "top long"])
    return rows.select(*keys, *values).repartition(keys[0]).sortWithinPartitions(*keys).mapInArrow(run, schema)
