"""Periodic runs of words: a harmonic grid of longest-common-extension queries over suffix arrays.

A run of smallest period q is a stretch of words, q apart identical, of at least max(SHORTEST, REPEATS * q) words that no
neighbouring word extends. For each period p, positions jp and (j+1)p of the grid are compared: their forward extension
(suffix array, LCP array and range-minimum table) and their backward extension (the same over the reversed words) give the
maximal stretch of period p around them. A stretch found for several periods belongs to the least one; the others are its
multiples, as two periods of a stretch three times as long have their common divisor as a period.

A run holds two neighbouring points of its period's grid and all words between them, so pairs of points are first compared
on a few single words there. Only where all agree is the pair asked, and only texts with such pairs get their arrays: what
is left out has no run by this proof. There are n ln n pairs for n words; they are made in slices.

Everything about a text happens in the task that reads it, without a shuffle. Texts share arrays in chunks; the first rank
of a word contains its text, so no extension crosses from one text to another. Words are compared whole, not by hashes.

Edges: a null text is the empty text, without words or runs; a very long text is handled alone, in memory proportional to
n log n; repeated rows are each answered; an empty table gives no rows; a null id passes through; an input column named as
an output is replaced, further ones stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.shared import raw_text, text_chunks

SHORTEST, REPEATS = 24, 3
#: Pairs of grid points made at once.
SLICE = 1 << 20
SPACES = r"[\x20\x09-\x0D]+"

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class Extensions:
    """Longest common extensions inside texts that lie side by side: suffix array by doubling, LCP array, sparse minima."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        n = len(words)
        self.n = n
        last = np.flatnonzero(np.append(text[1:] != text[:-1], True)) + 1
        self.end = np.repeat(last, np.diff(np.concatenate([[0], last])))
        order = np.lexsort((words, text)).astype(np.int64)
        fresh = np.ones(n, bool)
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        levels, size = [rank.astype(np.int32)], 1
        while True:
            # Only suffixes that share their first `size` words with another one are sorted on.
            alone = fresh & np.append(fresh[1:], True)
            open_ = np.flatnonzero(~alone)
            if not len(open_):
                break
            at = order[open_]
            to = at + size
            follow = np.where(to < self.end[at], rank[np.minimum(to, n - 1)] + 1, 0)
            by = np.lexsort((follow, rank[at]))
            at, follow = at[by], follow[by]
            new = np.ones(len(at), bool)
            new[1:] = (rank[at][1:] != rank[at][:-1]) | (follow[1:] != follow[:-1])
            order[open_] = at
            fresh[open_] = new
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
            levels.append(rank.astype(np.int32))
            size *= 2
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.minima = self._table(self._neighbours(order, levels))

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """The LCP array: words that each suffix shares with the one sorted before it, by halving steps over equal ranks."""
        a, b = order[:-1], order[1:]
        got = np.zeros(len(b), np.int64)
        for k in reversed(range(len(levels))):
            x, y = a + got, b + got
            inside = (x < self.end[a]) & (y < self.end[b])
            rank = levels[k]
            equal = inside & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)])
            got += equal.astype(np.int64) << k
        return np.concatenate([[0], got]).astype(np.int32)

    def _table(self, lcp: np.ndarray) -> np.ndarray:
        rows = [lcp]
        step = 1
        while 2 * step <= self.n:
            row = rows[-1].copy()
            row[: self.n - step] = np.minimum(rows[-1][: self.n - step], rows[-1][step:])
            rows.append(row)
            step *= 2
        return np.concatenate(rows)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j share; i and j differ and lie in one text."""
        a, b = self.place[i], self.place[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp((high - low + 1).astype(np.float64))[1].astype(np.int64) - 1
        return np.minimum(self.minima[k * self.n + low], self.minima[k * self.n + high - (np.int64(1) << k) + 1]).astype(np.int64)


def _grid(begin: np.ndarray, size: np.ndarray, shortest: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of (position of jp, p) over all texts, such that the next two points of p's grid lie in the text as well."""
    periods = np.where(size >= shortest, size // repeats, 0)
    total = int(periods.sum())
    at = 0
    ends = np.cumsum(periods)
    while at < total:
        to = min(total, at + SLICE)
        k = np.arange(at, to)
        own = np.searchsorted(ends, k, "right")
        p = k - (ends[own] - periods[own]) + 1
        points = (size[own] - 1) // p - 1
        sums = np.cumsum(points)
        first = 0
        while first < len(k):
            before = sums[first - 1] if first else 0
            upto = max(first + 1, int(np.searchsorted(sums, before + SLICE, "right")))
            n = points[first:upto]
            step = np.repeat(p[first:upto], n)
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(begin[own[first:upto]], n) + j * step, step
            first = upto
        at = to


def _agreeing(words: np.ndarray, x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid pairs whose stretch of equal words may reach from x to the next point: some words between are compared."""
    for at in (lambda x, p: x, lambda x, p: x + p, lambda x, p: x + p // 2, lambda x, p: x + np.minimum(1, p - 1)):
        y = at(x, p)
        keep = words[y] == words[y + p]
        x, p = x[keep], p[keep]
        if not len(x):
            break
    return x, p


def find_runs(words: np.ndarray, offsets: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> np.ndarray:
    """All runs of many texts: rows (text, start in the text, length, period), by text, start and period. repeats: 3 or more."""
    begin, size = offsets[:-1], np.diff(offsets)
    asked = np.zeros(len(size), bool)
    for x, p in _grid(begin, size, shortest, repeats):
        x, _ = _agreeing(words, x, p)
        asked[np.searchsorted(offsets, np.unique(x), "right") - 1] = True
    own = np.flatnonzero(asked)
    if not len(own):
        return np.zeros((0, 4), np.int64)
    size = size[own]
    text = np.repeat(np.arange(len(own)), size)
    ends = np.cumsum(size)
    words = words[np.arange(len(text)) - np.repeat(ends - size - begin[own], size)]
    n = len(words)
    ahead, back = Extensions(words, text), Extensions(words[::-1], text[::-1])
    found = np.zeros((0, 3), np.int64)
    for x, p in _grid(ends - size, size, shortest, repeats):
        x, p = _agreeing(words, x, p)
        if not len(x):
            continue
        start = x - back.common(n - 1 - x, n - 1 - x - p) + 1
        end = x + p + ahead.common(x, x + p)
        keep = end - start >= np.maximum(shortest, repeats * p)
        # Of equal stretches the least period stays.
        found = np.concatenate([found, np.stack([start[keep], end[keep], p[keep]], 1)])
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
        found = found[new]
    start, end, p = found.T
    owner = text[start]
    out = np.stack([own[owner], start - (ends - size)[owner], end - start, p], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def runs(df: DataFrame, text: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """Adds n_words, runs (array of start, length, period, in words) and collapsed: the words joined by one space, without those that a run holds after its first period."""
    keep = [f for f in df.schema.fields if f.name not in ("n_words", "runs", "collapsed")]
    schema = T.StructType([*keep, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    if repeats < 3:
        raise ValueError("the least period of a stretch is told by its multiples from three repeats on")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(iter([whole.append_column("\0text", whole.column("\1in"))]), "\0text"):
                data, off = raw_text(batch.column("\0text"))
                raw = data.tobytes()
                parts = [raw[a:b].split() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                size = np.fromiter(map(len, parts), np.int64, len(parts))
                offsets = np.concatenate([[0], np.cumsum(size)])
                ids = pa.array([w for own in parts for w in own], pa.large_binary()).dictionary_encode().indices.to_numpy()
                found = find_runs(ids, offsets, shortest, repeats)
                texts = [b" ".join(own) for own in parts]
                bounds = np.searchsorted(found[:, 0], np.arange(len(parts) + 1))
                for k in np.unique(found[:, 0]).tolist():
                    _, start, length, period = found[bounds[k] : bounds[k + 1]].T
                    depth = np.zeros(size[k] + 1, np.int64)
                    np.add.at(depth, start + period, 1)
                    np.add.at(depth, start + length, -1)
                    own = parts[k]
                    texts[k] = b" ".join([own[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()])
                rows = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], names=RUN.names)
                out = [pa.array(size), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows), pa.array(texts, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *out], names=schema.names)

    return df.select(*(F.col(f"`{f.name}`") for f in keep), F.col(text).alias("\1in")).mapInArrow(run, schema)


def planted(df: DataFrame) -> DataFrame:
    """doc_id and text; where the id's hash ends in 0, words from some place on repeat those that stand there. A null id is hashed as the empty text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACES), lambda w: w != "")
    g = F.floor(F.col("\1h") / 10)
    n = F.size("\1w").cast("long")
    again = F.transform("\1w", lambda w, i: F.when(i < F.col("\1a"), w).otherwise(F.element_at("\1w", (F.col("\1a") + (i - F.col("\1a")) % F.col("\1p") + 1).cast("int"))))
    # Only a tenth of the texts are cut into words here.
    cut = df.select(F.col("doc_id").cast("long"), "text", h.alias("\1h")).withColumn("\1w", F.when(F.col("\1h") % 10 == 0, words))
    some = cut.withColumn("\1a", F.when(n > 0, g % n)).withColumn("\1p", 1 + F.floor((n - F.col("\1a")) / (3 + g % 8)))
    return some.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The strongest run of each text and digests of all runs and of the collapsed text."""
    stronger = lambda a, b: F.when(a["length"] * b["period"] != b["length"] * a["period"], F.signum(b["length"] * a["period"] - a["length"] * b["period"]).cast("int")).when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["period"] - b["period"]).cast("int"))
    best = F.get(F.array_sort("runs", stronger), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    made = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return made.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
