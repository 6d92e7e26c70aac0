"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins the vector of its hash with the sum of the vectors of its hashed character 3- to
5-grams, so spellings and word stems that training never saw still speak. The network reads a window of
words both ways; attention weighs its states into one vector, and a logistic unit scores it. Every
window of WINDOW words, each STRIDE words, is scored, and the highest scores the text.

Training: a bounded sample of labelled rows (SAMPLE_ROWS at most, texts up to SAMPLE_CHARS characters,
chosen by a hash of the id), Adam on the logistic loss of each text's highest window. Whole epochs run until
the loss over held-back rows of the sample no longer falls; the running mean of the parameters is kept.

Edges: a null or empty text is one window without words, scored from the bias; a very long text is scored in
all its windows; a null id is scored like any other and has no label; without labelled rows of both kinds all
texts score the smoothed share of positives; an empty table gives no rows; repeated rows score alike; labels
repeated for an id count once, the higher; texts of a repeated id count once in training; further columns of
documents stay (toxic_score is replaced), those of labels are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.shared import fold, least_hashes, raw_text, text_chunks
from lodestar.llm.words import _BYTE, _LOWER, span_hashes, split_words

WINDOW, STRIDE = 48, 32
WORD_BUCKETS, GRAM_BUCKETS, WORD_SIZE, GRAM_SIZE = 1 << 15, 1 << 15, 6, 10
HIDDEN, ATTENTION = 12, 8
#: Bounds of the labelled sample: rows, and characters of a text in it.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 1500
DROP_WORDS, DROP_GRAMS, LEAST_TEXTS = 0.5, 0.25, 3
#: Training, alike at every size of the sample: rows of a batch, most epochs, share of rows held back, epochs without
#: a better loss over them before it ends, rate, share of the running mean that a step keeps.
BATCH, EPOCHS, HELD, PATIENCE, RATE, MEAN, SEED = 24, 20, 0.125, 3, 0.006, 0.95, 7
#: Windows that run through the network together.
ROWS = 2048


class Words:
    """Distinct words of some texts as inputs: hash buckets of words and of their character grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        h, self.doc, s, e = split_words(data, offsets)
        fresh, one, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.n = len(fresh)
        self.bucket = (fresh >> np.uint64(7)).astype(np.int64) % WORD_BUCKETS
        s, size = s[one], (e - s)[one]
        starts, ends, owner = [], [], []
        for k in (3, 4, 5):
            # A word shorter than three bytes is its own gram.
            count = np.maximum(size - k + 1, 0) if k > 3 else np.maximum(size - k + 1, 1)
            own = np.repeat(np.arange(self.n), count)
            at = s[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            starts.append(at)
            ends.append(np.minimum(at + k, s[own] + size[own]))
            owner.append(own)
        own = np.concatenate(owner)
        order = np.argsort(own, kind="stable")
        self.owner = own[order]
        gram = span_hashes(_BYTE[_LOWER[data]], np.concatenate(starts)[order], np.concatenate(ends)[order])
        self.gram = (gram >> np.uint64(7)).astype(np.int64) % GRAM_BUCKETS
        self.first = np.searchsorted(self.owner, np.arange(self.n))
        self.scale = 1 / np.sqrt(np.maximum(np.bincount(self.owner, minlength=self.n), 1)).astype(np.float32)
        self.word_gain, self.gram_gain = np.ones(self.n, np.float32), np.ones(len(self.gram), np.float32)

    def drop(self, rng: np.random.Generator, often: tuple[np.ndarray, np.ndarray]) -> None:
        """Leaves out vectors of words and grams that few texts have, and others at random, so that training leans on what texts share."""
        self.word_gain = ((rng.random(self.n) >= DROP_WORDS) & often[0][self.bucket]).astype(np.float32) / (1 - DROP_WORDS)
        self.gram_gain = ((rng.random(len(self.gram)) >= DROP_GRAMS) & often[1][self.gram]).astype(np.float32) / (1 - DROP_GRAMS)

    def inputs(self, p: dict[str, np.ndarray]) -> np.ndarray:
        """One row a distinct word, and a last row of zeros for padding."""
        out = np.zeros((self.n + 1, WORD_SIZE + GRAM_SIZE), np.float32)
        if self.n:
            out[:-1, :WORD_SIZE] = p["words"][self.bucket] * self.word_gain[:, None]
            out[:-1, WORD_SIZE:] = np.add.reduceat(p["grams"][self.gram] * self.gram_gain[:, None], self.first, axis=0) * self.scale[:, None]
        return out


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d = WORD_SIZE + GRAM_SIZE
    # Words and grams that training never meets stay zero and say nothing.
    p = {"words": np.zeros((WORD_BUCKETS, WORD_SIZE)), "grams": np.zeros((GRAM_BUCKETS, GRAM_SIZE))}
    for way in "fb":
        p[f"in_{way}"] = rng.normal(0, d**-0.5, (d, 3 * HIDDEN))
        p[f"bias_{way}"] = np.zeros(3 * HIDDEN)
        p[f"state_{way}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
    p |= {"look": rng.normal(0, 0.3, (2 * HIDDEN, ATTENTION)), "look_bias": np.zeros(ATTENTION), "pick": rng.normal(0, 0.3, ATTENTION), "out": rng.normal(0, 0.3, 2 * HIDDEN), "out_bias": np.full(1, -2.0)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _read(side: np.ndarray, state: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction: side holds each distinct word's part of the gates, index (steps, rows) the words."""
    steps, rows = index.shape
    n = HIDDEN
    h = np.zeros((rows, n), np.float32)
    out = np.empty((steps, rows, n), np.float32)
    for t in range(steps):
        a = np.take(side, index[t], 0)
        g = h @ state
        zr = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        new = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
        before = h
        h = before + mask[t][:, None] * (1 - z) * (new - before)
        if keep is not None:
            keep.append((before, z, r, new, g[:, 2 * n :]))
        out[t] = h
    return out


def _unread(grad: np.ndarray, state: np.ndarray, mask: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs (steps, rows, 3 HIDDEN) and of the state weights."""
    steps, rows, n = grad.shape
    gates = np.empty((steps, rows, 3 * n), np.float32)
    weights = np.zeros_like(state)
    later = np.zeros((rows, n), np.float32)
    for t in range(steps - 1, -1, -1):
        before, z, r, new, g = keep[t]
        d = grad[t] + later
        inner = d * mask[t][:, None]
        dn = inner * (1 - z) * (1 - new * new)
        dz = inner * (before - new) * z * (1 - z)
        dr = dn * g * r * (1 - r)
        to = np.concatenate([dz, dr, dn * r], axis=1)
        weights += before.T @ to
        later = d - inner + inner * z + to @ state.T
        gates[t, :, : 2 * n] = to[:, : 2 * n]
        gates[t, :, 2 * n :] = dn
    return gates, weights


def forward(p: dict[str, np.ndarray], x: np.ndarray, index: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """Logits of windows. index: (steps, rows) of word rows, the last row of x for padding."""
    mask = (index < len(x) - 1).astype(np.float32)
    keep_f, keep_b = ([], []) if kept is not None else (None, None)
    ahead = _read(x @ p["in_f"] + p["bias_f"], p["state_f"], index, mask, keep_f)
    back = _read(x @ p["in_b"] + p["bias_b"], p["state_b"], index[::-1], mask[::-1], keep_b)[::-1]
    s = np.concatenate([ahead, back], axis=2)
    u = np.tanh(s @ p["look"] + p["look_bias"])
    e = np.where(mask > 0, u @ p["pick"], -1e9)
    e = np.exp(e - e.max(axis=0)) * mask
    weight = e / np.maximum(e.sum(axis=0), 1e-9)
    pooled = np.einsum("tr,trh->rh", weight, s, optimize=True)
    if kept is not None:
        kept |= {"mask": mask, "f": keep_f, "b": keep_b, "s": s, "u": u, "weight": weight, "pooled": pooled}
    return pooled @ p["out"] + p["out_bias"][0]


def backward(p: dict[str, np.ndarray], words: Words, x: np.ndarray, index: np.ndarray, k: dict, d: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of all parameters from those of the logits; words and grams come as (rows, gradient)."""
    s, u, weight, mask = k["s"], k["u"], k["weight"], k["mask"]
    g = {"out": k["pooled"].T @ d, "out_bias": d.sum(keepdims=True)}
    dp = d[:, None] * p["out"]
    dw = np.einsum("trh,rh->tr", s, dp, optimize=True)
    de = weight * (dw - (weight * dw).sum(axis=0))
    du = de[:, :, None] * p["pick"] * (1 - u * u)
    g["pick"] = np.einsum("tr,tra->a", de, u, optimize=True)
    g["look"] = s.reshape(-1, 2 * HIDDEN).T @ du.reshape(-1, ATTENTION)
    g["look_bias"] = du.sum(axis=(0, 1))
    ds = weight[:, :, None] * dp + du @ p["look"].T
    dx = np.zeros_like(x)
    for way, part, m, at, turn in (("f", ds[:, :, :HIDDEN], mask, index, 1), ("b", ds[::-1, :, HIDDEN:], mask[::-1], index[::-1], -1)):
        gates, g[f"state_{way}"] = _unread(np.ascontiguousarray(part), p[f"state_{way}"], m, k[way])
        flat, where = gates.reshape(-1, 3 * HIDDEN), at.ravel()
        order = np.argsort(where, kind="stable")
        own, first = np.unique(where[order], return_index=True)
        side = np.add.reduceat(flat[order], first, axis=0)
        g[f"in_{way}"] = x[own].T @ side
        g[f"bias_{way}"] = side.sum(axis=0)
        dx[own] += side @ p[f"in_{way}"].T
    dx = dx[:-1]
    g["words"] = _by_row(words.bucket, dx[:, :WORD_SIZE] * words.word_gain[:, None])
    g["grams"] = _by_row(words.gram, (dx[:, WORD_SIZE:] * words.scale[:, None])[words.owner] * words.gram_gain[:, None])
    return g


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    own, first = np.unique(rows[order], return_index=True)
    return own, np.add.reduceat(values[order], first, axis=0)


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.rate, self.t = rate, 0

    def step(self, p: dict[str, np.ndarray], g: dict) -> None:
        self.t += 1
        rate = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, d in g.items():
            rows, d = d if isinstance(d, tuple) else (slice(None), d)
            self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * d
            self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * d * d
            p[k][rows] -= rate * self.m[k][rows] / (np.sqrt(self.v[k][rows]) + 1e-7)


def _texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return raw_text(pa.array(texts, pa.large_string()))


def common(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of grams that at least LEAST_TEXTS texts have."""
    seen = np.zeros(WORD_BUCKETS, np.int32), np.zeros(GRAM_BUCKETS, np.int32)
    for text in texts:
        w = Words(*_texts([text]))
        for count, own in zip(seen, (w.bucket, w.gram), strict=True):
            count[np.unique(own)] += 1
    return seen[0] >= LEAST_TEXTS, seen[1] >= LEAST_TEXTS


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Fits the network to whole texts; without both labels it is a constant."""
    rng = np.random.default_rng(SEED)
    p = start(rng)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        p["out"][:] = 0
        p["out_bias"][:] = np.log(share / (1 - share))
        return p
    adam = Adam(p, RATE)
    often = common(texts)
    size = np.array([len(t) for t in texts])
    mixed = rng.permutation(len(texts))
    held, own = mixed[: int(HELD * len(mixed))], mixed[int(HELD * len(mixed)) :]
    best, least, waited = p, np.inf, 0
    mean = {k: v.copy() for k, v in p.items()}
    for epoch in range(epochs):
        # Texts of like length share a batch; batches come in random order.
        order = own[np.argsort(size[own] + rng.uniform(0, 200, len(own)))]
        adam.rate = RATE * (1.0 if epoch < 0.5 * epochs else 0.3)
        for k in rng.permutation(-(-len(own) // BATCH)):
            rows = order[k * BATCH : (k + 1) * BATCH]
            words = Words(*_texts([texts[i] for i in rows]))
            words.drop(rng, often)
            x = words.inputs(p)
            # A text is as its highest window, in training as in scoring.
            owner, index = windows_of(words, len(rows))
            logit = forward(p, x, index)
            top = np.lexsort((-logit, owner))
            top = top[np.searchsorted(owner[top], np.arange(len(rows)))]
            kept: dict = {}
            index = index[:, top]
            logit = forward(p, x, index, kept)
            d = ((_sigmoid(logit) - y[rows]) / len(rows)).astype(np.float32)
            adam.step(p, backward(p, words, x, index, kept, d))
            # The fit is the running mean of the parameters.
            keep = MEAN * min(1.0, adam.t / 20)
            for name, v in mean.items():
                v += (1 - keep) * (p[name] - v)
        loss = mean_loss(mean, texts, y, held if len(held) else own)
        if loss < 0.98 * least:
            best, least, waited = {k: v.copy() for k, v in mean.items()}, loss, 0
        elif (waited := waited + 1) >= PATIENCE:
            break
    return best


def mean_loss(p: dict[str, np.ndarray], texts: list[str], y: np.ndarray, rows: np.ndarray) -> float:
    """The mean logistic loss of the texts' scores."""
    p1 = np.clip(scores(p, *_texts([texts[i] for i in rows])), 1e-6, 1 - 1e-6)
    return float(-np.mean(np.where(y[rows] > 0, np.log(p1), np.log1p(-p1))))


def windows_of(words: Words, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of each overlapping window, in order of texts, and (steps, windows) of word rows, padded at their ends."""
    size = np.bincount(words.doc, minlength=texts)
    begin = np.cumsum(size) - size
    count = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(texts), count)
    at = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    left = np.minimum(size[owner] - at, WINDOW)
    steps = np.arange(max(1, int(left.max(initial=1))))[:, None]
    word = np.append(words.word, words.n)
    return owner, np.where(steps < left, word[np.minimum(begin[owner] + at + steps, len(word) - 1)], words.n)


def scores(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of each text: the highest of all its overlapping windows."""
    texts = len(offsets) - 1
    words = Words(data, offsets)
    x = words.inputs(p)
    owner, index = windows_of(words, texts)
    best = np.full(texts, -np.inf, np.float32)
    # Windows of like length together, so that short ones carry little padding.
    left = (index < words.n).sum(axis=0)
    order = np.argsort(left, kind="stable")
    for k in range(0, len(order), ROWS):
        rows = order[k : k + ROWS]
        np.maximum.at(best, owner[rows], forward(p, x, index[: max(1, int(left[rows[-1]])), rows]).astype(np.float32))
    return _sigmoid(best.astype(np.float64))


def sample(df: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Labelled texts of the training folds, at most `rows` of at most `chars` characters, by a hash of the id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    # About four times the rows, as some texts are too long; the bound holds for what is broadcast and what is collected.
    picked = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    picked = least_hashes(picked, "h", rows)
    own = df.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.char_length("text") <= chars)
    # An id that many rows share gives one text, the one of least hash, found in each task first.
    found = own.join(F.broadcast(picked), "doc_id").groupBy("h", "doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("k"), "text")).alias("t"))
    rows_ = found.orderBy("h", "doc_id").limit(rows).select("t.text", "toxic").collect()
    return [r.text for r in rows_], [int(r.toxic) for r in rows_]


def score(df: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """All columns of df and the column toxic_score (0 to 1), without a shuffle. A column of that name is replaced."""
    df = df.drop("toxic_score")
    schema = T.StructType([*df.schema.fields, T.StructField("toxic_score", T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(iter([batch.append_column("\0text", batch.column(text))]), "\0text"):
                found = scores(model, *raw_text(part.column("\0text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(names) - 1)), pa.array(found, pa.float64())], names=names)

    return df.mapInArrow(run, schema)


def fit(df: DataFrame, labels: DataFrame, text: str = "text") -> dict[str, np.ndarray]:
    return train(*sample(df, labels, text))
