"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions, in numpy.

The network tags each character (outside, or the beginning or inside of one of four kinds). Texts of any
length are cut into overlapping windows; each window's best tag path comes from Viterbi search. A window
is skipped only where it can add no span: the final check asks a digit or an at sign (or the word) of any
span, and where the network was run, a bound may prove the all-outside path best. Spans seen by several windows are
reconciled over the whole text: a span cut by a window's edge gives way to what another window saw whole,
and cut spans of one kind that overlap are joined.
A plain check of digits and parts holds for each, and model spans join the pattern spans they do not touch.

Training: labelled spans in a bounded sample of the corpus, both those that the patterns find and spans
of many written forms, also such that the patterns miss, set between the words by a fixed seed.

Edges: a null or empty text has no spans; a very long text is searched whole, window by window; a null or
repeated id passes through; an empty sample trains on the made spans alone and an empty table gives no rows;
repeated rows are searched each; further columns, of whatever names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.pieces import code_points
from lodestar.llm.shared import least_hashes, raw_text, text_chunks
from lodestar.llm.toxicity import Adam

KINDS = ["email", "ip", "card", "phone"]
TAGS = 1 + 2 * len(KINDS)
#: Characters of a window, and the shared part of two neighbours; the longest made forms (58) and some context fit into the overlap.
WINDOW, OVERLAP = 128, 64
HIDDEN = 10
#: Code points below have an input of their own; the last two inputs are other characters and padding.
OWN = 256
#: Bounds of the training sample: rows, and characters of a text in it.
SAMPLE_ROWS, SAMPLE_CHARS = 300, 3000
STEPS, BATCH, RATE, SEED = 1200, 64, 0.02, 11
ROWS = 1024
_NEVER = -1e4

# The patterns of the base kinds.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind and start."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            while at > done and text[at - 1] in _LOCAL:
                at -= 1
            if at < m.start():
                out.append((0, at, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # Leading zeros say nothing, and what is left of a very long part is never read as a number.
            parts = [x.lstrip("0") for x in m.group().split(".")]
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def allowed() -> np.ndarray:
    """Which tag may follow which: an inside only its own beginning or inside."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


_FIRST = np.array([0.0] + [0.0, _NEVER] * len(KINDS), np.float32)


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for way in "fb":
        p[f"in_{way}"] = rng.normal(0, 0.5, (OWN + 2, 4 * HIDDEN))
        p[f"state_{way}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        p[f"in_{way}"][:, HIDDEN : 2 * HIDDEN] += 1.0
        p[f"tag_{way}"] = rng.normal(0, 0.3, (HIDDEN, TAGS))
    p |= {"tag": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _read(p: dict[str, np.ndarray], way: str, index: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States (steps, HIDDEN, rows) of one direction; gates are input, forget, output and candidate, one tanh for all four.

    Rows are the last axis, so that each gate is one contiguous block.
    """
    steps, rows = index.shape
    n = HIDDEN
    # sigmoid(x) = (tanh(x / 2) + 1) / 2: the first halving goes into the weights.
    half = np.full((4 * n, 1), 0.5, np.float32)
    half[3 * n :] = 1
    side, state = np.ascontiguousarray(p[f"in_{way}"].T * half), np.ascontiguousarray(p[f"state_{way}"].T * half)
    h, c = np.zeros((n, rows), np.float32), np.zeros((n, rows), np.float32)
    out = np.empty((steps, n, rows), np.float32)
    full = mask.all(axis=1)
    for t in range(steps):
        a = side[:, index[t]]
        a += state @ h
        np.tanh(a, out=a)
        gate = a[: 3 * n]
        gate += 1
        gate *= 0.5
        c0 = c
        c = gate[n : 2 * n] * c0
        c += gate[:n] * a[3 * n :]
        if not full[t]:
            c *= mask[t]
        s = np.tanh(c)
        h0, h = h, out[t]
        np.multiply(gate[2 * n :], s, out=h)
        if keep is not None:
            keep.append((a, c0, s, h0))
    return out


def _unread(p: dict[str, np.ndarray], way: str, index: np.ndarray, mask: np.ndarray, keep: list, grad: np.ndarray) -> dict[str, np.ndarray]:
    steps, n, rows = grad.shape
    state = p[f"state_{way}"]
    weights = np.zeros_like(state)
    flat = np.empty((steps, rows, 4 * n), np.float32)
    dh, dc = np.zeros((n, rows), np.float32), np.zeros((n, rows), np.float32)
    for t in range(steps - 1, -1, -1):
        a, c0, s, h0 = keep[t]
        i, f, o, g = a[:n], a[n : 2 * n], a[2 * n : 3 * n], a[3 * n :]
        d = grad[t] + dh
        inner = (dc + d * o * (1 - s * s)) * mask[t]
        to = np.concatenate([inner * g * i * (1 - i), inner * c0 * f * (1 - f), d * s * o * (1 - o), inner * i * (1 - g * g)])
        weights += h0 @ to.T
        dh, dc = state @ to, inner * f
        flat[t] = to.T
    where = index.ravel()
    order = np.argsort(where, kind="stable")
    own, first = np.unique(where[order], return_index=True)
    return {f"state_{way}": weights, f"in_{way}": (own, np.add.reduceat(flat.reshape(-1, 4 * n)[order], first, axis=0))}


def emissions(p: dict[str, np.ndarray], index: np.ndarray, kept: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tag scores (steps, TAGS, rows) and the mask (steps, rows) of windows of inputs."""
    mask = (index <= OWN).astype(np.float32)
    keep_f, keep_b = ([], []) if kept is not None else (None, None)
    ahead = _read(p, "f", index, mask, keep_f)
    back = _read(p, "b", index[::-1], mask[::-1], keep_b)[::-1]
    e = p["tag_f"].T @ ahead
    e += p["tag_b"].T @ back
    e += p["tag"][:, None]
    if kept is not None:
        kept |= {"f": keep_f, "b": keep_b, "ahead": ahead, "back": back}
    return e, mask


def may_hold(e: np.ndarray, move: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Rows where a path other than all-outside could be best.

    Viterbi over three states (outside, any beginning, any inside), each step and score taken at its best over the
    kinds, bounds every true path from above; scores are relative to the all-outside path.
    """
    rel = move - move[0, 0]
    first, more = slice(1, TAGS, 2), slice(2, TAGS, 2)
    most = lambda x, y: float(rel[x, y].max())
    into, again, anew = most(slice(0, 1), first), most(first, first), most(more, first)
    onward, within = most(first, more), most(more, more)
    out_first, out_more = max(most(first, slice(0, 1)), 0.0), max(most(more, slice(0, 1)), 0.0)
    pad = (mask - 1) * 1e6 - e[:, 0]
    begin = e[:, first].max(axis=1) + pad
    inside = e[:, more].max(axis=1) + pad
    b = begin[0].copy()
    i = np.full_like(b, _NEVER)
    hold = b + out_first > 0
    for t in range(1, len(e)):
        i, b = np.maximum(b + onward, i + within) + inside[t], np.maximum(np.maximum(b + again, i + anew), max(into, 0.0)) + begin[t]
        hold |= (b + out_first > 0) | (i + out_more > 0)
    return hold


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def crf_gradient(e: np.ndarray, move: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss and gradients (emissions, transitions) of the tag paths' negative log-likelihood, by forward-backward sums; e is (steps, rows, TAGS)."""
    steps, rows, _ = e.shape
    live = mask > 0
    a = np.empty_like(e)
    a[0] = e[0] + _FIRST
    for t in range(1, steps):
        step = e[t] + _log_sum(a[t - 1][:, :, None] + move, 1)
        a[t] = np.where(live[t][:, None], step, a[t - 1])
    total = _log_sum(a[-1], 1)
    b = np.zeros_like(e)
    pairs = np.zeros_like(move)
    for t in range(steps - 2, -1, -1):
        ahead = e[t + 1] + b[t + 1]
        joint = move + ahead[:, None, :]
        b[t] = np.where(live[t + 1][:, None], _log_sum(joint, 2), b[t + 1])
        chance = np.exp(a[t][:, :, None] + joint - total[:, None, None])
        pairs += (chance * live[t + 1][:, None, None]).sum(axis=0)
    g = np.exp(a + b - total[:, None]) * mask[:, :, None]
    t, r = np.nonzero(live)
    g[t, r, tags[t, r]] -= 1
    gold = (e[t, r, tags[t, r]]).sum()
    t, r = np.nonzero(live[1:])
    np.add.at(pairs, (tags[t, r], tags[t + 1, r]), -1)
    gold += move[tags[t, r], tags[t + 1, r]].sum()
    return float(total.sum() - gold) / rows, g / rows, pairs / rows


def viterbi(e: np.ndarray, move: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Best tags (steps, rows) of each window of the given length."""
    steps, rows, _ = e.shape
    best = e[0] + _FIRST
    back = np.zeros((steps, rows, TAGS), np.int8)
    last = np.zeros((rows, TAGS), np.float32)
    last[length == 1] = best[length == 1]
    for t in range(1, steps):
        x = best[:, :, None] + move
        back[t] = x.argmax(axis=1)
        best = x.max(axis=1) + e[t]
        done = length == t + 1
        last[done] = best[done]
    tags = np.zeros((steps, rows), np.int64)
    now = last.argmax(axis=1)
    row = np.arange(rows)
    for t in range(steps - 1, -1, -1):
        inside = t < length
        tags[t, inside] = now[inside]
        if t:
            now = np.where(inside, back[t][row, now], now)
    return tags


def runs(tags: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, kind, start, end) of each span of a tag matrix (steps, rows)."""
    out = []
    for r in np.flatnonzero(tags.any(axis=0)).tolist():
        column, at, kind = tags[:, r].tolist() + [0], -1, -1
        for t, x in enumerate(column):
            if at >= 0 and x != 2 + 2 * kind:
                out.append((r, kind, at, t))
                at = -1
            if x % 2 == 1:
                at, kind = t, (x - 1) // 2
    return out


def plausible(kind: int, text: str) -> bool:
    """The plain check of a model span."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == 0:
        parts = re.split(r"@|\bat\b|\(at\)|\[at\]", text, flags=re.IGNORECASE)
        return len(parts) == 2 and all(re.search(r"[A-Za-z0-9]", x) for x in parts) and bool(re.search(r"\.|dot", parts[1], re.IGNORECASE))
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) in (4, 5) and all(len(x) < 4 and int(x) <= 255 for x in parts[:4])
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and len(text) >= 9


def stitched(found: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int, bool]]:
    """Spans longer than the overlap: cut spans of one kind that overlap, joined."""
    out, last = [], None
    for kind, a, b, _ in sorted(x for x in set(found) if x[3]):
        if last and last[0] == kind and a < last[2]:
            last = (kind, last[1], max(b, last[2]), True)
            out.append(last)
        else:
            last = (kind, a, b, True)
    return out


def evidence(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Characters of which plausible() asks at least one in any span: a digit, an at sign, or the word "at" in either case.

    A window without them holds no span that plausible() lets pass, so it needs no search, unless a span cut by
    the edge of a window that has them goes on in it.
    """
    low = cp | 32
    letter = (cp < 128) & (low >= 97) & (low <= 122)
    edge = np.zeros(len(cp) + 3, bool)
    edge[off] = True
    before = np.concatenate([[False], letter[:-1]]) & ~edge[: len(cp)]
    after = np.concatenate([letter[2:], [False, False]])[: len(cp)] & ~edge[2 : len(cp) + 2]
    word = letter & (low == 97) & ~before & ~after
    word[:-1] &= letter[1:] & (low[1:] == 116)
    word[-1:] = False
    out = (cp == 64) | (cp >= 48) & (cp <= 57) | word
    out[1:] |= word[:-1]
    return out


def model_spans(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Reconciled (kind, start, end) of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(data):
        return out
    cp, off = code_points(data, offsets)
    code = np.append(np.minimum(cp, OWN).astype(np.int64), OWN + 1)
    size = np.diff(off)
    stride = WINDOW - OVERLAP
    count = np.where(size > 0, np.maximum(1, -(-(size - WINDOW) // stride) + 1), 0)
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(size)), count)
    at = (np.arange(len(owner)) - np.repeat(first, count)) * stride
    left = np.minimum(size[owner] - at, WINDOW)
    move = np.where(allowed(), p["move"], _NEVER).astype(np.float32)
    seen: dict[int, list[tuple[int, int, int, bool]]] = {}
    marks = np.concatenate([[0], np.cumsum(evidence(cp, off))])
    begin = off[owner] + at
    todo = np.flatnonzero(marks[begin + left] > marks[begin])
    done = np.zeros(len(owner), bool)
    while len(todo):
        done[todo] = True
        more: set[int] = set()
        todo = todo[np.argsort(left[todo], kind="stable")]
        for k in range(0, len(todo), ROWS):
            rows = todo[k : k + ROWS]
            steps = np.arange(int(left[rows].max()))[:, None]
            index = np.where(steps < left[rows], code[np.minimum(begin[rows] + steps, len(code) - 1)], OWN + 1)
            e, mask = emissions(p, index)
            ask = np.flatnonzero(may_hold(e, move, mask))
            if not len(ask):
                continue
            tags = viterbi(np.ascontiguousarray(e[:, :, ask].transpose(0, 2, 1)), move, left[rows[ask]])
            for r, kind, a, b in runs(tags):
                w = rows[ask[r]]
                n = int(owner[w])
                a, b = a + int(at[w]), b + int(at[w])
                cut = bool((a == at[w] and a > 0) or (b == at[w] + WINDOW and b < size[n]))
                seen.setdefault(n, []).append((kind, a, b, cut))
                if cut:
                    # What goes on beyond the edge may be joined, so every window that sees a part of it is read.
                    more.update(range(int(first[n]) + max(0, (a - WINDOW) // stride), int(first[n] + min(count[n], b // stride + 1))))
        todo = np.array(sorted(w for w in more if not done[w]), np.int64)
    for n, found in seen.items():
        taken: list[tuple[int, int, int]] = []
        found = {x for x in [*found, *stitched(found)] if plausible(x[0], texts[n][x[1] : x[2]])}
        # Whole views first, longer ones before shorter, then by place.
        for kind, a, b, _ in sorted(found, key=lambda x: (x[3], x[1] - x[2], x[1])):
            if all(b <= y or a >= z for _, y, z in taken):
                taken.append((kind, a, b))
        out[n] = sorted(taken)
    return out


def all_spans(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray, texts: list[str]) -> list[tuple[list, list]]:
    """Pattern spans, and all spans (pattern spans and the model's that touch none of them), of each text."""
    out = []
    for text, more in zip(texts, model_spans(p, data, offsets, texts), strict=True):
        base = base_spans(text)
        out.append((base, sorted(base + [x for x in more if all(x[2] <= b[1] or x[1] >= b[2] for b in base)])))
    return out


# --- training -----------------------------------------------------------------------------------


def _made(rng: np.random.Generator) -> tuple[int, str]:
    """A kind (-1: none) and a string written in one of its forms."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda a, b: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(a, b)))
    pick = lambda *x: x[rng.integers(len(x))]
    kind = int(rng.integers(-2, 4))
    if kind == 0:
        local = pick(word(3, 9), f"{word(2, 8)}.{word(2, 8)}", f"{word(2, 7)}{digits(2)}", f"{word(3, 9)}.{digits(2)}", f"{word(1, 3)}_{word(3, 8)}", f"{word(3, 7)}+{word(2, 5)}")
        host, end = pick(word(3, 9), f"mail{digits(1)}.{word(4, 8)}", f"{word(3, 6)}-{word(3, 6)}"), pick("com", "org", "net", "de", "fr", "es", "co.uk", "io", "edu")
        at, dot = pick(("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", "."), ("(at)", "(dot)"))
        text = local + at + host.replace(".", dot) + dot + end.replace(".", dot)
        return 0, text.upper() if rng.random() < 0.1 else text
    if kind == 1:
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return 1, pick(".", ".", ".", " . ", "[.]").join(parts)
    if kind == 2:
        n = int(pick(16, 16, 16, 15, 19))
        body = pick("4", "5", "37", "6011") + digits(20)
        body = body[: n - 1]
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        sep = pick("", " ", "-", "", ".", "  ")
        return 2, sep.join(body[i : i + 4] for i in range(0, n, 4))
    if kind == 3:
        a, b, c = digits(3), digits(3), digits(4)
        return 3, pick(f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"+{digits(11)}", f"00{digits(2)} {digits(3)} {digits(7)}", f"1-{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+1{a}{b}{c}")
    return -1, pick(
        digits(rng.integers(1, 9)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}.{digits(2)}", f"${digits(3)},{digits(3)}", "".join(pick(*"0123456789abcdef") for _ in range(40)),
        f'token = "{"".join(pick(*"0123456789abcdef") for _ in range(32))}"', f"http://{word(3, 9)}.com/{word(2, 9)}", f"www.{word(4, 9)}.org", f"@{word(3, 9)}", f"{word(2, 5)}_{digits(3)}", f"# {digits(2)}", f"{digits(4)} {digits(4)}", f"{word(2, 8)} at {word(2, 8)}", f"AKIA{digits(3)}{word(13, 14).upper()}", f"v{digits(1)}.{digits(2)}.{digits(3)}", f"{digits(5)}-{digits(4)}",
    )


def examples(texts: list[str], rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows of inputs and tags: excerpts of the texts with made spans between words, and pattern spans labelled."""
    texts = [t for t in texts if t] or ["the and of in to it"]
    index = np.full((WINDOW, n), OWN + 1, np.int64)
    tags = np.zeros((WINDOW, n), np.int64)
    for r in range(n):
        text = texts[rng.integers(len(texts))]
        at = int(rng.integers(0, max(1, len(text) - WINDOW)))
        text = text[at : at + WINDOW]
        spans = base_spans(text)
        # A pattern span cut by the excerpt would carry a wrong label.
        text = text if rng.random() < 0.97 or not spans else text[: spans[0][1]]
        spans = [s for s in spans if s[2] <= len(text)]
        for _ in range(int(rng.integers(0, 4))):
            kind, put = _made(rng)
            gaps = [i for i, c in enumerate(text) if c == " " and all(i < a or i >= b for _, a, b in spans)] or [len(text)]
            i = int(gaps[rng.integers(len(gaps))])
            left, right = " ", (" ", ", ", ". ", "### ", "; ", "\n")[int(rng.integers(6)) if rng.random() < 0.3 else 0]
            text = text[:i] + left + put + right + text[i + 1 :]
            grown = len(left) + len(put) + len(right) - 1
            spans = [(k, a + grown * (a > i), b + grown * (a > i)) for k, a, b in spans]
            if kind >= 0:
                spans.append((kind, i + len(left), i + len(left) + len(put)))
        cut = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        text = text[cut : cut + WINDOW]
        index[: len(text), r] = np.minimum([ord(c) for c in text], OWN)
        for k, a, b in spans:
            a, b = max(0, a - cut), min(len(text), b - cut)
            if a < b:
                tags[a, r] = 1 + 2 * k
                tags[a + 1 : b, r] = 2 + 2 * k
    return index, tags


def train(texts: list[str], steps: int = STEPS) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    p = start(rng)
    adam = Adam(p, RATE)
    ok = allowed()
    for step in range(steps):
        index, tags = examples(texts, rng, BATCH)
        kept: dict = {}
        e, mask = emissions(p, index, kept)
        move = np.where(ok, p["move"], _NEVER).astype(np.float32)
        _, de, pairs = crf_gradient(np.ascontiguousarray(e.transpose(0, 2, 1)), move, tags, mask)
        de = np.ascontiguousarray(de.astype(np.float32).transpose(0, 2, 1))
        g = {"tag": de.sum(axis=(0, 2)), "move": pairs * ok}
        for way, states in (("f", kept["ahead"]), ("b", kept["back"])):
            g[f"tag_{way}"] = (states @ de.transpose(0, 2, 1)).sum(axis=0)
        g |= _unread(p, "f", index, mask, kept["f"], p["tag_f"] @ de)
        g |= _unread(p, "b", index[::-1], mask[::-1], kept["b"], (p["tag_b"] @ de)[::-1])
        adam.rate = RATE * (1.0 if step < 0.6 * steps else 0.25)
        adam.step(p, g)
    return p


def sample(df: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[str]:
    """Texts of at most `rows` rows and `chars` characters, those of least hash: what is sent to the driver is bounded."""
    own = df.select(F.xxhash64("doc_id", text).alias("h"), F.col(text).alias("text")).filter(F.char_length("text").between(1, chars))
    few = least_hashes(own, "h", rows)
    return [r.text for r in few.orderBy("h", "text").limit(rows).collect()]


def fit(df: DataFrame, text: str = "text") -> dict[str, np.ndarray]:
    return train(sample(df, text))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """doc_id, base and spans of each row, both arrays of (kind, start, end), by kind and start; no shuffle."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            column = part.column("text")
            found = all_spans(model, *raw_text(column), column.to_pylist())
            shaped = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in f[i]] for f in found], pa.list_(span)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *shaped], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return df.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def digests(found: DataFrame) -> DataFrame:
    """The counts, digest and text of the spans of find()."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    more = (F.size("spans") - F.size("base")).cast("long").alias("n_model")
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), more)
