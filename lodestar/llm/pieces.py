"""Vectorised byte-level pre-tokenisation, and a bounded per-worker memo from piece to token ids."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

from lodestar.llm.words import mix, span_hashes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points of planes without assigned characters are neither letters, numbers nor spaces.
_PLANES = [(0, 0xD800), (0xE000, 0x40000), (0xE0000, 0xE1000)]
#: Entries of a worker's memo of pieces; past it the memo starts anew.
MEMO = 1_000_000


def class_table(tokenizer) -> bytes:
    """The class of every code point, asked of the library's own pre-tokenizer, compressed for shipping.

    A guess by Unicode properties is tested a block and class at a time: characters of one class form one piece.
    Only blocks where that fails (the library may know another Unicode version) are asked by character.
    """
    import regex

    ask = tokenizer.pre_tokenizer.pre_tokenize_str
    kinds = ((LETTER, "a", regex.compile(r"\p{L}")), (NUMBER, "1", regex.compile(r"\p{N}")), (OTHER, "!", regex.compile(r"[^\s\p{L}\p{N}]")))
    table = np.zeros(0x110000, np.uint8)
    for a, b in _PLANES:
        for low in range(a, b, 1024):
            points = np.arange(low, min(b, low + 1024))
            chars = "".join(map(chr, points))
            guess = np.full(len(points), SPACE, np.uint8)
            for kind, _, pattern in kinds:
                guess[[m.start() for m in pattern.finditer(chars)]] = kind
            ok = all(len(ask(base + "".join(chars[i] for i in np.flatnonzero(guess == kind)))) == 1 for kind, base, _ in kinds)
            gaps = "".join(f"!{chars[i]}" for i in np.flatnonzero(guess == SPACE))
            if not ok or len(ask(gaps)) < len(gaps) - chars.count(" "):
                guess[:] = SPACE
                for kind, base, _ in kinds:
                    text = "".join(f"\n{base}{c}" for c in chars)
                    at = np.zeros(len(text) + 1, bool)
                    at[[s for _, (s, _) in ask(text)]] = True
                    guess[~at[2 + 3 * np.arange(len(points))]] = kind
            table[points] = guess
    return zlib.compress(table.tobytes())


def read_table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of many texts as code points, with each text's offset among them."""
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return cp, lead[offsets]


def piece_starts(cp: np.ndarray, cuts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """True where a piece starts. cuts: sorted starts of the segments that are split on their own."""
    n = len(cp)
    cls = table[cp]
    begin = np.zeros(n + 1, bool)
    begin[cuts] = True
    begin[0] = begin[n] = True
    run = begin[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    blank = cp == 0x20
    after = np.zeros(n, bool)  # the character before is a plain space of the same segment
    after[1:] = blank[:-1] & ~begin[1:n]
    space = cls == SPACE
    start = np.where(space, run, run & ~after)
    # The last white space of a run goes with, or stands alone before, what follows it in the segment.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~begin[1:n]
    start |= last
    for i in np.flatnonzero((cp == 0x27) & run & ~after):
        to = int(i) + 1
        while to < min(n, i + 3) and not begin[to]:
            to += 1
        tail = "".join(map(chr, cp[i + 1 : to]))
        size = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
        if size:
            start[i + 1 : i + 1 + size] = False
            if i + 1 + size < n:
                start[i + 1 + size] = True
    return start


class HashIndex:
    """64-bit keys to row numbers by vectorised open addressing."""

    def __init__(self, bits: int = 16):
        self.keys, self.rows, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.rows[slot], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.rows[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Adds distinct absent keys and returns their rows."""
        rows = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        if self.n * 2 > len(self.keys):
            old, kept = self.keys, self.rows
            size = 1 << (self.n * 3).bit_length()
            self.keys, self.rows = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            full = old != 0
            self._put(old[full], kept[full])
        self._put(h, rows)
        return rows

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            s = slot[left]
            free = self.keys[s] == 0
            self.keys[s[free]] = h[left[free]]
            won = self.keys[s] == h[left]
            self.rows[s[won]] = rows[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask


class Encoder:
    """Ids of whole texts, piece by piece. encode: distinct pieces to lists of ids; special: strings with an id of their own."""

    def __init__(self, table: np.ndarray, encode: Callable[[list[str]], list[list[int]]], special: dict[str, int]):
        self.table, self.encode, self.special = table, encode, special
        self.reset()

    def reset(self) -> None:
        self.index, self.at, self.size = HashIndex(), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        lists = [[self.special[p]] if p in self.special else None for p in pieces]
        rest = [i for i, x in enumerate(lists) if x is None]
        for i, ids in zip(rest, self.encode([pieces[i] for i in rest]), strict=True):
            lists[i] = ids
        size = np.fromiter(map(len, lists), np.int32, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.int32, int(size.sum()))
        self.index.add(h)
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, flat])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text's ids start (one more offset than texts)."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cp, off = code_points(data, offsets)
        cuts = off
        marks = []
        raw = data.tobytes()
        for s in self.special:
            b, k = s.encode(), -1
            while (k := raw.find(b, k + 1)) >= 0:
                marks.append((k, k + len(b)))
        if marks:
            lead = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
            spans = np.array([(lead[a], lead[b]) for a, b in sorted(marks) if np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, b - 1, "right")], np.int64).reshape(-1, 2)
            cuts = np.union1d(off, spans.ravel())
        start = piece_starts(cp, cuts[cuts < len(cp)], self.table)
        if marks:
            for a, b in spans:
                start[a + 1 : b] = False
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(cp))
        wide = cp.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h = span_hashes(wide ^ (wide >> np.uint64(32)), s, e)
        h[h == 0] = 1
        row = self.index.find(h)
        new = np.flatnonzero(row < 0)
        if len(new):
            fresh, one = np.unique(h[new], return_index=True)
            if self.index.n + len(fresh) > MEMO:
                self.reset()
                fresh, one = np.unique(h, return_index=True)
                new = np.arange(len(h))
            text = data.tobytes().decode("utf-8")
            self._learn(fresh, [text[a:b] for a, b in zip(s[new[one]].tolist(), e[new[one]].tolist(), strict=True)])
            row[new] = self.index.find(h[new])
        size = self.size[row].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1])
        flat = self.ids[np.repeat(self.at[row] - (ends - size), size) + np.arange(total)]
        first = np.searchsorted(s, off)
        return flat, np.concatenate([[0], ends])[first]


__all__ = ["Encoder", "HashIndex", "class_table", "code_points", "mix", "piece_starts", "read_table"]
