"""Token counts of a unigram tokenizer without its ids: count-only Viterbi over Aho-Corasick matches.

A text's blanks become word marks, one is put before it, and each word is segmented on its own. All
vocabulary matches of a word come from one Aho-Corasick pass. The dynamic program carries, for each end,
the best score, the piece count and the start of a run of unknown characters. Tie rules are those of the
tokenizers library: of matches that end together the longest comes first and only a higher score displaces it; a character
without a piece of its own costs the least score less ten, unknown characters in a row fuse, and fused
ones count one for each byte where the vocabulary has all byte pieces, else one.

Edges: a null text is the empty text, of no tokens; repeated rows are counted each; further columns are
ignored; a null id passes through; an empty table gives no rows; words of any length take time in proportion to their matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.pieces import MEMO, HashIndex, code_points
from lodestar.llm.shared import raw_text, text_chunks
from lodestar.llm.words import span_hashes

MARK = "▁"
#: The library's penalty of an unknown character under the least score.
UNKNOWN_PENALTY = 10.0


class Unigram:
    """A vocabulary of (piece, score), where a later equal piece replaces an earlier; unk is the unknown piece."""

    def __init__(self, vocab: list[tuple[str, float]], unk: str, byte_fallback: bool = True):
        import ahocorasick

        self.score = dict(vocab)
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.score for b in range(256))
        self.unk = unk
        self.auto = ahocorasick.Automaton()
        for piece, s in self.score.items():
            if piece:
                self.auto.add_word(piece, (len(piece), s))
        self.auto.make_automaton()

    def count(self, word: str) -> tuple[int, float]:
        """Pieces and score of one word's best segmentation."""
        n = len(word)
        if not n:
            return 0, 0.0
        score, pieces, run = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.auto.iter(word):
            ends[end].append(match)
        unknown = self.unknown
        for end in range(n):
            best, start = None, -1
            single = False
            for size, s in ends[end]:
                at = end + 1 - size
                single = single or size == 1
                total = s + score[at]
                if best is None or total > best:
                    best, start = total, at
            fresh = False
            if not single:
                total = unknown + score[end]
                if best is None or total > best:
                    best, start, fresh = total, end, True
            score[end + 1] = best
            if fresh:
                first = run[start] if run[start] >= 0 else start
                run[end + 1] = first
                pieces[end + 1] = pieces[first] + self._fused(word[first : end + 1])
            else:
                pieces[end + 1] = pieces[start] + 1
        return pieces[n], score[n]

    def _fused(self, text: str) -> int:
        if text in self.score or not self.bytes:
            return 1
        return len(text.encode())


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


_WORKER: dict[str, tuple[Unigram, list]] = {}


def _counter(path: str) -> tuple[Unigram, list]:
    if path not in _WORKER:
        vocab = piece_vocabulary(path)
        _WORKER[path] = Unigram(vocab, vocab[0][0]), [HashIndex(), np.zeros(0, np.int32), np.zeros(0)]
    return _WORKER[path]


def counts(column: pa.Array, model: Unigram, memo: list) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and score of each text; a worker's memo keeps distinct words, up to MEMO of them."""
    texts = [t.replace(MARK, " ") for t in column.to_pylist()]
    texts = [t if t.startswith(" ") or not t else " " + t for t in texts]
    data, offsets = raw_text(pa.array(texts, pa.large_string()))
    n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    if not len(data):
        return n, total
    cp, off = code_points(data, offsets)
    s = np.flatnonzero(cp == 0x20)
    e = np.append(s[1:], len(cp))
    # A word ends at the next blank or at its text's end, where the next text starts with a blank.
    wide = cp.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = span_hashes(wide ^ (wide >> np.uint64(32)), s, e)
    h[h == 0] = 1
    row = memo[0].find(h)
    new = np.flatnonzero(row < 0)
    if len(new):
        fresh, one = np.unique(h[new], return_index=True)
        if memo[0].n + len(fresh) > MEMO:
            memo[:] = [HashIndex(), np.zeros(0, np.int32), np.zeros(0)]
            new = np.arange(len(h))
            fresh, one = np.unique(h, return_index=True)
        whole = "".join(texts)
        found = [model.count(MARK + whole[a + 1 : b]) for a, b in zip(s[new[one]].tolist(), e[new[one]].tolist(), strict=True)]
        memo[0].add(fresh)
        memo[1] = np.concatenate([memo[1], np.array([c for c, _ in found], np.int32)])
        memo[2] = np.concatenate([memo[2], np.array([v for _, v in found])])
        row[new] = memo[0].find(h[new])
    doc = np.searchsorted(off, s, "right") - 1
    n += np.bincount(doc, memo[1][row], len(texts)).astype(np.int64)
    total += np.bincount(doc, memo[2][row], len(texts))
    return n, total


def token_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens and score (the sum of piece scores) of each row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = _counter(path)
        for part in text_chunks(batches):
            n, total = counts(part.column("text"), model, memo)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "n_tokens", "score"])

    return df.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, score double")
