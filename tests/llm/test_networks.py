"""The networks of operators 3 and 4 against plain loops and enumeration, and held-out spans written by hand."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import pii, toxicity
from lodestar.llm.shared import raw_text


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(4)
    move = np.where(pii.allowed(), rng.normal(0, 1, (pii.TAGS, pii.TAGS)), pii._NEVER).astype(np.float32)
    length = np.array([4, 1, 3, 2])
    e = rng.normal(0, 2, (4, 4, pii.TAGS)).astype(np.float32)
    got = pii.viterbi(e, move, length)
    for r, n in enumerate(length.tolist()):
        best, value = None, -math.inf
        for path in itertools.product(range(pii.TAGS), repeat=n):
            if path[0] and path[0] % 2 == 0 or any(not pii.allowed()[x, y] for x, y in itertools.pairwise(path)):
                continue
            own = sum(float(e[t, r, x]) for t, x in enumerate(path)) + sum(float(move[x, y]) for x, y in itertools.pairwise(path))
            best, value = (path, own) if own > value else (best, value)
        assert tuple(got[:n, r]) == best


def test_emissions_equal_plain_loops():
    rng = np.random.default_rng(5)
    p = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in pii.start(rng).items()}
    texts = [[72, 101, 256, 111], [64], [49, 50]]
    index = np.full((4, 3), pii.OWN + 1)
    for r, t in enumerate(texts):
        index[: len(t), r] = t
    e, _ = pii.emissions(p, index)
    n = pii.HIDDEN
    for r, t in enumerate(texts):
        states = {}
        for way, chars in (("f", t), ("b", t[::-1])):
            h, c, out = np.zeros(n), np.zeros(n), []
            for x in chars:
                a = p[f"in_{way}"][x].astype(float) + h @ p[f"state_{way}"]
                c = sigmoid(a[n : 2 * n]) * c + sigmoid(a[:n]) * np.tanh(a[3 * n :])
                h = sigmoid(a[2 * n : 3 * n]) * np.tanh(c)
                out.append(h)
            states[way] = out if way == "f" else out[::-1]
        for k in range(len(t)):
            plain = states["f"][k] @ p["tag_f"] + states["b"][k] @ p["tag_b"] + p["tag"]
            assert np.allclose(e[k, :, r], plain, atol=1e-4)


def plain_score(p, text):
    """The highest window's score, a word at a time."""
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text.lower()) if w]
    each = toxicity.Words(*raw_text(pa.array([" ".join(words)], pa.large_string())))
    vector = each.inputs(p).astype(float)
    rows = [vector[k] for k in each.word]
    best = -math.inf
    for at in range(0, max(1, len(rows) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        own = rows[at : at + toxicity.WINDOW]
        n, both = toxicity.HIDDEN, {}
        for way, x in (("f", own), ("b", own[::-1])):
            h, out = np.zeros(n), []
            for v in x:
                a, g = v @ p[f"in_{way}"] + p[f"bias_{way}"], h @ p[f"state_{way}"]
                z, r = sigmoid(a[:n] + g[:n]), sigmoid(a[n : 2 * n] + g[n : 2 * n])
                h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * g[2 * n :])
                out.append(h)
            both[way] = out if way == "f" else out[::-1]
        states = [np.concatenate([a, b]) for a, b in zip(both["f"], both["b"], strict=True)]
        look = [float(np.tanh(s @ p["look"] + p["look_bias"]) @ p["pick"]) for s in states]
        weight = np.exp(np.array(look) - max(look, default=0))
        pooled = sum((w * s for w, s in zip(weight / weight.sum(), states, strict=True)), np.zeros(2 * n)) if states else np.zeros(2 * n)
        best = max(best, float(pooled @ p["out"] + p["out_bias"][0]))
    return sigmoid(best)


def test_toxicity_scores_equal_plain_loops():
    rng = np.random.default_rng(6)
    p = {k: rng.normal(0, 0.4, v.shape).astype(np.float32) for k, v in toxicity.start(rng).items()}
    words = ["alpha", "Beta", "of", "ü", "gamma-ray", "x"]
    texts = ["", " ", *(" ".join(rng.choice(words, n)) for n in (1, 7, 47, 48, 49, 80, 81, 200))]
    got = toxicity.scores(p, *raw_text(pa.array(texts, pa.large_string())))
    assert np.allclose(got, [plain_score(p, t) for t in texts], atol=1e-4)


#: Sentences with personal data in forms that no pattern of the base kinds takes, written by hand.
HELD_OUT = [
    ("Write to john.doe (at) example.org before noon", "john.doe (at) example.org", 0),
    ("contact mary [at] college [dot] edu for the keys", "mary [at] college [dot] edu", 0),
    ("my address is peter.parker at dailybugle dot com thanks", "peter.parker at dailybugle dot com", 0),
    ("call (212) 555-0187 after six", "(212) 555-0187", 3),
    ("phone 415-555-0132 or come by", "415-555-0132", 3),
    ("she rang 303.555.0119 twice", "303.555.0119", 3),
    ("the host 10 . 20 . 30 . 40 was down", "10 . 20 . 30 . 40", 1),
]
CLEAN = ["the meeting is at noon on Monday", "version 2.10.3 of the tool came out in 2021", "he paid $1,250 for 12 chairs", "look at section 4.2 and at page 19"]


@pytest.fixture(scope="module")
def tagger(spark, sf_dir):
    return pii.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_spans_written_by_hand(tagger):
    texts = [f"{'some plain words stand here before it ' * (k % 4)}{t}{' and more of them follow' * (k % 3)}" for k, (t, _, _) in enumerate(HELD_OUT)]
    found = pii.model_spans(tagger, *raw_text(pa.array(texts, pa.large_string())), texts)
    met = 0
    for (_, want, kind), text, own in zip(HELD_OUT, texts, found, strict=True):
        a = text.index(want)
        # The span's core is covered by one of its kind.
        met += any(k == kind and min(e, a + len(want)) - max(s, a) >= 0.7 * len(want) for k, s, e in own)
    assert met >= 5
    quiet = pii.model_spans(tagger, *raw_text(pa.array(CLEAN, pa.large_string())), CLEAN)
    assert sum(map(len, quiet)) == 0


def test_spans_in_a_very_long_text(tagger, odd):
    row = next(r for r in odd.collect() if r.doc_id == 5)
    text = row.text + " write to john.doe (at) example.org "
    (own,) = pii.model_spans(tagger, *raw_text(pa.array([text], pa.large_string())), [text])
    assert any(k == 0 and s >= len(row.text) for k, s, e in own)
