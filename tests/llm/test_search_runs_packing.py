"""Dual-tree search, periodic runs and packing against brute-force versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import dualtree, packing, periodic, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def plain_negatives(rows, every, positives, negatives, least):
    """rows: (id, label, vector). All pairs, sorted."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in itertools.zip_longest(a, b, fillvalue=0))
    for i, label, v in rows:
        if i % every:
            continue
        scored = [(-dot(v, w), j, own) for j, own, w in rows if j != i]
        best = sorted((s, j) for s, j, own in scored if own == label)[:positives]
        for s, j in best:
            hard = sorted((t, k) for t, k, own in scored if own != label and least * -s <= 100 * -t <= 100 * -s)[:negatives]
            out += [(i, j, n, k, -s, -t) for n, (t, k) in enumerate(hard, 1)]
    return sorted(out)


@pytest.fixture
def small_trees(monkeypatch):
    for name, value in (("LEAF", 16), ("GROUP", 4), ("FAN", 3), ("SAMPLE", 64), ("SEEDS", 2)):
        monkeypatch.setattr(dualtree, name, value)


def frame(spark, rows):
    return spark.createDataFrame([(i, label, [int(x) for x in v]) for i, label, v in rows], "vec_id long, label int, vector array<long>")


@pytest.mark.parametrize("kind", ["loose", "clusters", "hot", "huge", "negative"])
def test_negatives_equal_all_pairs(spark, small_trees, kind):
    rng = np.random.default_rng(len(kind))
    v = rng.integers(-50, 50, (400, 6))
    if kind == "clusters":
        v = rng.integers(-3, 3, (400, 6)) + 90 * np.eye(6, dtype=int)[rng.integers(0, 6, 400)]
    if kind == "hot":
        v[rng.random(400) < 0.4] = [9, -30, 12, 5, 5, 40]
    if kind == "huge":
        v = v * (dualtree.BOUND // 50)
    if kind == "negative":
        v[:, 1:] = 0
    labels = rng.integers(0, 4, 400)
    rows = [(int(i), int(b), x[: 6 - int(i) % 2].tolist()) for i, b, x in zip(rng.permutation(400), labels, v, strict=True)]
    rows += rows[:7]  # repeated rows
    got = sorted(tuple(r) for r in dualtree.hard_negatives(frame(spark, rows), 9, 3, 4, 70).collect())
    assert got == plain_negatives(rows, 9, 3, 4, 70) and len(got) > 100


def test_negatives_prune_clusters(spark, small_trees, monkeypatch):
    monkeypatch.setattr(dualtree, "SAMPLE", 512)
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 2, (600, 8)) + 100 * np.eye(8, dtype=int)[np.arange(600) % 8]
    df = frame(spark, [(i, i % 16 // 8, v[i]) for i in range(600)])
    table, groups = dualtree.leaves(df, 600, 8, 16, "t"), dualtree.leaves(df.filter("vec_id % 9 = 0"), 67, 8, 4, "g")
    asked = groups.selectExpr("*", "array(named_struct('row', 0, 'w', 0, 'low', 5000L, 'high', 1000000000L)) as windows")
    met = dualtree._pairs(asked, dualtree._hulls(table), True, False).count()
    assert 0 < met < groups.count() * table.count() / 3
    assert sum(r["size"] for r in table.collect()) == 600


def test_node_intervals_hold():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (rng.integers(-40, 40, (5, 3)) for _ in range(2))
        nodes = [dualtree.Nodes([x.min(0)], [x.max(0)], [x.mean(0)], [np.sqrt(((x - x.mean(0)) ** 2).sum(1).max())], [[1]]) for x in (a, b)]
        low, high = nodes[0].intervals(nodes[1], 0)
        s = a @ b.T
        assert low[0] <= s.min() and s.max() <= high[0]


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.25]), (1, 1, [0.5, 0.1]), (2, 2, [0.4, 0.3]), (7, 1, [0.45, 0.3]), (None, 2, [0.4, 0.3]), (3, None, [0.4, 0.3]), (4, 2, None), (5, 2, [0.4, None]), (6, 2, [nan, 0.3]), (8, 2, [inf, 0.3]), (9, 2, []), (10, 2, [0.4, 0.3]), (11, 2, [3e38, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, side string")
    clean = dualtree.relabelled(df)
    plain = [(r.vec_id, r.label, r.vector) for r in clean.collect()]
    assert sorted(r[0] for r in plain) == [0, 1, 2, 7, 9, 10, 11] and (7, 2, [115, 76]) in plain
    # Id 0 is divisible by 7 as well: its label is 2, so the row of id 1 is its only negative.
    got = sorted(tuple(r) for r in dualtree.hard_negatives(clean).collect())
    assert got == plain_negatives(plain, 100, 5, 5, 80) and {r[3] for r in got} == {1}
    assert dualtree.hard_negatives(clean.limit(0)).collect() == [] and dualtree.hard_negatives(clean.filter("vec_id > 0")).collect() == []


def plain_runs(words, shortest=24, repeats=3):
    found = {}
    for p in range(1, len(words) // repeats + 1):
        i = 0
        while i + p < len(words):
            first = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - first >= max(shortest, repeats * p) and i > first:
                found.setdefault((first, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


@pytest.mark.parametrize("shortest", [24, 6])
def test_runs_equal_brute_force(shortest, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE", 777)
    rng = random.Random(shortest)
    texts = [[], [1], [1] * 23, [1] * 24, [1, 2] * 12, [5] * 300]
    for _ in range(250):
        n, kinds = rng.choice([5, 24, 25, 60, 200]), rng.choice([1, 2, 3, 50])
        w = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if rng.random() < 0.5:
                w[rng.randrange(n)] = 99
        texts.append(w)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = periodic.find_runs(np.array([x for t in texts for x in t]), off, shortest)
    assert found.tolist() == [[i, *r] for i, t in enumerate(texts) for r in plain_runs(t, shortest)] and len(found) > 60


def test_extensions_equal_comparison():
    rng = np.random.default_rng(4)
    words, text = np.concatenate([rng.integers(0, 2, 300), np.zeros(200, int), rng.integers(0, 9, 100)]), np.repeat([0, 1, 2], [300, 200, 100])
    e = periodic.Extensions(words, text)
    for _ in range(2000):
        i, j = rng.integers(0, 600, 2)
        if i == j or text[i] != text[j]:
            continue
        n = 0
        while max(i, j) + n < 600 and text[max(i, j) + n] == text[i] and words[i + n] == words[j + n]:
            n += 1
        assert e.common(np.array([i]), np.array([j]))[0] == n


def plain_digest(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-math.floor(10**9 * r[1] / r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    short = [r for r in docs if len(r.text or "") < 6000]
    assert len(got) == len(docs) and len(short) > 150 and sum(r[1] > 0 for r in got.values()) > 10
    for r in short:
        assert got[r.doc_id] == plain_digest(r.doc_id, r.text)


def test_runs_of_odd_rows(spark, odd, none):
    made = periodic.digests(periodic.runs(periodic.planted(odd))).collect()
    plain = sorted((plain_digest(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 5), key=str)
    assert sorted((tuple(r) for r in made if r.doc_id != 5), key=str) == plain and len(made) == odd.count()
    kept = periodic.runs(odd.withColumn("runs", odd.doc_id)).collect()
    assert {r.node for r in kept if r.doc_id == 1} == {"a"} and all(isinstance(r.runs, list) for r in kept)
    assert periodic.digests(periodic.runs(periodic.planted(none))).collect() == []
    # A text of three million characters, one word repeated but for its middle.
    long = spark.createDataFrame([(1, "ab " * 500_000 + "c" + " ab" * 500_000)], "doc_id long, text string")
    row = periodic.runs(long).first()
    assert [tuple(r) for r in row.runs] == [(0, 500_000, 1), (500_001, 500_000, 1)] and row.collapsed == "ab c ab"


def unpacked(counts, made, table):
    """The sequences of a plan as lists of (offset, length), after checking that all items are placed once."""
    out, seen = [[] for _ in range(made)], defaultdict(int)
    for length, first, items, sequence, each, offset in table.tolist():
        assert first == seen[length]
        seen[length] += items
        for k in range(items):
            out[sequence + k // each].append((offset + k % each * length, length))
    assert all(seen[n] == c for n, c in enumerate(counts.tolist()) if n)
    for own in out:
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert 0 < at < len(counts)
    return out


@pytest.mark.parametrize("kind", ["any", "long", "one size", "few", "small", "none"])
def test_plans(kind):
    rng = np.random.default_rng(7)
    lengths = {"any": rng.integers(1, 2049, 3000), "long": rng.integers(500, 1000, 6000), "one size": np.full(5000, 700), "few": np.array([2048, 1, 1500]), "small": rng.integers(1, 30, 2000), "none": np.zeros(0, int)}[kind]
    counts = np.bincount(lengths, minlength=2049)
    made, table = packing.plan(counts)
    unpacked(counts, made, table)
    bound = -(-int(lengths.sum()) // 2048)
    if kind == "one size":
        assert made == 2500
    elif kind == "long":
        greedy = packing.grouped(counts, 2048, 1)[0]  # plain best fit
        assert made < 0.95 * greedy and made < 1.05 * bound
    else:
        assert made <= bound + max(1, bound // 50)


def test_small_plans_are_near_the_optimum():
    def fewest(items, bins):
        if not items:
            return True
        tried = set()
        for k, room in enumerate(bins):
            if room >= items[0] and room not in tried:
                tried.add(room)
                if fewest(items[1:], [*bins[:k], room - items[0], *bins[k + 1 :]]):
                    return True
        return False

    rng = random.Random(3)
    for _ in range(30):
        items = sorted((rng.randrange(1, 21) for _ in range(9)), reverse=True)
        best = next(n for n in range(1, 10) if fewest(items, [20] * n))
        counts = np.bincount(items, minlength=21)
        made, table = packing.plan(counts)
        unpacked(counts, made, table)
        assert best <= made <= best + 1


def test_configurations_reach_the_optimum():
    # 100 of 6, 100 of 5, 100 of 4 into 15: 6+5+4 each.
    got = packing.configurations(np.array([6, 5, 4]), np.array([100.0, 100.0, 100.0]), 15)
    assert sum(x for _, x in got) == pytest.approx(100) and all((c * [6, 5, 4]).sum() <= 15 for c, x in got if x > 0)


def test_packing_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    library = Tokenizer.from_file(BYTE)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs.items()}
    rows = queries.op13_best_fit_packing(spark, sf_dir).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert by.keys() == ids.keys()
    for i, own in by.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids[i]) // 2048))) and all(r.length == 2048 for r in own[1:])
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids[i])
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    total = sum(map(len, ids.values()))
    assert len(sequences) <= -(-total // 2048) * 1.02 + 1


def test_packing_of_odd_rows(spark, odd, none):
    packed = packing.pack(odd, BYTE, with_ids=True)
    rows = packed.collect()
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1] and sum(r.doc_id is None for r in rows) == 2
    assert sum(r.doc_id == 4 for r in rows) == 2 and all(r.length == len(r.ids) for r in rows)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert sum(len(r.ids) for r in whole.values()) == sum(r.length for r in rows)
    assert all(whole[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids for r in rows)
    assert packing.pack(none, BYTE).collect() == []
