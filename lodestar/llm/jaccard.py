"""Near-duplicate join on word shingles: chosen paths find candidates, an exact join inside them decides.

Texts are sets of five-word shingles (lower-cased A-Z, ASCII white space). Equal texts first collapse to
one node. In each run a set samples tokens, each with chance 1/(threshold x size) by a hash that all
sets share, and goes to the bucket of each; sets of a bucket that is too large sample again inside it, to
DEPTH levels. Small buckets, and last-level ones of any size in blocks, are compared pair by pair on
64 four-bit min-hashes. Runs repeat until a pair at the threshold is missed with a chance below 1 - RECALL:
each level keeps such a pair with at least the chance that a branching process of mean one survives.

Buckets yield spanning trees only, of bounded degree, so no key is hot and no group's pairs are emitted.
Their connected components are sets of candidates; inside one, every pair is intersected exactly, in blocks of
about BLOCK sets or BLOCK_TOKENS tokens a side, which counts each text's links and leaves the true links' spanning trees.

Edges: a null text is the empty text; a text of one to four words has one shingle of all its words; the
empty text has none and links with its copies alone; a null id is ignored when a class takes its least
id; repeated rows are copies of each other; further columns are ignored; an empty table gives no rows; a very
long text is one set of all its shingles, held by one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import checkpointed, looked_up, raw_text, release, text_chunks
from lodestar.llm.words import mix, split_words, windows

_U = np.uint64
SHINGLE, THRESHOLD = 5, 0.8
#: Chance that a pair at the threshold meets in some run's last level; levels; most sets of a bucket that is not split
#: (a task compares that many sketches of 32 bytes in about a second).
RECALL, DEPTH, SMALL = 0.9999, 3, 5000
#: Groups up to this size are compared together, at every distance; larger ones row by row.
TOGETHER = 128
#: Sets, and their tokens, a side of one exact comparison; sketches a side of one bucket comparison.
BLOCK, BLOCK_TOKENS, SIDE = 384, 1_000_000, 1500
#: Equal min-hashes, of 64, that make a candidate: 4.5 standard deviations under the threshold's mean.
EQUAL = 38
#: Children of a node of a spanning tree.
FAN = 16
#: Candidate rows that are broadcast (32 bytes each) to pick texts; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

_SEEDS = mix(np.arange(1, 129, dtype=_U))
_ODD, _ADD = _SEEDS[:64] | _U(1), _SEEDS[64:]


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    miss = 0.0
    for _ in range(depth):
        miss = math.exp(miss - 1)
    return math.ceil(math.log(1 - recall) / math.log(miss))


def sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = raw_text(column)
    h, doc, _, _ = split_words(data, offsets)
    s, owner = windows(h, doc, SHINGLE)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    return [np.unique(s[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def sketch(x: np.ndarray) -> bytes:
    """64 min-hashes of four bits each."""
    if not len(x):
        return bytes(32)
    least = np.full(64, ~_U(0))
    for k in range(0, len(x), 4096):
        np.minimum(least, (x[None, k : k + 4096] * _ODD[:, None] + _ADD[:, None]).min(axis=1), out=least)
    bits = (mix(least) >> _U(60)).astype(np.uint8)
    return (bits[0::2] | bits[1::2] << 4).tobytes()


def chosen(x: np.ndarray, paths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that a set samples on each path: (index of the path, new path)."""
    limit = min(1.0, 1 / (threshold * len(x)))
    bound = _U(min(int(limit * 2.0**64), 2**64 - 1))
    at, new = [], []
    odd = mix(paths) | _U(1)
    for k in range(0, len(x), 65536):
        part = x[k : k + 65536]
        p, t = np.nonzero(((part[None, :] ^ paths[:, None]) * odd[:, None]) <= bound)
        at.append(p)
        new.append(mix(mix(paths[p]) ^ part[t]))
    return np.concatenate(at), np.concatenate(new)


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


_SIGNED = "node long, tokens long, sketch binary, p1 array<long>, up2 array<long>, p2 array<long>, up3 array<long>, p3 array<long>"


def _paths(batches: Iterator[pa.RecordBatch], threshold: float, recall: float) -> Iterator[pa.RecordBatch]:
    seeds = mix(np.arange(1000, 1000 + runs_needed(recall), dtype=_U))
    for part in text_chunks(batches):
        columns: dict[str, list] = {k: [] for k in ("tokens", "sketch", "p1", "up2", "p2", "up3", "p3")}
        for x in sets(part.column("text")):
            columns["tokens"].append(len(x))
            columns["sketch"].append(sketch(x))
            level = seeds
            for k in (1, 2, 3):
                if len(x):
                    at, new = chosen(x, level, threshold)
                else:
                    at, new = np.zeros(0, np.int64), np.zeros(0, _U)
                if k > 1:
                    columns[f"up{k}"].append(_signed(level[at]))
                columns[f"p{k}"].append(_signed(new))
                level = new
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(columns["tokens"], pa.int64()), pa.array(columns["sketch"], pa.binary()), *(pa.array(columns[c], longs) for c in ("p1", "up2", "p2", "up3", "p3"))], names=["node", "tokens", "sketch", "p1", "up2", "p2", "up3", "p3"])


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing min-hashes of sketches given as rows of four 64-bit words."""
    x = a ^ b
    x |= x >> _U(1)
    x |= x >> _U(2)
    return np.bitwise_count(x & _U(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' components, joined by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def tree(label: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Each node's parent in a tree of FAN children a node over its component, in order of node ids; roots are their own."""
    order = np.lexsort((nodes, label))
    own, first = np.unique(label[order], return_index=True)
    size = np.diff(np.append(first, len(order)))
    start = np.repeat(first, size)
    rank = np.arange(len(order)) - start
    parent = np.empty_like(nodes)
    parent[order] = nodes[order[start + np.maximum(rank - 1, 0) // FAN]]
    return parent


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by the keys; small groups come many together."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = key(batch, batch.num_rows - 1)
        if held and key(held[-1], held[-1].num_rows - 1) == last:
            held.append(batch)
            continue
        # The first row of the last group.
        lo, hi = 0, batch.num_rows - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if key(batch, mid) == last else (mid + 1, hi)
        if lo or held:
            yield pa.Table.from_batches([*held, batch.slice(0, lo)])
        held = [batch.slice(lo)]
    if held:
        yield pa.Table.from_batches(held)
    release()


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _U).reshape(-1, 4)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning trees of the candidate pairs of each bucket block, as (a, b) of nodes."""
    for table in _groups(batches, ["bucket", "i", "j"]):
        bucket, i, j, node = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "node"))
        marks = _matrix(table.column("sketch"))
        cut = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        first = np.concatenate([[0], cut])
        size = np.diff(np.append(first, len(bucket)))
        end = np.repeat(first + size, size)
        left, right = [], []
        place = np.arange(len(bucket))
        # Pairs at distance d inside their group, all small groups at once.
        small = np.repeat(size <= TOGETHER, size)
        for d in range(1, int(size[size <= TOGETHER].max(initial=1))):
            a = place[small & (place + d < end)]
            ok = 64 - unequal(marks[a], marks[a + d]) >= EQUAL
            left.append(a[ok])
            right.append(a[ok] + d)
        for at, n in zip(first[size > TOGETHER].tolist(), size[size > TOGETHER].tolist(), strict=True):
            own = marks[at : at + n]
            label = np.arange(n)
            for k in range(n - 1):
                # Rows of the same component need no comparison; one that meets new ones joins them.
                rest = k + 1 + np.flatnonzero(label[k + 1 :] != label[k])
                if not len(rest):
                    continue
                near = rest[64 - unequal(own[k], own[rest]) >= EQUAL]
                if len(near):
                    joined = np.unique(np.append(label[near], label[k]))
                    label[np.isin(label, joined)] = joined[0]
            root = np.flatnonzero(label != np.arange(n))
            left.append(at + label[root])
            right.append(at + root)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        parent = tree(labels_of(len(node), a, b), node)
        far = np.flatnonzero(parent != node)
        if len(far):
            yield pa.RecordBatch.from_arrays([pa.array(node[far], pa.int64()), pa.array(parent[far], pa.int64())], names=["a", "b"])


def blocked(rows: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Adds i <= j and side: a group of a size above `block` is cut in blocks by node, and each pair of blocks is a group of its own."""
    m = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("node"), m).cast("int")
    others = F.transform(F.sequence(F.lit(0), m - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), (own > o).cast("int").alias("side")))
    out = rows.withColumn("\1o", F.explode(F.when(m > 1, others).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))))))
    return out.select(*rows.columns, "\1o.i", "\1o.j", "\1o.side").drop(size)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the least node of its component, by contraction to stars.

    In turn each node links its larger neighbours, and then its smaller ones, to the least of its neighbourhood; edges never grow in
    number, and the rounds grow with the logarithm of a component's diameter, not with it. A round is one table. The centre
    of a large star is sent to its edges, so that these stay where they lie.
    """
    edge = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edge = checkpointed(edge, "stars")
    total = 2 * edge.count()
    before = None
    while True:
        both = edge.union(edge.select("b", "a"))
        least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count("*").alias("n")), "least")
        large = looked_up(both, least, "a", "n", total).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = checkpointed(large, "large")
        low = checkpointed(large.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")), "low")
        small = looked_up(large, low, "a", "n", total).select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*")
        edge = checkpointed(small.filter("a <> b").distinct(), "stars")
        now = edge.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edge.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
            return edge.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
        before = now


def _exact(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of each node with the nodes of its block pair, weighted by copies, and its parent in the links' spanning tree."""
    for table in _groups(batches, ["comp", "i", "j"]):
        comp, i, j = (table.column(c).to_numpy() for c in ("comp", "i", "j"))
        cut = np.flatnonzero((np.diff(comp) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        first = np.concatenate([[0], cut])
        nodes, copies, sides, texts = (table.column(c) for c in ("node", "copies", "side", "set"))
        out_node, out_links, out_parent = [], [], []
        for a, b in zip(first.tolist(), np.append(first[1:], len(comp)).tolist(), strict=True):
            # Repeated rows of one text appear once.
            node, keep = np.unique(nodes.slice(a, b - a).to_numpy(), return_index=True)
            weight = copies.slice(a, b - a).to_numpy()[keep]
            side = sides.slice(a, b - a).to_numpy()[keep]
            own = [np.frombuffer(texts[a + k].as_py(), _U) for k in keep.tolist()]
            cross = bool(i[a] != j[a])
            x, y = linked(own, threshold, side if cross else None)
            links = np.bincount(x, weight[y], len(node)) + np.bincount(y, weight[x], len(node))
            out_node.append(node)
            out_links.append(links.astype(np.int64))
            out_parent.append(tree(labels_of(len(node), x, y), node))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in (out_node, out_links, out_parent)], names=["node", "links", "parent"])


def linked(own: list[np.ndarray], threshold: float, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets at the threshold or above (x < y); with sides, only pairs across them. Works on columns of shared tokens in slabs."""
    n = len(own)
    size = np.array([len(s) for s in own], np.float64)
    flat = np.concatenate(own) if n else np.zeros(0, _U)
    row = np.repeat(np.arange(n), size.astype(np.int64))
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    inter = np.zeros((n, n), np.float32)
    for k in range(0, int(column.max(initial=-1)) + 1, 4096):
        lo, hi = np.searchsorted(column, [k, k + 4096])
        slab = np.zeros((n, 4096), np.float32)
        slab[row[lo:hi], column[lo:hi] - k] = 1
        inter += slab @ slab.T
    near = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-6
    near &= inter > 0
    near = np.triu(near, 1)
    if side is not None:
        near &= side[:, None] != side[None, :]
    return np.nonzero(near)


def join(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row a row of df: doc_id, node (hash of the text), class_id (least doc_id of its class), n_links (rows it links with)."""
    return _classes(df, text, threshold, recall).drop("label")


def _classes(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The columns of join, and label: a node of the class, the same in all its rows and in no other class."""
    rows = df.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    nodes = checkpointed(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "nodes")

    # Sets of one row a text: copies are dropped where the table of first ids meets the rows.
    def one_a_text(picked: DataFrame, n: int) -> DataFrame:
        side = F.broadcast(picked) if n <= BROADCAST_ROWS else picked
        return rows.join(side, (rows.node == picked.node) & rows.doc_id.eqNullSafe(picked.first_id)).drop(picked.node)

    made = rows.select("node", "text").mapInArrow(lambda b: _paths(b, threshold, recall), _SIGNED)
    made = checkpointed(made.dropDuplicates(["node"]), "paths")

    def level(k: int) -> DataFrame:
        if k == 1:
            return made.select("node", F.explode("p1").alias("bucket"))
        z = F.explode(F.arrays_zip(F.col(f"up{k}").alias("up"), F.col(f"p{k}").alias("p"))).alias("z")
        return made.select("node", z).select("node", F.col("z.up").alias("up"), F.col("z.p").alias("bucket"))

    leaves, large = [], None
    for k in range(1, DEPTH + 1):
        part = level(k)
        if large is not None:
            part = part.join(large.select(F.col("bucket").alias("up")), "up", "left_semi").select("node", "bucket")
        count = part.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        count = checkpointed(count, "buckets")
        whole = count if k == DEPTH else count.filter(F.col("n") <= SMALL)
        large = count.filter(F.col("n") > SMALL)
        leaves.append(part.join(whole, "bucket").select("node", "bucket", "n"))
    met = leaves[0]
    for x in leaves[1:]:
        met = met.unionByName(x)
    met = met.join(made.select("node", "sketch"), "node")
    dealt = blocked(met, "bucket", "n", SIDE).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    edges = dealt.select("bucket", "i", "j", "node", "sketch").mapInArrow(_bucket_edges, "a long, b long").distinct()
    found = components(edges)
    # The size of a component in blocks' worth of sets or of tokens, whichever is more.
    found = checkpointed(found.join(made.select("node", "tokens"), "node"), "found")
    size = found.groupBy("label").agg(F.count("*").alias("rows"), F.greatest(F.count("*").cast("double"), F.sum("tokens") * (BLOCK / BLOCK_TOKENS)).alias("n"))
    size = checkpointed(size, "sizes")
    picked = checkpointed(looked_up(found, size, "label", "rows", found.count()).join(nodes, "node").select("node", "first_id", "copies", F.col("label").alias("comp"), "n"), "candidates")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "copies", "comp", "n"]
        for part in text_chunks(batches):
            raw = pa.array([s.tobytes() for s in sets(part.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), raw], names=[*names, "set"])

    texts = one_a_text(picked, picked.count()).select("node", "copies", "comp", "n", "text")
    with_sets = texts.mapInArrow(to_sets, "node long, copies long, comp long, n double, set binary")
    pairs = blocked(with_sets, "comp", "n", BLOCK).repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    links = checkpointed(pairs.select("comp", "i", "j", "side", "node", "copies", "set").mapInArrow(lambda b: _exact(b, threshold), "node long, links long, parent long"), "links")
    label = components(links.filter("node <> parent").select(F.col("node").alias("a"), F.col("parent").alias("b")).distinct())
    count = links.groupBy("node").agg(F.sum("links").alias("links"))
    # One row a text that has copies or links.
    known = nodes.join(label, "node", "left").join(count, "node", "left").filter((F.col("copies") > 1) | F.col("label").isNotNull())
    known = known.select("node", "first_id", F.coalesce("label", "node").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = checkpointed(known, "known")
    least = checkpointed(known.groupBy("label").agg(F.min("first_id").alias("class_id"), F.count("*").alias("rows")), "ids")
    known = checkpointed(looked_up(known, least, "label", "rows", known.count()).select("node", "label", "class_id", "n_links"), "classes")
    out = rows.select("doc_id", "node").join(known, "node", "left")
    return out.select("doc_id", "node", F.coalesce("label", "node").alias("label"), F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of df without near duplicates: of each class the row of least doc_id (ties: least text hash; repeated rows once). All columns stay."""
    found = _classes(df, text, threshold)
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("k"))
    kept = best.select(F.col("k.doc_id").alias("\1id"), F.col("k.node").alias("\1node"))
    marked = df.withColumn("\1own", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    out = marked.join(kept, marked.doc_id.cast("long").eqNullSafe(kept["\1id"]) & (marked["\1own"] == kept["\1node"]), "left_semi")
    return out.dropDuplicates(["doc_id", "\1own"]).select(*df.columns)
