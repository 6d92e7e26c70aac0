"""Hard negatives by dual-tree search: exact best inner products between anchors and all rows, in whole numbers.

Anchors and candidates each get a tree. Its planes are fitted on a bounded sample of SAMPLE rows; every row is then dealt by
them, and the rows of one side of all planes are cut, in order, into leaves of at most LEAF candidates or GROUP anchors. Up to FAN leaves that follow each other form an upper node. Boxes, balls and labels of the nodes are of
all their rows, so the sample decides on speed only, never on results.

What an anchor asks for are windows of scores, each with its best few rows of its own label (positives) or of another one
(negatives). The score interval of a node pair, from boxes and from balls, prunes the whole anchor group where it misses all
windows of the group or no label fits: first against upper nodes, which all tasks know, then against the leaves of those that
remain, which a join brings. A first round against the SEEDS most promising leaves raises the windows' lower ends to the worst
score that is still wanted. Remaining leaf pairs are joined with both leaves' rows and scored exactly, a matrix product each.
No group or task holds more than a leaf pair; the number of leaf pairs depends on the data (vectors without any structure
in many dimensions prune little) and is at most anchors x rows / (GROUP x LEAF).

Edges: rows with a null id, label or vector, or any null or non-finite component take no part; shorter vectors count as
filled up with zeros; components beyond +-BOUND count as that; rows of an anchor's own id are neither its positives nor its
negatives; repeated rows are each a candidate, and each an anchor; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import checkpointed, least_hashes

LEAF, GROUP, FAN = 1024, 128, 64
SAMPLE, SEEDS = 8192, 4
#: Components beyond are cut off, so that scores of up to 127 components fit a long.
BOUND = 1 << 28
#: Upper nodes that the driver hands to all tasks.
UPPER_MOST = 200_000

NODE = "low array<double>, high array<double>, centre array<double>, radius double, labels array<int>"
ROWS = f"block long, upper long, size int, ids binary, row_labels binary, vectors binary, {NODE}"


def relabelled(df: DataFrame) -> DataFrame:
    """Rows that take part, as vec_id, label and vector of whole numbers; every seventh id has the next label."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(256 * x.cast("double"), F.lit(-float(BOUND))), F.lit(float(BOUND)))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    there = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    return there.select(F.col("vec_id").cast("long"), label.cast("int").alias("label"), scaled.alias("vector"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Arrays of numbers as rows of one matrix, filled up with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dim))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Planes:
    """A complete binary tree of planes: a node's rows are parted along the line through two far points, at the widest gap of the middle half."""

    def __init__(self, sample: np.ndarray, depth: int):
        count, dim = 1 << (depth + 1), sample.shape[1]
        self.depth, self.normal, self.cut = depth, np.zeros((count, dim)), np.zeros(count)
        rows = {1: sample}
        for node in range(1, count):
            own = rows.pop(node)
            if len(own) > 1:
                a = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                long = np.sqrt(((b - a) ** 2).sum())
                self.normal[node] = (b - a) / long if long else 0
                along = own @ self.normal[node]
                middle = np.sort(along)[len(along) // 4 : len(along) - len(along) // 4]
                gap = int(np.diff(middle).argmax()) if len(middle) > 1 else 0
                self.cut[node] = middle[gap : gap + 2].mean()
                right = along > self.cut[node]
            else:
                right = np.zeros(len(own), bool)
            if 2 * node < count:
                rows[2 * node], rows[2 * node + 1] = own[~right], own[right]

    def deal(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its place along the leaf's own line."""
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + ((x * self.normal[node]).sum(1) > self.cut[node])
        return node - (1 << self.depth), (x * self.normal[node]).sum(1)


def _fitted(df: DataFrame, count: int, dim: int, leaf: int) -> Planes:
    keyed = df.withColumn("h", F.xxhash64("vec_id", "label", "vector"))
    drawn = least_hashes(keyed, "h", SAMPLE).orderBy("h").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    depth = int(np.ceil(np.log2(max(1, min(count / leaf, SAMPLE / 16)))))
    return Planes(_matrix(drawn, dim), depth)


def leaves(df: DataFrame, count: int, dim: int, most: int, name: str) -> DataFrame:
    """The tree over all rows of df: a written table with one row a leaf, its rows packed, and its box, ball and labels."""
    planes = _fitted(df, count, dim, most)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side, along = planes.deal(_matrix(batch.column("vector"), dim))
            yield pa.RecordBatch.from_arrays([pa.array(side), pa.array(along), *batch.columns], names=["side", "along", *batch.schema.names])

    def block(part: int, k: int, batch: pa.RecordBatch) -> dict:
        x = _matrix(batch.column("vector"), dim)
        centre = x.mean(0)
        labels = batch.column("label").to_numpy().astype("<i4")
        packed = {"ids": batch.column("vec_id").to_numpy().astype("<i8").tobytes(), "row_labels": labels.tobytes(), "vectors": x.astype("<i4").tobytes()}
        node = {"low": x.min(0), "high": x.max(0), "centre": centre, "radius": float(np.sqrt(((x - centre) ** 2).sum(1).max())), "labels": np.unique(labels)}
        return {"block": part << 32 | k, "upper": part << 32 | k // FAN, "size": len(x)} | packed | node

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            sides = held.column("side").to_numpy()
            at = 0
            for end in [*(np.flatnonzero(np.diff(sides)) + 1).tolist(), len(sides)]:
                while end - at >= most or at < end < len(sides):
                    to = min(end, at + most)
                    yield _record([block(part, k, held.slice(at, to - at))])
                    k, at = k + 1, to
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield _record([block(part, k, held)])

    dealt = df.mapInArrow(deal, "side long, along double, vec_id long, label int, vector array<long>")
    parts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // (4 * most))))
    ordered = dealt.repartitionByRange(parts, "side", "along", "vec_id").sortWithinPartitions("side", "along", "vec_id")
    return checkpointed(ordered.mapInArrow(cut, ROWS), name)


_KINDS = {"block": pa.int64(), "upper": pa.int64(), "size": pa.int32(), "ids": pa.binary(), "row_labels": pa.binary(), "vectors": pa.binary(), "low": pa.list_(pa.float64()), "high": pa.list_(pa.float64()), "centre": pa.list_(pa.float64()), "radius": pa.float64(), "labels": pa.list_(pa.int32())}


def _record(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in _KINDS.items()], names=list(_KINDS))


class Nodes:
    """Boxes, balls and labels of many nodes."""

    def __init__(self, low, high, centre, radius, labels):
        self.low, self.high, self.centre = (np.array([np.asarray(v, float) for v in x]) for x in (low, high, centre))
        self.radius, self.labels = np.asarray(radius, float), [frozenset(x) for x in labels]

    def intervals(self, other: Nodes, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of any row of each node here and any row of node k there."""
        corners = np.stack([a * b for a in (self.low, self.high) for b in (other.low[k], other.high[k])])
        low, high = corners.min(0).sum(1), corners.max(0).sum(1)
        middle = self.centre @ other.centre[k]
        norm = np.sqrt((self.centre**2).sum(1))
        spread = norm * other.radius[k] + np.sqrt((other.centre[k] ** 2).sum()) * self.radius + self.radius * other.radius[k]
        slack = 1e-9 * (norm + self.radius) * (np.sqrt((other.centre[k] ** 2).sum()) + other.radius[k]) + 1e-6
        return np.maximum(low, middle - spread) - slack, np.minimum(high, middle + spread) + slack

    def fits(self, labels: frozenset, same: bool) -> np.ndarray:
        """Whether a node has a row of one of these labels, or one whose label is not the label of all of them."""
        return np.array([bool(own & labels) if same else len(own | labels) > 1 for own in self.labels])


def _hulls(tree: DataFrame) -> tuple[DataFrame, list[int], Nodes]:
    """A row for each upper node with its leaves' nodes, and the upper nodes' own boxes, balls and labels."""
    uppers = tree.groupBy("upper").agg(F.collect_list(F.struct("block", "low", "high", "centre", "radius", "labels")).alias("nodes"))  # at most FAN leaves each
    uppers = checkpointed(uppers, "uppers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for upper, nodes in zip(batch.column("upper").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
                low, high = np.min([x["low"] for x in nodes], 0), np.max([x["high"] for x in nodes], 0)
                middles = np.array([x["centre"] for x in nodes])
                centre = middles.mean(0)
                reach = max(np.sqrt(((m - centre) ** 2).sum()) + x["radius"] for m, x in zip(middles, nodes, strict=True))
                out.append({"upper": upper, "low": low, "high": high, "centre": centre, "radius": reach, "labels": sorted({y for x in nodes for y in x["labels"]})})
            names = ["upper", "low", "high", "centre", "radius", "labels"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], _KINDS[c]) for c in names], names=names)

    rows = uppers.mapInArrow(run, f"upper long, {NODE}").limit(UPPER_MOST + 1).collect()
    if len(rows) > UPPER_MOST:
        raise ValueError(f"more than {UPPER_MOST} upper nodes: raise LEAF or FAN")
    return uppers, [r.upper for r in rows], Nodes(*([r[c] for r in rows] for c in ("low", "high", "centre", "radius", "labels")))


WINDOWS = "windows array<struct<row:int,w:int,low:long,high:long>>"


def _ends(windows: list[dict]) -> tuple[int, int]:
    return min((x["low"] for x in windows), default=1), max((x["high"] for x in windows), default=0)


def _group(r: dict) -> Nodes:
    return Nodes([r["low"]], [r["high"]], [r["centre"]], [r["radius"]], [r["labels"]])


def _pairs(groups: DataFrame, tree: tuple[DataFrame, list[int], Nodes], same: bool, seeds: bool) -> DataFrame:
    """Leaf pairs (group, block) whose score interval meets a window; with seeds, a few of greatest middle score each."""
    uppers, names, hulls = tree
    known = groups.sparkSession.sparkContext.broadcast((np.array(names, np.int64), hulls))

    def against(own: Nodes, nodes: Nodes, windows: list[dict], most: int) -> np.ndarray:
        least, greatest = _ends(windows)
        low, high = nodes.intervals(own, 0)
        meet = np.flatnonzero((high >= least) & (low <= greatest) & nodes.fits(own.labels[0], same))
        if seeds:
            meet = meet[np.argsort(-(nodes.centre[meet] @ own.centre[0]), kind="stable")[:most]]
        return meet

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nodes = known.value
        for batch in batches:
            for r in batch.to_pylist():
                if r["windows"]:
                    found = ids[against(_group(r), nodes, r["windows"], 2)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), r["block"])), pa.array(found)], names=["group", "upper"])

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                nodes = Nodes(*([x[c] for x in r["nodes"]] for c in ("low", "high", "centre", "radius", "labels")))
                own = _group(r)
                found = against(own, nodes, r["windows"], SEEDS)
                blocks = np.array([x["block"] for x in r["nodes"]], np.int64)[found]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), r["group"])), pa.array(blocks), pa.array(nodes.centre[found] @ own.centre[0])], names=["group", "block", "middle"])

    light = groups.select("block", "low", "high", "centre", "radius", "labels", "windows")
    first = light.mapInArrow(coarse, "group long, upper long")
    met = first.join(light.withColumnRenamed("block", "group"), "group").join(uppers, "upper").mapInArrow(fine, "group long, block long, middle double")
    if seeds:
        order = Window.partitionBy("group").orderBy(F.desc("middle"), "block")
        met = met.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= SEEDS)
    return met.select("group", "block")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where no sum can pass 2**53, else in longs."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.einsum("ik,jk->ij", a.astype(np.int64), b.astype(np.int64))


def _scored(groups: DataFrame, leaf_table: DataFrame, pairs: DataFrame, dim: int, same: bool, keep: int) -> DataFrame:
    """The best `keep` rows of each window: group, row, w, nth, anchor_id, id, score."""
    names = ["group", "row", "w", "anchor_id", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a_ids, ids = np.frombuffer(r["a_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                a_labels, labels = np.frombuffer(r["a_labels"], "<i4"), np.frombuffer(r["row_labels"], "<i4")
                scores = _products(np.frombuffer(r["a_vectors"], "<i4").reshape(-1, dim), np.frombuffer(r["vectors"], "<i4").reshape(-1, dim))
                fit = ((a_labels[:, None] == labels) == same) & (a_ids[:, None] != ids)
                for w in sorted({x["w"] for x in r["windows"]}):
                    low, high = np.full(len(a_ids), 1), np.full(len(a_ids), 0)
                    for x in r["windows"]:
                        if x["w"] == w:
                            low[x["row"]], high[x["row"]] = x["low"], x["high"]
                    row, col = np.nonzero(fit & (scores >= low[:, None]) & (scores <= high[:, None]))
                    order = np.lexsort((ids[col], -scores[row, col], row))
                    row, col = row[order], col[order]
                    best = np.arange(len(row)) - np.searchsorted(row, row) < keep
                    row, col = row[best], col[best]
                    columns = [np.full(len(row), r["group"]), row.astype(np.int32), np.full(len(row), w, np.int32), a_ids[row], ids[col], scores[row, col]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    asked = groups.select(F.col("block").alias("group"), F.col("ids").alias("a_ids"), F.col("row_labels").alias("a_labels"), F.col("vectors").alias("a_vectors"), "windows")
    both = pairs.join(asked, "group").join(leaf_table.select("block", "ids", "row_labels", "vectors"), "block")
    found = both.mapInArrow(run, "group long, row int, w int, anchor_id long, id long, score long")
    order = Window.partitionBy("group", "row", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= keep)


def _best(groups: DataFrame, leaf_table: DataFrame, tree: tuple[DataFrame, list[int], Nodes], dim: int, same: bool, keep: int, name: str) -> DataFrame:
    """Two rounds: the seeds raise the windows, then all leaf pairs that still meet one are scored."""
    seeds = _scored(groups, leaf_table, _pairs(groups, tree, same, True), dim, same, keep)
    worst = seeds.filter(F.col("nth") == keep).groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row", "w").alias("k"), "score"))).alias("worst"))  # at most GROUP x windows
    raised = F.transform("windows", lambda x: F.struct(x["row"].alias("row"), x["w"].alias("w"), F.greatest(x["low"], F.try_element_at("worst", F.struct(x["row"].alias("row"), x["w"].alias("w")))).alias("low"), x["high"].alias("high")))
    asked = groups.join(worst.withColumnRenamed("group", "block"), "block", "left").withColumn("windows", raised).drop("worst")
    asked = checkpointed(asked, f"{name}-asked")
    return _scored(asked, leaf_table, _pairs(asked, tree, same, False), dim, same, keep)


def hard_negatives(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """For each anchor (an id divisible by `every`) and each of its best positives, the best negatives that score from `least` percent of the positive's score up to it.

    df: vec_id, label and vector (whole numbers), without nulls. Returns anchor_id, positive_id, rank, negative_id, positive_score and negative_score.
    """
    spark = df.sparkSession
    anchors = df.filter(F.col("vec_id") % every == 0)
    size = df.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"), F.max(F.size("vector")).alias("dim")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size.asked:
        return spark.createDataFrame([], schema)
    dim = max(1, size.dim)
    table = leaves(df, size.n, dim, LEAF, "candidates")
    groups = leaves(anchors, size.asked, dim, GROUP, "anchors")
    tree = _hulls(table)
    everything = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct(i.cast("int").alias("row"), F.lit(0).alias("w"), F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high")))
    near = checkpointed(_best(groups.withColumn("windows", everything), table, tree, dim, True, positives, "positives"), "positives")
    # 80 p <= 100 n in whole numbers: n is at least 80 p / 100, rounded up; written so that no product overflows. No n lies between for a p below zero.
    window = F.struct(F.col("row"), F.col("nth").alias("w"), F.expr(f"{least} * (score div 100) + ({least} * (score % 100) + 99) div 100").alias("low"), F.col("score").alias("high"))
    windows = near.filter(F.col("score") >= 0).groupBy("group").agg(F.collect_list(window).alias("windows")).withColumnRenamed("group", "block")  # at most GROUP x positives
    asked = checkpointed(groups.join(windows, "block"), "negatives-asked")
    hard = _best(asked, table, tree, dim, False, negatives, "negatives")
    by = near.select("group", "row", F.col("nth").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(by, ["group", "row", "w"]).select("anchor_id", "positive_id", F.col("nth").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
