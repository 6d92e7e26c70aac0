"""The bounded queue against a plain one."""

import random
from collections import deque

import pytest

from lodestar.operators.graph import frontier


def plain(links, start, counted, bound):
    queue, order, found = deque((n, None, 0) for n in start), {}, 0
    while queue and found < bound:
        node, parent, depth = queue.popleft()
        if node in order:
            continue
        order[node] = (parent, len(order) + 1, depth)
        if node in counted:
            found += 1
            queue.extend((b, node, depth + 1) for b in links.get(node, []))
    waits = {}
    for node, parent, depth in queue:
        if node not in order:
            waits.setdefault(node, (parent, None, depth))
    return order | waits


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(6)
    links = {a: rng.sample(range(300), rng.choice([0, 1, 3, 6])) for a in range(300)}
    counted = {n for n in range(300) if rng.random() < 0.6} | {0}
    frames = spark.createDataFrame([(a, k, b) for a, own in links.items() for k, b in enumerate(own)], "a long, place int, b long"), spark.createDataFrame([(0, 0), (7, 1)], "node long, place int"), spark.createDataFrame([(n,) for n in counted], "node long")
    return links, counted, frames


@pytest.mark.parametrize("bound", [0, 1, 2, 17, 90, 10_000])
def test_the_queue_equals_a_plain_one(graph, bound):
    links, counted, frames = graph
    rows = frontier(*frames, bound).collect()
    got = {r.node: (r.parent, r.number, r.depth) for r in rows}
    assert got == plain(links, [0, 7], counted, bound) and len(rows) == len(got)
    assert all((r.number is None) == (r.status == "not_visited_due_bound") and r.counted == (r.node in counted) for r in rows)


def test_no_start(spark, graph):
    links, counted, (edges, start, marked) = graph
    assert frontier(edges, start.limit(0), marked, 5).collect() == []
