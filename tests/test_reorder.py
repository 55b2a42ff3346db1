"""The order by levels against the serial breadth-first search."""

from __future__ import annotations

import random

import pytest

from graticula.operators import reorder


def serial(n, links, starts):
    near = {k: set() for k in range(n)}
    for a, b in links:
        if a != b:
            near[a].add(b), near[b].add(a)
    out, seen = [], set()
    for s in sorted(starts, key=lambda s: (len(near[s]), s)):
        queue = [s]
        seen.add(s)
        while queue:
            k = queue.pop(0)
            out.append(k)
            new = sorted(near[k] - seen, key=lambda x: (len(near[x]), x))
            seen.update(new)
            queue += new
    return out


@pytest.mark.parametrize("seed", [1])
def test_order_is_the_serial_one(spark, seed):
    rng = random.Random(seed)
    n = 120
    links = [(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(150)) if a // 40 == b // 40]
    nodes = spark.range(n).withColumnRenamed("id", "node")
    both = spark.createDataFrame([*links, *((b, a) for a, b in links), (3, 3)], "a long, b long").repartition(3)
    starts = [tuple(r) for r in reorder.far_starts(nodes, both).collect()]
    order = {r.node: r.number for r in reorder.cuthill_mckee(nodes, both, spark.createDataFrame(starts, "node long, component long"), reverse=False).collect()}
    assert sorted(order, key=order.get) == serial(n, links, [s for s, _ in starts])
    back = {r.node: r.number for r in reorder.cuthill_mckee(nodes, both).collect()}
    assert back == {k: n - 1 - v for k, v in order.items()}


def test_components(spark):
    links = [(k, k + 1) for k in range(200) if k % 50 != 49] + [(301, 300), (300, 400), (400, 399)]
    nodes = spark.range(420).withColumnRenamed("id", "node")
    got = {r.node: r.component for r in reorder.components(nodes, spark.createDataFrame([*links, *((b, a) for a, b in links)], "a long, b long")).collect()}
    assert all(got[k] == k // 50 * 50 for k in range(200)) and {got[k] for k in (300, 301, 399, 400)} == {300} and got[410] == 410


def test_bandwidth_of_a_shuffled_strip(spark):
    rng = random.Random(4)
    name = list(range(45))
    rng.shuffle(name)
    at = lambda i, j: name[3 * i + j]
    links = [(at(i, j), at(i + 1, j)) for i in range(14) for j in range(3)] + [(at(i, j), at(i, j + 1)) for i in range(15) for j in range(2)]
    both = spark.createDataFrame([*links, *((b, a) for a, b in links)], "a long, b long")
    nodes = spark.range(45).withColumnRenamed("id", "node")
    assert reorder.bandwidth(both, reorder.cuthill_mckee(nodes, both)).first().bandwidth <= 5
    assert reorder.cuthill_mckee(nodes.filter("false"), both.filter("false")).count() == 0
