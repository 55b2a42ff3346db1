"""Rings against walks followed one edge at a time."""

from __future__ import annotations

import collections
import random

import pytest

from graticula.operators.rings import ring_lines, rings


def groups(edges):
    """Groups of edges that hang together by nodes."""
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        up[find(a)] = find(b)
    return len({find(a) for a, _ in edges})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walks_use_every_edge_once(spark, seed):
    rng = random.Random(seed)
    rows = []
    for part in range(4):
        used = set()
        for _ in range(rng.randrange(1, 9)):
            cycle = rng.sample(range(30 if part else 200), rng.randrange(3, 14))
            steps = set(zip(cycle, cycle[1:] + cycle[:1], strict=True))
            if not steps & used:
                used |= steps
        rows += [(part, a, b) for a, b in used]
    df = spark.createDataFrame(rows, "part int, a long, b long").repartition(3)
    for splice in (True, False):
        walks = collections.defaultdict(dict)
        for r in rings(df, splice).collect():
            walks[r.part, r.ring][r.position] = r.node
        got = []
        for (part, _), walk in walks.items():
            nodes = [walk[k] for k in range(len(walk))]
            steps = list(zip(nodes, nodes[1:] + nodes[:1], strict=True))
            assert steps[0] == min(steps)
            got += [(part, *e) for e in steps]
        assert sorted(got) == sorted(rows)
        for part in range(4):
            mine = [(a, b) for p, a, b in rows if p == part]
            number = sum(p == part for p, _ in walks)
            assert number == groups(mine) if splice else number >= groups(mine)
            firsts = [walks[part, k][0] for k in range(number)]
            assert firsts == sorted(firsts)


def test_one_long_ring_takes_few_rounds(spark):
    n = 3000
    df = spark.range(n).selectExpr("0 AS part", "id * 7 % 3000 AS a", "(id * 7 + 7) % 3000 AS b")
    got = {r.position: r.node for r in rings(df).collect()}
    assert [got[k] for k in range(n)] == [k * 7 % n for k in range(n)]


def test_open_edges_are_refused_and_none_give_none(spark):
    with pytest.raises(Exception, match="do not close"):
        rings(spark.createDataFrame([(0, 1, 2), (0, 2, 3)], "part int, a long, b long")).collect()
    assert rings(spark.createDataFrame([], "part int, a long, b long")).count() == 0


def test_lines(spark):
    walks = rings(spark.createDataFrame([(5, 1, 2), (5, 2, 3), (5, 3, 1)], "part int, a long, b long"))
    nodes = spark.createDataFrame([(k, 10.0 * k, -k / 2) for k in (1, 2, 3)], "gidx long, lon double, lat double")
    assert [r.value for r in ring_lines(walks, nodes).collect()] == ["5 0 10.0,-0.5 20.0,-1.0 30.0,-1.5 10.0,-0.5"]
