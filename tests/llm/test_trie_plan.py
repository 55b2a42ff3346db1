"""The trie's self-join: the size of its plan, and its links at the sign bit."""

from __future__ import annotations

import numpy as np

from graticula.llm import simhash


def test_keys_of_the_tries_are_one_mask_each(spark):
    fps = spark.createDataFrame([(1,)], "fp long")
    plan = simhash.near_links(fps)._jdf.queryExecution().optimizedPlan().toString()
    tries = len(simhash.plans(2))
    assert plan.count("&") <= 2 * tries and "shift" not in plan


def test_links_with_all_leading_bits(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64) | np.uint64(1 << 63)
    fps = set(base.tolist())
    for x in base.tolist():
        a, b = (int(v) for v in rng.choice(64, 2, replace=False))
        fps |= {x ^ (1 << a) ^ (1 << b), x ^ (1 << 63), x ^ (1 << 20) ^ (1 << 21)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = [(r.a & ((1 << 64) - 1), r.b & ((1 << 64) - 1)) for r in simhash.near_links(df).withColumnsRenamed({"fp_a": "a", "fp_b": "b"}).collect()]
    at = {x: k for k, x in enumerate(fps)}
    roots = lambda links: simhash._roots(len(fps), np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links])).tolist()
    assert roots(got) == roots([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
