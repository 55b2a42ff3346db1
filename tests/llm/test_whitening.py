"""Whitening against NumPy's decompositions."""

from __future__ import annotations

import numpy as np
import pytest

from graticula.llm import whitening


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "s") for r in rows], f"vec_id long, embedding array<{kind}>, x int, r string").repartition(5)


def test_jacobi_is_the_svd():
    rng = np.random.default_rng(0)
    for d, n in ((1, 3), (2, 5), (7, 30), (16, 16), (33, 100)):
        a = rng.normal(size=(n, d)) * 10.0 ** rng.integers(-6, 3, d)
        sigma, v = whitening.jacobi(np.linalg.qr(a, "r"))
        assert np.allclose(sigma, np.linalg.svd(a)[1], rtol=1e-9, atol=0 if d < 33 else 1e-12 * sigma[0])
        assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13
        y = a @ v
        assert np.abs(y.T @ y - np.diag(sigma**2)).max() < 1e-12 * sigma[0] ** 2


@pytest.mark.parametrize(("block", "fan"), [(4096, 16), (7, 2)])
def test_whitening(spark, monkeypatch, block, fan):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "FAN", fan)
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(12, 12))
    vectors = (rng.normal(size=(300, 12)) @ mix).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(5, vectors[5].tolist()), (None, vectors[6].tolist())]
    bad = [(900, None), (901, [float("nan"), *vectors[0].tolist()[1:]]), (902, [None, *vectors[0].tolist()[1:]]), (903, [float("-inf"), *vectors[0].tolist()[1:]])]
    got = whitening.whitened(table(spark, rows + bad)).collect()
    assert len(got) == len(rows)
    x = np.floor(1024 * np.array([v for _, v in rows], np.float64)).astype(int) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    want = {k: (y, dev) for (k, _), y, dev in zip(rows, c @ u[:, :8] / np.sqrt(e[:8]), ((n * x - s) ** 2).sum(1), strict=True)}
    turn = np.sign(sum(np.array(r.coordinates) * want[r.vec_id][0] for r in got))
    for r in got:
        y, dev = want[r.vec_id]
        assert np.allclose(np.array(r.coordinates) * turn, y, atol=1e-9) and int(r.deviation) == dev and r.n == n
        assert np.allclose(r.explained, e[:8] / e.sum(), rtol=1e-10) and r.identity_error < 1e-10


def test_exact_deviation_beyond_64_bits(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [5e8, -1.0])]
    got = {r.vec_id: int(r.deviation) for r in whitening.whitened(table(spark, rows, "double")).collect()}
    x = [[int(1024 * v) + 100_000 for v in r[1]] for r in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert got == {r[0]: sum((3 * v - t) ** 2 for v, t in zip(y, s, strict=True)) for r, y in zip(rows, x, strict=True)}
    assert max(got.values()) > 1 << 63


def test_components_without_variance_are_left_out(spark):
    rows = [(k, [float(k), 2.0 * k, 7.0, float(k % 3)]) for k in range(40)]
    got = whitening.whitened(table(spark, rows)).collect()
    assert {len(r.coordinates) for r in got} == {2} and abs(sum(got[0].explained) - 1) < 1e-12
    for some in ([], rows[:1], rows[:1] * 4, [(1, None)], [(1, [])]):
        assert whitening.whitened(table(spark, some)).count() == 0


def test_what_is_refused(spark):
    with pytest.raises(ValueError, match="lengths"):
        whitening.whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>").coalesce(2).repartitionByRange(2, "vec_id"))
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(table(spark, [(1, [1e20]), (2, [1.0])])).collect()


def test_query(spark):
    rng = np.random.default_rng(4)
    folder = spark.conf.get("spark.checkpoint.dir") + "/whitening"
    spark.createDataFrame([(k, rng.normal(size=10).tolist(), 0) for k in range(50)], "vec_id long, embedding array<float>, label int").write.parquet(folder + "/embeddings.parquet")
    rows = whitening.op11_jacobi_whitening(spark, folder).collect()
    assert len(rows) == 400 and {r.component for r in rows} == set(range(1, 9)) and len({r.identity_error for r in rows}) == 1
    for k in range(1, 9):
        y = np.array([r.whitened for r in rows if r.component == k])
        assert abs(y.mean()) < 1e-9 and abs(y.var() - 1) < 1e-9
