"""Pairs of polygons that are clipped: all that overlap, few others; rings of regular grids."""

from __future__ import annotations

import numpy as np

from graticula.operators import polygons
from graticula.operators.mesh import structured_cells
from graticula.sources.grids import regular_lonlat


def test_few_pairs_are_clipped_in_vain(spark):
    source, target = (polygons.regular_rings(regular_lonlat(spark, nx, ny), nx) for nx, ny in ((96, 49), (34, 18)))
    overlapping = {(r.row, r.col) for r in polygons.overlaps(source, target).select("row", "col").collect()}
    pairs = [(r.row, r.col) for r in polygons.meeting(source, target).select("row", "col").collect()]
    assert len(pairs) == len(set(pairs)) and overlapping <= set(pairs)
    assert len(pairs) < 2 * len(overlapping)


def test_rings_of_regular_grids(spark):
    points = regular_lonlat(spark, 14, 7)
    got = polygons.regular_rings(points, 14)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, polygons.rings(structured_cells(points, 14), points).collect()))


def test_overlaps_of_any_size_at_poles_and_the_date_line(spark):
    rng = np.random.default_rng(11)

    def some(n):
        out = []
        for k in range(n):
            c = np.array([(0, 0, 1), (0, 0, -1), (-1, 0, 0), (1, 0, 0)][k % 4]) + rng.normal(size=3) * 0.2
            c /= np.linalg.norm(c)
            e1 = np.cross(c, [0.3, 0.8, 0.52])
            e1 /= np.linalg.norm(e1)
            e2 = np.cross(c, e1)
            at = np.sort(rng.uniform(0, 2 * np.pi, int(rng.integers(3, 7))))
            p = c + 10 ** rng.uniform(-2, -0.3) * (np.cos(at)[:, None] * e1 + np.sin(at)[:, None] * e2)
            p /= np.linalg.norm(p, axis=1)[:, None]
            out.append((k, [(float(np.degrees(np.arctan2(y, x))) + 360.0 * (k % 3 - 1), float(np.degrees(np.arcsin(z)))) for x, y, z in p]))
        # one with a corner at the pole, its longitude far from the others'
        return [*out, (n, [(10.0, 80.0), (30.0, 80.0), (200.0, 90.0)]), (n + 1, [(0.0, 85.0), (120.0, 85.0), (240.0, 85.0)])]

    a, b = some(60), some(50)
    kind = "cell long, ring array<struct<lon double, lat double>>"
    got = {(r.row, r.col): r.area for r in polygons.overlaps(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()}
    tidy = lambda ps: {k: polygons.tidy(polygons.unit(*np.array(r).T)) for k, r in ps}
    s, t = tidy(a), tidy(b)
    want = {(j, i): area for j, y in t.items() for i, x in s.items() if (area := polygons.signed_area(polygons.clip(x, y))) > 1e-12}
    assert set(want) <= set(got) and len(want) > 100
    assert max(abs(got[k] - v) for k, v in want.items()) < 1e-12
    assert all(v < 2e-12 for k, v in got.items() if k not in want)
