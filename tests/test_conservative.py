"""Conservative remapping: batched clipping against one pair at a time, conservation, and the order of the error."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from graticula.operators import polygons
from graticula.operators.mesh import structured_cells
from graticula.sources.grids import regular_lonlat


def mesh(spark, nx, ny):
    p = regular_lonlat(spark, nx, ny)
    cells = structured_cells(p, nx)
    return polygons.rings(cells, p), cells


def serial_clip(ring, by):
    for a, b in zip(by, np.roll(by, -1, axis=0), strict=True):
        n, out = np.cross(a, b), []
        for p, q in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            s, t = p @ n, q @ n
            if s >= 0:
                out.append(p)
            if s * t < 0:
                x = p * abs(t) + q * abs(s)
                out.append(x / np.linalg.norm(x))
        if len(out) < 3:
            return np.zeros((0, 3))
        ring = np.array(out)
    return ring


def test_batches_clip_as_single_pairs():
    rng = np.random.default_rng(2)
    subjects, clips = [], []
    for _ in range(300):
        both = []
        for _ in range(2):
            centre = rng.normal(size=3)
            centre = np.array([1.0, 0.3, 0.2]) + 0.15 * centre / np.linalg.norm(centre)
            n = int(rng.integers(3, 8))
            e1 = np.cross(centre, [0.0, 0.0, 1.0])
            e2 = np.cross(centre, e1)
            at = np.sort(rng.uniform(0, 2 * np.pi, n))
            ring = centre + 0.2 * (np.cos(at)[:, None] * e1 + np.sin(at)[:, None] * e2)
            both.append(polygons.tidy(ring / np.linalg.norm(ring, axis=1)[:, None]))
        subjects.append(both[0]), clips.append(both[1])
    a = polygons.Rings(np.concatenate(subjects), np.array([len(x) for x in subjects]))
    b = polygons.Rings(np.concatenate(clips), np.array([len(x) for x in clips]))
    got = a.clipped(b)
    want = [serial_clip(x, y) for x, y in zip(subjects, clips, strict=True)]
    assert np.allclose(got.areas(), [polygons.signed_area(x) for x in want], atol=1e-12)
    assert (got.areas() > 1e-4).sum() > 100
    # moments of a small polygon: about its area times a point inside
    m, area = a.moments(), a.areas()
    big = area > 1e-3
    assert np.allclose(np.linalg.norm(m[big], axis=1) / area[big], 1, atol=0.03)


def error(spark, n, order, field, exact):
    (source, cells), (target, _) = mesh(spark, 3 * n, n + 1), mesh(spark, 4 * n, 2 * n + 1)
    w = polygons.conservative(source, target) if order == 1 else polygons.conservative_second_order(source, target, polygons.neighbours(cells))
    mean = lambda m: m.select("cell", "area", *((F.col(f"m{c}") / F.col("area")).alias(c) for c in "xyz"))
    s, t = mean(polygons.moments(source)).withColumn("f", field), mean(polygons.moments(target)).withColumn("g", exact)
    out = w.join(s.select(F.col("cell").alias("col"), "f"), "col").groupBy("row").agg(F.sum(F.col("w") * F.col("f")).alias("got"))
    pdf = out.join(t.withColumnRenamed("cell", "row"), "row").toPandas()
    mass = s.agg(F.sum(F.col("f") * F.col("area"))).first()[0]
    assert abs((pdf.got * pdf.area).sum() - mass) < 1e-11
    assert abs(pdf.area.sum() - 4 * np.pi) < 1e-11
    return float(np.sqrt(((pdf.got - pdf.g) ** 2 * pdf.area).sum()))


def test_order_of_the_error(spark):
    linear = F.col("x") + 2 * F.col("y") - F.col("z") / 2  # the mean over a cell is the value at its mean position
    one = [error(spark, n, 1, linear, linear) for n in (8, 16)]
    two = [error(spark, n, 2, linear, linear) for n in (8, 16)]
    assert two[0] < one[0] / 3 and 1.6 < one[0] / one[1] < 2.6 and two[0] / two[1] > 3
    assert error(spark, 8, 2, F.lit(3.5), F.lit(3.5)) < 1e-12


def test_gradients_of_linear_fields(spark):
    source, cells = mesh(spark, 24, 13)
    g = polygons.cell_gradients(source, polygons.neighbours(cells)).toPandas()
    m = polygons.moments(source).toPandas().set_index("cell")
    p = m[["mx", "my", "mz"]].div(m.area, axis=0)
    q = np.array([1.0, -2.0, 0.5])
    f = p.to_numpy() @ q
    g["v"] = f[p.index.get_indexer(g["of"])]
    got = g.assign(**{c: g[c] * g.v for c in ("gx", "gy", "gz")}).groupby("cell")[["gx", "gy", "gz"]].sum()
    u = p.loc[got.index].to_numpy()
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = q - (u @ q)[:, None] * u
    assert np.abs((got.to_numpy() * u).sum(1)).max() < 1e-12
    assert np.abs(got.to_numpy() - want).max() < 0.15
    # one neighbour spans no plane: no gradient
    few = polygons.cell_gradients(source, spark.createDataFrame([(5, 6)], "cell long, near long"))
    assert few.count() == 0
