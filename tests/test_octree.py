"""Searches where densities and sizes differ by orders of magnitude."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticula.operators import elements, interpolation, octree, polygons, search


def unit(lon, lat):
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(a) * np.cos(b), np.sin(a) * np.cos(b), np.sin(b)], 1)


def frame(spark, lon, lat):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lon, lat, strict=True))], "gidx long, lon double, lat double")


@pytest.mark.parametrize("k", [4])
def test_nearest_over_clusters(spark, monkeypatch, k):
    rng = np.random.default_rng(k)
    lon = np.concatenate([rng.uniform(0, 360, 60), 50 + rng.uniform(0, 0.01, 1500), [10.0] * 30, 359.999 + rng.uniform(0, 0.002, 40)])
    lat = np.concatenate([np.degrees(np.arcsin(rng.uniform(-1, 1, 60))), 40 + rng.uniform(0, 0.01, 1500), [-20.0] * 30, rng.uniform(-0.001, 0.001, 40)])
    at = np.concatenate([rng.integers(0, len(lon), 40), np.arange(1560, 1575)])
    tlon, tlat = np.concatenate([lon[at], rng.uniform(0, 360, 20), [50.02, 10.0]]), np.concatenate([lat[at], rng.uniform(-90, 90, 20), [40.0, -20.0]])
    made = []
    monkeypatch.setattr(octree, "_near", lambda *a, f=octree._near: made.append(f(*a)) or made[-1])
    got = {}
    for r in octree.nearest(frame(spark, tlon, tlat), frame(spark, lon, lat), k).collect():
        got.setdefault(r.target, {})[r["rank"]] = (r.source, r.d)
    d = np.round(np.sqrt(((unit(tlon, tlat)[:, None] - unit(lon, lat)[None]) ** 2).sum(2)), 12)
    for t in range(len(tlon)):
        best = np.lexsort((np.arange(len(lon)), d[t]))[:k]
        assert [got[t][n + 1][0] for n in range(k)] == best.tolist()
    # the cells that the last step leaves to each target hold few points, but where points coincide
    last = made[-1].groupBy("target").agg(F.sum("n").alias("n")).collect()
    assert np.median([r.n for r in last]) <= 50


def test_nearest_of_few_points(spark):
    t = frame(spark, [0.0, 90.0], [0.0, 10.0])
    assert octree.nearest(t, t, 5).count() == 4
    assert octree.nearest(t, t.filter("false"), 5).count() == 0 and octree.nearest(t.filter("false"), t, 5).count() == 0


def ring(west, south, east, north):
    return [{"x": float(a), "y": float(b)} for a, b in ((west, south), (east, south), (east, north), (west, north), (west, south))]


def test_one_polygon_of_the_sphere_among_small_ones(spark):
    rng = np.random.default_rng(3)
    small = [(k, ring(a, b, a + 0.01, b + 0.01)) for k, (a, b) in enumerate(zip(rng.uniform(0, 359, 2000), rng.uniform(-89, 88, 2000), strict=True))]
    table = spark.createDataFrame([*small, (9999, ring(0.0, -90.0, 360.0, 90.0))], "polygon long, ring array<struct<x:double,y:double>>")
    boxed = octree.in_cells(table.withColumn("lev", octree.own_level(F.array_max("ring.x") - F.array_min("ring.x"), 720.0)), 720.0, tx=(F.array_min("ring.x"), F.array_max("ring.x")), ty=(F.array_min("ring.y"), F.array_max("ring.y")))
    assert boxed.count() <= 4 * 2001
    picks = rng.integers(0, 2000, 300)
    lon = [small[k][1][0]["x"] + 0.005 for k in picks] + [10.0]
    lat = [small[k][1][0]["y"] + 0.005 for k in picks] + [-89.5]
    got = {r.gidx: r.polygon for r in search.locate_polygon(frame(spark, lon, lat), table).collect()}
    for n, (a, b) in enumerate(zip(lon, lat, strict=True)):
        want = [k for k, p in small if p[0]["x"] <= a <= p[1]["x"] and p[0]["y"] <= b <= p[2]["y"]]
        assert got[n] == (min(want) if want else 9999)


def test_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(5)

    def boxes(n):
        w, s, size = rng.uniform(0, 359, n), rng.uniform(-89, 80, n), 10.0 ** rng.uniform(-2, 1.5, n)
        return [(k, float(a), float(a + z), float(b), float(min(90, b + z))) for k, (a, b, z) in enumerate(zip(w, s, size, strict=True))]

    source, target = boxes(150), boxes(100)
    kind = "gidx long, west double, east double, south double, north double"
    got = {(r.row, r.col): r.w for r in interpolation.grid_box_average(spark.createDataFrame(source, kind), spark.createDataFrame(target, kind)).collect()}
    area = lambda w, e, s, n: np.radians(e - w) * (np.sin(np.radians(n)) - np.sin(np.radians(s)))
    want = {}
    for t, tw, te, ts, tn in target:
        for c, sw, se, ss, sn in source:
            for turn in (-360, 0, 360):
                w, e, s, n = max(tw, sw + turn), min(te, se + turn), max(ts, ss), min(tn, sn)
                if e > w and n > s:
                    want[t, c] = want.get((t, c), 0) + area(w, e, s, n) / area(tw, te, ts, tn)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_overlaps_of_all_sizes(spark):
    rng = np.random.default_rng(7)

    def cells(n, big):
        out = []
        for k in range(n):
            lon, lat, z = rng.uniform(0, 70), rng.uniform(-35, 35), (60.0 if k == 0 and big else 10.0 ** rng.uniform(-0.5, 1.2))
            lat = 0.0 if k == 0 and big else lat
            out.append((k, [{"lon": float(lon + a), "lat": float(max(-89.0, min(89.0, lat + b)))} for a, b in ((0.0, 0.0), (z, 0.0), (z, z / 2), (0.0, z / 2))]))
        return out

    kind = "cell long, ring array<struct<lon:double,lat:double>>"
    a, b = cells(120, True), cells(80, False)
    got = {(r.row, r.col): r.area for r in polygons.overlaps(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()}
    shape = lambda c: polygons.tidy(polygons.unit(*np.array([[p["lon"], p["lat"]] for p in c[1]]).T))
    want = {}
    for t in b:
        for s in a:
            part = polygons.signed_area(polygons.clip(shape(s), shape(t)))
            if part > 1e-14:
                want[t[0], s[0]] = part
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(want) > 100


def test_elements_of_all_sizes(spark):
    nodes = spark.createDataFrame([(0, -40.0, -30.0), (1, 40.0, -30.0), (2, 0.0, 40.0), (3, 60.0, 0.0), (4, 60.01, 0.0), (5, 60.0, 0.01)], "gidx long, lon double, lat double")
    cells = spark.createDataFrame([(0, [0, 1, 2]), (1, [3, 4, 5])], "cell long, nodes array<long>")
    points = frame(spark, [0.0, 60.003, 61.0], [0.0, 0.003, 0.0])
    got = {r.row: r.cell for r in elements.element_hits(points, elements.corners(cells, nodes)).collect()}
    assert got == {0: 0, 1: 1}
