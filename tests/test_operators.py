"""Literal cases and properties that must hold whatever the data."""

from __future__ import annotations

import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticula.functions import geometry, projections
from graticula.operators import clouds, elementwise, elements, exchange, fvm, interpolation, mesh, partition, polygons, search, sparse, spectral, statistics, structured
from graticula.plans.remap import Remap
from graticula.sources import grids, records
from graticula.streaming import windows

RANKS = {0: ([2, 0, 0, 0, 1], [9, 1, 2, 3, 4]), 1: ([0, 1, 1, 1, 2, 2], [3, 4, 5, 6, 7, 8]), 2: ([1, 1, 2, 2, 2, 0, 0], [5, 6, 7, 8, 9, 1, 2])}


@pytest.fixture(scope="module")
def ring(spark):
    """Nine points in a ring on three ranks, with replicas of the neighbours."""
    rows = [(r, k, p, g, 10.0 * g if p == r else 0.0, p != r) for r, (parts, ids) in RANKS.items() for k, (p, g) in enumerate(zip(parts, ids, strict=True))]
    return spark.createDataFrame(rows, "rank int, local int, part int, gidx long, value double, ghost boolean")


def test_imports_need_no_session():
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], timeout=120).returncode == 0


def test_exchange_on_a_ring(ring):
    out = exchange.halo_exchange(ring).collect()
    assert all(r.value == 10.0 * r.gidx for r in out) and len(out) == 18
    assert [r.value for r in exchange.gather(ring).collect()] == [10.0 * k for k in range(1, 10)]
    ones = ring.withColumn("value", F.lit(1.0))
    back = exchange.halo_exchange_adjoint(ones).collect()
    assert sum(r.value for r in back) == 18 and all(r.value == 0 for r in back if r.ghost)


def test_halo_adjoint_identity(ring):
    x = ring.withColumn("value", (F.col("gidx") * 7 % 5 + F.col("rank")).cast("double"))
    y = exchange.halo_exchange(x)
    dot = lambda a, b: a.select("rank", "local", F.col("value").alias("a")).join(b.select("rank", "local", F.col("value").alias("b")), ["rank", "local"]).agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    assert math.isclose(dot(y, y), dot(x.withColumn("value", F.when(F.col("ghost"), 0.0).otherwise(F.col("value"))), exchange.halo_exchange_adjoint(y)))


def test_sparse_products(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (0, 2, -3.0), (1, 1, 2.0), (2, 2, 2.0)], "row long, col long, w double")
    x = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "gidx long, value double")
    values = lambda df: [r.value for r in df.orderBy("row").collect()]
    assert values(sparse.apply(a, x)) == [-7, 4, 6]
    y = spark.createDataFrame([(0, 4.0), (1, 5.0), (2, 6.0)], "row long, value double")
    assert values(sparse.apply_add(a, x, y)) == [-3, 9, 12]
    m = spark.createDataFrame([(i, j, float(2 * i + j + 1)) for i in range(3) for j in range(2)], "row long, col long, w double")
    assert [r.w for r in sparse.matmul(a, m).orderBy("row", "col").collect()] == [-13, -14, 6, 8, 10, 12]
    assert values(sparse.apply(a.filter("row < 2"), x, rows=spark.range(4).withColumnRenamed("id", "row"))) == [-7, 4, 0, 0]
    left = sum(r.value * v for r, v in zip(sparse.apply(a, x).orderBy("row").collect(), (1, 1, 1), strict=True))
    ones = x.withColumn("value", F.lit(1.0))
    assert left == sum(r.value * v for r, v in zip(sparse.adjoint(a, ones).orderBy("row").collect(), (1, 2, 3), strict=True))


@pytest.mark.parametrize(("policy", "want"), [("missing-if-all-missing", [1, 1]), ("missing-if-any-missing", [-9, -9]), ("missing-if-heaviest-missing", [1, -9])])
@pytest.mark.parametrize("kind", ["nan", "equals", "approximately-equals"])
def test_missing_values(spark, policy, kind, want):
    w = spark.createDataFrame([(0, 0, 0.81), (0, 1, 0.09), (0, 3, 0.09), (0, 4, 0.01), (1, 0, 0.01), (1, 1, 0.09), (1, 3, 0.09), (1, 4, 0.81)], "row long, col long, w double")
    mark = float("nan") if kind == "nan" else -5.0
    f = spark.createDataFrame([(k, mark if k == 4 else 1.0) for k in range(9)], "gidx long, value double")
    out = sparse.apply_missing(w, f, sparse.is_missing(F.col("value"), kind, -5.0, 1e-6), policy, -9.0).orderBy("row").collect()
    assert np.allclose([r.value for r in out], want)


def test_nearest_points(spark):
    at = [(0, 90), (30, 60), (60, 30), (90, 0), (120, -30), (150, -60), (180, -90)]
    pts = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(at)], "gidx long, lon double, lat double")
    q = spark.createDataFrame([(7, 89.9, 44.9)], "gidx long, lon double, lat double")
    assert [r.source for r in search.nearest(q, pts, 4).orderBy("rank").collect()] == [2, 1, 3, 0]
    assert search.nearest(q, pts, 99).count() == 7 and search.nearest(q, pts.filter("false"), 3).count() == 0


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = [(k, float(rng.uniform(0, 360)), float(np.degrees(np.arcsin(rng.uniform(-1, 1))))) for k in range(400)]
    df = spark.createDataFrame(pts, "gidx long, lon double, lat double")
    xyz = np.array([[math.cos(math.radians(a)) * math.cos(math.radians(b)), math.sin(math.radians(a)) * math.cos(math.radians(b)), math.sin(math.radians(b))] for _, a, b in pts])
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    want = {(i, int(j)) for i in range(400) for j in np.argsort(d[i])[:3]}
    assert {(r.target, r.source) for r in search.nearest(df, df, 3).collect()} == want


@pytest.mark.parametrize(("name", "points"), [("O8", 8 * 4 * 8 + 4 * 8 * 16 - 192), ("F8", 32 * 16), ("H4", 12 * 16), ("L12x7", 84), ("L6", 24 * 13), ("S8x4", 32), ("CS-LFR-4", 96)])
def test_grid_sizes(spark, name, points):
    g = grids.grid(spark, name)
    n = 2 * sum(20 + 4 * j for j in range(8)) if name == "O8" else points
    assert g.count() == n and g.select("gidx").distinct().count() == n
    box = g.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    assert math.isclose(box[0], -box[1], abs_tol=1e-9) and 0 <= box[2]
    # every other ring of the belt begins one step east of 0 and ends at 360
    assert box[3] <= 360 if name == "H4" else box[3] < 360


def test_grid_names_and_weights():
    assert math.isclose(sum(grids.gaussian_weights(16)), 1.0) and grids.uid({"a": 1, "b": 2}) == grids.uid({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        grids.grid(None, "nothing")
    x = grids.focus(-1.0, 1.0, 5, 2.0)
    assert x[0] == -1 and math.isclose(x[-1], 1) and x[2] - x[1] < x[1] - x[0]


@pytest.mark.parametrize("kind", ["bilinear", "bicubic", "biquasicubic"])
def test_structured_weights(spark, kind):
    t = spark.createDataFrame([(k, (k * 37.3) % 360, -88 + (k * 13.7) % 176) for k in range(50)], "gidx long, lon double, lat double")
    w = interpolation.structured(t, 72, 37, kind)
    assert all(math.isclose(r.s, 1) for r in w.groupBy("row").agg(F.sum("w").alias("s")).collect())
    f = grids.regular_lonlat(spark, 72, 37).select("gidx", F.col("lat").alias("value"))
    got = sparse.apply(w, f).join(t.filter("abs(lat) < 80").select(F.col("gidx").alias("row"), "lat"), "row").collect()
    assert got and all(math.isclose(r.value, r.lat, abs_tol=1e-9) for r in got)


def test_grid_box_weights_add_up(spark):
    w = interpolation.grid_box_average(interpolation._boxed(spark, 36, 19), interpolation._boxed(spark, 24, 13))
    assert all(math.isclose(r.s, 1, abs_tol=1e-12) for r in w.groupBy("row").agg(F.sum("w").alias("s")).collect())


def test_remap_plan(spark):
    src = grids.grid(spark, "L24x13").select("gidx", "lon", "lat")
    dst = grids.grid(spark, "H2").select("gidx", "lon", "lat")
    plan = Remap.by("k-nearest-neighbours", src, dst, 3, 1.0, rows=dst.select(F.col("gidx").alias("row"))).stored()
    out = plan.execute(src.select("gidx", F.lit(4.0).alias("value"))).collect()
    assert len(out) == 48 and all(math.isclose(r.value, 4.0) for r in out)
    with pytest.raises(ValueError):
        Remap.by("nothing")


def test_spherical_vector_keeps_speed(spark):
    src = grids.grid(spark, "L24x13").filter("abs(lat) < 80").select("gidx", "lon", "lat")
    dst = spark.createDataFrame([(0, 33.0, 41.0), (1, 200.0, -50.0)], "gidx long, lon double, lat double")
    w = interpolation.nearest_neighbour(src, dst)
    out = interpolation.spherical_vector(w, src, dst, src.select("gidx", F.lit(3.0).alias("u"), F.lit(4.0).alias("v"))).collect()
    assert all(math.isclose(math.hypot(r.u, r.v), 5.0) for r in out)


def test_masked_and_column_functions(spark):
    f = spark.createDataFrame([(g, lev, float(10 * g + lev), g == 1) for g in range(2) for lev in range(3)], "gidx long, lev int, value double, ghost boolean")
    out = elementwise.for_each_value_masked(f, F.col("ghost"), lambda v: v + 1, "value").orderBy("gidx", "lev").collect()
    assert [r.value for r in out] == [1, 2, 3, 10, 11, 12]
    for g in (elementwise.for_each_column(f, lambda a: F.reverse(a), "gidx"), elementwise.for_each_column_pandas(f, lambda v: v[::-1], "gidx")):
        assert [r.value for r in g.orderBy("gidx", "lev").collect()] == [2, 1, 0, 12, 11, 10]


def test_partitioners_balance(spark):
    p = grids.grid(spark, "O16").select("gidx", "lon", "lat")
    n = p.count()
    for parts in (1, 2, 7, 20):
        sizes = [r.n for r in partition.equal_regions(p, parts, n).groupBy("part").agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == n and len(sizes) == parts and max(sizes) - min(sizes) <= 1
        assert sum(partition.equal_region_layout(parts)) == parts
    board = partition.checkerboard(p, 12, 64, 32, n).groupBy("part").count().collect()
    assert len(board) == 12 and sum(r["count"] for r in board) == n


def test_mesh_counts(spark):
    nx, ny = 12, 7
    cells = mesh.structured_cells(grids.regular_lonlat(spark, nx, ny), nx)
    edges, nodes = mesh.facets(cells).count(), nx * ny
    assert nodes - edges + cells.count() == 0  # a closed band
    assert mesh.boundary(cells).count() == 2 * nx
    assert math.isclose(mesh.dual_volumes(cells, grids.regular_lonlat(spark, nx, ny)).agg(F.sum("volume")).first()[0], 360 * 180)


def test_constant_fields_have_no_gradient(spark):
    e, n = fvm.dual_edges(spark, 24, 11)
    g = fvm.gradient(e, n, n.select("node", F.lit(3.0).alias("value")), radius=1.0, poles=fvm.pole_faces(n, 15.0)).collect()
    assert all(abs(r.gx) < 1e-9 and abs(r.gy) < 1e-9 for r in g) and len(g) == 24 * 11


def test_wind_from_vorticity(spark):
    """A turning sphere: vorticity 2 sin(lat), wind cos(lat), so u cos(lat) = cos(lat)^2."""
    vor = spark.createDataFrame([(0, 1, 0, 2 / math.sqrt(3))], "m int, n int, part int, value double")
    none = vor.withColumn("value", F.lit(0.0))
    u, v = spectral.wind_spectra(vor, none, 3)
    lats = grids.gaussian_latitudes(4)
    t = spectral.legendre_table(spark, 4, lats)
    got = {(r.j, r.i): r.value for r in spectral.inverse_transform(u, t, [8] * 8).collect()}
    assert all(math.isclose(got[j, i], math.cos(math.radians(lats[j])) ** 2, abs_tol=1e-9) for j in range(8) for i in range(8))
    assert all(abs(r.value) < 1e-12 for r in v.collect())


def test_projection_round_trips(spark):
    p = spark.createDataFrame([(k, (k * 41.0) % 360, -70 + (k * 7.0) % 140) for k in range(40)], "gidx long, lon double, lat double")
    for q in (projections.Mercator(10.0, 20.0), projections.Schmidt(3.0), projections.LambertConformalConic(5.0, 50.0, 40.0, 40.0), projections.LonLat((40.0, -20.0), 0.0)):
        m = projections.projected(p, q)
        lon, lat = q.inverse(F.col("x"), F.col("y"))
        for r in m.select("lon", "lat", geometry.normalise(lon, -0.5).alias("a"), lat.alias("b")).collect():
            assert math.isclose(r.lat, r.b, abs_tol=1e-7) and math.isclose(r.lon, r.a, abs_tol=1e-6)


def test_hilbert_is_a_path(spark):
    df = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    rows = df.select("x", "y", geometry.hilbert(F.col("x"), F.col("y"), 4).alias("k")).orderBy("k").collect()
    assert [r.k for r in rows] == list(range(256))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_statistics_do_not_depend_on_partitions(spark):
    f = spark.range(500).select(F.col("id").alias("gidx"), F.lit(0).alias("lev"), F.lit(0).alias("var"), (F.col("id") * 0.1).alias("value"), (F.col("id") % 9 == 0).alias("ghost"))
    for op in (statistics.exact_total, lambda x: statistics.checksum(x, ["gidx", "value"]), statistics.ordered_fletcher):
        assert op(f.repartition(1)).first() == op(f.repartition(8)).first()
    bytes_ = [(7 * k) % 251 for k in range(500)]
    g = spark.createDataFrame(list(enumerate(bytes_)), "gidx long, value long")
    assert statistics.ordered_fletcher(g).first()[0] == statistics.fletcher16(bytes_)


def test_records(spark, tmp_path):
    p = grids.grid(spark, "L8x5")
    records.write_mesh(p, mesh.structured_cells(p, 8), f"{tmp_path}/mesh")
    nodes, cells = records.read_mesh(spark, f"{tmp_path}/mesh")
    assert nodes.count() == 40 and sorted(cells.select("nodes").collect()) == sorted(mesh.structured_cells(p, 8).select("nodes").collect())
    records.write_record({"p": p}, f"{tmp_path}/record")
    assert records.list_record(spark, f"{tmp_path}/record").first().n == 40 and records.verify(spark, f"{tmp_path}/record").first().ok
    assert records.load_config('{"type": "x"}') == {"type": "x"}


def test_streamed_windows_equal_batch(spark, tmp_path):
    df = spark.range(200).select(F.timestamp_seconds(F.col("id") * 97).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windows.windowed(windows.read_stream(spark, f"{tmp_path}/in", df.schema))
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("windowed").collect()) == sorted(windows.windowed(df).collect())


def test_conservative_remap_conserves(spark):
    a, b = polygons._mesh(spark, 24, 13), polygons._mesh(spark, 16, 9)
    o = polygons.overlaps(a, b).toPandas()
    assert math.isclose(o["area"].sum(), 4 * math.pi, rel_tol=1e-9)
    target = o.groupby("row")["target_area"].first()
    assert np.allclose(o.groupby("row")["area"].sum(), target, rtol=1e-9)
    assert not o.duplicated(["row", "col"]).any()


def test_polygon_kernels():
    octant = polygons.tidy(polygons.unit(np.array([0.0, 90.0, 0.0]), np.array([0.0, 0.0, 90.0])))
    assert math.isclose(polygons.signed_area(octant), math.pi / 2)
    assert np.allclose(polygons.centroid(octant), np.ones(3) / math.sqrt(3))
    assert math.isclose(polygons.signed_area(polygons.clip(octant, octant)), math.pi / 2)
    other = polygons.tidy(polygons.unit(np.array([180.0, 270.0, 180.0]), np.array([0.0, 0.0, 90.0])))
    assert polygons.signed_area(polygons.clip(octant, other)) < 1e-12


def test_exact_total_of_very_small_and_very_large_values(spark):
    values = [1e-8, 3e-9, -2e-8, 1e30, -1e30, 5e300, -5e300, 0.0, 1.5, 2e-310, None]
    df = spark.createDataFrame([(i, v, False) for i, v in enumerate(values)], "gidx long, value double, ghost boolean")
    r = statistics.exact_total(df).first()
    assert r.n == 10 and abs(r.total - (1.5 - 7e-9)) < 1e-15
    tiny = statistics.exact_total(df.filter("gidx < 3")).first().total
    assert abs(tiny + 7e-9) < 1e-22
    assert statistics.exact_total(df.filter("value is null")).first().total is None


def test_focus_is_an_arc_tangent():
    assert [round(x, 3) for x in grids.focus(0.0, 1.0, 5, 4.0)] == [0.0, 0.422, 0.5, 0.578, 1.0]
    assert grids.focus(2.0, 4.0, 1, 3.0) == [3.0]


def test_appended_records_verify(spark, tmp_path):
    df = spark.range(10).withColumn("value", F.col("id") * 1.0)
    for part in (df.filter("id < 4"), df.filter("id >= 4")):
        records.write_record({"a": part}, f"{tmp_path}/r", mode="append")
    records.write_record({"b": df}, f"{tmp_path}/r", mode="append")
    assert {(r.name, r.ok) for r in records.verify(spark, f"{tmp_path}/r").collect()} == {("a", True), ("b", True)}
    assert {(r.name, r.n) for r in records.list_record(spark, f"{tmp_path}/r").collect()} == {("a", 10), ("b", 10)}


def test_checkerboard_bands_have_equal_parts(spark):
    p = spark.range(1000).select(F.col("id").alias("gidx"), (F.col("id") % 50 * 7.0).alias("lon"), (F.floor(F.col("id") / 50) * 1.0).alias("lat"))
    for parts in (6, 7, 10, 12):
        sizes = [r["count"] for r in partition.checkerboard(p, parts, 50, 20, 1000).groupBy("part").count().collect()]
        assert len(sizes) == parts and max(sizes) - min(sizes) <= parts


def test_numbers_of_sparse_keys(spark):
    rng = np.random.default_rng(3)
    keys = [int(k) for k in rng.integers(0, 1 << 60, 400)] * 2 + [-5, 7]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "uid long, row long")
    number = {k: n for n, k in enumerate(sorted(set(keys)), 1)}
    got = exchange.renumber(df, "uid").collect()
    assert len(got) == len(keys) and all(r.number == number[r.uid] for r in got)
    assert exchange.renumber(df.filter("false"), "uid").count() == 0
    assert exchange.renumber(df, "uid").select("number").distinct().count() == len(number)


def test_structured_weights_on_an_octahedral_grid(spark):
    """Constants everywhere, latitudes away from the poles and points of the grid come out exactly; null and impossible targets get nothing."""
    grid = grids.octahedral(spark, 8)
    targets = spark.createDataFrame([(0, 12.3, 3.0), (1, 359.9, -41.0), (2, -725.0, 89.9), (3, 10.0, -90.0), (4, 10.0, 90.0), (5, None, 3.0), (6, 1.0, 91.0)], "gidx long, lon double, lat double")
    for kind in structured.KINDS:
        w = structured.structured_weights(targets, grid, kind)
        total = {r.row: r.s for r in w.groupBy("row").agg(F.sum("w").alias("s")).collect()}
        assert total.keys() == {0, 1, 2, 3, 4} and all(math.isclose(v, 1.0, abs_tol=1e-12) for v in total.values())
        lat = {r.row: r.value for r in sparse.apply(w, grid.select("gidx", F.col("lat").alias("value"))).collect()}
        assert math.isclose(lat[0], 3.0, abs_tol=1e-9) and math.isclose(lat[1], -41.0, abs_tol=1e-9)
        own = structured.structured_weights(grid, grid, kind).filter("abs(w) > 1e-9").select("row", "col", F.round("w", 9).alias("w")).collect()
        assert len(own) == grid.count() and all(r.row == r.col and r.w == 1.0 for r in own)
    with pytest.raises(ValueError):
        structured.structured_weights(targets, grid, "quintic")


def test_cubic_vertical_weights(spark):
    levels = spark.createDataFrame([(k, z) for k, z in enumerate((0.0, 0.1, 0.3, 0.6, 1.0))], "lev long, z double")
    heights = spark.createDataFrame([(0, -1.0), (1, 0.05), (2, 0.2), (3, 0.9), (4, 2.0)], "row long, z double")
    cube = levels.select(F.col("lev").alias("gidx"), F.pow("z", F.lit(3)).alias("value"))
    value = lambda **o: [r.value for r in sparse.apply(structured.vertical_cubic(levels, heights, **o), cube).orderBy("row").collect()]
    assert np.allclose(value(linear_ends=False), [0.0, 0.05**3, 0.2**3, 0.9**3, 1.0])
    assert np.allclose(value(), [0.0, 0.0005, 0.2**3, 0.25 * 0.6**3 + 0.75, 1.0])


def test_elements_of_a_quadrilateral_and_a_triangle(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 10.0, 10.0), (3, 0.0, 10.0), (4, 20.0, 5.0)], "gidx long, lon double, lat double")
    cells = spark.createDataFrame([(7, [0, 1, 2, 3]), (8, [1, 4, 2])], "cell long, nodes array<long>")
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 5.0, 0.0), (2, 10.0, 10.0), (3, 18.0, 5.0), (4, -3.0, 5.0), (5, 180.0, 0.0)], "gidx long, lon double, lat double")
    w = {}
    for r in elements.finite_element(cells, nodes, points).collect():
        w.setdefault(r.row, {})[r.col] = round(r.w, 9)
    assert w[0] == {0: 1.0} and w[1] == {0: 0.5, 1: 0.5} and w[2] == {2: 1.0}
    assert w[3].keys() == {1, 4, 2} and w.keys() == {0, 1, 2, 3}
    at = sum(w[3][n] * polygons.unit(np.array([lon]), np.array([lat]))[0] for n, lon, lat in ((1, 10.0, 0.0), (4, 20.0, 5.0), (2, 10.0, 10.0)))
    assert np.allclose(at / np.linalg.norm(at), polygons.unit(np.array([18.0]), np.array([5.0]))[0]) and math.isclose(sum(w[3].values()), 1.0, abs_tol=1e-8)
    parts = spark.createDataFrame([(7, 0), (8, 1)], "cell long, part int")
    got = {r.gidx: r.part for r in elements.matching_parts(points, cells, nodes, parts).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: None, 5: None}
    assert {r.gidx: r.part for r in elements.matching_parts(points, cells, nodes, parts, fallback=True).collect()} == {**got, 4: 0, 5: 1}
    assert elements.finite_element(cells, nodes, points.filter("false")).count() == 0


@pytest.mark.parametrize("triangulate", [False, True])
def test_reduced_mesh_covers_the_sphere(spark, triangulate):
    grid = grids.octahedral(spark, 6)
    cells, nodes = elements.reduced_cells(grid, triangulate, poles=True), structured.extended(grid.select("gidx", "lon", "lat"))
    edges, faces = mesh.facets(cells).collect(), cells.collect()
    assert all(e.right is not None for e in edges) and len({c.cell for c in faces}) == len(faces)
    assert nodes.count() - len(edges) + len(faces) == 2
    assert elements.mesh_faults(cells, nodes).count() == 0
    assert elements.finite_element(cells, nodes, grid).filter("row = col and w = 1").count() == grid.count()


def test_domain_hilbert_halves_squares(spark):
    def place(x, y, west, east, south, north, levels):
        """Quarter by quarter: down the west side, up the east one; the first and last quarters are mirrored."""
        a, b, c, d = (west, north), (west, south), (east, south), (east, north)
        mid = (west + east) / 2
        out = 0
        if x < mid:
            c, d = (mid, south), (mid, north)
        else:
            a, b, out = (mid, north), (mid, south), 4**levels
        half = lambda p, q: ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
        for level in range(levels, 0, -1):
            o = half(a, c)
            quarters = [(a, half(a, d), o, half(a, b)), (half(a, b), b, half(b, c), o), (o, half(b, c), c, half(c, d)), (half(c, d), o, half(a, d), d)]
            k = min(range(4), key=lambda n: math.dist((x, y), half(quarters[n][0], quarters[n][2])))
            out += k * 4 ** (level - 1)
            a, b, c, d = quarters[k]
        return out

    rng = np.random.default_rng(3)
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(0, 360, 200), rng.uniform(-90, 90, 200), strict=True))]
    df = spark.createDataFrame(points, "gidx long, x double, y double").select("gidx", geometry.domain_hilbert(F.col("x"), F.col("y"), 0.0, 360.0, -90.0, 90.0, 6).alias("key"))
    assert [r.key for r in df.orderBy("gidx").collect()] == [place(x, y, 0.0, 360.0, -90.0, 90.0, 6) for _, x, y in points]


def test_running_sums_and_places(spark):
    rows = spark.createDataFrame([(k * k, k % 3, k + 1) for k in range(40)], "gidx long, part int, n long")
    got = {r.gidx: r.before for r in exchange.running(rows, "gidx", "n", "before").collect()}
    assert got == {k * k: k * (k + 1) // 2 for k in range(40)}
    assert {r.gidx: r.ridx for r in exchange.local_index(rows).collect()} == {k * k: k // 3 for k in range(40)}


def test_clouds_edges(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 1.0, 0.0, 1), (3, 1.0, 0.0, 1), (4, 180.0, 0.0, 2)], "gidx long, lon double, lat double, part int")
    got = {(r.part, r.gidx, r.ghost) for r in clouds.cloud_halo(p, 0.02).collect()}
    assert got == {(0, 1, False), (1, 2, False), (1, 3, False), (2, 4, False), (0, 2, True), (0, 3, True), (1, 1, True)}
    assert clouds.cloud_halo(p.filter("false"), 0.1).count() == 0
    assert clouds.create_field(p, 2, 3, 1.5).agg(F.count("*"), F.sum("value")).first() == (24, 36.0)
