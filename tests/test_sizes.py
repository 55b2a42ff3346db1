"""What Spark takes tables for, and what the size of a table costs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from graticula.operators import clouds, elements, elementwise, exchange, fvm, interpolation, mesh, octree, reorder, search, spectral
from graticula.sources.grids import from_rows, regular_lonlat
from graticula.sources.meshes import customers_field


def _size(df) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_grids_are_not_taken_for_their_rows(spark):
    assert _size(regular_lonlat(spark, 2000, 1000).select("gidx")) >= 8 * 2_000_000


def test_rows_of_different_lengths(spark):
    got = from_rows(spark, [(9.0 - j, n, 0.0, 1.0) for j, n in enumerate([3, 0, 5, 2])]).orderBy("gidx").select("gidx", "i", "j").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 0, 2), (4, 1, 2), (5, 2, 2), (6, 3, 2), (7, 4, 2), (8, 0, 3), (9, 1, 3)]


def test_equal_longitudes_of_rows_of_different_lengths_are_equal(spark, tmp_path):
    spark.range(15_000).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    points = elements._grid(spark, str(tmp_path)).select("i", "j", "lon").collect()
    nx = {j: 8 + 4 * min(j, 59 - j) for j in range(60)}
    assert len(points) == sum(nx.values())
    assert [r for r in points if r["lon"] != r["i"] * 360.0 / nx[r["j"]]] == []


def test_fixed_fields_are_broadcast_and_weights_are_not(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("c_custkey"), F.lit(1.0).alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    for kind in ("bilinear", "bicubic", "biquasicubic"):
        assert "BuildLeft" not in _plan(interpolation._structured(kind)(spark, str(tmp_path)))
        w = interpolation.structured(interpolation._targets(spark, str(tmp_path)), 8, 5, kind)
        assert "Exchange" not in _plan(w)
        assert w.count() == w.select("row", "col").distinct().count()


def test_places_are_searched_once(spark, monkeypatch):
    seen, tree = [], octree.tree
    monkeypatch.setattr(octree, "tree", lambda points, leaf: (seen.append(points.count()), tree(points, leaf))[1])
    at = lambda n, places, turn: spark.range(n).select(F.col("id").alias("gidx"), (F.col("id") % places * 40.0 + turn).alias("lon"), (F.col("id") % places * 10.0).alias("lat"))
    targets, sources = at(60, 4, 1.0), at(90, 3, 0.0)
    got = sorted((r["target"], r["rank"], r["source"], r["d"]) for r in octree.nearest(targets, sources, 5, 9).collect())
    xyz = lambda df: {r["gidx"]: np.array([np.cos(np.radians(r["lat"])) * np.cos(np.radians(r["lon"])), np.cos(np.radians(r["lat"])) * np.sin(np.radians(r["lon"])), np.sin(np.radians(r["lat"]))]) for r in df.collect()}
    s, want = xyz(sources), []
    for t, p in xyz(targets).items():
        near = sorted((round(float(np.linalg.norm(p - q)), 9), i) for i, q in s.items())[:5]
        want += [(t, k + 1, i, d) for k, (d, i) in enumerate(near)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, sorted(want), strict=True)) < 1e-8
    assert seen == [15]


def test_columns_go_to_pandas_by_batches(spark):
    rows = [(1, 2, 5.0), (1, 1, 3.0), (1, 3, 4.0), (2, 1, None), (2, 2, 7.0), (3, 1, 1.0)]
    out = elementwise.for_each_column_pandas(spark.createDataFrame(rows, "gidx long, lev int, value double"), lambda v: v.cummax(), "gidx")
    assert out.dtypes == [("gidx", "bigint"), ("lev", "int"), ("value", "double")]
    assert "FlatMapGroups" not in _plan(out)
    assert sorted((r[0], r[1], r[2]) for r in out.collect() if r[2] is not None) == [(1, 1, 3.0), (1, 2, 5.0), (1, 3, 5.0), (2, 2, 7.0), (3, 1, 1.0)]
    assert [tuple(r) for r in out.filter("value is null").collect()] == [(2, 1, None)]


def test_vectors_meet_a_pair_of_blocks_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 30)
    v = np.random.default_rng(3).integers(0, 3, (100, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    out = search.nearest_vectors(df.filter("vec_id % 5 = 0"), df, 6)
    assert "FlatMapCoGroupsInArrow" in _plan(out) and "MapInPandas" not in _plan(out)
    got = sorted((r["query"], r["rank"], r["item"], r["d"]) for r in out.collect())
    want = []
    for q in range(0, 100, 5):
        near = sorted((round(float(np.sqrt(((v[q].astype(float) - v[i]) ** 2).sum())), 4), i) for i in range(100) if i != q)[:6]
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert got == want


def test_clouds_search_places_not_points(spark, monkeypatch):
    seen, join = [], clouds.radius_join
    monkeypatch.setattr(clouds, "radius_join", lambda t, s, chord: (seen.append((t.count(), s.count())), join(t, s, chord))[1])
    points = [(g, g % 7 * 6.0, g % 3 * 5.0, g % 4) for g in range(84)]
    got = clouds.cloud_halo(spark.createDataFrame(points, "gidx long, lon double, lat double, part int"), 0.15)
    at = {g: np.array([np.cos(np.radians(y)) * np.cos(np.radians(x)), np.cos(np.radians(y)) * np.sin(np.radians(x)), np.sin(np.radians(y))]) for g, x, y, _ in points}
    want = {(p, g, p, False) for g, _, _, p in points} | {(p, g, o, True) for t, _, _, p in points for g, _, _, o in points if p != o and np.linalg.norm(at[t] - at[g]) <= 0.15}
    rows = [(r["part"], r["gidx"], r["owner"], r["ghost"]) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert seen == [(21, 21)]


def test_numbers_are_not_broadcast(spark):
    out = exchange.renumber(spark.range(50).select((F.col("id") % 20).alias("uid")), "uid")
    assert "strategy=merge" in out._jdf.queryExecution().logical().toString() + out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["uid"], r["number"]) for r in out.collect()} == {(i, i + 1) for i in range(20)}


def test_links_are_made_once(spark, monkeypatch):
    cut, seen = reorder._cut, []
    monkeypatch.setattr(reorder, "_cut", lambda df, name: (seen.append(name), cut(df, name))[1])
    links = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "a long, b long")
    out = reorder.levels_from(spark.createDataFrame([(0, 0)], "node long, component long"), links)
    assert sorted((r["node"], r["lev"]) for r in out.collect()) == [(0, 0), (1, 1), (2, 2)]
    assert seen.count("links") == 1


def test_legendre_rows_and_the_size_of_their_table(spark):
    lats = [80.0, 10.0, -35.5]
    p = spectral.legendre(9, lats)
    j, m = np.repeat(np.arange(3), 10), np.tile(np.arange(10), 3)
    assert np.allclose(spectral.legendre_rows(9, np.array(lats)[j], m), p[j, m], atol=1e-12)
    assert _size(spectral.legendre_table(spark, 399, [0.0] * 400)) >= 8 * 400 * 400


def test_legendre_tables_are_not_broadcast(spark):
    table = spectral.legendre_table(spark, 9, [0.0] * 10)
    spectra = spark.range(10).select(F.col("id").cast("int").alias("m"), F.lit(9).alias("n"), F.lit(0).alias("part"), F.lit(1.0).alias("value"))
    assert "BroadcastHashJoin" not in _plan(spectral.inverse_transform(spectra, table, [20] * 10))


def _halves(spark):
    """Cells of a grid of 8 by 5 points, those of the western half in part 0."""
    cells = mesh.structured_cells(regular_lonlat(spark, 8, 5), 8)
    return cells, cells.select("cell", F.when(F.col("cell") % 8 < 4, 0).otherwise(1).alias("part"))


def test_halos_make_their_cells_once(spark):
    out = mesh.halos(*_halves(spark), 1)
    assert "Join" not in _plan(out) and "Broadcast" not in _plan(out)
    rows = sorted((r["part"], r["cell"], r["halo"]) for r in out.collect())
    near = {0: (4, 7), 1: (0, 3)}
    assert rows == sorted((p, c, int(c % 8 // 4 != p)) for p in (0, 1) for c in range(32) if c % 8 // 4 == p or c % 8 in near[p])


def test_parallel_nodes_make_their_parts_once(spark):
    cells, parts = _halves(spark)
    node_parts = regular_lonlat(spark, 8, 5).select(F.col("gidx").alias("node"), F.when(F.col("gidx") % 8 < 4, 0).otherwise(1).alias("part")).filter("node <> 7919")
    out = mesh.parallel_nodes(cells, parts, node_parts, 0)
    assert "7919" not in _plan(out)
    rows = [(r["part"], r["node"], r["owner"], r["ghost"], r["ridx"]) for r in out.collect()]
    held = {0: (0, 1, 2, 3, 4), 1: (4, 5, 6, 7, 0)}
    assert sorted(rows) == sorted((p, n, n % 8 // 4, n % 8 // 4 != p, n // 8 * 4 + n % 4) for p in (0, 1) for n in range(40) if n % 8 in held[p])


def test_means_of_fields_are_not_broadcast(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("c_custkey"), F.col("id").cast("double").alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    field = customers_field(spark, str(tmp_path), 60)
    assert "BroadcastHashJoin" not in _plan(field)
    assert {r["node"]: r["value"] for r in field.collect()} == {n: (n if n >= 40 else n + 30.0) / 1000.0 for n in range(60)}


def test_dual_meshes_are_made_once(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("o_orderkey"), F.lit(1.0).alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    edges, nodes, size = fvm._mesh(spark, str(tmp_path))
    assert "Join" not in _plan(nodes) and "Aggregate" not in _plan(edges.filter("not pole"))
    assert size == nodes.count() == 200 and edges.count() == 200 + 180 + 20
    assert {round(r["volume"], 9) for r in nodes.collect()} == {324.0}


def test_levels_of_many_nodes_are_not_broadcast(spark, monkeypatch):
    cut, plans = reorder._cut, []
    monkeypatch.setattr(reorder, "SMALL", 3, raising=False)
    monkeypatch.setattr(reorder, "_cut", lambda df, name: (plans.append((name, _plan(df))), cut(df, name))[1])
    links = [(0, k) for k in range(1, 9)] + [(k, 10 + k) for k in range(1, 9)]
    both = spark.createDataFrame([*links, *((b, a) for a, b in links)], "a long, b long")
    start = spark.createDataFrame([(0, 0)], "node long, component long")
    levels = {r["node"]: r["lev"] for r in reorder.levels_from(start, both).collect()}
    assert levels == {0: 0, **{k: 1 for k in range(1, 9)}, **{10 + k: 2 for k in range(1, 9)}}
    order = reorder.cuthill_mckee(spark.createDataFrame([(k,) for k in levels], "node long"), both, start, reverse=False).collect()
    assert [r["node"] for r in sorted(order, key=lambda r: r["number"])] == [0, *range(1, 9), *range(11, 19)]
    late = [p for name in ("levels", "ranked") for p in [p for n, p in plans if n == name][2:]]
    assert late and not any("BroadcastHashJoin [a" in p or "BroadcastHashJoin [node" in p for p in late)
