"""Nearest neighbours, radius joins and point-in-polygon joins.

A radius join deals points on the sphere to cells of the unit cube, looks at the cells within reach of a point, an equi-join on the cell, and tests
the exact distance. kNN joins go down an octree of the sources (octree.py). Polygons lie in tiles of their own size. No cross join is formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.functions.geometry import xyz
from graticula.operators.octree import at_levels, in_cells, levels_of, nearest, own_level
from graticula.sources.tables import CUSTOMERS_SQL, POINTS_SQL, customer_points, order_points, table


def _cells(points: DataFrame, size: float) -> DataFrame:
    x, y, z = xyz(F.col("lon"), F.col("lat"))
    points = points.withColumns({"x": x, "y": y, "z": z})
    return points.withColumns({c: F.floor(F.col(a) / size).cast("int") for a, c in (("x", "cx"), ("y", "cy"), ("z", "cz"))})


def radius_join(targets: DataFrame, sources: DataFrame, chord: float) -> DataFrame:
    """Pairs (target, source, d) with a straight-line distance d of at most chord on the unit sphere.

    targets, sources: gidx, lon, lat. Each target is looked up in the 27 cells around its own, each source lies in one cell.
    """
    size = max(chord, 1e-6)
    s = _cells(sources.select("gidx", "lon", "lat"), size).select(F.col("gidx").alias("source"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), "cx", "cy", "cz")
    t = _cells(targets.select("gidx", "lon", "lat"), size).withColumnRenamed("gidx", "target")
    for c in ("cx", "cy", "cz"):
        t = t.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    d = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2 + (F.col("z") - F.col("sz")) ** 2)
    return t.join(s, ["cx", "cy", "cz"]).withColumn("d", d).filter(F.col("d") <= chord).select("target", "source", "d")


def nearest_vectors(queries: DataFrame, items: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact k nearest vectors by Euclidean distance for a stated set of queries against all items, in blocks.

    Queries and items are dealt into blocks of bounded size; a task holds one pair of a query block and an item block at a time. Matrix products show which items
    may be among the k nearest of a query there, these are compared exactly, and a rank over the k of each block gives the answer.
    """
    n_q, n_i = (max(1, -(-df.count() // BLOCK_ROWS)) for df in (queries, items))
    id_kind = queries.schema[id_col].dataType.simpleString()

    def blocks(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        row = df.select(F.col(id_col).cast(id_kind).alias("id"), F.col(vector).cast("array<float>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).alias(own))
        return row.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))).groupBy("qb", "ib")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (qid, a), (iid, b) = _rows(left), _rows(right)
        at, best, found = _k_nearest(qid, a, iid, b, k) if len(qid) and len(iid) else ([], [], [])
        return pa.table({"query": left["id"].take(pa.array(at, pa.int64())), "item": right["id"].take(pa.array(best, pa.int64())), "d": pa.array(found, pa.float64())})

    pairs = blocks(queries, "qb", n_q, "ib", n_i).cogroup(blocks(items, "ib", n_i, "qb", n_q)).applyInArrow(run, f"query {id_kind}, item {id_kind}, d double")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d", "item"))).filter(F.col("rank") <= k)


#: Rows of a block of vectors.
BLOCK_ROWS = 4096


#: Queries that are compared with a block of items at once.
SLICE = 128


def _rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block."""
    v = t["v"].combine_chunks()
    return t["id"].to_numpy(), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def _k_nearest(qid: np.ndarray, a: np.ndarray, iid: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of their k nearest items, itself excluded, with distances rounded to 4 digits; ties go to the lowest id."""
    out, length = [], (b**2).sum(1)
    for s in range(0, len(a), SLICE):
        x, own = a[s : s + SLICE], qid[s : s + SLICE, None] == iid
        rough = np.sqrt(np.maximum((x**2).sum(1)[:, None] + length - 2.0 * (x @ b.T), 0.0))
        rough[own | np.isnan(rough)] = np.inf
        # what rounding to 4 digits and the product's own rounding can hide
        slack = 2e-4 + 1e-5 * (1.0 + np.sqrt(np.nanmax(length, initial=0.0)))
        may = rough <= np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1 :][:, :1] + slack
        q, i = np.nonzero(may & ~own)
        d = np.round(np.sqrt(((b[i] - x[q]) ** 2).sum(1)), 4)
        order = np.lexsort((iid[i], d, q))
        q, i, d = q[order], i[order], d[order]
        keep = (np.arange(len(q)) - np.searchsorted(q, q) < k) & np.isfinite(d)
        out.append((q[keep] + s, i[keep], d[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def inside_polygon(px: Column, py: Column, polygon: Column, eps: float = 1e-10) -> Column:
    """Winding-number test of a point in a planar polygon, an array of structs (x, y) that closes on its first vertex; edges count as inside."""

    def step(acc: Column, i: Column) -> Column:
        a, b = F.get(polygon, i), F.get(polygon, i + 1)
        side = (b["x"] - a["x"]) * (py - a["y"]) - (px - a["x"]) * (b["y"] - a["y"])
        on = (F.abs(side) <= eps) & (px >= F.least(a["x"], b["x"]) - eps) & (px <= F.greatest(a["x"], b["x"]) + eps) & (py >= F.least(a["y"], b["y"]) - eps) & (py <= F.greatest(a["y"], b["y"]) + eps)
        up = ((a["y"] <= py) & (b["y"] > py) & (side > 0)).cast("int")
        down = ((a["y"] > py) & (b["y"] <= py) & (side < 0)).cast("int")
        return F.struct((acc["w"] + up - down).alias("w"), (acc["on"] | on).alias("on"))

    start = F.struct(F.lit(0).alias("w"), F.lit(False).alias("on"))
    return F.aggregate(F.sequence(F.lit(0), F.size(polygon) - 2), start, step, lambda acc: acc["on"] | (acc["w"] != 0))


def locate_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """gidx, polygon: the lowest-numbered polygon that holds each point, also looked for at lon + 360 and lon - 360; null if none does.

    Polygons (polygon, ring) lie in lon-lat tiles of the level of their own bounding box, points are looked up at each level there is: an equi-join, then the exact test.
    """
    bound = {"x0": F.array_min("ring.x"), "x1": F.array_max("ring.x"), "y0": F.array_min("ring.y"), "y1": F.array_max("ring.y")}
    box = polygons.select("polygon", "ring", *(c.alias(n) for n, c in bound.items()))
    box = box.withColumn("lev", own_level(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), TURN))
    levels = levels_of(box)
    eps = 1e-10
    box = in_cells(box, TURN, tx=(F.col("x0") - eps, F.col("x1") + eps), ty=(F.col("y0") - eps, F.col("y1") + eps))
    moved = points.select("gidx", "lat", F.explode(F.array(F.col("lon"), F.col("lon") - 360.0, F.col("lon") + 360.0)).alias("lon"))
    moved = at_levels(moved, levels, TURN, tx="lon", ty="lat")
    bounds = F.col("lon").between(F.col("x0") - eps, F.col("x1") + eps) & F.col("lat").between(F.col("y0") - eps, F.col("y1") + eps)
    held = moved.join(box, ["lev", "tx", "ty"]).filter(bounds).filter(inside_polygon(F.col("lon"), F.col("lat"), F.col("ring")))
    return points.select("gidx").join(held.groupBy("gidx").agg(F.min("polygon").alias("polygon")), "gidx", "left")


#: Degrees of a tile of level 0.
TURN = 720.0


def boxes(spark: SparkSession, step: int = 45) -> DataFrame:
    """Quadrilaterals that cover the sphere in lon-lat."""
    i = spark.range(360 // step).select((F.col("id") * step).cast("double").alias("x"))
    j = spark.range(180 // step).select((F.col("id") * step - 90).cast("double").alias("y"))
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(float(step), 0.0), corner(float(step), float(step)), corner(0.0, float(step)), corner(0.0, 0.0))
    grid = i.join(j)  # a few rows by a few rows
    return grid.select(((F.col("y") + 90) / step * (360 // step) + F.col("x") / step).cast("long").alias("polygon"), ring.alias("ring"))


def _targets(s: SparkSession, d: str) -> DataFrame:
    return customer_points(s, d).filter("gidx % 20 = 0")


_XYZ = "cos(radians(lon))*cos(radians(lat)) AS x, sin(radians(lon))*cos(radians(lat)) AS y, sin(radians(lat)) AS z"
_PAIRS = f"""WITH t AS (SELECT gidx AS target, {_XYZ} FROM {CUSTOMERS_SQL} WHERE gidx % 20 = 0), s AS (SELECT gidx AS source, {_XYZ} FROM {POINTS_SQL}),
p AS (SELECT target, source, round(sqrt(power(t.x-s.x,2)+power(t.y-s.y,2)+power(t.z-s.z,2)),7) AS d FROM t, s)"""
_knn = lambda s, d, k: nearest(_targets(s, d), order_points(s, d), k, digits=7)
QUERIES = {
    "j7_knn": lambda s, d: _knn(s, d, 4).select("target", "source", "rank"),
    "j8_nearest": lambda s, d: _knn(s, d, 1).select("target", "source", "d"),
    "j9_radius": lambda s, d: radius_join(_targets(s, d), order_points(s, d), 0.05).select("target", "source"),
    "tk1_top_k_vectors": lambda s, d: nearest_vectors(table(s, d, "embeddings").filter("vec_id % 20 = 0"), table(s, d, "embeddings"), 5).select("query", "item", "rank"),
    "j11_locate_polygon": lambda s, d: locate_polygon(order_points(s, d), boxes(s)),
    "f3_inside_polygon": lambda s, d: order_points(s, d).select("gidx", inside_polygon(F.col("lon"), F.col("lat"), F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (90.0, 0.0), (0.0, 80.0), (0.0, 0.0))))).alias("inside")),
}
ORACLES = {
    "j7_knn": f"{_PAIRS} SELECT target, source, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY d, source) AS rank FROM p) WHERE rank <= 4",
    "j8_nearest": f"{_PAIRS} SELECT target, source, d FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY d, source) AS rank FROM p) WHERE rank = 1",
    "j9_radius": f"{_PAIRS} SELECT target, source FROM p WHERE d <= 0.05",
    "tk1_top_k_vectors": "WITH p AS (SELECT q.vec_id AS query, i.vec_id AS item, round(sqrt(list_sum(list_transform(list_zip(q.embedding, i.embedding), lambda x: power((x[1]-x[2])::DOUBLE, 2)))), 4) AS d FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id) SELECT query, item, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, item) AS rank FROM p) WHERE rank <= 5",
    "j11_locate_polygon": f"SELECT gidx, (least(ceil((lat+90)/45)-1 + CASE WHEN lat = -90 THEN 1 ELSE 0 END, 3)*8 + CASE WHEN lon % 45 = 0 AND lon > 0 THEN lon/45 - 1 ELSE floor(lon/45) END)::BIGINT AS polygon FROM {POINTS_SQL}",
    "f3_inside_polygon": f"SELECT gidx, lon >= 0 AND lat >= 0 AND lon/90 + lat/80 <= 1 + 1e-12 AS inside FROM {POINTS_SQL}",
}
