"""Dual meshes of any mesh of polygons: median dual volumes, and the normals of the dual faces that cross the edges.

Everything is an aggregate over (cell, edge) pairs: a cell knows its centroid, an edge its middle, and a dual face runs from the centroid on one side to that on
the other. Coordinates are degrees of longitude and latitude; a cell or an edge that crosses the date line is taken next to its own first corner.
At the northern and the southern end of a mesh that leaves out the poles, volumes and faces reach up to the pole, and pole edges join each node to the
one on the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.functions.geometry import microdegrees
from graticula.operators.mesh import structured_cells
from graticula.sources.grids import regular_lonlat
from graticula.sources.meshes import SIZE_SQL, grid_size
from graticula.sources.records import cut

TOL = 1e-6


def _near(lon: Column, ref: Column) -> Column:
    """lon, moved by whole turns next to ref."""
    return lon - F.round((lon - ref) / 360.0) * 360.0


def _sides(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each side of each cell: cell, n0 < n1, their coordinates and the cell's centroid, all next to n0."""
    at = nodes.select(F.col("gidx").alias("node"), F.struct("lon", "lat").alias("p"))
    corner = cells.select("cell", F.posexplode("nodes").alias("k", "node")).join(at, "node")
    c = corner.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("k", "node", "p"))).alias("c"))
    c = c.withColumn("ref", F.get("c", F.lit(0))["p"]["lon"])
    c = c.withColumn("c", F.transform("c", lambda v: F.struct(v["node"].alias("node"), _near(v["p"]["lon"], F.col("ref")).alias("x"), v["p"]["lat"].alias("y"))))
    mean = lambda f: F.aggregate(F.col("c")[f], F.lit(0.0), lambda a, b: a + b) / F.size("c")
    c = c.withColumns({"cx": mean("x"), "cy": mean("y")})
    s = c.select("cell", "cx", "cy", "c", F.posexplode("c").alias("k", "a")).withColumn("b", F.get("c", F.pmod(F.col("k") + 1, F.size("c"))))
    swap = F.col("a.node") > F.col("b.node")
    p, q = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    s = s.filter("a.node <> b.node").select("cell", "cx", "cy", p.alias("p"), q.alias("q"))
    # all next to the true place of n0
    turn = F.col("p.x") - F.pmod(F.col("p.x"), F.lit(360.0))
    return s.select("cell", F.col("p.node").alias("n0"), F.col("q.node").alias("n1"), *((F.col(x) - turn).alias(n) for x, n in (("cx", "cx"), ("p.x", "x0"), ("q.x", "x1"))), "cy", F.col("p.y").alias("y0"), F.col("q.y").alias("y1"))


def median_dual(cells: DataFrame, nodes: DataFrame, poles: bool = True) -> tuple[DataFrame, DataFrame]:
    """edges (n0, n1, sx, sy, pole) and nodes (node, lon, lat, volume) of the median dual of cells (cell, nodes) over nodes (gidx, lon, lat).

    (sx, sy) is the dual face's normal, as long as the face in degrees, from n0 to n1; a boundary edge's face ends in its middle. With poles, the end rows of a
    mesh are closed to the pole: their volumes and faces reach it, and pole edges (pole = true; (0, sy) leads out of both ends) join opposite nodes.
    """
    s = _sides(cells, nodes)
    ends = nodes.agg(F.max("lat").alias("top"), F.min("lat").alias("low"))  # one row
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2

    def area(x: str, y: str) -> Column:
        return F.abs(F.col("cx") * (my - F.col(y)) + mx * (F.col(y) - F.col("cy")) + F.col(x) * (F.col("cy") - my)) / 2

    # an edge's triangles in its cells count towards its ends
    e = s.withColumns({"v0": area("x0", "y0"), "v1": area("x1", "y1")}).groupBy("n0", "n1").agg(F.min(F.struct("cell", "cx", "cy")).alias("l"), F.max(F.struct("cell", "cx", "cy")).alias("r"), F.count("*").alias("m"), *(F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")), F.sum("v0").alias("v0"), F.sum("v1").alias("v1"))
    e = e.crossJoin(F.broadcast(ends)).withColumns({"mx": mx, "my": my})
    outer = F.col("m") == 1
    at_pole = F.when(outer & F.lit(poles), F.when(F.abs(F.col("my") - F.col("top")) < TOL, 90.0).when(F.abs(F.col("my") - F.col("low")) < TOL, -90.0))
    e = e.withColumn("pole_lat", at_pole)
    lx, ly = _near(F.col("l.cx"), F.col("mx")), F.col("l.cy")
    rx = F.when(outer, F.col("mx")).otherwise(_near(F.col("r.cx"), F.col("mx")))
    ry = F.when(outer, F.coalesce("pole_lat", "my")).otherwise(F.col("r.cy"))
    e = e.withColumns({"sx": ly - ry, "sy": rx - lx})
    out = F.when((F.col("x1") - F.col("x0")) * F.col("sx") + (F.col("y1") - F.col("y0")) * F.col("sy") < 0, -1.0).otherwise(1.0)
    # a boundary edge's half on each side of its middle, up to the pole
    half = F.array(*(F.struct(F.col(f"n{k}").alias("node"), F.col("pole_lat"), F.abs(F.col("mx") - F.col(f"x{k}")).alias("width"), F.col(f"y{k}").alias("y")) for k in (0, 1)))
    e = e.select("n0", "n1", (F.col("sx") * out).alias("sx"), (F.col("sy") * out).alias("sy"), "v0", "v1", F.when(F.col("pole_lat").isNotNull(), half).alias("rim"))
    e = cut(e, "dual-edges")  # used for edges, volumes and, three times, the rim
    volumes = e.select(F.inline(F.array(*(F.struct(F.col(f"n{k}").alias("node"), F.col(f"v{k}").alias("v")) for k in (0, 1)))))
    inner = e.select("n0", "n1", "sx", "sy", F.lit(False).alias("pole"))
    if poles:
        rim = e.filter("rim is not null").select(F.inline("rim"))
        volumes = volumes.unionByName(rim.select("node", (F.col("width") * F.abs(F.col("pole_lat") - F.col("y"))).alias("v")))
        faces = rim.groupBy("node", "pole_lat").agg(F.sum("width").alias("width"))
        at = faces.join(nodes.select(F.col("gidx").alias("node"), F.pmod(microdegrees(F.col("lon")), F.lit(360_000_000)).alias("u")), "node")
        over = at.select(F.col("node").alias("n1"), "pole_lat", F.pmod(F.col("u") + 180_000_000, F.lit(360_000_000)).alias("u"))
        pairs = at.withColumnRenamed("node", "n0").join(over, ["pole_lat", "u"]).filter("n0 < n1")
        inner = inner.unionByName(pairs.select("n0", "n1", F.lit(0.0).alias("sx"), (F.signum("pole_lat") * F.col("width")).alias("sy"), F.lit(True).alias("pole")))
    volumes = volumes.groupBy("node").agg(F.sum("v").alias("volume"))
    return inner, nodes.select(F.col("gidx").alias("node"), "lon", "lat").join(volumes.hint("merge"), "node")


def brick_dual(points: DataFrame) -> DataFrame:
    """node, volume of a structured grid (gidx, j, lat): boxes as wide as a row's step, from half way to the row above to half way to the row below, or to the pole."""
    from pyspark.sql import Window

    rows = points.groupBy("j").agg(F.first("lat").alias("lat"), F.count("*").alias("n"))  # a row for each latitude
    w = Window.orderBy("j")
    north = F.coalesce((F.lag("lat").over(w) + F.col("lat")) / 2, F.lit(90.0))
    south = F.coalesce((F.lead("lat").over(w) + F.col("lat")) / 2, F.lit(-90.0))
    rows = rows.select("j", (360.0 / F.col("n") * (north - south)).alias("volume"))
    return points.select(F.col("gidx").alias("node"), "j").join(F.broadcast(rows), "j").select("node", "volume")


def shifted_mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int, int]:
    """cells, points, nx, ny of the grid of orders with rows half a step from the poles."""
    nx, ny = grid_size(spark, sf_dir)
    points = regular_lonlat(spark, nx, ny, shift_y=True)
    return structured_cells(points, nx), points, nx, ny


def _edges(s: SparkSession, d: str) -> DataFrame:
    cells, points, _, _ = shifted_mesh(s, d)
    return median_dual(cells, points)[0].select("n0", "n1", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"), "pole")


def _volumes(s: SparkSession, d: str) -> DataFrame:
    cells, points, _, _ = shifted_mesh(s, d)
    return median_dual(cells, points)[1].select("node", F.round("volume", 6).alias("volume"))


_G = f"(SELECT *, unnest(range(ny)) AS j FROM (SELECT nx, ny, 360.0::DOUBLE/nx AS dx, 180.0::DOUBLE/ny AS dy, unnest(range(nx)) AS i FROM {SIZE_SQL}))"
QUERIES = {
    "me4_dual_normals": _edges,
    "me4_dual_volumes_to_the_poles": _volumes,
    "me5_brick_volumes": lambda s, d: brick_dual(shifted_mesh(s, d)[1]).select("node", F.round("volume", 6).alias("volume")),
}
_VOLUMES = f"SELECT j*nx+i AS node, round(dx*dy, 6) AS volume FROM {_G}"
ORACLES = {
    "me4_dual_normals": f"""SELECT least(j*nx+i, j*nx+(i+1)%nx) AS n0, greatest(j*nx+i, j*nx+(i+1)%nx) AS n1, round(CASE WHEN i = nx - 1 THEN -dy ELSE dy END, 6) AS sx, 0.0::DOUBLE AS sy, false AS pole FROM {_G}
 UNION ALL SELECT j*nx+i, (j+1)*nx+i, 0.0::DOUBLE, round(-dx, 6), false FROM {_G} WHERE j < ny-1
 UNION ALL SELECT j*nx+i, j*nx+i+nx//2, 0.0::DOUBLE, round(CASE WHEN j = 0 THEN dx ELSE -dx END, 6), true FROM {_G} WHERE j IN (0, ny-1) AND i < nx//2""",
    "me4_dual_volumes_to_the_poles": _VOLUMES,
    "me5_brick_volumes": _VOLUMES,
}
