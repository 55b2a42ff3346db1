"""Finite-volume operators on the median dual of a mesh.

Edges carry the dual normal between their two nodes. An operator is: fetch both end values by two joins, average, multiply by the normal, and
sum with signs by node. The edges come from any mesh by dual.median_dual; for regular lon-lat grids there is a closed form as well.

Pole edges (column pole, if there is one) join a node to the one on the other side of the pole. A scalar flows over them out of both ends. Eastward and northward turn
round on the way, so a vector counts with the other sign, and what an area loses over a pole is nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.functions.geometry import EARTH_RADIUS
from graticula.operators.dual import median_dual, shifted_mesh
from graticula.sources.grids import regular_lonlat
from graticula.sources.meshes import SIZE_SQL, customers_field, field_sql, grid_size, orders_field
from graticula.sources.records import cut

RAD = math.pi / 180


def dual_edges(spark: SparkSession, nx: int, ny: int) -> tuple[DataFrame, DataFrame]:
    """edges (edge, n0, n1, sx, sy) and nodes (node, lon, lat, volume) of the regular grid nx by ny that leaves out both poles.

    (sx, sy) is the dual face's normal, its length in degrees, from n0 to n1; the first and the last row end at the poles.
    """
    dx, dy = 360.0 / nx, 180.0 / (ny + 1)
    p = regular_lonlat(spark, nx, ny + 2).filter((F.col("j") > 0) & (F.col("j") < ny + 1))
    j = F.col("j") - 1
    nodes = p.select((j * nx + F.col("i")).cast("long").alias("node"), "i", j.alias("j"), "lon", "lat")
    height = F.when((F.col("j") == 0) | (F.col("j") == ny - 1), F.lit(1.5 * dy)).otherwise(F.lit(dy))
    east = nodes.select((F.col("node") * 2).alias("edge"), F.col("node").alias("n0"), (F.col("j") * nx + F.pmod(F.col("i") + 1, F.lit(nx))).cast("long").alias("n1"), height.alias("sx"), F.lit(0.0).alias("sy"))
    south = nodes.filter(F.col("j") < ny - 1).select((F.col("node") * 2 + 1).alias("edge"), F.col("node").alias("n0"), (F.col("node") + nx).alias("n1"), F.lit(0.0).alias("sx"), F.lit(-dx).alias("sy"))
    return east.unionByName(south), nodes.select("node", "lon", "lat", (height * dx).alias("volume"))


def _ends(edges: DataFrame, nodes: DataFrame, field: DataFrame, names: list[str]) -> DataFrame:
    """edges with the values of both ends, and cos(lat) there: a_*, b_*."""
    v = nodes.select("node", F.cos(F.radians("lat")).alias("c")).hint("merge").join(field, "node")
    end = lambda side: v.select(F.col("node").alias(f"n{0 if side == 'a' else 1}"), *(F.col(n).alias(f"{side}_{n}") for n in ["c", *names]))
    e = edges if "pole" in edges.columns else edges.withColumn("pole", F.lit(False))
    # nodes and edges can be files, which Spark takes for as large as they are compressed, so it is told not to broadcast them
    return e.join(end("a").hint("merge"), "n0").join(end("b").hint("merge"), "n1")


def _by_node(edges: DataFrame, both: bool = False, **parts: Column) -> DataFrame:
    """Signed sums by node: an edge's flux leaves n0 and enters n1; both: over a pole edge it leaves n1 as well."""
    e = edges.select("n0", "n1", F.when(F.col("pole") & F.lit(both), 1.0).otherwise(-1.0).alias("sign"), *(c.alias(n) for n, c in parts.items()))
    signed = F.array(F.struct(F.col("n0").alias("node"), *(F.col(n) for n in parts)), F.struct(F.col("n1").alias("node"), *((F.col("sign") * F.col(n)).alias(n) for n in parts)))
    return e.select(F.inline(signed)).groupBy("node").agg(*(F.sum(n).alias(n) for n in parts))


def _close(sums: DataFrame, nodes: DataFrame) -> DataFrame:
    return sums.join(nodes.select("node", "volume", F.cos(F.radians("lat")).alias("c")).hint("merge"), "node")


def gradient(edges: DataFrame, nodes: DataFrame, field: DataFrame, name: str = "value", radius: float = EARTH_RADIUS, poles: DataFrame | None = None) -> DataFrame:
    """node, gx, gy of a scalar field (node, value), per length of the radius.

    poles: rows (node, sx, sy) of boundary faces, over which the node's own value flows.
    """
    e = _ends(edges, nodes, field, [name])
    mean = (F.col(f"a_{name}") + F.col(f"b_{name}")) / 2 * RAD
    s = _by_node(e, True, gx=mean * F.col("sx"), gy=mean * F.col("sy"))
    if poles is not None:
        own = poles.join(field, "node").select("node", (F.col(name) * RAD * F.col("sx")).alias("gx"), (F.col(name) * RAD * F.col("sy")).alias("gy"))
        s = s.unionByName(own).groupBy("node").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))
    scale = RAD * RAD * radius
    return _close(s, nodes).select("node", (F.col("gx") / (F.col("volume") * scale * F.col("c"))).alias("gx"), (F.col("gy") / (F.col("volume") * scale)).alias("gy"))


def divergence(edges: DataFrame, nodes: DataFrame, wind: DataFrame, radius: float = EARTH_RADIUS) -> DataFrame:
    """node, value of a wind (node, u, v); nothing flows over the poles, where the cosine is 0."""
    e = _ends(edges, nodes, wind, ["u", "v"]).filter("not pole")
    flux = ((F.col("a_u") + F.col("b_u")) / 2 * F.col("sx") + (F.col("a_v") * F.col("a_c") + F.col("b_v") * F.col("b_c")) / 2 * F.col("sy")) * RAD
    return _close(_by_node(e, f=flux), nodes).select("node", (F.col("f") / (F.col("volume") * (RAD * RAD * radius) * F.col("c"))).alias("value"))


def curl(edges: DataFrame, nodes: DataFrame, wind: DataFrame, radius: float = EARTH_RADIUS) -> DataFrame:
    """node, value: the vertical part of the rotation."""
    e = _ends(edges, nodes, wind, ["u", "v"]).filter("not pole")
    flux = ((F.col("a_v") + F.col("b_v")) / 2 * F.col("sx") - (F.col("a_u") * F.col("a_c") + F.col("b_u") * F.col("b_c")) / 2 * F.col("sy")) * RAD
    return _close(_by_node(e, f=flux), nodes).select("node", (F.col("f") / (F.col("volume") * (RAD * RAD * radius) * F.col("c"))).alias("value"))


def laplacian(edges: DataFrame, nodes: DataFrame, field: DataFrame, radius: float = EARTH_RADIUS, poles: DataFrame | None = None) -> DataFrame:
    g = gradient(edges, nodes, field, radius=radius, poles=poles).select("node", F.col("gx").alias("u"), F.col("gy").alias("v"))
    return divergence(edges, nodes, g, radius)


def vector_gradient(edges: DataFrame, nodes: DataFrame, wind: DataFrame, radius: float = EARTH_RADIUS) -> DataFrame:
    """node, ux, uy, vx, vy of a wind (node, u, v)."""
    e = _ends(edges, nodes, wind, ["u", "v"])
    mean = {n: (F.col(f"a_{n}") + F.when(F.col("pole"), -F.col(f"b_{n}")).otherwise(F.col(f"b_{n}"))) / 2 * RAD for n in ("u", "v")}
    s = _close(_by_node(e, **{f"{n}{x}": mean[n] * F.col(f"s{x}") for n in ("u", "v") for x in ("x", "y")}), nodes)
    scale = F.col("volume") * (RAD * RAD * radius)
    return s.select("node", *((F.col(f"{n}{x}") / (scale * F.col("c") if x == "x" else scale)).alias(f"{n}{x}") for n in ("u", "v") for x in ("x", "y")))


def pole_faces(nodes: DataFrame, dx: float) -> DataFrame:
    """The faces towards the poles of the first and the last row."""
    edge = nodes.agg(F.max("lat").alias("top"), F.min("lat").alias("low"))
    return nodes.crossJoin(F.broadcast(edge)).filter("lat = top or lat = low").select("node", F.lit(0.0).alias("sx"), F.when(F.col("lat") == F.col("top"), F.lit(dx)).otherwise(F.lit(-dx)).alias("sy"))


def _mesh(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    cells, points, nx, ny = shifted_mesh(s, d)
    edges, nodes = median_dual(cells, points)
    return edges, cut(nodes, "dual-nodes"), nx * ny  # nodes are joined three times


def _scalar(op):
    def query(s: SparkSession, d: str) -> DataFrame:
        e, n, size = _mesh(s, d)
        return _rounded(op(e, n, orders_field(s, d, size), radius=1.0))

    return query


def _vector(op):
    def query(s: SparkSession, d: str) -> DataFrame:
        e, n, size = _mesh(s, d)
        u = orders_field(s, d, size).withColumnRenamed("value", "u")
        wind = u.join(customers_field(s, d, size).withColumnRenamed("value", "v").hint("merge"), "node")
        return _rounded(op(e, n, wind, radius=1.0))

    return query


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("node", *((F.round(c, 4) + 0.0).alias(c) for c in df.columns if c != "node"))


# In SQL: each node with its neighbours (the other side of the pole beyond the end rows), and the means on the four sides of its box.
_F, _H = field_sql("nx * ny"), field_sql("nx * ny", "customer", "c_custkey", "c_acctbal")
_V = f"(SELECT j*nx+i AS node, i, j, nx, ny, radians(360.0/nx) AS dx, radians(180.0/ny) AS dy, radians(90 - 180.0/ny*(j+0.5)) AS b FROM (SELECT *, unnest(range(ny)) AS j FROM (SELECT *, unnest(range(nx)) AS i FROM {SIZE_SQL})))"


def _around(rows: str, names: str, pole: float | None) -> str:
    """node, b, dx, dy and for each name f: f_e - f_w as f_x and the means north minus south as f_y, weighed by the cosine where pole is null."""
    out = []
    for f in names:
        w = lambda t, f=f: f"{t}.{f} * cos({t}.b)" if pole is None else f"{t}.{f}"
        over = "0" if pole is None else f"(p.{f} + {pole} * o.{f}) / 2"
        north = f"CASE WHEN p.j = 0 THEN {over} ELSE ({w('p')} + {w('n')}) / 2 END"
        south = f"CASE WHEN p.j = p.ny - 1 THEN {over} ELSE ({w('p')} + {w('s')}) / 2 END"
        out.append(f"(e.{f} - w.{f}) / 2 AS {f}_x, {north} - {south} AS {f}_y")
    return f"""(SELECT p.node, p.i, p.j, p.nx, p.ny, p.b, p.dx, p.dy, {', '.join(out)} FROM {rows} p JOIN {rows} e ON e.node = p.j*p.nx + (p.i+1)%p.nx JOIN {rows} w ON w.node = p.j*p.nx + (p.i+p.nx-1)%p.nx
 LEFT JOIN {rows} n ON n.node = p.node - p.nx LEFT JOIN {rows} s ON s.node = p.node + p.nx JOIN {rows} o ON o.node = p.j*p.nx + (p.i+p.nx//2)%p.nx)"""


_SCALAR = f"WITH g AS {_V}, f AS {_F}, r AS MATERIALIZED (SELECT g.*, f.value AS v FROM g JOIN f ON g.node = f.node)"
_WIND = f"WITH g AS {_V}, f AS {_F}, h AS {_H}, r AS MATERIALIZED (SELECT g.*, f.value AS u, h.value AS v FROM g JOIN f ON g.node = f.node JOIN h ON h.node = g.node)"
_GRAD = f"(SELECT *, v_x / (dx*cos(b)) AS u, v_y / dy AS v FROM {_around('r', 'v', 1.0)})"
QUERIES = {
    "nu1_gradient": _scalar(gradient),
    "nu2_vector_gradient": _vector(vector_gradient),
    "nu3_divergence": _vector(divergence),
    "nu4_curl": _vector(curl),
    "nu5_laplacian": _scalar(laplacian),
    "nu6_edges": lambda s, d: (lambda n: dual_edges(s, n[0], n[1])[0].select("edge", "n0", "n1", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy")))(grid_size(s, d)),
}
ORACLES = {
    "nu1_gradient": f"{_SCALAR} SELECT node, round(u, 4) + 0.0 AS gx, round(v, 4) + 0.0 AS gy FROM {_GRAD}",
    "nu2_vector_gradient": f"{_WIND} SELECT node, round(u_x/(dx*cos(b)), 4) + 0.0 AS ux, round(u_y/dy, 4) + 0.0 AS uy, round(v_x/(dx*cos(b)), 4) + 0.0 AS vx, round(v_y/dy, 4) + 0.0 AS vy FROM {_around('r', 'uv', -1.0)}",
    "nu3_divergence": f"{_WIND} SELECT x.node, round((x.u_x/x.dx + y.v_y/x.dy)/cos(x.b), 4) + 0.0 AS value FROM {_around('r', 'u', None)} x JOIN {_around('r', 'v', None)} y ON x.node = y.node",
    "nu4_curl": f"{_WIND} SELECT x.node, round((y.v_x/x.dx - x.u_y/x.dy)/cos(x.b), 4) + 0.0 AS value FROM {_around('r', 'u', None)} x JOIN {_around('r', 'v', None)} y ON x.node = y.node",
    "nu5_laplacian": f"{_SCALAR}, q AS MATERIALIZED {_GRAD} SELECT x.node, round((x.u_x/x.dx + y.v_y/x.dy)/cos(x.b), 4) + 0.0 AS value FROM {_around('q', 'u', None)} x JOIN {_around('q', 'v', None)} y ON x.node = y.node",
    "nu6_edges": f"""WITH g AS (SELECT *, unnest(range(ny)) AS j FROM (SELECT nx, ny, 360.0::DOUBLE/nx AS dx, 180.0::DOUBLE/(ny+1) AS dy, unnest(range(nx)) AS i FROM {SIZE_SQL}))
 SELECT (j*nx+i)*2 AS edge, j*nx+i AS n0, j*nx+(i+1)%nx AS n1, round(CASE WHEN j IN (0, ny-1) THEN 1.5 ELSE 1.0 END * dy, 6) AS sx, 0.0::DOUBLE AS sy FROM g
 UNION ALL SELECT (j*nx+i)*2+1, j*nx+i, (j+1)*nx+i, 0.0::DOUBLE, round(-dx, 6) FROM g WHERE j < ny-1""",
}
