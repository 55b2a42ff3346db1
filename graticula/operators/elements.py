"""Meshes of reduced grids, and searches for the element that holds a point: finite-element weights, matching partitions, outlines.

Elements are triangles and quadrilaterals with straight edges between points of the unit sphere; a point lies in the one that its ray from the
centre hits. Elements lie in cells of the unit cube of the level of their own size and meet the points by an equi-join; the test is a column
expression. A point that several elements hold (on a common edge) goes to the one it is deepest in, then to the lowest number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.functions.geometry import quad_quality, triangle_quality, xyz
from graticula.operators.exchange import renumber
from graticula.operators.mesh import facets
from graticula.operators.octree import at_levels, in_cells, levels_of, nearest, own_level
from graticula.operators.sparse import apply
from graticula.operators.structured import extended
from graticula.sources.grids import from_rows
from graticula.sources.tables import CUSTOMERS_SQL, POINTS_SQL, customer_points, order_points, table

#: Side of a cell of level 0.
CUBE = 4.0
#: Weights below this count as zero.
TOL = 1e-12


def _rows_with_next(points: DataFrame) -> DataFrame:
    """j, first, nx, the same of the next row, and base: the number of the first cell between them. A row for each latitude."""
    rows = points.groupBy("j").agg(F.min("gidx").alias("first"), F.count("*").alias("nx"))
    w = Window.orderBy("j")
    return rows.select("j", "first", "nx", F.lead("first").over(w).alias("below"), F.lead("nx").over(w).alias("mx"))


def reduced_cells(points: DataFrame, triangulate: bool = False, poles: bool = False) -> DataFrame:
    """Cells (cell, nodes) between neighbouring rows of a grid (gidx, i, j) that goes round the sphere.

    Two rows of as many points are joined by quadrilaterals (or by two triangles each); others by triangles: the edges of both rows are
    taken in the order of their middles, counted from where the rows begin, the northern one first in a tie, and each is closed by the point
    of the other row that is reached there. With `poles`, the end rows are closed to the two points of `extended`. Cells are numbered from 0
    from north to south and west to east, with a gap for each triangle at a pole that would have no area.
    """
    p = points.select("gidx", "i", "j")
    if poles:
        size = p.agg(F.max("gidx").alias("last"), F.min("j").alias("top"), F.max("j").alias("bottom"))  # one row
        ends = size.select(F.inline(F.array(F.struct((F.col("last") + 1).alias("gidx"), F.lit(0).alias("i"), (F.col("top") - 1).alias("j")), F.struct((F.col("last") + 2).alias("gidx"), F.lit(0).alias("i"), (F.col("bottom") + 1).alias("j")))))
        p = p.unionByName(ends)
    rows = _rows_with_next(p)
    w = Window.orderBy("j")
    same = F.col("nx") == F.col("mx")
    count = F.when(same & F.lit(not triangulate), F.col("nx")).otherwise(F.col("nx") + F.col("mx"))
    bands = rows.filter("mx is not null").withColumn("base", F.coalesce(F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    i, nx, mx = F.col("i"), F.col("nx"), F.col("mx")
    upper = lambda k: F.col("first") + F.pmod(k, nx)
    lower = lambda k: F.col("below") + F.pmod(k, mx)
    north = p.join(F.broadcast(bands), "j")
    south = p.withColumn("j", F.col("j") - 1).join(F.broadcast(bands), "j")
    # edges of the other row whose middle comes before (2 i + 1) / (2 nx), and at or before (2 i + 1) / (2 mx)
    before = F.floor(((2 * i + 1) * mx - nx + 2 * nx - 1) / (2 * nx)).cast("long")
    until = F.floor(((2 * i + 1) * nx + mx) / (2 * mx)).cast("long")
    a = north.select((F.col("base") + i + before).alias("cell"), F.array(upper(i), lower(before), upper(i + 1)).alias("nodes"), same.alias("same"))
    b = south.select((F.col("base") + i + until).alias("cell"), F.array(lower(i), lower(i + 1), upper(until)).alias("nodes"), same.alias("same"))
    if triangulate:
        cells = a.unionByName(b)
    else:
        quads = north.filter(same).select((F.col("base") + i).alias("cell"), F.array(upper(i), lower(i), lower(i + 1), upper(i + 1)).alias("nodes"))
        cells = a.unionByName(b).filter("not same").drop("same").unionByName(quads)
    return cells.select("cell", "nodes").filter(F.size(F.array_distinct("nodes")) == F.size("nodes"))


def corners(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """cell and its corners in order: structs (node, x, y, z) on the unit sphere."""
    x, y, z = xyz(F.col("lon"), F.col("lat"))
    n = nodes.select(F.col("gidx").alias("node"), x.alias("x"), y.alias("y"), z.alias("z"))
    e = cells.select("cell", F.posexplode("nodes").alias("k", "node")).join(n, "node")
    listed = F.sort_array(F.collect_list(F.struct("k", "node", "x", "y", "z")))
    return e.groupBy("cell").agg(F.transform(listed, lambda v: v.dropFields("k")).alias("corners"))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def triangles(elements: DataFrame) -> DataFrame:
    """cell, far, three, ax to dz of the triangles that make up elements (cell, corners): one for three corners; at the first corner and
    (far) at the third one for four."""
    at = lambda p, q, r: [F.col("corners")[n][c].alias(f"{v}{c}") for v, n in zip("abd", (p, q, r), strict=True) for c in "xyz"]
    part = lambda far, *n: F.struct(F.lit(far).alias("far"), *at(*n))
    three = F.size("corners") == 3
    return elements.select("cell", three.alias("three"), F.inline(F.when(three, F.array(part(False, 0, 1, 2))).otherwise(F.array(part(False, 0, 1, 3), part(True, 2, 3, 1)))))


def element_hits(points: DataFrame, elements: DataFrame, slack: float = 1e-10) -> DataFrame:
    """row, cell, weights (of the corners, in order): the element that holds each point (gidx, lon, lat); other points have no row.
    Corners must be in anticlockwise order, seen from outside.

    The ray of a point hits a + u (b - a) + v (d - a); u and v are ratios of volumes, whose normals are made once for each triangle. A
    triangle has barycentric weights. A quadrilateral is two triangles, whose u and v along the sides give bilinear weights. A point may
    be outside by `slack`; such weights are cut at 0 and scaled to 1.
    """
    e = triangles(elements)
    spread = F.greatest(*(F.greatest(*(F.col(f"{v}{c}") for v in "abd")) - F.least(*(F.col(f"{v}{c}") for v in "abd")) for c in "xyz"))
    e = e.withColumn("pad", spread * spread / 2.0 + 1e-9)  # the sphere bulges over an element's plane
    normals = {n: _cross([F.col(f"{p}{c}") for c in "xyz"], [F.col(f"{q}{c}") for c in "xyz"]) for n, p, q in (("na", "b", "d"), ("nb", "d", "a"), ("nd", "a", "b"))}
    reach = lambda f, c: f(*(F.col(f"{v}{c}") for v in "abd"))
    cells = {f"c{c}": (F.col(f"{c}0"), F.col(f"{c}1")) for c in "xyz"}
    lev = own_level(spread + 2 * F.col("pad"), CUBE)
    bounds = [(reach(f, c) + sign * F.col("pad")).alias(f"{c}{k}") for c in "xyz" for k, f, sign in ((0, F.least, -1), (1, F.greatest, 1))]
    e = e.select("cell", "far", "three", "ax", "ay", "az", *(k.alias(f"{n}{c}") for n, v in normals.items() for c, k in zip("xyz", v, strict=True)), lev.alias("lev"), *bounds)
    levels = levels_of(e)
    e = in_cells(e, CUBE, **cells).drop("x0", "x1", "y0", "y1", "z0", "z1")
    x, y, z = xyz(F.col("lon"), F.col("lat"))
    t = points.select(F.col("gidx").alias("row"), x.alias("x"), y.alias("y"), z.alias("z"))
    t = at_levels(t, levels, CUBE, cx="x", cy="y", cz="z")
    ray = [F.col(c) for c in "xyz"]
    volume = lambda n: _dot(ray, [F.col(f"{n}{c}") for c in "xyz"])
    low = -slack * F.abs(volume("na") + volume("nb") + volume("nd"))
    held = (volume("na") >= low) & (volume("nb") >= low) & (volume("nd") >= low)  # corners are anticlockwise seen from outside
    j = t.join(e, ["lev", *cells]).filter((volume("a") > 0) & held).select("row", "cell", "far", "three", F.inline(F.array(F.struct(*(volume(n).alias(n) for n in ("na", "nb", "nd"))))))
    u, v = (F.col(n) / (F.col("na") + F.col("nb") + F.col("nd")) for n in ("nb", "nd"))
    j = j.select("row", "cell", "three", F.inline(F.array(F.struct(F.when(F.col("far"), 1.0 - u).otherwise(u).alias("u"), F.when(F.col("far"), 1.0 - v).otherwise(v).alias("v")))))
    u, v = F.col("u"), F.col("v")
    w = F.when(F.col("three"), F.array(1.0 - u - v, u, v)).otherwise(F.array((1.0 - u) * (1.0 - v), u * (1.0 - v), u * v, (1.0 - u) * v))
    j = j.select("row", "cell", F.transform(w, lambda q: F.when(q < TOL, 0.0).otherwise(q)).alias("w"))
    # ties within rounding go to the lowest number
    best = F.struct(-F.round(F.array_min("w"), 9), F.col("cell"))
    h = j.groupBy("row").agg(F.min_by(F.struct("cell", "w"), best).alias("h")).select("row", "h.cell", "h.w")
    return h.select("row", "cell", F.transform("w", lambda q: q / F.aggregate("w", F.lit(0.0), lambda acc, r: acc + r)).alias("weights"))


def finite_element(cells: DataFrame, nodes: DataFrame, points: DataFrame) -> DataFrame:
    """Weights (row, col, w) of points in the elements of a mesh; points outside all of them get none."""
    hits = element_hits(points, corners(cells, nodes)).join(cells.select("cell", "nodes"), "cell")
    return hits.select("row", F.inline(F.arrays_zip(F.col("nodes").alias("col"), F.col("weights").alias("w")))).filter("w > 0")


def not_found(points: DataFrame, weights: DataFrame) -> DataFrame:
    """Points that got no weights: their values are missing."""
    return points.select(F.col("gidx").alias("row")).join(weights.select("row").distinct(), "row", "left_anti")


def matching_parts(points: DataFrame, cells: DataFrame, nodes: DataFrame, parts: DataFrame, fallback: bool = False) -> DataFrame:
    """gidx, part: each point goes to the part (cell, part) of the element that holds it; points outside have a null part.

    With `fallback`, these go to the part of the element that has the nearest corner, the lowest part if there are several.
    """
    held = element_hits(points, corners(cells, nodes)).join(parts, "cell").select(F.col("row").alias("gidx"), "part")
    out = points.select("gidx").join(held, "gidx", "left")
    if not fallback:
        return out
    lost = points.join(out.filter("part is null").select("gidx"), "gidx", "left_semi")
    owners = cells.select("cell", F.explode("nodes").alias("source")).join(parts, "cell").groupBy("source").agg(F.min("part").alias("near"))
    used = nodes.join(owners.select(F.col("source").alias("gidx")), "gidx", "left_semi")
    near = nearest(lost, used, 1).join(owners, "source").select(F.col("target").alias("gidx"), "near")
    return out.join(near, "gidx", "left").select("gidx", F.coalesce("part", "near").alias("part"))


def outlines(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """part, a, b: the directed edges round each part's cells: those whose other side lies in another part or in none."""
    b = F.get("nodes", F.pmod(F.col("k") + 1, F.size("nodes")))
    e = cells.join(parts, "cell").select("part", "nodes", F.posexplode("nodes").alias("k", "a")).select("part", "a", b.alias("b"))
    g = e.groupBy("part", F.least("a", "b").alias("n0"), F.greatest("a", "b").alias("n1")).agg(F.count("*").alias("n"), F.min(F.struct("a", "b")).alias("e"))
    return g.filter("n = 1").select("part", "e.a", "e.b")


def kept_cells(cells: DataFrame, nodes: DataFrame, predicate: Column, all_of: bool = True) -> DataFrame:
    """Cells of which all (or any) nodes pass a predicate on the columns of nodes."""
    passed = cells.select("cell", F.explode("nodes").alias("node")).join(nodes.select(F.col("gidx").alias("node"), F.coalesce(predicate, F.lit(False)).alias("ok")), "node")
    ok = (F.bool_and if all_of else F.bool_or)("ok")
    return cells.join(passed.groupBy("cell").agg(ok.alias("ok")).filter("ok").select("cell"), "cell", "left_semi")


def cell_quality(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """cell, kind (3 or 4 corners), eta, rho: how regular each element is, by its sides and angles on the sphere."""
    n = nodes.select(F.col("gidx").alias("node"), "lon", "lat")
    e = cells.select("cell", F.posexplode("nodes").alias("k", "node")).join(n, "node")
    c = e.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("k", "lon", "lat"))).alias("c"))
    at = [(F.col(f"lon{k}"), F.col(f"lat{k}")) for k in range(4)]
    flat = c.select("cell", F.size("c").alias("kind"), *(F.get("c", F.lit(k))[name].alias(f"{name}{k}") for k in range(4) for name in ("lon", "lat")))
    (t_eta, t_rho), (q_eta, q_rho) = triangle_quality(*at[:3]), quad_quality(*at)
    three = F.col("kind") == 3
    return flat.select("cell", "kind", F.when(three, t_eta).otherwise(q_eta).alias("eta"), F.when(three, t_rho).otherwise(q_rho).alias("rho"))


def quality_statistics(quality: DataFrame) -> DataFrame:
    """Cells of each kind with the least, greatest and mean eta and rho."""
    return quality.groupBy("kind").agg(F.count("*").alias("cells"), *(f(c).alias(f"{c}_{n}") for c in ("eta", "rho") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))


def mesh_faults(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """fault, id: what makes tables no mesh: node numbers or cell numbers that occur twice, coordinates that are null or off the sphere, cells
    with fewer than three corners, cells that name a node that is not there, and edges with more than two cells (the lowest of these)."""
    twice = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("fault"), F.col(key).alias("id"))
    off = nodes.filter("lon is null or lat is null or abs(lat) > 90").select(F.lit("off the sphere").alias("fault"), F.col("gidx").alias("id"))
    small = cells.filter("size(array_distinct(nodes)) < 3").select(F.lit("too few corners").alias("fault"), F.col("cell").alias("id"))
    lost = cells.select("cell", F.explode("nodes").alias("gidx")).join(nodes.select("gidx"), "gidx", "left_anti").select(F.lit("no such node").alias("fault"), F.col("cell").alias("id")).distinct()
    b = F.get("nodes", F.pmod(F.col("k") + 1, F.size("nodes")))
    e = cells.select("cell", "nodes", F.posexplode("nodes").alias("k", "a")).select("cell", F.least("a", b).alias("n0"), F.greatest("a", b).alias("n1"))
    many = e.groupBy("n0", "n1").agg(F.count("*").alias("n"), F.min("cell").alias("id")).filter("n > 2").select(F.lit("edge of many cells").alias("fault"), "id").distinct()
    out = twice(nodes, "gidx", "node number twice").unionByName(twice(cells, "cell", "cell number twice"))
    for more in (off, small, lost, many):
        out = out.unionByName(more)
    return out


def element_numbers(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """cell, part, number: dense numbers from 1, part after part, by cell within a part."""
    uid = cells.select("cell").join(parts, "cell").withColumn("__uid", F.struct("part", "cell"))
    return renumber(uid, "__uid").drop("__uid")


def renumbered(cells: DataFrame, nodes: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes in the order of a key (then of their old number), numbered from 0 as gidx with the old number as `was`, and cells with the new numbers."""
    order = renumber(nodes.withColumn("__key", F.struct(key.alias("k"), F.col("gidx").alias("g"))), "__key").drop("__key")
    order = order.withColumn("was", F.col("gidx")).withColumn("gidx", F.col("number") - 1).drop("number")
    e = cells.select("cell", F.posexplode("nodes").alias("k", "was")).join(order.select("was", "gidx"), "was")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("k", "gidx"))), lambda v: v["gidx"])
    return e.groupBy("cell").agg(listed.alias("nodes")), order


# A reduced grid of n rows, half the root of the number of customers: 8, 12, 16, ... 16, 12, 8 points.


def _grid(s: SparkSession, d: str) -> DataFrame:
    n = 2 * max(3, math.isqrt(table(s, d, "customer", "c_custkey").count()) // 4)
    nx = [8 + 4 * min(j, n - 1 - j) for j in range(n)]
    return from_rows(s, [(90.0 - (j + 0.5) * 180.0 / n, k, 0.0, 360.0 / k) for j, k in enumerate(nx)], 360.0)


def _mesh(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = _grid(s, d)
    return reduced_cells(g, poles=True), extended(g.select("gidx", "lon", "lat"))


def _open_mesh(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = _grid(s, d)
    return reduced_cells(g), g.select("gidx", "lon", "lat")


_parts = lambda cells: cells.select("cell", F.pmod(F.floor(F.col("cell") / 100), F.lit(5)).cast("int").alias("part"))
_FIELD = "sin(radians({lon}))*cos(radians({lat})) + 2*sin(radians({lat}))"


def _finite_element(s: SparkSession, d: str) -> DataFrame:
    cells, nodes = _mesh(s, d)
    field = nodes.select("gidx", F.expr(_FIELD.format(lon="lon", lat="lat")).alias("value"))
    return apply(finite_element(cells, nodes, customer_points(s, d)), field).select("row", (F.round("value", 6) + 0.0).alias("value"))


def _outside(s: SparkSession, d: str) -> DataFrame:
    cells, nodes = _open_mesh(s, d)
    return not_found(order_points(s, d), finite_element(cells, nodes, order_points(s, d)))


def _matching(fallback: bool):
    def run(s: SparkSession, d: str) -> DataFrame:
        cells, nodes = _open_mesh(s, d) if fallback else _mesh(s, d)
        p = customer_points(s, d)
        out = matching_parts(p, cells, nodes, _parts(cells), fallback)
        return out.groupBy("part").agg(F.count("*").alias("n")) if fallback else out

    return run


def _kept(s: SparkSession, d: str) -> DataFrame:
    cells, nodes = _mesh(s, d)
    return kept_cells(cells, nodes, F.col("lat") > 30).select("cell")


def _faulty(s: SparkSession, d: str) -> DataFrame:
    cells, nodes = _mesh(s, d)
    return mesh_faults(cells, nodes.filter("gidx not in (0, 30)").unionByName(nodes.filter("gidx = 7")))


def _quality(s: SparkSession, d: str) -> DataFrame:
    return cell_quality(*_mesh(s, d)).select("cell", "kind", *((F.round(c, 6) + 0.0).alias(c) for c in ("eta", "rho")))


_lists = lambda cells: cells.select("cell", F.array_join("nodes", ",").alias("nodes"))
# All edges of a band in the order of their middles; each is closed by the point that the other row has reached.
_CELLS = """r AS (SELECT j, nx, rows, sum(nx) OVER (ORDER BY j) - nx AS f FROM (SELECT j, rows, 8 + 4*least(j, rows-1-j) AS nx FROM (SELECT rows, unnest(range(rows)) AS j FROM (SELECT 2*greatest(3, floor(sqrt(count(*)))::BIGINT // 4) AS rows FROM customer)))),
rp AS (SELECT j, nx, f FROM r UNION ALL SELECT -1, 1, sum(nx) FROM r WHERE {poles} UNION ALL SELECT max(rows), 1, sum(nx) + 1 FROM r WHERE {poles}),
b AS (SELECT u.j, u.nx AS n, u.f AS fu, l.nx AS m, l.f AS fl FROM rp u JOIN rp l ON l.j = u.j + 1),
e AS (SELECT *, 0 AS side, unnest(range(n)) AS i FROM b UNION ALL SELECT *, 1 AS side, unnest(range(m)) AS i FROM b),
o AS (SELECT *, coalesce(sum(side) OVER w, 0)::BIGINT AS low, coalesce(sum(1 - side) OVER w, 0)::BIGINT AS up FROM e
  WINDOW w AS (PARTITION BY j ORDER BY CASE side WHEN 0 THEN (2*i+1)*m ELSE (2*i+1)*n END, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT j, coalesce(sum(CASE WHEN n = m THEN n ELSE n + m END) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM b),
c AS (SELECT (base + low + up)::BIGINT AS cell, CASE side WHEN 0 THEN [fu + up, fl + low % m, fu + (up + 1) % n] ELSE [fl + low, fl + (low + 1) % m, fu + up % n] END::BIGINT[] AS nodes FROM o JOIN z USING (j) WHERE n <> m
  UNION ALL SELECT (base + i)::BIGINT, [fu + i, fl + i, fl + (i + 1) % m, fu + (i + 1) % n]::BIGINT[] FROM e JOIN z USING (j) WHERE n = m AND side = 0),
cells AS (SELECT * FROM c WHERE len(list_distinct(nodes)) = len(nodes)),
p AS (SELECT (f + i)::BIGINT AS node, i*360.0::DOUBLE/nx AS lon, 90.0::DOUBLE - (j + 0.5)*180.0/rows AS lat FROM (SELECT *, unnest(range(nx)) AS i FROM r) UNION ALL SELECT sum(nx)::BIGINT, 0, 90 FROM r UNION ALL SELECT sum(nx)::BIGINT + 1, 0, -90 FROM r),
v AS (SELECT node, lon, lat, cos(radians(lon))*cos(radians(lat)) AS x, sin(radians(lon))*cos(radians(lat)) AS y, sin(radians(lat)) AS z FROM p),
k AS (SELECT cell, len(nodes) AS kind, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS k FROM cells)"""
_CLOSED, _OPEN = _CELLS.format(poles="TRUE"), _CELLS.format(poles="FALSE")
# Every point against every element: u and v by determinants at the first corner, and at the third of a quadrilateral.
_HITS = """g AS (SELECT cell, any_value(kind) AS kind, list(v ORDER BY k) AS c FROM (SELECT cell, kind, k, v FROM k JOIN v ON k.node = v.node) GROUP BY cell),
t AS (SELECT cell, 0 AS far, kind, c, c[1] AS a, c[2] AS b, CASE kind WHEN 3 THEN c[3] ELSE c[4] END AS d FROM g UNION ALL SELECT cell, 1, kind, c, c[3], c[4], c[2] FROM g WHERE kind = 4),
q AS (SELECT gidx AS row, cos(radians(lon))*cos(radians(lat)) AS x, sin(radians(lon))*cos(radians(lat)) AS y, sin(radians(lat)) AS z FROM {points}),
d AS (SELECT row, cell, far, kind, c, (b.y*d.z - b.z*d.y)*q.x + (b.z*d.x - b.x*d.z)*q.y + (b.x*d.y - b.y*d.x)*q.z AS wa, (d.y*a.z - d.z*a.y)*q.x + (d.z*a.x - d.x*a.z)*q.y + (d.x*a.y - d.y*a.x)*q.z AS wb,
  (a.y*b.z - a.z*b.y)*q.x + (a.z*b.x - a.x*b.z)*q.y + (a.x*b.y - a.y*b.x)*q.z AS wd FROM q JOIN t ON a.x*q.x + a.y*q.y + a.z*q.z > 0),
h AS (SELECT row, cell, kind, c, CASE far WHEN 0 THEN wb/(wa+wb+wd) ELSE 1 - wb/(wa+wb+wd) END AS u, CASE far WHEN 0 THEN wd/(wa+wb+wd) ELSE 1 - wd/(wa+wb+wd) END AS v FROM d WHERE least(wa/(wa+wb+wd), wb/(wa+wb+wd), wd/(wa+wb+wd)) >= -1e-10),
l AS (SELECT row, cell, c, CASE kind WHEN 3 THEN [1-u-v, u, v] ELSE [(1-u)*(1-v), u*(1-v), u*v, (1-u)*v] END AS w FROM h),
best AS (SELECT row, arg_min(cell, (-round(list_min(w), 9) + 0.0, cell)) AS cell, arg_min(c, (-round(list_min(w), 9) + 0.0, cell)) AS c, arg_min(w, (-round(list_min(w), 9) + 0.0, cell)) AS w FROM l GROUP BY row)"""
_PART = "((cell // 100) % 5)::INT"
QUERIES = {
    "me1_reduced_cells": lambda s, d: _lists(_mesh(s, d)[0]),
    "in6_finite_element": _finite_element,
    "in6_points_outside": _outside,
    "pt8_matching_parts": _matching(False),
    "pt8_matching_fallback": _matching(True),
    "pt10_outlines": lambda s, d: outlines(_mesh(s, d)[0], _parts(_mesh(s, d)[0])),
    "f7_kept_cells": _kept,
    "sf16_cell_quality": _quality,
    "ag17_quality_statistics": lambda s, d: quality_statistics(cell_quality(*_mesh(s, d))).select("kind", "cells", *((F.round(f"{c}_{n}", 6) + 0.0).alias(f"{c}_{n}") for c in ("eta", "rho") for n in ("min", "max", "mean"))),
    "io21_mesh_faults": _faulty,
    "me11_element_numbers": lambda s, d: element_numbers(_mesh(s, d)[0], _parts(_mesh(s, d)[0])),
    "so3_renumbered_cells": lambda s, d: _lists(renumbered(*_mesh(s, d), F.struct("lon", "lat"))[0]),
}
_DEG = "degrees(2*asin(least(1, sqrt(power({a}.x-{b}.x,2)+power({a}.y-{b}.y,2)+power({a}.z-{b}.z,2))/2)))"
_DOT = "(({p}.x-{q}.x)*({r}.x-{q}.x) + ({p}.y-{q}.y)*({r}.y-{q}.y) + ({p}.z-{q}.z)*({r}.z-{q}.z))"
_CORD = "sqrt(power({a}.x-{b}.x,2)+power({a}.y-{b}.y,2)+power({a}.z-{b}.z,2))"


def _corner_angle(p: int, q: int, r: int) -> str:
    c = [f"c[{n}]" for n in (p, q, r)]
    return f"abs(acos({_DOT.format(p=c[0], q=c[1], r=c[2])} / ({_CORD.format(a=c[0], b=c[1])} * {_CORD.format(a=c[2], b=c[1])})) - pi()/2)"


_SIDES3 = [_DEG.format(a=f"c[{p}]", b=f"c[{q}]") for p, q in ((1, 2), (2, 3), (3, 1))]
_SIDES4 = [_DEG.format(a=f"c[{p}]", b=f"c[{q}]") for p, q in ((1, 2), (2, 3), (3, 4), (4, 1))]
_WORST = ", ".join(_corner_angle(*n) for n in ((4, 1, 2), (1, 2, 3), (2, 3, 4), (3, 4, 1)))
_QUALITY = f"""WITH {_CLOSED}, {_HITS.split('t AS')[0].rstrip().rstrip(',')},
s3 AS (SELECT cell, 3 AS kind, {_SIDES3[0]} AS a, {_SIDES3[1]} AS b, {_SIDES3[2]} AS d FROM g WHERE kind = 3),
quality AS (SELECT cell, kind, 4*sqrt(3)*sqrt(greatest(0, (a+b+d)/2*((a+b+d)/2-a)*((a+b+d)/2-b)*((a+b+d)/2-d)))/(a*a+b*b+d*d) AS eta, least(a, b, d)/greatest(a, b, d) AS rho FROM s3
 UNION ALL SELECT cell, 4, greatest(0, 1 - greatest({_WORST})*2/pi()), least({', '.join(_SIDES4)})/greatest({', '.join(_SIDES4)}) FROM g WHERE kind = 4)"""
_MATCH = f"WITH {_CLOSED}, {_HITS.format(points=CUSTOMERS_SQL)}"
ORACLES = {
    "me1_reduced_cells": f"WITH {_CLOSED} SELECT cell, array_to_string(nodes, ',') AS nodes FROM cells",
    "in6_finite_element": f"{_MATCH}, x AS (SELECT row, unnest(list_zip(c, w)) AS y FROM best) SELECT row, round(sum(y[2]*({_FIELD.format(lon='y[1].lon', lat='y[1].lat')}))/sum(y[2]), 6) + 0.0 AS value FROM x GROUP BY row",
    "in6_points_outside": f"WITH {_OPEN}, {_HITS.format(points=POINTS_SQL)} SELECT o_orderkey AS row FROM orders WHERE o_orderkey NOT IN (SELECT row FROM best)",
    "pt8_matching_parts": f"{_MATCH} SELECT row AS gidx, {_PART} AS part FROM best",
    "pt10_outlines": f"WITH {_CLOSED}, ed AS (SELECT {_PART} AS part, unnest(nodes) AS a, unnest(list_concat(nodes[2:], nodes[1:1])) AS b FROM cells) SELECT part, a, b FROM ed WHERE NOT EXISTS (SELECT 1 FROM ed o WHERE o.part = ed.part AND o.a = ed.b AND o.b = ed.a)",
    "f7_kept_cells": f"WITH {_CLOSED} SELECT cell FROM k JOIN p USING (node) GROUP BY cell HAVING min(lat) > 30",
    "sf16_cell_quality": f"{_QUALITY} SELECT cell, kind, round(eta, 6) + 0.0 AS eta, round(rho, 6) + 0.0 AS rho FROM quality",
    "ag17_quality_statistics": f"{_QUALITY} SELECT kind, count(*) AS cells, " + ", ".join(f"round({f}({c}), 6) + 0.0 AS {c}_{n}" for c in ("eta", "rho") for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"))) + " FROM quality GROUP BY kind",
    "io21_mesh_faults": f"WITH {_CLOSED} SELECT 'no such node' AS fault, cell AS id FROM cells WHERE list_contains(nodes, 0) OR list_contains(nodes, 30) UNION ALL SELECT 'node number twice', 7",
    "me11_element_numbers": f"WITH {_CLOSED} SELECT cell, {_PART} AS part, row_number() OVER (ORDER BY {_PART}, cell) AS number FROM cells",
    "so3_renumbered_cells": f"WITH {_CLOSED}, n AS (SELECT node, row_number() OVER (ORDER BY lon, lat, node) - 1 AS new FROM p) SELECT cell, string_agg(new::VARCHAR, ',' ORDER BY k) AS nodes FROM k JOIN n USING (node) GROUP BY cell",
}
