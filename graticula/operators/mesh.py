"""Meshes as tables: nodes, cells (node lists), edges. Connectivity is explode, group and join; growth of halos is a semi-join for each ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.functions.geometry import microdegrees, xyz
from graticula.operators.exchange import local_index, renumber
from graticula.sources.meshes import CELLS_SQL, GRID_SQL, SIZE_SQL, orders_grid
from graticula.sources.records import cut


def structured_cells(points: DataFrame, nx: int, triangulate: bool = False) -> DataFrame:
    """Cells (cell, nodes) between neighbouring rows of a regular grid, closed in longitude; triangles on demand."""
    i, j = F.col("i"), F.col("j")
    last = points.agg(F.max("j").alias("last_j"))
    rows = points.crossJoin(F.broadcast(last)).filter(F.col("j") < F.col("last_j"))  # one row on the right
    at = lambda a, b: ((j + b) * nx + F.pmod(i + a, F.lit(nx))).cast("long")
    quad = (j * nx + i).cast("long")
    if not triangulate:
        return rows.select(quad.alias("cell"), F.array(at(0, 1), at(1, 1), at(1, 0), at(0, 0)).alias("nodes"))
    two = F.array(
        F.struct((quad * 2).alias("cell"), F.array(at(0, 1), at(1, 1), at(1, 0)).alias("nodes")),
        F.struct((quad * 2 + 1).alias("cell"), F.array(at(0, 1), at(1, 0), at(0, 0)).alias("nodes")),
    )
    return rows.select(F.inline(two))


def facets(cells: DataFrame) -> DataFrame:
    """Unique edges (n0 < n1) with the cells on both sides, the lower one first; a boundary edge has one."""
    pairs = cells.select("cell", F.posexplode("nodes").alias("k", "a"), F.col("nodes"))
    b = F.get("nodes", F.pmod(F.col("k") + 1, F.size("nodes")))
    e = pairs.select("cell", F.least("a", b).alias("n0"), F.greatest("a", b).alias("n1"))
    g = e.groupBy("n0", "n1").agg(F.min("cell").alias("left"), F.max("cell").alias("right"), F.count("*").alias("n"))
    return g.select("n0", "n1", "left", F.when(F.col("n") > 1, F.col("right")).alias("right"))


def boundary(cells: DataFrame) -> DataFrame:
    return facets(cells).filter("right is null").select("n0", "n1", "left")


def node_to_cells(cells: DataFrame) -> DataFrame:
    return cells.select("cell", F.explode("nodes").alias("node")).groupBy("node").agg(F.sort_array(F.collect_set("cell")).alias("cells"))


def node_to_edges(edges: DataFrame) -> DataFrame:
    """Edges (edge, n0, n1) of each node, in the order of their ids."""
    ends = edges.select("edge", F.explode(F.array("n0", "n1")).alias("node"))
    return ends.groupBy("node").agg(F.sort_array(F.collect_set("edge")).alias("edges"))


def numbered(edges: DataFrame) -> DataFrame:
    """Edge ids from 0 by (n0, n1), by ranges of equal share."""
    e = renumber(edges.withColumn("__uid", F.struct("n0", "n1")), "__uid", "edge")
    return e.withColumn("edge", F.col("edge") - 1).drop("__uid")


def cell_centres(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean of the corners on the unit sphere; a corner that a cell names twice counts once."""
    x, y, z = xyz(F.col("lon"), F.col("lat"))
    n = nodes.select(F.col("gidx").alias("node"), x.alias("x"), y.alias("y"), z.alias("z"))
    return cells.select("cell", F.explode(F.array_distinct("nodes")).alias("node")).join(n, "node").groupBy("cell").agg(*(F.avg(c).alias(c) for c in "xyz"))


def halos(cells: DataFrame, parts: DataFrame, rings: int) -> DataFrame:
    """part, cell, halo: the cells of every part (halo 0) and those within `rings` of it, for all parts at once.

    Each ring is one equi-join on the nodes of the cells that the ring before brought in. The first ring starts from nodes that cells of different
    parts share, so the inside of a part is never looked at. Cells with their parts, the border and each ring are written, so that all are made once.
    """
    own = cut(cells.select("cell", "nodes").join(parts.select("cell", "part"), "cell"), "own")
    links = own.select("cell", "part", F.explode(F.array_distinct("nodes")).alias("node"))
    border = links.groupBy("node").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("node")
    at_border = cut(links.join(border.hint("merge"), "node", "left_semi"), "border")
    have = own.select("part", "cell", F.lit(0).alias("halo"))
    front = at_border.select("part", "node").distinct()
    for ring in range(1, rings + 1):
        # the first ring reaches cells at border nodes, later ones any cell
        near = front.join((at_border if ring == 1 else links).select("node", "cell").hint("merge"), "node").select("part", "cell").distinct()
        new = near.join(have.select("part", "cell").hint("merge"), ["part", "cell"], "left_anti").withColumn("halo", F.lit(ring))
        new = cut(new, "halo")
        have = have.unionByName(new)
        front = new.join(links.select("cell", "node").hint("merge"), "cell").select("part", "node").distinct()
    return have


def grow_halo(cells: DataFrame, parts: DataFrame, part: int, rings: int) -> DataFrame:
    """Cells of one part and those within `rings` of it: (cell, halo), halo 0 for its own."""
    return halos(cells, parts, rings).filter(F.col("part") == part).select("cell", "halo")


def parallel_nodes(cells: DataFrame, parts: DataFrame, node_parts: DataFrame, rings: int = 0) -> DataFrame:
    """part, node, halo, owner, ghost, ridx: the nodes that every part holds with `rings` of cells, where they live and their place there.

    A part's own nodes come first in its numbering, in the order of their numbers; ghosts follow, ring by ring. ridx is the place in the owner's.
    """
    node_parts = cut(node_parts.select("node", "part"), "node-parts")
    held = halos(cells, parts, rings).hint("merge").join(cells.select("cell", F.explode("nodes").alias("node")), "cell").select("part", "node", "halo")
    # nodes that no cell of their own part touches still live there
    alone = node_parts.select("part", "node", F.lit(0).alias("halo"))
    held = held.unionByName(alone).groupBy("part", "node").agg(F.min("halo").alias("halo"))
    places = local_index(node_parts, key="node").select("node", F.col("part").alias("owner"), "ridx")
    return held.join(places, "node").select("part", "node", "halo", "owner", (F.col("part") != F.col("owner")).alias("ghost"), "ridx")


def edge_parts(edges: DataFrame, nodes: DataFrame, node_parts: DataFrame, parts: DataFrame) -> DataFrame:
    """n0, n1, part of each edge (n0, n1, left, right): the part of its northern (then western) end, unless none of its cells lives there; then that of the other end.

    A boundary edge whose ends live in different parts belongs where its cell does.
    """
    end = nodes.select(F.col("gidx").alias("node"), microdegrees(F.col("lat")).alias("y"), microdegrees(F.col("lon")).alias("x")).join(node_parts, "node")
    side = lambda k: end.select(F.col("node").alias(f"n{k}"), F.struct("y", -F.col("x"), -F.col("node")).alias(f"at{k}"), F.col("part").alias(f"p{k}"))
    cell = lambda name: parts.select(F.col("cell").alias(name), F.col("part").alias(f"{name}_part"))
    e = edges.join(side(0), "n0").join(side(1), "n1").join(cell("left"), "left").join(cell("right"), "right", "left")
    first = F.col("at0") >= F.col("at1")
    p, q = F.when(first, F.col("p0")).otherwise(F.col("p1")), F.when(first, F.col("p1")).otherwise(F.col("p0"))
    here = (p == F.col("left_part")) | F.coalesce(p == F.col("right_part"), F.lit(False))
    there = (q == F.col("left_part")) | F.coalesce(q == F.col("right_part"), F.lit(False))
    inner = F.when(here, p).when(there, q).otherwise(F.col("left_part"))
    return e.select("n0", "n1", F.when(F.col("right").isNull(), F.when(p == q, p).otherwise(F.col("left_part"))).otherwise(inner).alias("part"))


def parallel_edges(edges: DataFrame, owners: DataFrame, held: DataFrame) -> DataFrame:
    """part, edge, n0, n1, owner, ghost, ridx: the edges (edge, n0, n1, left, right) of the cells that every part holds (part, cell of `halos`), their owners and their places there."""
    ends = edges.select("edge", "n0", "n1", F.explode(F.array_compact(F.array("left", "right"))).alias("cell"))
    kept = ends.join(held.select("part", "cell").hint("merge"), "cell").select("part", "edge", "n0", "n1").distinct()
    own = owners.select("n0", "n1", F.col("part").alias("owner"))
    places = local_index(edges.select("edge", "n0", "n1").join(owners, ["n0", "n1"]).select("edge", "part"), key="edge").select("edge", "ridx")
    kept = kept.join(own, ["n0", "n1"]).join(places, "edge")
    return kept.select("part", "edge", "n0", "n1", "owner", (F.col("part") != F.col("owner")).alias("ghost"), "ridx")


def partition_graph(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs of neighbouring parts: those that share an edge."""
    owner = lambda side, name: parts.select(F.col("cell").alias(side), F.col("part").alias(name))
    f = facets(cells).filter("right is not null").join(owner("left", "a"), "left").join(owner("right", "b"), "right").filter("a <> b")
    return f.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def periodic_pairs(nodes: DataFrame) -> DataFrame:
    """slave, master: nodes at lon 360 and the nodes at lon 0 with the same latitude in microdegrees."""
    key = F.round(F.col("lat") * 1e6).cast("long")
    west = nodes.filter("lon = 0").select(F.col("gidx").alias("master"), key.alias("k"))
    return nodes.filter("lon = 360").select(F.col("gidx").alias("slave"), key.alias("k")).join(west, "k").select("slave", "master")


def dual_volumes(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """Median-dual volume of each node in squared degrees: from each cell the two triangles (centroid, edge middle, node) at its edges."""
    n = nodes.select(F.col("gidx").alias("node"), "lon", "lat")
    corner = cells.select("cell", F.posexplode("nodes").alias("k", "node"), F.size("nodes").alias("m")).join(n, "node")
    ref = Window.partitionBy("cell")
    # corners of a cell that crosses the date line are moved next to its first one
    first = F.first("lon").over(ref.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lon = F.col("lon") - F.round((F.col("lon") - first) / 360.0) * 360.0
    corner = corner.withColumn("lon", lon).withColumns({"cx": F.avg(lon).over(ref), "cy": F.avg("lat").over(ref)})
    listed = corner.groupBy("cell", "cx", "cy", "m").agg(F.sort_array(F.collect_list(F.struct("k", "node", "lon", "lat"))).alias("c"))
    edge = listed.select("cx", "cy", F.posexplode("c").alias("k", "a"), F.col("c"), "m")
    b = F.get("c", F.pmod(F.col("k") + 1, F.col("m")))
    edge = edge.withColumn("b", b).withColumns({"ex": (F.col("a.lon") + F.col("b.lon")) / 2, "ey": (F.col("a.lat") + F.col("b.lat")) / 2})

    def area(p: Column) -> Column:
        return F.abs((F.col("ex") - F.col("cx")) * (p["lat"] - F.col("cy")) - (p["lon"] - F.col("cx")) * (F.col("ey") - F.col("cy"))) / 2

    both = F.array(F.struct(F.col("a.node").alias("node"), area(F.col("a")).alias("v")), F.struct(F.col("b.node").alias("node"), area(F.col("b")).alias("v")))
    return edge.select(F.inline(both)).groupBy("node").agg(F.sum("v").alias("volume"))


def _grid(s: SparkSession, d: str) -> DataFrame:
    return orders_grid(s, d)[0]


def _cells(s: SparkSession, d: str, triangulate: bool = False) -> DataFrame:
    points, nx, _ = orders_grid(s, d)
    return structured_cells(points, nx, triangulate)


def _parts(s: SparkSession, d: str) -> DataFrame:
    """Four parts by longitude, two by latitude."""
    _, nx, ny = orders_grid(s, d)
    i, j = F.col("cell") % nx, F.floor(F.col("cell") / nx)
    return _cells(s, d).select("cell", (F.floor(i * 4 / nx) + 4 * F.floor(j * 2 / (ny - 1))).cast("int").alias("part"))


def _node_parts(s: SparkSession, d: str) -> DataFrame:
    """The lowest part whose cells touch a node."""
    return _cells(s, d).join(_parts(s, d), "cell").select(F.explode("nodes").alias("node"), "part").groupBy("node").agg(F.min("part").alias("part"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    e = facets(_cells(s, d))
    return numbered(e.select("n0", "n1")).join(e, ["n0", "n1"])


def _periodic(s: SparkSession, d: str) -> DataFrame:
    """The grid with one more column, at lon 360."""
    _, nx, ny = orders_grid(s, d)
    lon, lat = (F.col("id") % (nx + 1)) * 360.0 / nx, 90.0 - F.floor(F.col("id") / (nx + 1)) * (180.0 / (ny - 1))
    return periodic_pairs(s.range((nx + 1) * ny).select(F.col("id").alias("gidx"), lon.alias("lon"), lat.alias("lat")))


def _parallel_nodes(s: SparkSession, d: str) -> DataFrame:
    return parallel_nodes(_cells(s, d), _parts(s, d), _node_parts(s, d), 1)


def _parallel_edges(s: SparkSession, d: str) -> DataFrame:
    e = _edges(s, d)
    owners = edge_parts(e, _grid(s, d), _node_parts(s, d), _parts(s, d))
    return parallel_edges(e, owners, halos(_cells(s, d), _parts(s, d), 1))


_C = CELLS_SQL
_PART = "(floor(i*4/nx) + 4*floor(j*2/(ny-1)))::INT"
_P = f"(SELECT *, {_PART} AS part FROM {_C})"
_F = f"""(WITH e AS (SELECT cell, least(nodes[k+1], nodes[(k+1)%4+1]) AS n0, greatest(nodes[k+1], nodes[(k+1)%4+1]) AS n1 FROM {_C}, (SELECT unnest([0,1,2,3]) AS k))
 SELECT n0::BIGINT AS n0, n1::BIGINT AS n1, min(cell)::BIGINT AS "left", CASE WHEN count(*) > 1 THEN max(cell)::BIGINT END AS "right" FROM e GROUP BY n0, n1)"""
_NP = f"(SELECT node, min(part) AS part FROM (SELECT part, unnest(nodes) AS node FROM {_P}) GROUP BY node)"
# rings by how far a cell is from a part's box, in columns (round the sphere) and rows
_H = f"""(WITH b AS (SELECT part, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM {_P} GROUP BY part),
 x AS (SELECT b.part, cell, greatest(CASE WHEN i BETWEEN i0 AND i1 THEN 0 ELSE least((i0 - i + nx) % nx, (i - i1 + nx) % nx) END, CASE WHEN j < j0 THEN j0 - j WHEN j > j1 THEN j - j1 ELSE 0 END) AS halo FROM b, {_P})
 SELECT part, cell, halo::INT AS halo FROM x)"""
_NUMBERED = f"(SELECT *, row_number() OVER (ORDER BY n0, n1) - 1 AS edge FROM {_F})"
_OWNED = f"""(SELECT e.edge, e.n0, e.n1, e."left", e."right", CASE WHEN e."right" IS NULL THEN CASE WHEN a.part = b.part THEN a.part ELSE l.part END
 WHEN CASE WHEN first THEN a.part ELSE b.part END IN (l.part, r.part) THEN CASE WHEN first THEN a.part ELSE b.part END
 WHEN CASE WHEN first THEN b.part ELSE a.part END IN (l.part, r.part) THEN CASE WHEN first THEN b.part ELSE a.part END ELSE l.part END AS part
 FROM (SELECT f.*, p.j < q.j OR (p.j = q.j AND p.i < q.i) AS first FROM {_NUMBERED} f JOIN {GRID_SQL} p ON p.gidx = n0 JOIN {GRID_SQL} q ON q.gidx = n1) e
 JOIN {_NP} a ON a.node = n0 JOIN {_NP} b ON b.node = n1 JOIN {_P} l ON l.cell = e."left" LEFT JOIN {_P} r ON r.cell = e."right")"""
QUERIES = {
    "me1_structured_cells": lambda s, d: _cells(s, d).select("cell", F.array_join("nodes", ",").alias("nodes")),
    "me1_triangles": lambda s, d: _cells(s, d, True).select("cell", F.array_join("nodes", ",").alias("nodes")),
    "j20_facets": lambda s, d: facets(_cells(s, d)),
    "me3_numbered_edges": lambda s, d: numbered(facets(_cells(s, d)).select("n0", "n1")),
    "st3_boundary": lambda s, d: boundary(_cells(s, d)).select("n0", "n1", "left"),
    "j19_node_to_cells": lambda s, d: node_to_cells(_cells(s, d)).select("node", F.array_join("cells", ",").alias("cells")),
    "j19_node_to_edges": lambda s, d: node_to_edges(numbered(facets(_cells(s, d)).select("n0", "n1"))).select("node", F.array_join("edges", ",").alias("edges")),
    "me6_cell_centres": lambda s, d: cell_centres(_cells(s, d), _grid(s, d)).select("cell", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz")),
    "j17_halo_growth": lambda s, d: grow_halo(_cells(s, d), _parts(s, d), 0, 2),
    "j17_halos_of_all_parts": lambda s, d: halos(_cells(s, d), _parts(s, d), 2),
    "me8_parallel_nodes": _parallel_nodes,
    "me8_parallel_edges": _parallel_edges,
    "j21_partition_graph": lambda s, d: partition_graph(_cells(s, d), _parts(s, d)),
    "j18_periodic": _periodic,
    "me4_dual_volumes": lambda s, d: dual_volumes(_cells(s, d), _grid(s, d)).select("node", F.round("volume", 6).alias("volume")),
}
ORACLES = {
    "me1_structured_cells": f"SELECT cell, array_to_string(nodes, ',') AS nodes FROM {_C}",
    "me1_triangles": f"SELECT cell*2 AS cell, concat_ws(',', nodes[1], nodes[2], nodes[3]) AS nodes FROM {_C} UNION ALL SELECT cell*2+1, concat_ws(',', nodes[1], nodes[3], nodes[4]) FROM {_C}",
    "j20_facets": f"SELECT * FROM {_F}",
    "me3_numbered_edges": f"SELECT n0, n1, edge FROM {_NUMBERED}",
    "st3_boundary": f"SELECT n0, n1, \"left\" FROM {_F} WHERE \"right\" IS NULL",
    "j19_node_to_cells": f"SELECT node, array_to_string(list(DISTINCT cell ORDER BY cell), ',') AS cells FROM (SELECT cell, unnest(nodes) AS node FROM {_C}) GROUP BY node",
    "j19_node_to_edges": f"SELECT node, string_agg(edge::VARCHAR, ',' ORDER BY edge) AS edges FROM (SELECT n0 AS node, edge FROM {_NUMBERED} UNION ALL SELECT n1, edge FROM {_NUMBERED}) GROUP BY node",
    "me6_cell_centres": f"SELECT cell, round(avg(cos(radians(lon))*cos(radians(lat))),6) + 0.0 AS x, round(avg(sin(radians(lon))*cos(radians(lat))),6) + 0.0 AS y, round(avg(sin(radians(lat))),6) + 0.0 AS z FROM (SELECT cell, unnest(nodes) AS node FROM {_C}) JOIN {GRID_SQL} ON gidx = node GROUP BY cell",
    "j17_halo_growth": f"SELECT cell, halo FROM {_H} WHERE part = 0 AND halo <= 2",
    "j17_halos_of_all_parts": f"SELECT part, cell, halo FROM {_H} WHERE halo <= 2",
    "me8_parallel_nodes": f"""WITH own AS (SELECT node, part AS owner, row_number() OVER (PARTITION BY part ORDER BY node) - 1 AS ridx FROM {_NP}),
 held AS (SELECT part, node, min(halo) AS halo FROM (SELECT h.part, h.halo, unnest(nodes) AS node FROM {_H} h JOIN {_C} c ON h.cell = c.cell WHERE halo <= 1 UNION ALL SELECT owner, 0, node FROM own) GROUP BY part, node)
 SELECT part, held.node, halo, owner, part <> owner AS ghost, ridx FROM held JOIN own ON held.node = own.node""",
    "me8_parallel_edges": f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY edge) - 1 AS ridx FROM {_OWNED}),
 k AS (SELECT DISTINCT h.part, edge FROM {_H} h JOIN (SELECT edge, "left" AS cell FROM o UNION ALL SELECT edge, "right" FROM o) x ON x.cell = h.cell WHERE halo <= 1)
 SELECT k.part, o.edge, n0, n1, o.part AS owner, k.part <> o.part AS ghost, ridx FROM k JOIN o ON k.edge = o.edge""",
    "j21_partition_graph": f"SELECT DISTINCT least(l.part, r.part) AS a, greatest(l.part, r.part) AS b FROM {_F} f JOIN {_P} l ON l.cell = f.\"left\" JOIN {_P} r ON r.cell = f.\"right\" WHERE l.part <> r.part",
    "j18_periodic": f"SELECT j*(nx+1)+nx AS slave, j*(nx+1) AS master FROM (SELECT nx, unnest(range(ny)) AS j FROM {SIZE_SQL})",
    "me4_dual_volumes": f"SELECT gidx AS node, round(360.0::DOUBLE/nx * (180.0::DOUBLE/(ny-1)) / CASE WHEN j IN (0, ny-1) THEN 2 ELSE 1 END, 6) AS volume FROM {GRID_SQL}",
}
