"""Rings from directed edges: outlines of partitions and boundaries as closed walks.

Each edge is followed by one that begins where it ends; where several do, the k-th that comes in goes on with the k-th that goes out. That makes a permutation
of the edges, whose cycles are found and numbered by pointer doubling: after round k each edge knows the least edge of the next 2 ** k and how far
away it is, so the rounds grow with the logarithm of the longest ring, and no task follows a ring. Rings that touch in a node are spliced into one: rings
toss a coin by hash, tails that meet heads hang themselves on one of them, and the edges at that node go on where their neighbours did. When no
two rings meet any more, each group of edges that hang together is one walk that uses every edge once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.operators.elements import outlines
from graticula.operators.mesh import structured_cells
from graticula.sources.meshes import CELLS_SQL, orders_grid
from graticula.sources.records import scratch


def _cut(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def successors(edges: DataFrame) -> DataFrame:
    """part, a, b, c: each edge a -> b with the end of the next one b -> c; every node must be left as often as it is reached."""
    rank = lambda node, other: F.row_number().over(Window.partitionBy("part", node).orderBy(other))
    e = edges.select("part", "a", "b").distinct()
    going = e.select("part", F.col("a").alias("v"), F.col("b").alias("c"), rank("a", "b").alias("k"))
    coming = e.select("part", "a", F.col("b").alias("v"), rank("b", "a").alias("k"))
    both = coming.join(going, ["part", "v", "k"], "full")
    both = both.withColumn("a", F.when(F.col("a").isNull() | F.col("c").isNull(), F.raise_error(F.lit("edges do not close"))).otherwise(F.col("a")))
    return both.select("part", "a", F.col("v").alias("b"), "c")


def ranked(follow: DataFrame) -> DataFrame:
    """follow (part, a, b, c) with la, lb (the least edge of its ring) and ahead (how many edges on it is)."""
    # edge (a, b); at (na, nb), 2 ** k edges on; the least of the edges in between
    s = follow.select("part", "a", "b", "c", F.col("b").alias("na"), F.col("c").alias("nb"), F.struct(F.col("a").alias("la"), F.col("b").alias("lb"), F.lit(0).cast("long").alias("ahead")).alias("least"))
    s, step = _cut(s, "ring-edges"), 1
    while True:
        on = s.select("part", F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("ma"), F.col("nb").alias("mb"), F.col("least").alias("further"))
        further = F.struct(F.col("further.la").alias("la"), F.col("further.lb").alias("lb"), (F.col("further.ahead") + step).alias("ahead"))
        s = s.join(on, ["part", "na", "nb"]).withColumn("best", F.least("least", further))
        s = _cut(s.select("part", "a", "b", "c", F.col("ma").alias("na"), F.col("mb").alias("nb"), F.col("best").alias("least"), (F.col("best") != F.col("least")).alias("new")), "ring-edges")
        # where no edge of a ring saw a lesser one, each window of this size holds the least edge
        if s.filter("new").isEmpty():
            return s.select("part", "a", "b", "c", "least.la", "least.lb", "least.ahead")
        s, step = s.drop("new"), 2 * step


def _spliced(s: DataFrame, turn: int) -> DataFrame | None:
    """follow, with rings that meet hung on each other; None if none do."""
    ring = F.struct("la", "lb").alias("ring")
    out = s.select("part", F.col("b").alias("v"), "a", "c", ring)  # an edge a -> v that goes on to c
    meets = out.groupBy("part", "v").agg(F.min("ring").alias("x"), F.max("ring").alias("y")).filter("x <> y").select("part", "v")
    meets = _cut(meets, "ring-nodes")
    if meets.isEmpty():
        return None
    heads = F.pmod(F.xxhash64(F.lit(turn), "ring.la", "ring.lb"), F.lit(2)) == 1
    # one edge of each ring at each node where rings meet
    one = out.join(meets, ["part", "v"]).groupBy("part", "v", "ring").agg(F.min(F.struct("a", "c")).alias("e")).withColumn("heads", heads)
    one = _cut(one, "ring-meetings")
    tails = one.filter("not heads").join(one.filter("heads").select("part", "v", F.col("ring").alias("head")), ["part", "v"])
    hooks = tails.groupBy("part", "ring").agg(F.min(F.struct("v", "head")).alias("h")).select("part", "ring", "h.v", "h.head")
    group = hooks.join(one, ["part", "v", "ring"]).select("part", "v", "head", "e.*")
    host = hooks.select("part", "v", "head").distinct().join(one.select("part", "v", F.col("ring").alias("head"), "e"), ["part", "v", "head"]).select("part", "v", "head", "e.*")
    group = group.unionByName(host)
    w = Window.partitionBy("part", "v", "head").orderBy("a")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = group.select("part", "a", F.col("v").alias("b"), F.coalesce(F.lead("c").over(w), F.first("c").over(whole)).alias("other"))
    return s.select("part", "a", "b", "c").join(turned, ["part", "a", "b"], "left").select("part", "a", "b", F.coalesce("other", "c").alias("c"))


def rings(edges: DataFrame, splice: bool = True) -> DataFrame:
    """part, ring (from 0 in each part), position (from 0), node: closed walks over directed edges (part, a, b), each edge in one of them.

    A ring begins with its least edge, rings are numbered by it. With splice, rings that share a node are one, in which the node comes as often as it is passed.
    """
    # edges are made once, though each is followed and follows
    s, turn = ranked(successors(_cut(edges.select("part", "a", "b"), "outline-edges"))), 0
    while splice and (follow := _spliced(s, turn)) is not None:
        s, turn = ranked(_cut(follow, "ring-follow")), turn + 1
    size = s.groupBy("part", "la", "lb").agg(F.count("*").alias("size"))
    # outlines have few rings for their edges: a part's rings are numbered in one window
    size = size.withColumn("ring", F.row_number().over(Window.partitionBy("part").orderBy("la", "lb")) - 1)
    placed = s.join(size, ["part", "la", "lb"])
    return placed.select("part", "ring", F.pmod(F.col("size") - F.col("ahead"), F.col("size")).alias("position"), F.col("a").alias("node"))


def ring_lines(walks: DataFrame, nodes: DataFrame) -> DataFrame:
    """part, ring, value: each ring as a text line `part ring lon,lat lon,lat ...` that ends where it begins: what a plot program reads."""
    at = walks.join(nodes.select(F.col("gidx").alias("node"), F.concat_ws(",", "lon", "lat").alias("p")), "node")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("position", "p"))), lambda v: v["p"])
    lines = at.groupBy("part", "ring").agg(listed.alias("p"))
    return lines.select("part", "ring", F.concat_ws(" ", "part", "ring", F.array_join("p", " "), F.get("p", F.lit(0))).alias("value"))


def write_rings(walks: DataFrame, nodes: DataFrame, path: str) -> None:
    ring_lines(walks, nodes).select("value").write.text(path)


def _outlined(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Outlines of parts of the grid of orders: eight cells that touch in corners (2), what is left of that half (0), and the other half (1)."""
    points, nx, _ = orders_grid(s, d)
    cells = structured_cells(points, nx)
    i, j = F.col("cell") % nx, F.floor(F.col("cell") / nx)
    parts = cells.select("cell", F.when((i > 0) & (i < 9) & (j == 5 + i % 2), 2).when(i < nx // 2, 0).otherwise(1).alias("part"))
    return outlines(cells, parts), points


def _rings(s: SparkSession, d: str) -> DataFrame:
    return rings(_outlined(s, d)[0])


def _boundary(s: SparkSession, d: str) -> DataFrame:
    """The two ends of the grid, at the poles."""
    points, nx, _ = orders_grid(s, d)
    cells = structured_cells(points, nx)
    return rings(outlines(cells, cells.select("cell", F.lit(0).alias("part")))).select("ring", "position", "node")


def _dump(s: SparkSession, d: str) -> DataFrame:
    edges, points = _outlined(s, d)
    path = scratch(s, "rings")
    write_rings(rings(edges.filter("part = 1")), points, path)
    back = s.read.text(path).select(F.split("value", " ").alias("p"))
    return back.select(F.get("p", F.lit(0)).cast("int").alias("part"), F.get("p", F.lit(1)).cast("int").alias("ring"), (F.size("p") - 2).alias("corners"), (F.get("p", F.lit(2)) == F.element_at("p", -1)).alias("closed"))


def _steps(s: SparkSession, d: str) -> DataFrame:
    """The steps of all walks, wherever they begin: each edge once."""
    w = _cut(_rings(s, d), "walks")
    size = w.groupBy("part", "ring").agg(F.count("*").alias("size"))
    step = w.join(size, ["part", "ring"]).select("part", "ring", F.pmod(F.col("position") + 1, F.col("size")).alias("position"), F.col("node").alias("a"))
    return step.join(w, ["part", "ring", "position"]).select("part", "a", F.col("node").alias("b"))


_E = f"""(WITH p AS (SELECT *, CASE WHEN i BETWEEN 1 AND 8 AND j = 5 + i % 2 THEN 2 WHEN i < nx//2 THEN 0 ELSE 1 END AS part FROM {CELLS_SQL}),
 e AS (SELECT part, nodes[k+1] AS a, nodes[(k+1)%4+1] AS b FROM p, (SELECT unnest([0,1,2,3]) AS k))
 SELECT part, a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.part = e.part AND f.a = e.b AND f.b = e.a))"""
QUERIES = {"pt10_ring_edges": _steps, "st3_boundary_rings": _boundary, "pt10_rings": lambda s, d: rings(_outlined(s, d)[0].filter("part = 1")), "io22_ring_lines": _dump}
_WALK = """walk AS (SELECT a AS start, 0::BIGINT AS position, a, b FROM (SELECT a, b FROM e ORDER BY a, b LIMIT 1) UNION ALL SELECT start, position + 1, e.a, e.b FROM walk JOIN e ON e.a = walk.b WHERE e.a <> start)"""
ORACLES = {
    "io22_ring_lines": f"SELECT 1 AS part, 0 AS ring, (count(*) + 1)::INT AS corners, true AS closed FROM {_E} WHERE part = 1",
    "pt10_ring_edges": f"SELECT part, a, b FROM {_E}",
    "st3_boundary_rings": f"SELECT ring, position, node FROM (SELECT 0 AS ring, (nx - i) % nx AS position, i AS node FROM {CELLS_SQL} WHERE j = 0 UNION ALL SELECT 1, i, (ny-1)*nx + i FROM {CELLS_SQL} WHERE j = 0)",
    "pt10_rings": f"WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM {_E} WHERE part = 1), {_WALK} SELECT 1 AS part, 0 AS ring, position, a AS node FROM walk",
}
