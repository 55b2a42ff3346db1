"""Node orders that keep neighbours near: reverse Cuthill-McKee, level by level.

The serial order is a breadth-first search: nodes are visited in the order of their parents, those of one parent by degree. That is an order by levels, and in a
level by (the parent's rank, degree, number), where a node's parent is its neighbour of least rank in the level before. So each level is one join with the
level before and one ranking, and the rounds grow with the number of levels, not of nodes. All components are searched at once: each has a
start of its own, a node of least degree as far away from the first as a few searches find it, and components follow each other by their starts' degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.operators.exchange import renumber
from graticula.operators.mesh import facets
from graticula.sources.records import scratch
from graticula.sources.tables import table


def _cut(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that Spark may broadcast: it takes files for as large as they are compressed, so it would broadcast many more.
SMALL = 100_000


def _side(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join, told not to be broadcast if it has many rows."""
    return df.hint("merge") if rows > SMALL else df


def neighbours(cells: DataFrame) -> DataFrame:
    """a, b: both ways, the nodes that an edge of a cell joins."""
    f = facets(cells).filter("n0 <> n1").select("n0", "n1")
    return f.select(F.inline(F.array(F.struct(F.col("n0").alias("a"), F.col("n1").alias("b")), F.struct(F.col("n1").alias("a"), F.col("n0").alias("b")))))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, component: the least node that each is joined to, by hooking to the least neighbour and jumping to its component's component."""
    label = _cut(nodes.select("node", F.col("node").alias("component")), "components")
    n = label.count()
    while True:
        near = links.join(_side(label.select(F.col("node").alias("b"), "component"), n), "b").groupBy("a").agg(F.min("component").alias("near"))
        hooked = label.join(_side(near.withColumnRenamed("a", "node"), n), "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("least"))
        hooked = _cut(hooked, "components")
        # the root of each component follows the least that any of its nodes saw, and nodes follow their root
        root = hooked.groupBy("component").agg(F.min("least").alias("to"))
        jumped = hooked.join(_side(root, n), "component").select("node", "component", F.col("to").alias("new"))
        after = jumped.select(F.col("node").alias("new"), F.col("new").alias("further"))
        jumped = _cut(jumped.join(_side(after, n), "new").select("node", "component", F.least("new", "further").alias("new")), "components")
        if jumped.filter("new <> component").isEmpty():
            return jumped.select("node", "component")
        label = jumped.select("node", F.col("new").alias("component"))


def levels_from(starts: DataFrame, links: DataFrame) -> DataFrame:
    """node, component, lev of all nodes that the starts (node, component) reach: one semi-join a level, from the last level only."""
    # made once, not once a level
    links = _cut(links.select("a", "b"), "links")
    front = _cut(starts.select("node", "component", F.lit(0).alias("lev")), "levels")
    last, out, lev, n, before = None, front, 0, front.count(), 0
    while True:
        lev += 1
        reached = links.join(_side(front.select(F.col("node").alias("a"), "component"), n), "a").select(F.col("b").alias("node"), "component").distinct()
        # neighbours of a level lie in it, in the one before or in the next one
        new = reached.join(_side(front.select("node"), n), "node", "left_anti")
        if last is not None:
            new = new.join(_side(last.select("node"), before), "node", "left_anti")
        new = _cut(new.withColumn("lev", F.lit(lev)).select("node", "component", "lev"), "levels")
        before, n = n, new.count()
        if n == 0:
            return out
        last, front, out = front, new, out.unionByName(new)


def far_starts(nodes: DataFrame, links: DataFrame, rounds: int = 2) -> DataFrame:
    """node, component: for each component a node of least degree, then, `rounds` times, one of least degree of the last level that it reaches."""
    degree = nodes.select("node").join(links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    degree = _cut(degree, "degrees")
    pick = lambda df: df.groupBy("component").agg(F.min(F.struct("degree", "node")).alias("s")).select("s.node", "component")
    starts = _cut(pick(components(nodes, links).join(degree, "node")), "starts")
    for _ in range(rounds):
        lev = levels_from(starts, links)
        deepest = lev.groupBy("component").agg(F.max("lev").alias("lev"))
        starts = _cut(pick(lev.join(deepest, ["component", "lev"]).join(degree, "node")), "starts")
    return starts


def cuthill_mckee(nodes: DataFrame, links: DataFrame, starts: DataFrame | None = None, reverse: bool = True) -> DataFrame:
    """node, number (from 0): the (reverse) Cuthill-McKee order of nodes (node) with links (a, b), both ways. starts: one for each component (node, component)."""
    links = _cut(links.select("a", "b").filter("a <> b").distinct(), "links")
    nodes = _cut(nodes.select("node").distinct(), "nodes")
    starts = far_starts(nodes, links) if starts is None else _cut(starts, "starts")
    degree = nodes.join(links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    degree = _cut(degree, "degrees")
    total, many = degree.count(), starts.count()
    first = starts.select("node", "component").join(_side(degree, total), "node")
    front = _cut(first.select("node", "component", F.lit(0).alias("lev"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("parent"), "degree"), "ranked")
    last, out, lev, n, before = None, front, 0, many, 0
    while True:
        lev += 1
        reached = links.join(_side(front.select(F.col("node").alias("a"), "component", "rank"), n), "a").groupBy(F.col("b").alias("node"), "component").agg(F.min("rank").alias("parent"))
        new = reached.join(_side(front.select("node"), n), "node", "left_anti")
        if last is not None:
            new = new.join(_side(last.select("node"), before), "node", "left_anti")
        new = new.join(_side(degree, total), "node")
        # ranks within the level, over all components at once, by ranges: a parent's number is enough to order its children
        ranked = renumber(new.withColumn("__key", F.struct("component", "parent", "degree", "node")), "__key", "rank").drop("__key")
        ranked = _cut(ranked.select("node", "component", F.lit(lev).alias("lev"), "rank", "parent", "degree"), "ranked")
        before, n = n, ranked.count()
        if n == 0:
            break
        last, front, out = front, ranked, out.unionByName(ranked)
    lead = first.select("component", F.struct("degree", F.col("node").alias("start")).alias("lead"))
    key = F.struct("lead", "lev", "rank", "node")
    whole = renumber(out.join(_side(lead, many), "component").withColumn("__key", key), "__key").select("node", (F.col("number") - 1).alias("number"))
    if not reverse:
        return whole
    return whole.select("node", (F.lit(total - 1) - F.col("number")).alias("number"))


def bandwidth(links: DataFrame, order: DataFrame) -> DataFrame:
    """One row: the greatest and the mean distance of linked nodes in an order (node, number)."""
    at = lambda c: order.select(F.col("node").alias(c), F.col("number").alias(f"n{c}"))
    d = F.abs(F.col("na") - F.col("nb"))
    return links.join(at("a"), "a").join(at("b"), "b").agg(F.max(d).alias("bandwidth"), F.avg(d).alias("mean"))


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers (2 c) and suppliers (2 s + 1), linked where an order joins them; and the least node as the start."""
    orders, items = table(s, d, "orders", "o_orderkey", "o_custkey"), table(s, d, "lineitem", "l_orderkey", "l_suppkey")
    e = orders.hint("merge").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).distinct()
    e = _cut(e, "pairs")  # used six times
    links = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    start = links.agg(F.min("a").alias("node")).select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node")).distinct(), links, start


def _levels(s: SparkSession, d: str) -> DataFrame:
    _, links, start = _graph(s, d)
    return levels_from(start, links).select("node", "lev")


QUERIES = {"so3_graph_levels": _levels, "so3_reverse_cuthill_mckee": lambda s, d: cuthill_mckee(*_graph(s, d))}
STEPS = 10  # levels that the SQL unrolls


def _order_sql() -> str:
    out = ["""e AS (SELECT DISTINCT o_custkey*2 AS a, l_suppkey*2+1 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), k AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
g AS (SELECT a AS node, count(*) AS degree FROM k GROUP BY a), r0 AS (SELECT min(a) AS node, 0 AS lev, 1::BIGINT AS rank FROM k)"""]
    for n in range(STEPS):
        seen = " UNION ALL ".join(f"SELECT node FROM r{m}" for m in range(max(0, n - 1), n + 1))
        out.append(f"r{n + 1} AS MATERIALIZED (SELECT node, {n + 1} AS lev, row_number() OVER (ORDER BY parent, degree, node) AS rank FROM (SELECT b AS node, min(rank) AS parent FROM k JOIN r{n} ON a = node WHERE b NOT IN ({seen}) GROUP BY b) JOIN g USING (node))")
    return "WITH " + ",\n".join(out) + ", o AS (" + " UNION ALL ".join(f"SELECT * FROM r{n}" for n in range(STEPS + 1)) + ")"


ORACLES = {
    "so3_graph_levels": f"{_order_sql()} SELECT node, lev::INT AS lev FROM o",
    "so3_reverse_cuthill_mckee": f"{_order_sql()} SELECT node, count(*) OVER () - row_number() OVER (ORDER BY lev, rank) AS number FROM o",
}
