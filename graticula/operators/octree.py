"""Search structures that follow the density: an octree of points, and levels of cells for things that have a size.

Points on the unit sphere are dealt to the cells of the cube around it, level by level: a cell with more than LEAF points is cut into eight by eight by eight. So a cluster
gets deep cells and an empty region none, and each leaf holds a few points. The k nearest points are found from the top: each target keeps the cells
that may hold one of its k nearest, going by the boxes of the points in the cells and by their numbers, and all targets go down a level with one equi-join.

Polygons, boxes and elements are kept in cells of the level of their own size, so each lies in a few cells, and a large one costs what a small one does. What is
looked up goes to every level that is there: at most DEEPEST + 1 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.functions.geometry import xyz
from graticula.sources.records import scratch

#: Points of a leaf, or k if that is more.
LEAF = 16
#: Bits of every coordinate at each level of the tree.
BITS = (2, 5, 8, 11, 14, 17, 20)
#: Finest level of things with a size.
DEEPEST = 24

CELL = ("cx", "cy", "cz")
BOX = tuple(f"{c}{k}" for c in "xyz" for k in (0, 1))


def _cut(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tree(points: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (lev, cx, cy, cz, n, leaf, the box of their points), points with their leaf (lev, cx, cy, cz), and the number of levels.

    points: gidx, lon, lat. A node of the last level is a leaf whatever it holds: points of a few metres, or the same place.
    """
    x, y, z = xyz(F.col("lon"), F.col("lat"))
    at = points.select("gidx", x.alias("x"), y.alias("y"), z.alias("z"))
    bits, deepest = BITS[-1], len(BITS)
    at = at.withColumns({f"i{c}": F.least(F.floor((F.col(c) + 1.0) * 2.0 ** (bits - 1)), F.lit((1 << bits) - 1)) for c in "xyz"})
    at = _cut(at, "tree-points")
    at_level = lambda lev: at.withColumns({f"c{c}": F.shiftright(f"i{c}", bits - BITS[lev - 1]) for c in "xyz"})
    nodes, leaves, large = None, None, None
    for lev in range(1, deepest + 1):
        # points of the cells of the level before that are no leaves
        a = at_level(lev)
        if large is not None:
            step = BITS[lev - 1] - BITS[lev - 2]
            parent = [F.shiftright(f"c{c}", step) == F.col(f"p{c}") for c in "xyz"]
            a = a.join(large.select(*(F.col(f"c{c}").alias(f"p{c}") for c in "xyz")), parent, "left_semi")
        box = [f(c).alias(f"{c}{k}") for c in "xyz" for k, f in enumerate((F.min, F.max))]
        found = a.groupBy(*CELL).agg(F.count("*").alias("n"), *box).withColumn("leaf", (F.col("n") <= leaf) | F.lit(lev == deepest))
        found = _cut(found.select(F.lit(lev).alias("lev"), *CELL, "n", "leaf", *BOX), "tree-nodes")
        nodes = found if nodes is None else nodes.unionByName(found)
        mine = at_level(lev).join(found.filter("leaf").select(*CELL), list(CELL)).select(F.lit(lev).alias("lev"), *CELL, "gidx", "x", "y", "z")
        leaves = mine if leaves is None else leaves.unionByName(mine)
        large = found.filter("not leaf")
        if lev == deepest or large.isEmpty():
            return nodes, leaves, lev
    raise AssertionError("unreachable")


def nearest(targets: DataFrame, sources: DataFrame, k: int, digits: int = 12) -> DataFrame:
    """target, source, d, rank: the k nearest sources of each target (fewer only if there are fewer sources), by straight-line distance on the unit sphere.

    Distances are compared after rounding to `digits`, so ties are ties on every machine; they go to the lowest source. Targets at one place have one search
    between them, and of sources at one place only the k lowest can be among the nearest.
    """
    spark = targets.sparkSession
    kinds = [f"{n} {df.schema['gidx'].dataType.simpleString()}" for n, df in (("target", targets), ("source", sources))]
    if k < 1 or sources.isEmpty():
        return spark.createDataFrame([], f"{', '.join(kinds)}, d double, rank int")
    lowest = F.row_number().over(Window.partitionBy("lon", "lat").orderBy("gidx"))
    sources = sources.select("gidx", "lon", "lat").withColumn("__n", lowest).filter(F.col("__n") <= k).drop("__n")
    nodes, leaves, levels = tree(sources, max(LEAF, k))
    x, y, z = xyz(F.col("lon"), F.col("lat"))
    # a place goes by its lowest target
    places = _cut(targets.groupBy("lon", "lat").agg(F.min("gidx").alias("target")), "places")
    t = places.select("target", x.alias("tx"), y.alias("ty"), z.alias("tz"))
    root = nodes.filter("lev = 1").drop("lev")
    front = t.crossJoin(F.broadcast(root)).withColumn("own", F.lit(1))  # at most 64 rows
    for lev in range(1, levels + 1):
        near = _near(front, k, 10.0**-digits)
        if lev == levels:
            break
        # used twice below: leaves stay as they are and go on to bound the rest
        near = _cut(near, "near-cells")
        child = nodes.filter(F.col("lev") == lev + 1).drop("lev").withColumns({f"p{c}": F.shiftright(f"c{c}", BITS[lev] - BITS[lev - 1]) for c in "xyz"})
        parent = near.filter("not leaf").select("target", "tx", "ty", "tz", *(F.col(f"c{c}").alias(f"p{c}") for c in "xyz"))
        down = parent.join(child, ["px", "py", "pz"]).select("target", "tx", "ty", "tz", F.lit(lev + 1).alias("own"), *CELL, "n", "leaf", *BOX)
        front = down.unionByName(near.filter("leaf").select(*down.columns))
    found = near.select("target", "tx", "ty", "tz", F.col("own").alias("lev"), *CELL).join(leaves, ["lev", *CELL])
    d = F.sqrt((F.col("tx") - F.col("x")) ** 2 + (F.col("ty") - F.col("y")) ** 2 + (F.col("tz") - F.col("z")) ** 2)
    pairs = found.select("target", F.col("gidx").alias("source"), F.round(d, digits).alias("d"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("d", "source"))).filter(F.col("rank") <= k)
    at = places.select(F.col("target").alias("__place"), F.col("lon").alias("__lon"), F.col("lat").alias("__lat")).join(pairs.withColumnRenamed("target", "__place"), "__place")
    here = F.col("lon").eqNullSafe(F.col("__lon")) & F.col("lat").eqNullSafe(F.col("__lat"))
    return targets.select(F.col("gidx").alias("target"), "lon", "lat").join(at, here).select("target", "source", "d", "rank")


def _near(front: DataFrame, k: int, eps: float) -> DataFrame:
    """The cells of each target that may hold one of its k nearest: those nearer than the farthest corners of the nearest cells with k points between them."""
    low = {c: F.greatest(F.col(f"{c}0") - F.col(f"t{c}"), F.col(f"t{c}") - F.col(f"{c}1"), F.lit(0.0)) for c in "xyz"}
    high = {c: F.greatest(F.abs(F.col(f"{c}0") - F.col(f"t{c}")), F.abs(F.col(f"{c}1") - F.col(f"t{c}"))) for c in "xyz"}
    length = lambda v: F.sqrt(v["x"] ** 2 + v["y"] ** 2 + v["z"] ** 2)
    f = front.withColumns({"__low": length(low), "__high": length(high)})
    upto = Window.partitionBy("target").orderBy("__high").rangeBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("__k", F.sum("n").over(upto))
    bound = F.min(F.when(F.col("__k") >= k, F.col("__high"))).over(Window.partitionBy("target"))
    f = f.withColumn("__bound", bound).filter(F.col("__bound").isNull() | (F.col("__low") <= F.col("__bound") + 2 * eps))
    return f.drop("__low", "__high", "__k", "__bound")


# Things with a size.


def own_level(size: Column, base: float) -> Column:
    """The finest level whose cells, base / 2 ** level wide, are as wide as size."""
    return F.greatest(F.lit(0), F.least(F.lit(DEEPEST), F.floor(F.log2(F.lit(base) / F.greatest(size, F.lit(base * 2.0**-DEEPEST)))))).cast("int")


def width(level: Column, base: float) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), -level)


def levels_of(*things: DataFrame, level: str = "lev") -> list[int]:
    """The levels that are there: at most DEEPEST + 1."""
    return sorted({r[0] for t in things for r in t.select(level).distinct().collect()})


def at_levels(points: DataFrame, levels: list[int], base: float, **axes: str) -> DataFrame:
    """points once for each level, with lev and the cell on each axis (cell=coordinate)."""
    out = points.withColumn("lev", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    return out.withColumns({cell: F.floor(F.col(c) / width(F.col("lev"), base)) for cell, c in axes.items()})


def at_common_levels(things: DataFrame, others: list[int]) -> DataFrame:
    """things (with lev) once for each level at which they can meet others of those levels: their own, if others are as fine, and the others' coarser ones; own tells them apart."""
    own, none = F.col("lev"), F.array().cast("array<int>")
    coarser = F.filter(F.array(*map(F.lit, others)) if others else none, lambda v: v < own)
    levels = F.concat(coarser, F.when(own <= max(others, default=-1), F.array(own)).otherwise(none))
    return things.withColumn("own", own).withColumn("lev", F.explode(levels))


def in_cells(things: DataFrame, base: float, coarser: list[int] | None = None, **axes: tuple[Column, Column]) -> DataFrame:
    """things (with lev) once for each cell that they meet on each axis (cell=(low, high)); with coarser, at their own level and at those of the list above it: own tells them apart."""
    if coarser is not None:
        things = things.withColumn("own", F.col("lev")).withColumn("lev", F.explode(F.filter(F.array(*map(F.lit, coarser)), lambda v: v <= F.col("own"))))
    for cell, (low, high) in axes.items():
        w = width(F.col("lev"), base)
        things = things.withColumn(cell, F.explode(F.sequence(F.floor(low / w), F.floor(high / w))))
    return things
