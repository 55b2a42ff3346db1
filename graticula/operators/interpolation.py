"""Interpolation: a method makes weights (row, col, w) once, and they are applied to any number of fields by joins.

Structured methods find a target's cell by arithmetic and fetch stencil points by an equi-join on (i, j); no neighbour search is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.functions.geometry import course
from graticula.operators.elements import finite_element
from graticula.operators.octree import in_cells, levels_of, nearest, own_level, width
from graticula.operators.planar import planar_weights
from graticula.operators.sparse import apply, normalised, transpose
from graticula.operators.structured import structured_weights
from graticula.sources.grids import regular_lonlat
from graticula.sources.meshes import GRID_SQL, field_sql, grid_size, grid_sql, orders_field
from graticula.sources.tables import CUSTOMERS_SQL, POINTS_SQL, customer_points, order_points


def nearest_neighbour(source: DataFrame, target: DataFrame, digits: int = 12) -> DataFrame:
    return nearest(target, source, 1, digits=digits).select(F.col("target").alias("row"), F.col("source").alias("col"), F.lit(1.0).alias("w"))


def k_nearest(source: DataFrame, target: DataFrame, k: int, radius: float = 6371229.0, digits: int = 12) -> DataFrame:
    """w = 1 / (1 + d^2), d in the length of the radius, scaled to 1 by row."""
    d = F.col("d") * radius
    near = nearest(target, source, k, digits=digits).select(F.col("target").alias("row"), F.col("source").alias("col"), (1.0 / (1.0 + d * d)).alias("w"))
    return normalised(near)


# Structured methods on regular lon-lat grids: nx points a row from lon 0, ny rows from 90 to -90 (or a given first row and step).


def _linear(f: Column) -> list[tuple[int, Column]]:
    return [(0, 1.0 - f), (1, f)]


def _cubic(f: Column) -> list[tuple[int, Column]]:
    """Lagrange weights of four equidistant points at -1, 0, 1, 2."""
    return [
        (-1, -f * (f - 1.0) * (f - 2.0) / 6.0),
        (0, (f + 1.0) * (f - 1.0) * (f - 2.0) / 2.0),
        (1, -f * (f + 1.0) * (f - 2.0) / 2.0),
        (2, f * (f + 1.0) * (f - 1.0) / 6.0),
    ]


def structured(targets: DataFrame, nx: int, ny: int, kind: str) -> DataFrame:
    """Weights of targets (gidx, lon, lat) for the regular grid nx by ny with both poles: `bilinear`, `bicubic` or `biquasicubic`.

    Rows beyond a pole are the same rows half way round. `biquasicubic` is linear along the outer rows and cubic along the inner ones.
    """
    dx, dy = 360.0 / nx, 180.0 / (ny - 1)
    u, v = F.col("lon") / dx, (90.0 - F.col("lat")) / dy
    t = targets.select(F.col("gidx").alias("row"), F.floor(u).alias("i0"), F.least(F.floor(v), F.lit(ny - 2)).alias("j0"), u.alias("u"), v.alias("v"))
    fx, fy = F.col("u") - F.col("i0"), F.col("v") - F.col("j0")
    rows = _linear(fy) if kind == "bilinear" else _cubic(fy)
    entries = []
    for dj, wy in rows:
        inner = dj in (0, 1)
        for di, wx in _linear(fx) if kind == "bilinear" or (kind == "biquasicubic" and not inner) else _cubic(fx):
            entries.append(F.struct((F.col("i0") + di).alias("i"), (F.col("j0") + dj).alias("j"), (wx * wy).alias("w")))
    e = t.select("row", F.inline(F.array(*entries)))
    over = (F.col("j") < 0) | (F.col("j") > ny - 1)
    j = F.when(F.col("j") < 0, -F.col("j")).when(F.col("j") > ny - 1, 2 * (ny - 1) - F.col("j")).otherwise(F.col("j"))
    i = F.pmod(F.col("i") + F.when(over, F.lit(nx // 2)).otherwise(F.lit(0)), F.lit(nx))
    w = e.select("row", (j * nx + i).alias("col"), "w").filter("w <> 0")
    # a stencil meets a point twice only where it reaches round a row, or half way round to its own image beyond a pole
    return w if nx >= 8 else w.groupBy("row", "col").agg(F.sum("w").alias("w"))


def limited(weights: DataFrame, field: DataFrame, inner: DataFrame) -> DataFrame:
    """W x, held between the least and the greatest value of the inner stencil (row, col)."""
    bounds = inner.join(field.withColumnRenamed("gidx", "col"), "col").groupBy("row").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return apply(weights, field).join(bounds, "row").select("row", F.least(F.greatest("value", "lo"), "hi").alias("value"))


def vertical_linear(levels: DataFrame, targets: DataFrame) -> DataFrame:
    """Weights (row, col, w) of heights z (row, z) for levels (lev, z): constant beyond the ends; an as-of step by ordered pairs of levels."""
    w = Window.orderBy("z")  # levels are few: tens, not data
    pairs = levels.select(F.col("lev").alias("a"), F.col("z").alias("z0"), F.lead("lev").over(w).alias("b"), F.lead("z").over(w).alias("z1"), F.lag("z").over(w).alias("below"))
    t = targets.join(
        F.broadcast(pairs), ((F.col("z") >= F.col("z0")) | F.col("below").isNull()) & ((F.col("z") < F.col("z1")) | F.col("z1").isNull())
    )
    f = F.when(F.col("z1").isNull() | (F.col("z") <= F.col("z0")), F.lit(0.0)).otherwise((F.col("z") - F.col("z0")) / (F.col("z1") - F.col("z0")))
    both = F.array(F.struct(F.col("a").alias("col"), (1.0 - f).alias("w")), F.struct(F.col("b").alias("col"), f.alias("w")))
    return t.select("row", F.inline(both)).filter("w > 1e-9 and col is not null")


# Grid boxes of regular grids: overlap of intervals, exactly.


def boxes(points: DataFrame, dx: float, dy: float) -> DataFrame:
    """Box (west, east, south, north) around each point, cut at the poles."""
    half = dy / 2
    return points.select("gidx", (F.col("lon") - dx / 2).alias("west"), (F.col("lon") + dx / 2).alias("east"), F.greatest(F.col("lat") - half, F.lit(-90.0)).alias("south"), F.least(F.col("lat") + half, F.lit(90.0)).alias("north"))


def box_area(west: Column, east: Column, south: Column, north: Column) -> Column:
    return F.radians(east - west) * (F.sin(F.radians(north)) - F.sin(F.radians(south)))


#: Degrees of a tile of level 0.
TURN = 1440.0


def grid_box_average(source: DataFrame, target: DataFrame) -> DataFrame:
    """w = overlap area / area of the target's box; boxes meet by an equi-join on lon-lat tiles, also across the date line.

    Each box lies in tiles of the level of its own size and in those of all coarser levels there are; two boxes meet at the coarser of their levels. Each
    overlap is counted in the tile that holds its south-west corner.
    """
    side = lambda w, e, s, n: own_level(F.greatest(F.col(e) - F.col(w), F.col(n) - F.col(s)), TURN)
    s = source.select(F.col("gidx").alias("col"), "south", "north", F.inline(F.array(*(F.struct((F.col("west") + k).alias("west"), (F.col("east") + k).alias("east")) for k in (-360.0, 0.0, 360.0)))))
    s = s.withColumn("lev", side("west", "east", "south", "north"))
    t = target.select(F.col("gidx").alias("row"), *(F.col(c).alias(f"t_{c}") for c in ("west", "east", "south", "north"))).withColumn("lev", side("t_west", "t_east", "t_south", "t_north"))
    levels = levels_of(s, t)
    s = in_cells(s, TURN, levels, tx=(F.col("west"), F.col("east")), ty=(F.col("south"), F.col("north"))).withColumnRenamed("own", "s_own")
    t = in_cells(t, TURN, levels, tx=(F.col("t_west"), F.col("t_east")), ty=(F.col("t_south"), F.col("t_north"))).withColumnRenamed("own", "t_own")
    w, e, so, n = F.greatest("west", "t_west"), F.least("east", "t_east"), F.greatest("south", "t_south"), F.least("north", "t_north")
    j = t.join(s, ["lev", "tx", "ty"]).filter("s_own = lev or t_own = lev").withColumns({"w0": w, "e0": e, "s0": so, "n0": n}).filter("e0 > w0 and n0 > s0")
    tile = width(F.col("lev"), TURN)
    j = j.filter((F.floor(F.col("w0") / tile) == F.col("tx")) & (F.floor(F.col("s0") / tile) == F.col("ty")))
    part = box_area(F.col("w0"), F.col("e0"), F.col("s0"), F.col("n0")) / box_area(F.col("t_west"), F.col("t_east"), F.col("t_south"), F.col("t_north"))
    return j.groupBy("row", "col").agg(F.sum(part).alias("w"))


def grid_box_maximum(weights: DataFrame, field: DataFrame) -> DataFrame:
    """The largest source value among the boxes that overlap a target's."""
    return weights.join(field.withColumnRenamed("gidx", "col"), "col").groupBy("row").agg(F.max("value").alias("value"))


def binning(auxiliary: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """The transpose of an auxiliary scheme (targets to sources), weighted by source areas (gidx, area), scaled to 1 by row."""
    w = transpose(auxiliary)
    if areas is not None:
        w = w.join(areas.select(F.col("gidx").alias("col"), "area"), "col").select("row", "col", (F.col("w") * F.col("area")).alias("w"))
    return normalised(w)


def spherical_vector(weights: DataFrame, source: DataFrame, target: DataFrame, wind: DataFrame) -> DataFrame:
    """u and v at the targets: each source's wind is turned by the difference of the courses between source and target."""
    s = source.select(F.col("gidx").alias("col"), F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    t = target.select(F.col("gidx").alias("row"), "lon", "lat")
    j = weights.join(s, "col").join(t, "row").join(wind.select(F.col("gidx").alias("col"), "u", "v"), "col")
    a, b = course(F.col("slon"), F.col("slat"), F.col("lon"), F.col("lat"))
    d = F.radians(a - b)
    j = j.select("row", "w", (F.col("u") * F.cos(d) - F.col("v") * F.sin(d)).alias("u"), (F.col("u") * F.sin(d) + F.col("v") * F.cos(d)).alias("v"))
    return j.groupBy("row").agg(F.sum(F.col("w") * F.col("u")).alias("u"), F.sum(F.col("w") * F.col("v")).alias("v"))


#: Methods by name, with older names of the same ones.
METHODS: dict[str, Callable[..., DataFrame]] = {
    "nearest-neighbour": nearest_neighbour,
    "k-nearest-neighbours": k_nearest,
    "grid-box-average": grid_box_average,
    "binning": binning,
    "finite-element": finite_element,
    "unstructured-bilinear-lonlat": planar_weights,
    "structured-bilinear": lambda source, target: structured_weights(target, source, "bilinear"),
    "regular-bilinear": lambda targets, nx, ny: structured(targets, nx, ny, "bilinear"),
    "structured-bicubic": lambda source, target: structured_weights(target, source, "bicubic"),
    "regular-bicubic": lambda targets, nx, ny: structured(targets, nx, ny, "bicubic"),
    "structured-biquasicubic": lambda source, target: structured_weights(target, source, "biquasicubic"),
    "regular-biquasicubic": lambda targets, nx, ny: structured(targets, nx, ny, "biquasicubic"),
}
ALIASES = {"bilinear": "structured-bilinear", "bicubic": "structured-bicubic", "biquasicubic": "structured-biquasicubic", "knn": "k-nearest-neighbours"}


def method(name: str) -> Callable[..., DataFrame]:
    name = ALIASES.get(name, name)
    if name not in METHODS:
        raise ValueError(f"no interpolation method is called {name}")
    return METHODS[name]


def _targets(s: SparkSession, d: str) -> DataFrame:
    return customer_points(s, d).select("gidx", "lon", "lat")


def _points(s: SparkSession, d: str) -> DataFrame:
    return order_points(s, d).select("gidx", "lon", "lat")


def _plane(s: SparkSession, nx: int, ny: int, f: Callable[[Column, Column], Column]) -> DataFrame:
    """A field of the fixed size nx ny, for whatever number of targets: it is what joins broadcast, not the weights."""
    return F.broadcast(regular_lonlat(s, nx, ny).select("gidx", f(F.col("lon"), F.col("lat")).alias("value")))


_wave = lambda lon, lat: F.sin(F.radians(lon)) * F.cos(F.radians(lat)) + F.sin(F.radians(lat))


def _structured(kind: str):
    return lambda s, d: apply(structured(_targets(s, d), 72, 37, kind), _plane(s, 72, 37, _wave)).select("row", (F.round("value", 6) + 0.0).alias("value"))


def _boxed(s: SparkSession, nx: int, ny: int) -> DataFrame:
    return boxes(regular_lonlat(s, nx, ny), 360.0 / nx, 180.0 / (ny - 1))


def _box_weights(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """From the grid of orders to that of customers, and the field of orders."""
    (nx, ny), (mx, my) = grid_size(s, d), grid_size(s, d, "customer")
    return grid_box_average(_boxed(s, nx, ny), _boxed(s, mx, my)), orders_field(s, d, nx * ny).withColumnRenamed("node", "gidx")


def _average(s: SparkSession, d: str) -> DataFrame:
    return apply(*_box_weights(s, d)).select("row", (F.round("value", 6) + 0.0).alias("value"))


def _vertical(s: SparkSession, d: str) -> DataFrame:
    levels = s.range(6).select(F.col("id").alias("lev"), (F.col("id") * F.col("id") * 0.04).alias("z"))
    targets = customer_points(s, d).select(F.col("gidx").alias("row"), ((F.col("gidx") % 113) / 100.0 - 0.05).alias("z"))
    return vertical_linear(levels, targets).select("row", "col", F.round("w", 6).alias("w"))


_NEAR = f"""WITH t AS (SELECT gidx AS target, cos(radians(lon))*cos(radians(lat)) AS x, sin(radians(lon))*cos(radians(lat)) AS y, sin(radians(lat)) AS z FROM {CUSTOMERS_SQL}),
s AS (SELECT gidx AS source, value, cos(radians(lon))*cos(radians(lat)) AS x, sin(radians(lon))*cos(radians(lat)) AS y, sin(radians(lat)) AS z FROM {POINTS_SQL}),
p AS (SELECT target, source, value, round(sqrt(power(t.x-s.x,2)+power(t.y-s.y,2)+power(t.z-s.z,2)),7) AS d FROM t, s),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY d, source) AS rank FROM p)"""
_BIL = """WITH t AS (SELECT gidx AS row, lon/5 AS u, (90-lat)/5 AS v FROM {c}),
c AS (SELECT row, floor(u)::INT AS i, least(floor(v), 35)::INT AS j, u, v FROM t),
e AS (SELECT row, (i+a) AS i, (j+b) AS j, (CASE WHEN a=0 THEN 1-(u-i) ELSE u-i END)*(CASE WHEN b=0 THEN 1-(v-j) ELSE v-j END) AS w FROM c, (SELECT unnest([0,1]) AS a), (SELECT unnest([0,1]) AS b))
SELECT row, round(sum(w*(sin(radians(i*5))*cos(radians(90-j*5)) + sin(radians(90-j*5)))), 6) + 0.0 AS value FROM e GROUP BY row""".format(c=CUSTOMERS_SQL)
QUERIES = {
    "in1_nearest_neighbour": lambda s, d: apply(nearest_neighbour(_points(s, d), _targets(s, d), 7), order_points(s, d).select("gidx", "value")),
    "in2_k_nearest": lambda s, d: apply(k_nearest(_points(s, d), _targets(s, d), 4, 1.0, 7), order_points(s, d).select("gidx", F.sqrt("value").alias("value"))).select("row", F.round("value", 6).alias("value")),
    "in3_grid_box_average": _average,
    "in4_grid_box_maximum": lambda s, d: (lambda w, f: grid_box_maximum(w.filter("w > 1e-9"), f))(*_box_weights(s, d)),  # boxes that touch within rounding do not overlap
    "in5_grid_boxes": lambda s, d: _boxed(s, *grid_size(s, d)).select("gidx", F.round(box_area(F.col("west"), F.col("east"), F.col("south"), F.col("north")), 6).alias("area")),
    "in9_structured_bilinear": _structured("bilinear"),
    "in10_structured_bicubic": _structured("bicubic"),
    "in11_structured_biquasicubic": _structured("biquasicubic"),
    "in13_vertical_linear": _vertical,
    "in14_limiter": lambda s, d: limited(structured(_targets(s, d), 72, 37, "bicubic"), _plane(s, 72, 37, _wave), structured(_targets(s, d), 72, 37, "bilinear")).select("row", (F.round("value", 6) + 0.0).alias("value")),
    "in17_binning": lambda s, d: apply(binning(nearest_neighbour(_targets(s, d), _points(s, d), 7)), order_points(s, d).select("gidx", F.sqrt("value").alias("value"))).select("row", F.round("value", 6).alias("value")),
}
_BOX = "SELECT gidx, lon - 180.0/nx AS w, lon + 180.0/nx AS e, greatest(lat - 90.0/(ny-1), -90) AS b, least(lat + 90.0/(ny-1), 90) AS t"
_BOXES = f"""WITH s AS MATERIALIZED (SELECT gidx AS col, w + o AS w, e + o AS e, b, t, value FROM ({_BOX} FROM {GRID_SQL}) x JOIN {field_sql('nx * ny')} f ON f.node = gidx, (SELECT unnest([-360, 0, 360]) AS o)),
t AS MATERIALIZED (SELECT gidx AS row, w, e, b, t FROM ({_BOX} FROM {grid_sql('customer')})),
p AS (SELECT row, value, (least(s.e, t.e) - greatest(s.w, t.w))*(sin(radians(least(s.t, t.t))) - sin(radians(greatest(s.b, t.b))))/((t.e - t.w)*(sin(radians(t.t)) - sin(radians(t.b)))) AS part FROM s JOIN t ON least(s.e, t.e) > greatest(s.w, t.w) AND least(s.t, t.t) > greatest(s.b, t.b))"""
ORACLES = {
    "in3_grid_box_average": f"{_BOXES} SELECT row, round(sum(part*value), 6) + 0.0 AS value FROM p WHERE part > 0 GROUP BY row",
    "in4_grid_box_maximum": f"{_BOXES} SELECT row, max(value) AS value FROM p WHERE part > 1e-9 GROUP BY row",
    "in1_nearest_neighbour": f"{_NEAR} SELECT target AS row, value FROM k WHERE rank = 1",
    "in2_k_nearest": f"{_NEAR} SELECT target AS row, round(sum(sqrt(value)/(1+d*d))/sum(1/(1+d*d)), 6) AS value FROM k WHERE rank <= 4 GROUP BY target",
    "in5_grid_boxes": f"SELECT gidx, round(radians(e - w)*(sin(radians(t)) - sin(radians(b))), 6) AS area FROM ({_BOX} FROM {GRID_SQL})",
    "in9_structured_bilinear": _BIL,
    "in13_vertical_linear": """WITH t AS (SELECT c_custkey AS row, (c_custkey % 113)/100.0 - 0.05 AS z FROM customer), l AS (SELECT k::BIGINT AS k, k*k*0.04 AS z FROM (SELECT unnest(range(6)) AS k)),
 e AS (SELECT row, k AS col, CASE WHEN t.z <= 0 THEN (CASE WHEN k = 0 THEN 1 ELSE 0 END) WHEN t.z >= 1 THEN (CASE WHEN k = 5 THEN 1 ELSE 0 END) WHEN t.z >= l.z THEN greatest(0, 1 - (t.z-l.z)/((k+1)*(k+1)*0.04 - l.z)) ELSE greatest(0, 1 - (l.z-t.z)/(l.z - (k-1)*(k-1)*0.04)) END AS w FROM t, l)
 SELECT row, col, round(w::DOUBLE, 6) AS w FROM e WHERE w > 1e-9""",
    "in17_binning": f"""WITH s AS (SELECT gidx AS tgt, cos(radians(lon))*cos(radians(lat)) AS x, sin(radians(lon))*cos(radians(lat)) AS y, sin(radians(lat)) AS z FROM {CUSTOMERS_SQL}),
 t AS (SELECT gidx, value, cos(radians(lon))*cos(radians(lat)) AS x, sin(radians(lon))*cos(radians(lat)) AS y, sin(radians(lat)) AS z FROM {POINTS_SQL}),
 n AS (SELECT gidx, value, arg_min(tgt, (round(sqrt(power(t.x-s.x,2)+power(t.y-s.y,2)+power(t.z-s.z,2)),7), tgt)) AS row FROM t, s GROUP BY gidx, value)
 SELECT row, round(avg(sqrt(value)), 6) AS value FROM n GROUP BY row""",
}
