"""Structured interpolation on global grids of rows, reduced ones included, in two and three dimensions.

The rows of the source grid are a small table (one for each latitude), continued beyond both poles by the rows near the pole, half way round.
A target meets the row to its north by an equi-join on latitude bins that are as wide as a mean step between rows, so it is compared with a
few rows whatever their number; points within a row are found by arithmetic. No shuffle is needed to make the weights.

Longitudes may have any period. A target with a null coordinate or beyond a pole gets no weights. Where a row is short, an entry (row, col)
may occur twice; a product adds them up.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.operators.sparse import apply
from graticula.sources.grids import healpix
from graticula.sources.tables import CUSTOMERS_SQL, POINTS_SQL, customer_points, order_points

#: Points this close (degrees) to a row or to a point of it count as lying on it.
TOL = 0.5e-6
KINDS = ("bilinear", "bicubic", "biquasicubic")


def rows_of(points: DataFrame) -> DataFrame:
    """j, y, nx, x0, dx, first of a grid (gidx, j, lon, lat) whose rows go round the sphere, from north to south."""
    g = points.groupBy("j").agg(F.max("lat").alias("y"), F.count("*").alias("nx"), F.min("lon").alias("x0"), F.min("gidx").alias("first"))
    return g.withColumn("dx", 360.0 / F.col("nx"))


def row_stencils(rows: DataFrame) -> DataFrame:
    """j, y, south (of the next row) and the stencil: rows j - 1 to j + 2 as structs (y, x0, dx, nx, first); j from -1 to ny - 1."""
    polar = lambda c: (90.0 - F.abs(c) < TOL).cast("int")
    ends = rows.agg(F.count("*").alias("ny"), polar(F.max("y")).alias("at_north"), polar(F.min("y")).alias("at_south"))
    j, ny = F.col("j"), F.col("ny")
    over = lambda k, y, turn: F.struct(k.cast("long").alias("j"), y.alias("y"), (F.col("x0") + turn).alias("x0"))
    images = F.array(over(j, F.col("y"), 0.0), over(-j - 1 + F.col("at_north"), 180.0 - F.col("y"), 180.0), over(2 * ny - j - 1 - F.col("at_south"), -180.0 - F.col("y"), 180.0))
    kept = F.filter(images, lambda r, k: F.when(k == 0, F.lit(True)).when(k == 1, r["j"].between(-2, -1)).otherwise(r["j"].between(ny, ny + 1)))
    more = rows.crossJoin(F.broadcast(ends)).select("dx", "nx", "first", "ny", F.explode(kept).alias("r"))  # one row on the right
    more = more.select("r.j", "r.y", "ny", F.struct("r.y", "r.x0", "dx", "nx", "first").alias("row"))
    w = Window.orderBy("j")  # a row for each latitude
    near = more.select("j", "y", "ny", F.lead("y").over(w).alias("south"), F.array(F.lag("row").over(w), F.col("row"), F.lead("row").over(w), F.lead("row", 2).over(w)).alias("stencil"))
    return near.filter((F.col("j") >= -1) & (F.col("j") < F.col("ny"))).drop("ny")


def _linear(f: Column) -> list[tuple[int, Column]]:
    return [(0, 1.0 - f), (1, f)]


def _cubic(f: Column) -> list[tuple[int, Column]]:
    """Lagrange weights of four equidistant points at -1, 0, 1, 2."""
    return [(-1, -f * (f - 1.0) * (f - 2.0) / 6.0), (0, (f + 1.0) * (f - 1.0) * (f - 2.0) / 2.0), (1, -f * (f + 1.0) * (f - 2.0) / 2.0), (2, f * (f + 1.0) * (f - 1.0) / 6.0)]


def lagrange(x: Column, at: list[Column]) -> list[Column]:
    """Weights of the values at any distinct places, exact for polynomials of that many terms."""
    out = []
    for k, a in enumerate(at):
        w = F.lit(1.0)
        for b in at[:k] + at[k + 1 :]:
            w = w * (x - b) / (a - b)
        out.append(w)
    return out


def structured_weights(targets: DataFrame, points: DataFrame, kind: str = "bilinear") -> DataFrame:
    """Weights (row, col, w) of targets (gidx, lon, lat) on a global grid (gidx, j, lon, lat) of at least two rows.

    `bilinear`: two points in each of two rows. `bicubic`: four points in each of four rows, cubic along rows and across them.
    `biquasicubic`: the same rows, but linear along the outer two.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    rows = rows_of(points)
    step = 180.0 / max(1, rows.count())
    cell = lambda c: F.floor(c / step)
    s = row_stencils(rows).withColumn("bin", F.explode(F.sequence(cell(F.col("south")), cell(F.col("y") + TOL))))
    t = targets.select(F.col("gidx").alias("row"), "lon", "lat").filter("lat between -90 and 90").withColumn("bin", cell(F.col("lat")))
    # a few rows of the right side for each latitude of the grid
    t = t.join(F.broadcast(s), "bin").filter((F.col("lat") <= F.col("y") + TOL) & (F.col("lat") > F.col("south") + TOL))
    used = [F.col("stencil")[k] for k in ((1, 2) if kind == "bilinear" else range(4))]
    across = lagrange(F.col("lat"), [r["y"] for r in used])
    in_row = [F.struct(r["x0"].alias("x0"), r["dx"].alias("dx"), r["nx"].alias("nx"), r["first"].alias("first"), F.lit(k in (0, 3)).alias("outer"), wy.alias("wy")) for k, (r, wy) in enumerate(zip(used, across, strict=True))]
    # a row for each stencil row, then one for each point of it
    u = (F.col("lon") - F.col("x0")) / F.col("dx")
    p = t.select("row", "lon", F.inline(F.array(*in_row))).withColumn("i", F.floor(u + TOL / F.col("dx"))).withColumn("f", u - F.col("i"))
    f = F.col("f")
    along = _linear(f) if kind == "bilinear" else _cubic(f)
    if kind == "biquasicubic":
        straight = dict(_linear(f))
        along = [(di, F.when(F.col("outer"), straight.get(di, F.lit(0.0))).otherwise(wx)) for di, wx in along]
    entries = [F.struct((F.col("first") + F.pmod(F.col("i") + di, F.col("nx"))).alias("col"), (wx * F.col("wy")).alias("w")) for di, wx in along]
    return p.select("row", F.inline(F.array(*entries))).filter("w <> 0")


def vertical_cubic(levels: DataFrame, targets: DataFrame, linear_ends: bool = True) -> DataFrame:
    """Weights (row, col, w) of heights (row, z) for at least four levels (lev, z): cubic between inner levels, constant beyond the ends.

    Next to an end, where one side has no second level: linear, or else the cubic of the four levels there.
    """
    w = Window.orderBy("z")  # levels are few: tens, not data
    ranked = levels.select("lev", "z", (F.row_number().over(w) - 1).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))
    four = F.sort_array(F.collect_list(F.struct("k", "z", "lev")).over(Window.partitionBy()))
    base = F.least(F.greatest(F.col("k") - 1, F.lit(0)), F.col("n") - 4)
    spans = ranked.withColumn("all", four).select("k", "n", F.col("z").alias("low"), F.lead("z").over(w).alias("high"), base.alias("base"), F.slice("all", base + 1, 4).alias("c"))
    z, first, last = F.col("z"), F.col("k") == 0, F.col("k") == F.col("n") - 1
    t = targets.join(F.broadcast(spans), ((z >= F.col("low")) | first) & ((z < F.col("high")) | last))
    at = [F.col("c")[k]["z"] for k in range(4)]
    cubic = lagrange(z, at)
    f = (z - F.col("low")) / (F.col("high") - F.col("low"))
    here = F.col("k") - F.col("base")
    out = []
    for k in range(4):
        straight = F.when(here == k, 1.0 - f).when(here == k - 1, f).otherwise(0.0)
        inner = F.when(first | (F.col("k") == F.col("n") - 2), straight).otherwise(cubic[k]) if linear_ends else cubic[k]
        beyond = F.when(here == k, 1.0).otherwise(0.0)
        out.append(F.struct(F.col("c")[k]["lev"].alias("col"), F.when((first & (z <= F.col("low"))) | last, beyond).otherwise(inner).alias("w")))
    return t.select("row", F.inline(F.array(*out))).filter("w <> 0")


def product(horizontal: DataFrame, vertical: DataFrame) -> DataFrame:
    """Weights (row, col, lev, w) of points in three dimensions: a join by target."""
    v = vertical.select("row", F.col("col").alias("lev"), F.col("w").alias("__v"))
    return horizontal.join(v, "row").select("row", "col", "lev", (F.col("w") * F.col("__v")).alias("w"))


def apply_levels(weights: DataFrame, field: DataFrame) -> DataFrame:
    """(row, value) for weights (row, col, lev, w) and a field (gidx, lev, value)."""
    f = field.withColumnRenamed("gidx", "col")
    return weights.join(f, ["col", "lev"]).groupBy("row").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def extended(points: DataFrame) -> DataFrame:
    """points (gidx, lon, lat, ...) and two more at the poles, numbered after all others; other columns are null there."""
    poles = points.agg(F.coalesce(F.max("gidx") + 1, F.lit(0)).alias("n")).select(F.inline(F.array(*(F.struct((F.col("n") + k).alias("gidx"), F.lit(0.0).alias("lon"), F.lit(90.0 - 180.0 * k).alias("lat")) for k in (0, 1)))))
    return points.unionByName(poles, allowMissingColumns=True)


def _wave(lon: Column, lat: Column) -> Column:
    return F.sin(F.radians(lon)) * F.cos(F.radians(lat)) + F.sin(F.radians(lat))


def _value(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        grid = healpix(s, 6)
        field = grid.select("gidx", _wave(F.col("lon"), F.col("lat")).alias("value"))
        return apply(structured_weights(customer_points(s, d), grid, kind), field).select("row", (F.round("value", 6) + 0.0).alias("value"))

    return run


def _levels(s: SparkSession) -> DataFrame:
    return s.range(6).select(F.col("id").alias("lev"), (F.col("id") * F.col("id") * 0.04).alias("z"))


def _heights(s: SparkSession, d: str) -> DataFrame:
    return customer_points(s, d).select(F.col("gidx").alias("row"), ((F.col("gidx") % 113) / 100.0 - 0.05).alias("z"))


def _deep(kind: str, vertical: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        grid = healpix(s, 6)
        field = grid.join(F.broadcast(_levels(s))).select("gidx", "lev", (_wave(F.col("lon"), F.col("lat")) * (1.0 + F.col("z"))).alias("value"))  # six levels
        weights = product(structured_weights(customer_points(s, d), grid, kind), vertical(_levels(s), _heights(s, d)))
        return apply_levels(weights, field).select("row", (F.round("value", 6) + 0.0).alias("value"))

    return run


# A field that is linear in z keeps its profile between the levels, whatever the vertical weights: 1 + z, held at both ends.
_SQL = """WITH q AS (SELECT r, least(r, 24 - r) AS q FROM (SELECT unnest(range(1, 24)) AS r)),
g AS (SELECT r - 1 AS j, CASE WHEN q < 6 THEN 4*q ELSE 24 END AS nx, CASE WHEN q < 6 THEN 45.0/q WHEN q = 12 OR q % 2 = 0 THEN 7.5 ELSE 15.0 END::DOUBLE AS x0,
  degrees(asin(CASE WHEN r > 12 THEN -1 ELSE 1 END * CASE WHEN q < 6 THEN 1 - q*q/108.0 ELSE (24.0 - 2.0*q)/18 END)) AS y FROM q),
h AS (SELECT j, nx, x0, y, x0 AS real_x, y AS real_y FROM g UNION ALL SELECT -j - 1, nx, x0 + 180, 180 - y, x0, y FROM g WHERE j < 2 UNION ALL SELECT 45 - j, nx, x0 + 180, -180 - y, x0, y FROM g WHERE j > 20),
c AS (SELECT gidx AS row, lon, lat, j AS j0 FROM {c} t ASOF JOIN (SELECT j, -y AS down FROM h) ON -t.lat >= down),
p AS (SELECT row, lon, lat, k, h.* FROM c JOIN (SELECT unnest({ks}) AS k) ON TRUE JOIN h ON h.j = j0 + k),
y AS (SELECT row, k, list_product([(lat - o.y)/(p.y - o.y) FOR o IN others]) AS wy FROM (SELECT a.row, a.k, any_value(a) AS p, any_value(a.lat) AS lat, list(b) AS others FROM p a JOIN p b ON a.row = b.row AND a.k <> b.k GROUP BY a.row, a.k) AS z),
x AS (SELECT p.row, wy, real_x, real_y, p.k, nx, floor((lon - x0)*nx/360)::BIGINT AS i, (lon - x0)*nx/360 AS u FROM p JOIN y ON p.row = y.row AND p.k = y.k),
w AS (SELECT row, wy, real_x, real_y, nx, i + di AS i, CASE WHEN {linear} THEN CASE di WHEN 0 THEN 1 - (u - i) WHEN 1 THEN u - i ELSE 0 END
  ELSE CASE di WHEN -1 THEN -(u-i)*(u-i-1)*(u-i-2)/6 WHEN 0 THEN (u-i+1)*(u-i-1)*(u-i-2)/2 WHEN 1 THEN -(u-i+1)*(u-i)*(u-i-2)/2 ELSE (u-i+1)*(u-i)*(u-i-1)/6 END END AS wx FROM x, (SELECT unnest([-1, 0, 1, 2]) AS di))
SELECT row, round({factor} * sum(wx*wy*(sin(radians(real_x + i*360.0/nx))*cos(radians(real_y)) + sin(radians(real_y)))), 6) + 0.0 AS value FROM w GROUP BY row"""


def _sql(kind: str, factor: str = "1") -> str:
    linear = {"bilinear": "TRUE", "bicubic": "FALSE", "biquasicubic": "k IN (-1, 2)"}[kind]
    return _SQL.format(c=CUSTOMERS_SQL, ks="[0, 1]" if kind == "bilinear" else "[-1, 0, 1, 2]", linear=linear, factor=factor)


_PROFILE = "(1 + least(1, greatest(0, (row % 113)/100.0 - 0.05)))"


def _trilinear(levels: DataFrame, targets: DataFrame) -> DataFrame:
    from graticula.operators.interpolation import vertical_linear

    return vertical_linear(levels, targets)


def _order(s: SparkSession, d: str) -> int:
    """An even HEALPix order that follows the number of customers."""
    return 2 * max(1, math.isqrt(s.read.parquet(f"{d}/customer.parquet").count()) // 4)


QUERIES = {f"in{n}_reduced_{kind}": _value(kind) for n, kind in zip((9, 10, 11), KINDS, strict=True)}
QUERIES |= {f"in12_structured_tri{kind[2:]}": _deep(kind, _trilinear if kind == "bilinear" else vertical_cubic) for kind in KINDS}
QUERIES |= {
    "in13_vertical_cubic": lambda s, d: vertical_cubic(_levels(s), _heights(s, d)).select("row", "col", (F.round("w", 6) + 0.0).alias("w")),
    "j24_row_stencils": lambda s, d: row_stencils(rows_of(healpix(s, _order(s, d)))).select("j", F.round("y", 6).alias("y"), F.round("south", 6).alias("south"), *(F.col("stencil")[k]["first"].alias(f"first_{k}") for k in range(4))),
    "st4_extended_points": lambda s, d: extended(order_points(s, d).select("gidx", "lon", "lat")).select("gidx", *(F.round(c, 6).alias(c) for c in ("lon", "lat"))),
}
ORACLES = {f"in{n}_reduced_{kind}": _sql(kind) for n, kind in zip((9, 10, 11), KINDS, strict=True)}
ORACLES |= {f"in12_structured_tri{kind[2:]}": _sql(kind, f"any_value{_PROFILE}") for kind in KINDS}
ORACLES |= {
    "in13_vertical_cubic": """WITH t AS (SELECT c_custkey AS row, (c_custkey % 113)/100.0 - 0.05::DOUBLE AS z FROM customer), l AS (SELECT k, (k*k*0.04)::DOUBLE AS h FROM (SELECT unnest(range(6)) AS k)),
 s AS (SELECT row, z, CASE WHEN z <= 0 THEN -1 WHEN z >= 1 THEN 5 ELSE (SELECT max(k) FROM l WHERE h <= z) END AS pos FROM t),
 c AS (SELECT row, z, pos, k, h FROM s, l WHERE CASE pos WHEN -1 THEN k = 0 WHEN 5 THEN k = 5 WHEN 0 THEN k < 2 WHEN 4 THEN k > 3 ELSE k BETWEEN pos - 1 AND pos + 2 END)
 SELECT a.row, a.k AS col, round(coalesce(product((a.z - b.h)/(a.h - b.h)), 1), 6) + 0.0 AS w FROM c a LEFT JOIN c b ON a.row = b.row AND a.k <> b.k GROUP BY a.row, a.k HAVING coalesce(product((a.z - b.h)/(a.h - b.h)), 1) <> 0""",
    "j24_row_stencils": """WITH o AS (SELECT 2*greatest(1, floor(sqrt(count(*)))::BIGINT // 4) AS n FROM customer), q AS (SELECT r, least(r, 4*n - r) AS q, n FROM (SELECT n, unnest(range(1, 4*n)) AS r FROM o)),
g AS (SELECT r - 1 AS j, n, CASE WHEN q < n THEN 4*q ELSE 4*n END AS nx, degrees(asin(CASE WHEN r > 2*n THEN -1 ELSE 1 END * CASE WHEN q < n THEN 1 - q*q/(3.0*n*n) ELSE (4.0*n - 2.0*q)/(3*n) END)) AS y FROM q),
f AS (SELECT j, y, sum(nx) OVER (ORDER BY j) - nx AS first FROM g), m AS (SELECT j, n, CASE WHEN j < 0 THEN -j - 1 WHEN j > 4*n-2 THEN 8*n-3 - j ELSE j END AS real FROM (SELECT n, unnest(range(-2, 4*n + 1)) AS j FROM o)),
h AS (SELECT m.j, CASE WHEN m.j < 0 THEN 180 - y WHEN m.j > 4*n-2 THEN -180 - y ELSE y END AS y, first FROM m JOIN f ON f.j = real)
SELECT b.j::BIGINT AS j, round(b.y, 6) AS y, round(c.y, 6) AS south, a.first::BIGINT AS first_0, b.first::BIGINT AS first_1, c.first::BIGINT AS first_2, e.first::BIGINT AS first_3
FROM h a JOIN h b ON b.j = a.j + 1 JOIN h c ON c.j = b.j + 1 JOIN h e ON e.j = c.j + 1""",
    "st4_extended_points": f"SELECT gidx, lon, lat FROM {POINTS_SQL} UNION ALL SELECT max(o_orderkey) + 1, 0, 90 FROM orders UNION ALL SELECT max(o_orderkey) + 2, 0, -90 FROM orders",
}
