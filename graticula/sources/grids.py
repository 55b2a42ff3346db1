"""Grids as tables (gidx, i, j, x, y, lon, lat): points are generated by executors from a small table of rows (one for each latitude).

gidx counts from 0, west to east in each row, rows from north to south.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.sources.tables import POINTS_SQL, order_points

# Spacings: lists of the driver, as long as a grid has rows.


def linear(start: float, end: float, n: int, endpoint: bool = True) -> list[float]:
    """n values; both ends are exact."""
    if n == 1:
        return [start]
    step = (end - start) / (n - 1 if endpoint else n)
    out = [start + k * step for k in range(n)]
    if endpoint:
        out[-1] = end
    return out


def focus(start: float, end: float, n: int, factor: float) -> list[float]:
    """Values that are denser around the middle for a factor above 1: a tangent's steps are flattened by it and turned back."""
    if n == 1:
        return [(start + end) / 2]
    tangents = [math.tan(math.pi * (k / (n - 1) - 0.5)) for k in range(1, n - 1)]
    return [start, *((start + end) / 2 + (end - start) * math.atan(t / factor) / math.pi for t in tangents), end]


def gaussian_latitudes(n: int) -> list[float]:
    """The 2 n latitudes in degrees from north to south."""
    nodes, _ = np.polynomial.legendre.leggauss(2 * n)
    return [math.degrees(math.asin(x)) for x in sorted(nodes, reverse=True)]


def gaussian_weights(n: int) -> list[float]:
    """Weights of the same latitudes: half of the quadrature weights, so each hemisphere has one half."""
    nodes, weights = np.polynomial.legendre.leggauss(2 * n)
    return [float(w) / 2 for _, w in sorted(zip(nodes, weights, strict=True), reverse=True)]


def vertical_levels(n: int) -> list[float]:
    return linear(0.0, 1.0, n)


# Rows (j, y, nx, x0, dx) and points.


def from_rows(spark: SparkSession, rows: list[tuple[float, int, float, float]], turn: float | None = None) -> DataFrame:
    """Points of rows (y, nx, first x, dx). With a turn, the length of all rows, steps are rounded once (i * turn / nx): the same longitude is the same number in rows of any length.

    Rows are joined to the places in the longest one, not exploded: Spark takes an explode for as large as what goes in, and so would broadcast whole grids later on.
    """
    table, at = [], 0
    for j, (y, nx, x0, dx) in enumerate(rows):
        table.append((j, float(y), nx, float(x0), float(dx), at))
        at += nx
    parts = max(1, min(len(table), at // 100_000 + 1))
    t = spark.createDataFrame(table, "j int, y double, nx int, x0 double, dx double, first long").repartition(parts)
    places = spark.range(max((r[2] for r in table), default=0)).select(F.col("id").cast("int").alias("i"))
    t = t.join(F.broadcast(places), F.col("i") < F.col("nx"))
    x = F.col("x0") + (F.col("i") * F.col("dx") if turn is None else F.col("i") * F.lit(turn) / F.col("nx"))
    return t.select((F.col("first") + F.col("i")).alias("gidx"), "i", "j", x.alias("x"), "y", x.alias("lon"), F.col("y").alias("lat"))


def octahedral(spark: SparkSession, n: int, start: int = 20) -> DataFrame:
    lats = gaussian_latitudes(n)
    nx = [start + 4 * j for j in range(n)]
    return from_rows(spark, [(y, k, 0.0, 360.0 / k) for y, k in zip(lats, nx + nx[::-1], strict=True)], 360.0)


def reduced(spark: SparkSession, points: list[int]) -> DataFrame:
    """A reduced Gaussian grid with the given points in each row from pole to pole."""
    return from_rows(spark, [(y, k, 0.0, 360.0 / k) for y, k in zip(gaussian_latitudes(len(points) // 2), points, strict=True)], 360.0)


def regular_gaussian(spark: SparkSession, n: int) -> DataFrame:
    return from_rows(spark, [(y, 4 * n, 0.0, 360.0 / (4 * n)) for y in gaussian_latitudes(n)])


def regular_lonlat(spark: SparkSession, nx: int, ny: int, shift_x: bool = False, shift_y: bool = False) -> DataFrame:
    dx, dy = 360.0 / nx, 180.0 / (ny if shift_y else ny - 1)
    x0 = dx / 2 if shift_x else 0.0
    ys = [90.0 - dy / 2 - j * dy for j in range(ny)] if shift_y else linear(90.0, -90.0, ny)
    return from_rows(spark, [(y, nx, x0, dx) for y in ys])


def healpix(spark: SparkSession, n: int) -> DataFrame:
    """12 n^2 points on 4 n - 1 rings."""
    rows = []
    for r in range(1, 4 * n):
        ring = min(r, 4 * n - r)
        if ring < n:  # a polar cap
            z, nx = 1.0 - ring * ring / (3.0 * n * n), 4 * ring
            z, start = (z if r < 2 * n else -z), 45.0 / ring
        else:
            z, nx = (4.0 * n - 2.0 * r) / (3.0 * n), 4 * n
            # every other ring is turned by half a step; on the equator an odd n begins at 0
            odd = (min(r, 4 * n - r) - n) % 2
            start = 45.0 * (1 + odd) / n if r != 2 * n else 45.0 * (1 - odd) / n
        rows.append((math.degrees(math.asin(z)), nx, start, 360.0 / nx))
    return from_rows(spark, rows)


def regional(spark: SparkSession, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int) -> DataFrame:
    """ny rows from y0 southwards."""
    return from_rows(spark, [(y0 - j * dy, nx, x0, dx) for j in range(ny)])


def zonal_band(spark: SparkSession, nx: int, ny: int, south: float, north: float) -> DataFrame:
    return from_rows(spark, [(y, nx, 0.0, 360.0 / nx) for y in linear(north, south, ny)])


def cubed_sphere(spark: SparkSession, n: int) -> DataFrame:
    """Cell centres of 6 tiles of n x n cells, equal angles: the tiles' frames are turned by column expressions."""
    cells = spark.range(6 * n * n).select(
        F.col("id").alias("gidx"), F.floor(F.col("id") / (n * n)).cast("int").alias("tile"), F.floor(F.col("id") % (n * n) / n).cast("int").alias("j"), (F.col("id") % n).cast("int").alias("i")
    )
    a, b = (F.tan(((F.col(c) + 0.5) / n * 2.0 - 1.0) * (math.pi / 4)) for c in ("i", "j"))
    one = F.lit(1.0)
    frames = [(one, a, b), (-a, one, b), (-one, -a, b), (a, -one, b), (-b, a, one), (b, a, -one)]
    pick = lambda k: F.coalesce(*(F.when(F.col("tile") == t, f[k]) for t, f in enumerate(frames)))
    out = cells.withColumns({"px": pick(0), "py": pick(1), "pz": pick(2)})
    lon = F.degrees(F.atan2("py", "px"))
    lon = F.when(lon < 0, lon + 360.0).otherwise(lon)
    return out.select("gidx", "i", "j", "tile", lon.alias("lon"), F.degrees(F.atan2("pz", F.sqrt(F.col("px") ** 2 + F.col("py") ** 2))).alias("lat"))


def unstructured(points: DataFrame) -> DataFrame:
    return points.select(F.col("gidx"), F.col("lon").alias("x"), F.col("lat").alias("y"), "lon", "lat")


# Domains.


def in_rectangle(x: Column, y: Column, west: float, east: float, south: float, north: float, eps: float = 1e-12) -> Column:
    return x.between(west - eps, east + eps) & y.between(south - eps, north + eps)


def in_zonal_band(lon: Column, lat: Column, south: float, north: float, west: float = 0.0, east: float = 360.0, eps: float = 1e-12) -> Column:
    """Longitudes are taken modulo 360, from west on."""
    turned = lon - F.floor((lon - west + eps) / 360.0) * 360.0
    return lat.between(south - eps, north + eps) & (turned <= east + eps)


def cropped(grid: DataFrame, domain: Column) -> DataFrame:
    return grid.filter(domain)


# Names: the first pattern that matches makes the grid.

BUILDERS: list[tuple[str, Callable]] = [
    (r"[Oo](\d+)$", lambda s, n: octahedral(s, int(n))),
    (r"[Ff](\d+)$", lambda s, n: regular_gaussian(s, int(n))),
    (r"[Hh](\d+)$", lambda s, n: healpix(s, int(n))),
    (r"[Ll](\d+)x(\d+)$", lambda s, a, b: regular_lonlat(s, int(a), int(b))),
    (r"[Ll](\d+)$", lambda s, n: regular_lonlat(s, 4 * int(n), 2 * int(n) + 1)),
    (r"Slon(\d+)x(\d+)$", lambda s, a, b: regular_lonlat(s, int(a), int(b), shift_x=True)),
    (r"Slat(\d+)x(\d+)$", lambda s, a, b: regular_lonlat(s, int(a), int(b), shift_y=True)),
    (r"S(\d+)x(\d+)$", lambda s, a, b: regular_lonlat(s, int(a), int(b), shift_x=True, shift_y=True)),
    (r"CS-LFR-(?:C-)?(\d+)$", lambda s, n: cubed_sphere(s, int(n))),
]


def register(pattern: str, build: Callable) -> None:
    """A further kind of grid, looked at before the others."""
    BUILDERS.insert(0, (pattern, build))


def grid(spark: SparkSession, name: str) -> DataFrame:
    for pattern, build in BUILDERS:
        if m := re.match(pattern, name):
            return build(spark, *m.groups())
    raise ValueError(f"no grid is called {name}")


def uid(spec: dict) -> str:
    """The same for equal specifications, whatever the order of their keys."""
    return hashlib.md5(json.dumps(spec, sort_keys=True).encode()).hexdigest()


def row_offsets(points: DataFrame) -> DataFrame:
    """j, nx and first: enough to turn (i, j) into gidx and back."""
    return points.groupBy("j").agg(F.count("*").alias("nx"), F.min("gidx").alias("first"))


def index_to_ij(index: DataFrame, offsets: DataFrame) -> DataFrame:
    """index (gidx) with i and j: rows and indices meet in bins as wide as the mean row, so an index meets a few rows."""
    mean = offsets.agg(F.max(F.col("first") + F.col("nx")).alias("n"), F.count("*").alias("rows")).first()  # one row
    width = max(1, (mean["n"] or 1) // max(1, mean["rows"]))
    bins = F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"(first + nx - 1) div {width}"))).alias("bin")
    binned = offsets.filter("nx > 0").select("j", "first", "nx", bins)
    hit = index.withColumn("bin", F.expr(f"gidx div {width}")).join(binned, "bin").filter("gidx >= first and gidx < first + nx")
    return hit.select("gidx", (F.col("gidx") - F.col("first")).alias("i"), "j")


# Analytic fields.


def vortex_rollup(lon: Column, lat: Column, t: float) -> Column:
    """A vortex that rolls up around a turned pole."""
    a, b = F.radians(lon), F.radians(lat)
    lon0, lat0 = math.pi / 2, 0.0
    turned_lat = F.asin(F.sin(b) * math.sin(lat0) + F.cos(b) * math.cos(lat0) * F.cos(a - lon0))
    turned_lon = F.atan2(F.cos(b) * F.sin(a - lon0), F.cos(b) * math.sin(lat0) * F.cos(a - lon0) - math.cos(lat0) * F.sin(b))
    rho = F.cos(turned_lat) * 3.0
    v = F.tanh(rho) / F.cosh(rho) / F.cosh(rho) * (1.5 * math.sqrt(3.0))
    omega = F.when(F.abs(rho) < 1e-12, F.lit(0.0)).otherwise(v / rho)
    return 1.0 - F.tanh(rho / 5.0 * F.sin(turned_lon - omega * (2 * math.pi * t)))


def solid_body(lon: Column, lat: Column, beta: float) -> tuple[Column, Column]:
    """Wind of a rotating sphere whose axis is turned by beta degrees."""
    a, b, t = F.radians(lon), F.radians(lat), math.radians(beta)
    return F.cos(b) * math.cos(t) + F.cos(a) * F.sin(b) * math.sin(t), -F.sin(a) * math.sin(t)


def spherical_harmonic(lon: Column, lat: Column, n: int, m: int) -> Column:
    """Real part, with the normalised associated Legendre function by its three-term recurrence in column form."""
    x, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    p = F.lit(1.0)
    for k in range(1, m + 1):
        p = p * c * math.sqrt((2 * k + 1) / (2 * k))
    before, now = F.lit(0.0), p
    for k in range(m + 1, n + 1):
        e = lambda q: math.sqrt((q * q - m * m) / (4 * q * q - 1)) if q > m else 0.0
        before, now = now, (x * now - before * e(k - 1)) * (1.0 / e(k))
    return now * F.cos(F.radians(lon) * m)


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_ll = lambda df: _r(df.select("gidx", "i", "j", "lon", "lat"))


def _size(s: SparkSession, d: str) -> tuple[int, int]:
    """The grid of orders (see meshes.py)."""
    ny = max(3, math.isqrt(s.read.parquet(f"{d}/orders.parquet").count() // 4))
    return 2 * ny, ny


def _on_grid(s: SparkSession, d: str, **columns: Callable[[Column, Column], Column]) -> DataFrame:
    return _r(regular_lonlat(s, *_size(s, d)).select("gidx", *(f(F.col("lon"), F.col("lat")).alias(n) for n, f in columns.items())))


def _rows_sized(s: SparkSession, d: str) -> DataFrame:
    """A classic reduced grid: two rows of 8, two of 12, and so on towards the equator."""
    ny = _size(s, d)[1] // 2 * 2
    return from_rows(s, [(y, 4 * (min(j, ny - 1 - j) // 2 + 2), 0.0, 90.0 / (min(j, ny - 1 - j) // 2 + 2)) for j, y in enumerate(gaussian_latitudes(ny // 2))])


def _orders_index(s: SparkSession, d: str) -> DataFrame:
    """The keys of orders, as indices of an octahedral grid."""
    n = _size(s, d)[1]
    g = octahedral(s, n)
    index = s.read.parquet(f"{d}/orders.parquet").select(F.pmod("o_orderkey", F.lit(4 * n * (n + 9))).cast("long").alias("gidx")).distinct()
    return index_to_ij(index, row_offsets(g))


_ring = lambda df: _r(df.select("gidx", "i", "j", "lon"))
QUERIES = {
    "g1_reduced_gaussian": lambda s, d: _ring(_rows_sized(s, d)),
    "g2_octahedral": lambda s, d: _ring(grid(s, f"O{_size(s, d)[1]}")),
    "g3_regular_gaussian": lambda s, d: _ring(grid(s, f"F{_size(s, d)[1] // 2}")),
    "g4_regular_lonlat": lambda s, d: _ll(grid(s, "L{}x{}".format(*_size(s, d)))),
    "g5_shifted_lonlat": lambda s, d: _ll(grid(s, "S{}x{}".format(*_size(s, d)))),
    "g5_shifted_lon": lambda s, d: _ll(grid(s, "Slon{}x{}".format(*_size(s, d)))),
    "g5_shifted_lat": lambda s, d: _ll(regular_lonlat(s, *_size(s, d), shift_y=True)),
    "g6_healpix": lambda s, d: _r(grid(s, f"H{_size(s, d)[1] // 4 * 2}").select("gidx", "lon", "lat")),
    "g6_healpix_odd": lambda s, d: _r(grid(s, f"H{_size(s, d)[1] // 4 * 2 + 1}").select("gidx", "lon", "lat")),
    "g19_focus": lambda s, d: _r(s.createDataFrame(list(enumerate(focus(0.0, 1.0, _size(s, d)[0] + 1, 4.0))), "k int, value double")),
    "g7_cubed_sphere": lambda s, d: _r(cubed_sphere(s, max(2, _size(s, d)[1] // 4 * 2)).select("gidx", "tile", "i", "j", "lon", "lat")),
    "g9_regional": lambda s, d: _ll(regional(s, 10.0, 60.0, 0.5, 0.25, *_size(s, d))),
    "g9_zonal_band": lambda s, d: _ll(zonal_band(s, *_size(s, d), -20.0, 20.0)),
    "g12_unstructured": lambda s, d: _r(unstructured(order_points(s, d).select("gidx", "lon", "lat"))),
    "g13_cropped": lambda s, d: _ll(cropped(regular_lonlat(s, *_size(s, d)), in_rectangle(F.col("lon"), F.col("lat"), 0.0, 45.0, -30.0, 30.0))),
    "f1_domain_zonal_band": lambda s, d: order_points(s, d).select("gidx", in_zonal_band(F.col("lon"), F.col("lat"), 10.0, 50.0, -90.0, 45.0).alias("inside")),
    "g15_index_to_ij": _orders_index,
    "g23_solid_body": lambda s, d: _on_grid(s, d, u=lambda a, b: solid_body(a, b, 30.0)[0], v=lambda a, b: solid_body(a, b, 30.0)[1]),
    "g23_spherical_harmonic": lambda s, d: _on_grid(s, d, value=lambda a, b: spherical_harmonic(a, b, 2, 1)),
    "g23_vortex_rollup": lambda s, d: _on_grid(s, d, value=lambda a, b: vortex_rollup(a, b, 0.0)),
}
_SIZE = "(SELECT 2 * ny AS nx, ny FROM (SELECT greatest(3, floor(sqrt(count(*) // 4))::BIGINT) AS ny FROM orders))"
_G = f"(SELECT *, unnest(range(ny)) AS j FROM (SELECT nx, ny, unnest(range(nx)) AS i FROM {_SIZE}))"
_LL = f"SELECT j*nx+i AS gidx, i::INT AS i, j::INT AS j, round(({{sx}} + i*360.0/nx)::DOUBLE, 6) AS lon, round(({{north}} - j*{{dy}})::DOUBLE, 6) + 0.0 AS lat FROM {_G}"
_LONLAT = _LL.format(sx="0.0", north="90.0", dy="180.0/(ny-1)")
_PLANE = f"(SELECT j*nx+i AS gidx, radians(i*360.0/nx) AS a, radians(90 - j*180.0/(ny-1)) AS b FROM {_G})"
# rings by their distance q from the nearer pole; the belt's rings begin at 45/n and 90/n in turn, the equator at 45/n or 0
_HEALPIX = f"""WITH r AS (SELECT r, least(r, 4*n - r) AS q, n FROM (SELECT n, unnest(range(1, 4*n)) AS r FROM (SELECT ny // 4 * 2 + {{odd}} AS n FROM {_SIZE}))),
s AS (SELECT r, n, CASE WHEN q < n THEN 4*q ELSE 4*n END AS nx, CASE WHEN q < n THEN 45.0/q WHEN q = 2*n THEN CASE WHEN n % 2 = 0 THEN 45.0/n ELSE 0 END
  WHEN (q - n) % 2 = 0 THEN 45.0/n ELSE 90.0/n END AS start, CASE WHEN r > 2*n THEN -1 ELSE 1 END * CASE WHEN q < n THEN 1 - q*q/(3.0*n*n) ELSE (4.0*n - 2.0*q)/(3*n) END AS z FROM r),
f AS (SELECT *, sum(nx) OVER (ORDER BY r) - nx AS before FROM s)
SELECT (before + i)::BIGINT AS gidx, round((start + i*360.0/nx)::DOUBLE, 6) + 0.0 AS lon, round(degrees(asin(z::DOUBLE)), 6) + 0.0 AS lat FROM (SELECT *, unnest(range(nx)) AS i FROM f)"""
_RING = "SELECT (sum_ + i)::BIGINT AS gidx, i::INT AS i, j::INT AS j, round((i*360.0/nx)::DOUBLE, 6) AS lon FROM (SELECT *, unnest(range(nx)) AS i FROM (SELECT j, nx, sum(nx) OVER (ORDER BY j) - nx AS sum_ FROM ({rows})))"
_OCTA = f"SELECT j, 20 + 4*least(j, 2*n-1-j) AS nx FROM (SELECT n, unnest(range(2*n)) AS j FROM (SELECT ny AS n FROM {_SIZE}))"
# the six frames, turned tile by tile
_CUBE = f"""WITH c AS (SELECT n, t, i, j, tan(((i+0.5)/n*2-1)*pi()/4) AS a, tan(((j+0.5)/n*2-1)*pi()/4) AS b FROM (SELECT *, unnest(range(6)) AS t FROM (SELECT *, unnest(range(n)) AS j FROM (SELECT n, unnest(range(n)) AS i FROM (SELECT greatest(2, ny // 4 * 2) AS n FROM {_SIZE}))))),
p AS (SELECT *, CASE t WHEN 0 THEN [1, a, b] WHEN 1 THEN [-a, 1, b] WHEN 2 THEN [-1, -a, b] WHEN 3 THEN [a, -1, b] WHEN 4 THEN [-b, a, 1] ELSE [b, a, -1] END::DOUBLE[] AS v FROM c)
SELECT t*n*n + j*n + i AS gidx, t::INT AS tile, i::INT AS i, j::INT AS j, round(degrees(atan2(v[2], v[1])) + CASE WHEN atan2(v[2], v[1]) < 0 THEN 360 ELSE 0 END, 6) + 0.0 AS lon, round(degrees(atan2(v[3], sqrt(v[1]*v[1] + v[2]*v[2]))), 6) + 0.0 AS lat FROM p"""
ORACLES = {
    "g1_reduced_gaussian": _RING.format(rows=f"SELECT j, 4*(least(j, n-1-j)//2 + 2) AS nx FROM (SELECT n, unnest(range(n)) AS j FROM (SELECT ny//2*2 AS n FROM {_SIZE}))"),
    "g2_octahedral": _RING.format(rows=_OCTA),
    "g3_regular_gaussian": _RING.format(rows=f"SELECT unnest(range(ny//2*2)) AS j, 4*(ny//2) AS nx FROM {_SIZE}"),
    "g4_regular_lonlat": _LONLAT,
    "g5_shifted_lonlat": _LL.format(sx="180.0/nx", north="90.0 - 90.0/ny", dy="180.0/ny"),
    "g5_shifted_lon": _LL.format(sx="180.0/nx", north="90.0", dy="180.0/(ny-1)"),
    "g5_shifted_lat": _LL.format(sx="0.0", north="90.0 - 90.0/ny", dy="180.0/ny"),
    "g6_healpix": _HEALPIX.format(odd=0),
    "g6_healpix_odd": _HEALPIX.format(odd=1),
    "g19_focus": f"SELECT k::INT AS k, round(CASE WHEN k = 0 THEN 0.0 WHEN k = nx THEN 1.0 ELSE 0.5 + atan(tan(pi()/2*(-1 + 2.0*k/nx))/4)/pi() END, 6) AS value FROM (SELECT nx, unnest(range(nx + 1)) AS k FROM {_SIZE})",
    "g7_cubed_sphere": _CUBE,
    "g9_regional": f"SELECT j*nx+i AS gidx, i::INT AS i, j::INT AS j, (10 + i*0.5)::DOUBLE AS lon, (60 - j*0.25)::DOUBLE AS lat FROM {_G}",
    "g9_zonal_band": _LL.format(sx="0.0", north="20.0", dy="40.0/(ny-1)"),
    "g12_unstructured": f"SELECT gidx, lon AS x, lat AS y, lon, lat FROM {POINTS_SQL}",
    "g13_cropped": f"SELECT * FROM ({_LONLAT}) WHERE lon <= 45 AND abs(lat) <= 30",
    "f1_domain_zonal_band": f"SELECT gidx, lat BETWEEN 10 AND 50 AND (lon <= 45 OR lon >= 270) AS inside FROM {POINTS_SQL}",
    "g15_index_to_ij": f"WITH r AS (SELECT j, nx, sum(nx) OVER (ORDER BY j) - nx AS f, sum(nx) OVER () AS n FROM ({_OCTA})) SELECT gidx, (gidx - f)::BIGINT AS i, j::INT AS j FROM (SELECT DISTINCT o_orderkey % (SELECT any_value(n) FROM r)::BIGINT AS gidx FROM orders) JOIN r ON gidx >= f AND gidx < f + nx",
    "g23_solid_body": f"SELECT gidx, round(cos(b)*cos(radians(30)) + cos(a)*sin(b)*sin(radians(30)), 6) + 0.0 AS u, round(-sin(a)*sin(radians(30)), 6) + 0.0 AS v FROM {_PLANE}",
    "g23_spherical_harmonic": f"SELECT gidx, round(sqrt(1.5)*cos(b)*sin(b)*sqrt(5.0)*cos(a), 6) + 0.0 AS value FROM {_PLANE}",
    "g23_vortex_rollup": f"SELECT gidx, round(1 - tanh(3*cos(q)/5*sin(atan2(cos(b)*sin(a-pi()/2), -sin(b)))), 6) + 0.0 AS value FROM (SELECT *, asin(cos(b)*cos(a-pi()/2)) AS q FROM {_PLANE})",
}
