"""Scalar geometry on the sphere as column expressions: degrees in and out, x towards lon 0, z towards the north pole."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from graticula.sources.tables import POINTS_SQL, order_points

EARTH_RADIUS = 6371229.0


def xyz(lon: Column, lat: Column, radius: float = 1.0) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(a) * F.cos(b) * radius, F.sin(a) * F.cos(b) * radius, F.sin(b) * radius


def lonlat(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def normalise(lon: Column, west: float = 0.0, eps: float = 1e-11) -> Column:
    """Into [west, west + 360); what is within eps below west counts as west."""
    return lon - F.floor((lon - west + eps) / 360.0) * 360.0


def chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Straight-line distance on the unit sphere."""
    (a, b, c), (d, e, f) = xyz(lon1, lat1), xyz(lon2, lat2)
    return F.sqrt((a - d) * (a - d) + (b - e) * (b - e) + (c - f) * (c - f))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 1.0) -> Column:
    """Great-circle distance, well behaved for near points: half the chord is the sine of half the angle."""
    return F.asin(F.least(chord(lon1, lat1, lon2, lat2) / 2.0, F.lit(1.0))) * (2.0 * radius)


def course(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    """Bearings (degrees) of the great circle at its start and at its end; equal points give (0, 0)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    c1 = F.atan2(F.cos(p2) * F.sin(dl), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))
    c2 = F.atan2(F.cos(p1) * F.sin(dl), -F.cos(p2) * F.sin(p1) + F.sin(p2) * F.cos(p1) * F.cos(dl))
    same = (lon1 == lon2) & (lat1 == lat2)
    return tuple(F.when(same, F.lit(0.0)).otherwise(F.degrees(c)) for c in (c1, c2))


def microdegrees(x: Column) -> Column:
    """Degrees to whole microdegrees, half away from zero."""
    return F.round(x * 1e6).cast("long")


def unique_lonlat(lon: Column, lat: Column) -> Column:
    """One integer for a point: latitude in the high bits, descending, longitude in the low 31."""
    return F.shiftleft(F.lit(360_000_000).cast("long") - microdegrees(lat), 31).bitwiseOR(microdegrees(lon) + F.lit(1_440_000_000))


def rotated(lon: Column, lat: Column, pole_lon: float, pole_lat: float, angle: float = 0.0, back: bool = False) -> tuple[Column, Column]:
    """Coordinates turned so that the south pole of the rotated frame is at (pole_lon, pole_lat); back: the reverse."""
    t, o = math.radians(-(90.0 + pole_lat)), math.radians(-pole_lon)
    ct, st, co, so = math.cos(t), math.sin(t), math.cos(o), math.sin(o)
    turn = [[ct * co, -ct * so, st], [so, co, 0.0], [-st * co, st * so, ct]]
    if back:
        turn = [list(r) for r in zip(*turn, strict=True)]
    v = xyz(lon if back else lon - F.lit(angle), lat)
    rot = [[turn[j][i] for j in range(3)] for i in range(3)]
    x, y, z = (sum((v[k] * rot[i][k] for k in range(1, 3)), v[0] * rot[i][0]) for i in range(3))
    a, b = lonlat(x, y, z)
    return (a + F.lit(angle) if back else a), b


def flag_set(flags: Column, mask: int) -> Column:
    return flags.bitwiseOR(F.lit(mask))


def flag_check(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == mask


def _shortest_to_longest(sides: list[Column]) -> Column:
    return F.least(*sides) / F.greatest(*sides)


def triangle_quality(*points: tuple[Column, Column]) -> tuple[Column, Column]:
    """eta and rho of a spherical triangle (three lon, lat) by its sides as central angles in degrees.

    eta: 4 sqrt(3) times the area by Heron's rule over the sum of squared sides, 1 for an equilateral and 0 for a flat triangle. rho: the
    shortest side over the longest. Both are null for three equal points.
    """
    a, b, c = (F.degrees(distance(*points[k], *points[k - 2])) for k in range(3))
    half = (a + b + c) / 2.0
    area = F.sqrt(F.greatest(half * (half - a) * (half - b) * (half - c), F.lit(0.0)))
    squares = a * a + b * b + c * c
    return F.when(squares > 0, area * (4.0 * math.sqrt(3.0)) / squares), F.when(squares > 0, _shortest_to_longest([a, b, c]))


def quad_quality(*points: tuple[Column, Column]) -> tuple[Column, Column]:
    """eta and rho of a spherical quadrilateral: how far the corner that is least square is from flat, and the shortest side over the longest."""
    corners = [xyz(*p) for p in points]
    edges = [[b - a for a, b in zip(corners[k], corners[(k + 1) % 4], strict=True)] for k in range(4)]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    turns = [F.acos(-dot(edges[k - 1], edges[k]) / F.sqrt(dot(edges[k - 1], edges[k - 1]) * dot(edges[k], edges[k]))) for k in range(4)]
    worst = F.greatest(*(F.abs(t - math.pi / 2) for t in turns))
    sides = [distance(*points[k], *points[(k + 1) % 4]) for k in range(4)]
    return F.greatest(1.0 - worst * (2.0 / math.pi), F.lit(0.0)), _shortest_to_longest(sides)


def barycentric(px: Column, py: Column, corners: list[tuple[Column, Column]]) -> tuple[Column, Column, Column]:
    """Weights of a planar triangle's corners at a point."""
    (x1, y1), (x2, y2), (x3, y3) = corners
    d = (y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)
    a = ((y2 - y3) * (px - x3) + (x3 - x2) * (py - y3)) / d
    b = ((y3 - y1) * (px - x3) + (x1 - x3) * (py - y3)) / d
    return a, b, 1.0 - a - b


def hilbert(x: Column, y: Column, order: int = 16) -> Column:
    """Hilbert index of integer cells (x, y) in [0, 2**order): one step of the curve for each bit, as nested structs."""
    state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, k: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))
        rx = (acc["x"].bitwiseAND(s) > 0).cast("long")
        ry = (acc["y"].bitwiseAND(s) > 0).cast("long")
        d = acc["d"] + s * s * (rx * 3).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        fx = F.when(flip, s - 1 - acc["x"].bitwiseAND(s - 1)).otherwise(acc["x"].bitwiseAND(s - 1))
        fy = F.when(flip, s - 1 - acc["y"].bitwiseAND(s - 1)).otherwise(acc["y"].bitwiseAND(s - 1))
        swap = ry == 0
        return F.struct(F.when(swap, fy).otherwise(fx).alias("x"), F.when(swap, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), state, step, lambda acc: acc["d"])


def domain_hilbert(x: Column, y: Column, west: float, east: float, south: float, north: float, levels: int = 15) -> Column:
    """Place of a point on two Hilbert curves side by side, one for each half of a box twice as wide as high, west half first.

    A curve runs from the half's north-west corner down and up again to its north-east one, through 4**levels cells.
    """
    half = (x >= (west + east) / 2).cast("long")
    cells = 2**levels
    along = (x - west) / ((east - west) / 2) - half
    cell = lambda c: F.least(F.greatest(F.floor(c * cells), F.lit(0)), F.lit(cells - 1))
    return hilbert(cell(along), cell((north - y) / (north - south)), levels) + half * 4**levels


def torus(x: Column, y: Column, west: float, east: float, south: float, north: float, nx: int, ny: int, major: float = 2.0, minor: float = 1.0) -> tuple[Column, Column, Column]:
    """A plane of nx by ny points, doubly periodic, on a ring: x goes round the ring, y round its tube."""
    a = -math.pi + (x - west) * (2 * math.pi * (nx - 1) / nx / (east - west))
    b = -math.pi + (y - south) * (2 * math.pi * (ny - 1) / ny / (north - south))
    reach = major + minor * F.cos(b)
    return F.cos(a) * reach, F.sin(a) * reach, F.sin(b) * minor


def _p(s: SparkSession, d: str):
    return order_points(s, d).select("gidx", "lon", "lat")


def _six(**cols: Column) -> list[Column]:
    return [F.col("gidx"), *((F.round(c, 6) + 0.0).alias(n) for n, c in cols.items())]  # no negative zero


def _xyz(s: SparkSession, d: str):
    x, y, z = xyz(F.col("lon"), F.col("lat"), EARTH_RADIUS)
    return _p(s, d).select(F.col("gidx"), *((F.round(c, 3) + 0.0).alias(n) for n, c in (("x", x), ("y", y), ("z", z))))


def _back(s: SparkSession, d: str):
    lon, lat = lonlat(*xyz(F.col("lon") - 180.0 + 0.5, F.col("lat")))
    return _p(s, d).select(*_six(lon=lon, lat=lat))


def _course(s: SparkSession, d: str):
    a, b = course(F.col("lon"), F.col("lat"), F.lit(10.5), F.lit(45.25))
    return _p(s, d).select(*_six(start=a, finish=b))


def _rotate(s: SparkSession, d: str):
    lon, lat = rotated(F.col("lon"), F.col("lat"), 10.0, -40.0)
    return _p(s, d).select(*_six(x=F.cos(F.radians(lon)) * F.cos(F.radians(lat)), lat=lat))


def _round_trip(s: SparkSession, d: str):
    lon, lat = rotated(F.col("lon"), F.col("lat"), 25.0, -30.0)
    p = _p(s, d).select("gidx", lon.alias("a"), lat.alias("b"))
    lon, lat = rotated(F.col("a"), F.col("b"), 25.0, -30.0, back=True)
    return p.select("gidx", F.round(normalise(lon, -0.5), 6).alias("lon"), F.round(lat, 6).alias("lat"))


def _hilbert(s: SparkSession, d: str):
    return _p(s, d).select("gidx", hilbert(F.col("lon").cast("int"), (F.col("lat") + 89).cast("int"), 9).alias("key"))


def _quality(s: SparkSession, d: str, rule, fixed: list[tuple[float, float]], last: tuple[float, float]):
    """A shape of fixed corners and one that moves with the points."""
    corners = [(F.lit(x), F.lit(y)) for x, y in fixed] + [(F.col("lon") / 180 + last[0], F.col("lat") / 90 + last[1])]
    eta, rho = rule(*corners)
    return _p(s, d).select(*_six(eta=eta, rho=rho))


def _torus(s: SparkSession, d: str):
    x, y, z = torus(F.col("lon"), F.col("lat"), 0.0, 359.0, -89.0, 89.0, 360, 179)
    return _p(s, d).select(*_six(x=x, y=y, z=z))


QUERIES = {
    "me7_torus": _torus,
    "sf11_domain_hilbert": lambda s, d: _p(s, d).select("gidx", domain_hilbert(F.col("lon"), F.col("lat"), 0.0, 360.0, -90.0, 90.0, 10).alias("key")),
    "sf1_rotate": _rotate,
    "sf1_unrotate": _round_trip,
    "sf2_lonlat_to_xyz": _xyz,
    "sf2_xyz_to_lonlat": _back,
    "sf3_distance": lambda s, d: _p(s, d).select("gidx", F.round(distance(F.col("lon"), F.col("lat"), F.lit(10.5), F.lit(45.25), EARTH_RADIUS), 2).alias("meters"), F.round(chord(F.col("lon"), F.col("lat"), F.lit(10.5), F.lit(45.25)), 8).alias("chord")),
    "sf4_course": _course,
    "sf5_normalise": lambda s, d: _p(s, d).select("gidx", normalise(F.col("lon") * 3 - 500, -180.0).alias("lon")),
    "sf6_unique_id": lambda s, d: _p(s, d).select("gidx", unique_lonlat(F.col("lon"), F.col("lat")).alias("uid")),
    "sf7_microdegrees": lambda s, d: _p(s, d).select("gidx", microdegrees(F.col("lat") / 7).alias("micro")),
    "sf8_flags": lambda s, d: _p(s, d).select("gidx", flag_set((F.col("gidx") % 16).cast("int"), 4).alias("flags"), flag_check((F.col("gidx") % 16).cast("int"), 6).alias("both")),
    "sf9_units": lambda s, d: _p(s, d).select(*_six(radians=F.radians("lon"), degrees=F.degrees(F.radians("lat")))),
    "sf11_hilbert": _hilbert,
    "sf13_pack": lambda s, d: _p(s, d).select("gidx", F.struct("lon", "lat").alias("v")).select("gidx", F.col("v.lon").alias("u"), F.col("v.lat").alias("w")),
    "sf16_triangle_quality": lambda s, d: _quality(s, d, triangle_quality, [(0.0, 0.0), (8.0, 1.0)], (10.0, 5.0)),
    "sf16_quad_quality": lambda s, d: _quality(s, d, quad_quality, [(0.0, 0.0), (8.0, 1.0), (9.0, 12.0)], (-3.0, 8.0)),
    "sf17_barycentric": lambda s, d: _p(s, d).select("gidx", *((F.round(w, 6) + 0.0).alias(n) for n, w in zip("abc", barycentric(F.col("lon"), F.col("lat"), [(F.lit(0.0), F.lit(-90.0)), (F.lit(360.0), F.lit(-90.0)), (F.lit(100.0), F.lit(90.0))]), strict=True))),
    "sf20_periodic": lambda s, d: _p(s, d).select("gidx", (F.col("lon") + F.lit(360.0) * (F.col("gidx") % 3 - 1)).alias("lon")),
}


def _angle(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"degrees(acos(least(1, sin(radians({lat1}))*sin(radians({lat2})) + cos(radians({lat1}))*cos(radians({lat2}))*cos(radians({lon1} - ({lon2}))))))"


def _unit(lon: str, lat: str) -> str:
    return f"[cos(radians({lon}))*cos(radians({lat})), sin(radians({lon}))*cos(radians({lat})), sin(radians({lat}))]"


_C = "2*asin(least(sqrt(power(cos(radians(lon))*cos(radians(lat))-cos(radians(10.5))*cos(radians(45.25)),2)+power(sin(radians(lon))*cos(radians(lat))-sin(radians(10.5))*cos(radians(45.25)),2)+power(sin(radians(lat))-sin(radians(45.25)),2))/2,1))"
ORACLES = {
    "me7_torus": f"SELECT gidx, round(cos(a)*(2+cos(b)), 6) + 0.0 AS x, round(sin(a)*(2+cos(b)), 6) + 0.0 AS y, round(sin(b), 6) + 0.0 AS z FROM (SELECT gidx, -pi() + lon*2*pi()/360 AS a, -pi() + (lat+89)*2*pi()/179 AS b FROM {POINTS_SQL})",
    "sf1_rotate": f"""WITH p AS (SELECT gidx, radians(lon) AS l, radians(lat) AS b, radians(-50.0) AS t, radians(-10.0) AS o FROM {POINTS_SQL}),
 v AS (SELECT gidx, t, o, cos(l)*cos(b) AS x, sin(l)*cos(b) AS y, sin(b) AS z FROM p),
 r AS (SELECT gidx, cos(t)*cos(o)*x + sin(o)*y - sin(t)*cos(o)*z AS x, sin(t)*x + cos(t)*z AS z FROM v)
 SELECT gidx, round(x, 6) + 0.0 AS x, round(degrees(asin(z)), 6) + 0.0 AS lat FROM r""",
    "sf1_unrotate": f"SELECT gidx, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {POINTS_SQL}",
    "sf2_lonlat_to_xyz": f"SELECT gidx, round(6371229.0*cos(radians(lon))*cos(radians(lat)),3) + 0.0 AS x, round(6371229.0*sin(radians(lon))*cos(radians(lat)),3) + 0.0 AS y, round(6371229.0*sin(radians(lat)),3) + 0.0 AS z FROM {POINTS_SQL}",
    "sf2_xyz_to_lonlat": f"SELECT gidx, round(lon - 179.5, 6) AS lon, round(lat, 6) AS lat FROM {POINTS_SQL}",
    "sf3_distance": f"SELECT gidx, round(6371229.0*{_C}, 2) AS meters, round(2*sin({_C}/2), 8) AS chord FROM {POINTS_SQL}",
    "sf4_course": f"""WITH p AS (SELECT gidx, radians(lat) AS p1, radians(45.25) AS p2, radians(10.5-lon) AS dl FROM {POINTS_SQL})
 SELECT gidx, round(degrees(atan2(cos(p2)*sin(dl), cos(p1)*sin(p2)-sin(p1)*cos(p2)*cos(dl))),6) AS start, round(degrees(atan2(cos(p1)*sin(dl), -cos(p2)*sin(p1)+sin(p2)*cos(p1)*cos(dl))),6) AS finish FROM p""",
    "sf5_normalise": f"SELECT gidx, (lon*3-500) - floor((lon*3-500+180)/360.0)*360.0 AS lon FROM {POINTS_SQL}",
    "sf6_unique_id": f"SELECT gidx, ((360000000 - lat*1000000)::BIGINT << 31) | (lon*1000000 + 1440000000)::BIGINT AS uid FROM {POINTS_SQL}",
    "sf7_microdegrees": f"SELECT gidx, round(lat/7*1e6)::BIGINT AS micro FROM {POINTS_SQL}",
    "sf8_flags": f"SELECT gidx, ((gidx % 16)::INT | 4) AS flags, ((gidx % 16)::INT & 6) = 6 AS both FROM {POINTS_SQL}",
    "sf9_units": f"SELECT gidx, round(radians(lon),6) AS radians, round(lat,6) AS degrees FROM {POINTS_SQL}",
    "sf13_pack": f"SELECT gidx, lon AS u, lat AS w FROM {POINTS_SQL}",
    "sf16_triangle_quality": f"""WITH s AS (SELECT gidx, {_angle('0', '0', '8', '1')} AS a, {_angle('8', '1', 'lon/180 + 10', 'lat/90 + 5')} AS b, {_angle('lon/180 + 10', 'lat/90 + 5', '0', '0')} AS c FROM {POINTS_SQL})
 SELECT gidx, round(sqrt(3)*sqrt((a+b+c)*(b+c-a)*(a+c-b)*(a+b-c))/(a*a+b*b+c*c), 6) + 0.0 AS eta, round(least(a,b,c)/greatest(a,b,c), 6) + 0.0 AS rho FROM s""",
    "sf16_quad_quality": f"""WITH p AS (SELECT gidx, lon/180 - 3 AS l, lat/90 + 8 AS b FROM {POINTS_SQL}),
 x AS (SELECT gidx, [[1.0, 0.0, 0.0], {_unit('8', '1')}, {_unit('9', '12')}, {_unit('l', 'b')}] AS c, {_angle('0', '0', '8', '1')} AS s1, {_angle('8', '1', '9', '12')} AS s2, {_angle('9', '12', 'l', 'b')} AS s3, {_angle('l', 'b', '0', '0')} AS s4 FROM p),
 e AS (SELECT gidx, k, list_transform(list_zip(c[k], c[(k + 2) % 4 + 1]), lambda v: v[2] - v[1]) AS u, list_transform(list_zip(c[k], c[k % 4 + 1]), lambda v: v[2] - v[1]) AS w FROM x, (SELECT unnest([1, 2, 3, 4]) AS k)),
 a AS (SELECT gidx, max(abs(pi()/2 - acos(list_dot_product(u, w)/sqrt(list_dot_product(u, u)*list_dot_product(w, w))))) AS worst FROM e GROUP BY gidx)
 SELECT gidx, round(greatest(1 - worst*2/pi(), 0), 6) + 0.0 AS eta, round(least(s1,s2,s3,s4)/greatest(s1,s2,s3,s4), 6) + 0.0 AS rho FROM a JOIN x USING (gidx)""",
    "sf17_barycentric": f"SELECT gidx, round(1-b-c,6) + 0.0 AS a, round(b,6) + 0.0 AS b, round(c,6) + 0.0 AS c FROM (SELECT gidx, (lat+90)/180 AS c, (lon - 100*(lat+90)/180)/360 AS b FROM {POINTS_SQL})",
    "sf20_periodic": f"SELECT gidx, lon + 360.0*(gidx % 3 - 1) AS lon FROM {POINTS_SQL}",
}
