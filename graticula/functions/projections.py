"""Map projections as column expressions: (lon, lat) in degrees to (x, y) and back."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.functions.geometry import EARTH_RADIUS, normalise, rotated
from graticula.sources.tables import POINTS_SQL, order_points

Pair = tuple[Column, Column]


@dataclass(frozen=True)
class LonLat:
    pole: tuple[float, float] | None = None  # of the rotated frame's south pole
    angle: float = 0.0

    def forward(self, lon: Column, lat: Column) -> Pair:
        return rotated(lon, lat, *self.pole, self.angle, back=True) if self.pole else (lon, lat)

    def inverse(self, x: Column, y: Column) -> Pair:
        return rotated(x, y, *self.pole, self.angle) if self.pole else (x, y)

    def jacobian(self, lon: Column, lat: Column) -> Column:
        return F.struct(F.lit(1.0).alias("dx_dlon"), F.lit(0.0).alias("dx_dlat"), F.lit(0.0).alias("dy_dlon"), F.lit(1.0).alias("dy_dlat"))


@dataclass(frozen=True)
class Mercator:
    lon0: float = 0.0
    lat1: float = 0.0
    radius: float = EARTH_RADIUS

    def forward(self, lon: Column, lat: Column) -> Pair:
        k, s = self.radius * math.cos(math.radians(self.lat1)), F.sin(F.radians(lat))
        return F.radians(normalise(lon - self.lon0, -180.0)) * k, F.log((1.0 + s) / (1.0 - s)) * (k / 2)

    def inverse(self, x: Column, y: Column) -> Pair:
        k = self.radius * math.cos(math.radians(self.lat1))
        return F.degrees(x / k) + self.lon0, F.degrees(F.lit(math.pi / 2) - F.atan(F.exp(-y / k)) * 2.0)


@dataclass(frozen=True)
class Schmidt:
    """Latitudes stretched by the factor c."""

    c: float

    def _stretch(self, lat: Column, c: float) -> Column:
        colat = F.acos(F.sin(F.radians(lat)))
        return F.degrees(F.asin(F.cos(F.atan(F.tan(colat / 2.0) * c) * 2.0)))

    def forward(self, lon: Column, lat: Column) -> Pair:
        return lon, self._stretch(lat, self.c)

    def inverse(self, x: Column, y: Column) -> Pair:
        return x, self._stretch(y, 1.0 / self.c)


@dataclass(frozen=True)
class LambertConformalConic:
    lon0: float
    lat0: float
    lat1: float
    lat2: float
    radius: float = EARTH_RADIUS

    def _constants(self) -> tuple[float, float, float]:
        t = lambda p: math.tan(math.pi / 4 + math.radians(p) / 2)
        c1, c2 = math.cos(math.radians(self.lat1)), math.cos(math.radians(self.lat2))
        n = math.sin(math.radians(self.lat1)) if self.lat1 == self.lat2 else math.log(c1 / c2) / math.log(t(self.lat2) / t(self.lat1))
        f = c1 * t(self.lat1) ** n / n
        return n, f, self.radius * f * t(self.lat0) ** -n

    def forward(self, lon: Column, lat: Column) -> Pair:
        n, f, rho0 = self._constants()
        rho = F.pow(F.tan(F.radians(lat) / 2.0 + math.pi / 4), F.lit(-n)) * (self.radius * f)
        theta = F.radians(normalise(lon - self.lon0, -180.0)) * n
        return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> Pair:
        n, f, rho0 = self._constants()
        sign = 1.0 if n > 0 else -1.0
        dy = F.lit(rho0) - y
        rho = F.sqrt(x * x + dy * dy) * sign
        theta = F.atan2(x * sign, dy * sign)
        lat = F.atan(F.pow(F.lit(self.radius * f) / rho, F.lit(1.0 / n))) * 2.0 - math.pi / 2
        return F.degrees(theta / n) + self.lon0, F.degrees(lat)


@dataclass(frozen=True)
class LambertAzimuthalEqualArea:
    lon0: float
    lat1: float
    radius: float = EARTH_RADIUS

    def forward(self, lon: Column, lat: Column) -> Pair:
        a, b, p = F.radians(lon - self.lon0), F.radians(lat), math.radians(self.lat1)
        k = F.sqrt(F.lit(2.0) / (F.sin(b) * math.sin(p) + F.cos(b) * F.cos(a) * math.cos(p) + 1.0)) * self.radius
        return k * F.cos(b) * F.sin(a), k * (F.sin(b) * math.cos(p) - F.cos(b) * F.cos(a) * math.sin(p))

    def inverse(self, x: Column, y: Column) -> Pair:
        p, rho = math.radians(self.lat1), F.sqrt(x * x + y * y)
        c = F.asin(rho / (2 * self.radius)) * 2.0
        lat = F.when(rho < 1e-12, F.lit(self.lat1)).otherwise(F.degrees(F.asin(F.cos(c) * math.sin(p) + y * F.sin(c) * math.cos(p) / rho)))
        lon = F.when(rho < 1e-12, F.lit(0.0)).otherwise(F.degrees(F.atan2(x * F.sin(c), rho * F.cos(c) * math.cos(p) - y * F.sin(c) * math.sin(p))))
        return lon + self.lon0, lat


def projected(points: DataFrame, projection) -> DataFrame:
    x, y = projection.forward(F.col("lon"), F.col("lat"))
    return points.withColumns({"x": x, "y": y})


def bounding_box(points: DataFrame, projection) -> DataFrame:
    """Of projected points x, y: the least and greatest lon and lat."""
    lon, lat = projection.inverse(F.col("x"), F.col("y"))
    q = points.select(lon.alias("lon"), lat.alias("lat"))
    return q.agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))


def _p(s: SparkSession, d: str) -> DataFrame:
    return order_points(s, d).select("gidx", "lon", "lat")


def _forward(projection, digits: int = 2):
    return lambda s, d: projected(_p(s, d), projection).select("gidx", (F.round("x", digits) + 0.0).alias("x"), (F.round("y", digits) + 0.0).alias("y"))


def _back(projection):
    def query(s: SparkSession, d: str) -> DataFrame:
        p = projected(_p(s, d), projection)
        lon, lat = projection.inverse(F.col("x"), F.col("y"))
        return p.select("gidx", F.round(normalise(lon, -0.5), 5).alias("lon"), (F.round(lat, 5) + 0.0).alias("lat"))

    return query


_LCC, _LAEA = LambertConformalConic(10.0, 45.0, 30.0, 60.0), LambertAzimuthalEqualArea(10.5, 52.5)  # no point lies opposite to this centre
_SAME = f"SELECT gidx, round(lon, 5) AS lon, round(lat, 5) AS lat FROM {POINTS_SQL}"
_DL = "radians(lon - 10 - floor((lon - 10 + 180)/360.0)*360)"
QUERIES = {
    "pr1_rotated_round_trip": _back(LonLat((20.0, -35.0))),
    "pr2_mercator": _forward(Mercator(10.0)),
    "pr2_mercator_inverse": _back(Mercator(10.0)),
    "pr3_schmidt": _forward(Schmidt(2.4), 6),
    "pr3_schmidt_inverse": _back(Schmidt(2.4)),
    "pr4_lambert_conformal": _forward(_LCC),
    "pr4_lambert_conformal_inverse": _back(_LCC),
    "pr5_lambert_azimuthal": lambda s, d: _forward(_LAEA)(s, d),
    "pr5_lambert_azimuthal_inverse": _back(_LAEA),
    "pr10_bounding_box": lambda s, d: bounding_box(projected(_p(s, d), Mercator(180.0)), Mercator(180.0)).select(*(F.round(c, 4).alias(c) for c in ("west", "east", "south", "north"))),
}
ORACLES = {
    "pr1_rotated_round_trip": _SAME,
    "pr2_mercator": f"SELECT gidx, round(6371229.0*{_DL}, 2) + 0.0 AS x, round(6371229.0/2*ln((1+sin(radians(lat)))/(1-sin(radians(lat)))), 2) + 0.0 AS y FROM {POINTS_SQL}",
    "pr2_mercator_inverse": _SAME,
    "pr3_schmidt": f"SELECT gidx, round(lon, 6) AS x, round(degrees(asin(cos(2*atan(2.4*tan(acos(sin(radians(lat)))/2))))), 6) + 0.0 AS y FROM {POINTS_SQL}",
    "pr3_schmidt_inverse": _SAME,
    "pr4_lambert_conformal": f"""WITH c AS (SELECT ln(cos(radians(30))/cos(radians(60)))/ln(tan(pi()/4+radians(60)/2)/tan(pi()/4+radians(30)/2)) AS n),
 k AS (SELECT n, 6371229.0*cos(radians(30))*power(tan(pi()/4+radians(30)/2), n)/n AS f FROM c)
 SELECT gidx, round(f*power(tan(pi()/4+radians(lat)/2), -n)*sin(n*{_DL}), 2) + 0.0 AS x, round(f*power(tan(pi()/4+radians(45)/2), -n) - f*power(tan(pi()/4+radians(lat)/2), -n)*cos(n*{_DL}), 2) + 0.0 AS y FROM k, {POINTS_SQL}""",
    "pr4_lambert_conformal_inverse": _SAME,
    "pr5_lambert_azimuthal": f"""WITH p AS (SELECT gidx, radians(lon-10.5) AS a, radians(lat) AS b, radians(52.5) AS p FROM {POINTS_SQL}),
 k AS (SELECT *, 6371229.0*sqrt(2/(1+sin(p)*sin(b)+cos(p)*cos(b)*cos(a))) AS k FROM p)
 SELECT gidx, round(k*cos(b)*sin(a), 2) + 0.0 AS x, round(k*(cos(p)*sin(b)-sin(p)*cos(b)*cos(a)), 2) + 0.0 AS y FROM k""",
    "pr5_lambert_azimuthal_inverse": _SAME,
    "pr10_bounding_box": f"SELECT round(min(lon),4) AS west, round(max(lon),4) AS east, round(min(lat),4) AS south, round(max(lat),4) AS north FROM {POINTS_SQL}",
}
