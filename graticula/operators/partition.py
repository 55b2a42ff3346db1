"""Partitioners: rules that give each point its part. All are column expressions, window ranks over bands, or small tables of the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.operators.exchange import renumber
from graticula.sources.tables import POINTS_SQL, order_points


def serial(points: DataFrame, part: int = 0) -> DataFrame:
    return points.withColumn("part", F.lit(part))


def bands(index: Column, parts: int, size: int, block: int = 1) -> Column:
    """Part of a point by its index from 0: blocks of points in equal numbers; size is the number of points."""
    blocks = -(-size // block)
    return F.floor(F.floor(index / block) * parts / blocks).cast("int")


def chunk_sizes(n: int, parts: int) -> list[int]:
    """n in parts, the remainder to the first ones."""
    return [n // parts + (i < n % parts) for i in range(parts)]


def checkerboard(points: DataFrame, parts: int, nx: int, ny: int, size: int) -> DataFrame:
    """Parts in bands from north to south, each cut from west to east: bands hold points in proportion to their parts."""
    wanted = max(1, min(parts, math.floor(math.sqrt(parts * ny / nx) + 0.5)))
    nbands = max(b for b in range(1, wanted + 1) if parts % b == 0)  # all bands have the same number of parts
    per_band = chunk_sizes(parts, nbands)
    counts = [size * p // parts for p in per_band]
    counts[-1] += size - sum(counts)
    return _cut(points, per_band, counts)


def _cut(points: DataFrame, per_band: list[int], counts: list[int], exact: list[list[int]] | None = None) -> DataFrame:
    """Band by rank from north to south, then part by rank from west to east inside the band; both ranks are taken by ranges."""
    y, x = -F.col("lat"), F.col("lon")
    spark = points.sparkSession
    r = ranked(points, [y, x, F.col("gidx")], "__rank")
    edges, acc = [], 0
    for b, c in enumerate(counts):
        edges.append((b, acc, acc + c))
        acc += c
    band = F.lit(None).cast("int")
    for b, lo, hi in reversed(edges):
        band = F.when((F.col("__rank") >= lo) & (F.col("__rank") < hi), F.lit(b)).otherwise(band)
    r = r.withColumn("__band", band)
    # a band holds exactly its count, so a rank over all bands is one inside the band after the edge before
    inner = ranked(r, [F.col("__band"), x, y, F.col("gidx")], "__k")
    start = F.lit(0)
    for b, lo, _ in edges:
        start = F.when(F.col("__band") == b, F.lit(lo)).otherwise(start)
    inner = inner.withColumn("__k", F.col("__k") - start)
    rows, first = [], 0
    for b, (p, c) in enumerate(zip(per_band, counts, strict=True)):
        at = 0
        for i, s in enumerate(exact[b] if exact else [c // p] * (p - 1) + [c - (c // p) * (p - 1)]):
            rows.append((b, at, at + s, first + i))
            at += s
        first += p
    table = spark.createDataFrame(rows, "__b int, __lo long, __hi long, part int")  # a row for each part
    cond = (F.col("__band") == F.col("__b")) & (F.col("__k") >= F.col("__lo")) & (F.col("__k") < F.col("__hi"))
    return inner.drop("part").join(F.broadcast(table), cond).drop("__band", "__k", "__rank", "__b", "__lo", "__hi")


def ranked(points: DataFrame, order: list[Column], name: str) -> DataFrame:
    """points with a rank from 0 by an order, by ranges of equal share whatever its values; the order must end on a unique key."""
    keyed = points.withColumn("__key", F.struct(*(c.alias(f"k{n}") for n, c in enumerate(order))))
    return renumber(keyed, "__key", name).withColumn(name, F.col(name) - 1).drop("__key")


def equal_region_layout(parts: int) -> list[int]:
    """Regions in each band from pole to pole: caps of one region, collars of near-square regions of equal area."""
    if parts == 1:
        return [1]
    if parts == 2:
        return [1, 1]
    area = 4 * math.pi / parts
    cap = 2 * math.asin(math.sqrt(area / math.pi) / 2)
    collars = max(1, round((math.pi - 2 * cap) / math.sqrt(area)))
    fit = (math.pi - 2 * cap) / collars
    out, carry = [1], 0.0
    for k in range(collars):
        ring = 2 * math.pi * (math.cos(cap + k * fit) - math.cos(cap + (k + 1) * fit))
        n = round(ring / area + carry)
        carry += ring / area - n
        out.append(n)
    return [*out, 1]


def equal_regions(points: DataFrame, parts: int, size: int) -> DataFrame:
    """Balanced parts in bands of equal-area regions: sizes differ by one at most, the larger ones first."""
    layout = equal_region_layout(parts)
    sizes, exact, at = chunk_sizes(size, parts), [], 0
    for n in layout:
        exact.append(sizes[at : at + n])
        at += n
    return _cut(points, layout, [sum(e) for e in exact], exact)


def equal_area(parts: int) -> Column:
    """Part of a point by the region that holds it: a band by latitude, then a sector by longitude."""
    layout, area = equal_region_layout(parts), 4 * math.pi / parts
    done, first, out = 0, 0, None
    branches = []
    for n in layout:
        done += n
        south = math.degrees(math.pi / 2 - 2 * math.asin(min(1.0, math.sqrt(done * area / math.pi) / 2)))
        sector = F.floor(F.radians(F.col("lon")) * n / (2 * math.pi + 1e-8)).cast("int")
        branches.append((F.col("lat") >= south if done < parts else F.lit(True), F.least(sector, F.lit(n - 1)) + first))
        first += n
    for cond, value in reversed(branches):
        out = value if out is None else F.when(cond, value).otherwise(out)
    return out


def summary(points: DataFrame) -> DataFrame:
    return points.groupBy("part").agg(F.count("*").alias("n"), F.min("gidx").alias("least"), F.max("gidx").alias("most"))


def _n(s: SparkSession, d: str) -> int:
    return order_points(s, d).count()


QUERIES = {
    "pt3_checkerboard_points": lambda s, d: checkerboard(order_points(s, d), 12, 360, 179, _n(s, d)).select("gidx", "part"),
    "pt4_equal_regions_points": lambda s, d: equal_regions(order_points(s, d), 12, _n(s, d)).select("gidx", "part"),
    "pt1_serial": lambda s, d: serial(order_points(s, d).select("gidx")),
    "pt2_bands": lambda s, d: order_points(s, d).select("gidx", bands(F.col("gidx"), 7, 20000, 16).alias("part")),
    "pt3_checkerboard": lambda s, d: checkerboard(order_points(s, d), 12, 360, 179, _n(s, d)).groupBy("part").agg(F.count("*").alias("n")),
    "pt4_equal_regions": lambda s, d: summary(equal_regions(order_points(s, d), 20, _n(s, d))).select("part", "n"),
    "pt5_equal_area": lambda s, d: order_points(s, d).select("gidx", equal_area(2).alias("part")),
    "pt9_distribution": lambda s, d: summary(order_points(s, d)),
}
_RANKED = f"SELECT gidx, lon, lat, row_number() OVER (ORDER BY -lat, lon, gidx) - 1 AS r, count(*) OVER () AS n FROM {POINTS_SQL}"
ORACLES = {
    "pt3_checkerboard": f"WITH b AS (SELECT *, CASE WHEN r < n*6//12 THEN 0 ELSE 1 END AS band FROM ({_RANKED})), k AS (SELECT band, row_number() OVER (PARTITION BY band ORDER BY lon, -lat, gidx) - 1 AS k, count(*) OVER (PARTITION BY band) AS c FROM b) SELECT (band*6 + least(k // (c//6), 5))::INT AS part, count(*) AS n FROM k GROUP BY 1",
    "pt3_checkerboard_points": f"WITH b AS (SELECT *, CASE WHEN r < n*6//12 THEN 0 ELSE 1 END AS band FROM ({_RANKED})), k AS (SELECT gidx, band, row_number() OVER (PARTITION BY band ORDER BY lon, -lat, gidx) - 1 AS k, count(*) OVER (PARTITION BY band) AS c FROM b) SELECT gidx, (band*6 + least(k // (c//6), 5))::INT AS part FROM k",
    # twelve regions: two caps and two collars of five; sizes differ by one at most
    "pt4_equal_regions_points": f"""WITH s AS (SELECT p, (SELECT count(*) FROM orders) AS n, CASE WHEN p = 0 THEN 0 WHEN p < 6 THEN 1 WHEN p < 11 THEN 2 ELSE 3 END AS band FROM (SELECT unnest(range(12)) AS p)),
 e AS (SELECT p, band, (sum(n//12 + (p < n%12)::INT) OVER (ORDER BY p))::BIGINT AS hi, n//12 + (p < n%12)::INT AS m FROM s),
 b AS (SELECT *, (SELECT min(band) FROM e WHERE hi > r) AS band FROM ({_RANKED})), k AS (SELECT gidx, band, row_number() OVER (ORDER BY band, lon, -lat, gidx) - 1 AS k FROM b)
 SELECT gidx, (SELECT min(p) FROM e WHERE hi > k)::INT AS part FROM k""",
    "pt1_serial": "SELECT o_orderkey AS gidx, 0 AS part FROM orders",
    "pt2_bands": "SELECT o_orderkey AS gidx, floor(floor(o_orderkey/16)*7/1250)::INT AS part FROM orders",
    "pt4_equal_regions": "WITH t AS (SELECT count(*) AS n FROM orders) SELECT p::INT AS part, n // 20 + (CASE WHEN p < n % 20 THEN 1 ELSE 0 END) AS n FROM t, (SELECT unnest(range(20)) AS p)",
    "pt5_equal_area": f"SELECT gidx, CASE WHEN lat >= 0 THEN 0 ELSE 1 END AS part FROM {POINTS_SQL}",
    "pt9_distribution": "SELECT (o_orderkey % 4)::INT AS part, count(*) AS n, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders GROUP BY 1",
}
