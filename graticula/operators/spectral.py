"""Spectral operators: coefficients in rows (m, n, part, value), part 0 real and 1 imaginary, triangular truncation n <= T.

The inverse transform joins the coefficients with a table of Legendre functions (m, n, j, p), sums over n by (m, j), and puts the waves of each
latitude together by an inverse real FFT, one latitude a group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.sources.grids import gaussian_latitudes, gaussian_weights
from graticula.sources.meshes import customers_field, field_sql, grid_size, size_sql


#: Pairs of a latitude and a wave whose functions a task holds at once.
BLOCK = 1024


def legendre(truncation: int, lats: list[float]) -> np.ndarray:
    """p[j, m, n]: associated Legendre functions, their squares' mean over the sphere 1 for m = 0; by the three-term recurrence."""
    x = np.sin(np.radians(np.asarray(lats)))
    c = np.sqrt(1 - x * x)
    p = np.zeros((len(x), truncation + 1, truncation + 1))
    eps = lambda n, m: math.sqrt((n * n - m * m) / (4 * n * n - 1)) if n > m else 0.0
    p[:, 0, 0] = 1.0
    for m in range(1, truncation + 1):
        p[:, m, m] = p[:, m - 1, m - 1] * c * math.sqrt((2 * m + 1) / (2 * m))
    for m in range(truncation + 1):
        for n in range(m + 1, truncation + 1):
            before = p[:, m, n - 2] * eps(n - 1, m) if n - 2 >= m else 0.0
            p[:, m, n] = (x * p[:, m, n - 1] - before) / eps(n, m)
    return p


def legendre_rows(truncation: int, lats: np.ndarray, m: np.ndarray) -> np.ndarray:
    """p[k, n]: the same functions, of latitude lats[k] and wave m[k], 0 below n = m[k]."""
    x = np.sin(np.radians(lats))
    c = np.sqrt(1 - x * x)
    start = np.ones(len(x))
    for k in range(1, int(m.max(initial=0)) + 1):
        start = np.where(k <= m, start * c * math.sqrt((2 * k + 1) / (2 * k)), start)
    p = np.zeros((len(x), truncation + 1))
    p[np.arange(len(x)), m] = start
    eps = lambda n: np.sqrt(np.maximum(n * n - m * m, 0) / (4 * n * n - 1))
    for n in range(1, truncation + 1):
        before = p[:, n - 2] * eps(n - 1) if n > 1 else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            p[:, n] = np.where(n > m, (x * p[:, n - 1] - before) / eps(n), p[:, n])
    return p


def legendre_table(spark: SparkSession, truncation: int, lats: list[float]) -> DataFrame:
    """The functions as rows (m, n, j, p): written once, it serves any number of transforms.

    Tasks get pairs of a latitude and a wave and hold the functions of a block of them. As latitudes alone, Spark would take the table for as small as their list and broadcast it.
    """

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                j, m = (pdf[c].to_numpy()[at : at + BLOCK] for c in "jm")
                p = legendre_rows(truncation, np.asarray(lats)[j], m)
                k, n = np.nonzero(np.arange(truncation + 1) >= m[:, None])
                yield pd.DataFrame({"m": m[k], "n": n, "j": j[k], "p": p[k, n]})

    j, m = (spark.range(n).select(F.col("id").cast("int").alias(c)) for n, c in ((len(lats), "j"), (truncation + 1, "m")))
    return j.crossJoin(m).mapInPandas(run, "m int, n int, j int, p double")


def inverse_transform(spectra: DataFrame, table: DataFrame, points: list[int]) -> DataFrame:
    """j, i, value on a grid whose row j has points[j] points from lon 0: value = Re sum c(m, n) p e^{i m lon}, m > 0 counted twice."""
    # a table is about as many times larger than its pairs as there are waves, which Spark does not know
    waves = spectra.join(table.hint("merge"), ["m", "n"]).groupBy("j", "m", "part").agg(F.sum(F.col("value") * F.col("p")).alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        j, nx = int(pdf["j"].iloc[0]), points[int(pdf["j"].iloc[0])]
        f = np.zeros(max(nx // 2 + 1, int(pdf["m"].max()) + 1), complex)
        for part, unit in ((0, 1.0), (1, 1j)):
            sel = pdf[(pdf["part"] == part) & ((pdf["m"] > 0) | (part == 0))]
            f[sel["m"].to_numpy()] += unit * sel["w"].to_numpy()
        return pd.DataFrame({"j": j, "i": range(nx), "value": np.fft.irfft(f[: nx // 2 + 1] * nx, nx)})

    return waves.groupBy("j").applyInPandas(run, "j int, i int, value double")


def direct_transform(values: DataFrame, table: DataFrame, weights: list[float]) -> DataFrame:
    """The coefficients of a grid-point field on Gaussian latitudes: one FFT a row, then quadrature over rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.fft.rfft(pdf.sort_values("i")["value"].to_numpy()) / len(pdf)
        j = int(pdf["j"].iloc[0])
        return pd.DataFrame({"j": j, "m": np.repeat(np.arange(len(f)), 2), "part": [0, 1] * len(f), "f": np.column_stack([f.real, f.imag]).ravel() * weights[j]})

    waves = values.groupBy("j").applyInPandas(run, "j int, m int, part int, f double")
    return waves.join(table.hint("merge"), ["m", "j"]).groupBy("m", "n", "part").agg(F.sum(F.col("f") * F.col("p")).alias("value")).select("m", "n", "part", "value")


def norm(spectra: DataFrame, *by: str) -> DataFrame:
    """Square root of the mean square of the field: waves with m > 0 count twice."""
    return spectra.groupBy(*by).agg(F.sqrt(F.sum(F.col("value") ** 2 * F.when(F.col("m") > 0, 2.0).otherwise(1.0))).alias("norm"))


def truncated(spectra: DataFrame, truncation: int) -> DataFrame:
    """The same field at another truncation: waves are dropped, or come in with 0."""
    s = spectra.sparkSession
    m = s.range(truncation + 1).select(F.col("id").cast("int").alias("m"))
    every = m.withColumn("n", F.explode(F.sequence(F.col("m"), F.lit(truncation)))).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    return every.join(spectra, ["m", "n", "part"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def inverse_laplacian(spectra: DataFrame, radius: float = 1.0) -> DataFrame:
    return spectra.withColumn("value", F.when(F.col("n") > 0, F.col("value") * (-radius * radius) / (F.col("n") * (F.col("n") + 1))).otherwise(F.lit(0.0)))


def wind_spectra(vorticity: DataFrame, divergence: DataFrame, truncation: int, radius: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Spectra of u cos(lat) and v cos(lat), up to truncation + 1, from those of vorticity and divergence.

    With stream function and velocity potential psi, chi: U = i m chi - dpsi, V = i m psi + dchi, where d is cos(lat) d/dlat, which takes n
    to n - 1 and n + 1; all of it are joins on shifted n.
    """
    psi, chi = inverse_laplacian(vorticity, radius), inverse_laplacian(divergence, radius)
    eps = lambda n: F.sqrt((n * n - F.col("m") * F.col("m")) / (4.0 * n * n - 1.0))

    def slope(f: DataFrame) -> DataFrame:
        n = F.col("n")
        up = f.select("m", (n + 1).alias("n"), "part", (F.col("value") * (-n) * eps(n + 1)).alias("value"))
        down = f.filter("n > m").select("m", (n - 1).alias("n"), "part", (F.col("value") * (n + 1) * eps(n)).alias("value"))
        return up.unionByName(down)

    def turned(f: DataFrame) -> DataFrame:  # i m f
        sign = F.when(F.col("part") == 1, -1.0).otherwise(1.0)
        return f.select("m", "n", (1 - F.col("part")).alias("part"), (F.col("value") * F.col("m") * sign).alias("value"))

    minus = lambda f: f.withColumn("value", -F.col("value"))
    total = lambda a, b: a.unionByName(b).groupBy("m", "n", "part").agg((F.sum("value") / radius).alias("value"))
    return total(turned(chi), minus(slope(psi))), total(turned(psi), slope(chi))


def table_spectra(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Coefficients made of the customers: (m, n, part) with the number m (T + 1) 2 + 2 n + part takes the mean balance of the keys with that remainder, and T."""
    t = grid_size(spark, sf_dir, "customer")[1]
    size = 2 * (t + 1) * (t + 1)
    k = F.col("node")
    m, n, part = F.floor(k / (2 * t + 2)).cast("int"), F.floor(k % (2 * t + 2) / 2).cast("int"), (k % 2).cast("int")
    f = customers_field(spark, sf_dir, size).select(m.alias("m"), n.alias("n"), part.alias("part"), "value")
    return f.filter("n >= m and (m > 0 or part = 0)"), t


def _inverse(s: SparkSession, d: str) -> DataFrame:
    """On 2 T + 2 points of T + 1 latitudes between the poles."""
    f, t = table_spectra(s, d)
    lats = [90.0 - (j + 0.5) * 180.0 / (t + 1) for j in range(t + 1)]
    return inverse_transform(f, legendre_table(s, t, lats), [2 * t + 2] * (t + 1)).select("j", "i", (F.round("value", 6) + 0.0).alias("value"))


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    f, t = table_spectra(s, d)
    n = t // 2 + 1  # 2 n Gaussian latitudes are exact to this truncation
    table = legendre_table(s, t, gaussian_latitudes(n))
    g = direct_transform(inverse_transform(f, table, [2 * t + 2] * (2 * n)), table, [2 * w for w in gaussian_weights(n)])
    return g.filter((F.col("n") <= t) & ((F.col("m") > 0) | (F.col("part") == 0))).select("m", "n", "part", (F.round(F.col("value") / 2, 6) + 0.0).alias("value"))


def _truncated(s: SparkSession, d: str) -> DataFrame:
    f, t = table_spectra(s, d)
    low = truncated(f, t // 2).withColumn("truncation", F.lit("low"))
    return low.unionByName(truncated(f, t + 3).withColumn("truncation", F.lit("high")))


_S = f"""(SELECT m, n, part, value, t FROM (SELECT node // (2*t+2) AS m, node % (2*t+2) // 2 AS n, node % 2 AS part, value, t FROM {field_sql('2*(ny+1)*(ny+1)', 'customer', 'c_custkey', 'c_acctbal', 'customer')}, (SELECT ny AS t FROM {size_sql('customer')})) WHERE n >= m AND (m > 0 OR part = 0))"""
_EVERY = "(SELECT m, n, part FROM (SELECT unnest(range({t}+1)) AS n), (SELECT unnest(range({t}+1)) AS m), (SELECT unnest([0, 1]) AS part) WHERE n >= m)"
QUERIES = {
    "sp1_inverse_transform": _inverse,
    "sp3_direct_transform": _round_trip,
    "sp5_truncation": _truncated,
    "ag13_spectral_norm": lambda s, d: norm(table_spectra(s, d)[0]).select(F.round("norm", 6).alias("norm")),
    "ag13_spectral_norm_by_wave": lambda s, d: norm(table_spectra(s, d)[0], "n").select("n", F.round("norm", 6).alias("norm")),
}
_NORM = "round(sqrt(sum(value*value*CASE WHEN m > 0 THEN 2 ELSE 1 END)), 6) AS norm"
ORACLES = {
    # the functions by their recurrence in n from p(m, m), for each latitude
    "sp1_inverse_transform": f"""WITH RECURSIVE s AS MATERIALIZED {_S}, y AS (SELECT j, t, sin(radians(90 - (j+0.5)*180.0/(t+1))) AS x FROM (SELECT t, unnest(range(t+1)) AS j FROM (SELECT DISTINCT t FROM s))),
d AS (SELECT j, t, x, 0::BIGINT AS m, 1.0::DOUBLE AS p FROM y UNION ALL SELECT j, t, x, m+1, p*sqrt(1-x*x)*sqrt((2*(m+1)+1)/(2.0*(m+1))) FROM d WHERE m < t),
l AS (SELECT j, t, x, m, m AS n, p, 0.0::DOUBLE AS before FROM d UNION ALL SELECT j, t, x, m, n+1, (x*p - CASE WHEN n > m THEN before*sqrt((n*n-m*m)/(4.0*n*n-1)) ELSE 0 END)/sqrt(((n+1)*(n+1)-m*m)/(4.0*(n+1)*(n+1)-1)), p FROM l WHERE n < t),
w AS (SELECT j, l.m, part, l.t, sum(value*p) AS w FROM l JOIN s ON s.m = l.m AND s.n = l.n GROUP BY j, l.m, part, l.t)
SELECT j::INT AS j, i::INT AS i, round(sum(w*CASE WHEN m > 0 THEN 2 ELSE 1 END*CASE part WHEN 0 THEN cos(2*pi()*m*i/(2*t+2)) ELSE -sin(2*pi()*m*i/(2*t+2)) END), 6) + 0.0 AS value FROM w, (SELECT unnest(range(2*ny+2)) AS i FROM {size_sql('customer')}) GROUP BY j, i""",
    "sp3_direct_transform": f"SELECT m::INT AS m, n::INT AS n, part::INT AS part, round(value, 6) + 0.0 AS value FROM {_S}",
    "sp5_truncation": f"""WITH s AS MATERIALIZED {_S}, q AS (SELECT any_value(t) AS t FROM s), e AS (SELECT 'low' AS truncation, x.* FROM {_EVERY.format(t='(SELECT t // 2 FROM q)')} x UNION ALL SELECT 'high', x.* FROM {_EVERY.format(t='(SELECT t + 3 FROM q)')} x)
SELECT truncation, e.m::INT AS m, e.n::INT AS n, e.part::INT AS part, coalesce(value, 0.0) AS value FROM e LEFT JOIN s ON s.m = e.m AND s.n = e.n AND s.part = e.part""",
    "ag13_spectral_norm": f"SELECT {_NORM} FROM {_S}",
    "ag13_spectral_norm_by_wave": f"SELECT n::INT AS n, {_NORM} FROM {_S} GROUP BY n",
}
