"""Embedding whitening by a one-sided Jacobi singular value decomposition.

The vectors' entries become whole numbers, whose sums are exact. Each task centres its rows and reduces them, a block at a time, to one upper
triangle R (QR of the triangle so far on top of the next block); triangles are merged FAN at a time until few are left, so neither a task nor
the driver holds more than some triangles of dimension x dimension. Plane rotations, in rounds of disjoint pairs, make R's columns orthogonal: the accumulated
rotations are the components, the lengths of the columns over the root of n their standard deviations. R'R is never formed, so small ones are exact as well.

Defined cases: vectors that are null or hold null or non-finite entries are left out; repeated rows and null ids are ordinary rows; vectors of
different lengths, and entries beyond 2 ** 40, are refused; components along which all vectors are equal (to rounding) have no whitened
coordinate and are left out, so a table of one vector, of equal vectors or of empty ones gives no row, as an empty table does; ties of
eigenvalues take any basis, the same for all rows; further columns do not take part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.llm.common import written

BLOCK = 4096  # rows of a block
FAN = 16  # triangles that are merged at once
SCALE, OFFSET = 1024, 100_000
LIMIT = float(1 << 40)


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x (array of long) of all rows whose vector is complete and finite."""
    e = F.col(f"`{embedding}`")
    whole = F.forall(e, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))

    def entry(c: Column) -> Column:
        c = c.cast("double")
        return F.when(F.abs(c) <= LIMIT, F.floor(SCALE * c) + OFFSET).otherwise(F.raise_error(F.lit("an entry is too large")).cast("long"))

    return vectors.filter(e.isNotNull() & whole).select(F.col(f"`{vec_id}`").alias("vec_id"), F.transform(e, entry).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    n = len(column)
    values = column.flatten().to_numpy()
    if n and (len(values) % n or (np.diff(column.offsets.to_numpy()) != len(values) // n).any()):
        raise ValueError("vectors of different lengths")
    return values.reshape(n, -1) if n else values.reshape(0, 0)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension: a row for each dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                if total is not None and x.shape[1] != len(total):
                    raise ValueError("vectors of different lengths")
                n, total = n + len(x), x.sum(0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(np.full(len(total), n)), pa.array(total), pa.array(np.full(len(total), len(total)))], ["at", "n", "s", "size"])

    found = rows.select("x").mapInArrow(run, "at long, n long, s long, size long")
    found = found.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("size").alias("low"), F.max("size").alias("high")).orderBy("at").collect()
    if len({(r.low, r.high) for r in found}) > 1 or any(r.low != r.high for r in found):
        raise ValueError("vectors of different lengths")
    return (found[0].n if found else 0), [r.s for r in found]


def triangle(rows: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of all centred rows."""
    d = len(mean)

    def pack(r: np.ndarray, key: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["key", "r"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, d))
        for batch in batches:
            x = _matrix(batch.column(0)).reshape(batch.num_rows, d)
            for at in range(0, len(x), BLOCK):
                r = np.linalg.qr(np.concatenate((r, x[at : at + BLOCK] - mean)), "r")
        if len(r):
            yield pack(r, TaskContext.get().partitionId())

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.concatenate([np.frombuffer(x).reshape(-1, d) for x in pdf.sort_values("key")["r"]]), "r")
        return pd.DataFrame({"key": [key[0]], "r": [r.tobytes()]})

    out = written(rows.select("x").mapInArrow(local, "key long, r binary"), "triangles")
    while out.count() > FAN:
        merged = out.groupBy(F.expr(f"key div {FAN}").alias("__k")).applyInPandas(merge, "key long, r binary")
        out = written(merged, "triangles")
    last = out.orderBy("key").collect()  # at most FAN
    return np.linalg.qr(np.concatenate([np.frombuffer(x.r).reshape(-1, d) for x in last]), "r") if last else np.zeros((0, d))


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors (columns), by plane rotations from the right."""
    a, d = r.astype(float).copy(), r.shape[1]
    v = np.eye(d)
    odd = d % 2
    seats = np.arange(d + odd)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(1, d + odd - 1)):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            ok = (p < d) & (q < d)
            p, q = p[ok], q[ok]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            on = np.abs(xy) > 1e-15 * np.sqrt(xx * yy)
            swap = xx < yy  # the longer column first
            if on.any() or swap.any():
                turned |= bool(on.any())
                zeta = (yy - xx) / np.where(on, 2 * xy, 1)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                t = np.where(on, t, 0.0)
                c = 1 / np.hypot(1, t)
                s = c * t
                for m in (a, v):
                    x, y = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            seats = np.concatenate((seats[:1], np.roll(seats[1:], 1)))
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


def whitened(vectors: DataFrame, components: int = 8, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n, deviation (decimal), coordinates (array of whitened coordinates), explained (array) and identity_error of every complete row."""
    spark = vectors.sparkSession
    rows = scaled(vectors, vec_id, embedding)
    kind = rows.schema["vec_id"].dataType.simpleString()
    columns = f"vec_id {kind}, n long, deviation decimal(38,0), coordinates array<double>, explained array<double>, identity_error double"
    n, sums = exact_sums(rows)
    d = len(sums)
    if not n or not d:
        return spark.createDataFrame([], columns)
    mean = np.array([s / n for s in sums])
    r = triangle(rows, mean)
    sigma, v = jacobi(r)
    # rounding of the mean leaves equal entries about this far from zero
    noise = math.sqrt(n) * np.abs(mean).max() * d * 2**-50
    k = min(components, int((sigma > max(noise, sigma[0] * d * 2**-50)).sum()))
    if not k:
        return spark.createDataFrame([], columns)
    turn = v[:, :k] / (sigma[:k] / math.sqrt(n))
    explained = sigma[:k] ** 2 / float((r * r).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sums, object)
        for batch in batches:
            x = _matrix(batch.column(1)).reshape(batch.num_rows, d)
            y = (x - mean) @ turn
            # n * x - S in 64 bits where it and the sum of its squares fit, else in Python's integers
            off = (np.abs(x - mean).max(initial=0) + 1) * n
            if np.abs(x).max(initial=0) * float(n) < 2.0**62 and off * off * d < 2.0**62:
                deviation = pa.array(((n * x - exact.astype(np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([int(((n * row.astype(object) - exact) ** 2).sum()) for row in x], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], ["vec_id", "deviation", "coordinates"])

    out = written(rows.mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), coordinates array<double>"), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = out.agg(*(F.covar_pop(F.col("coordinates")[i], F.col("coordinates")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return out.select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", "coordinates", F.array(*(F.lit(float(e)) for e in explained)).alias("explained"), F.lit(float(error)).alias("identity_error")
    )


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("coordinates", "explained")).alias("at", "c")
    rows = rows.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", each)
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.coordinates").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


QUERIES = {"op11_jacobi_whitening": op11_jacobi_whitening}
