"""Grids and meshes whose size follows a table, with fields made of all its rows: what the mesh queries run on.

orders gives a regular grid of 2 ny by ny points, ny the root of a fourth of its row count; each order counts towards the node with the number that its key leaves as a remainder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticula.sources.grids import regular_lonlat
from graticula.sources.tables import table


def grid_size(spark: SparkSession, sf_dir: str, name: str = "orders") -> tuple[int, int]:
    """nx, ny of the grid of a table."""
    ny = max(3, math.isqrt(table(spark, sf_dir, name).count() // 4))
    return 2 * ny, ny


def orders_grid(spark: SparkSession, sf_dir: str, name: str = "orders") -> tuple[DataFrame, int, int]:
    """gidx, i, j, lon, lat of rows from pole to pole, and nx, ny."""
    nx, ny = grid_size(spark, sf_dir, name)
    return regular_lonlat(spark, nx, ny), nx, ny


def _field(spark: SparkSession, sf_dir: str, n: int, name: str, key: str, value: str) -> DataFrame:
    per = table(spark, sf_dir, name, key, value).groupBy(F.pmod(key, F.lit(n)).cast("long").alias("node")).agg((F.avg(value) / 1000.0).alias("value"))
    # Spark takes the means for a part of their compressed file, so it is told not to broadcast them
    return spark.range(n).withColumnRenamed("id", "node").join(per.hint("merge"), "node", "left").select("node", F.coalesce("value", F.lit(0.0)).alias("value"))


def orders_field(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """node, value: the mean o_totalprice, in thousands, of the orders of each of n nodes; 0 where there is none."""
    return _field(spark, sf_dir, n, "orders", "o_orderkey", "o_totalprice")


def customers_field(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The same of the customers' c_acctbal."""
    return _field(spark, sf_dir, n, "customer", "c_custkey", "c_acctbal")


#: The same in SQL.
def size_sql(name: str) -> str:
    return f"(SELECT 2 * ny AS nx, ny FROM (SELECT greatest(3, floor(sqrt(count(*) // 4))::BIGINT) AS ny FROM {name}))"


SIZE_SQL = size_sql("orders")


def grid_sql(name: str) -> str:
    return f"(SELECT j*nx+i AS gidx, i, j, nx, ny, i*360.0::DOUBLE/nx AS lon, 90.0::DOUBLE - j*(180.0::DOUBLE/(ny-1)) AS lat FROM (SELECT *, unnest(range(ny)) AS j FROM (SELECT nx, ny, unnest(range(nx)) AS i FROM {size_sql(name)})))"


GRID_SQL = grid_sql("orders")
CELLS_SQL = f"(SELECT j*nx+i AS cell, i, j, nx, ny, [(j+1)*nx+i, (j+1)*nx+(i+1)%nx, j*nx+(i+1)%nx, j*nx+i] AS nodes FROM {GRID_SQL} WHERE j < ny - 1)"


def field_sql(n: str, name: str = "orders", key: str = "o_orderkey", value: str = "o_totalprice", size: str = "orders") -> str:
    means = f"(SELECT {key} % (SELECT {n} FROM {size_sql(size)}) AS node, avg({value}) / 1000.0 AS value FROM {name} GROUP BY 1)"
    return f"(SELECT g.node, coalesce(value, 0.0) AS value FROM (SELECT unnest(range({n})) AS node FROM {size_sql(size)}) g LEFT JOIN {means} f ON g.node = f.node)"
